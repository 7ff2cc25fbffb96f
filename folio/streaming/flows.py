"""Record flows: each takes a batch or a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAYS, LATE = 7, "1 hour"
#: Sessions merge at a distance equal to the gap, edits only below 800 ms.
GAP = "799999 microseconds"


def last_beats(heartbeats: DataFrame) -> DataFrame:
    """session, project, at, clean_exit of the last beat of heartbeats(session, project, at, clean_exit)."""
    valid = heartbeats.where("session is not null and project is not null and at is not null")
    last = valid.groupBy("session").agg(F.max(F.struct("at", "clean_exit", "project")).alias("_last"))
    return last.select("session", "_last.project", "_last.at", "_last.clean_exit")


def interrupted_sessions(beats: DataFrame, now) -> DataFrame:
    """project, session, at: the newest session of each project whose last beat is no clean exit and 0 to 7 days old at now (a literal or a column)."""
    open_ = beats.where(~F.coalesce("clean_exit", F.lit(False)) & (F.col("at") <= now) & (F.col("at") >= now - F.expr(f"interval {DAYS} days")))
    return open_.groupBy("project").agg(F.max(F.struct("at", "session")).alias("_last")).select("project", "_last.session", "_last.at")


def receipt_counts(receipts: DataFrame) -> DataFrame:
    """hour, kind, receipts of receipts(id, kind, at); an id counts once. On a stream, repeats are known for as long as events may be late."""
    if receipts.isStreaming:
        once = receipts.withWatermark("at", LATE).dropDuplicatesWithinWatermark(["id"])
    else:
        once = receipts.where("at is not null").groupBy("id").agg(F.min(F.struct("at", "kind")).alias("_first")).select("id", "_first.at", "_first.kind")
    return once.groupBy(F.window("at", "1 hour").alias("_hour"), "kind").agg(F.count("*").alias("receipts")).select(F.col("_hour.start").alias("hour"), "kind", "receipts")


def history_sessions(edits: DataFrame) -> DataFrame:
    """owner, merge_key, started, edits of edits(owner, merge_key, at): runs with gaps under 800 ms; edits without a key join nothing and are left out."""
    rows = edits.where("merge_key is not null")
    rows = rows.withWatermark("at", LATE) if rows.isStreaming else rows
    return rows.groupBy("owner", "merge_key", F.session_window("at", GAP).alias("_run")).agg(F.count("*").alias("edits")).select("owner", "merge_key", F.col("_run.start").alias("started"), "edits")
