"""Operational records: dedup, budgets, receipts, timelines, edit history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.scans import before

# fixed values: reserve and overhead of storage, what is kept, and what tells the kind of a receipt
RESERVE, QUOTA_SHARE, OVERHEAD = 25_000_000, 0.05, 0.08
RECEIPTS, TIMELINE, HISTORY, MERGE_MS = 300, 100, 80, 800
DOCUMENT, REPORT, REPORT_TYPE = r"(?i)\.pdf$", r"(?i)\.(?:json|csv|txt)$", "(?i)(?:json|csv|text)"
CURRENT = 3


def dedupe_by_checksum(docs: DataFrame, projects: DataFrame, current: int = CURRENT) -> DataFrame:
    """doc_id, checksum, project_id, reused of docs(doc_id, text): the project of projects(project_id, checksum, schema_version, stored_checksum) that holds the same content, else a new one, named like the document.

    The first project (by id) with this checksum and a readable schema version is used, if its stored bytes still have
    the checksum. A null text is an empty one.
    """
    rows = docs.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("checksum"))
    readable = projects.where(F.col("schema_version").between(1, current))
    first = readable.groupBy("checksum").agg(F.min(F.struct("project_id", "stored_checksum")).alias("_first"))
    usable = first.where("_first.stored_checksum = checksum").select("checksum", F.col("_first.project_id").alias("_project"))
    found = rows.join(usable, "checksum", "left")
    return found.select("doc_id", "checksum", F.coalesce("_project", "doc_id").alias("project_id"), F.col("_project").isNotNull().alias("reused"))


def storage_budget(requests: DataFrame) -> DataFrame:
    """requests(requested, usage, quota) with required, reserve and status ok, warning or blocked; an unknown quota is a warning."""
    required = F.greatest(F.lit(0), F.ceil(F.col("requested") * (1 + OVERHEAD)))
    known = F.col("usage").isNotNull() & F.coalesce(F.col("quota") > 0, F.lit(False))
    reserve = F.greatest(F.lit(RESERVE), F.ceil(F.col("quota") * QUOTA_SHARE))
    after = F.greatest(F.lit(0), F.col("quota") - F.col("usage")) - required
    status = F.when(~known, "warning").when(after < 0, "blocked").when(after < reserve, "warning").otherwise("ok")
    return requests.withColumns({"required": required.cast("long"), "reserve": F.when(known, reserve).cast("long"), "status": status})


def budget_classes(docs: DataFrame) -> DataFrame:
    """budget_class, documents, bytes of docs(page_count, byte_length)."""
    kind = F.when((F.col("page_count") >= 1000) | (F.col("byte_length") >= 500_000_000), "extreme").when((F.col("page_count") >= 250) | (F.col("byte_length") >= 100_000_000), "large").otherwise("normal")
    return docs.groupBy(kind.alias("budget_class")).agg(F.count("*").alias("documents"), F.sum("byte_length").alias("bytes"))


def activity_receipts(receipts: DataFrame, most: int = RECEIPTS, backup: str = ".backup") -> DataFrame:
    """The newest valid receipts of every owner with their kind: receipts(owner, id, schema_version, sha256, filename, mime_type, created_at).

    Receipts of another version than 1 or without a checksum don't count; backup is the ending of a backup's name.
    """
    name, mime = F.coalesce(F.col("filename"), F.lit("")), F.coalesce(F.col("mime_type"), F.lit(""))
    kind = F.when(F.lower(name).endswith(backup.lower()), "backup").when(name.rlike(DOCUMENT) | (mime == "application/pdf"), "document-output").when(name.rlike(REPORT) | mime.rlike(REPORT_TYPE), "report").otherwise("other")
    newest = Window.partitionBy("owner").orderBy(F.desc("created_at"), F.desc("id"))
    valid = receipts.where("schema_version = 1 and sha256 is not null")
    return valid.withColumn("kind", kind).withColumn("position", F.row_number().over(newest)).where(F.col("position") <= most)


def event_timeline(events: DataFrame, most: int = TIMELINE) -> DataFrame:
    """The newest events of every project: events(project, id, kind, at)."""
    newest = Window.partitionBy("project").orderBy(F.desc("at"), F.desc("id"))
    return events.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= most)


def merge_history(entries: DataFrame, most: int = HISTORY) -> DataFrame:
    """owner, position (0 is the present), id, merge_key, merged of entries(owner, id, at_ms, merge_key).

    Entries with the merge key of the one before, less than 800 ms after it, replace it; null and empty keys join nothing.
    An owner's entries are spread over tasks; ids tell entries of the same time apart.
    """
    rows = entries.select("owner", "id", "at_ms", "merge_key")
    entry = F.struct("at_ms", "id", "merge_key")
    rows = before(rows, ["owner"], ["at_ms", "id"], _last=(F.max, entry))
    joins = (F.col("merge_key") != "") & (F.col("merge_key") == F.col("_last.merge_key")) & (F.col("at_ms") - F.col("_last.at_ms") < MERGE_MS)
    begins = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    rows = before(rows.withColumn("_begins", begins).drop("_last"), ["owner"], ["at_ms", "id"], _earlier=(F.sum, F.col("_begins")))
    rows = rows.withColumn("_group", F.coalesce("_earlier", F.lit(0)) + F.col("_begins"))
    last = rows.groupBy("owner", "_group").agg(F.max(entry).alias("_last"), F.count("*").alias("merged"))
    # the newest of every part of an owner's groups, then the newest of those
    back = lambda *keys: F.row_number().over(Window.partitionBy("owner", *keys).orderBy(F.desc("_group")))
    some = last.withColumn("_part", F.floor(F.col("_group") / (8 * (most + 1)))).withColumn("_place", back("_part")).where(F.col("_place") <= most + 1)
    return some.withColumn("position", back() - 1).where(F.col("position") <= most).select("owner", "position", "_last.id", "_last.merge_key", "merged")


RECEIPT_FIELDS = ("created_at", "kind", "filename", "mime_type", "byte_length", "sha256", "route", "release")


def _cells() -> list:
    return [F.date_format(F.to_utc_timestamp("created_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), *(F.col(c).cast("string") for c in RECEIPT_FIELDS[1:])]


def receipts_csv(receipts: DataFrame) -> DataFrame:
    """id, line: the time in ISO form (UTC, whatever the session's zone) and seven fields, each in quotes, quotes inside doubled; nulls are empty."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in _cells()]
    return receipts.select("id", F.concat_ws(",", *quoted).alias("line"))


def save_receipts(receipts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The fields of receipts_csv() as CSV files below path, each with a line of names; every cell in quotes."""
    cells = [F.coalesce(c, F.lit("")).alias(n) for n, c in zip(RECEIPT_FIELDS, _cells())]
    receipts.select(*cells).write.mode(mode).csv(path, header=True, quoteAll=True, escape='"', emptyValue='""')
