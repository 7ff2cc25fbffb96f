"""Sessions that ended without a clean exit, kept up to date by a stateful stream of heartbeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .flows import DAYS, LATE

#: The state store that timers need; a session that runs session_states() has to name it.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_MICROS = DAYS * 86_400_000_000


class _Session(StatefulProcessor):
    """Holds the last beat of a session until it is DAYS old; a row for each change of what is last, and one when it expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, clean boolean, project string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        best = held
        for frame in rows:
            for at, clean, project in zip(frame["at_us"].tolist(), frame["clean"].tolist(), frame["project_key"].tolist()):
                if best is None or (at, clean, project) > tuple(best):
                    best = (at, clean, project)
        if best is not None and (held is None or tuple(best) != tuple(held)):
            if held is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            self.last.update(best)
            # timers count in ms: not before the session is too old
            self.handle.registerTimer((best[0] + _MICROS) // 1_000 + 1)
            yield self._row(key, best, "closed" if best[1] else "open")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.last.get()
        self.last.clear()
        if held is not None:
            yield self._row(key, held, "expired")

    def _row(self, key, last, status: str) -> pd.DataFrame:
        return pd.DataFrame({"session_key": [key[0]], "project_key": [last[2]], "at_us": [last[0]], "status": [status]})

    def close(self) -> None:
        pass


def session_states(heartbeats: DataFrame, now: Column | None = None, late: str = LATE) -> DataFrame:
    """session, project, at, status of a stream of heartbeats(session, project, at, clean_exit): a row whenever a session's last beat changes or gets too old.

    status is open, closed (its last beat is a clean exit) or expired, when the watermark is more than seven days past that
    beat. A session's state is its last beat, and goes when it expires, so the state holds the sessions of seven days.
    Beats without a session, a project or a time, and those from after ``now`` (the present, if not given), count for
    nothing, as do those that are later than ``late``. Ids come out as strings. The Spark session needs the state store of STORE.
    """
    valid = heartbeats.where("session is not null and project is not null and at is not null").where(F.col("at") <= (F.current_timestamp() if now is None else now))
    rows = valid.withWatermark("at", late).select(
        F.col("session").cast("string").alias("session_key"), F.col("project").cast("string").alias("project_key"), "at",
        F.unix_micros("at").alias("at_us"), F.coalesce("clean_exit", F.lit(False)).alias("clean"),
    )
    found = rows.groupBy("session_key").transformWithStateInPandas(_Session(), "session_key string, project_key string, at_us long, status string", "Append", "EventTime")
    return found.select(F.col("session_key").alias("session"), F.col("project_key").alias("project"), F.timestamp_micros("at_us").alias("at"), "status")


def interrupted_now(states: DataFrame) -> DataFrame:
    """project, session, at of the rows that session_states() has given so far: the newest open session of each project."""
    rank = F.when(F.col("status") == "expired", 2).when(F.col("status") == "closed", 1).otherwise(0)
    last = states.groupBy("session").agg(F.max(F.struct("at", rank.alias("_rank"), "project", "status")).alias("_last"))
    return last.where("_last.status = 'open'").groupBy(F.col("_last.project").alias("project")).agg(F.max(F.struct(F.col("_last.at").alias("at"), "session")).alias("_new")).select("project", "_new.session", "_new.at")
