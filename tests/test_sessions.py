"""The stream of heartbeats gives the batch form's answer, forgets old sessions, and goes on after a restart."""

import datetime as dt
import random

import pytest

from folio.streaming import flows, sessions

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "session long, project long, at timestamp, clean_exit boolean"


@pytest.fixture
def store(spark):
    before = {k: spark.conf.get(k, None) for k in sessions.STORE}
    for k, v in sessions.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def feed(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = sessions.session_states(stream).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    if query.exception():
        raise query.exception()
    return spark.read.schema("session string, project string, at timestamp, status string").parquet(f"{tmp_path}/{name}"), query.lastProgress


def batch(spark, rows, now):
    last = flows.last_beats(spark.createDataFrame(rows, SCHEMA))
    return sorted((str(r.project), str(r.session), r.at) for r in flows.interrupted_sessions(last, now).collect())


def test_stream_equals_batch_and_forgets(spark, store, tmp_path):
    draw, minute = random.Random(4), lambda n: T0 + dt.timedelta(minutes=n)
    from pyspark.sql import functions as F

    first = [(s, s % 3, minute(s * 50 + draw.randrange(40)), draw.random() < 0.2) for s in range(40) for _ in range(4)]
    first += [(None, 1, minute(5), False), (7, None, minute(6), False), (8, 1, None, False), (9, 1, dt.datetime(2999, 1, 1), False)]
    out, progress = feed(spark, tmp_path, "out", first)
    now = F.lit(minute(40 * 50))
    got = sorted(map(tuple, sessions.interrupted_now(out).collect()))
    assert got == batch(spark, first[:-1], now) and got

    # a second run goes on from the checkpoint: a session exits, one comes back, and a week later most are forgotten
    then = [(39, 0, minute(2_000), True), (2, 2, minute(2_001), None)]
    out, progress = feed(spark, tmp_path, "out", then)
    assert sorted(map(tuple, sessions.interrupted_now(out).collect())) == batch(spark, first[:-1] + then, F.lit(minute(2_001)))
    late = [(100, 0, minute(2_001) + dt.timedelta(days=8), False)]
    feed(spark, tmp_path, "out", late)
    out, progress = feed(spark, tmp_path, "out", [(101, 1, minute(2_100) + dt.timedelta(days=8), False)])
    assert progress["stateOperators"][0]["numRowsTotal"] <= 8  # of 42 sessions two are held, with their timers
    assert sorted(map(tuple, sessions.interrupted_now(out).collect())) == [("0", "100", late[0][2]), ("1", "101", minute(2_100) + dt.timedelta(days=8))]
    assert out.where("status = 'expired'").count() == 40
