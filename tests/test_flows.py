"""Flows run as streams give the batch form's answer; small cases of lineage and redaction."""

import datetime as dt

from folio.operators import governance, lineage
from folio.streaming import flows

T0 = dt.datetime(2024, 1, 1)


def streamed(spark, rows, schema, flow, tmp_path):
    """flow over rows read as a stream; a row of the far future closes every window."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = flow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    out.writeStream.format("memory").queryName("flow").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination(240)
    return {tuple(r) for r in spark.table("flow").collect()}


def test_history_sessions_as_stream(spark, tmp_path):
    ms = lambda n: T0 + dt.timedelta(milliseconds=n)
    rows = [("o", "k", ms(0)), ("o", "k", ms(799)), ("o", "k", ms(1599)), ("o", "j", ms(100)), ("o", None, ms(5))]
    far = [("z", "z", T0 + dt.timedelta(days=9))]
    schema = "owner string, merge_key string, at timestamp"
    wanted = {tuple(r) for r in flows.history_sessions(spark.createDataFrame(rows, schema)).collect()}
    assert wanted == {("o", "k", ms(0), 2), ("o", "k", ms(1599), 1), ("o", "j", ms(100), 1)}
    assert streamed(spark, rows + far, schema, flows.history_sessions, tmp_path) == wanted


def test_receipt_counts_as_stream(spark, tmp_path):
    hour = lambda n: T0 + dt.timedelta(hours=n)
    rows = [(1, "report", hour(0)), (1, "report", hour(0)), (2, "report", hour(0.5)), (3, "other", hour(1.5))]
    schema = "id long, kind string, at timestamp"
    wanted = {tuple(r) for r in flows.receipt_counts(spark.createDataFrame(rows, schema)).collect()}
    assert wanted == {(hour(0), "report", 2), (hour(1), "other", 1)}
    assert streamed(spark, [*rows, (9, "z", hour(99))], schema, flows.receipt_counts, tmp_path) == wanted


def test_lineage_of_chains_cycles_and_nothing(spark):
    rows = [(i, i - 1 if i else None) for i in range(40)] + [(100, 101), (101, 100), (102, 101), (200, 999)]
    got = {r.project_id: (r.root_id, r.sequence) for r in lineage.document_lineage(spark.createDataFrame(rows, "project_id long, parent_id long")).collect()}
    assert got == {i: (0, i) for i in range(40)} | {i: (None, None) for i in (100, 101, 102)} | {200: (200, 0)}
    assert lineage.document_lineage(spark.createDataFrame([], "project_id long, parent_id long")).count() == 0


def test_redaction_edges(spark):
    box = "doc_id long, page_number int, x double, y double, w double, h double"
    spans = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, "a", "abc  d"), (1, 1, 10.0, 0.0, 10.0, 10.0, "b", "meets only"), (1, 2, 0.0, 0.0, 10.0, 10.0, "c", "hid")], f"{box}, span_id string, text string")
    marks = spark.createDataFrame([(1, 1, 5.0, 5.0, 5.0, 5.0, True), (1, 2, 5.0, 5.0, 5.0, 5.0, False)], f"{box}, visible boolean")
    assert [r.token for r in governance.redaction_tokens(spans, marks).collect()] == ["abc d"]
    assert [r.span_id for r in governance.redact_spans(spans, marks).collect()] == ["b"]
