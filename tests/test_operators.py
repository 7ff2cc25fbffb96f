"""Small hand-computed cases of single operators."""

from folio.operators import assembly, records, search


def test_select_pages(spark):
    cases = [(1, "all,!last", 4), (2, "!even", 5), (3, "last-2", 4), (4, "2,99", 3), (5, "x", 2), (6, " ODD , 2 ", 3), (7, "", 3)]
    got = {}
    for r in assembly.select_pages(spark.createDataFrame(cases, "doc_id long, expression string, page_count int")).collect():
        got.setdefault(r.doc_id, set()).add(r.page_number or r.error)
    assert got == {1: {1, 2, 3}, 2: {1, 3, 5}, 3: {2, 3, 4}, 4: {2, "Page 99 is outside 1-3."}, 5: {"Unsupported token: x"}, 6: {1, 2, 3}}


def test_booklet(spark):
    got = assembly.imposition(spark.createDataFrame([(1, 5)], "doc_id long, page_count int")).orderBy("side", "slot").collect()
    assert [r.page_number for r in got] == [None, 1, 2, None, None, 3, 4, 5]


def test_merge_history(spark):
    entries = [("o", 1, 0, "k"), ("o", 2, 700, "k"), ("o", 3, 1500, "k"), ("o", 4, 1600, None), ("o", 5, 1700, None)]
    got = records.merge_history(spark.createDataFrame(entries, "owner string, id long, at_ms long, merge_key string")).orderBy("position").collect()
    assert [(r.id, r.merged) for r in got] == [(5, 1), (4, 1), (3, 1), (2, 2)]


def test_search_is_literal(spark):
    pages = spark.createDataFrame([(1, 1, "a.b axb A.B"), (1, 2, "nothing")], "doc_id long, page_number int, text string")
    assert [(r.page_number, r.match_count) for r in search.search_pages(pages, " a.b ").collect()] == [(1, 2)]
    assert search.search_pages(pages, "  ").count() == 0


def test_registered_limits_are_the_survey_s(spark):
    import tempfile

    from folio.plans import registry

    events = spark.createDataFrame([(i, 1, "open", None) for i in range(400)], "event_id long, user_id long, event_type string, ts timestamp")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    events.write.mode("overwrite").parquet(f"{path}/events.parquet")
    assert registry.QUERIES["j8_activity_receipts_full"](spark, path).count() == 300
    assert registry.QUERIES["j9_event_timeline_full"](spark, path).count() == 100
