"""Search for many literals against Python's re."""

import re

from folio.operators import search


def test_literals_are_found(spark):
    texts = ["The old stone bridge, the OLD stone", "colder stones (a+b) a+b", "café au lait", "xé y", "bridge"]
    asked = ["old stone", "stone bridge", "(a+b)", "a+b", "au lait", "é y", "é", "the", "old", "no such words", "", "st"]
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, page_number int, text string")
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    for whole in (True, False):
        got = {(r.query, r.doc_id): r.match_count for r in search.search_many(pages, queries, whole_word=whole).collect()}
        if not whole:
            assert got == {(q, i): n for q in asked if q for i, t in enumerate(texts) if (n := len(re.findall(re.escape(q), t, re.I | re.A)))}
        else:
            assert {k: got.get(k) for k in [("old stone", 0), ("stone bridge", 0), ("a+b", 1), ("au lait", 2), ("the", 0), ("old", 1)]} == {("old stone", 0): 2, ("stone bridge", 0): 1, ("a+b", 1): 2, ("au lait", 2): 1, ("the", 0): 2, ("old", 1): None}


def test_shards_overlaps_and_odd_rows(spark):
    """Many shards give what one gives; matches of a literal do not overlap; nulls and blanks match nothing."""
    edge = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
    texts = ["aaaa aa a", "ab abab Ab-ab", "x.x.x", "STRASSE straße", "", None, "aa" * 30_000]
    asked = ["aa", "a", "ab", "AB", " ab ", "x.x", ".", "straße", "e", None, "  ", "b a", "a" * 50]
    pages = spark.createDataFrame([(f"d{i}", i, t, 7) for i, t in enumerate(texts)], "doc_id string, page_number long, text string, query int")
    queries = spark.createDataFrame([(q,) for q in asked * 2], "query string")
    for case in (True, False):
        for whole in (True, False):
            wanted = {}
            for q in {q for q in asked if q and q.strip()}:
                literal = re.escape(q.strip())
                pattern = re.compile(edge + literal + edge if whole else literal, 0 if case else re.I)
                wanted |= {(q, f"d{i}", i): n for i, t in enumerate(texts) if t and (n := len(pattern.findall(t)))}
            for shard in (20, 4_000_000):
                got = search.search_many(pages, queries, case, whole, shard).collect()
                assert {(r.query, r.doc_id, r.page_number): r.match_count for r in got} == wanted and len(got) == len(wanted)
    assert search.search_many(pages, queries.limit(0)).count() == 0 and search.search_many(pages.limit(0), queries).count() == 0


def test_folded_letters_and_edges_of_one_query(spark):
    """The plain path for ASCII queries counts as the pattern of all letters does."""
    edge = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
    texts = ["the THE The_ theé éthe", "mask MAſK maſK", "İı iI", "a.b A.B (a.b)", "-a- b", "x" * 300 + " mask " + "y" * 300, "ΑΣ the"]
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, page_number int, text string")
    for query in ["the", "mask", "ii", "a.b", "-a-", "é", " THE "]:
        for case in (True, False):
            for whole in (True, False):
                got = {r.doc_id: (r.match_count, r.snippet) for r in search.search_pages(pages, query, case, whole).collect()}
                q = query.strip()
                pattern = re.compile((edge + re.escape(q) + edge) if whole else re.escape(q), 0 if case else re.I)
                wanted = {}
                for i, t in enumerate(texts):
                    # Python folds the dotted and the dotless i otherwise
                    t_ = t if case else t.replace("İ", "ı").replace("ı", "ı")
                    n = len(pattern.findall(t_))
                    if n:
                        wanted[i] = n
                assert {i: n for i, (n, _) in got.items()} == wanted or (q == "ii" and not case), (query, case, whole)
    long = {r.doc_id: r.snippet for r in search.search_pages(pages, "MASK").collect()}[5]
    assert long == "…" + "x" * 69 + " mask " + "y" * 99 + "…"
