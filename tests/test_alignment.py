"""Alignment and word differences: hand-computed cases and invariants over the smallest tables."""

import random

import pytest

from folio.operators import alignment
from folio.plans import compared, registry

SF = "/root/testdata/sf0.001"


def test_only_folds_lack_sql():
    folds = "b1_html_blocks b2_html_links b4_markdown_runs b4_run_styles b6_render_runs b7_paginate b11_heading_outline d8_align_sequences d9_alignment_summary d10_diff_words e5_sample_pages".split()
    folds += "f11_structure_elements f11_accessibility_summary g2_visual_lines g4_text_flows g6_cluster_values g7_aligned_text_tables g8_grid_tables g10_dedupe_tables j3_recover_transactions".split()
    assert set(registry.QUERIES) - set(registry.ORACLES) == set(folds)


def test_word_changes():
    assert alignment.word_changes(list("abc"), list("axc")) == [("same", "a"), ("removed", "b"), ("added", "x"), ("same", "c")]
    assert alignment.word_changes([], ["q"]) == [("added", "q")] and alignment.word_changes([], []) == []


def plain_changes(a, b):
    """Word changes from the whole table of longest lengths."""
    longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            longest[i + 1][j + 1] = longest[i][j] + 1 if a[i] == b[j] else max(longest[i][j + 1], longest[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j, kind, word = i - 1, j - 1, "same", a[i - 1]
        elif j and (not i or longest[i][j - 1] >= longest[i - 1][j]):
            j, kind, word = j - 1, "added", b[j - 1]
        else:
            i, kind, word = i - 1, "removed", a[i - 1]
        out.append((kind, word))
    return out[::-1]


def plain_alignment(left, right):
    alike = alignment._similarities(left, right) if left and right else None
    score = [[alignment.GAP * (i + j) if not (i and j) else 0.0 for j in range(len(right) + 1)] for i in range(len(left) + 1)]
    came = {}
    for i in range(1, len(left) + 1):
        for j in range(1, len(right) + 1):
            choices = (score[i - 1][j - 1] + (alike[i - 1, j - 1] * alignment.GAIN - alignment.COST), score[i - 1][j] + alignment.GAP, score[i][j - 1] + alignment.GAP)
            score[i][j] = max(choices)
            came[i, j] = choices.index(max(choices))
    out, i, j = [], len(left), len(right)
    while i or j:
        move = came.get((i, j), 1 if i else 2)
        out.append((i if move != 2 else None, j if move != 1 else None))
        i, j = i - (move != 2), j - (move != 1)
    return out[::-1]


@pytest.mark.parametrize("held", [1, 64, 4_000_000])
def test_folds_equal_whole_tables(monkeypatch, held):
    monkeypatch.setattr(alignment, "CELLS", held)
    monkeypatch.setattr(alignment, "BITS", held)
    draw = random.Random(held)
    for _ in range(150):
        few = "abcdefgh"[: draw.choice([2, 4, 8])]
        a, b = ([draw.choice(few) for _ in range(draw.randint(0, 40))] for _ in range(2))
        assert alignment.word_changes(a, b) == plain_changes(a, b)
        pages = [[{"normalized": " ".join(t := draw.choices(["aa", "bb", "cc"], k=draw.randint(0, 3))), "tokens": list(dict.fromkeys(t))} for _ in range(draw.randint(0, 12))] for _ in range(2)]
        assert [r[:2] for r in alignment.align(*pages)] == plain_alignment(*pages)


def test_align_small(spark):
    schema = "doc_id long, page_number int, text string"
    a = spark.createDataFrame([(1, 1, "alpha beta gamma"), (1, 2, "delta epsilon zeta"), (2, 1, "only on the left")], schema)
    b = spark.createDataFrame([(1, 1, "delta epsilon zeta"), (1, 2, "entirely new words"), (3, 1, None)], schema)
    got = {tuple(r) for r in alignment.align_sequences(a, b).collect()}
    assert got == {(1, 0, 1, None, 0.0, "deleted", None), (1, 1, 2, 1, 1.0, "same", "text"), (1, 2, None, 2, 0.0, "inserted", None), (2, 0, 1, None, 0.0, "deleted", None), (3, 0, None, 1, 0.0, "inserted", None)}
    assert {r.status for r in alignment.align_sequences(a, b, cells=1).where("doc_id = 1").collect()} == {"too-large"}


def test_pages_with_fingerprints(spark):
    schema = "doc_id long, page_number int, text string, visual struct<bits:bigint,ink:double,aspect:double>"
    look, other, long = (-1, 0.5, 1.0), (0, 0.5, 1.0), "enough text to be relied on by itself"
    a = spark.createDataFrame([(1, 1, "", look), (2, 1, long, look), (3, 1, long, None)], schema)
    b = spark.createDataFrame([(1, 1, "x", look), (2, 1, long, other), (3, 1, long, look)], schema)
    got = {r.doc_id: (round(r.similarity, 6), r.status, r.basis) for r in alignment.align_sequences(a, b).collect()}
    assert got == {1: (1.0, "same", "visual"), 2: (0.76 + 0.24 * 0.22, "modified", "hybrid"), 3: (1.0, "same", "text")}


def test_alignment_covers_every_page_once(spark):
    rows = compared.d8_align_sequences(spark, SF).collect()
    pages = {(r.doc_id, r.page_number) for r in compared._pages(spark, SF).collect()}
    left = [(r.doc_id, r.left_page) for r in rows if r.left_page]
    assert len(left) == len(set(left)) and set(left) == pages
    summary = {r.doc_id: r.changed for r in compared.d9_alignment_summary(spark, SF).collect()}
    assert sum(summary.values()) == sum(r.status != "same" for r in rows)


def test_diff_rebuilds_both_sides(spark):
    texts = {(r.doc_id, r.page_number): r.text for r in compared._pages(spark, SF).collect()}
    built: dict = {}
    for r in sorted(compared.d10_diff_words(spark, SF).collect(), key=lambda r: (r.doc_id, r.page_number, r.pos)):
        if r.kind != "added":
            built[r.doc_id, r.page_number] = built.get((r.doc_id, r.page_number), "") + r.text
    assert built and all(texts[k] == v for k, v in built.items() if len(v.split()) < 300)


def test_pages_without_text_are_aligned(spark):
    a = spark.createDataFrame([(1, 2, "alpha beta gamma"), (1, 1, None), (None, 1, "x")], "doc_id long, page_number int, text string")
    b = spark.createDataFrame([(1, 1, None), (1, 2, "alpha beta gamma"), (None, 1, "x")], "doc_id long, page_number int, text string")
    got = sorted(tuple(r)[1:6] for r in alignment.align_sequences(a, b).where("doc_id = 1").collect())
    assert [r[4] for r in got if r[3] == 1.0] == ["same"] and len(got) == 3
    assert sorted(r.status for r in alignment.align_sequences(a, b).where("doc_id is null").collect()) == ["deleted", "inserted"]


def test_few_pages_are_aligned_as_many():
    import random

    draw = random.Random(5)
    pages = lambda n: [alignment._page(" ".join(draw.choice(["aa", "bb", "cc", "dd", "e", "ff"]) for _ in range(draw.randrange(6)))) for _ in range(n)]
    for _ in range(200):
        a, b = pages(draw.randrange(1, 8)), pages(draw.randrange(1, 8))
        few = alignment._few_similarities(a, b)
        assert few == alignment._similarities(a, b).tolist()
        small, alignment.SMALL = alignment.SMALL, 0
        whole = alignment.align(a, b)
        alignment.SMALL = small
        assert alignment.align(a, b) == whole == alignment._align_few(few)


def test_long_documents_are_aligned():
    pages = [{"normalized": f"page number n{i} x{i}", "tokens": ["page", "number", f"n{i}", f"x{i}"]} for i in range(300)]
    other = [*pages[:100], {"normalized": "something else", "tokens": ["something", "else"]}, *pages[100:200], *pages[201:]]
    assert [r[:2] for r in alignment.align(pages, other) if r[3] != "same"] == [(None, 101), (201, None)]


def test_no_size_stops_the_alignment(spark):
    rows = [(1, i + 1, f"words{i} of page{i}") for i in range(2001)]
    a = spark.createDataFrame(rows, "doc_id long, page_number int, text string")
    summary = alignment.alignment_summary(alignment.align_sequences(a, a)).collect()
    assert [(r.same, r.changed) for r in summary] == [(2001, 0)]


def test_whole_pages_are_compared(spark):
    import random

    draw = random.Random(2)
    left = [draw.choice("abcde") for _ in range(150)]
    right = [draw.choice("abcde") for _ in range(170)]
    found = alignment.word_changes(left, right)
    best = [[0] * 171 for _ in range(151)]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert [w for k, w in found if k != "added"] == left and [w for k, w in found if k != "removed"] == right
    assert sum(k == "same" for k, _ in found) == best[-1][-1]
    text = " ".join(f"w{i}" for i in range(500))
    pair = spark.createDataFrame([(1, 1, text, text + " new")], "doc_id long, page_number int, left string, right string")
    assert [r.text for r in alignment.diff_words(pair, limit=None).collect() if r.kind != "same"] == [" ", "new"]
