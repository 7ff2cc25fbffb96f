"""Layout geometry by hand-computed cases."""

import random

import numpy as np
import pytest

from folio.operators import geometry

BOX = "doc_id long, page_number int, span_id string, text string, x double, y double, w double, h double, size double"


def test_lines(spark):
    spans = [(1, 1, "b", "world", 60.0, 11.0, 30.0, 10.0, 10.0), (1, 1, "a", "Hello", 10.0, 10.0, 30.0, 10.0, 10.0), (1, 1, "c", "!", 90.5, 12.0, 3.0, 10.0, 10.0), (1, 1, "d", "below", 10.0, 30.0, 30.0, 10.0, 10.0), (1, 2, "e", " x ", 0.0, 0.0, 1.0, 1.0, 1.0)]
    found = geometry.visual_lines(spark.createDataFrame(spans, BOX)).orderBy("page_number", "line").collect()
    assert [(r.page_number, r.line, r.text, r.spans) for r in found] == [(1, 0, "Hello world!", ["a", "b", "c"]), (1, 1, "below", ["d"]), (2, 0, "x", ["e"])]
    assert (found[0].x, found[0].y, found[0].w, found[0].h) == (10.0, 10.0, 83.5, 12.0)


def test_flows_take_the_column_they_overlap_most(spark):
    blocks = [(1, 1, "a", 50.0, 10.0, 100.0, 20.0, "ltr"), (1, 1, "b", 52.0, 40.0, 100.0, 20.0, "ltr"), (1, 1, "c", 300.0, 10.0, 100.0, 20.0, "ltr"), (1, 1, "wide", 50.0, 80.0, 500.0, 20.0, "ltr"), (1, 1, "r", 50.0, 120.0, 100.0, 20.0, "rtl"), (1, 1, "t", 50.0, 200.0, 100.0, 20.0, "ltr")]
    b = spark.createDataFrame(blocks, "doc_id long, page_number int, object_id string, x double, y double, w double, h double, direction string")
    pages = spark.createDataFrame([(1, 1, 612.0)], "doc_id long, page_number int, width double")
    tables = spark.createDataFrame([(1, 1, 40.0, 190.0, 200.0, 50.0)], "doc_id long, page_number int, x double, y double, w double, h double")
    found = {r.object_id: (r.flow, r.position, r.gap_before, r.gap_after) for r in geometry.text_flows(b, pages, tables).collect()}
    assert found == {"a": (0, 0, None, 10.0), "b": (0, 1, 10.0, None)}


def test_clusters_follow_the_running_mean():
    assert geometry.clusters([10, 11, 13, 30, float("nan"), 5]) == [5, pytest.approx((10 + 11 + 13) / 3), 30]
    assert geometry.clusters([0, 2, 4, 6]) == [1.0, 5.0] and geometry.clusters([]) == []


def test_aligned_tables(spark):
    lines = [(1, 1, f"{r}{c}", 10.0 + 100 * c, 10.0 + 20 * r, 50.0, 10.0) for r in range(3) for c in range(3 if r else 2)] + [(1, 1, "single", 10.0, 90.0, 50.0, 10.0), (2, 1, "x", 0.0, 0.0, 1.0, 1.0)]
    found = geometry.aligned_text_tables(spark.createDataFrame(lines, "doc_id long, page_number int, text string, x double, y double, w double, h double")).collect()
    assert {(r.row, r.column): r.text for r in found} == {(r, c): f"{r}{c}" for r in range(3) for c in range(3 if r else 2)} and found[0].confidence == pytest.approx(0.72 + 3 * 0.025 + 3 * 0.02)


def test_grids(spark):
    schema = "doc_id long, page_number int, vector_id string, kind string, x double, y double, w double, h double"
    rect = lambda d, i, x, y, w, h: (d, 1, i, "rect", x, y, w, h)
    rows = [rect(1, f"{r}{c}", 10.0 + 50 * c, 10.0 + 20 * r, 50.0, 20.0) for r in range(2) for c in range(3) if (r, c) not in ((0, 0), (0, 1))] + [rect(1, "m", 10.0, 10.0, 100.0, 20.0)]
    rows += [(2, 1, f"h{i}", "line", 10.0, 10.0 + 20 * i, 100.0, 1.0) for i in range(3)] + [(2, 1, f"v{i}", "line", 10.0 + 50 * i, 10.0, 1.0, 41.0) for i in range(3)] + [(2, 1, "img", "image", 20.0, 15.0, 5.0, 5.0)]
    rows += [rect(3, str(i), 10.0 + 60 * i, 10.0, 20.0, 20.0) for i in range(4)]
    found = {r.doc_id: r for r in geometry.grid_tables(spark.createDataFrame(rows, schema)).collect()}
    assert set(found) == {1, 2}
    assert (found[1].rows, found[1].columns, found[1].merged, found[1].complex) == (2, 3, 1, False) and found[1].xs == [10.0, 60.0, 110.0, 160.0] and found[1].confidence == pytest.approx(0.86 + 6 * 0.007)
    assert (found[2].rows, found[2].columns, found[2].merged, found[2].complex) == (2, 2, 0, True) and found[2].ys == [10.5, 30.5, 50.5]


def test_covered_tables_go(spark):
    rows = [(1, 1, 0, 0.0, 0.0, 100.0, 100.0), (1, 1, 1, 5.0, 0.0, 100.0, 100.0), (1, 1, 2, 50.0, 0.0, 100.0, 100.0), (1, 1, 3, 60.0, 0.0, 20.0, 20.0), (2, 1, 4, 0.0, 0.0, 1.0, 1.0)]
    found = geometry.dedupe_tables(spark.createDataFrame(rows, "doc_id long, page_number int, table_id int, x double, y double, w double, h double"))
    assert sorted((r.doc_id, r.table_id) for r in found.collect()) == [(1, 0), (1, 2), (2, 4)]


def test_boxes_go_to_the_screen_and_back(spark):
    boxes = spark.createDataFrame([(i, 1, "a", 10.0, 20.0, 30.0, 60.0) for i in range(5)], "doc_id long, page_number int, object_id string, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(i, 1, 600.0, 800.0, 2.0, r) for i, r in enumerate((0, 90, 180, 270, 45))], "doc_id long, page_number int, width double, height double, zoom double, rotation int")
    there = geometry.transform_boxes(boxes, pages)
    got = {r.doc_id: (r.x0, r.y0, r.x1, r.y1, r.error) for r in there.collect()}
    assert got[0] == (20.0, 1480.0, 60.0, 1560.0, None) and got[1] == (40.0, 20.0, 120.0, 60.0, None) and got[4][:4] == (None,) * 4 and got[4][4]
    back = geometry.transform_boxes(there.drop("error").where("doc_id < 4"), pages, inverse=True)
    assert all((r.x0, r.y0, r.x1, r.y1) == pytest.approx((10, 20, 30, 60)) for r in back.collect())


def test_vertical_lines(spark):
    """Vertical spans join by the width they share and go from top to bottom; other spans don't join them."""
    spans = [(1, 1, "a", "縦", 100.0, 10.0, 10.0, 10.0, 10.0, 1), (1, 1, "b", "書", 101.0, 22.0, 10.0, 10.0, 10.0, 1), (1, 1, "c", "き", 80.0, 10.0, 10.0, 10.0, 10.0, 1), (1, 1, "d", "row", 95.0, 10.0, 30.0, 10.0, 10.0, 0), (1, 1, "e", "!", 100.0, 300.0, 10.0, 10.0, 10.0, 1), (1, 1, "f", "x", 104.5, 50.0, 10.0, 10.0, 10.0, None)]
    found = geometry.visual_lines(spark.createDataFrame(spans, BOX + ", writing_mode int")).orderBy("line").collect()
    assert [(r.spans, r.text, r.y) for r in found] == [(["c"], "き", 10.0), (["d"], "row", 10.0), (["a", "b", "e"], "縦書!", 10.0), (["f"], "x", 50.0)]


def test_rows_equal_a_search_of_all_members():
    draw = random.Random(2)
    same = lambda a, b: geometry._vertical_overlap(a, b) >= 0.55 or abs(a[0] - b[0]) <= max(a[1], b[1]) * 0.35
    for _ in range(200):
        keys = sorted((draw.choice([0, 1, 2, 5, 9, 10.5, 14]) + draw.choice([0, 0.3]), draw.choice([0.3, 1, 2, 5, 9, 30])) for _ in range(draw.randint(0, 40)))
        rows = []
        for i, key in enumerate(keys):
            own = next((row for row in rows if any(same(keys[j], key) for j in row)), None)
            rows.append([i]) if own is None else own.append(i)
        tallest = max((k[1] for k in keys), default=0)
        assert geometry._rows_of(keys, same, lambda a, b: a[0] + a[1] <= b[0] and b[0] - a[0] > max(a[1], tallest) * 0.35) == rows  # noqa: B023
    assert geometry._rows_of([(5.0, 10.0)] * 20_000, same, lambda a, b: False) == [list(range(20_000))]


def pairwise_groups(n, joined):
    group = list(range(n))
    for a in range(n):
        for b in range(n):
            if joined(a, b) or joined(b, a):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return sorted([[i for i in range(n) if group[i] == g] for g in set(group)])


@pytest.mark.parametrize("pairs", [3, 1 << 20])
def test_grids_equal_a_search_of_all_pairs(monkeypatch, pairs):
    monkeypatch.setattr(geometry, "PAIRS", pairs)
    draw, near = random.Random(pairs), geometry.TOLERANCE
    for _ in range(60):
        boxes = [(draw.choice([0, 12, 24.5, 40, 60]) + draw.choice([0, 0.25, 2.25, 2.75]), draw.choice([0, 10, 20.5, 40]) + draw.choice([0, 2.25, 2.75]), draw.choice([12, 14.5, 30]), draw.choice([6, 10, 8.5])) for _ in range(draw.randint(4, 30))]
        x0, y0 = [b[0] for b in boxes], [b[1] for b in boxes]
        x1, y1 = [b[0] + b[2] for b in boxes], [b[1] + b[3] for b in boxes]

        def joined(a, b):
            cx, cy = min(x1[a], x1[b]) - max(x0[a], x0[b]), min(y1[a], y1[b]) - max(y0[a], y0[b])  # noqa: B023
            meet = x0[a] <= x1[b] + near and x1[a] >= x0[b] - near and y0[a] <= y1[b] + near and y1[a] >= y0[b] - near  # noqa: B023
            return a != b and (meet or abs(x1[a] - x0[b]) <= near or abs(y1[a] - y0[b]) <= near) and (cy > 2 or cx > 2)  # noqa: B023

        wanted = [g for g in pairwise_groups(len(boxes), joined) if len(g) >= 4]
        grids = geometry._grids(np.array(boxes, dtype=float), ["rect"] * len(boxes))
        kept = [g for g in wanted if len(geometry.clusters([v for i in g for v in (x0[i], x1[i])])) >= 3 and len(geometry.clusters([v for i in g for v in (y0[i], y1[i])])) >= 3]
        assert [g["own"].tolist() for g in grids] == kept


def test_a_page_of_very_many_vectors():
    boxes = np.array([(20 * i, 10 * j, 20, 10) for i in range(200) for j in range(250)], dtype=float)
    (grid,) = geometry._grids(boxes, ["rect"] * len(boxes))
    assert len(grid["own"]) == 50_000 and len(grid["xs"]) == 201 and len(grid["ys"]) == 251
