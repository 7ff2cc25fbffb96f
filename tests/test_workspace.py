"""Tabs, package ranges and edit history, with one key that holds all rows."""

import random

import pytest
from pyspark.sql import functions as F

from folio.functions import scans
from folio.operators import records, workspace

EVENTS = "workspace string, project long, id long, kind string, mode string, at long"


def tabs(spark, events, schema=EVENTS):
    return sorted((r.workspace, r.state, r.position, r.project, r.mode, r.pinned, r.active) for r in workspace.tab_state(spark.createDataFrame(events, schema)).collect())


def test_a_pushed_out_tab_never_returns(spark):
    events = [("w", p, p, "tab-opened", "read", p) for p in range(1, 11)] + [("w", p, 20 + p, "tab-closed", None, 20 + p) for p in range(1, 10)] + [("w", 9, 40, "tab-restored", None, 40), (None, 1, 1, "tab-opened", None, None)]
    got = tabs(spark, [e for e in events if e[0]])
    assert [g[3] for g in got if g[1] == "closed"] == [8, 7, 6, 5, 4, 3, 2]
    assert [(g[3], g[6]) for g in got if g[1] == "open"] == [(10, False), (9, True)]
    assert [r for r in workspace.tab_state(spark.createDataFrame(events, EVENTS)).collect() if r.workspace is None][0].project == 1


def test_pins_order_and_the_active_tab(spark):
    step = lambda i, kind, project=None, mode=None, order=None: ("w", project, i, kind, mode, i, order)
    events = [step(1, "tab-opened", 1, "read"), step(2, "tab-opened", 2, "edit"), step(3, "tab-opened", 3, "read"), step(4, "tab-pinned", 2), step(5, "mode-changed", 1, "sign"), step(6, "tab-closed", 1), step(7, "tab-closed", 2)]
    schema = EVENTS + ", order array<long>"
    assert tabs(spark, events, schema) == [("w", "closed", 1, 2, "edit", True, False), ("w", "closed", 2, 1, "sign", False, False), ("w", "open", 1, 3, "read", False, True)]
    events += [step(8, "tab-restored"), step(9, "tabs-reordered", order=[2, 99]), step(10, "tab-opened", 1, "read"), step(11, "tab-closed", 77), step(12, "checkpoint-created", 3)]
    # a restored tab keeps its pin; opening leaves the closed entry where it is
    assert tabs(spark, events, schema) == [("w", "closed", 1, 1, "sign", False, False), ("w", "open", 1, 2, "edit", True, False), ("w", "open", 2, 3, "read", False, False), ("w", "open", 3, 1, "read", False, True)]
    assert workspace.tab_state(spark.createDataFrame([], EVENTS)).count() == 0


def overlaps(spark, ranges):
    packages = spark.createDataFrame([("p", 0, 10_000, 10_000, "x", "x")], "package_id string, source_length long, payload_length long, declared_length long, payload_checksum string, declared_checksum string")
    assets = spark.createDataFrame([("p", i, a, b - a) for i, a, b in ranges], "package_id string, id string, start long, length long")
    none = spark.createDataFrame([], "package_id string, id string, type string, asset_id string")
    pages = spark.createDataFrame([], "package_id string, job_id string, page_number int, start long, length long")
    return sorted(r.item for r in workspace.validate_packages(packages, assets, none, none.select("package_id", "id"), pages).collect() if r.rule == "range-overlaps")


def test_every_range_that_begins_in_an_earlier_one_is_found(spark):
    assert overlaps(spark, [("A", 10, 510), ("B", 20, 30), ("C", 100, 110), ("D", 510, 600)]) == ["asset B", "asset C"]
    draw = random.Random(3)
    ranges = [(f"r{i:03}", a := draw.randrange(9_000), a + draw.randrange(1, 60)) for i in range(200)]
    ordered, end, wanted = sorted(ranges, key=lambda r: (r[1], r[2], f"asset {r[0]}")), -1, []
    for i, a, b in ordered:
        wanted += [f"asset {i}"] * (a < end)
        end = max(end, b)
    assert overlaps(spark, ranges) == sorted(wanted)


@pytest.mark.parametrize("owners", [1, 3])
def test_history_of_an_owner_with_all_rows(spark, owners):
    draw, at, rows = random.Random(owners), 0, []
    for i in range(3_000):
        at += draw.choice([0, 5, 799, 800, 2_000])
        rows.append((draw.randrange(owners), i, at, draw.choice(["a", "a", "b", "", None])))
    wanted = []
    for owner in range(owners):
        groups, last = [], None
        for _, i, t, key in (r for r in rows if r[0] == owner):
            if last and key and key == last[1] and t - last[0] < 800:
                groups[-1] = (i, key, groups[-1][2] + 1)
            else:
                groups.append((i, key, 1))
            last = (t, key)
        wanted += [(owner, k, *g) for k, g in enumerate(groups[::-1][:81])]
    entries = spark.createDataFrame(rows, "owner long, id long, at_ms long, merge_key string").repartition(5)
    assert sorted(map(tuple, records.merge_history(entries).collect())) == sorted(wanted)


def test_scans_equal_windows(spark):
    rows = spark.range(4_000).selectExpr("if(id % 3 = 0, null, id % 2) as k", "id * 7919 % 4001 as o", "id % 97 as v").repartition(6)
    got = scans.before(rows, ["k"], ["o"], top=(F.max, F.col("v")), total=(F.sum, F.col("v")))
    have = {}
    for r in sorted(rows.collect(), key=lambda r: r.o):
        have.setdefault(r.k, []).append((r.o, r.v))
    wanted = {}
    for k, seen in have.items():
        top = total = None
        for o, v in seen:
            wanted[k, o] = (top, total)
            top, total = v if top is None else max(top, v), (total or 0) + v
    assert {(r.k, r.o): (r.top, r.total) for r in got.collect()} == wanted
