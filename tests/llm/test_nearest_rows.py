"""Nearest neighbours on awkward rows: against all pairs, with columns named like those used inside."""

import math

from folio.llm import ann

SCHEMA = "vec_id long, embedding array<double>, rep long, list int, unit array<float>, dim int, query long, near double, rank int, score double, block int, asks boolean, ids array<long>"


def cosine(a, b):
    a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
    return sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b))


def test_awkward_vectors(spark):
    some = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 2.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0]), (5, [-1.0, 0.5]), (6, [3.0, 3.0]), (7, [1e-200, 1e-200]), (8, [1.0, 2.0, 3.0]), (10, [3.0, 2.0, 1.0])]
    none = [(12, None), (14, []), (16, [0.0, 0.0]), (18, [float("nan"), 1.0]), (20, [None, 1.0]), (22, [float("inf"), 1.0]), (None, [1.0, 0.0])]
    rows = [(i, v, 5, 6, [1.0], 7, 8, 0.5, 9, 0.25, 3, True, [1]) for i, v in some + none]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {}
    for r in ann.search(vectors, vectors.where("vec_id % 2 = 0")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    held = {(i, tuple(v)) for i, v in some}
    for q, v in held:
        if q % 2:
            continue
        best = {}
        for i, w in held:
            if i != q and len(w) == len(v):
                best[i] = max(best.get(i, -9.0), cosine(v, w))
        wanted = sorted(best.items(), key=lambda p: (-round(p[1], 12), p[0]))[:5]
        got = sorted(found.get(q, []))
        assert [g[0] for g in got] == list(range(1, len(wanted) + 1))
        assert all(abs(g[2] - w[1]) < 1e-9 for g, w in zip(got, wanted)), (q, got, wanted)
    assert set(found) == {q for q, _ in held if q % 2 == 0}
    assert ann.search(vectors.limit(0), vectors).count() == 0 and ann.search(vectors, vectors.limit(0)).count() == 0
