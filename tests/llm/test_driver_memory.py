"""What the driver gets is bounded: no table is broadcast because Spark sizes it too low."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import ann, components, mixing, near


def broadcast_parts(df):
    """The nodes below each broadcast that Spark plans for df by its guess of sizes."""
    found, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(re.match(r"[ :+|-]*(\*\(\d+\) )?", line).group(0))
        if depth is not None and at > depth:
            found[-1].append(line[at:])
        elif line[at:].startswith("BroadcastExchange"):
            depth = at
            found.append([])
        else:
            depth = None
    return found


@pytest.fixture
def planned(spark, monkeypatch):
    """Parts broadcast in what a module writes, as planned while tables of up to 700 kB are taken for small ones."""

    def watch(module):
        seen, write = [], module.written
        monkeypatch.setattr(module, "written", lambda df: (seen.extend(broadcast_parts(df)), write(df))[1])
        return seen

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "700k")
    yield watch
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def shapeless(spark):
    draw = np.random.default_rng(11)
    return spark.createDataFrame([(i, v) for i, v in enumerate(draw.normal(size=(3000, 64)).astype(np.float32).tolist())], "vec_id long, embedding array<float>").repartition(4).cache()


def test_queries_of_many_lists_are_not_broadcast(spark, shapeless, planned):
    """Each query looks into many lists: its copies once were a table that Spark took for a small one."""
    parts = planned(ann)
    found = ann.search(shapeless, shapeless.where("vec_id % 5 < 2")).collect()
    assert not any("MapInPandas" in line for part in parts for line in part), parts
    assert len(found) == 6_000
    x = np.array([r.embedding for r in shapeless.orderBy("vec_id").collect()])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for r in found:
        cos = x @ x[r.query_id]
        assert abs(cos[r.vec_id] - r.score) < 1e-6
        hits += (cos > cos[r.vec_id] + 1e-9).sum() <= 5
    assert hits / len(found) > 0.9


@pytest.mark.parametrize("kind", ["float", "double"])
def test_the_sample_is_cut_before_it_is_collected(spark, shapeless, monkeypatch, kind):
    monkeypatch.setattr(ann, "SAMPLE", 50)
    rows = shapeless.select(F.array("vec_id").alias("ids"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    wanted = rows.orderBy(F.xxhash64(F.col("embedding").cast("array<double>"))).limit(50).collect()
    got = ann._sampled(rows)["embedding"].tolist()
    assert len(got) == 50 and all(np.allclose(g, np.array(w.embedding) / np.abs(w.embedding).max(), atol=1e-6) for g, w in zip(got, wanted, strict=True))
    assert len(ann._sampled(rows.limit(20))) == 20 and len(ann._sampled(rows.limit(0))) == 0


@pytest.mark.parametrize("floats, piece", [(64 * 40, 7), (64, 4096)])
def test_small_blocks_find_the_same(spark, shapeless, monkeypatch, floats, piece):
    """Packs cut into blocks and lists cut into pieces give the rows of whole ones; copies and repeated ids too."""
    some = shapeless.where("vec_id < 600")
    both = some.unionByName(some.select((F.col("vec_id") + 64 * 100).alias("vec_id"), "embedding").where("vec_id % 3 = 0")).unionByName(some.where("vec_id = 7").select(F.lit(8).cast("long").alias("vec_id"), "embedding"))
    queries = both.where("vec_id % 10 < 3")
    plain = sorted(map(tuple, ann.search(both, queries).collect()))
    monkeypatch.setattr(ann, "FLOATS", floats)
    monkeypatch.setattr(ann, "PIECE", piece)
    assert sorted(map(tuple, ann.search(both, queries).collect())) == plain


def _texts(spark, groups, copies, words):
    """Near copies: groups of texts that differ in one word or two."""
    draw = np.random.default_rng(3)
    rows = []
    for g in range(groups):
        own = draw.integers(0, 1 << 40, words).astype(str)
        for c in range(copies):
            own[draw.integers(0, words)] = f"w{g}x{c}"
            rows.append((len(rows), " ".join(own), "en", f"s{g % 3}", 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_blocks_of_words_are_not_broadcast(spark, planned):
    """mix() has a row for each block of words on both sides of a join, of which Spark took one for a small table."""
    docs = _texts(spark, 20, 10, 300)
    planned(mixing)
    done = mixing.mix(docs)
    assert not any("_cell" in line for part in broadcast_parts(done) for line in part)
    got = {r.doc_id: r for r in done.collect()}
    assert len(got) == 200 and all(0 <= r.taken <= 3 * r.size == 900 for r in got.values())


def test_copies_of_members_are_not_broadcast(spark, planned):
    """near_groups() copies the members of large buckets to several blocks, which Spark took for a small table."""
    parts = planned(components)
    units = _texts(spark, 10, 40, 300).select(F.col("doc_id").alias("unit_id"), "text")
    groups = {}
    for r in near.near_groups(units, rows=1).collect():
        groups.setdefault(r.group_id, []).append(r.unit_id)
    assert not any(re.search(r"Generate explode.*[mr]b#", line) for part in parts for line in part)
    assert len(groups) >= 10 and all(u // 40 == g // 40 for g, own in groups.items() for u in own)


def test_texts_are_not_broadcast(spark, planned, tmp_path):
    """Texts that compress well look like a small table by the size of their files."""
    rows = [(i, "word " * 2000 + f"w{i}", "en", f"s{i % 3}", 0) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    done = corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
    assert not any("text#" in line for part in broadcast_parts(done) for line in part)
    assert {r.doc_id for r in done.select("doc_id").collect()} <= set(range(200))
