"""The registered corpus queries over the smallest tables: SQL where there is some, else libraries and brute force."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from folio.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text, lang from read_parquet('{SF}/documents.parquet')").fetchall()


def result(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_every_operator_has_a_query_and_a_result_to_hold():
    """Each of the thirteen operators is registered once, and has SQL or a test of its own here."""
    import pathlib

    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    here = pathlib.Path(__file__).read_text()
    assert all(name in queries.ORACLES or f'"{name}"' in here.rsplit("def test_op1_", 1)[-1] for name in queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    wanted = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    rows = lambda found, names: sorted([tuple(float(r[names.index(c)]) if isinstance(r[names.index(c)], (int, float)) else r[names.index(c)] for c in columns) for r in found], key=str)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(wanted.fetchall(), wanted.columns)


def test_op1_equals_the_library(spark, documents):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path())
    lib.no_truncation()
    lib.no_padding()
    got = {r.doc_id: r for r in result(spark, "op1_bpe")}
    assert len(got) == len(documents)
    for doc, text, _ in documents:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert got[doc].n_tokens == len(ids) and got[doc].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op3_rows_are_what_they_say(spark, documents):
    texts = {d: t for d, t, _ in documents if t is not None}
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in texts.items()}
    lower = lambda w: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in w]
    rows = result(spark, "op3_substring_dedup")
    assert {r.doc_id for r in rows if r.removed} and all(r.copies > 1 for r in rows)
    gone = collections.defaultdict(set)
    for r in rows:
        if r.first_word is not None:
            run, kept = words[r.doc_id][r.first_word : r.first_word + r.n_words], words[r.keep_doc_id][r.keep_first_word : r.keep_first_word + r.n_words]
            assert lower(run) == lower(kept) and len(run) == r.n_words >= 25
        elif r.removed:
            gone[r.doc_id].add(r.paragraph)
    # a kept line is removed by no other
    assert not [r for r in rows if r.first_word is None and r.keep_paragraph in gone[r.keep_doc_id]]
    # every 25 words that two documents share outside removed lines are in a row of both
    places, told = collections.defaultdict(set), collections.defaultdict(set)
    for r in rows:
        if r.first_word is not None:
            told[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words - 24))
    for d, text in texts.items():
        line = [k for k, row in enumerate(text.split("\n")) for _ in re.findall(r"[^\x20\x09-\x0D]+", row)]
        w = lower(words[d])
        for p in range(len(w) - 24):
            if not gone[d] & set(line[p : p + 25]):
                places[tuple(w[p : p + 25])].add((d, p))
    for held in places.values():
        if len({d for d, _ in held}) > 1:
            assert all(p in told[d] for d, p in held)


def test_op6_equals_brute_force(spark, documents):
    from test_corpus_operators import brute_groups

    groups, sizes = brute_groups([(d, t or "") for d, t, _ in documents], 3, 85, 100)
    for r in result(spark, "op6_minhash"):
        assert (r.component_id, r.n_shingles, r.kept) == (groups[r.doc_id], sizes[r.doc_id], r.doc_id == groups[r.doc_id])


def test_op7_equals_brute_force(spark, documents):
    raw = {d: (t or "").encode() for d, t, _ in documents}
    count = collections.Counter(hash(b[i : i + 200]) for b in raw.values() for i in range(len(b) - 199))
    got = {r.doc_id: r for r in result(spark, "op7_suffix_dedup")}
    for d, b in raw.items():
        gone = np.zeros(len(b) + 1, dtype=np.int64)
        for i in range(len(b) - 199):
            if count[hash(b[i : i + 200])] > 1:
                gone[i] += 1
                gone[i + 200 if i + 200 < len(b) else len(b)] -= 1
        gone = np.cumsum(gone[:-1]) > 0 if len(b) else np.zeros(0, dtype=bool)
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("name,label,modulus,held", [("op5_toxicity", "toxic", 3, 1), ("op8_quality", "quality", 4, 2)])
def test_scores(spark, documents, name, label, modulus, held):
    sf = "/root/testdata/sf0.01"
    marks = dict(duckdb.sql(f"select doc_id, max({label}) from read_parquet('{sf}/labels.parquet') group by 1").fetchall())
    rows = queries.QUERIES[name](spark, sf).collect()
    assert all(r.held_out == (fold(r.doc_id, modulus) == held) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    seen = [(r.predicted, r.score, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    yes, no = ([s for _, s, m in seen if m == k] for k in (1, 0))
    # of a marked and an unmarked document the marked one has the higher score, and few unmarked ones are predicted
    assert np.mean([a > b for a in yes for b in no]) >= 0.85 and np.mean([p for p, _, m in seen if m == 0]) <= 0.1
    assert name == "op5_toxicity" or np.mean([p == m for p, _, m in seen]) >= 0.9


def test_a_fit_of_separable_classes_converges():
    from folio.llm.toxicity import _fit_logistic

    x = np.stack([np.ones(200), np.repeat([0.0, 3.0], 100), np.linspace(0, 1, 200)], axis=1)
    w = _fit_logistic(x, np.repeat([0.0, 1.0], 100))
    p = 1 / (1 + np.exp(-x @ w))
    assert p[:100].max() < 0.1 and p[100:].min() > 0.9


def test_op9_predicts_held_out_languages(spark, documents):
    langs = {d: lang for d, _, lang in documents}
    rows = result(spark, "op9_language_id")
    assert len(rows) == len(documents) and all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out and langs[r.doc_id] and r.lang_pred != "und"]) >= 0.95


def test_op10_recall(spark):
    rows = duckdb.sql("select vec_id, embedding from read_parquet('/root/testdata/sf0.01/embeddings.parquet')").fetchall()
    ids, x = np.array([v for v, _ in rows]), np.array([e for _, e in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = collections.defaultdict(dict)
    for r in queries.QUERIES["op10_nearest"](spark, "/root/testdata/sf0.01").collect():
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    hits, asked = 0, [i for i, v in enumerate(ids) if v % 50 == 0]
    for i in asked:
        cos = x @ x[i]
        cos[i] = -9
        assert sorted(found[ids[i]]) == [1, 2, 3, 4, 5] and all(s == pytest.approx(cos[np.flatnonzero(ids == v)[0]]) for v, s in found[ids[i]].values())
        hits += len(set(ids[np.argsort(-cos)[:5]].tolist()) & {v for v, _ in found[ids[i]].values()})
    assert hits >= 0.9 * 5 * len(asked)


def test_pipeline_keeps_one_of_repeated_rows_and_extra_columns(spark):
    import corpus_pipeline

    rows = [(1, "the old house stands near the river and the bridge", "en", "a", 9, "x", 1), (1, "the old house stands near the river and the bridge", "en", "a", 9, "x", 1), (2, "das haus steht am fluss und der mann geht in die stadt", "de", "b", 9, "y", 2), (3, None, "en", "a", 0, "z", 3)]
    rows += [(10 + i, f"the {i} old men and the sea with that house number {i * 7}", "en", "a", 9, "e", i) for i in range(6)] + [(20 + i, f"der {i} alte mann und das meer mit dem haus nummer {i * 7}", "de", "b", 9, "d", i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, _times int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        got = [(r.doc_id, r.kept) for r in docs.collect()]
        assert set(got) <= {(r[0], r[5]) for r in rows}, name
        if name != "mix_sources":
            assert got.count((1, "x")) == (2 if name == "language_id" else 1)


AWKWARD = "doc_id long, text string, lang string, source string, score double, kept string, features string, _id long, _fold int, toxic int, quality int, n int, key string, _row int, target double, runs string, lang_pred int, unit_id string"


def _operators():
    from folio.llm import bpe, exact, langid, minhash, mixing, phrases, quality, secrets, substring, suffix, toxicity

    labels = lambda d: d.where("doc_id is not null").select("doc_id", "toxic", "quality")
    return {
        "op1": lambda d: bpe.bpe_encode(d, queries.tokenizer_path()), "op2": exact.exact_dedup, "op3": substring.repeated_paragraphs, "op4": mixing.mix,
        "op5": lambda d: toxicity.predict(d, toxicity.fit(d, labels(d))), "op6": minhash.near_dedup, "op7": suffix.suffix_dedup, "op8": lambda d: quality.predict(d, quality.fit(d, labels(d))), "op9": lambda d: langid.predict(d, langid.fit(d)), "op12": lambda d: phrases.mine_phrases(d, 3), "op13": secrets.scan_secrets,
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op12", "op13"])
def test_awkward_rows(spark, name):
    """Nulls anywhere, empty and very long texts, repeated rows, columns named like those used inside, and no rows at all."""
    some = lambda i, text, lang="en": (i, text, lang, f"s{i}", 0.5, "k", "f", 7, 1, i % 2, 1 - i % 2, 3, "k", 4, 0.1, "r", 9, "u")
    none = (None,) * 15
    long = " ".join(f"w{i % 977} of the {i % 31}" for i in range(8_000))
    rows = [some(1, "the house of the old man"), some(1, "the house of the old man"), some(2, ""), some(3, long, "de"), some(4, "x" * 20_000), some(5, "\ud7ff é \n\t\x00 z"), (6, None, None, *none), (None, "the house of the old man", None, *none), (None, None, None, *none)]
    docs = spark.createDataFrame(rows, AWKWARD)
    run = _operators()[name]
    found = run(docs).collect()
    if name not in ("op3", "op12"):
        assert len(found) == len(rows) and sum(r.doc_id is None for r in found) == 2
    assert sorted(map(str, found)) == sorted(map(str, run(docs).collect()))
    run(docs.limit(0)).collect()


def test_op4_is_the_same_whatever_the_layout(spark):
    """Shares and totals are sums of whole numbers, so neither the order of rows nor their partitions change a row."""
    from folio.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = None
    for parts, adaptive in ((1, "true"), (4, "false"), (16, "true")):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            got = sorted((r.doc_id, r.taken, r.first_slot, r.target) for r in mixing.mix(docs.repartition(parts).orderBy("n_chars") if parts == 16 else docs.repartition(parts)).collect())
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        first = first or got
        assert got == first
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in queries.QUERIES["op4_mixing"](spark, SF).collect():
        by[r.source_size, r.target][0] += r.taken
    assert all(abs(taken - target) <= 5 * mixing.BLOCK_WORDS for (_, target), (taken, _) in by.items())
    assert abs(sum(t for t, _ in by.values()) - sum(s for s, _ in by)) < 2 * mixing.BLOCK_WORDS
