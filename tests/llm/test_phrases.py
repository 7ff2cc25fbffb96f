"""Collocations against a plain count of all phrases."""

import collections
import random
import re

import numpy as np
import pytest

from folio.llm import phrases


def brute(rows, least, top):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    often = {k: a for k, a in f.items() if a >= least}
    cover = collections.Counter()
    for (lang, w), a in often.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                cover[lang, w[i : i + m]] = max(cover[lang, w[i : i + m]], a)
    out = collections.defaultdict(list)
    for (lang, w), a in often.items():
        if len(w) > 1 and 100 * cover[lang, w] < 80 * a:
            score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def made(n=400, seed=5):
    draw = random.Random(seed)
    word = "the old house of New york é 日本 stands, near; a river.\n and\tthen x\x0by \x00 !? the of".split(" ")
    return [(draw.choice(["en", "en", "en", None, "und", ""]), " ".join(draw.choices(word, k=draw.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("least,top", [(30, 2_000), (3, 7)])
def test_phrases_equal_a_plain_count(spark, least, top):
    rows = made() + [("en", None), ("fr", ""), ("de", "der alte mann " * 9_000), ("de", "x" * 50_000)]
    docs = spark.createDataFrame([(i % 50 or None, lang, text, "p", 1) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int").repartition(3)
    found = phrases.mine_phrases(docs, least, top)
    assert sorted(tuple(r)[:8] for r in found.collect()) == brute(rows, least, top)
    assert phrases.mine_phrases(docs.limit(0)).count() == 0 and phrases.mine_phrases(docs.where("text is null or text = ''")).count() == 0


def test_a_full_filter_and_equal_fingerprints_change_nothing(spark, monkeypatch):
    """Candidates that pass for nothing, and words and phrases with the same fingerprint, are told apart by their text."""
    rows = made(150, 9)
    docs = spark.createDataFrame([(lang, text, i) for i, (lang, text) in enumerate(rows)], "lang string, text string, doc_id long")
    full = phrases.Filter(np.full(64, np.uint64(2**64 - 1)))
    counted = sorted(tuple(r) for r in phrases._as_text(docs, full, 5).select("lang", "phrase", "f").collect())
    words = phrases.Words(np.frombuffer(b"ab cd ab ef", dtype=np.uint8), np.array([0, 5, 11]), np.array([7, 7], dtype=np.uint64))
    words.own[:] = 1  # every word looks alike
    number = words.known()
    assert number[0] == number[2] and len(set(number.tolist())) == 3
    plain = collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").lower()):
            w = re.findall(r"[^\x20\x09]+", piece)
            plain.update(("und" if lang is None else lang, " ".join(w[i : i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    assert counted == sorted((lang, p, c) for (lang, p), c in plain.items() if c >= 5)


def test_pieces_end_with_texts_and_at_breaks():
    text = b"Ab  c.d\te" + b"f g"
    words = phrases.Words(np.frombuffer(text, dtype=np.uint8), np.array([0, 9, 9, 12]), np.zeros(3, dtype=np.uint64))
    assert [words.data[a:b].tobytes() for a, b in zip(words.low, words.high)] == [b"ab", b"c", b"d", b"e", b"f", b"g"]
    assert words.left.tolist() == [2, 1, 2, 1, 2, 1] and words.text.tolist() == [0, 0, 0, 0, 2, 2]


def test_filter_has_all_that_went_in(spark):
    prints = spark.range(3_000).selectExpr("xxhash64(id) as print")
    made_ = phrases.bloom(prints)
    own = np.array([r.print for r in prints.collect()], dtype=np.int64).view(np.uint64)
    assert made_.has(own).all() and int(own[0]) in made_
    other = np.array([r.p for r in spark.range(3_000).selectExpr("xxhash64(id, 5) as p").collect()], dtype=np.int64).view(np.uint64)
    assert made_.has(other).mean() < 0.1
