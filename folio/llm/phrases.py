"""Collocations by fingerprints of word sequences (operator 12).

A word's fingerprint is a difference of a prefix polynomial over the bytes, a phrase's one over its words' fingerprints;
both are numpy sums of whole slices of text. Fingerprints of one and two words are counted over all documents, then those
of longer phrases whose pairs of words are all frequent. Frequent fingerprints only say where to look: the phrases that
bear one are counted once more as text, so a collision adds a candidate at most and never a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import meet, written

#: Words of a phrase at most.
LONGEST = 4
#: Bytes of text whose words are hashed at once; a longer text is a slice of its own.
SLICE = 1 << 20
#: Bits of a filter for each fingerprint in it, and bits at most: 32 MB.
BITS_EACH, MOST_BITS = 12, 1 << 28
SPLITS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE, _BREAK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Odd, so they have inverses modulo 2**64.
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_KINDS = np.array([0x2545F4914F6CDD1D * k % (1 << 64) for k in range(LONGEST + 1)], dtype=np.uint64)


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers, kept for the next slice."""
    if len(_tables.get(base, ())) < n:
        out = np.full(n + n // 8, base, dtype=np.uint64)
        out[:1] = 1
        _tables[base] = np.multiply.accumulate(out, out=out)
    return _tables[base][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, base: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of every low..high the polynomial of its values, the first with power 0, from sums of prefixes."""
    n = len(values)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.multiply(values, _powers(base, n), out=prefix[1:])
    np.cumsum(prefix, out=prefix)
    return (prefix[high] - prefix[low]) * _powers(pow(base, -1, 1 << 64), n + 1)[low]


class Words:
    """The words of some texts: first byte, end, fingerprint and, for each, how many follow in its piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> None:
        """langs has the fingerprint of each text's language."""
        self.data = data = _LOWER[data]
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = ~(_SPACE | _BREAK)[data]
        first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        first[full] = inside[1:-1][full]
        last[full[1:] - 1] = inside[1:-1][full[1:] - 1]
        self.low, self.high = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.low, side="right") - 1
        size = (self.high - self.low).astype(np.uint64)
        self.own = _mixed(_sums(data, _BYTE, self.low, self.high) + size * np.uint64(_WORD))
        self.lang = langs[self.text]
        breaks = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(_BREAK[data], out=breaks[1:])
        piece = breaks[self.low] if len(self.low) else np.zeros(0, dtype=np.int64)
        same = np.zeros(len(self.low) + 1, dtype=bool)
        same[1:-1] = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])
        # words from here to the end of the piece
        ends = np.flatnonzero(~same[1:])
        self.left = ends[np.searchsorted(ends, np.arange(len(self.low)))] - np.arange(len(self.low)) + 1 if len(self.low) else piece

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all phrases of n words: number of the first word, and fingerprint."""
        at = np.flatnonzero(self.left >= n)
        return at, _mixed(_sums(self.own, _WORD, at, at + n) + self.lang[at] + _KINDS[n])

    def spelled(self, some: np.ndarray) -> pa.Array:
        """These words as text: words and what stands between them are the items of one array over the bytes."""
        cuts = np.stack([self.low, self.high], axis=1).reshape(-1)
        items = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(self.data))
        return items.take(pa.array(2 * some))

    def known(self) -> np.ndarray:
        """A number for every word, equal where language and bytes are: fingerprints first, then the bytes themselves are compared."""
        _, first, number = np.unique(_mixed(self.own + self.lang), return_index=True, return_inverse=True)
        number = number.reshape(-1).astype(np.int64)
        like = first[number]
        size = self.high - self.low
        off = (size[like] != size) | (self.lang[like] != self.lang)
        ok = np.flatnonzero(~off)
        for some in np.array_split(ok, max(1, len(ok) // 50_000)):
            upto = np.cumsum(size[some])
            where = np.repeat(self.low[some] - upto + size[some], size[some]) + np.arange(upto[-1] if len(upto) else 0)
            other = np.repeat(self.low[like[some]] - self.low[some], size[some]) + where
            off[np.repeat(some, size[some])[self.data[where] != self.data[other]]] = True
        names: dict[tuple, int] = {}
        for k in np.flatnonzero(off).tolist():
            number[k] = names.setdefault((self.lang[k], self.data[self.low[k] : self.high[k]].tobytes()), len(first) + len(names))
        return number


class Filter:
    """A Bloom filter of fingerprints, which says no only of those not in it."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def __contains__(self, fingerprint: int) -> bool:
        return bool(self.has(np.array([fingerprint], dtype=np.uint64))[0])

    def has(self, found: np.ndarray) -> np.ndarray:
        out = np.ones(len(found), dtype=bool)
        for shift in (0, 21, 40):
            bit = (found >> np.uint64(shift) ^ found << np.uint64(shift // 3)) & self.mask
            out &= (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def bloom(prints: DataFrame, column: str = "print", bits: int | None = None) -> Filter:
    """The filter of a column of fingerprints: BITS_EACH bits for each, a power of two, MOST_BITS at most (beyond, more of what it is asked passes).

    Spark sets the bits; the driver gets the words of the filter that are not zero.
    """
    size = bits or min(MOST_BITS, 1 << max(12, (BITS_EACH * prints.count()).bit_length()))
    mask, own = size - 1, F.col(column)
    bit = F.array(*(F.shiftrightunsigned(own, s).bitwiseXOR(F.shiftleft(own, s // 3)).bitwiseAND(F.lit(mask).cast("long")) for s in (0, 21, 40)))
    rows = prints.select(F.explode(bit).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    words = np.zeros(size // 64, dtype=np.uint64)
    for row in rows.toArrow().to_batches():
        words[row["word"].to_numpy()] = row["bits"].to_numpy().view(np.uint64)
    return Filter(words)


def _in_slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[tuple[Words, list[str], np.ndarray]]:
    """Words of about so many bytes of whole texts, with the language and the place of each text."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        names, of = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object), return_inverse=True)
        prints = np.array([int(pd.util.hash_array(np.array([n], dtype=object))[0]) for n in names], dtype=np.uint64)
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1)
            here = of.reshape(-1)[low:high]
            yield Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], prints[here]), names[here].tolist(), batch.column("at").to_numpy(zero_copy_only=False)[low:high]
            low = high


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("at"))


def _counted(docs: DataFrame, sizes: tuple[int, ...], least: int, pairs: Filter | None) -> DataFrame:
    """print: fingerprints of phrases of these sizes that at least so many have, and (lang, n) the words of each language where size 1 is among them.

    With pairs only phrases are looked at whose pairs of words are all in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pairs) if pairs else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs, _ in _in_slices(batches):
            if shared:
                some = np.zeros(len(words.low) + LONGEST, dtype=bool)
                at, prints = words.phrases(2)
                some[at] = shared.value.has(prints)
            for n in sizes:
                at, prints = words.phrases(n)
                if shared:
                    prints = prints[np.all([some[at + k] for k in range(n - 1)], axis=0)]
                prints, many = np.unique(prints, return_counts=True)
                yield pa.record_batch({"lang": pa.nulls(len(prints), pa.string()), "print": prints.view(np.int64), "n": many})
            if 1 in sizes and len(words.low):
                texts, many = np.unique(words.text, return_counts=True)
                by = pd.Series(many).groupby(np.array(langs, dtype=object)[texts]).sum()
                yield pa.record_batch({"lang": pa.array(by.index.tolist(), pa.string()), "print": pa.nulls(len(by), pa.int64()), "n": pa.array(by.tolist(), pa.int64())})

    found = _texts(docs).mapInArrow(count, "lang string, print long, n long")
    return found.groupBy("lang", "print").agg(F.sum("n").alias("n")).where(F.col("lang").isNotNull() | (F.col("n") >= least))


def _as_text(docs: DataFrame, frequent: Filter, least: int) -> DataFrame:
    """lang, phrase, words, f, at: how often each phrase occurs, for all that occur at least so often, and the first doc_id that has it."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs, docs_ in _in_slices(batches):
            if not len(words.low):
                continue
            number = words.known()
            _, first, number = np.unique(number, return_index=True, return_inverse=True)
            number = number.reshape(-1).astype(np.int64)
            chain, many = number, len(first)
            for n in range(1, LONGEST + 1):
                at, prints = words.phrases(n)
                if n > 1:  # the first n - 1 words by their number, and the last by its own
                    longer = np.full(len(number), -1, dtype=np.int64)
                    _, ids = np.unique(chain[at] * len(first) + number[at + n - 1], return_inverse=True)
                    longer[at] = ids.reshape(-1)
                    chain, many = longer, int(ids.max(initial=-1)) + 1
                at = at[shared.value.has(prints)]
                of, doc = chain[at], docs_[words.text[at]]
                count, one, least_doc = np.bincount(of, minlength=many), np.empty(many, dtype=np.int64), np.full(many, np.iinfo(np.int64).max)
                one[of[::-1]] = at[::-1]
                np.minimum.at(least_doc, of, doc)
                which = np.flatnonzero(count)
                text = words.text[one[which]]
                phrase = pc.binary_join_element_wise(*(words.spelled(one[which] + k) for k in range(n)), pa.scalar(" ", pa.large_string())).cast(pa.string())
                yield pa.record_batch({"lang": pa.array(langs, pa.string()).take(pa.array(text)), "phrase": phrase, "words": pa.array(np.full(len(which), n), pa.int64()), "f": count[which], "at": least_doc[which]})

    found = _texts(docs).mapInArrow(write, "lang string, phrase string, words long, f long, at long")
    return found.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("f").alias("f"), F.min("at").alias("at")).where(F.col("f") >= least)


def _wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def mine_phrases(docs: DataFrame, least: int = 30, top: int = 2_000, covered: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, example_doc_id: the best collocations of every language.

    ASCII capitals are lowered, texts are cut at ``.,;:!?`` and line breaks into pieces and pieces at spaces and tabs into
    words. A candidate has 2 to 4 words and occurs a >= least times. Cut after its first words it has parts that occur l and
    r times and a score of floor(2000000 a / (l + r)); its lowest-scoring cut counts, of equal ones the first. A candidate is
    dropped when a longer one contains it and occurs at least covered percent as often. n is the words of the language.
    Each language's best ``top`` by score, a (both falling) and phrase (by bytes) are returned.

    A null language is ``und``, a null text is empty; repeated rows count again, and documents without an id too (an example
    without one is null). Texts are read whole whatever their length. Numbers past 64 bits are decimals. Other columns
    of docs change nothing, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    short = written(_counted(docs, (1, 2), least, None))
    totals, prints = short.where("print is null").select("lang", "n"), short.where("print is not null").select("print")
    pairs = bloom(prints)
    longer = written(_counted(docs, tuple(range(3, LONGEST + 1)), least, pairs).select("print"))
    frequent = bloom(prints.unionByName(longer))
    found = written(_as_text(docs, frequent, least))

    split = F.split("phrase", " ")
    part = lambda low, size: F.array_join(F.slice(split, low, size), " ")
    candidates = found.where("words >= 2")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("words") - 1)))
    sides = cuts.select("lang", F.col("phrase").alias("whole"), "k", F.explode(F.array(F.struct(F.lit(0).alias("right"), part(F.lit(1), F.col("k")).alias("phrase")), F.struct(F.lit(1).alias("right"), part(F.col("k") + 1, F.col("words")).alias("phrase")))).alias("side"))
    sides = written(sides.select("lang", "whole", "k", "side.right", "side.phrase"))
    asked = written(sides.groupBy("lang", "phrase").agg(F.count("*").alias("uses")).join(found.select("lang", "phrase", "f"), ["lang", "phrase"]))
    told = meet(sides, asked, ["lang", "phrase"], "uses")
    parts = told.groupBy("lang", F.col("whole").alias("phrase"), "k").agg(F.sum(F.when(F.col("right") == 0, F.col("f"))).alias("l"), F.sum(F.when(F.col("right") == 1, F.col("f"))).alias("r"))
    parts = parts.join(candidates, ["lang", "phrase"])
    score = F.expr("(cast(f as decimal(20,0)) * cast(2000000 as decimal(10,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = parts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("f").alias("a"), F.first("at").alias("at"))

    inner = candidates.where("words >= 3").withColumn("size", F.explode(F.sequence(F.lit(2).cast("long"), F.col("words") - 1)))
    inner = inner.withColumn("low", F.explode(F.sequence(F.lit(1).cast("long"), F.col("words") - F.col("size") + 1)))
    covers = inner.select("lang", part(F.col("low"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    kept = scored.join(covers, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (_wide("cover") * 100 < _wide("a") * covered))

    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SPLITS))).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    # a row for each language that has a phrase: top times as many rows at most meet it
    best = best.join(totals, "lang")
    return best.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", F.when(F.col("at") >= 0, F.col("at")).alias("example_doc_id"))
