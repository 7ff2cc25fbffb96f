"""Substring dedup by paragraphs: MinHash bands, exact Jaccard, removal by components (operator 3).

Lines are compared as wholes and resolved first. A passage inside other text is a paragraph too: every 25
words in a row of the lines that stay, in whatever lines. Seeds of 13 words, at places whose next three words
have the smallest hash of 13 neighbours, tell where texts can share so many words; there passages are
compared by 128-bit digests, first in pieces, then one by one. So what a line or passage is removed for stands
in text that stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, dropped, in_slices, meet, solid, written
from .mixing import word_count
from .near import mixed, near_groups, placed_words

#: A paragraph is a line of at least so many words, one shingle; shorter lines are never removed.
MIN_WORDS = 5
#: Share of the pairs of lines at the limit of similarity that may be overlooked, and rows of a band: 12 bands follow.
#: Shingles of five words are so rare that three rows bring few unlike lines together, and fewer bands cost less.
LOSS, ROWS = 2e-4, 3
#: Words of a passage.
PASSAGE = 25
#: Words of a seed; any PASSAGE words in a row hold one.
SEED = 13
_PLACE = np.uint64((1 << 26) - 1)
#: meet() where groups are far fewer than rows.
_meet = partial(meet, side="shuffle_hash")


def one_text(docs: DataFrame) -> DataFrame:
    """doc_id, text of every doc_id with a text; of several texts of one doc_id the smallest."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = written(rows.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"))
    if again.isEmpty():
        return rows
    least = rows.join(again, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return rows.join(again, "doc_id", "left_anti").unionByName(least)


def _has_words(text: Column, least: int) -> Column:
    """Whether text has so many words; of long texts only the first few words are read, unless many are asked for."""
    if not 1 <= least <= 64:
        return word_count(text) >= least
    return text.rlike(rf"^{SPACE[:-1]}*+(?:{WORD}+{SPACE}+){{{least - 1}}}{WORD[:-1]}")


def paragraphs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """unit_id, doc_id, paragraph (number of the line, from 0), text of every line of at least min_words words of docs(doc_id, text), as a written table."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "text"))
    lines = lines.where(_has_words(F.col("text"), min_words))
    return written(lines.select(F.monotonically_increasing_id().alias("unit_id"), "doc_id", "paragraph", "text"))


def _words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, number of the text, number within the text, and line of every word."""
    w, owner, starts, raw, offsets = placed_words(texts)
    breaks = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10)
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets)[owner]
    first = np.searchsorted(owner, np.arange(len(texts)))
    return w, owner, np.arange(len(w)) - first[owner], line


def _grams(w: np.ndarray, sizes: tuple[int, ...], step: int) -> list[np.ndarray]:
    """A hash of so many words from every place, for each of sizes, by doubling."""
    powers, k = {1: w}, 1
    while k * 2 <= max(sizes):
        powers[k * 2] = mixed(powers[k][:-k] * np.uint64(step) + powers[k][k:]) if len(powers[k]) > k else w[:0]
        k *= 2
    out = []
    for size in sizes:
        n, found, at = max(0, len(w) - size + 1), None, 0
        for k in sorted(powers, reverse=True):
            if size & k:
                part = powers[k][at : at + n]
                found = part if found is None else mixed(found * np.uint64(step + 2) + part)
                at += k
        out.append(found)
    return out


def _pieces_of(w: np.ndarray, owner: np.ndarray, good: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First passage, number of passages, seed and flatness of every piece: passages in a row with one seed.

    The seed of a passage is at the place, of those where SEED words begin inside it, whose next three words have the
    smallest hash, the first of several. Passages lie in one text, and in words that are good; flat ones have one
    word only and are pieces of their own.
    """
    n = len(w) - PASSAGE + 1
    if n < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(bool)
    three, seed = _grams(w, (3, SEED), 0xD1342543DE82EF95)
    places = len(w) - SEED + 1
    least = (three[:places] & ~_PLACE) | np.arange(places, dtype=np.uint64)
    width, size = PASSAGE - SEED + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    at = (np.minimum(least[:n], least[width - size : width - size + n]) & _PLACE).astype(np.int64)
    inside = owner[:n] == owner[PASSAGE - 1 :]
    if good is not None:
        bad = np.concatenate([[0], np.cumsum(~good)])
        inside &= bad[:n] == bad[PASSAGE:]
    changes = np.concatenate([[0], np.cumsum(w[1:] != w[:-1])])
    flat = changes[:n] == changes[PASSAGE - 1 :]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | ~inside[:-1] | (flat[1:] != flat[:-1])]) & inside
    first = np.flatnonzero(new)
    last = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    return first, last - first + 1, seed[at[first]], flat[first]


def _outside(owner: np.ndarray, line: np.ndarray, gone: pd.Series) -> np.ndarray:
    """Whether each word is outside the lines that are gone from its text."""
    good, begin = np.ones(len(owner), dtype=bool), np.searchsorted(owner, np.arange(len(gone) + 1))
    for i, lines in enumerate(gone):
        if lines is not None and len(lines):
            good[begin[i] : begin[i + 1]] = ~np.isin(line[begin[i] : begin[i + 1]], np.asarray(lines))
    return good


def seeds(docs: DataFrame) -> DataFrame:
    """doc_id, seed, n (pieces with it in the row) of every text of docs(doc_id, text, lines), outside the words of lines."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_slices(frames, "text", 1_000_000):
            w, owner, _, line = _words_of(part["text"].tolist())
            first, _, seed, _ = _pieces_of(w, owner, _outside(owner, line, part["lines"]))
            order = np.lexsort([seed, owner[first]])
            text, seed = owner[first][order], seed[order]
            fresh = np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])])) if len(seed) else order
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[text[fresh]], "seed": seed[fresh].view(np.int64), "n": np.diff(np.append(fresh, len(seed)))})

    return docs.select("doc_id", "text", "lines").mapInPandas(solid(run), "doc_id long, seed long, n int")


PIECE = "doc_id long, seed long, first_word int, flat boolean, one long, two long, passages binary, lines array<int>"


def pieces(docs: DataFrame) -> DataFrame:
    """The pieces with a wanted seed of docs(doc_id, text, seeds, lines), outside the words of lines: two digests of all words, those of each passage, and the line each passage begins in."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_slices(frames, "text", 1_000_000):
            w, owner, number, line = _words_of(part["text"].tolist())
            first, many, seed, flat = _pieces_of(w, owner, _outside(owner, line, part["lines"]))
            seed, own = seed.view(np.int64), owner[first]
            wanted, at = np.zeros(len(first), dtype=bool), np.searchsorted(own, np.arange(len(part) + 1))
            for i, mine in enumerate(part["seeds"]):
                wanted[at[i] : at[i + 1]] = np.isin(seed[at[i] : at[i + 1]], np.asarray(mine, dtype=np.int64))
            first, many, seed, flat, own = first[wanted], many[wanted], seed[wanted], flat[wanted], own[wanted]
            if not len(first):
                continue
            one, two = _grams(w, (PASSAGE,), 0xD1342543DE82EF95)[0], _grams(w ^ (w >> np.uint64(31)), (PASSAGE,), 0xA24BAED4963EE407)[0]
            both = np.stack([one, two], axis=1)
            raw = [both[f : f + n].tobytes() for f, n in zip(first.tolist(), many.tolist(), strict=True)]
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), dtype=np.int64).reshape(-1, 2)
            lines = [line[f : f + n] for f, n in zip(first.tolist(), many.tolist(), strict=True)]
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[own], "seed": seed, "first_word": number[first], "flat": flat, "one": digests[:, 0], "two": digests[:, 1], "passages": raw, "lines": lines})

    return docs.select("doc_id", "text", "seeds", "lines").mapInPandas(solid(run), PIECE)


RUN = "array<struct<a:int,b:int,doc_id:bigint,word:int,line:int,copies:bigint>>"


def _passages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each passage of a kind of piece, at its first place."""
    for frame in frames:
        many = (frame["passages"].str.len() // 16).to_numpy()
        digests = np.frombuffer(b"".join(frame["passages"]), dtype=np.int64).reshape(-1, 2)
        off = np.arange(len(digests)) - np.repeat(np.cumsum(many) - many, many)
        each = lambda c: np.repeat(frame[c].to_numpy(), many)  # noqa: E731, B023
        yield pd.DataFrame({"one": each("one"), "two": each("two"), "off": off, "p1": digests[:, 0], "p2": digests[:, 1], "doc_id": each("doc_id"), "word": each("first_word") + off, "line": np.concatenate(frame["lines"].tolist()), "copies": each("copies")})


def _runs_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs of passages of a kind of piece that are kept in one stretch of another place, or of this one."""
    for frame in frames:
        found = []
        for n, doc, word, lines, copies, shared in zip(frame["n"], frame["doc_id"], frame["first_word"], frame["lines"], frame["copies"], frame["shared"], strict=True):
            kept = {s["off"]: (s["doc_id"], s["word"], s["line"], s["copies"]) for s in (shared if shared is not None else ())}
            runs: list[dict] = []
            for i in range(n):
                keep = kept.get(i) or ((doc, word + i, lines[i], copies) if copies > 1 else None)
                if keep is None:
                    continue
                if runs and runs[-1]["b"] == i - 1 and runs[-1]["doc_id"] == keep[0] and runs[-1]["word"] - runs[-1]["a"] == keep[1] - i:
                    runs[-1]["b"], runs[-1]["copies"] = i, max(runs[-1]["copies"], keep[3])
                else:
                    runs.append({"a": i, "b": i, "doc_id": keep[0], "word": keep[1], "line": keep[2], "copies": keep[3]})
            found.append(runs)
        out = frame[["one", "two", "copies"]].assign(runs=found)
        yield out[out["runs"].map(len) > 0]


def repeated_passages(docs: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """doc_id, paragraph, first_word, n_words, keep_doc_id, keep_paragraph, keep_first_word, copies, removed of runs of PASSAGE words or more that stand at several places of docs(doc_id, text), a text for each doc_id.

    Every PASSAGE words in a row that stand at several places, of one document or more, are kept at the first (by
    doc_id, then word) and removed at all others, unless those overlap it; a row is a longest run of such places
    with one kept run. copies is the most places that any PASSAGE words of the run have. One word said over and
    over is no repeat within its document. lines(doc_id, lines) are lines removed already; no passage holds a word of them.

    Passages with one seed in a row are a piece. Equal pieces are one kind, settled by their number; only where a seed
    has several kinds are passages compared one by one, and each kind stands for its copies.
    """
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # texts stay unsorted: the other side, a row for each document at most, is hashed
    docs = docs.withColumn("lines", F.lit(None).cast("array<int>")) if lines is None else docs.join(lines.hint("shuffle_hash"), "doc_id", "left")
    every = written(seeds(docs))
    often = written(every.groupBy("seed").agg(F.sum("n").alias("_n"), F.count("*").alias("_rows")).where("_n > 1").select("seed", "_rows"))
    mine = _meet(every.select("doc_id", "seed"), often, ["seed"], "_rows").groupBy("doc_id").agg(F.collect_list("seed").alias("seeds"))
    found = written(pieces(docs.join(mine.hint("shuffle_hash"), "doc_id")))
    dropped(every, often)
    place = F.struct("doc_id", "first_word", "lines")
    kinds = found.groupBy("one", "two").agg(F.count("*").alias("copies"), F.min(place).alias("_first"), F.max("doc_id").alias("_last"), F.any_value("flat").alias("_flat"), F.any_value("seed").alias("seed"), F.any_value("passages").alias("passages"))
    # a flat passage is a piece of its own; one document saying a word over and over is no repeat
    kinds = written(kinds.where("not (_flat and _first.doc_id = _last)").select("one", "two", "seed", "copies", "_first.*", "passages"))
    several = written(kinds.groupBy("seed").agg(F.count("*").alias("_kinds")).where("_kinds > 1"))
    mixed_ = written(_meet(kinds, several, ["seed"], "_kinds").drop("seed", "_kinds"))
    alone = written(kinds.where("copies > 1")).join(several.select("seed"), "seed", "left_anti")
    whole = F.struct(F.lit(0).alias("a"), (F.size("lines") - 1).alias("b"), "doc_id", F.col("first_word").alias("word"), F.col("lines")[0].alias("line"), "copies")
    alone = alone.select("one", "two", "copies", F.array(whole).cast(RUN).alias("runs"))
    passages = written(mixed_.mapInPandas(solid(_passages), "one long, two long, off int, p1 long, p2 long, doc_id long, word int, line int, copies long"))
    shared = passages.groupBy("p1", "p2").agg(F.count("*").alias("_kinds"), F.min(F.struct("doc_id", "word", "line")).alias("_keep"), F.sum("copies").alias("_copies")).where("_kinds > 1")
    shared = _meet(passages.select("one", "two", "off", "p1", "p2"), written(shared), ["p1", "p2"], "_kinds")
    own = shared.groupBy("one", "two").agg(F.collect_list(F.struct("off", "_keep.doc_id", "_keep.word", "_keep.line", F.col("_copies").alias("copies"))).alias("shared"))
    both = mixed_.select("one", "two", "copies", "doc_id", "first_word", "lines", F.size("lines").alias("n")).join(own, ["one", "two"], "left").where("copies > 1 or shared is not null")
    settled = written(both.mapInPandas(solid(_runs_of), f"one long, two long, copies long, runs {RUN}").unionByName(alone))
    dropped(kinds, several, mixed_, passages)

    met = _meet(found.select("doc_id", "first_word", "flat", "one", "two", "lines"), settled, ["one", "two"], "copies")
    met = met.select("doc_id", "first_word", "flat", "lines", F.explode("runs").alias("_r")).select("doc_id", "flat", (F.col("first_word") + F.col("_r.a")).alias("_at"), (F.col("_r.b") - F.col("_r.a") + 1).alias("_n"), F.get("lines", F.col("_r.a")).alias("_own_line"), F.col("_r.doc_id").alias("_doc"), F.col("_r.word").alias("_word"), F.col("_r.line").alias("_line"), F.col("_r.copies").alias("copies"))
    shift = F.col("_at") - F.col("_word")
    met = met.withColumn("_shift", shift).where((F.col("doc_id") != F.col("_doc")) | (F.col("_shift") == 0) | ((F.col("_shift") >= PASSAGE) & ~F.col("flat")))
    order = Window.partitionBy("doc_id", "_doc", "_shift").orderBy("_at")
    starts = F.when(F.lag(F.col("_at") + F.col("_n")).over(order) == F.col("_at"), 0).otherwise(1)
    runs = met.withColumn("_start", starts).withColumn("_run", F.sum("_start").over(order))
    at_start = lambda c: F.max(F.when(F.col("_start") == 1, F.col(c))).alias(c)
    runs = runs.groupBy("doc_id", "_doc", "_shift", "_run").agg(at_start("_at"), at_start("_own_line"), at_start("_word"), at_start("_line"), (F.sum("_n") + PASSAGE - 1).alias("n_words"), F.max("copies").alias("copies"))
    runs = written(runs)
    dropped(found, settled)
    removed = (F.col("doc_id") != F.col("_doc")) | (F.col("_shift") != 0)
    return runs.select("doc_id", F.col("_own_line").alias("paragraph"), F.col("_at").cast("long").alias("first_word"), "n_words", F.col("_doc").alias("keep_doc_id"), F.col("_line").alias("keep_paragraph"), F.col("_word").cast("long").alias("keep_first_word"), "copies", removed.alias("removed"))


def repeated_lines(docs: DataFrame, words: int, num: int, den: int, min_words: int) -> DataFrame:
    """doc_id, paragraph, n_shingles, keep_doc_id, keep_paragraph, copies of the lines of docs(doc_id, text) that have a near copy."""
    units = paragraphs(docs, min_words)
    groups = written(near_groups(units, words, num, den, LOSS, ROWS))
    sizes = written(groups.groupBy("group_id").agg(F.count("*").alias("_size")).where("_size > 1"))
    some = written(_meet(groups, sizes, ["group_id"], "_size").join(units.select("unit_id", "doc_id", "paragraph"), "unit_id").select("group_id", "doc_id", "paragraph", "n"))
    keeps = written(some.groupBy("group_id").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "paragraph")).alias("_keep")))
    lines = written(_meet(some, keeps, ["group_id"], "copies").select("doc_id", "paragraph", F.col("n").alias("n_shingles"), F.col("_keep.doc_id").alias("keep_doc_id"), F.col("_keep.paragraph").alias("keep_paragraph"), "copies"))
    dropped(units, groups, sizes, some, keeps)
    return lines


def repeated_paragraphs(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, paragraph, first_word, n_words, n_shingles, keep_doc_id, keep_paragraph, keep_first_word, copies, removed for each paragraph that has a near copy.

    Lines (first_word is null) are near copies when the Jaccard similarity of their word shingles is num / den
    or more; components of near copies keep their first line (by doc_id, then line), the others are removed.
    Passages (first_word is set) are the whole runs of repeated_passages() in the lines that stay. Documents
    that share no paragraph have no rows. Null texts and null doc_ids have no paragraphs. Rows that repeat a
    doc_id are one document; of several texts the smallest counts. Other columns are ignored. A very long text
    is cut into lines and slices. An empty table gives no rows.
    """
    docs = one_text(docs)
    lines = repeated_lines(docs, words, num, den, min_words)
    none = F.lit(None).cast("long")
    removed = (F.col("doc_id") != F.col("keep_doc_id")) | (F.col("paragraph") != F.col("keep_paragraph"))
    lines = lines.select("doc_id", "paragraph", none.alias("first_word"), none.alias("n_words"), "n_shingles", "keep_doc_id", "keep_paragraph", none.alias("keep_first_word"), "copies", removed.alias("removed"))
    gone = written(lines.where("removed").groupBy("doc_id").agg(F.collect_set("paragraph").alias("lines")))
    inside = repeated_passages(docs, gone).withColumn("n_shingles", F.greatest(F.lit(1), F.col("n_words") - words + 1))
    return lines.unionByName(inside)


def without(text: str, lines: list[int], runs: list[tuple[int, int]]) -> str:
    """text without the given lines and without the given runs (number of the first word, words)."""
    gone = np.zeros(len(text) + 1, dtype=bool)
    if len(runs):
        spans = [m.span() for m in re.finditer(WORD, text)]
        for first, words in runs:
            held = spans[first : first + words]
            if held:
                gone[held[0][0] : held[-1][1]] = True
    out, at, skipped = [], 0, set(lines)
    for number, line in enumerate(text.split("\n")):
        if number not in skipped:
            out.append("".join(c for c, g in zip(line, gone[at : at + len(line)], strict=True) if not g))
        at += len(line) + 1
    return "\n".join(out)


def substring_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id and text without the removed lines and passages, for every document of repeated_paragraphs() that loses some."""
    gone = repeated_paragraphs(docs, **options).where("removed").groupBy("doc_id").agg(F.collect_set(F.when(F.col("first_word").isNull(), F.col("paragraph"))).alias("_lines"), F.collect_set(F.when(F.col("first_word").isNotNull(), F.array("first_word", "n_words"))).alias("_runs"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_slices(frames, "text"):
            kept = [without(t, x, y) for t, x, y in zip(part["text"], part["_lines"], part["_runs"], strict=True)]
            yield pd.DataFrame({"doc_id": part["doc_id"], "text": kept})

    found = one_text(docs).join(gone, "doc_id")
    return found.mapInPandas(solid(run), "doc_id long, text string")
