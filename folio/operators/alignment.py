"""Alignment of page sequences and word differences, one document or page pair at a time inside tasks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.compare import TOKENS, normal_pages
from folio.operators.images import INK_SPREAD, RELIABLE, W_ASPECT, W_HASH, W_INK, W_TEXT, W_VISUAL

# fixed values of the alignment: cost of a gap, gain and cost of a match, similarity from which pages are the same
GAP, GAIN, COST, SAME = -0.55, 2.0, 1.3, 0.96
#: Pages of the right side that are compared at once.
COLUMNS = 2048
#: Cells of an alignment, and bits of a comparison of words, that are held at once.
CELLS, BITS = 4_000_000, 1 << 28
#: Up to so many cells similarities are found, and pages aligned, without arrays, which cost more than the cells.
FEW, SMALL = 64, 2_048
#: Rows that a task gives at once.
ROWS = 10_000


def _similarities(left: list, right: list) -> np.ndarray:
    """The similarity of every page of left with every page of right."""
    place: dict[str, int] = {}
    for page in left:
        for token in page["tokens"]:
            place.setdefault(token, len(place))
    found = []
    for pages in (left, right):
        has = np.zeros((len(pages), len(place)), dtype=np.float32)
        for row, page in enumerate(pages):
            has[row, [place[t] for t in page["tokens"] if t in place]] = 1
        found.append((has, np.array([len(set(p["tokens"])) for p in pages], dtype=float), np.array([len(p["normalized"]) for p in pages], dtype=float)))
    (a, ta, na), (b, tb, nb) = found
    both = (a @ b.T).astype(float)
    either = np.maximum(ta[:, None] + tb[None, :] - both, 1)
    longer = np.maximum(na[:, None], nb[None, :])
    out = np.minimum(1.0, both / either * 0.78 + np.minimum(na[:, None], nb[None, :]) / np.maximum(longer, 1) * 0.22)
    known: dict[str, int] = {}
    number = lambda side: np.array([known.setdefault(p["normalized"], len(known)) for p in side], dtype=np.int64)
    equal = number(left)[:, None] == number(right)[None, :]
    out[(na[:, None] == 0) | (nb[None, :] == 0)] = 0.0
    out[equal & (na[:, None] >= 8)] = 1.0
    if any(p.get("visual") is not None for p in left) and any(p.get("visual") is not None for p in right):
        _mix_in_visuals(out, left, right)
    return out


def basis_of(left: dict, right: dict) -> str:
    """What two pages are compared by: text, visual, or hybrid where both have fingerprints and enough text."""
    if left.get("visual") is None or right.get("visual") is None:
        return "text"
    return "hybrid" if min(len(left["normalized"]), len(right["normalized"])) >= RELIABLE else "visual"


def _mix_in_visuals(out: np.ndarray, left: list, right: list) -> None:
    """Put the similarity of fingerprints into out, for pages that both have one."""
    rows, columns = ([i for i, p in enumerate(side) if p.get("visual") is not None] for side in (left, right))
    field = lambda side, at, name, kind: np.array([side[i]["visual"][name] for i in at], dtype=kind)
    bits = np.bitwise_count(field(left, rows, "bits", np.int64).view(np.uint64)[:, None] ^ field(right, columns, "bits", np.int64).view(np.uint64)[None, :])
    ink = np.abs(field(left, rows, "ink", float)[:, None] - field(right, columns, "ink", float)[None, :]) / INK_SPREAD
    x, y = field(left, rows, "aspect", float)[:, None], field(right, columns, "aspect", float)[None, :]
    visual = np.clip((1 - bits / 64) * W_HASH + (1 - np.minimum(1, ink)) * W_INK + np.minimum(x, y) / np.maximum(x, y) * W_ASPECT, 0, 1)
    enough = lambda side, at: np.array([len(side[i]["normalized"]) >= RELIABLE for i in at])
    sure = enough(left, rows)[:, None] & enough(right, columns)[None, :]
    here = np.ix_(rows, columns)
    out[here] = np.where(sure, np.clip(out[here] * W_TEXT + visual * W_VISUAL, 0, 1), visual)


def _page(normalized: str | None) -> dict:
    """A page with its tokens: the first TOKENS distinct words of two letters or more."""
    text = normalized or ""
    return {"normalized": text, "tokens": list(dict.fromkeys(w for w in text.split(" ") if len(w) >= 2))[:TOKENS]}


def _few_similarities(left: list, right: list) -> list[list[float]]:
    """_similarities() of few pages by their texts, by the same operations."""
    known = [(p["normalized"], len(p["normalized"]), set(p["tokens"])) for p in right]
    out = []
    for page in left:
        text, size, tokens = page["normalized"], len(page["normalized"]), set(page["tokens"])
        row = []
        for other, length, theirs in known:
            if text == other and size >= 8:
                row.append(1.0)
            elif not size or not length:
                row.append(0.0)
            else:
                both = len(tokens & theirs)
                row.append(min(1.0, both / max(len(tokens) + len(theirs) - both, 1) * 0.78 + min(size, length) / max(size, length) * 0.22))
        out.append(row)
    return out


def _align_few(alike: list[list[float]]) -> list[tuple[int | None, int | None, float, str]]:
    """align() of few pages, from their similarities, by the same operations."""
    moves, above = [], [GAP * j for j in range(len(alike[0]) + 1)]
    for i, scores in enumerate(alike, 1):
        row, came = [GAP * i], []
        for j, score in enumerate(scores):
            match, gone, new = above[j] + (score * GAIN - COST), above[j + 1] + GAP, row[j] + GAP
            move = 0 if match >= gone and match >= new else 1 if gone >= new else 2
            row.append((match, gone, new)[move])
            came.append(move)
        moves.append(came)
        above = row
    rows, i, j = [], len(alike), len(alike[0])
    while i or j:
        move = moves[i - 1][j - 1] if i and j else 1 if i else 2
        rows.append(_row(i, j, move, alike[i - 1][j - 1] if move == 0 else 0.0))
        i, j = i - (move != 2), j - (move != 1)
    return rows[::-1]


def _row(i: int, j: int, move: int, score: float) -> tuple[int | None, int | None, float, str]:
    return i if move != 2 else None, j if move != 1 else None, score, ("same" if score >= SAME else "modified") if move == 0 else ("deleted", "inserted")[move - 1]


def align(left: list, right: list) -> list[tuple[int | None, int | None, float, str]]:
    """left_page, right_page, similarity, status of the best global alignment; at equal scores a match goes before a deletion, that before an insertion.

    Scores are kept for one row in a block of rows only; the moves of a block are made again on the way back. A block has CELLS
    cells, about, so most documents are one.
    """
    if not left or not right:
        return [(i + 1, None, 0.0, "deleted") for i in range(len(left))] + [(None, j + 1, 0.0, "inserted") for j in range(len(right))]
    if len(left) * len(right) <= SMALL:
        seen = any(p.get("visual") is not None for p in left) and any(p.get("visual") is not None for p in right)
        few = len(left) * len(right) <= FEW and not seen
        return _align_few(_few_similarities(left, right) if few else _similarities(left, right).tolist())
    step = max(1, min(len(left), CELLS // len(right)))

    def block(above: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The last scores, similarities and moves of the rows from base on, one diagonal at a time: its cells need only the two before."""
        alike = np.hstack([_similarities(left[base : base + step], right[at : at + COLUMNS]) for at in range(0, len(right), COLUMNS)])
        n, m = alike.shape
        gains, came = alike * GAIN - COST, np.zeros((n, m), dtype=np.uint8)
        side = np.array([GAP * (base + i) for i in range(n + 1)])
        # scores of the cells (i, d - i) by i, of the diagonals d - 2, d - 1 and d
        older, old, last = np.empty(n + 1), np.empty(n + 1), np.empty(m + 1)
        old[0], last[0] = above[0], side[n]
        for d in range(1, n + m + 1):
            new = np.empty(n + 1)
            if d <= m:
                new[0] = above[d]
            if d <= n:
                new[d] = side[d]
            low, high = max(1, d - m), min(n, d - 1)
            if low <= high:
                i = np.arange(low, high + 1)
                choices = np.stack([older[low - 1 : high] + gains[i - 1, d - i - 1], old[low - 1 : high] + GAP, old[low : high + 1] + GAP])
                move = choices.argmax(axis=0)
                came[i - 1, d - i - 1] = move
                new[low : high + 1] = choices[move, np.arange(len(i))]
            if d >= n:
                last[d - n] = new[n]
            older, old = old, new
        return last, alike, came

    tops = [np.array([GAP * j for j in range(len(right) + 1)])]
    for base in range(0, len(left), step):
        last, alike, came = block(tops[-1], base)
        tops.append(last)
    rows, i, j = [], len(left), len(right)
    while i or j:
        if i and i - 1 < base:
            base -= step
            _, alike, came = block(tops[base // step], base)
        move = int(came[i - 1 - base, j - 1]) if i and j else 1 if i else 2
        score = float(alike[i - 1 - base, j - 1]) if move == 0 else 0.0
        rows.append(_row(i, j, move, score))
        i, j = i - (move != 2), j - (move != 1)
    return rows[::-1]


def align_sequences(left: DataFrame, right: DataFrame, cells: int | None = None) -> DataFrame:
    """doc_id, pos (from 0), left_page, right_page, similarity, status, basis (of pages that are matched) for the documents of either side.

    Pages may have a visual fingerprint, a column visual of bits, ink, aspect; those that both have one are compared by it
    too, and by it alone where either has little text.
    If cells is given, a document with more pairs of pages gets one row with status too-large and null pages, and no alignment.
    """
    seen = next((df.schema["visual"].dataType.simpleString() for df in (left, right) if "visual" in df.columns), None)
    look = lambda df: [F.col("visual") if "visual" in df.columns else F.lit(None).cast(seen).alias("visual")] if seen else []
    side = lambda df, right_: normal_pages(df).select("doc_id", F.lit(right_).alias("_right"), "page_number", "normalized", *look(df))
    # the pages of a document come in a row; a null doc_id meets no other
    rows = side(left, False).unionByName(side(right, True)).repartition("doc_id").sortWithinPartitions("doc_id", "_right", "page_number", "normalized", *(["visual"] if seen else []))
    fields = ["doc_id", "pos", "left_page", "right_page", "similarity", "status", "basis"]
    schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("left_page", pa.int32()), ("right_page", pa.int32()), ("similarity", pa.float64()), ("status", pa.string()), ("basis", pa.string())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list, list]]:
        now, sides = None, ([], [])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "_right", "normalized", *(["visual"] if seen else []))]
            for doc, right_, text, *visual in zip(*columns, strict=True):
                if (doc,) != now:
                    if now:
                        yield now[0], *sides
                    now, sides = (doc,), ([], [])
                sides[right_].append(_page(text) | ({"visual": visual[0]} if visual else {}))
        if now:
            yield now[0], *sides

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], fields)
        for doc, a, b in documents(batches):
            for x, y in [(a, b)] if doc is not None else [(side_, []) if side_ is a else ([], side_) for side_ in (a, b) if side_]:
                found = align(x, y) if cells is None or len(x) * len(y) <= cells else [(None, None, 0.0, "too-large")]
                met = lambda row: basis_of(x[row[0] - 1], y[row[1] - 1]) if row[0] and row[1] else None  # noqa: E731, B023
                rows += [(doc, pos, *row, met(row)) for pos, row in enumerate(found)]
            if len(rows) >= ROWS:
                yield batch()
                rows = []
        if rows:
            yield batch()

    return rows.select("doc_id", "_right", "normalized", *(["visual"] if seen else [])).mapInArrow(run, "doc_id long, pos int, left_page int, right_page int, similarity double, status string, basis string")


def alignment_summary(rows: DataFrame) -> DataFrame:
    """doc_id, a count for each status, changed, first_changed (its pos) of align_sequences()."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("same", "modified", "inserted", "deleted")]
    changed = F.col("status") != "same"
    return rows.groupBy("doc_id").agg(*counts, F.count_if(changed).alias("changed"), F.min(F.when(changed, F.col("pos"))).alias("first_changed"))


def word_changes(left: list[str], right: list[str]) -> list[tuple[str, str]]:
    """(same, removed or added; word) along a longest common subsequence; read from the end, additions come first at equal length."""
    tail = 0
    while tail < min(len(left), len(right)) and left[-1 - tail] == right[-1 - tail]:
        tail += 1
    a, b = left[: len(left) - tail], right[: len(right) - tail]
    # bit j of a row is 0 where the longest length grows at word j of the right side; a row follows from the one above in one addition
    places: dict[str, list[int]] = {}
    for j, word in enumerate(b):
        places.setdefault(word, []).append(j)
    every, masks = (1 << len(b)) - 1, {}

    def mask(word: str) -> int:
        if word not in masks:
            raw = bytearray(len(b) // 8 + 1)
            for j in places.get(word, ()):
                raw[j >> 3] |= 1 << (j & 7)
            if len(b) * (len(masks) + 1) > BITS:
                masks.clear()
            masks[word] = int.from_bytes(raw, "little")
        return masks[word]

    step = max(1, min(len(a), BITS // max(1, len(b))), math.isqrt(len(a)))

    def block(row: int, base: int) -> list[int]:
        """The rows from base on."""
        rows = []
        for word in a[base : base + step]:
            hit = row & mask(word)
            row = ((row + hit) | (row - hit)) & every
            rows.append(row)
        return rows

    tops, base, rows = [every], 0, []
    for base in range(0, len(a), step):
        rows = block(tops[-1], base)
        tops.append(rows[-1])
    out, i, j = [("same", w) for w in reversed(left[len(a) :])], len(a), len(b)
    while i or j:
        if i and i - 1 < base:
            base -= step
            rows = block(tops[base // step], base)
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(("same", a[i]))
        elif not i or (j and rows[i - 1 - base] >> (j - 1) & 1):  # no growth here: without this word of the right side nothing is lost
            j -= 1
            out.append(("added", b[j]))
        else:
            i -= 1
            out.append(("removed", a[i]))
    return out[::-1]


def diff_words(pairs: DataFrame, limit: int | None = 600) -> DataFrame:
    """doc_id, page_number, pos, kind, text of pairs(doc_id, page_number, left, right): words and the white space between, the first limit of each side (None: all); null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lambda text: [w for w in re.split(r"(\s+)", text or "") if w][:limit]
        names = ["doc_id", "page_number", "pos", "kind", "text"]

        def table(docs: list, pages: list, sizes: list, changes: list) -> pa.RecordBatch:
            kinds, texts = zip(*changes, strict=True)
            page = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            pos = np.arange(len(changes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            columns = [pa.array(docs, pa.int64()).take(page), pa.array(pages, pa.int32()).take(page), pa.array(pos, pa.int32()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            docs, pages, sizes, changes = [], [], [], []
            for d, p, a, b in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "page_number", "left", "right")), strict=True):
                found = word_changes(words(a), words(b))
                docs.append(d)
                pages.append(p)
                sizes.append(len(found))
                changes += found
                if len(changes) >= 50_000:  # a batch of pages has millions of words
                    yield table(docs, pages, sizes, changes)
                    docs, pages, sizes, changes = [], [], [], []
            if changes:
                yield table(docs, pages, sizes, changes)

    return pairs.select("doc_id", "page_number", "left", "right").mapInArrow(run, "doc_id long, page_number int, pos int, kind string, text string")
