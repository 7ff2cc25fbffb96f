"""Suffix-array dedup: bytes covered by long strings that occur elsewhere (operator 7).

1. Every window of MIN_LENGTH bytes is named by its anchor, the least hash of the 32-byte strings in it, so
   equal windows have equal anchors. Runs of windows with one anchor are pieces of about 280 bytes.
2. Pieces whose anchor occurs once hold nothing that repeats. The others are dealt out by anchor; a task lays
   pieces side by side, sorts their windows in suffix order by prefix doubling, finds for each the previous
   and next smaller position in that order, and from them the longest previous factor. A factor of MIN_LENGTH
   is a later copy; the window beside it in suffix order is the earlier one.
3. Pieces of an anchor with very many bytes are not gathered. Their windows are split by the place of the
   anchor into ever smaller spans; spans whose common bytes occur once are dropped, spans whose bytes occur
   in whole at several places are settled, only what lies between goes on to the next, smaller width. Both
   are counts by digest, so no group of pieces has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, in_slices, meet, solid, written
from .near import mixed

MIN_LENGTH, GRAM = 200, 32
#: An anchor with more bytes of pieces is hot; LONGEST is the most windows of a piece.
HOT_BYTES, LONGEST = 1_000_000, 4_096
SLICE, BATCH = 1_000_000, 1_500_000
#: Widths of the spans of windows of a hot anchor, by the anchor's place.
WIDTHS = (43, 11, 3, 1)
_POSITION = np.uint64((1 << 20) - 1)
_draw = np.random.default_rng(77)
_BYTES = _draw.integers(0, 1 << 63, 256, dtype=np.uint64)
_STEPS = [np.uint64(x | 1) for x in _draw.integers(0, 1 << 62, 8).tolist()]
RUNS = "array<struct<a:int,b:int>>"
ROW = ["ra", "rb"]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the 32 bytes at every position, by doubling."""
    h, size, step = _BYTES[data], 1, 0
    while size < gram:
        h = h[:-size] * _STEPS[step] + h[size:]
        size, step = size * 2, step + 1
    return mixed(h)


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first and last window start, and places of the key of every run of windows with one anchor; windows stay inside the texts that end at ends."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none
    h = gram_hashes(data, GRAM)
    least = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    width, size = length - GRAM + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    n = len(data) - length + 1
    least = np.minimum(least[:n], least[width - size : width - size + n])
    at = (least & _POSITION).astype(np.int64)
    key = h[at]
    inside = np.ones(n, dtype=bool)
    for end in ends[:-1].tolist():
        inside[max(0, end - length + 1) : end] = False
    new = np.concatenate([[True], (key[1:] != key[:-1]) | ~inside[:-1]]) & inside
    starts = np.flatnonzero(new)
    stops = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    if len(starts) and (stops - starts).max() >= LONGEST:  # a text that repeats itself closely has one long run
        new[np.concatenate([np.arange(a, b + 1, LONGEST) for a, b in zip(starts, stops, strict=True)])] = True
        starts = np.flatnonzero(new)
        stops = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    moved = np.concatenate([[0], np.cumsum(at[1:] != at[:-1])])
    return key[starts].view(np.int64), starts, stops, moved[stops] - moved[starts] + 1


def _find(length: int):
    """ra, rb, key, lo, hi, n of every run of windows; long texts in overlapping slices, short ones together."""

    def many(rows: list[tuple[int, int, int, bytes]]) -> pd.DataFrame:
        ends = np.cumsum([len(raw) for *_, raw in rows])
        key, lo, hi, n = anchors(np.frombuffer(b"".join(raw for *_, raw in rows), dtype=np.uint8), ends, length)
        own = np.searchsorted(ends, lo, side="right")
        shift = np.array([at for *_, at, _ in rows]) - np.concatenate([[0], ends[:-1]])
        names = {c: np.array([row[i] for row in rows])[own] for i, c in enumerate(ROW)}
        return pd.DataFrame({**names, "key": key, "lo": (lo + shift[own]).astype(np.int32), "hi": (hi + shift[own]).astype(np.int32), "n": n.astype(np.int32)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held, size = [], 0
            for ra, rb, raw in zip(frame["ra"], frame["rb"], frame["raw"], strict=True):
                if raw is None or len(raw) < length:
                    continue
                for at in range(0, len(raw) - length + 1, SLICE):
                    part = raw[at : at + SLICE + length - 1]
                    if held and size + len(part) > SLICE + length:
                        yield many(held)
                        held, size = [], 0
                    held.append((ra, rb, at, part))
                    size += len(part)
            if held:
                yield many(held)

    return run


def _cut(length: int):
    """The bytes of the wanted runs of every text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_slices(frames, "raw"):
            rows = [
                (ra, rb, doc, int(r["lo"]), r["key"], r["hot"], raw[r["lo"] : r["hi"] + length])
                for ra, rb, doc, raw, runs in zip(part["ra"], part["rb"], part["doc_id"], part["raw"], part["runs"], strict=True)
                for r in runs
            ]
            yield pd.DataFrame(rows, columns=[*ROW, "doc_id", "lo", "key", "hot", "piece"]).astype({"doc_id": "Int64"})

    return run


def _ranked(keys: np.ndarray) -> np.ndarray:
    """The dense rank of every key."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    ranks = np.empty(len(keys), dtype=np.uint32)
    ranks[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
    return ranks


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """starts in suffix order by their first `length` bytes, equal ones by position, and the bytes (at most `length`) each shares with the one before (the first: 0).

    Ranks of the first 8, 16, 32, ... bytes of all positions, each from pairs of the ranks before; the last
    pair overlaps so that it ends at `length`.
    """
    padded = np.concatenate([data, np.zeros(length + 8, dtype=np.uint8)]).astype(np.uint64)
    n = len(data) + length
    packed = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        packed |= padded[i : i + n] << np.uint64(56 - 8 * i)
    levels, width = [(8, _ranked(packed))], 8
    while width * 2 <= length:
        last = levels[-1][1].astype(np.uint64)
        levels.append((width * 2, _ranked(last[: len(last) - width] << np.uint64(32) | last[width:])))
        width *= 2
    last = levels[-1][1].astype(np.uint64)
    keys = last[starts] << np.uint64(32) | last[starts + length - width]
    by_place = np.argsort(keys, kind="stable")
    order = starts[by_place]
    shared = np.zeros(len(order), dtype=np.int64)
    a, b = order[:-1], order[1:]
    for size, ranks in reversed(levels):
        at = shared[1:]
        some = np.flatnonzero(at + size <= length)
        at[some[ranks[a[some] + at[some]] == ranks[b[some] + at[some]]]] += size
    # fewer than 8 bytes are left to compare
    left = packed[a + shared[1:]] ^ packed[b + shared[1:]]
    more = np.full(len(left), 8, dtype=np.int64)
    for k in range(8):
        more = np.where((more == 8) & (left >> np.uint64(56 - 8 * k) != 0), k, more)
    shared[1:] = np.minimum(shared[1:] + more, length)
    return order, shared


#: Rounds of plain jumps, and positions that a minimum of the next level covers.
JUMPS, FAN = 12, 16


def _smaller_before(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each place of the order the bytes it shares with the nearest place before it of a smaller position; 0 if there is none.

    Pointers jump over larger positions, all at once, and carry the least of the shared bytes they pass. Those that are on
    their way after JUMPS rounds climb levels of minima, so no order takes more than some FAN steps a level.
    """
    n = len(order)
    before, least = np.arange(-1, n - 1), shared.copy()
    open_ = np.flatnonzero(before >= 0)
    open_ = open_[order[before[open_]] > order[open_]]
    for _ in range(JUMPS):
        there = before[open_]
        least[open_], before[open_] = np.minimum(least[open_], least[there]), before[there]
        open_ = open_[before[open_] >= 0]
        open_ = open_[order[before[open_]] > order[open_]]
    if len(open_):
        _climb(order, shared, before, least, open_)
    least[before < 0] = 0
    return least


def _climb(order: np.ndarray, shared: np.ndarray, before: np.ndarray, least: np.ndarray, open_: np.ndarray) -> int:
    """Finish the places that are open: before and least are changed. The number of steps is returned."""
    sums = [(order.astype(np.int64), shared.astype(np.int64))]
    while len(sums[-1][0]) > 1:
        pad = -len(sums[-1][0]) % FAN
        sums.append(tuple(np.pad(level, (0, pad), constant_values=np.iinfo(np.int64).max).reshape(-1, FAN).min(axis=1) for level in sums[-1]))
    begin = np.cumsum([0, *(len(o) for o, _ in sums)])
    lowest, passed = (np.concatenate([level[k] for level in sums]) for k in (0, 1))
    at, level, own, low, steps = before[open_].copy(), np.zeros(len(open_), dtype=np.int64), order[open_], least[open_], 0
    while len(open_):
        steps += 1
        here = begin[level] + at
        down = lowest[here] < own
        found = down & (level == 0)
        # past a whole block: to the one before it, or up where it is the first of its parent's
        low = np.where(down, low, np.minimum(low, passed[here]))
        up = ~down & (at % FAN == 0)
        at = np.where(down, at * FAN + FAN - 1, np.where(up, at // FAN - 1, at - 1))
        level = level + up - down
        over = found | (at < 0)
        before[open_[over]], least[open_[over]] = np.where(found[over], 0, -1), low[over]
        stay = ~over
        open_, at, level, own, low = open_[stay], at[stay], level[stay], own[stay], low[stay]
        # the last block of a level may be short
        at = np.minimum(at, begin[level + 1] - begin[level] - 1)
    return steps


def previous_factors(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The longest previous factor of each place of the order: the bytes it shares with any suffix of a smaller position, read off the previous and next smaller ones."""
    back = np.concatenate([[0], shared[:0:-1]])
    return np.maximum(_smaller_before(order, shared), _smaller_before(order[::-1], back)[::-1])


def repeats(pieces: list[bytes], copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces in order of first occurrence: where each begins in their concatenation, which window starts repeat anywhere, and which repeat earlier bytes."""
    sizes = np.array([len(p) for p in pieces])
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(pieces)), sizes)
    starts = np.flatnonzero(np.arange(sizes.sum()) + length <= (begins + sizes)[owner])
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    order, shared = suffix_order(data, starts, length)
    later = previous_factors(order, shared) >= length
    anywhere, earlier = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    earlier[order[later]] = True
    anywhere[order[later]] = True
    anywhere[order[:-1][later[1:] & (shared[1:] >= length)]] = True
    anywhere[starts[copies[owner[starts]] > 1]] = True
    return begins, anywhere, earlier


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _settle(length: int):
    """Rows arrive sorted by key: settle all pieces of a key, several keys at a time."""

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "lo"], kind="stable", na_position="first")
        pieces = rows["piece"].tolist()
        begins, anywhere, earlier = repeats(pieces, rows["copies"].to_numpy(), length)
        cut = [slice(b, b + len(p)) for b, p in zip(begins, pieces, strict=True)]
        out = rows[["key", "pa", "pb", "copies", "doc_id", "lo"]].assign(runs=[_runs(anywhere[c]) for c in cut], later=[_runs(earlier[c]) for c in cut])
        return out[out["runs"].map(len) > 0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, size, last = [], 0, None
        for frame in frames:
            if not len(frame):
                continue
            new = (frame["key"] != frame["key"].shift()).to_numpy()
            new[0] = last != frame["key"].iloc[0]
            last = frame["key"].iloc[-1]
            at, sizes = 0, frame["piece"].str.len().to_numpy()
            for i in range(len(frame)):
                if new[i] and size and size + sizes[i] > BATCH:
                    yield done(pd.concat([*rest, frame.iloc[at:i]], ignore_index=True))
                    rest, size, at = [], 0, i
                size += sizes[i]
            rest.append(frame.iloc[at:])
        if rest:
            yield done(pd.concat(rest, ignore_index=True))

    return run


def _digest(*parts: bytes) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(b"".join(parts))
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


SPANS = "key long, pa long, pb long, doc_id long, at int, a int, b int, c1 long, c2 long, h1 long, h2 long"


def _spans(length: int, width: int):
    """The spans of windows a to b of each piece of a hot anchor, with the digest c of the bytes that all windows of such a span have in common and h of those of this one.

    A span holds windows with the anchor at one of `width` neighbouring places. Windows before a place of the
    anchor and after the one before it belong to that place.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, pa, pb, doc, lo, piece, parts in frame[["key", "pa", "pb", "doc_id", "lo", "piece", "parts"]].itertuples(index=False):
                last = len(piece) - length
                at = np.flatnonzero(gram_hashes(np.frombuffer(piece, dtype=np.uint8), GRAM).view(np.int64) == key)
                for first, stop in [(0, last)] if parts is None else [(p["a"], p["b"]) for p in parts]:
                    a = first
                    while a <= stop:
                        q = int(at[np.searchsorted(at, a)])
                        node = (q - a) // width
                        b = min(stop, q - node * width)
                        near, far = node * width, min(node * width + width - 1, length - GRAM)
                        name = near.to_bytes(4, "little")
                        c = _digest(name, piece[q - near : q - far + length])
                        h = _digest(name, (q - a).to_bytes(4, "little"), (q - b).to_bytes(4, "little"), piece[a : b + length])
                        out.append((key, pa, pb, doc, lo + a, a, b, *c, *h))
                        a = b + 1
            yield pd.DataFrame(out, columns=["key", "pa", "pb", "doc_id", "at", "a", "b", "c1", "c2", "h1", "h2"]).astype({"doc_id": "Int64", "at": "int32", "a": "int32", "b": "int32"})

    return run


def _hot(pieces: DataFrame, length: int) -> DataFrame:
    """key, pa, pb, runs, later of the different pieces of hot anchors."""
    places = ["key", "pa", "pb", "doc_id", "lo", "piece"]
    rows, found = pieces.select(*places, F.lit(None).cast(RUNS).alias("parts")), []
    for width in WIDTHS:
        spans = written(rows.mapInPandas(solid(_spans(length, width)), SPANS))
        place = F.struct("doc_id", "at", "pa", "pb", "key", "a", "b")
        whole = written(spans.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.first("c1").alias("c1"), F.first("c2").alias("c2")))
        own = meet(spans.select("h1", "h2", place.alias("place")), whole.where("n > 1").select("h1", "h2", "n", "first"), ["h1", "h2"], "n")
        found.append(written(own.select("place.key", "place.pa", "place.pb", "place.a", "place.b", (F.col("place") != F.col("first")).alias("late"))))
        if width > 1:
            # one span of each kind goes on, if others have its common bytes
            kinds = written(whole.groupBy("c1", "c2").agg(F.count("*").alias("kinds")).where("kinds > 1"))
            on = meet(whole.select("c1", "c2", "first"), kinds, ["c1", "c2"], "kinds").select("first.*")
            parts = written(on.groupBy("key", "pa", "pb").agg(F.collect_list(F.struct("a", "b")).alias("parts")))
            dropped(spans, whole, kinds)
            rows = pieces.select(places).join(parts, ["key", "pa", "pb"])
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    run = F.struct("a", "b")
    return every.groupBy("key", "pa", "pb").agg(F.collect_list(run).alias("runs"), F.collect_list(F.when(F.col("late"), run)).alias("later"))


def repeated_spans(docs: DataFrame, length: int = MIN_LENGTH, keep: str = "none", hot_bytes: int = HOT_BYTES) -> DataFrame:
    """ra, rb, spans: byte ranges [start, end) to remove from the rows of docs(ra, rb, doc_id, raw)."""
    found = written(docs.select(*ROW, "raw").mapInPandas(solid(_find(length)), "ra long, rb long, key long, lo int, hi int, n int"))
    size = F.col("hi") - F.col("lo") + length
    used = found.groupBy("key").agg(F.sum("n").alias("_uses"), F.count("*").alias("_rows"), F.sum(size).alias("_bytes")).where("_uses > 1")
    used = written(used.select("key", "_rows", (F.col("_bytes") > hot_bytes).alias("hot")))
    wanted = meet(found.select(*ROW, "key", "lo", "hi"), used, ["key"], "_rows").groupBy(ROW).agg(F.collect_set(F.struct("lo", "hi", "key", "hot")).alias("runs"))
    cut = docs.join(wanted, ROW).select(*ROW, "doc_id", "raw", "runs").mapInPandas(solid(_cut(length)), "ra long, rb long, doc_id long, lo int, key long, hot boolean, piece binary")
    pieces = written(cut.withColumns({"pa": F.xxhash64("piece"), "pb": F.xxhash64(F.lit(3), "piece")}))
    dropped(found, used)
    first = F.min(F.struct("doc_id", "lo"))
    unique = pieces.groupBy("key", "pa", "pb", "hot").agg(F.count("*").alias("copies"), first.alias("_first"), F.any_value("piece").alias("piece"))
    unique = written(unique.select("key", "pa", "pb", "hot", "copies", "_first.doc_id", "_first.lo", "piece"))
    cool = unique.where("not hot").drop("hot").repartition("key").sortWithinPartitions("key")
    place = ["key", "pa", "pb", "copies", "doc_id", "lo"]
    settled = cool.mapInPandas(solid(_settle(length)), f"key long, pa long, pb long, copies long, doc_id long, lo int, runs {RUNS}, later {RUNS}")
    hot = unique.where("hot")
    if not hot.isEmpty():
        # a piece that stands at several places repeats as a whole
        several = F.array(F.struct(F.lit(0).alias("a"), (F.length("piece") - length).alias("b")))
        copied = hot.where("copies > 1").select("key", "pa", "pb", several.alias("runs"), F.array().cast(RUNS).alias("later"))
        parts = _hot(hot, length).unionByName(copied).groupBy("key", "pa", "pb").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("runs", "later")))
        settled = settled.unionByName(hot.select(place).join(parts, ["key", "pa", "pb"]))
    settled = written(settled.withColumnsRenamed({"doc_id": "_doc", "lo": "_lo"}))
    dropped(unique)
    own = meet(pieces.select(*ROW, "doc_id", "lo", "key", "pa", "pb", F.length("piece").alias("size")), settled, ["key", "pa", "pb"], "copies")
    if keep == "first":
        whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("size") - length).alias("b")))
        is_first = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("lo") == F.col("_lo"))
        own = own.withColumn("runs", F.when(is_first, F.col("later")).otherwise(whole))
    spans = F.transform("runs", lambda r: F.struct((F.col("lo") + r["a"]).alias("start"), (F.col("lo") + r["b"] + length).alias("end")))
    found = written(own.select(*ROW, spans.alias("_spans")).groupBy(ROW).agg(F.flatten(F.collect_list("_spans")).alias("spans")))
    dropped(pieces, settled)
    return found


def suffix_dedup(docs: DataFrame, length: int = MIN_LENGTH, keep: str = "none", hot_bytes: int = HOT_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) for every row.

    A byte goes when a string of `length` bytes that covers it also starts anywhere else, in this text or
    another (keep="none"), or starts earlier by (doc_id, position) (keep="first"). Strings never cross texts
    and are judged on the input. Null texts are empty. Texts shorter than `length` lose nothing; a very long
    one is cut into slices, and into pieces of LONGEST windows at most. Rows that repeat a doc_id and text are
    copies of each other, and lose what any copy loses; for keep="first" they count as one place. A null
    doc_id comes before all others. Other columns are ignored; an empty table gives no rows. Rows are known
    by two 64-bit digests of (doc_id, text), windows of hot anchors by one of 128 bits.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("ra"), F.xxhash64(F.lit(11), "text", "doc_id").alias("rb"), F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"))
    spans = repeated_spans(rows, length, keep, hot_bytes)

    def remove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_slices(frames, "raw"):
            made = []
            for raw, own in zip(part["raw"], part["spans"], strict=True):
                if own is None or not len(own):
                    made.append((len(raw), 0, 0, raw))
                    continue
                merged: list[list[int]] = []
                for start, end in sorted((s["start"], s["end"]) for s in own):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                stays = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in merged)], [*(s for s, _ in merged), len(raw)], strict=True))
                made.append((len(raw), len(raw) - len(stays), len(merged), stays))
            names = ["n_bytes", "n_removed", "n_spans", "kept"]
            yield pd.concat([part[["doc_id"]].reset_index(drop=True).astype("Int64"), pd.DataFrame(made, columns=names)], axis=1)

    joined = rows.join(spans, ROW, "left").select("doc_id", "raw", "spans")
    return joined.mapInPandas(solid(remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
