"""Groups of units whose sets of word shingles are similar, exactly verified (used by operators 3 and 6).

1. Every unit gets its set's size, a 128-bit digest of the set, and the keys of its MinHash bands.
   Units with equal sets become one node.
2. Each band bucket names a hub, the member whose buckets are fullest; every other member is paired
   with the hub. Copies of one original are joined by it in this step.
3. A hub's spokes are dealt out in blocks, each with the hub's set: an odd-sketch filter, then the full
   sets are compared; links give components.
4. Buckets that still hold several components pair every member outside the hub's component with all
   members of other components: small buckets by a self join, larger ones in blocks of bounded size by
   sketch. These pairs are verified in the same way, so no pair that shares a bucket is left out, while
   pairs inside a component are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, in_slices, meet, solid, written
from .components import components

SKETCH_BITS = 2048
SAMPLE_BINS = 1024
SMALL_BUCKET = 24
#: The bands are worked through in so many parts.
CHUNKS = 4
BLOCK = 512

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_draw = np.random.default_rng(20240229)
_BYTE = _draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_MULTIPLIERS = _draw.integers(0, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each maximal run of non-space bytes, and where it begins."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    solid = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(data) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each maximal run of non-space bytes."""
    return _hashed(raw)[0]


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, 1 << 16)
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _tables["up"], _tables["down"]


def placed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Hashes of the words of all texts, ASCII letters in lower case, the number of the text of each, its first byte in the texts joined by line ends, these, and the first byte of each text."""
    raws = [t.encode("utf-8", "replace").translate(_LOWER) if isinstance(t, str) else b"" for t in texts]
    raw = b"\n".join(raws)
    w, starts = _hashed(raw)
    offsets = np.cumsum([0, *(len(r) + 1 for r in raws[:-1])])
    return w, np.searchsorted(offsets, starts, side="right") - 1, starts, raw, offsets


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, ASCII letters in lower case, and the number of the text of each."""
    return placed_words(texts)[:2]


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text, one text after the other, and their numbers; a shorter text's whole word sequence is its one shingle."""
    w, owner = words_of(texts)
    many = np.bincount(owner, minlength=len(texts)) if len(w) else np.zeros(len(texts), dtype=np.int64)
    first = np.cumsum(many) - many
    hashes, owners = [], []
    for k in range(1, words + 1):
        if k == words:
            at = np.flatnonzero(owner[: len(w) - k + 1] == owner[k - 1 :]) if len(w) >= k else np.zeros(0, dtype=np.int64)
        else:
            at = first[many == k]
        out = w[at]
        for i in range(1, k):
            out = mixed(out * np.uint64(0xD1342543DE82EF95) + w[at + i])
        hashes.append(out + np.uint64(k))
        owners.append(owner[at])
    h, own = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(h)
    if len(texts) > 1:
        order = order[np.argsort(own[order].astype(np.uint16 if len(texts) < 1 << 16 else np.int64), kind="stable")]
    h, own = h[order], own[order]
    if len(h):
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])])
        h, own = h[fresh], own[fresh]
    return h, np.bincount(own, minlength=len(texts))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of one text."""
    return shingle_sets([text], words)[0]


def bands_for(threshold: float, loss: float = 1e-6, rows: int | None = None) -> tuple[int, int]:
    """Bands and rows of MinHash that lose a pair at the threshold with at most this probability; rows, if not given, are such that two pairs in five at the threshold share a band."""
    rows = rows or (max(1, round(np.log(0.42) / np.log(threshold))) if threshold < 1 else 8)
    return max(1, int(np.ceil(np.log(loss) / np.log1p(-min(threshold**rows, 1 - 1e-12))))), rows


def band_keys(every: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """len(starts) x bands keys of MinHash bands of the sets that begin at starts; none is empty."""
    keys = np.empty((len(starts), bands), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(starts), band + 1, dtype=np.uint64)
        for row in range(rows):
            least = np.minimum.reduceat(every * _MULTIPLIERS[band * rows + row], starts)
            key = mixed(key * np.uint64(0xD1342543DE82EF95) + least)
        keys[:, band] = key
    return keys.view(np.int64)


def odd_sketch(hashes: np.ndarray) -> bytes:
    """One-permutation MinHash samples (the smallest hash of each bin) folded into a parity bitmap, then the bitmap of used bins."""
    bins = ((hashes * np.uint64(0xA24BAED4963EE407)) >> np.uint64(54)).astype(np.int64)
    used, first = np.unique(bins, return_index=True)  # hashes are sorted: the first of a bin is its smallest
    places = mixed(hashes[first] ^ (used.astype(np.uint64) * np.uint64(_BASE))) >> np.uint64(53)
    parity = (np.bincount(places.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(bool)
    occupied = np.zeros(SAMPLE_BINS, dtype=bool)
    occupied[used] = True
    return np.packbits(parity).tobytes() + np.packbits(occupied).tobytes()


def sketch_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of sketches as uint64 words."""
    cut = SKETCH_BITS // 64
    odd = np.bitwise_count(a[..., :cut] ^ b[..., :cut]).sum(-1, dtype=np.int64)
    differ = -SKETCH_BITS / 2 * np.log(np.maximum(1 - 2 * odd / SKETCH_BITS, 1e-3))
    size = np.bitwise_count(a[..., cut:]).sum(-1, dtype=np.int64) + np.bitwise_count(b[..., cut:]).sum(-1, dtype=np.int64)
    bins = np.bitwise_count(a[..., cut:] | b[..., cut:]).sum(-1, dtype=np.int64)
    return (size - differ) / 2 / np.maximum(bins, 1)


def least_estimate(threshold: float, bins: np.ndarray) -> np.ndarray:
    """Estimates below this are safe to drop: the threshold less five standard errors of a sample of so many bins, and the folding's."""
    return threshold - 0.03 - 0.05 * np.minimum(1.0, bins / SAMPLE_BINS)


def _words(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint64).reshape(len(column), -1)


def signatures(units: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """unit_id, n (set size), sig_a, sig_b (digest of the set), keys; null and empty texts have n = 0 and no keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_slices(frames, "text", _STEP):
            every, n = shingle_sets(part["text"].tolist(), words)
            full = np.flatnonzero(n)
            a, b, keys = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64), [None] * len(n)
            if len(full):
                starts = (np.cumsum(n) - n)[full]
                a[full] = np.add.reduceat(every, starts).view(np.int64)
                b[full] = np.add.reduceat(mixed(every ^ np.uint64(0x5851F42D4C957F2D)), starts).view(np.int64)
                for i, row in zip(full.tolist(), band_keys(every, starts, bands, rows), strict=True):
                    keys[i] = row
            yield pd.DataFrame({"unit_id": part["unit_id"].to_numpy(), "n": n, "sig_a": a, "sig_b": b, "keys": keys})

    return units.select("unit_id", "text").mapInPandas(solid(run), "unit_id long, n long, sig_a long, sig_b long, keys array<long>")


def _sets(units: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, n, sketch, members of the nodes wanted(id, sig_a, sig_b, least), from the text of their smallest unit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_slices(frames, "text", _STEP):
            every, n = shingle_sets(part["text"].tolist(), words)
            sets = np.split(every, np.cumsum(n)[:-1])
            sums = [(int(s.sum(dtype=np.uint64).view(np.int64)), int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))) for s in sets]
            yield pd.DataFrame({"sig_a": [a for a, _ in sums], "sig_b": [b for _, b in sums], "n": n, "sketch": [odd_sketch(s) for s in sets], "members": [s.tobytes() for s in sets]})

    # shuffled at every size, as it must be for large tables
    some = units.join(wanted.select(F.col("least").alias("unit_id")).hint("merge"), "unit_id", "left_semi")
    made = some.select("unit_id", "text").mapInPandas(solid(run), "sig_a long, sig_b long, n long, sketch binary, members binary")
    # a unit_id may come with several texts, and a text several times
    return made.join(wanted.select("id", "sig_a", "sig_b"), ["sig_a", "sig_b"]).select("id", "n", "sketch", "members").dropDuplicates(["id"])


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (spoke, hub) whose full sets have den * intersection >= num * union, as (a, b).

    Blocks of a hub's spokes meet in a task, each block with the hub's set once.
    """

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, own, hub = None, None, None
        for frame in frames:  # sorted by (hub, block), the hub's own row first
            good = []
            for at, block, n, sketch, members in frame[["hub", "block", "n", "sketch", "members"]].itertuples(index=False):
                if (at, block) != held:
                    held, own, hub = (at, block), np.frombuffer(sketch, dtype=np.uint64), np.frombuffer(members, dtype=np.uint64)
                    good.append(False)
                    continue
                near = sketch_similarity(np.frombuffer(sketch, dtype=np.uint64), own) >= least_estimate(num / den, np.minimum(n, len(hub)))
                both = n + len(hub) - len(np.union1d(np.frombuffer(members, dtype=np.uint64), hub)) if near else 0
                good.append(den * both >= num * (n + len(hub) - both))
            yield frame.loc[np.array(good, dtype=bool), ["spoke", "hub"]].rename(columns={"spoke": "a", "hub": "b"})

    pairs = written(pairs.select("spoke", "hub").distinct())
    hubs = written(pairs.groupBy("hub").agg(F.count("*").alias("spokes")).withColumn("blocks", F.ceil(F.col("spokes") / BLOCK).cast("int")))
    own = sets.join(hubs, sets["id"] == hubs["hub"]).select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("spoke"), "n", "sketch", "members")
    size = hubs.join(sets.select(F.col("id").alias("hub"), F.col("n").alias("n_hub")), "hub")
    dealt = meet(pairs, written(size), ["hub"], "spokes").withColumn("block", F.pmod(F.xxhash64("spoke"), F.col("blocks")).cast("int"))
    dealt = dealt.join(sets.withColumnRenamed("id", "spoke"), "spoke").where(f"{den} * least(n, n_hub) >= {num} * greatest(n, n_hub)")
    rows = own.unionByName(dealt.select(own.columns)).repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("spoke").asc_nulls_first())
    return rows.mapInPandas(solid(compare), "a long, b long")


def _blocked(frames: Iterator[pd.DataFrame], num: int, den: int) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by (key, mb, rb): links of each block's residual rows with its members, one for each two components that meet.

    Members that the sketches do not rule out are compared by their full sets, the likeliest first, unless the two
    components have been linked in this block already.
    """

    def links(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["left_side"]], group[~group["left_side"]]
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            x, y = _words(left["sketch"]), _words(right["sketch"])
            ids, comps, n = right["id"].to_numpy(), right["comp"].tolist(), right["n"].to_numpy()
            sets = [np.frombuffer(m, dtype=np.uint64) for m in right["members"]]
            for i, (own, comp, size, members) in enumerate(zip(left["id"], left["comp"], left["n"], left["members"], strict=True)):
                mine, alike = np.frombuffer(members, dtype=np.uint64), sketch_similarity(x[i][None, :], y)
                may = (alike >= least_estimate(num / den, np.minimum(n, size))) & (den * np.minimum(n, size) >= num * np.maximum(n, size))
                for j in np.flatnonzero(may)[np.argsort(-alike[may], kind="stable")].tolist():
                    a, b = find(comp), find(comps[j])
                    if a == b:
                        continue
                    both = len(mine) + len(sets[j]) - len(np.union1d(mine, sets[j]))
                    if den * both >= num * (len(mine) + len(sets[j]) - both):
                        root[b] = a
                        found.append((int(own), int(ids[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    for group in sorted_groups(frames, ["key", "mb", "rb"]):
        yield links(group)


def sorted_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that arrive sorted by keys."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if len(frame):
            last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1)
            for _, group in frame[~last].groupby(keys, sort=False):
                yield group
            rest = frame[last]
    if rest is not None and len(rest):
        yield rest


def near_groups(units: DataFrame, words: int = 5, num: int = 80, den: int = 100, loss: float = 1e-6, rows: int | None = None) -> DataFrame:
    """unit_id, n, group_id for every row of units(unit_id, text).

    group_id is the smallest unit_id that links reach. Rows without words or with a null unit_id have their
    own id. Rows that repeat a unit_id are one unit, linked by all their texts. A pair at the threshold is
    overlooked with a probability of `loss` at most.
    """
    bands, rows = bands_for(num / den, loss, rows)
    units = units.select("unit_id", "text")
    signed = written(signatures(units, words, bands, rows))
    real = signed.where("n > 0 and unit_id is not null")
    kinds = real.groupBy("sig_a", "sig_b").agg(F.count("*").alias("units"), F.min("unit_id").alias("least"), F.first("keys").alias("keys"))
    nodes = written(kinds.withColumn("id", F.monotonically_increasing_id()))
    slim = written(signed.drop("keys"))
    dropped(signed)
    signed, real = slim, slim.where("n > 0 and unit_id is not null")
    # a few bands at a time, so that the keys of all bands are never on disk at once
    count, step, members = nodes.count(), -(-bands // CHUNKS), None
    for at in range(0, bands, step):
        banded = nodes.select("id", F.explode(F.slice("keys", at + 1, step)).alias("key"))
        shared = written(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
        found = written(meet(banded, shared, ["key"], "size", count * step))
        members = found if members is None else members.unionByName(found)
        dropped(shared)
    weights = members.groupBy("id").agg(F.sum("size").alias("weight"))
    hubs = members.join(weights, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top"), F.max("size").alias("size"))
    hubs = written(hubs.select("key", "size", (-F.col("top.minus")).alias("hub")))
    pairs = meet(members.select("key", "id"), hubs, ["key"], "size").where("id <> hub").select(F.col("id").alias("spoke"), "hub")

    wanted = written(nodes.join(weights.select("id"), "id", "left_semi").select("id", "sig_a", "sig_b", "least"))
    sets = written(_sets(units, wanted, words))
    links = written(_verified(pairs, sets, num, den))
    first = written(components(links))

    found = first.select(F.col("id").alias("hub"), F.col("component").alias("main"))
    labelled = meet(members.select("key", "id"), written(hubs.join(found, "hub", "left").select("key", "size", F.coalesce("main", "hub").alias("main"))), ["key"], "size")
    labelled = written(labelled.join(first, "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("comp"), "main"))
    dropped(members)
    open_keys = written(labelled.groupBy("key").agg(F.sum(F.when(F.col("comp") != F.col("main"), 1).otherwise(0)).alias("apart"), F.count("*").alias("_rows")).where("apart > 0"))
    labelled = written(meet(labelled, open_keys, ["key"], "_rows"))
    left = labelled.where("comp <> main")
    few = left.where(f"size <= {SMALL_BUCKET}").alias("l").join(labelled.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.comp") != F.col("r.comp")))
    few = few.select(F.least("l.id", "r.id").alias("spoke"), F.greatest("l.id", "r.id").alias("hub")).distinct()

    over = labelled.where(f"size > {SMALL_BUCKET}").withColumn("_m", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("_r", F.ceil(F.col("apart") / BLOCK).cast("int"))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rights = over.select("key", "id", "comp", place("_m").alias("mb"), every("_r").alias("rb"), F.lit(False).alias("left_side"))
    lefts = over.where("comp <> main").select("key", "id", "comp", every("_m").alias("mb"), place("_r").alias("rb"), F.lit(True).alias("left_side"))
    # a row for each block that a member is copied to, which Spark sizes like a row for each member: never broadcast
    blocks = rights.unionByName(lefts).join(sets.hint("merge"), "id").repartition("key", "mb", "rb").sortWithinPartitions("key", "mb", "rb")
    many = blocks.select("key", "mb", "rb", "id", "comp", "left_side", "n", "sketch", "members").mapInPandas(solid(lambda it: _blocked(it, num, den)), "a long, b long")
    more = _verified(few, sets, num, den).unionByName(many)

    # texts of one unit_id are linked too
    own = real.select("unit_id", "sig_a", "sig_b").distinct()
    several = own.groupBy("unit_id").agg(F.count("*").alias("_n")).where("_n > 1").select("unit_id")
    held = own.join(several, "unit_id").join(nodes.select("id", "sig_a", "sig_b"), ["sig_a", "sig_b"])
    same = held.join(held.groupBy("unit_id").agg(F.min("id").alias("b")), "unit_id").where("id <> b").select(F.col("id").alias("a"), "b")
    joined = components(first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(same))

    placed = written(nodes.join(joined, "id", "left").select("sig_a", "sig_b", "units", "least", F.coalesce("component", "id").alias("comp")))
    groups = written(placed.groupBy("comp").agg(F.min("least").alias("group_id"), F.count("*").alias("_nodes")))
    stands = written(meet(placed, groups, ["comp"], "_nodes").select("sig_a", "sig_b", "units", "group_id"))
    grouped = meet(real.select("unit_id", "n", "sig_a", "sig_b"), stands, ["sig_a", "sig_b"], "units").select("unit_id", "n", "group_id")
    dropped(nodes, hubs, wanted, sets, labelled, open_keys, placed, groups)
    lone = signed.where("n = 0 or unit_id is null").select("unit_id", "n", F.col("unit_id").alias("group_id"))
    return grouped.unionByName(lone)
