"""Approximate nearest neighbours by balanced posting lists (operator 10).

Centroids are fitted on a bounded sample and split until their lists are balanced. Every vector goes to
the list of its nearest centroid, and boundary vectors also to that of the next one. A query finds near
centroids with a best-first search of an in-memory graph, keeps those within a ratio of the nearest distance,
and compares itself with the vectors of their lists. Ratio and number of lists are set on the sample: the
cheapest pair that finds TARGET of its nearest neighbours there, so vectors that lie in clusters need few
lists and shapeless ones many. Lists are packed for the tasks that compare, and a query goes to a pack once,
with the lists it looks into there: their number does not multiply what is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, solid, written
from .near import mixed

#: Bounds: sampled vectors (those of smallest hash), lists, vectors of the sample in one list, queries the settings are tried with.
SAMPLE, MAX_LISTS, LIST_SIZE, TRIED = 20_000, 2_048, 24, 256
#: A vector goes to so many lists at most, whose squared distance is within the ratio of the nearest.
COPIES, CLOSURE = 2, 1.1
#: Share of the sample's nearest neighbours that its settings find.
TARGET = 0.96
NEIGHBOURS, BEAM = 24, 64
#: Lists make up PACKS packs, or more: a pack has at least so many vectors and about FLOATS components at most, or is cut into blocks.
PACKS, LEAST_PACK, FLOATS = 32, 1_024, 1 << 24
#: Vectors of a list that queries are compared with at once.
PIECE = 4_096


@dataclass
class ListIndex:
    centroids: np.ndarray
    graph: np.ndarray
    probes: int = 1
    ratio: float = 1.0

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of about the k nearest centroids of each row, by best-first search of the graph, all rows at once.

        Each round follows the edges of a few of the nearest centroids not yet followed; the search of a row ends
        when its k (or BEAM) nearest have all been.
        """
        n, many, k = len(x), len(self.centroids), min(k, len(self.centroids))
        beam = min(max(BEAM, k + k // 4), many)
        wide = max(1, beam // 8)
        square = (self.centroids**2).sum(1)
        # distances are looked up by centroid: infinite until it is seen
        gaps = np.full((n, many), np.inf)
        followed = np.zeros((n, many), dtype=bool)
        start = np.linspace(0, many - 1, min(many, 16)).astype(np.int64)
        gaps[:, start] = square[start] - 2 * x @ self.centroids[start].T
        for _ in range(many):
            limit = np.partition(gaps, beam - 1, axis=1)[:, beam - 1 : beam] if beam < many else np.inf
            waiting = np.where(followed | (gaps > limit), np.inf, gaps)
            pick = np.argpartition(waiting, wide - 1, axis=1)[:, :wide] if wide < many else np.tile(np.arange(many), (n, 1))
            rows, column = np.nonzero(np.isfinite(np.take_along_axis(waiting, pick, 1)))
            if not len(rows):
                break
            from_ = pick[rows, column]
            followed[rows, from_] = True
            r, c = np.repeat(rows, self.graph.shape[1]), self.graph[from_].ravel()
            fresh = np.isinf(gaps[r, c])
            r, c = r[fresh], c[fresh]
            gaps[r, c] = square[c] - 2 * np.einsum("nd,nd->n", x[r], self.centroids[c])
        ids = np.argpartition(gaps, k - 1, axis=1)[:, :k]
        order = np.argsort(np.take_along_axis(gaps, ids, 1), axis=1, kind="stable")
        ids = np.take_along_axis(ids, order, 1)
        return ids, np.maximum(np.take_along_axis(gaps, ids, 1) + (x**2).sum(1)[:, None], 0)


def _kmeans(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 6) -> np.ndarray:
    centres = x[draw.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
        for c in range(k):
            if (own == c).any():
                centres[c] = x[own == c].mean(0)
    return ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


def build(sample: np.ndarray) -> ListIndex:
    """Split the sample by small k-means until every part has LIST_SIZE vectors at most, or there are MAX_LISTS."""
    draw, parts, lists = np.random.default_rng(5), [sample], []
    while parts:
        parts.sort(key=len)
        part = parts.pop()
        if len(part) <= LIST_SIZE or len(parts) + len(lists) + 1 >= MAX_LISTS or (part == part[0]).all():
            lists.append(part.mean(0))
            continue
        own = _kmeans(part, min(8, max(2, len(part) // LIST_SIZE)), draw)
        cut = [part[own == c] for c in np.unique(own)]
        if len(cut) == 1:
            lists.append(part.mean(0))
        else:
            parts += cut
    centroids = np.array(lists)
    gaps = (centroids**2).sum(1)[None, :] - 2 * centroids @ centroids.T
    near = np.argsort(gaps, axis=1)[:, 1 : NEIGHBOURS + 1] if len(centroids) > 1 else np.zeros((1, 1), dtype=np.int64)
    # long edges keep the graph connected
    far = draw.integers(0, len(centroids), (len(centroids), 4))
    ring = ((np.arange(len(centroids)) + 1) % len(centroids))[:, None]
    index = ListIndex(centroids, np.hstack([near, far, ring]))
    index.probes, index.ratio = _settings(index, sample, draw)
    return index


def _settings(index: ListIndex, sample: np.ndarray, draw: np.random.Generator, k: int = 5) -> tuple[int, float]:
    """The number of lists and the distance ratio, of those that find TARGET of the k nearest in the sample, that open the fewest lists."""
    c = index.centroids
    if len(c) == 1 or len(sample) <= k:
        return len(c), np.inf
    x = sample[draw.choice(len(sample), min(TRIED, len(sample)), replace=False)]
    near = x @ sample.T
    near[near >= 1 - 1e-12] = -9  # itself and its copies
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    gaps = np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * x @ c.T, 0)
    rank = gaps.argsort(1).argsort(1)
    ratio = (gaps + 1e-12) / (gaps.min(1, keepdims=True) + 1e-12)
    y = sample[best.ravel()]
    held = (c**2).sum(1)[None, :] - 2 * y @ c.T + (y**2).sum(1)[:, None]
    own = held.argpartition(COPIES - 1, axis=1)[:, :COPIES]
    gap = np.take_along_axis(held, own, 1)
    inside = (gap <= np.maximum(gap.min(1, keepdims=True), 0) * CLOSURE + 1e-12).reshape(*best.shape, COPIES)
    lists = own.reshape(*best.shape, COPIES)
    rows = np.arange(len(x))[:, None, None]
    need_rank = np.where(inside, rank[rows, lists], len(c)).min(2).ravel()
    need_ratio = np.where(inside, ratio[rows, lists], np.inf)
    choices = []
    for share in np.linspace(TARGET, 1.0, 13):
        probes = int(np.quantile(need_rank, share)) + 1
        ratios = np.where(rank[rows, lists] < probes, need_ratio, np.inf).min(2).ravel()
        limit = float(np.quantile(ratios, TARGET, method="higher"))
        if np.isfinite(limit):
            choices.append((((rank < probes) & (ratio <= limit)).sum(1).mean(), probes, limit))
    return min(choices)[1:] if choices else (len(c), np.inf)


def _unit(column: pd.Series) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = np.array(column.tolist(), dtype=np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of rows that take part: not null, not zero, of finite components only. Single precision stays so, which halves what is shuffled."""
    array = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), array.alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(good & F.exists("embedding", lambda v: v != 0))


def _sampled(unique: DataFrame) -> pd.DataFrame:
    """embedding (single precision, largest component 1) of the SAMPLE vectors of smallest hash, in its order.

    All but a few more are left out before anything is collected, so what the driver gets does not grow with the tasks.
    """
    rows, number, share = unique.withColumn("_hash", F.xxhash64(F.col("embedding").cast("array<double>"))), unique.count(), 1.1
    while share * SAMPLE < number:
        few = rows.where(F.col("_hash") < int(share * SAMPLE / number * (1 << 64)) - (1 << 63))
        if few.count() >= SAMPLE:
            rows = few
            break
        share *= 2
    scaled = F.transform("embedding", lambda v: v / F.array_max(F.transform("embedding", F.abs))).cast("array<float>")
    found = rows.select("_hash", F.col("ids")[0].alias("_least"), scaled.alias("embedding")).toArrow().to_pandas()
    return found.sort_values(["_hash", "_least"], kind="stable").head(SAMPLE)[["embedding"]].reset_index(drop=True)


def _places(shared, asks: bool, everywhere: bool = False):
    """Cuts frames into parts of one length of vectors: the part, its unit vectors, and row and list of each list a vector is held in, or (asks) looks into."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
        for frame in frames:
            for d, own in frame.groupby(frame["embedding"].map(len)):
                index = shared.value.get(d)
                for at in range(0, len(own), 512):
                    part = own.iloc[at : at + 512]
                    x = _unit(part["embedding"])
                    if index is None:  # a length the sample has not: one list
                        r, lists = np.arange(len(part)), np.full(len(part), -1)
                    else:
                        many = len(index.centroids)
                        found, gaps = index.nearest(x, many if everywhere else index.probes if asks else COPIES)
                        ratio = np.inf if everywhere else index.ratio if asks else CLOSURE
                        r, c = np.nonzero(gaps <= np.maximum(gaps[:, :1], 1e-12) * ratio + 1e-12)
                        lists = found[r, c]
                    yield int(d), part, x.astype(np.float32), r, lists.astype(np.int32)

    return run


def _post(shared):
    """Rows with the length of their vectors and the lists these are held in."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d, part, _, r, lists in _places(shared, False)(frames):
            yield part[["rep", "ids", "embedding"]].assign(dim=np.int32(d), lists=np.split(lists, np.searchsorted(r, np.arange(1, len(part)))))

    return run


def _packs(posted: DataFrame) -> pd.DataFrame:
    """list, dim, pack, blocks of each list that holds something: lists of one length of vectors in a row make up a pack."""
    sizes = posted.select("dim", F.explode("lists").alias("list")).groupBy("dim", "list").agg(F.count("*").alias("n")).toPandas().sort_values(["dim", "list"])
    n, d = sizes["n"].to_numpy(dtype=np.int64), sizes["dim"].to_numpy(dtype=np.int64)
    room = np.minimum(np.maximum(n.sum() // PACKS, LEAST_PACK), np.maximum(FLOATS // np.maximum(d, 1), 1))
    before = sizes.groupby("dim")["n"].cumsum().to_numpy(dtype=np.int64) - n
    sizes["pack"] = before // room
    whole = sizes.groupby(["dim", "pack"])["n"].transform("sum").to_numpy(dtype=np.int64)
    sizes["blocks"] = -(-whole // (2 * room))
    return sizes[["list", "dim", "pack", "blocks"]].astype("int32")


DEALT = "dim int, pack int, block int, asks boolean, rep long, unit binary, lists binary"


def _dealt(d: int, x: np.ndarray, names: np.ndarray, r: np.ndarray, lists: np.ndarray, known: pd.DataFrame, asks: bool) -> Iterator[pd.DataFrame]:
    """The rows of x in each pack that has lists of theirs, with these as bytes: in one of its blocks, or (asks) in all."""
    at = known.index.get_indexer(lists)
    r, lists, at = r[at >= 0], lists[at >= 0], at[at >= 0]
    pack, blocks = known["pack"].to_numpy()[at], known["blocks"].to_numpy()[at]
    order = np.lexsort((lists, pack, r))
    r, lists, pack, blocks = r[order], lists[order], pack[order], blocks[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (pack[1:] != pack[:-1])])[: len(r)])
    held = [lists[s:e].tobytes() for s, e in zip(first, np.append(first[1:], len(r)), strict=True)]
    many = blocks[first].astype(np.int64)
    each = np.repeat(np.arange(len(first)), many if asks else 1)
    block = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) if asks else (mixed(names[r[first]].astype(np.uint64)) % many.astype(np.uint64)).astype(np.int64)
    unit = [row.tobytes() for row in x]
    for start in range(0, len(each), 10_000):
        some = each[start : start + 10_000]
        row = r[first[some]]
        yield pd.DataFrame({"dim": np.int32(d), "pack": pack[first[some]], "block": block[start : start + 10_000].astype(np.int32), "asks": asks, "rep": names[row], "unit": [unit[i] for i in row], "lists": [held[i] for i in some]})


def _hold(packs):
    """Vectors that know their lists, dealt to the blocks of these."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {d: own.set_index("list") for d, own in packs.value.groupby("dim")}
        for frame in frames:
            for d, own in frame.groupby("dim"):
                for at in range(0, len(own), 512):
                    part = own.iloc[at : at + 512]
                    r = np.repeat(np.arange(len(part)), part["lists"].map(len))
                    yield from _dealt(d, _unit(part["embedding"]).astype(np.float32), part["rep"].to_numpy(), r, np.concatenate(part["lists"].tolist()), known[d], False)

    return run


def _ask(shared, packs, everywhere: bool):
    """Queries, dealt to all blocks of the lists they look into."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {d: own.set_index("list") for d, own in packs.value.groupby("dim")}
        for d, part, x, r, lists in _places(shared, True, everywhere)(frames):
            if d in known:
                yield from _dealt(d, x, part["rep"].to_numpy(), r, lists, known[d], True)

    return run


def _best(x: np.ndarray, asked: list[bytes], y: np.ndarray, names: np.ndarray, lists: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, name and cosine of the k + 2 nearest of y for each row of x, among those of the lists asked by it; lists are sorted, place says where in y each one's vectors are."""
    wide = COPIES * (k + 2)  # a vector may be held in several lists
    near, best = np.full((len(x), wide), -np.inf, dtype=np.float32), np.full((len(x), wide), -1, dtype=np.int64)
    wanted = np.frombuffer(b"".join(asked), dtype=np.int32)
    row = np.repeat(np.arange(len(x)), [len(a) // 4 for a in asked])
    order = np.argsort(wanted, kind="stable")
    wanted, row = wanted[order], row[order]
    for one in np.unique(wanted):
        rows, (begin, end) = row[slice(*np.searchsorted(wanted, [one, one + 1]))], np.searchsorted(lists, [one, one + 1])
        for s in range(begin, end, PIECE):
            own = place[s : min(s + PIECE, end)]
            cos, top = x[rows] @ y[own].T, min(k + 2, len(own))
            some = np.argpartition(-cos, top - 1, axis=1)[:, :top]
            both = np.hstack([near[rows], np.take_along_axis(cos, some, 1)])
            reps = np.hstack([best[rows], names[own][some]])
            some = np.argpartition(-both, wide - 1, axis=1)[:, :wide]
            near[rows], best[rows] = np.take_along_axis(both, some, 1), np.take_along_axis(reps, some, 1)
    order = np.argsort(best, axis=1, kind="stable")
    near, best = np.take_along_axis(near, order, 1), np.take_along_axis(best, order, 1)
    near[:, 1:][best[:, 1:] == best[:, :-1]] = -np.inf
    some = np.argpartition(-near, k + 1, axis=1)[:, : k + 2]
    near, best = np.take_along_axis(near, some, 1), np.take_along_axis(best, some, 1)
    r, c = np.nonzero(np.isfinite(near))
    return r, best[r, c], near[r, c].astype(np.float64)


def _compare(k: int):
    """The k + 2 nearest of each block for each of its queries; rows arrive sorted by (dim, pack, block, asks), so a block's queries pass by its vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, parts, held = None, [], None
        for frame in frames:
            for own, group in frame.groupby(["dim", "pack", "block"], sort=False):
                if own != key:
                    key, parts, held = own, [], None
                asks = group["asks"].to_numpy()
                if not asks.all():
                    some = group[~asks]
                    parts.append((b"".join(some["unit"]), some["rep"].to_numpy(), b"".join(some["lists"]), some["lists"].map(len).to_numpy() // 4))
                some = group[asks]
                if not len(some) or not parts and held is None:
                    continue
                if held is None:
                    units, names, lists, many = zip(*parts, strict=True)
                    parts, lists, many = [], np.frombuffer(b"".join(lists), dtype=np.int32), np.concatenate(many)
                    order = np.argsort(lists, kind="stable")
                    held = np.frombuffer(b"".join(units), dtype=np.float32).reshape(-1, own[0]), np.concatenate(names), lists[order], np.repeat(np.arange(len(many)), many)[order]
                for at in range(0, len(some), 1024):
                    part = some.iloc[at : at + 1024]
                    x = np.frombuffer(b"".join(part["unit"]), dtype=np.float32).reshape(-1, own[0])
                    r, rep, near = _best(x, part["lists"].tolist(), *held, k)
                    yield pd.DataFrame({"query": part["rep"].to_numpy()[r], "rep": rep, "near": near})

    return run


def _candidates(held: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query, rep of the nearest vectors of the lists that a query looks into."""
    rows = held.unionByName(asked).repartition("dim", "pack", "block").sortWithinPartitions("dim", "pack", "block", "asks")
    # rows of a query meet once: those of one vector, and the nearest of them
    met = rows.mapInPandas(solid(_compare(k)), "query long, rep long, near double").repartition("query").groupBy("query", "rep").agg(F.max("near").alias("near"))
    top = Window.partitionBy("query").orderBy(F.desc("near"), "rep")
    # one row is the query's own vector; its copies' ids are candidates like others
    return met.withColumn("_n", F.row_number().over(top)).where(f"_n <= {k + 2}").select("query", "rep")


def _cosine(a: str, b: str):
    """The cosine of two array columns in double precision; components that squares could lose are scaled first."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    def scaled(name: str):
        array = F.col(name).cast("array<double>")
        most = F.array_max(F.transform(array, F.abs))
        return F.when(most.between(1e-100, 1e100), array).otherwise(F.transform(array, lambda v: v / most))

    x, y = scaled(a), scaled(b)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries(vec_id) the k vectors of largest cosine found, or all candidates if there are fewer.

    Both sides are (vec_id, embedding); a query's own row is no candidate. Equal vectors are searched as one
    and stand for their k + 1 smallest vec_ids, which is all that ties can use, so a large group of copies
    is no large list. Null, zero and non-finite vectors take no part. Vectors of different length are
    compared with their own kind only, and a very long one is whole in a task. Candidates are found by unit
    vectors in single precision, scores are of the original ones in double precision; ties go to the smaller
    vec_id. A query that finds fewer than k looks into all lists. Rows that repeat a vec_id with the same
    vector are one, with different ones candidates of their own. Other columns are ignored, whatever their
    names. An empty table gives no rows.
    """
    rows = valid(vectors)
    # smallest k + 1 ids of every different vector; merging bounded lists keeps the state of a group bounded
    ids = rows.groupBy("embedding", F.floor(F.col("vec_id") / 64).alias("_part")).agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select("embedding", F.slice("ids", 1, k + 1).alias("ids"))
    # several vectors may have one id, so they are known by a number of their own
    unique = written(ids.select(F.monotonically_increasing_id().alias("rep"), "ids", "embedding", F.xxhash64("embedding").alias("_key")))
    several = written(unique.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
    if not several.isEmpty():  # only what is in several parts is merged
        spread = unique.join(several, "_key", "left_semi").select("rep", "embedding", F.explode("ids").alias("vec_id"))
        place = Window.partitionBy("embedding").orderBy("vec_id")
        few = spread.withColumn("_n", F.row_number().over(place)).where(f"_n <= {k + 1}").groupBy("embedding").agg(F.min("rep").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
        ids, unique = unique, written(unique.join(several, "_key", "left_anti").drop("_key").unionByName(few))
        dropped(ids)
    sample = _sampled(unique)
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = sample["embedding"].map(len)
    indexes = {int(d): build(_unit(sample["embedding"][sizes == d])) for d in sizes.unique()}
    shared = vectors.sparkSession.sparkContext.broadcast(indexes)

    kind = unique.schema["embedding"].dataType.simpleString()
    posted = written(unique.select("rep", "ids", "embedding").mapInPandas(solid(_post(shared)), f"rep long, ids array<long>, embedding {kind}, dim int, lists array<int>"))
    dropped(unique)
    packs = vectors.sparkSession.sparkContext.broadcast(_packs(posted))
    held = posted.select("rep", "embedding", "dim", "lists").mapInPandas(solid(_hold(packs)), DEALT)
    wanted = written(valid(queries).select("vec_id", "embedding").distinct())
    asked = written(wanted.groupBy("embedding").agg(F.min("vec_id").alias("_least")).select(F.monotonically_increasing_id().alias("rep"), "embedding"))  # equal queries are asked once
    spread_out = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def looks(queries: DataFrame, everywhere: bool = False) -> DataFrame:
        return queries.repartition(spread_out).mapInPandas(solid(_ask(shared, packs, everywhere)), DEALT)

    def named(best: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, score of the candidates (query, rep)."""
        near = written(best).join(posted.select("rep", "ids", F.col("embedding").alias("other")), "rep")
        every = wanted.join(asked.withColumnRenamed("rep", "query"), "embedding").select(F.col("vec_id").alias("query_id"), "query", "embedding")
        pairs = every.join(near, "query").select("query_id", "embedding", "other", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        scored = pairs.select("query_id", "vec_id", _cosine("embedding", "other").alias("score")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return scored.withColumn("rank", F.row_number().over(last)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")

    found = written(named(_candidates(held, looks(asked), k)))
    full = found.groupBy("query_id").agg(F.count("*").alias("_n")).where(f"_n >= {k}")
    short = written(asked.join(wanted.join(full, wanted["vec_id"] == full["query_id"], "left_anti").select("embedding").distinct(), "embedding"))
    if not short.isEmpty():
        more = written(named(_candidates(held, looks(short, True), k)))
        found = found.join(more, "query_id", "left_anti").unionByName(more)
    return found
