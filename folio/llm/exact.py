"""Exact dedup over a partitioned cuckoo-filter index (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import solid, SPACE, written

SLOTS = 4
MAX_KICKS = 200
COMBINE_ROWS = 200_000
INDEX_COLUMNS = "text_sha256 string, keep_id long, group_size long"
_KEPT, _DELETE, _INSERT = 0, 1, 2


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints whose hits are verified against the digests stored beside it.

    Each digest has two buckets of four slots; a slot holds the fingerprint in the filter and the whole
    digest in the store. When an insertion is kicked on too often, the buckets double and are filled again
    from the stored digests.
    """

    def __init__(self, buckets: int = 64) -> None:
        self._clear(buckets)
        self.live = 0

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints: list[list[int]] = [[] for _ in range(buckets)]
        self.store: list[list[tuple[str, list]]] = [[] for _ in range(buckets)]

    def _places(self, digest: str) -> tuple[int, int, int]:
        mark = int(digest[:4], 16) + 1
        first = int(digest[4:16], 16) & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, digest: str) -> list | None:
        """The value stored for a digest; the filter rejects most misses before content is compared."""
        mark, *both = self._places(digest)
        for bucket in both:
            if mark in self.prints[bucket]:
                for stored, value in self.store[bucket]:
                    if stored == digest:
                        return value
        return None

    def insert(self, digest: str, value: list) -> None:
        self.live += 1
        if (left := self._place(digest, value)) is not None:
            self._resize(left)

    def _resize(self, left: tuple[str, list]) -> None:
        rows, size = [*self.rows(), left], self.mask + 1
        while True:
            size *= 2
            self._clear(size)
            if all(self._place(digest, value) is None for digest, value in rows):
                return

    def _place(self, digest: str, value: list) -> tuple[str, list] | None:
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            if len(self.prints[bucket]) < SLOTS:
                self.prints[bucket].append(mark)
                self.store[bucket].append((digest, value))
                return None
        bucket = second
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            self.prints[bucket][slot], mark = mark, self.prints[bucket][slot]
            self.store[bucket][slot], (digest, value) = (digest, value), self.store[bucket][slot]
            bucket = self._other(bucket, mark)
            if len(self.prints[bucket]) < SLOTS:
                self.prints[bucket].append(mark)
                self.store[bucket].append((digest, value))
                return None
        return digest, value

    def delete(self, digest: str) -> bool:
        mark, *both = self._places(digest)
        for bucket in both:
            for slot, (stored, _) in enumerate(self.store[bucket]):
                if stored == digest:
                    del self.store[bucket][slot], self.prints[bucket][slot]
                    self.live -= 1
                    return True
        return False

    def rows(self) -> Iterator[tuple[str, list]]:
        for bucket in self.store:
            yield from bucket


def _emit(index: CuckooIndex) -> pd.DataFrame:
    rows = list(index.rows())
    return pd.DataFrame({
        "text_sha256": [d for d, _ in rows],
        "keep_id": pd.array([v[0] for _, v in rows], dtype="Int64"),
        "group_size": [v[1] for _, v in rows],
    })


def _combine(limit: int | None):
    """Merge rows of (digest, smallest id, count) through an index; with a limit it is emptied whenever it is that full."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CuckooIndex()
        for frame in frames:
            kinds = frame["_kind"] if "_kind" in frame else [_INSERT] * len(frame)
            for digest, keep, size, kind in zip(frame["text_sha256"], frame["keep_id"], frame["group_size"], kinds, strict=True):
                if kind == _DELETE:
                    index.delete(digest)
                    continue
                keep = None if pd.isna(keep) else int(keep)
                held = index.find(digest)
                if held is None:
                    index.insert(digest, [keep, int(size)])
                else:
                    held[0] = keep if held[0] is None else held[0] if keep is None else min(held[0], keep)
                    held[1] += int(size)
            if limit and index.live >= limit:
                yield _emit(index)
                index = CuckooIndex()
        yield _emit(index)

    return run


def text_digest(text: str = "text"):
    """sha256 of the text with every run of ASCII white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ").cast("binary"), 256)


def digest_index(docs: DataFrame) -> DataFrame:
    """text_sha256, keep_id (smallest doc_id), group_size of every live text.

    Each task first merges its own rows through an index, so that a group sends one row a task; the
    digests are then dealt out by their hash and merged in the same way.
    """
    rows = docs.select(text_digest().alias("text_sha256"), F.col("doc_id").cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    partial = rows.mapInPandas(solid(_combine(COMBINE_ROWS)), INDEX_COLUMNS)
    return partial.repartition("text_sha256").mapInPandas(solid(_combine(None)), INDEX_COLUMNS)


def update_index(index: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """A digest_index() after deleting the texts of one document table and then inserting those of another."""
    names = ["text_sha256", "keep_id", "group_size", "_kind"]
    gone = deleted.select(text_digest().alias("text_sha256")).distinct()
    gone = gone.select("text_sha256", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(_DELETE).alias("_kind"))
    rows = index.withColumn("_kind", F.lit(_KEPT)).select(names).unionByName(gone).unionByName(digest_index(inserted).withColumn("_kind", F.lit(_INSERT)).select(names))
    return rows.repartition("text_sha256").sortWithinPartitions("_kind").mapInPandas(solid(_combine(None)), INDEX_COLUMNS)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """All rows with text_sha256, keep_id, group_size, kept.

    Of rows with equal texts, the one with the smallest doc_id stays. A null text is an empty one. Rows
    repeated with the same doc_id are copies of each other: all carry the group's figures, and each row
    with the smallest doc_id is marked kept. A null doc_id never stays if its group has another; kept is
    true for it only in a group without any doc_id. A very long text is digested whole; only digests are shuffled
    for the groups. Columns of docs named like the results are replaced. An empty table gives no rows.
    """
    docs = docs.drop("text_sha256", "keep_id", "group_size", "kept")
    groups = written(digest_index(docs))
    marked = docs.withColumn("text_sha256", text_digest())
    return marked.join(groups, "text_sha256", "left").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
