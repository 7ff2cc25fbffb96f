"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder in ``spark.checkpoint.dir``; clear() deletes it.

    Where the session names no folder a local run takes a temporary one; on a cluster that is an error, since
    executors do not share their local folders. The session's configuration is left as it is.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        set_dir = sc._jsc.sc().getCheckpointDir()
        where = set_dir.get() if set_dir.isDefined() else _own_dir(sc)
    return f"{where}/folio-{sc.applicationId}"


_own: dict[str, str] = {}


def _own_dir(sc) -> str:
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="folio-")
    return _own[sc.applicationId]


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables made by written() that nothing reads any more.

    The driver's JVM is asked to collect, since Spark keeps the shuffle files of finished jobs until then.
    """
    for table_ in tables:
        for path in {file.rpartition("/")[0] for file in table_.inputFiles()}:
            _delete(table_.sparkSession, path)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written; results that are not yet computed are lost."""
    _delete(spark, shared_dir(spark))


#: A group is heavy when it meets more than this share of the rows (and more than LEAST_HEAVY): there are 1000 at most.
HEAVY, LEAST_HEAVY = 1_000, 10_000


def meet(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int | None = None, side: str = "merge") -> DataFrame:
    """rows joined with groups on keys, where size says how many rows each group meets; total is the number of rows, counted if not given.

    rows and groups are written tables; a row of groups has keys of its own. Heavy groups are broadcast (by their
    sizes there are HEAVY at most), so their rows stay where they are; the rest is shuffled, at every size, and has no heavy key.
    side is the hint for groups there: where they are far fewer than the rows, "shuffle_hash" spares sorting the rows.
    """
    limit = max(LEAST_HEAVY, (rows.count() if total is None else total) // HEAVY)
    heavy, light = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    rest = rows.join(F.broadcast(heavy.select(keys)), keys, "left_anti").join(light.hint(side), keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(rest)


def running(rows: DataFrame, sums: dict[str, Column | str], keys: list[str], chunk: str, order: list[str]) -> DataFrame:
    """rows with, under each name of sums, the sum of its value over the rows of the same keys that come before in the order (chunk, order).

    Two steps, so no task has a whole key: totals of the chunks are summed up, then the rows inside a chunk.
    """
    values = [(name, F.col(v) if isinstance(v, str) else v) for name, v in sums.items()]
    ahead = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, chunk).agg(*(F.sum(v).alias(f"_sum_{name}") for name, v in values))
    before = [F.coalesce(F.sum(f"_sum_{name}").over(ahead), F.lit(0)).alias(f"_ahead_{name}") for name, _ in values]
    totals = totals.select(*(F.col(k).alias(f"_at_{k}") for k in keys), F.col(chunk).alias("_at"), *before)
    match = F.col(chunk) == F.col("_at")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_at_{k}"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_inside_{name}") for name, v in values))
    kept = [c for c in rows.columns if not c.startswith("_inside_")]
    return rows.join(totals, match).select(*kept, *((F.col(f"_inside_{name}") + F.col(f"_ahead_{name}")).alias(name) for name, _ in values))


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def in_slices(frames: Iterator[pd.DataFrame], column: str, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Cut batches into slices of about so many characters of a text column, so memory is bounded by one slice or text."""
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).to_numpy(dtype=np.int64) + 64
        cuts = np.cumsum(sizes) // chars
        for _, part in frame.groupby(cuts, sort=False) if len(frame) else ():
            yield part


def solid(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """run without the empty frames it gives, which Arrow cannot always type."""

    def full(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (frame for frame in run(frames) if len(frame))

    return full
