"""Aggregates over all earlier rows of a key, without a task for each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written


def before(rows: DataFrame, keys: list[str], order: list[str], **values: tuple[Callable[[Column], Column], Column]) -> DataFrame:
    """rows with, under each name, an aggregate (F.max or F.sum) of a value over the rows of the same keys that come earlier in the order; null for the first.

    The order must tell rows of a key apart. Rows are dealt out by ranges of keys and order, so that a key with very many
    rows has several ranges: an aggregate of each range, a scan of these, and a scan inside each range are the whole scan.
    """
    ranged = written(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    at = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in (*keys, "_range")]
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_range").agg(*(f(v).alias(f"_all_{n}") for n, (f, v) in values.items()))
    totals = totals.select(*keys, "_range", *(f(F.col(f"_all_{n}")).over(ahead).alias(f"_ahead_{n}") for n, (f, _) in values.items()))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    some = ranged.select("*", *(f(v).over(inside).alias(f"_inside_{n}") for n, (f, v) in values.items()))

    def both(n: str, f: Callable) -> Column:
        a, b = F.col(f"t._ahead_{n}"), F.col(f"r._inside_{n}")
        joined = F.greatest(a, b) if f is F.max else F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(joined).alias(n)

    return some.alias("r").join(totals.alias("t"), at).select(*(F.col(f"r.{c}").alias(c) for c in rows.columns), *(both(n, f) for n, (f, _) in values.items()))
