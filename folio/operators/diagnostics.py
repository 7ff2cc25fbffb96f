"""Masking of error reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what is masked, in this order, and the limits
MASKS = [
    (r"(?i)blob:[^\s)]+", "[blob-url]"),
    (r"(?i)file://[^\s)]+", "[file-url]"),
    (r"""([A-Za-z]:\\|/)(?:[^\s/:*?"<>|]+[\\/]){2,}[^\s)]+""", "[local-path]"),
    (r"""(["'`])[^\r\n]{80,}?\1""", "[long-value]"),
]
LONGEST, KEPT = 12_000, 50


def mask_diagnostics(logs: DataFrame, most: int = KEPT) -> DataFrame:
    """owner, position, id, message of the newest logs(owner, id, at, message), without addresses, paths and long values."""
    message = F.col("message")
    for pattern, mask in MASKS:
        message = F.regexp_replace(message, pattern, mask)
    newest = Window.partitionBy("owner").orderBy(F.desc("at"), F.desc("id"))
    kept = logs.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= most)
    return kept.select("owner", "position", "id", F.substring(message, 1, LONGEST).alias("message"))


def mask_counts(logs: DataFrame) -> DataFrame:
    """mask, messages, places: in how many messages of logs(message) each mask was put, and how often; each looks at what the ones before it left."""
    text, counts = F.col("message"), []
    for pattern, mask in MASKS:
        counts.append(F.struct(F.lit(mask).alias("mask"), F.regexp_count(text, F.lit(pattern)).alias("n")))
        text = F.regexp_replace(text, pattern, mask)
    rows = logs.select(F.inline(F.array(*counts)))
    return rows.groupBy("mask").agg(F.count_if(F.col("n") > 0).alias("messages"), F.coalesce(F.sum("n"), F.lit(0)).alias("places"))
