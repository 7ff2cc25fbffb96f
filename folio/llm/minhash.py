"""MinHash near-dedup with odd sketches (operator 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near import near_groups

def near_dedup(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Two documents are linked when den * intersection >= num * union of their sets of distinct word shingles
    (ASCII lower case; a shorter text is one shingle). component_id is the smallest doc_id that links reach,
    kept marks it. Null and empty texts are linked with nothing. A null doc_id takes no part, its
    component_id is null and it is kept. Rows repeating a doc_id are one document: all carry its component,
    which any of their texts links. Very long texts are whole sets like others. Ties go to the smallest doc_id.
    Other columns are ignored; an empty table gives no rows. Bands follow from the threshold.
    """
    units = docs.select(F.col("doc_id").cast("long").alias("unit_id"), "text")
    out = near_groups(units, words, num, den)
    return out.select(F.col("unit_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("group_id").alias("component_id"), F.col("unit_id").eqNullSafe(F.col("group_id")).alias("kept"))
