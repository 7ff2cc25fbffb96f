"""Digests of document objects and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def object_fingerprints(objects: DataFrame) -> DataFrame:
    """doc_id, category, object_id, digest of objects(doc_id, category, object_id, value)."""
    return objects.select("doc_id", "category", "object_id", F.sha2(F.concat_ws("|", "category", "object_id", "value").cast("binary"), 256).alias("digest"))


def category_digests(fingerprints: DataFrame) -> DataFrame:
    """doc_id, category, object_count, digest of the sorted digests: the order of objects doesn't matter."""
    joined = F.array_join(F.array_sort(F.collect_list("digest")), "|")
    return fingerprints.groupBy("doc_id", "category").agg(F.count("*").alias("object_count"), F.sha2(joined.cast("binary"), 256).alias("digest"))


def compare_contract(source: DataFrame, output: DataFrame, policy: DataFrame, operation: str) -> DataFrame:
    """doc_id, category, outcome (failure, warning, passed), detail for every category of either side.

    policy has (category, rule), a row for each category: preserve, remove or unsupported; others are not checked.
    """
    side = lambda df, s: df.select("doc_id", "category", F.col("object_count").alias(f"n_{s}"), F.col("digest").alias(f"d_{s}"))
    both = side(source, "src").join(side(output, "out"), ["doc_id", "category"], "full").join(policy, "category", "left").na.fill(0, ["n_src", "n_out"])
    detail = (
        F.when((F.col("rule") == "preserve") & (F.col("n_src") != F.col("n_out")), "count")
        .when((F.col("rule") == "preserve") & F.lit(operation != "impose") & ~F.col("d_src").eqNullSafe(F.col("d_out")), "objects")
        .when((F.col("rule") == "remove") & (F.col("n_out") != 0), "not removed")
        .when((F.col("rule") == "unsupported") & (F.col("n_src") > 0), "unsupported")
        .otherwise("")
    )
    outcome = F.when(detail == "", "passed").when(detail == "unsupported", "warning").otherwise("failure")
    return both.select("doc_id", "category", outcome.alias("outcome"), detail.alias("detail"))


def contract_verdict(outcomes: DataFrame) -> DataFrame:
    """doc_id, passed (no failure), failures, warnings of compare_contract()."""
    counts = [F.count_if(F.col("outcome") == kind).alias(f"{kind}s") for kind in ("failure", "warning")]
    return outcomes.groupBy("doc_id").agg(*counts).withColumn("passed", F.col("failures") == 0)


def fingerprint_delta(source: DataFrame, output: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, category, position, object_id, change: at most so many of the missing, modified and added, the source's first."""
    side = lambda df, s: df.select("doc_id", "category", "object_id", F.col("digest").alias(s))
    both = side(source, "_src").join(side(output, "_out"), ["doc_id", "category", "object_id"], "full")
    change = F.when(F.col("_out").isNull(), "missing").when(F.col("_src").isNull(), "added").when(F.col("_src") != F.col("_out"), "modified")
    order = Window.partitionBy("doc_id", "category").orderBy(F.col("change") == "added", "object_id")
    rows = both.withColumn("change", change).where("change is not null").withColumn("position", F.row_number().over(order))
    return rows.where(f"position <= {most}").select("doc_id", "category", "position", "object_id", "change")
