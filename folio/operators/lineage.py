"""Versioned records and their lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.storage import written

CURRENT = 3


def load_versioned(records: DataFrame, current: int = CURRENT) -> tuple[DataFrame, DataFrame]:
    """Records whose schema_version is 1 to current, and the others untouched; a null version is of the others."""
    known = F.coalesce(F.col("schema_version").between(1, current), F.lit(False))
    return records.where(known), records.where(~known)


def migrate_manifests(manifests: DataFrame, current: int = CURRENT) -> DataFrame:
    """Manifests with the defaults of the current version: their own root, sequence 0, a legacy source."""
    return manifests.withColumns({
        "root_id": F.coalesce("root_id", "project_id"), "sequence": F.coalesce("sequence", F.lit(0)),
        "operation": F.coalesce("operation", F.lit("legacy-source")), "schema_version": F.lit(current),
    })


def document_lineage(revisions: DataFrame) -> DataFrame:
    """project_id, root_id, sequence (steps to the root) of revisions(project_id, parent_id), by pointer doubling.

    A parent that is null or absent makes a root. Rounds grow with the logarithm of the depth; rows that have
    reached their root leave the join, so a popular root is never a join key. Members of a parent cycle, and
    rows below one, get null root_id and sequence.
    """
    ids = revisions.select(F.col("project_id").alias("_parent")).distinct()
    linked = revisions.select("project_id", "parent_id").join(ids, F.col("parent_id") == F.col("_parent"), "left")
    state = written(linked.select("project_id", F.coalesce("_parent", "project_id").alias("root_id"), F.when(F.col("_parent").isNull(), 0).otherwise(1).cast("long").alias("sequence"), F.col("_parent").isNull().alias("_done")))
    finished = [state.where("_done")]
    pending = state.where("not _done")
    # a path has no more steps than there are revisions, so whoever is left after these rounds is in a cycle or below one
    for _ in range(state.count().bit_length() + 1):
        ahead = state.select(F.col("project_id").alias("_id"), F.col("root_id").alias("_root"), F.col("sequence").alias("_steps"), F.col("_done").alias("_end"))
        step = pending.drop("_done").join(ahead, F.col("root_id") == F.col("_id"))
        state = written(step.select("project_id", F.col("_root").alias("root_id"), (F.col("sequence") + F.col("_steps")).alias("sequence"), F.col("_end").alias("_done")))
        finished.append(state.where("_done"))
        pending = state.where("not _done")
        if pending.isEmpty():
            break
        state = state.where("not _done").unionByName(_all(finished))
    out = _all(finished).select("project_id", "root_id", "sequence")
    return out.unionByName(pending.select("project_id", F.lit(None).cast("long").alias("root_id"), F.lit(None).cast("long").alias("sequence")))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def isolate_ids(assets: DataFrame, objects: DataFrame) -> DataFrame:
    """objects(project_id, object_id, asset_id) with a fresh asset id for each asset of assets(project_id, asset_id); other references stay."""
    fresh = F.sha2(F.concat_ws("|", F.col("project_id").cast("string"), "asset_id").cast("binary"), 256)
    known = assets.select("project_id", "asset_id").distinct().withColumn("_fresh", fresh)
    return objects.join(known, ["project_id", "asset_id"], "left").select("project_id", "object_id", F.coalesce("_fresh", "asset_id").alias("asset_id"))
