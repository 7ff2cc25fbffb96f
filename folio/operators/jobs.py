"""Recognition jobs and their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile_jobs(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """jobs(job_id, completed_pages) with actual_pages, the complete ones there are, and mismatch."""
    done = pages.where("status = 'complete'").groupBy("job_id").agg(F.count("*").alias("actual_pages"))
    return jobs.join(done, "job_id", "left").na.fill(0, ["actual_pages"]).withColumn("mismatch", ~F.col("completed_pages").eqNullSafe(F.col("actual_pages")))


def ocr_quality(pages: DataFrame) -> DataFrame:
    """job_id, status, pages, words, confidence (mean, six places)."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    return pages.groupBy("job_id", "status").agg(F.count("*").alias("pages"), F.sum(words).alias("words"), F.round(F.avg("confidence"), 6).alias("confidence"))


def recipe_fingerprint(*columns: str):
    """Digest of a recipe's columns in canonical form; a null field differs from an empty one."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def pending_pages(requested: DataFrame, jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """job_id, page_number still to be done of requested(job_id, page_number, fingerprint).

    A finished page of pages(job_id, page_number, status) is used again only where its job of jobs(job_id, status,
    fingerprint) has the same recipe and is not complete: a complete job starts anew.
    """
    open_ = jobs.where("status is distinct from 'complete'").select("job_id", "fingerprint")
    done = pages.where("status = 'complete'").select("job_id", "page_number").join(open_, "job_id")
    return requested.join(done, ["job_id", "page_number", "fingerprint"], "left_anti").select("job_id", "page_number")


def annotation_inventory(annotations: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, links, widgets, others of annotations(doc_id, page_number, subtype), on the given pages (doc_id, page_number) only if there are any given."""
    rows = annotations if pages is None else annotations.join(pages, ["doc_id", "page_number"], "left_semi")
    kind = F.coalesce("subtype", F.lit(""))
    return rows.groupBy("doc_id").agg(F.count_if(kind == "Link").alias("links"), F.count_if(kind == "Widget").alias("widgets"), F.count_if(~kind.isin("Link", "Widget")).alias("others"))
