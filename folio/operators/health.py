"""Recovery of transactions, audit and repair of stored records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = ["code", "severity", "project_id", "item", "records", "repairable"]
#: Records of a project that is gone: issue of each table.
ORPHANS = {
    "assets": "orphan-assets", "jobs": "orphan-ocr-jobs", "pages": "orphan-ocr-pages", "events": "orphan-workspace-events", "checkpoints": "orphan-workspace-checkpoints",
    "tabs": "stale-workspace-tabs", "revisions": "orphan-document-revisions", "transactions": "orphan-document-transactions",
}


def recover_transactions(transactions: DataFrame, projects: DataFrame) -> DataFrame:
    """transaction_id, outcome (committed or rolled-back), output_id of the preparing ones of transactions(transaction_id, project_id, status, started_at, source_revision_id, operation).

    The newest transaction of a project chooses first: the earliest unused one of projects(project_id, parent_id,
    parent_revision_id, operation, created_at) derived from the same project by the same operation, from its source
    revision if it names one, created no earlier than it started. Records go through tasks in batches, those of one project
    in a row and the newest first: what was derived since a transaction started lies on stacks, the earliest on top. Only
    unused ones of one project are held, and time grows with the records.
    """
    asked = transactions.where("status = 'preparing'").select(
        F.col("project_id").alias("_project"), F.col("started_at").alias("_time"), F.lit(True).alias("_asks"), F.col("transaction_id").alias("_id"), F.col("operation").alias("_kind"), F.col("source_revision_id").alias("_revision"),
    )
    derived = projects.where("parent_id is not null and created_at is not null").select(F.col("parent_id").alias("_project"), F.col("created_at").alias("_time"), F.lit(False).alias("_asks"), F.col("project_id").alias("_id"), F.col("operation").alias("_kind"), F.col("parent_revision_id").alias("_revision"))
    rows = asked.unionByName(derived).withColumn("_kind", F.when(F.col("_project").isNotNull() & F.col("_time").isNotNull(), F.col("_kind")))
    rows = rows.repartition("_project").sortWithinPartitions(F.col("_project").asc_nulls_first(), F.col("_time").desc_nulls_last(), "_asks", F.col("_id").desc())

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, stacks = None, set(), {}
        for batch in batches:
            ids, outputs = [], []
            for project, asks, id_, kind, revision in zip(*(batch.column(c).to_pylist() for c in ("_project", "_asks", "_id", "_kind", "_revision")), strict=True):
                if project != now:
                    now, used, stacks = project, set(), {}
                if not asks:
                    if kind is not None:
                        stacks.setdefault((kind, None), []).append(id_)
                        if revision is not None:
                            stacks.setdefault((kind, revision), []).append(id_)
                    continue
                free, found = stacks.get((kind, revision), []), None
                while free and found is None:
                    top = free.pop()
                    if top not in used:
                        found = top
                        used.add(top)
                ids.append(id_)
                outputs.append(found)
            outcomes = ["rolled-back" if o is None else "committed" for o in outputs]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(outcomes, pa.string()), pa.array(outputs, pa.int64())], ["transaction_id", "outcome", "output_id"])

    return rows.select("_project", "_asks", "_id", "_kind", "_revision").mapInArrow(match, "transaction_id long, outcome string, output_id long")


def _issue(rows: DataFrame, code: str, severity: str, repairable: bool, item: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("project_id").cast("long").alias("project_id"), item.cast("string").alias("item"), F.lit(1).cast("long").alias("records"), F.lit(repairable).alias("repairable"))


def _lost(tables: dict[str, DataFrame]) -> DataFrame:
    """code, records of the stores with records that belong to no project; pages also when their job is gone.

    All stores are counted by project together, so they meet the projects once; jobs and pages without a project belong to none and stay.
    """
    every = None
    for name, code in ORPHANS.items():
        rows = tables[name]
        if name == "pages":
            jobs = tables["jobs"].select(F.col("job_id").alias("_job")).distinct()
            rows = rows.join(jobs, F.col("job_id") == F.col("_job"), "left").where("_job is null or project_id is not null")
            part = rows.groupBy("project_id", F.col("_job").isNull().alias("_gone")).agg(F.count("*").alias("_n"))
        else:
            rows = rows.where("project_id is not null") if name == "jobs" else rows
            part = rows.groupBy("project_id").agg(F.count("*").alias("_n")).withColumn("_gone", F.lit(False))
        part = part.select(F.col("project_id").cast("long").alias("project_id"), "_gone", "_n", F.lit(code).alias("code"))
        every = part if every is None else every.unionByName(part)
    held = tables["projects"].select(F.col("project_id").cast("long").alias("_held")).distinct()
    met = every.join(held, F.col("project_id") == F.col("_held"), "left").where("_gone or _held is null")
    return met.groupBy("code").agg(F.sum("_n").alias("records"))


def health_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """code, severity, project_id, item, records, repairable of the issues of a store; one row `healthy` if there are none.

    tables: projects(project_id, byte_length, checksum, stored_length, stored_checksum, interrupted_job), where a
    null stored_checksum means that the source is missing; objects(project_id, object_id, type, asset_id),
    assets(project_id, asset_id), jobs(job_id, project_id, completed_pages), pages(job_id, project_id, status), and
    events, checkpoints, tabs, revisions, transactions, each with project_id.
    """
    projects = tables["projects"]
    here = projects.where("stored_checksum is not null")
    held = here.select(F.col("project_id").alias("_held")).distinct()
    on = lambda rows: rows.join(held, F.col("project_id") == F.col("_held"), "left_semi")
    done = tables["pages"].where("status = 'complete'").groupBy("job_id").agg(F.count("*").alias("_done"))
    counted = on(tables["jobs"]).join(done, "job_id", "left").where(~F.col("completed_pages").eqNullSafe(F.coalesce("_done", F.lit(0))))
    assets = tables["assets"].select(F.col("project_id").alias("_p"), F.col("asset_id").alias("_a")).distinct()
    images = on(tables["objects"].where("type = 'image'"))
    none = F.lit(None)
    parts = [
        _issue(projects.where("stored_checksum is null"), "source-missing", "error", False, none),
        _issue(here.where("not (stored_length <=> byte_length)"), "source-size", "error", False, none),
        _issue(here.where("not (stored_checksum <=> checksum)"), "source-checksum", "error", False, none),
        _issue(images.join(assets, (F.col("project_id") == F.col("_p")) & (F.col("asset_id") == F.col("_a")), "left_anti"), "editor-asset-missing", "error", False, F.col("object_id")),
        _issue(counted, "ocr-count", "warning", True, F.col("job_id")),
        _issue(here.where("interrupted_job is not null"), "interrupted-job", "warning", True, F.col("interrupted_job")),
    ]
    parts.append(
        _lost(tables).select("code", F.lit("warning").alias("severity"), F.lit(None).cast("long").alias("project_id"), F.lit(None).cast("string").alias("item"), "records", F.lit(True).alias("repairable"))
    )
    issues = parts[0]
    for part in parts[1:]:
        issues = issues.unionByName(part)
    well = issues.agg(F.count("*").alias("_n")).where("_n = 0")
    healthy = well.select(F.lit("healthy").alias("code"), F.lit("pass").alias("severity"), F.lit(None).cast("long").alias("project_id"), F.lit(None).cast("string").alias("item"), F.lit(0).cast("long").alias("records"), F.lit(False).alias("repairable"))
    return issues.select(ISSUE).unionByName(healthy)


def repair(tables: dict[str, DataFrame], codes: tuple[str, ...]) -> dict[str, DataFrame]:
    """The tables of health_audit() after repairing the issues named: orphans deleted (a job with its pages), counters recomputed, interrupted jobs forgotten.

    An issue that can't be repaired is a ValueError, and nothing is done.
    """
    known = set(ORPHANS.values()) | {"ocr-count", "interrupted-job"}
    if refused := sorted(set(codes) - known):
        raise ValueError(f"repair: not repairable: {', '.join(refused)}")
    out = dict(tables)
    ids = tables["projects"].select(F.col("project_id").alias("_key")).distinct()
    own = lambda rows: rows.join(ids, F.col("project_id") == F.col("_key"), "left_semi")
    free = lambda rows: rows.where("project_id is null").unionByName(own(rows))
    if {"orphan-ocr-jobs", "orphan-ocr-pages"} & set(codes):
        out["jobs"] = free(tables["jobs"])
        jobs = out["jobs"].select(F.col("job_id").alias("_job")).distinct()
        out["pages"] = free(tables["pages"]).join(jobs, F.col("job_id") == F.col("_job"), "left_semi")
    for name, code in ORPHANS.items():
        if code in codes and name not in ("jobs", "pages"):
            out[name] = own(tables[name])
    if "ocr-count" in codes:
        done = out["pages"].where("status = 'complete'").groupBy("job_id").agg(F.count("*").alias("_done"))
        kind = out["jobs"].schema["completed_pages"].dataType
        out["jobs"] = out["jobs"].join(done, "job_id", "left").withColumn("completed_pages", F.coalesce("_done", F.lit(0)).cast(kind)).select(out["jobs"].columns)
    if "interrupted-job" in codes:
        out["projects"] = out["projects"].withColumn("interrupted_job", F.lit(None).cast("string"))
    return out
