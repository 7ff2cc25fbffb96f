"""Queries that write the given tables as files and read them again, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folio.functions.storage import shared_dir
from folio.operators import exports, ingest, records
from folio.plans import compared, governed, structured
from folio.sources import derived, files, views


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def s3_triage_folder(spark, sf_dir):
    path = _folder(spark)
    raw = derived.raw_files(views.table(spark, sf_dir, "documents"))
    files.write_files(raw.select(F.concat(F.col("doc_id") % 7, F.lit("/"), "doc_id", F.lit(".bin")).alias("name"), F.col("content").alias("body")), path)
    found = ingest.triage_folder(spark, path)
    return found.select(F.regexp_extract("path", r"/(\d+)\.bin$", 1).cast("long").alias("doc_id"), *(c for c in found.columns if c != "path")).withColumn("errors", F.array_join("errors", ","))


def s6_document_files(spark, sf_dir):
    pages, path = views.doc_pages(views.table(spark, sf_dir, "documents")), _folder(spark)
    exports.save_documents(pages, path)
    exports.save_documents(pages, path, "markdown")
    kind = F.when(F.col("name").endswith(".md"), "markdown").otherwise("text")
    return files.read_texts(spark, path).select(F.regexp_extract("name", r"^\d+", 0).cast("long").alias("doc_id"), kind.alias("form"), "body")


def s7_chunk_files(spark, sf_dir):
    pages, path = views.doc_pages(views.table(spark, sf_dir, "documents")), _folder(spark)
    exports.save_chunks(pages, 4, path)
    place = F.regexp_extract("name", r"^(\d+)/(.*)\.txt$", 1).cast("long").alias("doc_id"), F.regexp_extract("name", r"^(\d+)/(.*)\.txt$", 2).alias("name")
    return files.read_texts(spark, path).select(*place, "body")


def s8_receipts_file(spark, sf_dir):
    path = _folder(spark)
    records.save_receipts(compared.receipts(spark, sf_dir), path)
    schema = ", ".join(f"{f} string" for f in records.RECEIPT_FIELDS)
    return spark.read.schema(schema).csv(path, header=True, escape='"', nullValue="\0").select(*(F.coalesce(f, F.lit("")).alias(f) for f in records.RECEIPT_FIELDS))


QUERIES = {f.__name__: f for f in (s3_triage_folder, s6_document_files, s7_chunk_files, s8_receipts_file)}

ORACLES = {
    "s3_triage_folder": structured.ORACLES["s3_container_triage"],
    "s6_document_files": governed.ORACLES["s6_export_documents"],
    "s7_chunk_files": "with " + views.SQL + """ select doc_id, printf('pages-%04d-%04d', min(page_number), max(page_number)) as name, string_agg(text, chr(10) || chr(10) || '--- Page break ---' || chr(10) || chr(10) order by page_number) as body
        from doc_pages group by doc_id, (page_number - 1) // 4""",
    "s8_receipts_file": """select strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as created_at, event_type as kind, 'f"' || event_id as filename, '' as mime_type, user_id::varchar as byte_length, sha256(event_id::varchar) as sha256, '/activity' as route, '1' as release from events""",
}
