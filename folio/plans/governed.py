"""Queries over manifests, redactions, exports, recognition jobs and record flows, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.storage import shared_dir
from folio.operators import assembly, diagnostics, exports, governance, jobs, lineage
from folio.sources import views
from folio.streaming import flows, sessions


def _docs(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "documents")


def _pages(spark, sf_dir) -> DataFrame:
    return views.doc_pages(_docs(spark, sf_dir))


def _events(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _ntz(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast("timestamp_ntz"))


def s1_load_versioned(spark, sf_dir):
    good, rest = lineage.load_versioned(views.manifests(_docs(spark, sf_dir)))
    rows = lambda df, loaded: df.select("project_id", "checksum", "schema_version", F.lit(loaded).alias("loaded"))
    return rows(good, True).unionByName(rows(rest, False))


def s2_migrate_manifests(spark, sf_dir):
    good, _ = lineage.load_versioned(views.manifests(_docs(spark, sf_dir)))
    return lineage.migrate_manifests(good).select("project_id", "schema_version", "root_id", "sequence", "operation")


def s6_export_documents(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return exports.export_documents(pages).unionByName(exports.export_documents(pages, "markdown"))


def s6_export_html(spark, sf_dir):
    return exports.export_documents(_pages(spark, sf_dir), "html", 'A "b" & c')


def b5_plain_text_blocks(spark, sf_dir):
    return exports.plain_text_blocks(_docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", "n\\.\n", "n.\n \n").alias("text")))


def e7_inspect_totals(spark, sf_dir):
    n = F.col("page_number")
    fonts = F.array(F.concat(F.lit("F"), F.col("doc_id") % 3), F.concat(F.lit("F"), (n % 2).cast("long")))
    facts = _pages(spark, sf_dir).select("doc_id", F.length("text").alias("characters"), (n % 3).alias("images"), F.regexp_count("text", F.lit("@")).alias("links"), (n % 2).alias("widgets"), fonts.alias("fonts"))
    return exports.inspect_totals(facts)


def _redaction(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return views.spans(docs), views.marks(docs)


def f1_redaction_tokens(spark, sf_dir):
    return governance.redaction_tokens(*_redaction(spark, sf_dir))


def f2_redact_spans(spark, sf_dir):
    return governance.redact_spans(*_redaction(spark, sf_dir)).select("doc_id", "page_number", "span_id", "text")


def f3_verify_redaction(spark, sf_dir):
    spans, marks = _redaction(spark, sf_dir)
    output = governance.span_text(governance.redact_spans(spans, marks))
    return governance.verify_redaction(governance.redaction_tokens(spans, marks), output)


def _logs(spark, sf_dir):
    i = F.col("event_id").cast("string")
    texts = [F.concat(F.lit("(blob:https://host/"), i, F.lit(") lost")), F.concat(F.lit("open FILE:///home/u/"), i), F.concat(F.lit("read /var/data/x"), i, F.lit("/file.txt failed")), F.concat(F.lit('value "'), F.repeat(F.lit("v"), 90), F.lit('" of '), i)]
    return _events(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.element_at(F.array(*texts), (F.col("event_id") % 4 + 1).cast("int")).alias("message"))


def f7_mask_diagnostics(spark, sf_dir):
    return diagnostics.mask_diagnostics(_logs(spark, sf_dir))


def f7_mask_counts(spark, sf_dir):
    return diagnostics.mask_counts(_logs(spark, sf_dir))


def g13_box_collisions(spark, sf_dir):
    return governance.box_collisions(views.spans(_docs(spark, sf_dir)).withColumn("w", F.col("w") * 2))


def h5_bates_numbers(spark, sf_dir):
    return assembly.bates_numbers(_pages(spark, sf_dir).where("page_number % 2 = 1"), "A-", 4, 10, "/x")


def h7_insert_blank_pages(spark, sf_dir):
    return assembly.insert_blank_pages(_pages(spark, sf_dir), 2, "start", 10, 9000)


def i1_reconcile_jobs(spark, sf_dir):
    pages = views.ocr_pages(views.table(spark, sf_dir, "conversations"))
    return jobs.reconcile_jobs(views.ocr_jobs(pages), pages)


def i4_ocr_quality(spark, sf_dir):
    return jobs.ocr_quality(views.ocr_pages(views.table(spark, sf_dir, "conversations")))


def j2_document_lineage(spark, sf_dir):
    return lineage.document_lineage(views.manifests(_docs(spark, sf_dir)))


def j13_isolate_ids(spark, sf_dir):
    pages = _pages(spark, sf_dir).select(F.col("doc_id").alias("project_id"), F.concat(F.lit("obj:"), "page_number").alias("object_id"), F.concat(F.lit("page:"), "page_number").alias("asset_id"), "page_number")
    return lineage.isolate_ids(pages.where("page_number % 2 = 1"), pages)


def _beats(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("session"), (F.col("user_id") % 20).alias("project"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "purchase").alias("clean_exit"))


def k1_interrupted_sessions(spark, sf_dir):
    events = _events(spark, sf_dir)
    return _ntz(flows.interrupted_sessions(flows.last_beats(_beats(events)), events.select(F.max("ts")).scalar()), "at")


def k1_session_stream(spark, sf_dir):
    """The events as a stream, run until it has read all; what it wrote gives the batch form's rows."""
    events = views.table(spark, sf_dir, "events")
    where = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    old = spark.conf.get(next(iter(sessions.STORE)))
    try:
        for key, value in sessions.STORE.items():
            spark.conf.set(key, value)
        events.write.parquet(f"{where}/in")
        states = sessions.session_states(_beats(spark.readStream.schema(events.schema).parquet(f"{where}/in")))
        states.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(next(iter(sessions.STORE)), old)
    newest = events.select(F.max(F.col("ts").cast("timestamp"))).scalar()
    found = sessions.interrupted_now(spark.read.schema(states.schema).parquet(f"{where}/out")).where(F.col("at") >= newest - F.expr(f"interval {flows.DAYS} days"))
    return _ntz(found.select(F.col("project").cast("long").alias("project"), F.col("session").cast("long").alias("session"), "at"), "at")


def k2_receipt_counts(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["document-output", "report", "report", "backup", "other"]))
    receipts = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("kind"), F.col("ts").alias("at"))
    return _ntz(flows.receipt_counts(receipts), "hour")


def k3_history_sessions(spark, sf_dir):
    edits = _events(spark, sf_dir).select(F.col("user_id").alias("owner"), F.when(F.col("event_id") % 10 != 0, F.col("event_type")).alias("merge_key"), F.expr("timestamp_micros(unix_micros(ts) div 1000)").alias("at"))
    return _ntz(flows.history_sessions(edits), "started")


QUERIES = {f.__name__: f for f in (s1_load_versioned, s2_migrate_manifests, s6_export_documents, s6_export_html, b5_plain_text_blocks, e7_inspect_totals, f1_redaction_tokens, f2_redact_spans, f3_verify_redaction, f7_mask_diagnostics, f7_mask_counts, g13_box_collisions, h5_bates_numbers, h7_insert_blank_pages, i1_reconcile_jobs, i4_ocr_quality, j2_document_lineage, j13_isolate_ids, k1_interrupted_sessions, k1_session_stream, k2_receipt_counts, k3_history_sessions)}

_WITH = "with recursive " + views.SQL
_TOKENS = r""", tokens as (select distinct doc_id, page_number, trim(regexp_replace(text, '\s+', ' ', 'g')) as token from touched where visible and length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 3),
kept as (select * from boxes b where not exists (select 1 from touched t where t.doc_id = b.doc_id and t.span_id = b.span_id))"""

ORACLES = {
    "s1_load_versioned": _WITH + " select project_id, checksum, schema_version, schema_version between 1 and 3 as loaded from manifests",
    "s2_migrate_manifests": _WITH + " select project_id, 3::int as schema_version, coalesce(root_id, project_id) as root_id, coalesce(sequence, 0)::int as sequence, coalesce(operation, 'legacy-source') as operation from manifests where schema_version <= 3",
    "s6_export_documents": _WITH + """ select doc_id, 'text' as form, string_agg(text, chr(10) || chr(10) || '--- Page break ---' || chr(10) || chr(10) order by page_number) as body from doc_pages group by doc_id
        union all select doc_id, 'markdown', '# PDF export' || chr(10) || string_agg(chr(10) || '## Page ' || page_number || chr(10) || chr(10) || case when text = '' then '_No extractable text on this page._' else text end, chr(10) order by page_number) from doc_pages group by doc_id""",
    "s6_export_html": _WITH + """ select doc_id, 'html' as form, '<!doctype html><html><head><meta charset="utf-8"><title>A &quot;b&quot; &amp; c</title></head><body><h1>A &quot;b&quot; &amp; c</h1>'
        || string_agg('<section class="page"><h2>Page ' || page_number || '</h2><pre>' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</pre></section>', '' order by page_number) || '</body></html>' as body from doc_pages group by doc_id""",
    "b5_plain_text_blocks": r"""with t as (select doc_id, regexp_split_to_array(regexp_replace(text, 'n\.\n', 'n.' || chr(10) || ' ' || chr(10), 'g'), '\n\s*\n') as ps from documents),
        p as (select doc_id, unnest(ps) as p, generate_subscripts(ps, 1) as i from t), q as (select doc_id, i, regexp_replace(p, '^\s+|\s+$', '', 'g') as p from p)
        select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as pos, replace(p, chr(10), ' ') as text from q where p <> ''""",
    "e7_inspect_totals": _WITH + """ select doc_id, sum(length(text))::bigint as characters, sum(page_number % 3)::bigint as images, sum(length(text) - length(replace(text, '@', '')))::bigint as links, sum(page_number % 2)::bigint as widgets,
        len(list_distinct(list(doc_id % 3) || list((page_number % 2)::bigint)))::int as fonts from doc_pages group by doc_id""",
    "f1_redaction_tokens": _WITH + _TOKENS + " select * from tokens",
    "f2_redact_spans": _WITH + _TOKENS + " select doc_id, page_number, span_id, text from kept",
    "f3_verify_redaction": _WITH + _TOKENS + """, output as (select doc_id, page_number, lower(string_agg(text, ' ' order by y, x, text)) as t from kept group by all),
        hits as (select distinct doc_id, token from tokens join output using (doc_id, page_number) where contains(t, lower(token))), h as (select doc_id, list(token order by token) as found from hits group by 1)
        select d.doc_id, coalesce(len(found), 0)::bigint as left_over, coalesce(array_to_string(found[1:5], '|'), '') as examples, found is null as passed from (select distinct doc_id from tokens) d left join h using (doc_id)""",
    "f7_mask_diagnostics": """with l as (select user_id as owner, event_id as id, row_number() over (partition by user_id order by ts desc, event_id desc) as position from events where event_type = 'error')
        select owner, position, id, case id % 4 when 0 then '([blob-url]) lost' when 1 then 'open [file-url]' when 2 then 'read [local-path] failed' else 'value [long-value] of ' || id end as message from l where position <= 50""",
    "f7_mask_counts": """select ['[blob-url]', '[file-url]', '[local-path]', '[long-value]'][k + 1] as mask, count(event_id) as messages, count(event_id)::bigint as places
        from (select unnest([0, 1, 2, 3]) as k) left join events on event_type = 'error' and event_id % 4 = k group by 1""",
    "g13_box_collisions": _WITH + """ select l.doc_id, l.page_number, l.span_id as a, r.span_id as b from boxes l join boxes r on l.doc_id = r.doc_id and l.page_number = r.page_number and l.span_id < r.span_id
        and l.x < r.x + 2 * r.w and r.x < l.x + 2 * l.w and l.y < r.y + r.h and r.y < l.y + l.h""",
    "h5_bates_numbers": _WITH + " select doc_id, page_number, printf('A-%04d/x', 9 + row_number() over (order by doc_id, page_number)) as label from doc_pages where page_number % 2 = 1",
    "h7_insert_blank_pages": _WITH + """ select doc_id, (page_number + 2)::int as page_number, text, null::double as width, null::double as height from doc_pages
        union all select doc_id, unnest([1, 2])::int, null, 72, 2880 from (select distinct doc_id from doc_pages)""",
    "i1_reconcile_jobs": _WITH + """ select j.job_id, completed_pages, coalesce(actual_pages, 0) as actual_pages, completed_pages <> coalesce(actual_pages, 0) as mismatch
        from ocr_jobs j left join (select job_id, count(*) as actual_pages from ocr_pages where status = 'complete' group by 1) a using (job_id)""",
    "i4_ocr_quality": _WITH + r""" select job_id, status, count(*) as pages, sum(len(regexp_extract_all(coalesce(text, ''), '\S+')))::bigint as words, round(avg(confidence), 6) as confidence from ocr_pages group by 1, 2""",
    "j2_document_lineage": _WITH + """, up(project_id, top, steps) as (select project_id, project_id, 0 from manifests union all
        select u.project_id, m.parent_id, u.steps + 1 from up u join manifests m on m.project_id = u.top join manifests p on p.project_id = m.parent_id)
        select project_id, arg_max(top, steps) as root_id, max(steps)::bigint as sequence from up group by 1""",
    "j13_isolate_ids": _WITH + """ select doc_id as project_id, 'obj:' || page_number as object_id, case when page_number % 2 = 1 then sha256(doc_id || '|page:' || page_number) else 'page:' || page_number end as asset_id from doc_pages""",
    "k1_interrupted_sessions": """with l as (select user_id as session, user_id % 20 as project, ts as "at", event_type = 'purchase' as clean from events qualify row_number() over (partition by user_id order by ts desc, event_type = 'purchase' desc) = 1)
        select project, session, "at" from l where not clean and "at" >= (select max(ts) from events) - interval 7 days qualify row_number() over (partition by project order by "at" desc, session desc) = 1""",
    "k2_receipt_counts": """select date_trunc('hour', ts) as hour, ['document-output', 'report', 'report', 'backup', 'other'][event_id % 5 + 1] as kind, count(*) as receipts from events group by 1, 2""",
    "k3_history_sessions": """with e as (select user_id as owner, event_type as merge_key, epoch_us(ts) // 1000 as us from events where event_id % 10 <> 0),
        g as (select *, case when us - lag(us) over w < 800000 then 0 else 1 end as s from e window w as (partition by owner, merge_key order by us)), h as (select *, sum(s) over (partition by owner, merge_key order by us rows unbounded preceding) as n from g)
        select owner, merge_key, make_timestamp(min(us)::bigint) as started, count(*) as edits from h group by owner, merge_key, n""",
}
ORACLES["k1_session_stream"] = ORACLES["k1_interrupted_sessions"]
