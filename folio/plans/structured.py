"""Queries over the structure of texts, pages and files, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import checks, compliance, exports, ingest, markup
from folio.plans.governed import _docs
from folio.sources import derived, views


def _html(spark, sf_dir):
    return derived.html_pages(views.table(spark, sf_dir, "pages"))


def _markdown(spark, sf_dir):
    return markup.markdown_blocks(derived.md_docs(_docs(spark, sf_dir)))


def _talks(spark, sf_dir):
    return views.table(spark, sf_dir, "conversations")


def b1_html_blocks(spark, sf_dir):
    return markup.html_blocks(_html(spark, sf_dir)).select("page_id", "pos", "type", "level", "number", "text", F.size("runs").alias("runs"))


def b2_html_links(spark, sf_dir):
    return markup.html_links(markup.html_blocks(_html(spark, sf_dir))).groupBy("host", "page_id").agg(F.count("*").alias("links"))


def b3_markdown_blocks(spark, sf_dir):
    return _markdown(spark, sf_dir)


def b4_markdown_runs(spark, sf_dir):
    return markup.markdown_runs(_markdown(spark, sf_dir)).select("doc_id", "pos", "type", "text", F.posexplode_outer("runs").alias("run", "_r")).select("doc_id", "pos", "type", "run", F.coalesce("_r.text", "text").alias("text"), "_r.style", "_r.href")


def b4_run_styles(spark, sf_dir):
    return markup.run_styles(markup.markdown_runs(_markdown(spark, sf_dir)))


def b6_render_blocks(spark, sf_dir):
    plain = F.when(~F.col("type").isin("code", "rule"), F.array(F.struct(F.col("source").alias("text"), F.lit("normal").alias("style"), F.lit(None).cast("string").alias("href"))))
    return markup.render_blocks(_markdown(spark, sf_dir).withColumn("runs", plain).withColumnRenamed("source", "text"))


def b6_render_runs(spark, sf_dir):
    return markup.render_blocks(markup.markdown_runs(_markdown(spark, sf_dir)))


def b7_paginate(spark, sf_dir):
    return markup.paginate(exports.plain_text_blocks(_docs(spark, sf_dir)), width=451, height=700)


def b10_join_lines(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return markup.join_lines(lines.withColumn("part", F.floor(F.col("pos") / views.LINES) + 1).withColumn("script", compliance.script_of(F.col("text"))))


def b11_heading_outline(spark, sf_dir):
    return markup.heading_outline(markup.html_blocks(_html(spark, sf_dir)).withColumnRenamed("page_id", "doc_id"))


def f11_structure_elements(spark, sf_dir):
    found = checks.structure_elements(_html(spark, sf_dir))
    return found.withColumn("path", F.array_join(F.transform("path", lambda p: p.cast("string")), "."))


def f11_accessibility_summary(spark, sf_dir):
    pages = _html(spark, sf_dir)
    return checks.accessibility_summary(pages.select("page_id", (F.col("page_id") % 5 != 0).alias("tagged")), checks.structure_elements(pages))


def _triaged(spark, sf_dir):
    return ingest.container_triage(derived.raw_files(_docs(spark, sf_dir)), "doc_id")


def s3_container_triage(spark, sf_dir):
    return _triaged(spark, sf_dir).withColumn("errors", F.array_join("errors", ","))


def s3_triage_totals(spark, sf_dir):
    return ingest.triage_totals(_triaged(spark, sf_dir))


def s4_ingest_ocr_tsv(spark, sf_dir):
    return ingest.ingest_ocr_tsv(derived.ocr_tsv(_talks(spark, sf_dir)))


def s5_ingest_hocr(spark, sf_dir):
    talks = _talks(spark, sf_dir)
    return ingest.ingest_words(derived.ocr_tsv(talks), derived.hocr(talks))


QUERIES = {f.__name__: f for f in (b1_html_blocks, b2_html_links, b3_markdown_blocks, b4_markdown_runs, b4_run_styles, b6_render_blocks, b6_render_runs, b7_paginate, b10_join_lines, b11_heading_outline, f11_structure_elements, f11_accessibility_summary, s3_container_triage, s3_triage_totals, s4_ingest_ocr_tsv, s5_ingest_hocr)}

_WITH = "with " + views.SQL + "," + derived.SQL
_BLOCKS = r""", ml as (select doc_id, unnest(ls) as raw, generate_subscripts(ls, 1) as n from (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as ls from md_docs)),
mf as (select *, regexp_replace(raw, '\s+$', '') as line, regexp_matches(raw, '^\s*```') as fence from ml),
mg as (select *, sum(fence::int) over (partition by doc_id order by n) as fences from mf),
mk as (select *, case when fence then case when fences % 2 = 1 then 'code' else 'end' end when fences % 2 = 1 then 'code' when line = '' then 'blank' when regexp_matches(line, '^\s*(#{1,6})\s+(.+)$') then 'heading'
    when regexp_matches(line, '^\s*(?:---+|___+|\*\*\*+)\s*$') then 'rule' when regexp_matches(line, '^\s*[-+*]\s+(.+)$') then 'bullet' when regexp_matches(line, '^\s*(\d+)[.)]\s+(.+)$') then 'numbered' when regexp_matches(line, '^\s*>\s?(.*)$') then 'quote' else 'paragraph' end as type from mg),
mb as (select *, sum(case when type = lag_type and (type = 'paragraph' or (type = 'code' and not fence)) then 0 else 1 end) over (partition by doc_id order by n) as block from (select *, lag(type) over (partition by doc_id order by n) as lag_type from mk)),
mp as (select *, case when type = 'heading' then regexp_extract(line, '^\s*(#{1,6})\s+(.+)$', 2) when type = 'bullet' then regexp_extract(line, '^\s*[-+*]\s+(.+)$', 1) when type = 'numbered' then regexp_extract(line, '^\s*(\d+)[.)]\s+(.+)$', 2)
    when type = 'quote' then regexp_extract(line, '^\s*>\s?(.*)$', 1) when type = 'code' then case when not fence then raw end else regexp_replace(line, '^\s+', '') end as part from mb where type not in ('blank', 'end')),
ma as (select doc_id, block, type, max(case when type = 'heading' then length(regexp_extract(line, '^\s*(#{1,6})', 1)) end)::int as level, max(case when type = 'numbered' then try_cast(regexp_extract(line, '^\s*(\d+)', 1) as int) end)::int as number,
    case when type = 'code' then string_agg(part, chr(10) order by n) else string_agg(part, ' ' order by n) end as joined from mp group by doc_id, block, type),
md_blocks as (select doc_id, (row_number() over (partition by doc_id order by block) - 1)::int as pos, type, level, number, case when type = 'rule' then null when type = 'code' then coalesce(joined, '') when type = 'paragraph' then trim(regexp_replace(joined, '\s+', ' ', 'g'))
    else regexp_replace(joined, '^\s+|\s+$', '', 'g') end as source from ma)"""

ORACLES = {
    "b3_markdown_blocks": _WITH + _BLOCKS + " select doc_id, pos, type, level, number, source from md_blocks",
    # the texts are Latin, so no line is without a space for its script
    "b10_join_lines": r"""with l as (select doc_id, i - 1 as pos, regexp_replace(coalesce(ls[i], ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as t from (select doc_id, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null)),
        g as (select doc_id, pos // LINES + 1 as part, list(t order by pos) filter (t <> '') as ts from l group by 1, 2)
        select doc_id, part, case when ts is null then '' else list_reduce(ts, lambda a, t: case when regexp_matches(a, '[A-Za-zÀ-ž]-$') and regexp_matches(t, '^[a-zà-ž]') then left(a, length(a) - 1) || t else a || ' ' || t end) end as text from g""".replace("LINES", str(views.LINES)),
    "b6_render_blocks": _WITH + _BLOCKS + """, e as (select *, replace(replace(replace(replace(source, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as t, case type when 'bullet' then 'ul' when 'numbered' then 'ol' else '' end as kind from md_blocks),
        f as (select *, coalesce(lag(kind) over w, '') as before, coalesce(lead(kind) over w, '') as after from e window w as (partition by doc_id order by pos)),
        g as (select doc_id, pos, case when kind <> '' and kind <> before then '<' || kind || '>' || chr(10) else '' end || case type when 'bullet' then '<li>' || t || '</li>' when 'numbered' then '<li>' || t || '</li>'
            when 'heading' then '<h' || level || '>' || t || '</h' || level || '>' when 'paragraph' then '<p>' || t || '</p>' when 'quote' then '<blockquote>' || t || '</blockquote>' when 'code' then '<pre><code>' || t || '</code></pre>' else '<hr>' end
            || case when kind <> '' and kind <> after then chr(10) || '</' || kind || '>' else '' end as piece from f) select doc_id, string_agg(piece, chr(10) order by pos) as html from g group by 1""",
    "s3_container_triage": _WITH + r""", t as (select doc_id, content, strlen(content) as byte_length, regexp_matches(content, '^%PDF-\d\.\d') as has_header, regexp_matches(right(content, 2048), '%%EOF\s*$') as has_eof from raw_files)
        select doc_id, byte_length, has_header, has_eof, array_to_string(list_filter([case when byte_length = 0 then 'empty-file' end, case when not has_header then 'missing-header' end, case when not has_eof then 'missing-eof' end], lambda e: e is not null), ',') as errors,
        contains(content, '/Encrypt') as encrypted, contains(content, '/ObjStm') as object_streams, contains(content, '/XRef') as xref_streams, contains(content, '/Linearized') as linearized, contains(content, '/Prev') as previous_xref,
        ((length(content) - length(replace(content, 'startxref', ''))) // 9)::int as incremental_updates, byte_length > 0 and has_header and has_eof as valid from t""",
    "s4_ingest_ocr_tsv": r"""with w as (select conv_id as job_id, turn + 1 as page_number, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\r\n]+'), lambda x: x <> '') as ws from conversations where conv_id % 6 <> 0),
        x as (select job_id, page_number, unnest(ws) as text, generate_subscripts(ws, 1) - 1 as i from w)
        select job_id, page_number, (i + 2)::int as pos, text, case when i % 7 = 6 then 0.0 else (60 + i % 40)::double end as confidence, (i * 10)::double as x0, 20.0::double as y0, (i * 10 + 9)::double as x1, 32.0::double as y1 from x""",
    "s5_ingest_hocr": r"""with w as (select conv_id as job_id, turn + 1 as page_number, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\r\n]+'), lambda x: x <> '') as ws from conversations),
        x as (select job_id, page_number, unnest(ws) as text, generate_subscripts(ws, 1) - 1 as i from w)
        select job_id, page_number, case when job_id % 6 = 0 then i else i + 2 end::int as pos, text, case when job_id % 6 = 0 then case when i % 3 = 0 then 0.0 else (60 + i % 40)::double end when i % 7 = 6 then 0.0 else (60 + i % 40)::double end as confidence,
        (i * 10)::double as x0, 20.0::double as y0, (i * 10 + 9)::double as x1, 32.0::double as y1 from x""",
}
ORACLES["s3_triage_totals"] = "with z as (" + ORACLES["s3_container_triage"] + """), f as (select unnest(list_filter([case when valid then 'valid' end, case when encrypted then 'encrypted' end, case when object_streams then 'object_streams' end, case when xref_streams then 'xref_streams' end,
    case when linearized then 'linearized' end, case when previous_xref then 'previous_xref' end, case when incremental_updates > 1 then 'revised' end] || case when errors = '' then [] else string_split(errors, ',') end, lambda e: e is not null)) as fact from z) select fact, count(*) as files from f group by 1"""
