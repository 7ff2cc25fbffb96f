"""More derived input views over the given tables; see FIXTURES.md part 3. The same views in SQL are in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.sources.views import doc_pages, ocr_jobs, ocr_pages

#: Added to the id of a project that is gone, and to image ids of the two kinds of near copies.
AWAY, LIGHTER, TURNED = 10_000_000, 1_000_000, 2_000_000


def images(embeddings: DataFrame) -> DataFrame:
    """image_id, rgba, width, height: grey images of 8 x 8, and two near copies of each fourth."""
    levels = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v * 64 + 128 + 0.5))).cast("int"))
    rows = embeddings.where("vec_id is not null and size(embedding) = 64").select(F.col("vec_id").alias("image_id"), levels.alias("l"))
    lighter = rows.where("image_id % 4 = 0").select((F.col("image_id") + LIGHTER).alias("image_id"), F.transform("l", lambda v: F.least(F.lit(255), v + 10)).alias("l"))
    turned = rows.where("image_id % 4 = 0").select((F.col("image_id") + TURNED).alias("image_id"), F.transform("l", lambda v, i: F.when(i >= 56, 255 - v).otherwise(v)).alias("l"))
    pixel = lambda v: F.concat(F.repeat(F.lpad(F.hex(v), 2, "0"), F.lit(3)), F.lit("FF"))
    every = rows.unionByName(lighter).unionByName(turned)
    return every.select("image_id", F.unhex(F.array_join(F.transform("l", pixel), "")).alias("rgba"), F.lit(8).alias("width"), F.lit(8).alias("height"))


def md_docs(docs: DataFrame) -> DataFrame:
    """Documents marked up as Markdown by line, some with a fence that stays open."""
    mark = lambda l, i: F.when(i == 0, F.concat(F.lit("# "), l)).when(i % 6 == 2, F.concat(F.lit("- "), l)).when(i % 6 == 3, F.concat(i.cast("string"), F.lit(". "), l)).when(i % 6 == 4, F.concat(F.lit("> "), l)).otherwise(l)
    marked = F.transform(F.split("text", "\n"), lambda l, i: F.concat(mark(l, i), F.when(i % 5 == 4, "\n").otherwise("")))
    text = F.concat(F.array_join(marked, "\n"), F.when(F.col("doc_id") % 11 == 0, "\n```\nopen\n  code").otherwise(""))
    return docs.where("text is not null").select("doc_id", text.alias("text"))


def html_pages(pages: DataFrame) -> DataFrame:
    """Pages, those of even number with links to other hosts."""
    host = F.concat(F.lit('href="https://host'), (F.col("page_id") % 7).cast("string"), F.lit(".example/"))
    return pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit('href="/'), host)).otherwise(F.col("html")).alias("html"))


def raw_files(docs: DataFrame) -> DataFrame:
    """doc_id, content: documents as files of several kinds, whole, torn and empty."""
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 5
    whole = F.concat(F.lit("%PDF-1.7 /Encrypt "), text, F.lit(" startxref 1 startxref 2 %%EOF\n "))
    content = F.when(k == 0, "").when(k == 1, F.concat(text, F.lit(" startxref %%EOF"))).when(k == 2, whole)
    content = content.when(k == 3, F.concat(F.lit("%PDF-1.4 /Linearized /Prev "), text)).otherwise(F.concat(F.lit("%PDF-1.5 /ObjStm /XRef %%EOF"), F.repeat(F.lit("x"), F.lit(3000))))
    return docs.select("doc_id", content.cast("binary").alias("content"))


def _words(talks: DataFrame) -> DataFrame:
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\r\n]+"), lambda w: w != "")
    return talks.select(F.col("conv_id").alias("job_id"), (F.col("turn") + 1).alias("page_number"), words.alias("_w"))


def ocr_tsv(talks: DataFrame) -> DataFrame:
    """job_id, page_number, tsv: words of turns as lines of level 5, after a line of another level; blank for each sixth job."""
    line = lambda w, i: F.concat_ws("\t", F.lit("5"), (i * 10).cast("string"), F.lit("20"), F.lit("9"), F.lit("12"), F.when(i % 7 == 6, "?").otherwise((60 + i % 40).cast("string")), w)
    head = "level\tleft\ttop\twidth\theight\tconf\ttext\n4\t0\t0\t1\t1\t-1\tline\n"
    return _words(talks).select("job_id", "page_number", F.when(F.col("job_id") % 6 == 0, "").otherwise(F.concat(F.lit(head), F.array_join(F.transform("_w", line), "\n"))).alias("tsv"))


def hocr(talks: DataFrame) -> DataFrame:
    """job_id, page_number, hocr: the same words as spans; each third has no confidence."""
    safe = lambda w: F.replace(F.replace(F.replace(w, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    span = lambda w, i: F.concat(F.lit("<span class='ocrx_word' id='w' title='bbox "), (i * 10).cast("string"), F.lit(" 20 "), (i * 10 + 9).cast("string"), F.lit(" 32"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("; x_wconf "), (60 + i % 40).cast("string"))), F.lit("'><b>"), safe(w), F.lit("</b></span>\n"))
    return _words(talks).select("job_id", "page_number", F.array_join(F.transform("_w", span), "").alias("hocr"))


def _away(project, every: int):
    return F.when(project % every == 0, project + AWAY).otherwise(project)


def store(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a store of documents, with faults of every kind; tables has documents, events and conversations."""
    docs, d = tables["documents"].where("text is not null"), F.col("doc_id")
    pages, turns = doc_pages(docs), ocr_pages(tables["conversations"])
    digest = F.sha2(F.col("text").cast("binary"), 256)
    owner = lambda j: F.when(j % 3 != 0, F.when(j % 7 == 0, j + AWAY).otherwise(j))
    events = tables["events"]
    return {
        "projects": docs.select(
            d.alias("project_id"), (F.octet_length("text") + F.when(d % 17 == 0, 1).otherwise(0)).cast("long").alias("byte_length"), F.concat(digest, F.when(d % 19 == 0, "x").otherwise("")).alias("checksum"),
            F.octet_length("text").cast("long").alias("stored_length"), F.when(d % 23 != 0, digest).alias("stored_checksum"), F.when(d % 13 == 0, "ocr").alias("interrupted_job"),
        ),
        "objects": pages.select(d.alias("project_id"), F.concat(F.lit("obj:"), "page_number").alias("object_id"), F.when(F.col("page_number") % 3 == 0, "text").otherwise("image").alias("type"), F.concat(F.lit("page:"), "page_number").alias("asset_id")),
        "assets": pages.where("page_number % 4 <> 2").select(_away(d, 29).alias("project_id"), F.concat(F.lit("page:"), "page_number").alias("asset_id")),
        "jobs": ocr_jobs(turns).select("job_id", owner(F.col("job_id")).alias("project_id"), "completed_pages"),
        "pages": turns.select("job_id", "page_number", owner(F.col("job_id")).alias("project_id"), "status"),
        "events": events.select(F.col("event_id").alias("id"), F.col("user_id").alias("project_id")),
        "checkpoints": events.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("user_id").alias("project_id")),
        "tabs": events.where("event_type = 'signup'").select(F.col("event_id").alias("id"), _away(F.col("user_id"), 3).alias("project_id")),
        "revisions": docs.select(d.alias("id"), _away(d, 31).alias("project_id")),
        "transactions": docs.select(d.alias("id"), _away(d, 37).alias("project_id")),
    }


SQL = r"""
px as (select vec_id as image_id, list_transform(embedding, lambda v: greatest(0, least(255, floor(v::double * 64 + 128 + 0.5)))::int) as l from embeddings where vec_id is not null and len(embedding) = 64),
images as (select * from px union all select image_id + 1000000, list_transform(l, lambda v: least(255, v + 10)) from px where image_id % 4 = 0
    union all select image_id + 2000000, list_transform(l, lambda v, i: case when i > 56 then 255 - v else v end) from px where image_id % 4 = 0),
prints0 as (select image_id, l, list_transform(range(64), lambda i: case when l[(i // 8) * 8 + [0,1,2,3,4,4,5,6,7][i % 8 + 1] + 1] > l[(i // 8) * 8 + [0,1,2,3,4,4,5,6,7][i % 8 + 2] + 1] then '1' else '0' end) as b,
    list_transform(range(72), lambda i: l[(i // 9) * 8 + [0,1,2,3,4,4,5,6,7][i % 9 + 1] + 1]) as s from images),
prints as (select image_id, array_to_string(b, '') as bits, len(list_filter(s, lambda v: v * 0.2126::double + v * 0.7152::double + v * 0.0722::double < 236))::double / 72 as ink, 1.0::double as aspect from prints0),
md_docs as (select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: (case when i = 1 then '# ' || l when (i - 1) % 6 = 2 then '- ' || l when (i - 1) % 6 = 3 then (i - 1) || '. ' || l when (i - 1) % 6 = 4 then '> ' || l else l end)
    || case when (i - 1) % 5 = 4 then chr(10) else '' end), chr(10)) || case when doc_id % 11 = 0 then chr(10) || '```' || chr(10) || 'open' || chr(10) || '  code' else '' end as text from documents where text is not null),
raw_files as (select doc_id, case doc_id % 5 when 0 then '' when 1 then coalesce(text, '') || ' startxref %%EOF' when 2 then '%PDF-1.7 /Encrypt ' || coalesce(text, '') || ' startxref 1 startxref 2 %%EOF' || chr(10) || ' '
    when 3 then '%PDF-1.4 /Linearized /Prev ' || coalesce(text, '') else '%PDF-1.5 /ObjStm /XRef %%EOF' || repeat('x', 3000) end as content from documents),
st_projects as (select doc_id as project_id, strlen(text) + case when doc_id % 17 = 0 then 1 else 0 end as byte_length, sha256(text) || case when doc_id % 19 = 0 then 'x' else '' end as checksum, strlen(text) as stored_length,
    case when doc_id % 23 <> 0 then sha256(text) end as stored_checksum, case when doc_id % 13 = 0 then 'ocr' end as interrupted_job from documents where text is not null),
st_objects as (select doc_id as project_id, 'obj:' || page_number as object_id, case when page_number % 3 = 0 then 'text' else 'image' end as type, 'page:' || page_number as asset_id from doc_pages),
st_assets as (select case when doc_id % 29 = 0 then doc_id + 10000000 else doc_id end as project_id, 'page:' || page_number as asset_id from doc_pages where page_number % 4 <> 2),
st_jobs as (select job_id, case when job_id % 3 <> 0 then case when job_id % 7 = 0 then job_id + 10000000 else job_id end end as project_id, completed_pages from ocr_jobs),
st_pages as (select job_id, page_number, case when job_id % 3 <> 0 then case when job_id % 7 = 0 then job_id + 10000000 else job_id end end as project_id, status from ocr_pages),
st_events as (select event_id as id, user_id as project_id, event_type from events),
st_revisions as (select doc_id as id, case when doc_id % 31 = 0 then doc_id + 10000000 else doc_id end as project_id from documents where text is not null),
st_transactions as (select doc_id as id, case when doc_id % 37 = 0 then doc_id + 10000000 else doc_id end as project_id from documents where text is not null)
"""
