"""Derived input views over the given tables; see FIXTURES.md part 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_pages(docs: DataFrame) -> DataFrame:
    """doc_id, page_number, text: three lines a page, white space collapsed; a row-wise explode, no shuffle."""
    lines = F.split("text", "\n")
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / LINES).cast("int")), lambda i: F.struct((i + 1).alias("page_number"), F.trim(F.regexp_replace(F.array_join(F.slice(lines, i * LINES + 1, LINES), " "), r"\s+", " ")).alias("text")))
    return docs.where("text is not null").select("doc_id", F.inline(pages))


def revised_pages(pages: DataFrame) -> DataFrame:
    """doc_pages after a revision: some pages dropped, some with one word more, numbered anew."""
    key = F.col("doc_id") + F.col("page_number")
    kept = pages.where((key % 7) != 3).withColumn("text", F.when(key % 5 == 0, F.concat("text", F.lit(" revised"))).otherwise(F.col("text")))
    return kept.withColumn("page_number", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number")))


def page_objects(pages: DataFrame) -> DataFrame:
    """doc_id, category, object_id, value: a text object and a pages object for every page."""
    text = pages.select("doc_id", F.lit("text").alias("category"), F.concat(F.lit("page:"), "page_number").alias("object_id"), F.col("text").alias("value"))
    return text.unionByName(pages.select("doc_id", F.lit("pages").alias("category"), F.concat(F.lit("page:"), "page_number").alias("object_id"), F.length("text").cast("string").alias("value")))


def manifests(docs: DataFrame) -> DataFrame:
    """A manifest for every document; those of old versions have no lineage."""
    new = F.col("doc_id") % 5 == 2
    return docs.select(
        F.col("doc_id").alias("project_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("checksum"), (1 + F.col("doc_id") % 5).cast("int").alias("schema_version"),
        F.when(F.col("doc_id") % 9 != 0, F.floor(F.col("doc_id") / 2)).cast("long").alias("parent_id"), F.when(new, F.floor(F.col("doc_id") / 2)).cast("long").alias("root_id"),
        F.when(new, F.col("doc_id") % 4).cast("int").alias("sequence"), F.when(new, "edit").alias("operation"),
    )


def spans(docs: DataFrame) -> DataFrame:
    """Groups of three words as boxes of a page: two or three at the beginning of every line."""
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    groups = lines.select("doc_id", "i", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ").alias("_words"), F.explode(F.sequence(F.lit(0), 1 + F.col("i") % 2)).alias("g"))
    text = F.array_join(F.slice("_words", F.col("g") * 3 + 1, F.lit(3)), " ")
    found = groups.withColumn("text", text).where("text <> ''")
    page = (F.floor(F.col("i") / LINES) + 1).cast("int")
    return found.select("doc_id", page.alias("page_number"), F.concat_ws(":", F.col("i").cast("string"), F.col("g").cast("string")).alias("span_id"), "text", (F.lit(72.0) + 150 * F.col("g")).alias("x"), (F.lit(72.0) + 14 * (F.col("i") % LINES)).alias("y"), (F.length("text") * 5.0).alias("w"), F.lit(12.0).alias("h"))


def marks(docs: DataFrame) -> DataFrame:
    """A redaction box on every page of each fourth document, hidden in each eighth."""
    pages = doc_pages(docs.where("doc_id % 4 = 0")).select("doc_id", "page_number")
    return pages.select("*", F.lit(60.0).alias("x"), F.lit(80.0).alias("y"), F.lit(140.0).alias("w"), F.lit(30.0).alias("h"), (F.col("doc_id") % 8 != 0).alias("visible"))


def ocr_pages(talks: DataFrame) -> DataFrame:
    """Turns of conversations as recognised pages."""
    status = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, "failed").otherwise("complete")
    return talks.select(F.col("conv_id").alias("job_id"), (F.col("turn") + 1).alias("page_number"), "text", status.alias("status"), (60 + (F.col("turn") * 7 + F.col("conv_id")) % 40).alias("confidence"))


def ocr_jobs(pages: DataFrame) -> DataFrame:
    """Jobs of ocr_pages with a stored counter that is wrong in each fifth; some pages have no job."""
    done = F.count_if(F.col("status") == "complete") + F.when(F.col("job_id") % 5 == 0, 1).otherwise(0)
    return pages.where("job_id % 11 <> 10").groupBy("job_id").agg(done.alias("completed_pages"))


#: The same views in SQL, as common table expressions.
SQL = r"""
lines as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
pnum as (select doc_id, ls, unnest(range(0, (len(ls) + 2) // 3)) as i from lines),
doc_pages as (select doc_id, (i + 1)::int as page_number, trim(regexp_replace(array_to_string(ls[i * 3 + 1 : i * 3 + 3], ' '), '\s+', ' ', 'g')) as text from pnum),
revised_pages as (select doc_id, row_number() over (partition by doc_id order by page_number)::int as page_number,
    case when (doc_id + page_number) % 5 = 0 then text || ' revised' else text end as text from doc_pages where (doc_id + page_number) % 7 <> 3),
page_objects as (select doc_id, 'text' as category, 'page:' || page_number as object_id, text as value from doc_pages
    union all select doc_id, 'pages', 'page:' || page_number, length(text)::varchar from doc_pages),
revised_objects as (select doc_id, 'text' as category, 'page:' || page_number as object_id, text as value from revised_pages
    union all select doc_id, 'pages', 'page:' || page_number, length(text)::varchar from revised_pages),
manifests as (select doc_id as project_id, sha256(coalesce(text, '')) as checksum, (1 + doc_id % 5)::int as schema_version, case when doc_id % 9 <> 0 then doc_id // 2 end as parent_id,
    case when doc_id % 5 = 2 then doc_id // 2 end as root_id, case when doc_id % 5 = 2 then (doc_id % 4)::int end as sequence, case when doc_id % 5 = 2 then 'edit' end as operation from documents),
slines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents where text is not null),
sgroups as (select doc_id, i, string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ') as ws, unnest(range(0, 2 + i % 2)) as g from slines),
spans as (select * from (select doc_id, (i // 3 + 1)::int as page_number, i || ':' || g as span_id, array_to_string(ws[g * 3 + 1 : g * 3 + 3], ' ') as text, (72 + 150 * g)::double as x, (72 + 14 * (i % 3))::double as y, 12::double as h from sgroups) where text <> ''),
boxes as (select *, (length(text) * 5)::double as w from spans),
marks as (select doc_id, page_number, 60 as mx, 80 as my, 140 as mw, 30 as mh, doc_id % 8 <> 0 as visible from doc_pages where doc_id % 4 = 0),
touched as (select b.*, m.visible from boxes b join marks m using (doc_id, page_number) where x < mx + mw and mx < x + w and y < my + mh and my < y + h),
ocr_pages as (select conv_id as job_id, turn + 1 as page_number, text, case when (conv_id + turn) % 7 = 0 then 'failed' else 'complete' end as status, 60 + (turn * 7 + conv_id) % 40 as confidence from conversations),
ocr_jobs as (select job_id, count(*) filter (status = 'complete') + case when job_id % 5 = 0 then 1 else 0 end as completed_pages from ocr_pages where job_id % 11 <> 10 group by job_id)
"""
