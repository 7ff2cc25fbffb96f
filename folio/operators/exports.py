"""Documents as text and text as blocks."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.assembly import split_fixed
from folio.sources.files import write_files

ENDINGS = {"text": ".txt", "markdown": ".md", "html": ".html"}
# fixed values: the texts between pages and for a page without text, and the HTML around them
PAGE_BREAK = "\n\n--- Page break ---\n\n"
EMPTY_PAGE = "_No extractable text on this page._"
HTML_HEAD, HTML_BODY, HTML_END = '<!doctype html><html><head><meta charset="utf-8"><title>', "</title></head><body><h1>", "</h1>"


def export_documents(pages: DataFrame, form: str = "text", title: str = "PDF export") -> DataFrame:
    """doc_id, form, body of every document: text, markdown, or html with a title, a section for each page and no style sheet."""
    text = F.coalesce("text", F.lit(""))
    if form == "markdown":
        part, glue, before, after = F.concat(F.lit("\n## Page "), "page_number", F.lit("\n\n"), F.when(F.trim(text) == "", EMPTY_PAGE).otherwise(F.trim(text))), "\n", f"# {title}\n", ""
    elif form == "html":
        safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
        part = F.concat(F.lit('<section class="page"><h2>Page '), "page_number", F.lit("</h2><pre>"), safe(F.trim(text)), F.lit("</pre></section>"))
        name = html.escape(title, quote=True).replace("&#x27;", "'")
        glue, before, after = "", HTML_HEAD + name + HTML_BODY + name + HTML_END, "</body></html>"
    else:
        part, glue, before, after = text, PAGE_BREAK, "", ""
    parts = F.array_sort(F.collect_list(F.struct("page_number", part.alias("part"))))
    body = F.concat(F.lit(before), F.array_join(F.transform(parts, lambda p: p["part"]), glue), F.lit(after))
    return pages.groupBy("doc_id").agg(body.alias("body")).select("doc_id", F.lit(form).alias("form"), "body")


def save_documents(pages: DataFrame, path: str, form: str = "text", title: str = "PDF export", mode: str = "append") -> None:
    """export_documents() as files below path, one for each document, named by its id; all or none."""
    rows = export_documents(pages, form, title)
    write_files(rows.select(F.concat(F.col("doc_id").cast("string"), F.lit(ENDINGS[form])).alias("name"), "body"), path, mode)


def save_chunks(pages: DataFrame, size: int, path: str, mode: str = "append") -> DataFrame:
    """The chunks of split_fixed() as text files <doc_id>/<name>.txt below path, all or none; gives doc_id, chunk, name, page_count, and fails if a chunk's pages are not those its name says."""
    whole = F.raise_error(F.concat(F.lit("pages are missing in "), "doc_id", F.lit("/"), "name"))
    texts = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text")))).alias("_parts")
    rows = split_fixed(pages, size, texts).withColumn("name", F.when(F.col("page_count") == F.col("last_page") - F.col("first_page") + 1, F.col("name")).otherwise(whole.cast("string")))
    chunks, rows = rows.drop("_parts"), rows.withColumn("body", F.array_join(F.transform("_parts", lambda p: p["text"]), PAGE_BREAK))
    write_files(rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), "name", F.lit(".txt")).alias("name"), "body"), path, mode)
    return chunks.select("doc_id", "chunk", "name", "page_count")


def plain_text_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 0), text of the paragraphs between blank lines; line breaks inside become spaces. Null and blank texts have none."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), trimmed), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "text")).withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))


def inspect_totals(pages: DataFrame) -> DataFrame:
    """doc_id, characters, images, links, widgets, fonts (different ones) of page facts."""
    sums = [F.sum(c).alias(c) for c in ("characters", "images", "links", "widgets")]
    return pages.groupBy("doc_id").agg(*sums, F.size(F.array_distinct(F.flatten(F.collect_set("fonts")))).alias("fonts"))
