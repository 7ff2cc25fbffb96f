"""Redaction by spatial and token joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 200.0


def _marks(marks: DataFrame) -> DataFrame:
    return marks.select(*(F.col(c).alias(f"_m_{c}") for c in ("doc_id", "page_number", "x", "y", "w", "h")))


def _touches() -> Column:
    """A span and a mark of the same page overlap; edges that only meet don't."""
    page = (F.col("doc_id") == F.col("_m_doc_id")) & (F.col("page_number") == F.col("_m_page_number"))
    across = (F.col("x") < F.col("_m_x") + F.col("_m_w")) & (F.col("_m_x") < F.col("x") + F.col("w"))
    return page & across & (F.col("y") < F.col("_m_y") + F.col("_m_h")) & (F.col("_m_y") < F.col("y") + F.col("h"))


def redaction_tokens(spans: DataFrame, marks: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, page_number, token: the different texts, of three characters or more, under visible marks."""
    token = F.trim(F.regexp_replace("text", r"\s+", " "))
    return spans.join(_marks(marks.where("visible")), _touches(), "left_semi").select("doc_id", "page_number", token.alias("token")).where(F.length("token") >= least).distinct()


def redact_spans(spans: DataFrame, marks: DataFrame) -> DataFrame:
    """The spans that no mark touches; hidden marks are applied too."""
    return spans.join(_marks(marks), _touches(), "left_anti")


def span_text(spans: DataFrame) -> DataFrame:
    """doc_id, page_number, text of spans in reading order."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "text")))
    return spans.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("text"))


def verify_redaction(tokens: DataFrame, output: DataFrame, most: int = 5) -> DataFrame:
    """doc_id, passed, left_over, examples (the first five) for documents with redacted texts: none may occur on its page of the output, in any case."""
    found = tokens.join(output.select("doc_id", "page_number", F.lower("text").alias("_text")), ["doc_id", "page_number"], "left")
    found = found.withColumn("_hit", F.when(F.coalesce(F.contains("_text", F.lower("token")), F.lit(False)), F.col("token")))
    hits = F.array_sort(F.collect_set("_hit"))
    return found.groupBy("doc_id").agg(F.size(hits).cast("long").alias("left_over"), F.array_join(F.slice(hits, 1, most), "|").alias("examples")).withColumn("passed", F.col("left_over") == 0)


def box_collisions(boxes: DataFrame) -> DataFrame:
    """doc_id, page_number, a, b (span ids, a before b) of boxes that overlap.

    Boxes meet in grid cells; a pair counts in the cell of its overlap's first corner only, so none comes twice.
    """
    cells = lambda start, size: F.sequence(F.floor(F.col(start) / CELL), F.floor((F.col(start) + F.col(size)) / CELL))
    held = boxes.select("doc_id", "page_number", "span_id", "x", "y", "w", "h").withColumn("_cx", F.explode(cells("x", "w"))).withColumn("_cy", F.explode(cells("y", "h")))
    l, r = held.alias("l"), held.alias("r")  # noqa: E741
    c = F.col
    on = (c("l.doc_id") == c("r.doc_id")) & (c("l.page_number") == c("r.page_number")) & (c("l._cx") == c("r._cx")) & (c("l._cy") == c("r._cy")) & (c("l.span_id") < c("r.span_id"))
    for at, size in (("x", "w"), ("y", "h")):
        on &= (c(f"l.{at}") < c(f"r.{at}") + c(f"r.{size}")) & (c(f"r.{at}") < c(f"l.{at}") + c(f"l.{size}"))
        on &= F.floor(F.greatest(f"l.{at}", f"r.{at}") / CELL) == c(f"l._c{at}")
    return l.join(r, on).select(c("l.doc_id").alias("doc_id"), c("l.page_number").alias("page_number"), c("l.span_id").alias("a"), c("r.span_id").alias("b"))
