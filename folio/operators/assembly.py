"""Page selection, splitting and imposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.storage import written


def select_pages(requests: DataFrame) -> DataFrame:
    """doc_id, page_number, error of requests(doc_id, expression, page_count): a row for each page or bad token (tokens and messages are fixed values).

    Tokens are all, odd, even, last, a number or a range of numbers and last; ! excludes. Exclusions alone start from all pages.
    """
    tokens = F.filter(F.transform(F.split("expression", ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    rows = requests.select("doc_id", "page_count", F.explode(tokens).alias("raw"))
    rows = rows.withColumn("exclude", F.col("raw").startswith("!")).withColumn("token", F.expr("if(exclude, substring(raw, 2), raw)"))
    end = lambda k: F.when(F.regexp_extract("token", r"^(\d+|last)-(\d+|last)$", k) == "last", F.col("page_count")).otherwise(F.expr(f"try_cast(regexp_extract(token, '^([0-9]+|last)-([0-9]+|last)$', {k}) as int)"))
    rows = rows.withColumn("a", end(1)).withColumn("b", end(2)).withColumn("n", F.expr("if(token rlike '^[0-9]+$', try_cast(token as int), null)"))
    low = F.when(F.col("token").isin("all", "odd"), 1).when(F.col("token") == "even", 2).when(F.col("token") == "last", F.col("page_count")).when(F.col("n").isNotNull(), F.col("n")).otherwise(F.greatest(F.lit(1), F.least("a", "b")))
    high = F.when(F.col("token").isin("all", "odd", "even", "last"), F.col("page_count")).when(F.col("n").isNotNull(), F.col("n")).otherwise(F.least("page_count", F.greatest("a", "b")))
    step = F.when(F.col("token").isin("odd", "even"), 2).otherwise(1)
    # fixed values: the messages
    bad = F.when(F.col("token").rlike("^[0-9]+$") & ~F.coalesce((F.col("n") >= 1) & (F.col("n") <= F.col("page_count")), F.lit(False)), F.concat(F.lit("Page "), F.regexp_replace("token", "^0+(?=[0-9])", ""), F.lit(" is outside 1-"), F.col("page_count"), F.lit(".")))
    named = F.col("token").isin("all", "odd", "even", "last") | F.col("token").rlike("^[0-9]+$")
    bad = bad.when(~named & (F.col("a").isNull() | F.col("b").isNull()), F.concat(F.lit("Unsupported token: "), F.col("raw")))
    rows = rows.withColumn("error", bad)
    pages = F.when(F.col("error").isNull() & (low <= high), F.sequence(low, high, step))
    hits = rows.select("doc_id", "exclude", F.explode(pages).alias("page_number"))
    only_out = rows.groupBy("doc_id", "page_count").agg(F.bool_and("exclude").alias("_only")).where("_only").select("doc_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page_number"))
    inside = hits.where("not exclude").select("doc_id", "page_number").unionByName(only_out).distinct()
    kept = inside.join(hits.where("exclude"), ["doc_id", "page_number"], "left_anti")
    errors = rows.where("error is not null").select("doc_id", F.lit(None).cast("int").alias("page_number"), "error")
    return kept.withColumn("error", F.lit(None).cast("string")).select("doc_id", "page_number", "error").unionByName(errors)


def chunk_of(page: Column, size: float) -> Column:
    """The chunk, from 0, that a page is in; chunks have size pages (rounded, 1 to 500)."""
    return F.floor((page - 1) / max(1, min(500, int(size + 0.5)))).cast("int")


def split_fixed(pages: DataFrame, size: float, *more: Column) -> DataFrame:
    """doc_id, chunk, name, first_page, last_page, page_count, and more aggregates, of parts of size pages (rounded, 1 to 500)."""
    parts = pages.groupBy("doc_id", chunk_of(F.col("page_number"), size).alias("chunk"))
    parts = parts.agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count("*").alias("page_count"), *more)
    return parts.withColumn("name", F.format_string("pages-%04d-%04d", "first_page", "last_page"))


def imposition(counts: DataFrame, layout: str = "booklet", direction: str = "ltr") -> DataFrame:
    """doc_id, side, slot, page_number (null for a blank) of counts(doc_id, page_count); layout is 2-up, 4-up or booklet."""
    if layout != "booklet":
        per = 4 if layout == "4-up" else 2
        sides = counts.withColumn("side", F.explode(F.sequence(F.lit(0), F.ceil(F.col("page_count") / per).cast("int") - 1)))
        slots = sides.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(per - 1)))).withColumn("_page", F.col("side") * per + F.col("slot") + 1)
    else:
        padded = (F.ceil(F.col("page_count") / 4) * 4).cast("int")
        sides = counts.withColumn("_padded", padded).withColumn("side", F.explode(F.sequence(F.lit(0), (F.col("_padded") / 2 - 1).cast("int"))))
        # outer sides take the last page first, inner sides the first
        front, back = F.col("side") + 1, F.col("_padded") - F.col("side")
        order = F.when(F.col("side") % 2 == 0, F.array(back, front)).otherwise(F.array(front, back))
        slots = sides.select("*", F.posexplode(F.reverse(order) if direction == "rtl" else order).alias("slot", "_page"))
    return slots.where("page_count > 0").select("doc_id", "side", "slot", F.when(F.col("_page") <= F.col("page_count"), F.col("_page")).cast("int").alias("page_number"))


def insert_blank_pages(pages: DataFrame, count: int, at: str = "end", width: float = 612, height: float = 792) -> DataFrame:
    """doc_id, page_number, text, width, height: 1 to 20 blank pages (null text) before or after the pages of every document; their sides are 72 to 2880."""
    n = max(1, min(20, count))
    side = lambda v: F.lit(float(max(72, min(2880, v))))
    last = F.lit(0) if at == "start" else F.col("_last")
    blanks = pages.groupBy("doc_id").agg(F.max("page_number").alias("_last")).select("doc_id", F.explode(F.sequence(last + 1, last + n)).alias("page_number"), F.lit(None).cast("string").alias("text"), side(width).alias("width"), side(height).alias("height"))
    moved = F.col("page_number") + (n if at == "start" else 0)
    return blanks.unionByName(pages.select("doc_id", moved.cast("int").alias("page_number"), "text", F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height")))


def bates_numbers(pages: DataFrame, prefix: str = "", digits: int = 6, start: int = 1, suffix: str = "") -> DataFrame:
    """doc_id, page_number, label: one running number over all the pages, in order of document and page.

    Documents are dealt out by ranges of their ids; a sum for each range is all that goes through one task.
    """
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("_n"))
    ranged = written(counts.repartitionByRange("doc_id").withColumn("_part", F.spark_partition_id()))
    so_far = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("_part").agg(F.sum("_n").alias("_sum")).select("_part", so_far(Window.orderBy("_part"), "_sum").alias("_base"))
    docs = ranged.withColumn("_within", so_far(Window.partitionBy("_part").orderBy("doc_id"), "_n")).join(F.broadcast(parts), "_part").select("doc_id", (F.col("_base") + F.col("_within")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number"))
    number = (F.col("_before") + rank + (start - 1)).cast("string")
    padded = F.when(F.length(number) >= digits, number).otherwise(F.lpad(number, digits, "0"))
    return pages.select("doc_id", "page_number").join(docs, "doc_id").select("doc_id", "page_number", F.concat(F.lit(prefix), padded, F.lit(suffix)).alias("label"))


def merge_documents(pages: DataFrame) -> DataFrame:
    """merge_id, page_number, doc_id, source_page, lead (the first source, whose metadata wins) of pages(merge_id, source_index, doc_id, page_number)."""
    sources = pages.groupBy("merge_id", "source_index").agg(F.max("page_number").alias("_n"), F.min("doc_id").alias("_doc"))
    order = Window.partitionBy("merge_id").orderBy("source_index")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sources.select("merge_id", "source_index", before.alias("_before"), F.first("_doc").over(order).alias("lead"))
    return pages.join(offsets, ["merge_id", "source_index"]).select("merge_id", (F.col("_before") + F.col("page_number")).alias("page_number"), "doc_id", F.col("page_number").alias("source_page"), "lead")
