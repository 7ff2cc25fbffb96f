"""Samples of pages, comparison of document profiles, and corpus expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: pages of a sample, tolerance of a page's geometry, metadata that must stay
MOST, TOLERANCE, METADATA = 32, 0.02, ["Title", "Author", "Subject", "Keywords", "Creator"]


def _even(rows: DataFrame, count: Column) -> DataFrame:
    """Of rows(doc_id, page_number, ...) count evenly spaced ones of each document: all if there are no more, the middle one if count is 1."""
    every = Window.partitionBy("doc_id")
    rows = rows.withColumn("_i", F.row_number().over(every.orderBy("page_number")) - 1).withColumn("_n", F.count("*").over(every)).withColumn("_count", count)
    # the k-th pick is at floor(k (n - 1) / (count - 1) + 0.5)
    last, picks = F.greatest(F.col("_n") - 1, F.lit(1)), F.greatest(F.col("_count") - 1, F.lit(1))
    k = F.floor((F.col("_i") - 0.5) * picks / last)
    hit = lambda c: F.floor(c * last / picks + 0.5) == F.col("_i")
    spaced = hit(k) | hit(k + 1) | hit(k + 2)
    keep = F.when(F.col("_count") <= 0, False).when(F.col("_n") <= F.col("_count"), True).when(F.col("_count") == 1, F.col("_i") == F.floor((F.col("_n") - 1) / 2)).otherwise(spaced)
    return rows.where(keep).drop("_i", "_n", "_count")


def sample_pages(counts: DataFrame, affected: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, page_number, reason of at most `most` pages of counts(doc_id, page_count): the first and last, evenly spaced affected(doc_id, page_number), their neighbours in order, evenly spaced others."""
    docs = counts.where("page_count > 0").select("doc_id", F.col("page_count").cast("int").alias("page_count")) if most > 0 else counts.where("false").select("doc_id", "page_count")
    ends = docs.select("doc_id", "page_count", F.explode(F.array_distinct(F.array(F.lit(1), "page_count"))).alias("page_number"))
    room = F.greatest(F.lit(0), F.lit(most) - F.when(F.col("page_count") > 1, 2).otherwise(1))
    hit = affected.select("doc_id", "page_number").distinct().join(docs, "doc_id").where("page_number between 1 and page_count")
    hit = _even(hit, room).select("doc_id", "page_number")
    chosen = ends.select("doc_id", "page_number", F.lit(0).alias("_step")).unionByName(hit.select("doc_id", "page_number", F.lit(1).alias("_step")))
    # neighbours in the order of the affected pages, the one before first; those chosen already take no room
    side = F.explode(F.array(F.struct(F.lit(0).alias("s"), (F.col("page_number") - 1).alias("p")), F.struct(F.lit(1).alias("s"), (F.col("page_number") + 1).alias("p"))))
    near = hit.select("doc_id", F.col("page_number").alias("_from"), side.alias("_x")).join(docs, "doc_id").where("_x.p between 1 and page_count")
    near = near.groupBy("doc_id", F.col("_x.p").alias("page_number")).agg(F.min(F.struct(F.col("_from"), F.col("_x.s"))).alias("_order"))
    near = near.join(chosen.select("doc_id", "page_number"), ["doc_id", "page_number"], "left_anti")
    taken = chosen.select("doc_id", "page_number").distinct().groupBy("doc_id").agg(F.count("*").alias("_taken"))
    near = near.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("_order"))).join(taken, "doc_id").where(F.col("_rank") <= F.lit(most) - F.col("_taken"))
    chosen = chosen.unionByName(near.select("doc_id", "page_number", F.lit(2).alias("_step")))
    taken = chosen.select("doc_id", "page_number").distinct().groupBy("doc_id").agg(F.count("*").alias("_taken"))
    rest = docs.join(taken, "doc_id").where(F.col("_taken") < most).select("doc_id", "_taken", F.explode(F.sequence(F.lit(1), "page_count")).alias("page_number"))
    rest = rest.join(chosen.select("doc_id", "page_number"), ["doc_id", "page_number"], "left_anti")
    rest = _even(rest, F.lit(most) - F.col("_taken")).select("doc_id", "page_number", F.lit(3).alias("_step"))
    reasons = F.array(*map(F.lit, ["end", "affected", "neighbour", "spaced"]))
    found = chosen.unionByName(rest).groupBy("doc_id", "page_number").agg(F.min("_step").alias("_step"))
    return found.select("doc_id", "page_number", F.element_at(reasons, F.col("_step") + 1).alias("reason"))


def _both(source: DataFrame, output: DataFrame, keys: list[str]) -> DataFrame:
    side = lambda df, s: df.select(*keys, F.struct(*(c for c in df.columns if c not in keys)).alias(s))
    return side(source, "s").join(side(output, "o"), keys, "left")


def compare_profiles(source: DataFrame, output: DataFrame, source_pages: DataFrame, output_pages: DataFrame) -> DataFrame:
    """doc_id, level (failure or warning), rule, page_number of what differs between source and output.

    source and output have doc_id, page_count, encrypted, outline_entries, attachments, form_fields, has_javascript,
    labels_digest, metadata (a map); source also affected_pages (a number), incremental_updates, previous_xref,
    linearized. Pages have doc_id, page_number, x0, y0, x1, y1, rotation, user_unit, characters, text_digest, images,
    vectors, annotations, links, widgets; source_pages, the sampled ones, also affected. On affected pages only the
    geometry and the widgets count.
    """
    docs = _both(source, output, ["doc_id"])
    differ = lambda c: ~F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}"))
    named = {"page-count": "page_count", "encryption": "encrypted", "outline": "outline_entries", "attachments": "attachments", "forms": "form_fields", "javascript": "has_javascript", "page-labels": "labels_digest"}
    rules = [F.when(differ(c), rule) for rule, c in named.items()]
    value = lambda side, k: F.coalesce(F.col(f"{side}.metadata")[k], F.lit(""))
    rules += [F.when(value("s", k) != value("o", k), f"metadata-{k}") for k in METADATA]
    failed = docs.select("doc_id", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("rule"))
    failed = failed.select("doc_id", F.lit("failure").alias("level"), "rule", F.lit(None).cast("int").alias("page_number"))

    pages = _both(source_pages, output_pages, ["doc_id", "page_number"])
    far = lambda c: F.abs(F.col(f"s.{c}") - F.col(f"o.{c}")) > TOLERANCE
    gone = F.col("o").isNull()
    view = far("x0") | far("y0") | far("x1") | far("y1") | far("user_unit") | differ("rotation")
    free = ~F.col("s.affected")
    page_rules = [F.when(gone, "page-missing"), F.when(~gone & view, "geometry"), F.when(~gone & differ("widgets"), "widgets"), F.when(~gone & free & (differ("characters") | differ("text_digest")), "text")]
    page_rules += [F.when(~gone & free & differ(c), c) for c in ("images", "vectors", "annotations", "links")]
    on_pages = pages.select("doc_id", "page_number", F.explode(F.filter(F.array(*page_rules), lambda r: r.isNotNull())).alias("rule"))
    on_pages = on_pages.select("doc_id", F.lit("failure").alias("level"), "rule", F.col("page_number").cast("int").alias("page_number"))

    sampled = source_pages.groupBy("doc_id").agg(F.count_if("affected").alias("_sampled"))
    told = source.join(sampled, "doc_id", "left").select("doc_id", F.explode(F.filter(F.array(
        F.when(F.coalesce("_sampled", F.lit(0)) < F.col("affected_pages"), "sampled"),
        F.when((F.col("incremental_updates") > 1) | F.col("previous_xref"), "revisions"),
        F.when(F.col("linearized"), "linearized"),
    ), lambda r: r.isNotNull())).alias("rule"))
    told = told.select("doc_id", F.lit("warning").alias("level"), "rule", F.lit(None).cast("int").alias("page_number"))
    return failed.unionByName(on_pages).unionByName(told)


def profile_verdict(source: DataFrame, differences: DataFrame) -> DataFrame:
    """doc_id, passed, failures, warnings of every document of source."""
    counts = differences.groupBy("doc_id").agg(F.count_if(F.col("level") == "failure").alias("failures"), F.count_if(F.col("level") == "warning").alias("warnings"))
    return source.select("doc_id").join(counts, "doc_id", "left").na.fill(0).withColumn("passed", F.col("failures") == 0)


def validate_corpus(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """file_id, check, engine, passed of every expectation.

    expected(file_id, checksum, malformed, encrypted, pages, bookmarks, annotations_min, links_min, form_fields_min,
    text, text_absent), where a null is no expectation; observed(file_id, engine, checksum, error, encrypted, pages,
    bookmarks, annotations, links, form_fields, text), a row for each engine. A malformed file must fail; a file that
    an engine cannot read has that as its only check.
    """
    rows = expected.select("file_id", F.struct(*(c for c in expected.columns if c != "file_id")).alias("e")).join(observed.select("file_id", "engine", F.struct(*(c for c in observed.columns if c not in ("file_id", "engine"))).alias("o")), "file_id", "left")
    e, o = (lambda c: F.col(f"e.{c}")), (lambda c: F.col(f"o.{c}"))
    check = lambda name, passed: F.struct(name.alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"))
    named = lambda name, asked, passed: F.when(asked, check(F.lit(name), passed))
    malformed = F.coalesce(e("malformed"), F.lit(False))
    unread = o("error").isNotNull() | F.col("o").isNull()
    single = F.array(
        named("checksum", e("checksum").isNotNull(), e("checksum") == o("checksum")),
        named("readable", unread | malformed, unread == malformed),
        *(named(c, e(c).isNotNull() & ~unread, e(c) == o(c)) for c in ("pages", "bookmarks")),
        *(named(c, e(f"{c}_min").isNotNull() & ~unread, o(c) >= e(f"{c}_min")) for c in ("annotations", "links", "form_fields")),
        named("encrypted", F.coalesce(e("encrypted"), F.lit(False)) & ~unread, o("encrypted")),
    )
    empty = F.array().cast("array<string>")
    marks = lambda c, inside: F.transform(F.when(unread, empty).otherwise(F.coalesce(e(c), empty)), lambda m: check(F.concat(F.lit("text:" if inside else "text-absent:"), m), F.contains(o("text"), m) if inside else ~F.contains(o("text"), m)))
    checks = F.concat(F.filter(single, lambda c: c.isNotNull()), marks("text", True), marks("text_absent", False))
    return rows.select("file_id", "engine", F.inline(checks))


def corpus_verdict(checks: DataFrame) -> DataFrame:
    """file_id, checks, failed, passed: all checks of all engines."""
    return checks.groupBy("file_id").agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"), F.bool_and("passed").alias("passed"))
