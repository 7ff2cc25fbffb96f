"""Queries over profiles, rules and page geometry, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import checks, fidelity, geometry
from folio.plans.governed import _docs, _pages
from folio.sources import views

SAMPLE = 6


def _counts(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))


def e5_sample_pages(spark, sf_dir):
    affected = _pages(spark, sf_dir).where("(doc_id + page_number) % 4 = 1").select("doc_id", "page_number")
    return fidelity.sample_pages(_counts(spark, sf_dir), affected, SAMPLE)


def _profiles(spark, sf_dir):
    docs, pages, counts = _docs(spark, sf_dir).where("text is not null"), _pages(spark, sf_dir), _counts(spark, sf_dir)
    d, n = F.col("doc_id"), F.col("page_number")
    base = docs.select("doc_id", "lang", "source").join(counts, "doc_id")
    source = base.select(
        "doc_id", "page_count", (d % 2 == 0).alias("encrypted"), (d % 5).alias("outline_entries"), (d % 3).alias("attachments"), (d % 4).alias("form_fields"), F.lit(False).alias("has_javascript"), F.lit("l").alias("labels_digest"),
        F.create_map(F.lit("Title"), F.coalesce("lang", F.lit("")), F.lit("Author"), F.coalesce("source", F.lit(""))).alias("metadata"), F.floor(F.col("page_count") / 3).cast("int").alias("affected_pages"),
        (d % 6).alias("incremental_updates"), (d % 7 == 0).alias("previous_xref"), (d % 9 == 0).alias("linearized"),
    )
    changed = F.create_map(F.lit("Title"), F.coalesce("lang", F.lit("")), F.lit("Author"), F.when(d % 11 == 0, "someone").otherwise(F.coalesce("source", F.lit(""))))
    output = base.select(
        "doc_id", (F.col("page_count") + F.when(d % 13 == 0, 1).otherwise(0)).alias("page_count"), (d % 2 == 0).alias("encrypted"), F.when(d % 10 == 3, 9).otherwise(d % 5).alias("outline_entries"), (d % 3).alias("attachments"), F.when(d % 17 == 0, 8).otherwise(d % 4).alias("form_fields"),
        (d % 19 == 0).alias("has_javascript"), F.when(d % 23 == 0, "m").otherwise("l").alias("labels_digest"), changed.alias("metadata"),
    )
    box = lambda shift: [F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.lit(612.0) + shift).alias("x1"), F.lit(792.0).alias("y1")]
    facts = lambda extra: [F.length("text").alias("characters"), F.sha2(F.col("text").cast("binary"), 256).alias("text_digest"), (n % 3 + extra).alias("images"), (n % 4).alias("vectors"), (n % 2).alias("annotations"), F.regexp_count("text", F.lit("@")).alias("links"), (n % 5).alias("widgets")]
    shift = F.when((d + n) % 8 == 0, 0.5).when((d + n) % 8 == 1, 0.01).otherwise(0.0)
    one = F.lit(1.0).alias("user_unit")
    source_pages = pages.select("doc_id", "page_number", *box(F.lit(0.0)), (d % 4 * 90).alias("rotation"), one, *facts(F.lit(0)), (n % 3 == 0).alias("affected"))
    output_pages = views.revised_pages(pages).select("doc_id", "page_number", *box(shift), (d % 4 * 90).alias("rotation"), one, *facts(F.when((d + n) % 6 == 0, 1).otherwise(0)))
    return source, output, source_pages, output_pages


def e6_compare_profiles(spark, sf_dir):
    return fidelity.compare_profiles(*_profiles(spark, sf_dir))


def e6_profile_verdict(spark, sf_dir):
    profiles = _profiles(spark, sf_dir)
    return fidelity.profile_verdict(profiles[0], fidelity.compare_profiles(*profiles))


def e9_validate_corpus(spark, sf_dir):
    d = F.col("doc_id")
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    docs = _docs(spark, sf_dir).where("text is not null").join(_counts(spark, sf_dir), "doc_id")
    expected = docs.select(
        d.alias("file_id"), F.when(d % 3 == 0, digest).alias("checksum"), (d % 8 == 0).alias("malformed"), (d % 5 == 0).alias("encrypted"), (F.col("page_count") + F.when(d % 13 == 0, 1).otherwise(0)).alias("pages"), F.lit(None).cast("int").alias("bookmarks"),
        F.when(d % 2 == 0, 2).alias("annotations_min"), F.lit(None).cast("int").alias("links_min"), F.lit(1).alias("form_fields_min"), F.array(F.get(words, F.lit(0)), F.element_at(words, -1)).alias("text"), F.array(F.lit("revised")).alias("text_absent"),
    )
    engines = F.explode(F.array(F.lit("one"), F.lit("two"))).alias("engine")
    observed = docs.select("*", engines).select(
        d.alias("file_id"), "engine", digest.alias("checksum"), F.when((d % 16 == 0) | ((d % 21 == 0) & (F.col("engine") == "two")), "broken").alias("error"), (d % 10 == 0).alias("encrypted"), F.col("page_count").alias("pages"), F.lit(0).alias("bookmarks"),
        (d % 4).alias("annotations"), F.lit(0).alias("links"), (d % 7).alias("form_fields"), F.concat("text", F.when(d % 9 == 0, " revised").otherwise("")).alias("text"),
    )
    return fidelity.corpus_verdict(fidelity.validate_corpus(expected, observed))


def _inspections(spark, sf_dir):
    d = F.col("doc_id")
    facts = _pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("page_count"), F.sum(F.regexp_count("text", F.lit("@"))).alias("links"))
    return facts.select(
        "doc_id", "page_count", (d % 4 == 0).alias("opens_without_password"), (d % 3 == 0).alias("encrypted"), (d % 5).alias("redaction_marks"), F.when(d % 7 == 0, F.array(F.lit("aa"), F.lit("bb"))).alias("tokens_left"), (d % 6).alias("tokens_sought"), (d % 2).alias("form_mismatches"),
        (d % 8 == 0).alias("has_javascript"), F.lit(False).alias("has_open_action"), F.lit(None).cast("boolean").alias("has_additional_actions"), (d % 3).alias("attachments"), "links", (d % 4).alias("annotations"),
        F.when(d % 2 == 0, F.create_map(F.lit("Title"), F.lit("t"))).alias("metadata"), (d % 9).alias("filled_fields"), (d % 10).alias("fields"),
    )


def f6_security_checks(spark, sf_dir):
    d = F.col("doc_id")
    facts = _inspections(spark, sf_dir)
    on = lambda k, name: (F.floor(d / k) % 2 == 0).alias(name)
    options = facts.select(
        "doc_id", (F.col("page_count") + F.when(d % 11 == 0, 1).otherwise(0)).alias("expected_pages"), F.element_at(F.array(*map(F.lit, ["keep", "aes-256", "remove"])), (d % 3 + 1).cast("int")).alias("encryption"), on(2, "redaction"), (d % 3).alias("form_updates"),
        on(3, "remove_javascript"), F.lit(None).cast("boolean").alias("remove_open_actions"), on(4, "remove_attachments"), on(5, "remove_links"), on(6, "remove_comments"), on(7, "remove_metadata"), on(8, "clear_form_values"), on(9, "flatten_forms"), on(10, "flatten_annotations"),
    )
    return checks.security_checks(facts, options)


def f10_preflight(spark, sf_dir):
    d = F.col("doc_id")
    labels = views.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    base = _docs(spark, sf_dir).where("text is not null").select("doc_id", "lang").join(labels, "doc_id", "left").join(_counts(spark, sf_dir), "doc_id")
    facts = base.select(
        "doc_id", (d % 5 == 0).alias("encrypted"), (d % 4).alias("fonts"), (d % 3).alias("embedded_fonts"), (F.coalesce("toxic", F.lit(0)) == 1).alias("unsafe_actions"), (d % 3).alias("output_intents"), (d % 2).alias("embedded_intents"), (d % 7 == 0).alias("pdfa_claimed"),
        (d % 6).alias("attachments"), F.element_at(F.array(*map(F.lit, ["missing", "baseline", "partial", "meaningful"])), (d % 4 + 1).cast("int")).alias("structure"), F.col("lang").alias("language"), F.when(F.col("quality") == 1, "good").otherwise("").alias("title"),
        (F.col("page_count") % 2).alias("figures_without_alt"), F.lit(None).cast("int").alias("fields_without_tooltip"), (d % 2).alias("pages_without_trim"), F.lit(0).alias("pages_without_bleed"), (F.col("page_count") % 3).alias("transparent_pages"), F.lit(0).alias("overprint_pages"),
        (d % 9 == 0).alias("has_xfa"), (F.col("doc_id") % 8 == 0).cast("int").alias("bad_signatures"), (F.col("doc_id") % 4 == 0).cast("int").alias("stale_signatures"),
    )
    return checks.preflight(facts)


def f10_preflight_summary(spark, sf_dir):
    return checks.preflight_summary(f10_preflight(spark, sf_dir))


def _spans(spark, sf_dir):
    return views.spans(_docs(spark, sf_dir))


def g1_transform_boxes(spark, sf_dir):
    d = F.col("doc_id")
    spans = _spans(spark, sf_dir)
    boxes = spans.select("doc_id", "page_number", F.col("span_id").alias("object_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    pages = _pages(spark, sf_dir).select("doc_id", "page_number", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.when(d % 12 != 7, 1 + d % 3 / 2).otherwise(0.0).alias("zoom"), (90 * (d % 4)).cast("int").alias("rotation"))
    return geometry.transform_boxes(boxes, pages)


def _lines(spark, sf_dir):
    spans = _spans(spark, sf_dir).withColumn("size", 10.0 + F.split("span_id", ":")[0].cast("int") % 3)
    return geometry.visual_lines(spans)


def g2_visual_lines(spark, sf_dir):
    return _lines(spark, sf_dir).withColumn("spans", F.array_join("spans", ","))


def _set_lines(spark, sf_dir):
    """Lines of a page in blocks of up to three, in a font and size each."""
    lines = _docs(spark, sf_dir).where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    i, size = F.col("i"), F.length(F.col("text"))
    return lines.select("doc_id", (F.floor(i / views.LINES) + 1).cast("int").alias("page_number"), (F.col("doc_id") % 3).alias("block"), i.alias("line"), (72.0 + 5 * (i % 2)).alias("x"), (72.0 + 14 * (i % views.LINES)).alias("y"), F.least(F.lit(400.0), size * 1.0).alias("w"), F.lit(12.0).alias("h"), F.concat(F.lit("F"), (i % 2).cast("string")).alias("font"), (10.0 + i % 3).alias("size"))


def g3_paragraphs(spark, sf_dir):
    found = geometry.paragraphs(_set_lines(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("size", "line_height")})


def g4_text_flows(spark, sf_dir):
    d = F.col("doc_id")
    blocks = _spans(spark, sf_dir).select("doc_id", "page_number", F.col("span_id").alias("object_id"), "x", "y", "w", "h", F.when(d % 9 == 0, "rtl").otherwise("ltr").alias("direction"))
    pages = _pages(spark, sf_dir).select("doc_id", "page_number", F.lit(612.0).alias("width"))
    tables = _pages(spark, sf_dir).where("doc_id % 5 = 0").select("doc_id", "page_number", F.lit(60.0).alias("x"), F.lit(80.0).alias("y"), F.lit(140.0).alias("w"), F.lit(30.0).alias("h"))
    return geometry.text_flows(blocks, pages, tables)


def g6_cluster_values(spark, sf_dir):
    edges = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("value")), F.struct(F.lit("x").alias("axis"), (F.col("x") + F.col("w")).alias("value")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("value"))))
    return geometry.cluster_values(_spans(spark, sf_dir).select("doc_id", "page_number", edges.alias("_e")).select("doc_id", "page_number", "_e.axis", "_e.value")).withColumn("value", F.round("value", 6))


def g7_aligned_text_tables(spark, sf_dir):
    return geometry.aligned_text_tables(_spans(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


def _vectors(spark, sf_dir):
    """Grids of rectangles, grids of lines, and an image in some."""
    d, r, c = F.col("doc_id"), F.col("r"), F.col("c")
    some = _pages(spark, sf_dir).where("doc_id % 5 = 0").select("doc_id", "page_number")
    cells = some.withColumn("r", F.explode(F.sequence(F.lit(0), (1 + d % 4).cast("int")))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2))))
    rects = cells.where("doc_id % 10 = 0 and not (doc_id % 15 = 0 and r = 0 and c = 1)").select("doc_id", "page_number", F.concat_ws(":", r.cast("string"), c.cast("string")).alias("vector_id"), F.lit("rect").alias("kind"), (72.0 + 150 * c).alias("x"), (72.0 + 14 * r).alias("y"), F.when((d % 15 == 0) & (r == 0) & (c == 0), 300.0).otherwise(150.0).alias("w"), F.lit(14.0).alias("h"))
    across = cells.where("doc_id % 10 = 5 and c = 0").select("doc_id", "page_number", F.concat(F.lit("h"), r).alias("vector_id"), F.lit("line").alias("kind"), F.lit(72.0).alias("x"), (72.0 + 20 * r).alias("y"), F.lit(300.0).alias("w"), F.lit(1.0).alias("h"))
    down = cells.where("doc_id % 10 = 5 and r = 0").select("doc_id", "page_number", F.concat(F.lit("v"), c).alias("vector_id"), F.lit("line").alias("kind"), (72.0 + 150 * c).alias("x"), F.lit(72.0).alias("y"), F.lit(1.0).alias("w"), F.lit(100.0).alias("h"))
    art = some.where("page_number % 3 = 0").select("doc_id", "page_number", F.lit("i").alias("vector_id"), F.lit("image").alias("kind"), F.lit(80.0).alias("x"), F.lit(75.0).alias("y"), F.lit(8.0).alias("w"), F.lit(8.0).alias("h"))
    return rects.unionByName(across).unionByName(down).unionByName(art)


def g8_grid_tables(spark, sf_dir):
    return geometry.grid_tables(_vectors(spark, sf_dir)).withColumns({c: F.array_join(F.transform(c, lambda v: F.round(v, 3).cast("string")), ",") for c in ("xs", "ys")}).withColumn("confidence", F.round("confidence", 6))


def g9_assign_cells(spark, sf_dir):
    tables = _pages(spark, sf_dir).where("doc_id % 2 = 0").select("doc_id", "page_number", F.lit(0).alias("table_id"), F.array(*map(F.lit, [70.0, 220.0, 370.0, 520.0])).alias("xs"), F.array(*map(F.lit, [72.0, 86.0, 100.0])).alias("ys"))
    return geometry.assign_cells(_spans(spark, sf_dir), tables)


def g10_dedupe_tables(spark, sf_dir):
    tables = _pages(spark, sf_dir).select("doc_id", "page_number", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("table_id"))
    k, d = F.col("table_id"), F.col("doc_id")
    return geometry.dedupe_tables(tables.select("doc_id", "page_number", "table_id", (72.0 + k * (d % 7)).alias("x"), (72.0 + k * (d % 3)).alias("y"), F.lit(100.0).alias("w"), (40.0 + k).alias("h")))


QUERIES = {f.__name__: f for f in (e5_sample_pages, e6_compare_profiles, e6_profile_verdict, e9_validate_corpus, f6_security_checks, f10_preflight, f10_preflight_summary, g1_transform_boxes, g2_visual_lines, g3_paragraphs, g4_text_flows, g6_cluster_values, g7_aligned_text_tables, g8_grid_tables, g9_assign_cells, g10_dedupe_tables)}

_WITH = "with " + views.SQL
_PROFILES = """, n as (select doc_id, count(*)::int as c from doc_pages group by 1), diff as (
    select doc_id, 'failure' as level, unnest(list_filter([case when doc_id % 13 = 0 then 'page-count' end, case when doc_id % 10 = 3 then 'outline' end, case when doc_id % 17 = 0 then 'forms' end, case when doc_id % 19 = 0 then 'javascript' end,
        case when doc_id % 23 = 0 then 'page-labels' end, case when doc_id % 11 = 0 and coalesce(source, '') <> 'someone' then 'metadata-Author' end], lambda x: x is not null)) as rule, null::int as page_number from documents where text is not null
    union all select s.doc_id, 'failure', unnest(list_filter([case when r.doc_id is null then 'page-missing' end, case when r.doc_id is not null and (s.doc_id + s.page_number) % 8 = 0 then 'geometry' end,
        case when s.page_number % 3 <> 0 and r.text <> s.text then 'text' end, case when s.page_number % 3 <> 0 and r.doc_id is not null and (s.doc_id + s.page_number) % 6 = 0 then 'images' end,
        case when s.page_number % 3 <> 0 and length(r.text) - length(replace(r.text, '@', '')) <> length(s.text) - length(replace(s.text, '@', '')) then 'links' end], lambda x: x is not null)), s.page_number from doc_pages s left join revised_pages r using (doc_id, page_number)
    union all select doc_id, 'warning', unnest(list_filter([case when doc_id % 6 > 1 or doc_id % 7 = 0 then 'revisions' end, case when doc_id % 9 = 0 then 'linearized' end], lambda x: x is not null)), null from documents where text is not null)"""

ORACLES = {
    "e6_compare_profiles": _WITH + _PROFILES + " select doc_id, level, rule, page_number from diff",
    "e6_profile_verdict": _WITH + _PROFILES + """ select doc_id, count(level) filter (level = 'failure') as failures, count(level) filter (level = 'warning') as warnings, count(level) filter (level = 'failure') = 0 as passed from n left join diff using (doc_id) group by 1""",
    "e9_validate_corpus": _WITH + r""", n as (select doc_id, count(*) as c from doc_pages group by 1), w as (select doc_id as d, text, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as ws, unnest(['one', 'two']) as engine from documents where text is not null),
        o as (select *, d % 16 = 0 or (d % 21 = 0 and engine = 'two') as bad, text || case when d % 9 = 0 then ' revised' else '' end as seen from w),
        k as (select d, unnest(list_filter([case when d % 3 = 0 then true end, case when bad or d % 8 = 0 then bad = (d % 8 = 0) end, case when not bad then d % 13 <> 0 end, case when d % 2 = 0 and not bad then d % 4 >= 2 end, case when not bad then d % 7 >= 1 end,
            case when d % 5 = 0 and not bad then d % 10 = 0 end, case when not bad then contains(seen, ws[1]) end, case when not bad then contains(seen, ws[-1]) end, case when not bad then not contains(seen, 'revised') end], lambda x: x is not null)) as passed from o)
        select d as file_id, count(*) as checks, count(*) filter (not passed) as failed, bool_and(passed) as passed from k group by 1""",
    "f6_security_checks": _WITH + """, i as (select doc_id as d, count(*) as c, sum(length(text) - length(replace(text, '@', '')))::bigint as links from doc_pages group by 1),
        k as (select d, unnest(list_filter([{'check': 'Page tree', 'passed': d % 11 <> 0, 'detail': c || ' of ' || (c + case when d % 11 = 0 then 1 else 0 end) || ' expected pages'},
        case when d % 3 = 1 then {'check': 'Password protection', 'passed': false, 'detail': case when d % 4 = 0 then 'The output opened without the requested password.' else 'Opening without a password was rejected.' end} end,
        case when d % 3 = 2 then {'check': 'Encryption removal', 'passed': true, 'detail': 'The output opens without encryption.'} end,
        case when d // 2 % 2 = 0 then {'check': 'Redaction annotations consumed', 'passed': d % 5 = 0, 'detail': d % 5 || ' redaction marks remain.'} end,
        case when d // 2 % 2 = 0 then {'check': 'Redacted text extraction', 'passed': d % 6 = 0 or d % 7 <> 0, 'detail': case when d % 6 = 0 then 'No selectable text was marked.' when d % 7 = 0 then 'Still found: aa, bb' else d % 6 || ' covered text fragments were absent after export.' end} end,
        case when d // 9 % 2 = 1 and d // 8 % 2 = 1 and d % 3 > 0 then {'check': 'Form values', 'passed': d % 2 = 0, 'detail': case when d % 2 = 1 then '1 requested field updates did not persist.' else d % 3 || ' requested field updates persisted.' end} end,
        case when d // 3 % 2 = 0 then {'check': 'Active content', 'passed': d % 8 <> 0, 'detail': case when d % 8 = 0 then 'Active document actions remain.' else 'No active document actions were detected.' end} end,
        case when d // 4 % 2 = 0 then {'check': 'Attachments', 'passed': d % 3 = 0, 'detail': d % 3 || ' embedded attachment entries remain.'} end, case when d // 5 % 2 = 0 then {'check': 'Links', 'passed': links = 0, 'detail': links || ' page links remain.'} end,
        case when d // 6 % 2 = 0 then {'check': 'Comments', 'passed': d % 4 = 0, 'detail': d % 4 || ' non-redaction annotations remain.'} end, case when d // 7 % 2 = 0 then {'check': 'Metadata', 'passed': d % 2 = 1, 'detail': case when d % 2 = 0 then 'Remaining fields: Title' else 'Standard document metadata was removed.' end} end,
        case when d // 8 % 2 = 0 and d // 9 % 2 = 1 then {'check': 'Form clearing', 'passed': d % 9 = 0, 'detail': d % 9 || ' non-empty field values remain.'} end, case when d // 9 % 2 = 0 then {'check': 'Form flattening', 'passed': d % 10 = 0, 'detail': d % 10 || ' interactive fields remain.'} end,
        case when d // 10 % 2 = 0 then {'check': 'Annotation flattening', 'passed': d % 4 + d % 5 = 0, 'detail': (d % 4 + d % 5) || ' editable annotations remain.'} end], lambda x: x is not null)) as x from i)
        select d as doc_id, x.check, x.passed, x.detail from k""",
    "f10_preflight": _WITH + """, n as (select doc_id, count(*) as c from doc_pages group by 1), q as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1),
        i as (select doc_id as d, lang, c, coalesce(quality, 0) = 1 as good, coalesce(toxic, 0) = 1 as bad from documents join n using (doc_id) left join q using (doc_id) where text is not null),
        k as (select d, unnest([['archive-encryption', 'archival', case when d % 5 = 0 then 'error' else 'pass' end, (d % 5 = 0)::varchar], ['archive-fonts', 'archival', case when d % 4 <> d % 3 then 'error' else 'pass' end, 'false'],
        ['archive-active', 'archival', case when bad then 'error' else 'pass' end, 'true'], ['archive-output-intent', 'archival', case when d % 2 = 0 then 'error' else 'pass' end, 'true'], ['archive-xmp', 'archival', case when d % 7 <> 0 then 'warning' else 'pass' end, 'true'],
        ['archive-attachments', 'archival', case when d % 6 > 0 then 'warning' else 'pass' end, 'false'], ['access-tags', 'accessibility', ['error', 'warning', 'warning', 'pass'][d % 4 + 1], (d % 4 <> 3)::varchar], ['access-lang', 'accessibility', case when coalesce(lang, '') = '' then 'error' else 'pass' end, 'true'],
        ['access-title', 'accessibility', case when good then 'pass' else 'warning' end, 'true'], ['access-alt', 'accessibility', case when c % 2 > 0 then 'warning' else 'pass' end, 'true'], ['access-fields', 'accessibility', 'pass', 'true'],
        ['print-boxes', 'print', case when d % 2 > 0 then 'warning' else 'pass' end, 'true'], ['print-transparency', 'print', case when c % 3 > 0 then 'info' else 'pass' end, 'false'], ['print-overprint', 'print', 'pass', 'false'], ['print-intent', 'print', case when d % 3 = 0 then 'warning' else 'pass' end, 'true'],
        ['security-actions', 'security', case when bad then 'error' else 'pass' end, 'true'], ['security-xfa', 'security', case when d % 9 = 0 then 'warning' else 'pass' end, 'false'], ['security-attachments', 'security', case when d % 6 > 0 then 'warning' else 'pass' end, 'true'],
        ['signature-ranges', 'signatures', case when d % 8 = 0 then 'error' when d % 4 = 0 then 'warning' else 'pass' end, 'false']]) as x from i)
        select d as doc_id, x[1] as id, x[2] as profile, x[3] as severity, x[4] = 'true' as repairable from k""",
    "g1_transform_boxes": _WITH + """, m as (select b.*, doc_id % 4 as turn, 1 + (doc_id % 3) / 2.0::double as z, doc_id % 12 = 7 as bad, x + w as x2, y + h as y2 from boxes b)
        select doc_id, page_number, span_id as object_id, case when not bad then [x * z, y * z, (612 - x2) * z, (792 - y2) * z][turn + 1] end::double as x0, case when not bad then [(792 - y2) * z, x * z, y * z, (612 - x2) * z][turn + 1] end::double as y0,
        case when not bad then [x2 * z, y2 * z, (612 - x) * z, (792 - y) * z][turn + 1] end::double as x1, case when not bad then [(792 - y) * z, x2 * z, y2 * z, (612 - x) * z][turn + 1] end::double as y1,
        case when bad then 'Page dimensions, zoom or rotation are not possible.' end as error from m""",
    "g3_paragraphs": _WITH + """, l as (select doc_id, i, (i // 3 + 1)::int as page_number, (doc_id % 3) as block, 72.0::double + 5 * (i % 2) as x, 72.0::double + 14 * (i % 3) as y, least(400.0::double, length(line)::double) as w, 12.0::double as h, 'F' || (i % 2) as font, 10.0::double + i % 3 as size from slines),
        s as (select *, abs(y - lag(y) over (partition by doc_id, page_number, block order by y, x, i)) as step, min(x) over g as x0, max(x + w) over g as x1 from l window g as (partition by doc_id, page_number, block)),
        f as (select doc_id, page_number, block, font, row_number() over (partition by doc_id, page_number, block order by count(*) desc, font) as k from l group by 1, 2, 3, 4),
        a as (select doc_id, page_number, block, min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h, median(size) as size, count(*) as line_count, median(step) filter (step > 0.1) as advance, median(h) as height,
            stddev_pop(x - x0) as dl, stddev_pop(x1 - x - w) as dr, stddev_pop(x + w / 2 - (x0 + x1) / 2) as dc from s group by 1, 2, 3)
        select doc_id, page_number, block, x, y, w, h, font, round(size, 6) as size, line_count, round(coalesce(advance, greatest(height, size * 1.2::double)), 6) as line_height,
        case when line_count < 2 then 'left' when dc + 0.75 < least(dl, dr) then 'center' when dr + 0.75 < dl then 'right' else 'left' end as align from a join f using (doc_id, page_number, block) where k = 1""",
    "g9_assign_cells": _WITH + r""", s as (select *, x + w / 2 as cx, y + h / 2 as cy, list_filter(string_split(regexp_replace(trim(text), '\s+', ' ', 'g'), ' '), lambda v: v <> '') as ws from boxes where doc_id % 2 = 0),
        k as (select *, greatest(0, least(1, case when cy >= 100 then 2 when cy >= 86 then 1 else 0 end)) as row, w > 202.5 and len(ws) between 2 and 3 as wide from s where x <= 521 and x + w >= 69 and y <= 101 and y + h >= 71 and cy between 71 and 101),
        p as (select doc_id, page_number, row, y, x, span_id, unnest(ws) as text, generate_subscripts(ws, 1) - 1 as col from k where wide union all
            select doc_id, page_number, row, y, x, span_id, text, greatest(0, least(2, case when cx >= 520 then 3 when cx >= 370 then 2 when cx >= 220 then 1 else 0 end)) from k where not wide and cx between 69 and 521)
        select doc_id, page_number, 0 as table_id, row::int as row, col::int as column, trim(string_agg(text, ' ' order by y, x, span_id, text)) as text from p group by doc_id, page_number, row, col""",
}
ORACLES["f10_preflight_summary"] = "with z as (" + ORACLES["f10_preflight"] + ") select profile, severity, count(*) as findings, count(distinct doc_id) as documents from z group by 1, 2"
