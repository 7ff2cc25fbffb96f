"""Security checks, preflight findings and the structure of pages."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.markup import DROPPED, HELD, Element, parse_html


def security_checks(inspections: DataFrame, options: DataFrame) -> DataFrame:
    """doc_id, check, passed, detail of every check that options(doc_id, ...) ask for.

    inspections has doc_id, page_count, opens_without_password, encrypted, redaction_marks, tokens_left (an array),
    tokens_sought, form_mismatches, has_javascript, has_open_action, has_additional_actions, attachments, links,
    annotations, metadata (a map), filled_fields, fields. options has expected_pages, encryption (aes-256, remove or
    keep), redaction, form_updates (a number) and the flags remove_javascript, remove_open_actions,
    remove_attachments, remove_links, remove_comments, remove_metadata, clear_form_values, flatten_forms,
    flatten_annotations; a null flag is not set.
    """
    rows = inspections.join(options, "doc_id")
    asked = lambda c: F.coalesce(F.col(c), F.lit(False))
    number = lambda c: F.coalesce(F.col(c), F.lit(0))

    def check(when: Column, name: str, passed: Column, *detail) -> Column:
        text = F.concat(*(d.cast("string") if isinstance(d, Column) else F.lit(d) for d in detail))
        return F.when(when, F.struct(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), text.alias("detail")))

    left, active = F.coalesce("tokens_left", F.array().cast("array<string>")), asked("has_javascript") | asked("has_open_action") | asked("has_additional_actions")
    fields = F.coalesce(F.map_keys("metadata"), F.array().cast("array<string>"))
    # fixed values: the messages
    no_text = F.when(number("tokens_sought") == 0, "No selectable text was marked.").when(F.size(left) > 0, F.concat(F.lit("Still found: "), F.array_join(F.slice(left, 1, 5), ", "))).otherwise(F.concat(number("tokens_sought").cast("string"), F.lit(" covered text fragments were absent after export.")))
    touched = ~asked("flatten_forms") & ~asked("clear_form_values") & (number("form_updates") > 0)
    # fixed values: names of checks and their details
    checks = F.array(
        check(F.lit(True), "Page tree", F.col("page_count") == F.col("expected_pages"), F.col("page_count"), " of ", F.col("expected_pages"), " expected pages"),
        check(F.col("encryption") == "aes-256", "Password protection", ~asked("opens_without_password") & asked("encrypted"), F.when(asked("opens_without_password"), "The output opened without the requested password.").otherwise("Opening without a password was rejected.")),
        check(F.col("encryption") == "remove", "Encryption removal", ~asked("encrypted"), F.when(asked("encrypted"), "Encryption is still reported.").otherwise("The output opens without encryption.")),
        check(asked("redaction"), "Redaction annotations consumed", number("redaction_marks") == 0, number("redaction_marks"), " redaction marks remain."),
        check(asked("redaction"), "Redacted text extraction", (number("tokens_sought") == 0) | (F.size(left) == 0), no_text),
        check(touched, "Form values", number("form_mismatches") == 0, F.when(number("form_mismatches") > 0, F.concat(number("form_mismatches").cast("string"), F.lit(" requested field updates did not persist."))).otherwise(F.concat(number("form_updates").cast("string"), F.lit(" requested field updates persisted.")))),
        check(asked("remove_javascript") | asked("remove_open_actions"), "Active content", ~active, F.when(active, "Active document actions remain.").otherwise("No active document actions were detected.")),
        check(asked("remove_attachments"), "Attachments", number("attachments") == 0, number("attachments"), " embedded attachment entries remain."),
        check(asked("remove_links"), "Links", number("links") == 0, number("links"), " page links remain."),
        check(asked("remove_comments"), "Comments", number("annotations") == 0, number("annotations"), " non-redaction annotations remain."),
        check(asked("remove_metadata"), "Metadata", F.size(fields) == 0, F.when(F.size(fields) > 0, F.concat(F.lit("Remaining fields: "), F.array_join(fields, ", "))).otherwise("Standard document metadata was removed.")),
        check(asked("clear_form_values") & ~asked("flatten_forms"), "Form clearing", number("filled_fields") == 0, number("filled_fields"), " non-empty field values remain."),
        check(asked("flatten_forms"), "Form flattening", number("fields") == 0, number("fields"), " interactive fields remain."),
        check(asked("flatten_annotations"), "Annotation flattening", number("annotations") + number("redaction_marks") == 0, number("annotations") + number("redaction_marks"), " editable annotations remain."),
    )
    return rows.select("doc_id", F.inline(F.filter(checks, lambda c: c.isNotNull())))


def checks_verdict(checks: DataFrame) -> DataFrame:
    """doc_id, checks, failed, valid."""
    return checks.groupBy("doc_id").agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"), F.bool_and("passed").alias("valid"))


def preflight(facts: DataFrame) -> DataFrame:
    """doc_id, id, profile, severity, repairable: one finding for each of 19 rules.

    facts has doc_id, encrypted, fonts, embedded_fonts, unsafe_actions, output_intents, embedded_intents, pdfa_claimed,
    attachments, structure (missing, baseline, partial or meaningful), language, title, figures_without_alt,
    fields_without_tooltip, pages_without_trim, pages_without_bleed, transparent_pages, overprint_pages, has_xfa,
    bad_signatures, stale_signatures.
    """
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    text = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    bad = lambda when, level: F.when(when, level).otherwise("pass")
    quality = F.coalesce("structure", F.lit("missing"))
    # fixed values: the rules, their profile, what decides and whether they can be repaired
    rules = [
        ("archive-encryption", "archival", bad(on("encrypted"), "error"), on("encrypted")),
        ("archive-fonts", "archival", bad(~F.col("fonts").eqNullSafe(F.col("embedded_fonts")), "error"), False),
        ("archive-active", "archival", bad(on("unsafe_actions"), "error"), True),
        ("archive-output-intent", "archival", bad(~some("embedded_intents"), "error"), True),
        ("archive-xmp", "archival", bad(~on("pdfa_claimed"), "warning"), True),
        ("archive-attachments", "archival", bad(some("attachments"), "warning"), False),
        ("access-tags", "accessibility", F.when(quality == "meaningful", "pass").when(quality == "missing", "error").otherwise("warning"), quality != "meaningful"),
        ("access-lang", "accessibility", bad(~text("language"), "error"), True),
        ("access-title", "accessibility", bad(~text("title"), "warning"), True),
        ("access-alt", "accessibility", bad(some("figures_without_alt"), "warning"), True),
        ("access-fields", "accessibility", bad(some("fields_without_tooltip"), "warning"), True),
        ("print-boxes", "print", bad(some("pages_without_trim") | some("pages_without_bleed"), "warning"), True),
        ("print-transparency", "print", bad(some("transparent_pages"), "info"), False),
        ("print-overprint", "print", bad(some("overprint_pages"), "info"), False),
        ("print-intent", "print", bad(~some("output_intents"), "warning"), True),
        ("security-actions", "security", bad(on("unsafe_actions"), "error"), True),
        ("security-xfa", "security", bad(on("has_xfa"), "warning"), False),
        ("security-attachments", "security", bad(some("attachments"), "warning"), True),
        ("signature-ranges", "signatures", F.when(some("bad_signatures"), "error").when(some("stale_signatures"), "warning").otherwise("pass"), False),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(p).alias("profile"), s.alias("severity"), (r if isinstance(r, Column) else F.lit(r)).alias("repairable")) for i, p, s, r in rules))
    return facts.select("doc_id", F.inline(rows))


def preflight_summary(findings: DataFrame) -> DataFrame:
    """profile, severity, findings, documents."""
    return findings.groupBy("profile", "severity").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("documents"))


# fixed values: the structure tags of HTML elements
TAGS = {"p": "P", "ul": "L", "ol": "L", "li": "LI", "table": "Table", "tr": "TR", "th": "TH", "td": "TD", "img": "Figure", "figure": "Figure", "a": "Link", "blockquote": "BlockQuote", "pre": "Code", "code": "Code", "section": "Sect", "article": "Art", "div": "Div", "nav": "TOC", "input": "Form", "select": "Form", "textarea": "Form", "button": "Form"} | {f"h{i}": f"H{i}" for i in range(1, 7)}


def structure_elements(pages: DataFrame) -> DataFrame:
    """page_id, path, depth, tag, alt, language, label, children, has_content of the elements of pages(page_id, html) that have a structure tag.

    path counts elements with a tag from 0, depth is 0 at the top, children counts those right below; has_content
    tells whether the element holds text of its own.
    """

    def below(node: Element) -> list[Element]:
        found, stack = [], list(reversed(node.elements()))
        while stack:
            one = stack.pop()
            if one.tag in TAGS:
                found.append(one)
            elif one.tag not in DROPPED:
                stack += reversed(one.elements())
        return found

    def rows_of(page: int, html: str | None) -> list[tuple]:
        rows, stack = [], [((i,), e) for i, e in reversed(list(enumerate(below(parse_html(html or "")))))]
        while stack:
            path, e = stack.pop()
            under = below(e)
            label = e.attrs.get("aria-label") or e.attrs.get("title") or ""
            rows.append((page, list(path), len(path) - 1, TAGS[e.tag], e.attrs.get("alt", ""), e.attrs.get("lang", ""), label, len(under), any(isinstance(c, str) and c.strip() for c in e.children)))
            stack += reversed([((*path, i), c) for i, c in enumerate(under)])
        return rows

    names = ["page_id", "path", "depth", "tag", "alt", "language", "label", "children", "has_content"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for frame in frames for page, html in zip(frame["page_id"], frame["html"], strict=True) for row in rows_of(page, html))
        for held in batched(rows, HELD):
            yield pd.DataFrame(list(held), columns=names)

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, path array<int>, depth int, tag string, alt string, language string, label string, children int, has_content boolean")


def accessibility_summary(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """page_id, quality (missing, baseline, partial, meaningful), elements, top_level, headings, tables, figures_without_alt, fields_without_label of pages(page_id, tagged)."""
    tag = F.col("tag")
    counts = elements.groupBy("page_id").agg(
        F.count("*").alias("elements"), F.count_if(F.col("depth") == 0).alias("top_level"), F.count_if(tag.rlike("^H[1-6]$")).alias("headings"), F.count_if(tag == "Table").alias("tables"),
        F.count_if((tag == "Figure") & (F.trim("alt") == "")).alias("figures_without_alt"), F.count_if((tag == "Form") & (F.trim("label") == "")).alias("fields_without_label"), F.bool_or("has_content").alias("_content"),
    )
    rows = pages.select("page_id", "tagged").join(counts, "page_id", "left").na.fill(0)
    quality = F.when(~F.coalesce("tagged", F.lit(False)), "missing").when(F.col("elements") == 0, "baseline").when(F.col("_content"), "meaningful").otherwise("partial")
    return rows.select("page_id", quality.alias("quality"), "elements", "top_level", "headings", "tables", "figures_without_alt", "fields_without_label")
