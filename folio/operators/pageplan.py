"""Page plans, labels, crops and recipes."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINTS_PER_MM = 72 / 25.4
# fixed values: the smallest side after a crop, and the steps of a recipe, those with several outputs last
LEAST_SIDE = 12
STEPS = ["rotate", "optimize", "remove-metadata", "crop", "decorate", "blank-pages", "raster-compress", "grayscale", "split-fixed", "page-images"]
MANY_OUTPUTS = ["split-fixed", "page-images"]
CODECS = ["optimize", "raster-compress", "grayscale", "page-images"]
SCHEMA = 3

# --- page plans: plan(doc_id, pos from 0, item_id, source_page, rotation, selected) ------------------------------


def page_plan(pages: DataFrame) -> DataFrame:
    """The plan of pages(doc_id, page_number) as they are."""
    return pages.select("doc_id", (F.col("page_number") - 1).alias("pos"), F.col("page_number").cast("string").alias("item_id"), F.col("page_number").alias("source_page"), F.lit(0).alias("rotation"), F.lit(False).alias("selected"))


def _numbered(plan: DataFrame, *order: Column) -> DataFrame:
    """The plan in a new order of each document."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return plan.withColumn("pos", place).select("doc_id", "pos", "item_id", "source_page", "rotation", "selected")


def rotate_items(plan: DataFrame, chosen: Column, degrees: int) -> DataFrame:
    """Chosen items turned; any rotation but 90, 180 and 270 is none."""
    turned = F.pmod(F.col("rotation") + degrees, F.lit(360))
    return plan.withColumn("rotation", F.when(chosen, F.when(turned.isin(90, 180, 270), turned).otherwise(0)).otherwise(F.col("rotation")).cast("int"))


def duplicate_items(plan: DataFrame, chosen: Column) -> DataFrame:
    """A selected copy after each chosen item."""
    rows = plan.withColumn("_copy", F.explode(F.when(chosen, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = rows.withColumn("item_id", F.when(F.col("_copy") == 1, F.concat("item_id", F.lit("-copy"))).otherwise(F.col("item_id"))).withColumn("selected", F.col("selected") | (F.col("_copy") == 1))
    return _numbered(rows, F.col("pos"), F.col("_copy"))


def delete_items(plan: DataFrame, chosen: Column) -> DataFrame:
    """The plan without the chosen items; a document of chosen items only stays as it is."""
    rows = plan.withColumn("_goes", F.coalesce(chosen, F.lit(False)))
    rows = rows.withColumn("_all", F.bool_and("_goes").over(Window.partitionBy("doc_id")))
    return _numbered(rows.where("not _goes or _all"), F.col("pos"))


def move_items(plan: DataFrame, chosen: Column, target: int) -> DataFrame:
    """Chosen items, in their order, before what stands at target (from 0)."""
    every = Window.partitionBy("doc_id")
    rows = plan.withColumn("_moves", F.coalesce(chosen, F.lit(False)))
    rows = rows.withColumn("_stays", F.count_if(~F.col("_moves")).over(every.orderBy("pos")) - 1)
    rows = rows.withColumn("_at", F.count_if(~F.col("_moves") & (F.col("pos") < target)).over(every))
    group = F.when(F.col("_moves"), 1).when(F.col("_stays") < F.col("_at"), 0).otherwise(2)
    return _numbered(rows, group, F.col("pos"))


def reverse_items(plan: DataFrame, selected_only: bool = False) -> DataFrame:
    """The items of each document in reverse order; with selected_only the selected ones change places among themselves."""
    if not selected_only:
        return _numbered(plan, F.desc("pos"))
    own = plan.where("selected")
    order = Window.partitionBy("doc_id")
    places = own.select("doc_id", F.col("pos").alias("_place"), F.row_number().over(order.orderBy("pos")).alias("_n"))
    moved = own.withColumn("_n", F.row_number().over(order.orderBy(F.desc("pos")))).join(places, ["doc_id", "_n"]).withColumn("pos", F.col("_place"))
    columns = ["doc_id", "pos", "item_id", "source_page", "rotation", "selected"]
    return moved.select(columns).unionByName(plan.where("not selected").select(columns))


def select_items(plan: DataFrame, numbers: tuple[int, ...]) -> DataFrame:
    """Items selected by number, from 1."""
    return plan.withColumn("selected", (F.col("pos") + 1).isin(*numbers) if numbers else F.lit(False))


# --- labels and crops ---------------------------------------------------------------------------------------------


def decoration_language(text: str, preferred: str = "auto") -> str | None:
    """The language that a decoration's font is taken for; scripts that need shaping are a ValueError."""
    if preferred != "auto":
        return preferred
    # fixed values: the characters of each language
    for pattern, name in ((r"[가-힯ᄀ-ᇿ]", "ko"), (r"[぀-ヿ]", "ja"), (r"[㐀-鿿]", "zh-Hans")):
        if re.search(pattern, text):
            return name
    if re.search("[֐-ࣿऀ-෿฀-๿]", text):
        raise ValueError("page_labels: a script that needs shaping")
    return None


def page_labels(pages: DataFrame, header: str = "", footer: str = "", watermark: str = "", page_numbers: bool = False, start: float = 1, language: str = "auto") -> DataFrame:
    """doc_id, page_number, element, text, align, language of what is set on pages(doc_id, page_number): watermark, header, footer, number.

    Numbers begin at start; a footer goes left and the number right where both are set. Texts in a script that needs
    shaping are a ValueError.
    """
    elements = [("watermark", watermark, "center"), ("header", header, "center"), ("footer", footer, "left" if page_numbers else "center")]
    parts = [F.struct(F.lit(name).alias("element"), F.lit(text).alias("text"), F.lit(align).alias("align"), F.lit(decoration_language(text, language)).cast("string").alias("language")) for name, text, align in elements if text]
    if page_numbers:
        first = math.floor(start + 0.5)
        number = (F.col("page_number") - 1 + first).cast("string")
        parts.append(F.struct(F.lit("number").alias("element"), number.alias("text"), F.lit("right" if footer else "center").alias("align"), F.lit(decoration_language("0", language)).cast("string").alias("language")))
    if not parts:
        return pages.where("false").select("doc_id", "page_number", *(F.lit(None).cast("string").alias(c) for c in ("element", "text", "align", "language")))
    return pages.select("doc_id", "page_number", F.inline(F.array(*parts)))


def _visible(width: Column, height: Column, top: float, right: float, bottom: float, left: float) -> tuple[Column, Column, Column, Column]:
    """x0, y0, x1, y1 of what a crop leaves; each margin leaves a point at least."""
    clamp = lambda v, most: F.least(F.greatest(F.lit(float(v)), F.lit(0.0)), F.greatest(most, F.lit(0.0)))
    x0 = clamp(left, width - 1)
    y0 = clamp(top, height - 1)
    return x0, y0, width - clamp(right, width - x0 - 1), height - clamp(bottom, height - y0 - 1)


def crop_report(pages: DataFrame, spans: DataFrame, top: float = 0, right: float = 0, bottom: float = 0, left: float = 0) -> DataFrame:
    """doc_id, page_number, x0, y0, x1, y1, hidden, error of pages(doc_id, page_number, width, height) with margins in points.

    hidden counts the spans(doc_id, page_number, x, y, w, h) outside what stays visible; they are kept. A page with a
    side below 12 has an error and no box.
    """
    box = _visible(F.col("width"), F.col("height"), top, right, bottom, left)
    rows = pages.select("doc_id", "page_number", *(c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)))
    small = (F.col("x1") - F.col("x0") < LEAST_SIDE) | (F.col("y1") - F.col("y0") < LEAST_SIDE)
    met = spans.select("doc_id", "page_number", "x", "y", "w", "h").join(rows, ["doc_id", "page_number"])
    outside = (F.col("x") >= F.col("x1")) | (F.col("x") + F.col("w") <= F.col("x0")) | (F.col("y") >= F.col("y1")) | (F.col("y") + F.col("h") <= F.col("y0"))
    hidden = met.where(outside).groupBy("doc_id", "page_number").agg(F.count("*").alias("hidden"))
    # fixed value: the message
    error = F.when(small, F.concat(F.lit("Crop margins leave page "), F.col("page_number"), F.lit(" too small.")))
    found = rows.join(hidden, ["doc_id", "page_number"], "left").na.fill(0, ["hidden"]).withColumn("error", error)
    return found.select("doc_id", "page_number", *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")), "hidden", "error")


# --- recipes ------------------------------------------------------------------------------------------------------

_STEP = "struct<type:string,degrees:int,topMm:double,rightMm:double,bottomMm:double,leftMm:double,position:string,count:double,pagesPerFile:double>"
_RECIPE = f"schemaVersion double, name string, steps array<{_STEP}>, rotate int, compression string, removeMetadata boolean, outputSuffix string"


def parse_recipes(recipes: DataFrame) -> DataFrame:
    """recipe_id, name, output_suffix, steps, error of recipes(recipe_id, json).

    Version 1 has flags in place of steps; newer versions than ours, unknown steps, no name or no steps, and a step
    with several outputs that is not the last one are errors.
    """
    json = F.from_json("json", _RECIPE)
    rows = recipes.select("recipe_id", json.alias("_r"), F.get_json_object("json", "$").alias("_json"), F.get_json_object("json", "$.steps").alias("_steps"))
    step = lambda kind, **values: F.struct(F.lit(kind).alias("type"), *(values.get(n, F.lit(None)).cast(t).alias(n) for n, t in (("degrees", "int"), ("topMm", "double"), ("rightMm", "double"), ("bottomMm", "double"), ("leftMm", "double"), ("position", "string"), ("count", "double"), ("pagesPerFile", "double")))).cast(_STEP)
    r = lambda name: F.col(f"_r.{name}")
    turns = F.when(F.coalesce(r("rotate"), F.lit(0)) != 0, step("rotate", degrees=r("rotate")))
    packs = F.when(r("compression") == "lossless", step("optimize")).when(r("compression").isin("screen", "balanced", "small", "print"), step("raster-compress"))
    legacy = F.filter(F.array(turns, packs, F.when(r("removeMetadata"), step("remove-metadata"))), lambda s: s.isNotNull())
    version = r("schemaVersion")
    steps = F.when((version >= 2) & F.coalesce(F.col("_steps").startswith("["), F.lit(False)), r("steps")).otherwise(legacy)
    rows = rows.withColumn("steps", steps)
    unknown = F.exists("steps", lambda s: ~F.coalesce(s["type"].isin(STEPS), F.lit(False)))
    early = F.exists(F.slice("steps", F.lit(1), F.greatest(F.size("steps") - 1, F.lit(0))), lambda s: s["type"].isin(MANY_OUTPUTS))
    # fixed values: the messages
    error = (
        F.when(F.col("_json").isNull(), "Recipe file is not valid JSON.").when(~F.col("_json").rlike(r"^\s*[{\[]"), "Recipe JSON must contain an object.")
        .when(F.trim(F.coalesce(r("name"), F.lit(""))) == "", "Recipe JSON is missing a name.")
        .when(version.isNull() | (version != F.floor(version)) | (version < 1), "Batch recipe has an invalid schema version.")
        .when(version > SCHEMA, "This Batch recipe was created by a newer version.")
        .when(F.size("steps") == 0, "Recipe JSON must contain at least one processing step.").when(unknown, "Recipe JSON contains an unsupported processing step.")
        .when(early, "Multi-output Batch steps must be the final recipe step.")
    )
    suffix = F.substring(F.regexp_replace(F.coalesce(F.nullif(r("outputSuffix"), F.lit("")), F.lit("processed")), "[^a-zA-Z0-9_-]", ""), 1, 40)
    return rows.select("recipe_id", F.substring(F.trim(r("name")), 1, 120).alias("name"), F.coalesce(F.nullif(suffix, F.lit("")), F.lit("processed")).alias("output_suffix"), "steps", error.alias("error"))


def run_recipe(items: DataFrame, recipes: DataFrame) -> DataFrame:
    """item_id, recipe_id, status (complete or error), error, pages, expected_pages, rotation, has_metadata, files of items(item_id, recipe_id, page_count, width, height).

    The steps of a recipe are folded over the state of each item: rotations add up, metadata goes, blank pages are
    added, the last step may split. A crop that leaves a side below 12 is an error, and so are steps that need a
    codec. The number of pages at the end must be as expected.
    """
    parsed = parse_recipes(recipes)
    both = items.join(parsed, "recipe_id", "left").withColumn("error", F.when(F.col("name").isNull() & F.col("error").isNull(), "No such recipe.").otherwise(F.col("error")))
    start = F.struct(F.col("page_count").cast("long").alias("pages"), F.col("page_count").cast("long").alias("expected"), F.lit(0).alias("rotation"), F.lit(True).alias("has_metadata"), F.lit(1).cast("long").alias("files"), F.lit(None).cast("string").alias("error"))

    def fold(s: Column, step: Column) -> Column:
        kind = step["type"]
        count = F.when(kind == "blank-pages", F.greatest(F.lit(1), F.least(F.lit(20), F.floor(F.coalesce(step["count"], F.lit(1.0)) + 0.5)))).otherwise(0).cast("long")
        turned = F.pmod(s["rotation"] + F.coalesce(step["degrees"], F.lit(0)), F.lit(360))
        size = F.greatest(F.lit(1), F.least(F.lit(500), F.floor(F.coalesce(step["pagesPerFile"], F.lit(1.0)) + 0.5)))
        mm = lambda n: F.greatest(F.coalesce(step[n], F.lit(0.0)), F.lit(0.0)) * POINTS_PER_MM
        left, top = F.least(mm("leftMm"), F.greatest(F.col("width") - 1, F.lit(0.0))), F.least(mm("topMm"), F.greatest(F.col("height") - 1, F.lit(0.0)))
        wide = F.col("width") - left - F.least(mm("rightMm"), F.greatest(F.col("width") - left - 1, F.lit(0.0)))
        high = F.col("height") - top - F.least(mm("bottomMm"), F.greatest(F.col("height") - top - 1, F.lit(0.0)))
        # fixed values: the messages
        error = F.when(kind.isin(CODECS), F.concat(F.lit("Unsupported step: "), kind)).when((kind == "crop") & ((wide < LEAST_SIDE) | (high < LEAST_SIDE)), "Crop margins leave page 1 too small.")
        return F.struct(
            (s["pages"] + count).alias("pages"), (s["expected"] + count).alias("expected"),
            F.when(kind == "rotate", F.when(turned.isin(90, 180, 270), turned).otherwise(0)).otherwise(s["rotation"]).cast("int").alias("rotation"),
            (s["has_metadata"] & (kind != "remove-metadata")).alias("has_metadata"),
            F.when(kind == "split-fixed", F.ceil(s["pages"] / size)).otherwise(s["files"]).cast("long").alias("files"), F.coalesce(s["error"], error).alias("error"),
        )

    rows = both.withColumn("_s", F.aggregate(F.coalesce("steps", F.array().cast(f"array<{_STEP}>")), start, fold))
    error = F.coalesce("error", "_s.error", F.when(F.col("_s.pages") != F.col("_s.expected"), "Output page count does not match."))
    rows = rows.withColumn("error", error)
    good = F.col("error").isNull()
    shown = [("pages", "pages"), ("expected", "expected_pages"), ("rotation", "rotation"), ("has_metadata", "has_metadata"), ("files", "files")]
    return rows.select("item_id", "recipe_id", F.when(good, "complete").otherwise("error").alias("status"), "error", *(F.when(good, F.col(f"_s.{c}")).alias(n) for c, n in shown))
