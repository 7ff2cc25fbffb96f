"""Scripts, signatures, claims, fonts and form values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: characters of each script, and the traditional ones among the Han characters
COMPLEX = r"[\x{590}-\x{DFF}\x{FB1D}-\x{FEFF}]"
HANGUL = r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]"
KANA = r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}]|日本"
TRADITIONAL = "[國學體龍門萬與為雲臺灣廣東書長會國華漢]"
HAN = r"[\x{4E00}-\x{9FFF}]"
LATIN = r"[\x{41}-\x{24F}\x{1E00}-\x{1EFF}]|^\s*$"
OFF = ["", "off", "false", "0", "no"]
# fixed values: a signature's byte range, how far around it its fields stand, and the forms of an archival claim
BYTE_RANGE, AROUND = r"/ByteRange\s*\[\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*\]", (1500, 2500)
SIGNATURE_FIELDS = {"filter": "Filter", "sub_filter": "SubFilter", "signing_time": "M", "reason": "Reason", "location": "Location"}
CLAIM_ATTRIBUTE, CLAIM_ELEMENT = r"""(?i)pdfaid:%s=["']([^"']+)["']""", r"(?i)<pdfaid:%s>([^<]+)</pdfaid:%s>"


def script_of(text: Column) -> Column:
    """The script of a text, the hardest to set first; a null text is blank."""
    text = F.coalesce(text, F.lit(""))
    found = F.when(text.rlike(COMPLEX), "complex").when(text.rlike(HANGUL), "cjk-ko").when(text.rlike(KANA), "cjk-ja")
    return found.when(text.rlike(TRADITIONAL), "cjk-zh-hant").when(text.rlike(HAN), "cjk-zh-hans").when(text.rlike(LATIN), "latin").otherwise("unknown")


def script_profile(texts: DataFrame) -> DataFrame:
    """script, editability, texts."""
    script = F.col("script")
    level = F.when(script == "latin", "fixed-box").when(script == "complex", "overlay-only").when(script == "unknown", "unsupported").otherwise("cjk-fixed-box")
    return texts.select(script_of(F.col("text")).alias("script")).groupBy("script").agg(F.count("*").alias("texts")).withColumn("editability", level)


def signature_coverage(raw: DataFrame) -> DataFrame:
    """doc_id, pos, covered, gap, tail, status, filter, sub_filter, signing_time, reason, location of every byte range of raw(doc_id, raw); raw is text with a character for each byte.

    An invalid range covers nothing, and the whole file is its tail. The fields are names or texts near the range, empty
    if there are none.
    """
    groups = F.arrays_zip(*[F.regexp_extract_all("raw", F.lit(BYTE_RANGE), F.lit(k)).alias(n) for k, n in enumerate("abcd", start=1)])
    # the text before the k-th range ends where the parts before it do
    parts = F.split("raw", BYTE_RANGE)
    whole = F.regexp_extract_all("raw", F.lit(f"({BYTE_RANGE})"), F.lit(1))
    held = raw.select("doc_id", "raw", F.length("raw").alias("_size"), parts.alias("_parts"), whole.alias("_whole"), groups.alias("_groups"))
    rows = held.select("doc_id", "raw", "_size", "_parts", "_whole", F.posexplode("_groups").alias("pos", "_g"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, v: s + F.length(v))
    start = total(F.slice("_parts", F.lit(1), F.col("pos") + 1)) + total(F.slice("_whole", F.lit(1), F.col("pos")))
    begin = F.greatest(F.lit(0), start - AROUND[0])
    rows = rows.withColumn("_near", F.substring(F.col("raw"), begin + 1, F.least("_size", start + AROUND[1]) - begin))
    rows = rows.select("doc_id", "pos", "_size", "_near", *(F.expr(f"try_cast(_g.{n} as bigint)").alias(n) for n in "abcd"))
    valid = F.coalesce((F.col("a") == 0) & (F.col("c") >= F.col("b")) & (F.col("c") + F.col("d") <= F.col("_size")), F.lit(False))
    tail = F.when(valid, F.col("_size") - F.col("c") - F.col("d")).otherwise(F.col("_size"))
    status = F.when(~valid, "invalid-range").when(tail == 0, "covers-current-file").otherwise("covers-prior-revision")

    def field(key: str) -> Column:
        name = F.nullif(F.regexp_extract("_near", rf"/{key}\s*/([^\s<>\[\]()]+)", 1), F.lit(""))
        return F.coalesce(name, F.regexp_replace(F.regexp_extract("_near", rf"/{key}\s*\(([^)]*)\)", 1), r"\\([()\\])", "$1"))

    inside = lambda c: F.when(valid, c).otherwise(0)
    return rows.select("doc_id", "pos", inside(F.col("b") + F.col("d")).alias("covered"), inside(F.col("c") - F.col("b")).alias("gap"), tail.alias("tail"), status.alias("status"), *(field(k).alias(n) for n, k in SIGNATURE_FIELDS.items()))


def archival_claims(packets: DataFrame) -> DataFrame:
    """doc_id, claimed, profile of packets(doc_id, xmp); part and conformance are attributes or elements."""
    first = lambda p: F.nullif(F.regexp_extract("xmp", p, 1), F.lit(""))
    value = lambda n: F.coalesce(first(CLAIM_ATTRIBUTE % n), first(CLAIM_ELEMENT % (n, n)))
    profile = F.coalesce(F.concat(F.lit("PDF/A-"), value("part"), F.lower(value("conformance"))), F.lit(""))
    return packets.select("doc_id", (profile != "").alias("claimed"), profile.alias("profile"))


def font_coverage(docs: DataFrame, fonts: DataFrame) -> DataFrame:
    """doc_id, fonts, embedded, severity (info without fonts) of docs(doc_id) and fonts(doc_id, font, embedded)."""
    each = fonts.groupBy("doc_id", "font").agg(F.bool_and("embedded").alias("_in"))
    counts = each.groupBy("doc_id").agg(F.count("*").alias("fonts"), F.count_if("_in").alias("embedded"))
    severity = F.when(F.col("fonts") == 0, "info").when(F.col("fonts") == F.col("embedded"), "pass").otherwise("fail")
    return docs.select("doc_id").distinct().join(counts, "doc_id", "left").na.fill(0, ["fonts", "embedded"]).withColumn("severity", severity)


def verify_form_updates(updates: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, id, matched, passed of updates(doc_id, id, name, page_number, type, value) against fields(doc_id, id, name, page_number, value).

    A field is found by name and page, else by id. Boxes and buttons agree when both are on or both off. Of several fields the one with the smallest id counts.
    """
    by_name = fields.groupBy("doc_id", "name", "page_number").agg(F.min(F.struct("id", F.coalesce("value", F.lit("")).alias("value"))).alias("_by_name"))
    by_id = fields.groupBy("doc_id", "id").agg(F.min(F.struct(F.coalesce("value", F.lit("")).alias("value"))).alias("_by_id"))
    both = updates.join(by_name, ["doc_id", "name", "page_number"], "left").join(by_id, ["doc_id", "id"], "left")
    have, want = F.coalesce("_by_name.value", "_by_id.value"), F.coalesce("value", F.lit(""))
    on = lambda c: ~F.lower(F.trim(c)).isin(OFF)
    same = F.when(F.col("type").isin("checkbox", "radiobutton", "button"), on(have) == on(want)).otherwise(have == want)
    return both.select("doc_id", "id", have.isNotNull().alias("matched"), F.coalesce(same, F.lit(False)).alias("passed"))


def sanitize_objects(objects: DataFrame, remove: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The objects(doc_id, category, object_id, subtype) that stay, and doc_id, category, removed: how many went.

    remove names categories; of comments, redactions stay. A null category stays.
    """
    goes = F.coalesce(F.col("category").isin(*remove) & ~((F.col("category") == "comments") & F.coalesce(F.col("subtype").isin("Redact", "Redaction"), F.lit(False))), F.lit(False))
    return objects.where(~goes), objects.where(goes).groupBy("doc_id", "category").agg(F.count("*").alias("removed"))
