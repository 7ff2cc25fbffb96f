"""Files and recognition results as tables, and reports for support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources import files

# fixed values: how far from its ends a file's marks may be, and the tokens that tell its features
HEAD, TAIL = 1024, 2048
TOKENS = {"encrypted": "/Encrypt", "object_streams": "/ObjStm", "xref_streams": "/XRef", "linearized": "/Linearized", "previous_xref": "/Prev"}
REVISION = "startxref"
OMITTED = "[filename omitted]"


def container_triage(files: DataFrame, key: str = "path") -> DataFrame:
    """key, byte_length, has_header, has_eof, errors, valid and the features of files(key, content); a null content is empty.

    The header stands at the very beginning, the end mark before nothing but white space; features are tokens
    anywhere, incremental_updates counts the places of startxref. For files in a folder there is triage_folder().
    """
    raw = F.coalesce("content", F.lit(b""))
    text = F.decode(raw, "ISO-8859-1")
    tail = F.expr(f"substring(coalesce(content, X''), greatest(1, length(coalesce(content, X'')) - {TAIL} + 1), {TAIL})")
    return _judged(files, key, F.octet_length(raw).cast("long"), F.substring(text, 1, HEAD), F.decode(tail, "ISO-8859-1"), [F.contains(text, F.lit(t)) for t in TOKENS.values()], F.regexp_count(text, F.lit(REVISION)))


def triage_folder(spark: SparkSession, path: str) -> DataFrame:
    """container_triage() of the files below a folder: their ends by ranges, tokens counted block by block, no file held whole."""
    facts = files.file_facts(spark, path, HEAD, TAIL, (*TOKENS.values(), REVISION))
    counts = [F.col("counts")[i] for i in range(len(TOKENS) + 1)]
    return _judged(facts, "path", F.col("byte_length"), F.decode("head", "ISO-8859-1"), F.decode("tail", "ISO-8859-1"), [c > 0 for c in counts[:-1]], counts[-1].cast("int"))


def _judged(rows: DataFrame, key: str, size: Column, head: Column, tail: Column, found: list[Column], revisions: Column) -> DataFrame:
    header, eof = head.rlike(r"^%PDF-\d\.\d"), tail.rlike(r"%%EOF\s*\z")
    errors = F.filter(F.array(F.when(size == 0, "empty-file"), F.when(~header, "missing-header"), F.when(~eof, "missing-eof")), lambda e: e.isNotNull())
    out = rows.select(key, size.alias("byte_length"), header.alias("has_header"), eof.alias("has_eof"), errors.alias("errors"), *(f.alias(n) for n, f in zip(TOKENS, found)), revisions.alias("incremental_updates"))
    return out.withColumn("valid", F.size("errors") == 0)


def triage_totals(triaged: DataFrame) -> DataFrame:
    """fact, files: how many files have each feature or error, and how many are valid."""
    flags = [F.when(F.col(n), F.lit(n)) for n in ("valid", *TOKENS)] + [F.when(F.col("incremental_updates") > 1, "revised")]
    facts = F.concat(F.filter(F.array(*flags), lambda f: f.isNotNull()), "errors")
    return triaged.select(F.explode(facts).alias("fact")).groupBy("fact").agg(F.count("*").alias("files"))


WORD = ["job_id", "page_number", "pos", "text", "confidence", "x0", "y0", "x1", "y1"]


def ingest_ocr_tsv(pages: DataFrame) -> DataFrame:
    """job_id, page_number, pos (of the line), text, confidence, x0, y0, x1, y1 of the words of pages(job_id, page_number, tsv).

    Columns go by the names of the first line; without one of left, top, width, height, conf, text there are no
    words. Lines of another level than 5 and blank texts are left out, a bad confidence is 0.
    """
    lines = F.split("tsv", r"\r?\n")
    header = F.split(F.get(lines, F.lit(0)), "\t")
    at = {n: F.array_position(header, n) for n in ("left", "top", "width", "height", "conf", "text", "level")}
    # the header is read below the explode, once a page
    heads = pages.where("tsv is not null").select("job_id", "page_number", *(p.cast("int").alias(f"_{n}") for n, p in at.items()), lines.alias("_lines"))
    rows = heads.select(*(c for c in heads.columns if c != "_lines"), F.posexplode("_lines").alias("pos", "_line"))
    rows = rows.where("pos > 0 and least(_left, _top, _width, _height, _conf, _text) > 0").withColumn("_cells", F.split("_line", "\t"))
    cell = lambda n: F.get("_cells", F.col(f"_{n}") - 1)
    number = lambda n: F.trim(cell(n)).try_cast("double")
    text = F.trim(cell("text"))
    rows = rows.where(((F.col("_level") == 0) | F.coalesce(number("level") == 5, F.lit(False))) & (text != ""))
    confidence = F.coalesce(F.nanvl(number("conf"), F.lit(0.0)), F.lit(0.0))
    return rows.select("job_id", "page_number", "pos", text.alias("text"), confidence.alias("confidence"), number("left").alias("x0"), number("top").alias("y0"), (number("left") + number("width")).alias("x1"), (number("top") + number("height")).alias("y1"))


# fixed value: a word of hOCR with its box, confidence and content
HOCR_WORD = r"""(?is)<span[^>]*class=["'][^"']*ocrx_word[^"']*["'][^>]*title=["'][^"']*bbox\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)(?:;[^"']*x_wconf\s+(\d+))?[^"']*["'][^>]*>(.*?)</span>"""


def ingest_hocr(pages: DataFrame) -> DataFrame:
    """The same columns of the words of pages(job_id, page_number, hocr): tags and entities are taken out of the texts, blank ones are left out, a missing confidence is 0."""
    groups = F.arrays_zip(*(F.regexp_extract_all("hocr", F.lit(HOCR_WORD), F.lit(k)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1", "confidence", "text"), start=1)))
    rows = pages.where("hocr is not null").select("job_id", "page_number", F.posexplode(groups).alias("pos", "_w"))
    text = F.regexp_replace("_w.text", "<[^>]+>", "")
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(name), F.lit(char))
    number = lambda n: F.col(f"_w.{n}").try_cast("double")
    rows = rows.select("job_id", "page_number", "pos", F.trim(text).alias("text"), F.coalesce(number("confidence"), F.lit(0.0)).alias("confidence"), *(number(n).alias(n) for n in ("x0", "y0", "x1", "y1")))
    return rows.where("text <> ''").select(WORD)


def ingest_words(tsv: DataFrame, hocr: DataFrame) -> DataFrame:
    """The words of the TSV of each page, and of its hOCR where the TSV has none."""
    words = ingest_ocr_tsv(tsv)
    rest = hocr.join(words.select("job_id", "page_number").distinct(), ["job_id", "page_number"], "left_anti")
    return words.unionByName(ingest_hocr(rest))


def support_bundle(issues: DataFrame, diagnostics: DataFrame, receipts: DataFrame, filenames: bool = False) -> DataFrame:
    """section, key, body (JSON) of a report: health issues(code, ...), diagnostics(id, ...) and receipts(id, filename, ...); file names are left out unless asked for."""
    hidden = receipts if filenames else receipts.withColumn("filename", F.lit(OMITTED))

    def section(name: str, rows: DataFrame, key: str) -> DataFrame:
        return rows.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("body"))

    return section("storageHealth", issues, "code").unionByName(section("diagnostics", diagnostics, "id")).unionByName(section("activity", hidden, "id"))
