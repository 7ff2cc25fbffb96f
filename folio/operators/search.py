"""Search over page text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.storage import written

#: Characters of the queries that one automaton is made of, and rows of a result that are given out together.
SHARD, ROWS = 4_000_000, 50_000

# fixed values: characters before and after a match in a snippet; a word's edge, by ASCII letters, digits and _
BEFORE, AFTER = 70, 100
W = "[0-9A-Za-z_]"
# the letters outside ASCII that equal an ASCII letter where case is folded, and these
FOLDED = ("\u017f\u212a\u0131\u0130", "skii")
EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def search_pages(pages: DataFrame, query: str, case_sensitive: bool = False, whole_word: bool = False, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc_id, page_number, match_count, snippet of every page with a match; a blank query gives none.

    The query is literal text. The snippet surrounds the first place where the query occurs at all, whole
    word or not, and has an ellipsis where text is cut off.
    """
    query = query.strip()
    text = F.concat_ws(" ", *columns)
    fold, literal = "" if case_sensitive else "(?iu)", re.escape(query)
    pattern = fold + (f"{EDGE}{literal}{EDGE}" if whole_word else literal)
    rows = pages.where(F.lit(bool(query))).select("doc_id", "page_number", text.alias("_text"))
    if query.isascii():
        plain = F.col("_text") if case_sensitive else F.lower(F.translate("_text", *FOLDED))
        rows = rows.withColumn("_plain", plain).where(F.contains("_plain", F.lit(query if case_sensitive else query.lower())))
        own = re.escape(query if case_sensitive else query.lower())
        edges = [(f"(?<!{W})" if re.match(W, query[0]) else EDGE), (f"(?!{W})" if re.match(W, query[-1]) else EDGE)] if whole_word and query else ["", ""]
        odd = F.lit(False) if case_sensitive else F.length(F.translate("_text", FOLDED[0], "")) < F.length("_text")
        count = F.when(odd, F.regexp_count("_text", F.lit(pattern))).otherwise(F.regexp_count("_plain", F.lit(own.join(edges))))
        at = F.instr("_plain", F.lit(query if case_sensitive else query.lower())) - 1
    else:
        count, at = F.regexp_count("_text", F.lit(pattern)), F.length(F.regexp_extract("_text", f"(?s){fold}^(.*?){literal}", 1))
    text = F.col("_text")
    start, end = F.greatest(F.lit(0), at - BEFORE), F.least(F.length(text), at + len(query) + AFTER)
    snippet = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "…").otherwise(""))
    found = rows.withColumn("match_count", count)
    return found.where("match_count > 0").select("doc_id", "page_number", "match_count", snippet.alias("snippet"))


class _Fold(dict):
    """Code points by what they equal where case is folded: the lower case of their upper case, where both are one character."""

    def __missing__(self, point: int) -> int:
        c = chr(point)
        c = c.upper() if len(c.upper()) == 1 else c
        self[point] = ord(c.lower()) if len(c.lower()) == 1 else ord(c)
        return self[point]


_FOLD = _Fold({0x130: ord("i"), 0x131: ord("i")})
_INSIDE = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")


def folded(text: str) -> str:
    """text with case folded, character by character, so that places stay."""
    return text.lower() if text.isascii() else text.translate(_FOLD)


def count_literals(text: str, finder, case_sensitive: bool, whole_word: bool) -> dict[int, int]:
    """How often each literal of an automaton occurs in text, none of its matches overlapping another of its own, as a pattern finds them from the left."""
    counts: dict[int, int] = {}
    after: dict[int, int] = {}
    size = len(text)
    for last, (literal, length) in finder.iter(text if case_sensitive else folded(text)):
        start = last + 1 - length
        if start < after.get(literal, 0):
            continue
        if whole_word:
            end = last + 1
            if (start > 0 and text[start - 1] in _INSIDE) == (text[start] in _INSIDE) or (text[last] in _INSIDE) == (end < size and text[end] in _INSIDE):
                continue
        after[literal] = last + 1
        counts[literal] = counts.get(literal, 0) + 1
    return counts


def search_many(pages: DataFrame, queries: DataFrame, case_sensitive: bool = False, whole_word: bool = True, shard: int = SHARD) -> DataFrame:
    """query, doc_id, page_number, match_count of every page with a match of queries(query), literal text as in search_pages().

    Every page is read once for each shard of the queries, of about ``shard`` characters, by an automaton of all its
    literals; usually there is one shard. No text is shuffled, and tasks get a shard's literals only. Blank and null queries
    and null texts have no matches; queries that are equal count once.
    """
    asked = queries.select("query", F.trim("query").alias("_literal")).where("_literal <> ''").distinct()
    total = asked.agg(F.sum(F.length("_literal") + 16)).first()[0] or 0
    shards = -(-int(total) // shard)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = f"query string, doc_id {kinds['doc_id']}, page_number {kinds['page_number']}, match_count long"
    some = asked.withColumn("_shard", F.pmod(F.xxhash64("query"), F.lit(max(1, shards))))
    if shards > 1:
        some = written(some)
    spark, found = pages.sparkSession, None
    for n in range(shards):
        own = [(r["query"], r["_literal"]) for r in some.where(F.col("_shard") == n).toLocalIterator()]
        if not own:
            continue
        part = pages.select("doc_id", "page_number", "text").where("text is not null").mapInPandas(_searcher(spark.sparkContext.broadcast(own), case_sensitive, whole_word), schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def _searcher(asked, case_sensitive: bool, whole_word: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        of: dict[str, list[str]] = {}
        for query, literal in asked.value:
            of.setdefault(literal if case_sensitive else folded(literal), []).append(query)
        finder, names = ahocorasick.Automaton(), list(of)
        for i, literal in enumerate(names):
            finder.add_word(literal, (i, len(literal)))
        finder.make_automaton()
        for frame in frames:
            rows = []
            for doc, page, text in zip(frame["doc_id"], frame["page_number"], frame["text"]):
                rows += [(query, doc, page, n) for i, n in count_literals(text, finder, case_sensitive, whole_word).items() for query in of[names[i]]]
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=["query", "doc_id", "page_number", "match_count"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["query", "doc_id", "page_number", "match_count"])

    return run


def page_text(items: DataFrame) -> DataFrame:
    """doc_id, page_number, text: the texts of items(doc_id, page_number, pos, text) in order of pos, white space collapsed; a null text counts as empty."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text"))))
    joined = F.array_join(F.transform(ordered, lambda i: i["text"]), " ")
    return items.groupBy("doc_id", "page_number").agg(F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("text"))
