"""Blocks, runs and links of HTML, Markdown and plain text, and their rendering, outline and pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUNS = "array<struct<text:string,style:string,href:string>>"

# fixed values: elements that are left out, that only hold others, that have no end tag, and that end an open paragraph
DROPPED = {"script", "style", "noscript", "template", "iframe", "object", "embed"}
CONTAINERS = {"div", "section", "article", "main", "header", "footer"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS_PARAGRAPH = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hr", "ul", "ol", "table", "form", "nav", "aside", "address", "dl", "fieldset", "figure"}
HEAD = {"head", "title", "meta", "link", "base"}
#: Rows that a task gathers before it hands them on.
HELD = 10_000
SAFE_LINK = re.compile(r"(https?://|mailto:)", re.I)


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def text(self) -> str:
        """All text below, elements that are left out aside; without recursion, since pages nest as deep as they like."""
        out, stack = [], [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, str):
                    out.append(child)
                elif child.tag not in DROPPED:
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()
        return "".join(out)


class _Builder(HTMLParser):
    """A tree of elements; missing end tags of paragraphs and list items are put in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#root")
        self.open = [self.root]

    def _close(self, tag: str, stops: tuple[str, ...] = ()) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return
            if self.open[at].tag in stops:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_PARAGRAPH:
            self._close("p", ("button", "td", "th", "object"))
        if tag == "li":
            self._close("li", ("ul", "ol"))
        made = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(made)
        if tag not in VOID:
            self.open.append(made)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse_html(source: str) -> Element:
    """The body of a page."""
    builder = _Builder()
    builder.feed(source)
    builder.close()
    todo, body = [builder.root], None
    while todo and body is None:
        one = todo.pop()
        body = one if one.tag == "body" else None
        todo += reversed(one.elements())
    if body is None:
        body = next((c for c in builder.root.elements() if c.tag == "html"), builder.root)
    body.children = [c for c in body.children if isinstance(c, str) or c.tag not in HEAD]
    return body


def _add_run(runs: list[dict], text: str, style: str, href: str | None = None) -> None:
    if not text:
        return
    if runs and runs[-1]["style"] == style and runs[-1]["href"] == href:
        runs[-1]["text"] += text
    else:
        runs.append({"text": text, "style": style, "href": href})


def html_runs(node: Element) -> list[dict]:
    """The inline runs of an element: neighbours of one style and link are one run, white space is collapsed within a text."""
    runs: list[dict] = []
    stack: list[tuple] = [(node, "normal")]
    while stack:
        item, style, *link = stack.pop()
        if isinstance(item, str):
            _add_run(runs, re.sub(r"\s+", " ", item), style, link[0] if link else None)
            continue
        if item.tag in DROPPED:
            continue
        if item.tag == "a":
            href = item.attrs.get("href", "")
            safe = href if SAFE_LINK.match(href) else None
            below = [(c, "link", safe) if isinstance(c, str) else (c, "link") for c in item.children]
        else:
            if item.tag in ("strong", "b"):
                style = "bold-italic" if style == "italic" else "bold"
            elif item.tag in ("em", "i"):
                style = "bold-italic" if style == "bold" else "italic"
            elif item.tag == "code":
                style = "code"
            below = [(c, style) for c in item.children]
        stack += reversed(below)
    return runs


def html_block_rows(source: str | None) -> list[tuple]:
    """type, level, number, text, runs of the blocks of a page."""
    body, out = parse_html(source or ""), []

    def add(kind: str, node: Element, level: int | None = None, number: int | None = None) -> bool:
        runs = html_runs(node)
        text = re.sub(r"\s+", " ", "".join(r["text"] for r in runs)).strip()
        if text:
            out.append((kind, level, number, text, runs))
        return bool(text)

    stack = list(reversed(body.elements()))
    while stack:
        node = stack.pop()
        tag = node.tag
        if tag in DROPPED:
            continue
        if re.fullmatch("h[1-6]", tag):
            add("heading", node, level=int(tag[1]))
        elif tag == "p":
            add("paragraph", node)
        elif tag in CONTAINERS and not node.elements():
            add("paragraph", node)
        elif tag == "blockquote":
            add("quote", node)
        elif tag == "pre":
            out.append(("code", None, None, node.text(), None))
        elif tag == "hr":
            out.append(("rule", None, None, None, None))
        elif tag in ("ul", "ol"):
            number = 1
            for item in node.elements():
                if item.tag == "li" and add("bullet" if tag == "ul" else "numbered", item, number=number if tag == "ol" else None):
                    number += 1
        else:
            stack += reversed(node.elements())
    if not out:
        text = re.sub(r"\s+", " ", body.text()).strip()
        if text:
            out.append(("paragraph", None, None, text, [{"text": text, "style": "normal", "href": None}]))
    return out


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, pos, type, level, number, text, runs of the blocks of pages(page_id, html).

    Scripts, styles and embedded objects are left out, containers are opened, numbered lists begin at 1, blocks
    without text are skipped; a page without any block is one paragraph of its text. A null page has none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((key, pos, *block) for frame in frames for key, html in zip(frame["page_id"], frame["html"], strict=True) for pos, block in enumerate(html_block_rows(html)))
        for held in batched(rows, HELD):
            yield pd.DataFrame(list(held), columns=["page_id", "pos", "type", "level", "number", "text", "runs"]).astype({"level": "Int32", "number": "Int32"})

    return pages.select("page_id", "html").mapInPandas(run, f"page_id long, pos int, type string, level int, number int, text string, runs {RUNS}")


def html_links(blocks: DataFrame) -> DataFrame:
    """page_id, pos, run, text, href, host of the links of html_blocks()."""
    runs = blocks.select("page_id", "pos", F.posexplode("runs").alias("run", "_r")).where("_r.href is not null")
    href = F.col("_r.href")
    host = F.nullif(F.regexp_extract(F.lower(href), r"^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    return runs.select("page_id", "pos", "run", F.col("_r.text").alias("text"), href.alias("href"), host.alias("host"))


# fixed values: the line forms of Markdown, in the order they are tried
HEADING, RULE = r"^\s*(#{1,6})\s+(.+)$", r"^\s*(?:---+|___+|\*\*\*+)\s*$"
BULLET, NUMBERED, QUOTE, FENCE = r"^\s*[-+*]\s+(.+)$", r"^\s*(\d+)[.)]\s+(.+)$", r"^\s*>\s?(.*)$", r"^\s*```"


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, pos, type, level, number, source (its Markdown text) of the blocks of docs(doc_id, text).

    Fences turn code on and off and an open one ends with the text; lines of a paragraph are joined by a space.
    Lines are classified by expressions, runs of them found by windows over a document.
    """
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("_n", "_raw"))
    order = Window.partitionBy("doc_id").orderBy("_n")
    line = F.regexp_replace("_raw", r"\s+$", "")
    rows = lines.withColumn("_line", line).withColumn("_fence", F.col("_line").rlike(FENCE))
    rows = rows.withColumn("_fences", F.sum(F.col("_fence").cast("int")).over(order))
    kind = (
        F.when(F.col("_fence"), F.when(F.col("_fences") % 2 == 1, "code").otherwise("end")).when(F.col("_fences") % 2 == 1, "code")
        .when(F.trim("_line") == "", "blank").when(F.col("_line").rlike(HEADING), "heading").when(F.col("_line").rlike(RULE), "rule")
        .when(F.col("_line").rlike(BULLET), "bullet").when(F.col("_line").rlike(NUMBERED), "numbered").when(F.col("_line").rlike(QUOTE), "quote").otherwise("paragraph")
    )
    rows = rows.withColumn("type", kind)
    before = F.lag("type").over(order)
    same = (F.col("type") == before) & ((F.col("type") == "paragraph") | ((F.col("type") == "code") & ~F.col("_fence")))
    rows = rows.withColumn("_block", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(order))
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    part = F.when(F.col("_fence"), None).when(F.col("type") == "code", F.col("_raw"))
    part = part.when(F.col("type") == "heading", F.regexp_extract("_line", HEADING, 2)).when(F.col("type") == "bullet", F.regexp_extract("_line", BULLET, 1))
    part = part.when(F.col("type") == "numbered", F.regexp_extract("_line", NUMBERED, 2)).when(F.col("type") == "quote", F.regexp_extract("_line", QUOTE, 1)).when(F.col("type") == "paragraph", trimmed(F.col("_line")))
    rows = rows.where("type not in ('blank', 'end')").withColumn("_part", part)
    level = F.when(F.col("type") == "heading", F.length(F.regexp_extract("_line", HEADING, 1)))
    number = F.when(F.col("type") == "numbered", F.expr(r"try_cast(regexp_extract(_line, '^\\s*(\\d+)', 1) as int)"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col("_part").alias("p")))), lambda s: s["p"])
    found = rows.groupBy("doc_id", "_block", "type").agg(parts.alias("_parts"), F.max(level).alias("level"), F.max(number).alias("number"))
    joined = F.when(F.col("type") == "rule", None).when(F.col("type") == "code", F.array_join(F.filter("_parts", lambda p: p.isNotNull()), "\n"))
    joined = joined.otherwise(trimmed(F.when(F.col("type") == "paragraph", F.regexp_replace(F.array_join("_parts", " "), r"\s+", " ")).otherwise(F.array_join("_parts", " "))))
    numbered = F.row_number().over(Window.partitionBy("doc_id").orderBy("_block")) - 1
    return found.withColumn("source", joined).select("doc_id", numbered.alias("pos"), "type", "level", "number", "source")


# fixed values: the inline forms of Markdown, in the order they are tried
INLINE = [
    (re.compile(r"\[([^\]]+)\]\((https?://[^\s)]+|mailto:[^\s)]+)\)", re.I), "link"),
    (re.compile(r"(?:\*\*\*|___)(.+?)(?:\*\*\*|___)"), "bold-italic"),
    (re.compile(r"(?:\*\*|__)(.+?)(?:\*\*|__)"), "bold"),
    (re.compile(r"`([^`]+)`"), "code"),
    (re.compile(r"(?:\*|_)([^*_]+?)(?:\*|_)"), "italic"),
]
_PLAIN = re.compile(r"[^\\\[*_`]+")


def inline_runs(source: str) -> list[dict]:
    """The runs of a Markdown text; a backslash takes the next character as it is."""
    runs: list[dict] = []
    at = 0
    while at < len(source):
        if plain := _PLAIN.match(source, at):
            _add_run(runs, plain[0], "normal")
            at = plain.end()
            continue
        if source[at] == "\\" and at + 1 < len(source):
            _add_run(runs, source[at + 1], "normal")
            at += 2
            continue
        for pattern, style in INLINE:
            if found := pattern.match(source, at):
                _add_run(runs, found[1], style, found[2] if style == "link" else None)
                at = found.end()
                break
        else:
            _add_run(runs, source[at], "normal")
            at += 1
    return runs


def markdown_runs(blocks: DataFrame) -> DataFrame:
    """markdown_blocks() with text and runs; paragraphs without text are left out, code and rules have no runs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            runs = [None if kind in ("code", "rule") else inline_runs(source) for kind, source in zip(frame["type"], frame["source"], strict=True)]
            text = [source if r is None else "".join(x["text"] for x in r).strip() for source, r in zip(frame["source"], runs, strict=True)]
            out = frame.assign(text=text, runs=runs).drop(columns="source").astype({"level": "Int32", "number": "Int32"})
            yield out[(out["type"] != "paragraph") | (out["text"] != "")]

    return blocks.select("doc_id", "pos", "type", "level", "number", "source").mapInPandas(run, f"doc_id long, pos int, type string, level int, number int, text string, runs {RUNS}")


def run_styles(blocks: DataFrame) -> DataFrame:
    """style, runs, characters of all runs of blocks."""
    runs = blocks.select(F.explode("runs").alias("_r"))
    return runs.groupBy(F.col("_r.style").alias("style")).agg(F.count("*").alias("runs"), F.sum(F.length("_r.text")).alias("characters"))


def _escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def render_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, html of blocks(doc_id, pos, type, level, text, runs): fragments joined by line breaks; list items that follow each other share a list."""

    def one(r: Column) -> Column:
        text = _escaped(r["text"])
        tag = lambda name: F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))
        link = F.concat(F.lit('<a href="'), _escaped(r["href"]), F.lit('" rel="noreferrer">'), text, F.lit("</a>"))
        found = F.when(r["style"] == "bold", tag("strong")).when(r["style"] == "italic", tag("em")).when(r["style"] == "bold-italic", F.concat(F.lit("<strong><em>"), text, F.lit("</em></strong>")))
        return found.when(r["style"] == "code", tag("code")).when((r["style"] == "link") & r["href"].isNotNull(), link).otherwise(text)

    inner = F.coalesce(F.array_join(F.transform("runs", one), ""), _escaped(F.col("text")), F.lit(""))
    around = lambda name: F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))
    level = F.col("level").cast("string")
    piece = F.when(F.col("type").isin("bullet", "numbered"), around("li")).when(F.col("type") == "heading", F.concat(F.lit("<h"), level, F.lit(">"), inner, F.lit("</h"), level, F.lit(">")))
    piece = piece.when(F.col("type") == "paragraph", around("p")).when(F.col("type") == "quote", around("blockquote"))
    piece = piece.when(F.col("type") == "code", F.concat(F.lit("<pre><code>"), F.coalesce(_escaped(F.col("text")), F.lit("")), F.lit("</code></pre>"))).otherwise("<hr>")
    kind = F.when(F.col("type") == "bullet", "ul").when(F.col("type") == "numbered", "ol").otherwise("")
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = blocks.withColumn("_piece", piece).withColumn("_list", kind)
    rows = rows.withColumn("_before", F.lag("_list", 1, "").over(order)).withColumn("_after", F.lead("_list", 1, "").over(order))
    opens = F.when((F.col("_list") != "") & (F.col("_list") != F.col("_before")), F.concat(F.lit("<"), F.col("_list"), F.lit(">\n"))).otherwise("")
    closes = F.when((F.col("_list") != "") & (F.col("_list") != F.col("_after")), F.concat(F.lit("\n</"), F.col("_list"), F.lit(">"))).otherwise("")
    rows = rows.withColumn("_piece", F.concat(opens, "_piece", closes))
    parts = F.array_sort(F.collect_list(F.struct("pos", "_piece")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["_piece"]), "\n").alias("html"))


CJK = r"^[\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{3040}-\x{30FF}]"


def join_lines(lines: DataFrame) -> DataFrame:
    """doc_id, part, text: the texts of lines(doc_id, part, pos, text, script) in order of pos, joined.

    Blank lines are skipped, a hyphen after a letter goes before a lower-case letter, and there is no space beside
    Chinese, Japanese or Korean characters.
    """
    trimmed = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    ordered = F.array_sort(F.collect_list(F.struct("pos", trimmed.alias("text"), F.coalesce("script", F.lit("")).alias("script"))))

    def add(so_far: Column, line: Column) -> Column:
        text = line["text"]
        hyphen = so_far.rlike(r"[A-Za-zÀ-ž]-$") & text.rlike(r"^[a-zà-ž]")
        tight = text.rlike(CJK) | F.substring(so_far, -1, 1).rlike(CJK) | line["script"].startswith("cjk-")
        joined = F.when(hyphen, F.concat(F.regexp_replace(so_far, "-$", ""), text))
        joined = joined.when(tight, F.concat(so_far, text)).otherwise(F.concat(so_far, F.lit(" "), text))
        return F.when(text == "", so_far).when(so_far == "", text).otherwise(joined)

    rows = lines.groupBy("doc_id", "part").agg(ordered.alias("_lines"))
    return rows.select("doc_id", "part", F.aggregate("_lines", F.lit(""), add).alias("text"))


def heading_outline(blocks: DataFrame) -> DataFrame:
    """doc_id, outline_id (1, 1.2, 1.2.1), depth, level, title, digest of the headings of blocks(doc_id, pos, type, level, text).

    A heading is below the last one before it with a smaller level. Headings of one document are folded in a task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, headings in zip(frame["doc_id"], frame["headings"], strict=True):
                path: list[tuple[int, int]] = []  # level and number of the open headings
                counts = {(): 0}
                for h in headings:
                    while path and path[-1][0] >= h["level"]:
                        path.pop()
                    above = tuple(n for _, n in path)
                    counts[above] = number = counts.get(above, 0) + 1
                    path.append((h["level"], number))
                    rows.append((doc, ".".join(str(n) for _, n in path), len(path) - 1, h["level"], h["title"]))
            yield pd.DataFrame(rows, columns=["doc_id", "outline_id", "depth", "level", "title"])

    heads = blocks.where("type = 'heading'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "level", F.coalesce("text", F.lit("")).alias("title")))).alias("headings"))
    rows = heads.mapInPandas(run, "doc_id long, outline_id string, depth int, level int, title string")
    return rows.withColumn("digest", F.sha2(F.col("title").cast("binary"), 256))


# fixed values: widths of characters in parts of the size
SPACE_WIDTH, NARROW, WIDE, OTHER, MONO = 0.29, (0.25, "ilI1.,'`:;|!"), (0.78, "mwMW@%&#"), 0.51, 0.61


@lru_cache(maxsize=1 << 16)
def text_width(text: str, size: float, mono: bool = False) -> float:
    """The estimated width of a text."""
    total = 0.0
    for c in text:
        if "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "가" <= c <= "힯":
            total += size
        elif c in " \t":
            total += size * SPACE_WIDTH
        elif c in NARROW[1]:
            total += size * NARROW[0]
        elif c in WIDE[1]:
            total += size * WIDE[0]
        else:
            total += size * (MONO if mono else OTHER)
    return total


def wrap_text(text: str, width: float, size: float, mono: bool = False) -> list[str]:
    """Lines no wider than width; a word that is too long for a line is broken between characters."""
    lines, line, used = [], "", 0.0
    for token in re.findall(r"\S+\s*|\s+", text) or [text]:
        size_of = text_width(token, size, mono)
        if line and used + size_of > width and token.strip():
            lines.append(line.rstrip())
            line, used = "", 0.0
        if size_of <= width:
            piece = token if line else token.lstrip()
            line, used = line + piece, used + text_width(piece, size, mono)
            continue
        for c in token:
            wide = text_width(c, size, mono)
            if line and used + wide > width:
                lines.append(line.rstrip())
                line, used = "", 0.0
            line, used = line + c, used + wide
    if line or not lines:
        lines.append(line.rstrip())
    return lines


def paginate(blocks: DataFrame, width: float, height: float, size: float = 11.0, line_height: float = 1.35, gap: float = 8.0) -> DataFrame:
    """doc_id, page_number, line_number (on the page), pos (of the block), text of the lines of blocks(doc_id, pos, text).

    A page ends where what is left of its height is too small for another line; a document is laid out in one task.
    """

    def lines_of(doc: int, own: list) -> Iterator[tuple]:
        page, line, y = 1, 0, 0.0
        for block in own:
            for text in wrap_text(block["text"] or "", width, size):
                if y + size * line_height + 2 > height and line:
                    page, line, y = page + 1, 0, 0.0
                line, y = line + 1, y + size * line_height
                yield doc, page, line, block["pos"], text
            y += gap

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for frame in frames for doc, own in zip(frame["doc_id"], frame["blocks"], strict=True) for row in lines_of(doc, own))
        for held in batched(rows, HELD):
            yield pd.DataFrame(list(held), columns=["doc_id", "page_number", "line_number", "pos", "text"])

    own = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("blocks"))
    return own.mapInPandas(run, "doc_id long, page_number int, line_number int, pos int, text string")
