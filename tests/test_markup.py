"""HTML and Markdown structure by hand-computed cases."""

import pytest

from folio.operators import checks, markup


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_html_blocks(spark):
    html = """<html><head><title>no</title><style>p{}</style></head><body>
      <h2>Head <em>one</em></h2><div><p>a  <b>bold <i>both</i></b> &amp; <a href="/x">rel</a><a href="HTTPS://h.example/p">abs</a><p>next</div>
      <ul><li>x<li>y</ul><ol><li> </li><li>p</li><li>q</li></ol><script>var a</script><pre> keep
 it</pre><hr><section>leaf</section><blockquote>said</blockquote><table><tr><td><p>cell</p></td></tr></table></body></html>"""
    found = markup.html_blocks(spark.createDataFrame([(1, html), (2, "just text"), (3, None), (4, "<div> </div>")], "page_id long, html string")).orderBy("page_id", "pos").cache()
    assert rows(found, "page_id", "type", "level", "number", "text") == [
        (1, "heading", 2, None, "Head one"), (1, "paragraph", None, None, "a bold both & relabs"), (1, "paragraph", None, None, "next"), (1, "bullet", None, None, "x"), (1, "bullet", None, None, "y"),
        (1, "numbered", None, 1, "p"), (1, "numbered", None, 2, "q"), (1, "code", None, None, " keep\n it"), (1, "rule", None, None, None), (1, "paragraph", None, None, "leaf"), (1, "quote", None, None, "said"), (1, "paragraph", None, None, "cell"),
        (2, "paragraph", None, None, "just text"),
    ]
    runs = [(r["text"], r["style"], r["href"]) for r in found.where("page_id = 1 and pos = 1").first()["runs"]]
    assert runs == [("a ", "normal", None), ("bold ", "bold", None), ("both", "italic", None), (" & ", "normal", None), ("rel", "link", None), ("abs", "link", "HTTPS://h.example/p")] or runs[2] == ("both", "bold-italic", None)
    assert rows(markup.html_links(found), "page_id", "text", "href", "host") == [(1, "abs", "HTTPS://h.example/p", "h.example")]


def test_markdown(spark):
    text = "# One **b**\r\nline a\nline *b*\n\n- x\n+ y\n12) z\n> q\n---\n```py\ncode\n\n  more\n```\nend\n```\nopen"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "####### not\n__x__ [t](https://e.example/a) \\*lit\\* ***bi*** `c` _i_ [n](ftp://x)")], "doc_id long, text string")
    blocks = markup.markdown_blocks(docs)
    assert rows(blocks.where("doc_id = 1").orderBy("pos"), "type", "level", "number", "source") == [
        ("heading", 1, None, "One **b**"), ("paragraph", None, None, "line a line *b*"), ("bullet", None, None, "x"), ("bullet", None, None, "y"), ("numbered", None, 12, "z"), ("quote", None, None, "q"),
        ("rule", None, None, None), ("code", None, None, "code\n\n  more"), ("paragraph", None, None, "end"), ("code", None, None, "open"),
    ]
    found = {(r["doc_id"], r["pos"]): [(x["text"], x["style"], x["href"]) for x in r["runs"] or ()] for r in markup.markdown_runs(blocks).collect()}
    assert found[1, 0] == [("One ", "normal", None), ("b", "bold", None)] and found[1, 7] == []
    assert found[4, 0] == [("####### not ", "normal", None), ("x", "bold", None), (" ", "normal", None), ("t", "link", "https://e.example/a"), (" *lit* ", "normal", None), ("bi", "bold-italic", None), (" ", "normal", None), ("c", "code", None), (" ", "normal", None), ("i", "italic", None), (" [n](ftp://x)", "normal", None)]
    html = {r.doc_id: r.html for r in markup.render_blocks(markup.markdown_runs(blocks)).collect()}
    assert html[1].startswith("<h1>One <strong>b</strong></h1>\n<p>line a line <em>b</em></p>\n<ul>\n<li>x</li>\n<li>y</li>\n</ul>\n<ol>\n<li>z</li>\n</ol>\n<blockquote>q</blockquote>\n<hr>\n<pre><code>code\n\n  more</code></pre>")
    assert markup.render_blocks(markup.markdown_runs(markup.markdown_blocks(docs.limit(0)))).count() == 0


def test_lines_are_joined(spark):
    lines = [(1, 1, 0, " exam-", ""), (1, 1, 1, "ple ", ""), (1, 1, 2, None, ""), (1, 1, 3, "B-", ""), (1, 1, 4, "Big", ""), (1, 2, 0, "漢", ""), (1, 2, 1, "字", ""), (1, 2, 2, "x", ""), (1, 2, 3, "y", "cjk-ja")]
    found = markup.join_lines(spark.createDataFrame(lines, "doc_id long, part int, pos int, text string, script string"))
    assert {r.part: r.text for r in found.collect()} == {1: "example B- Big", 2: "漢字xy"}


def test_outline(spark):
    heads = [(1, i, "heading", level, t) for i, (level, t) in enumerate([(2, "a"), (3, "b"), (3, "c"), (6, "d"), (2, "e"), (1, "f"), (4, "g")])]
    found = markup.heading_outline(spark.createDataFrame(heads, "doc_id long, pos int, type string, level int, text string"))
    assert {r.title: (r.outline_id, r.depth) for r in found.collect()} == {"a": ("1", 0), "b": ("1.1", 1), "c": ("1.2", 1), "d": ("1.2.1", 2), "e": ("2", 0), "f": ("3", 0), "g": ("3.1", 1)}


def test_pages_are_laid_out(spark):
    assert markup.wrap_text("aaa bbb ccc", 37, 10) == ["aaa bbb", "ccc"] and markup.wrap_text("漢字漢字", 20, 10) == ["漢字", "漢字"] and markup.wrap_text("", 20, 10) == [""]
    assert markup.text_width("i m", 10) == pytest.approx(13.2)
    blocks = spark.createDataFrame([(1, 0, "a " * 100), (1, 1, "b"), (2, 0, None)], "doc_id long, pos int, text string")
    found = markup.paginate(blocks, width=80, height=50, size=10, line_height=1.2, gap=8)
    lines = [(r.page_number, r.line_number, r.text) for r in found.where("doc_id = 1").orderBy("page_number", "line_number").collect()]
    assert "".join(t for *_, t in lines).replace(" ", "") == "a" * 100 + "b" and max(n for _, n, _ in lines) == 4 and len({p for p, *_ in lines}) > 2


def test_structure(spark):
    html = '<body><section lang="de"><h1>t</h1><div><img><img alt="x"></div></section><table><tr><td>c</td></tr></table><input title="n"><input></body>'
    pages = spark.createDataFrame([(1, html), (2, ""), (3, "<p></p>")], "page_id long, html string")
    found = checks.structure_elements(pages).cache()
    got = {".".join(map(str, r.path)): (r.tag, r.depth, r.children, r.alt, r.language) for r in found.where("page_id = 1").collect()}
    assert got["0"] == ("Sect", 0, 2, "", "de") and got["0.0"] == ("H1", 1, 0, "", "") and got["0.1.1"] == ("Figure", 2, 0, "x", "") and got["1.0.0"] == ("TD", 2, 0, "", "")
    tagged = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "page_id long, tagged boolean")
    summary = {r.page_id: r for r in checks.accessibility_summary(tagged, found).collect()}
    assert [summary[i].quality for i in (1, 2, 3, 4)] == ["meaningful", "baseline", "partial", "missing"]
    assert (summary[1].figures_without_alt, summary[1].fields_without_label, summary[1].headings, summary[1].tables) == (1, 1, 1, 1)


class Spy:
    """Stands for a table and keeps the function of a task."""

    def __getattr__(self, name):
        return lambda *_: self

    def mapInPandas(self, run, schema):
        return run


def test_blocks_and_lines_leave_a_task_in_pieces(spark):
    """Neither all rows of a batch at once nor a piece for each document."""
    import pandas as pd

    html = pd.DataFrame({"page_id": range(3_000), "html": ["<p>a</p>" * 20] * 3_000})
    for made in (markup.html_blocks(Spy()), checks.structure_elements(Spy())):
        sizes = [len(piece) for piece in made([html])]
        assert max(sizes) <= markup.HELD and sum(sizes) == 60_000
    docs = pd.DataFrame({"doc_id": range(30_000), "blocks": [[{"pos": 0, "text": "a b"}]] * 30_000})
    assert [len(piece) for piece in markup.paginate(Spy(), 451, 700)([docs.iloc[:15_000], docs.iloc[15_000:]])] == [markup.HELD] * 3


def test_word_differences_of_empty_sides(spark):
    from folio.operators import alignment

    pairs = spark.createDataFrame([(0, 1, "a b", "a c"), (1, 1, None, "a c"), (2, 1, "", None)], "doc_id long, page_number int, left string, right string")
    found = {(r.doc_id, r.pos): (r.kind, r.text) for r in alignment.diff_words(pairs).collect()}
    assert [found.pop((0, i)) for i in range(4)] == [("same", "a"), ("same", " "), ("removed", "b"), ("added", "c")]
    assert [found.pop((1, i)) for i in range(3)] == [("added", w) for w in ("a", " ", "c")] and not found
