"""Pages to paragraphs and articles: against the standard library's parser, hand-made pages, and hostile ones."""

import html as entities
import re
import time
from html.parser import HTMLParser

import pytest
import regex
from pyspark.sql import functions as F

from readflow.operators import html, shared

SPACE = re.compile("[\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
CJK = r"\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\u3000-\u303f\uff00-\uffef"
FOLD = regex.compile(rf"(?<=[{CJK}])[^\S\n]*\n\s*(?=[{CJK}])")
MARK = re.compile(r"\[[^\[\]]+\]")


def collapsed(text):
    return SPACE.sub(" ", FOLD.sub("", text)).strip(" ")


class Reader(HTMLParser):
    """Collects the paragraphs of a page; a stack tells what is skipped and what is chrome."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.part: list[str] = []
        self.hidden: list[str] = []
        self.pre = 0
        self.sup: list[int] = []

    def flush(self) -> None:
        text = "".join(self.part)
        self.part = []
        for line in text.split("\n") if self.pre else [text]:
            if line := collapsed(line):
                self.out.append(line)

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            if tag not in html.VOID:
                self.hidden.append(tag)
            return
        known = dict(attrs)
        chrome = known.get("id") == "siteSub" or "mw-editsection" in (known.get("class") or "").split()
        if (tag in html.SKIPPED or tag == "title" or chrome) and tag not in html.VOID:
            self.hidden.append(tag)
        elif tag == "br":
            if not self.pre:
                self.flush()
        elif tag == "sup":
            self.sup.append(len(self.part))
        elif tag == "pre":
            self.flush()
            self.pre += 1
        elif tag in html.BLOCKS and not self.pre:
            self.flush()

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
        elif tag == "sup" and self.sup:
            at = self.sup.pop()
            if MARK.fullmatch("".join(self.part[at:]).strip()):
                del self.part[at:]
        elif tag == "pre" and self.pre:
            self.flush()
            self.pre -= 1
        elif tag in html.BLOCKS and not self.pre:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.part.append(data)


def parsed(page):
    """The paragraphs of a whole page by the parser."""
    reader = Reader()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return reader.out


def frame(spark, pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")


def paragraphs(spark, pages, main):
    got = [[] for _ in pages]
    for r in html.paragraphs(frame(spark, pages), main).orderBy("page_id", "pos").collect():
        assert r.pos == len(got[r.page_id])
        got[r.page_id].append(r.paragraph)
    return got


ODD = [
    "<nav>n</nav><p>a<b>b</b> c<br>d</p><pre>x\n y</pre><sup>[4]</sup><sup>2</sup><ruby>漢<rt>かん</rt></ruby>日本\n語<table><tr><td>t</table><span class='mw-editsection'>e</span>&amp;",
    None, "", "plain", "<", "a < b <3 & c", "<p>one<p>two<li>three", "<p title=\"a>b\">q</p>", "<p title='a>b' x=\"'\">q<i>r</i></p>", "<div id=siteSub>gone</div>kept<span id='siteSubs'>kept too</span>",
    "<pre>l1\n l2\n\nl3<div>same line</div></pre>after", "<sup>[1]</sup>x<sup> [注 2] </sup>y<sup>[a][b]</sup>z<sup>th</sup><sup>[]</sup>", "a<script>if (a < b) { '</p>' }</script>b<style>p{}</style>c<noscript><p>no</noscript>d",
    "<!-- <p>hidden --> shown <!-- - > -->x", "日本\n語 speed\nreading は\n　速い", "<svg><title>t</title><text>x</text></svg>y<math><mi>z</mi></math>w", "<table><tr><td>a<table><tr><td>b</table>c</table>d",
    "</div></p>stray</table>closes<template>x</template>", "<BR><P>Upper</P><Script>x</SCRIPT>case", "<a href=x>in</a>line <em>tags</em> <unknown-tag>stay</unknown-tag>", "<ul><li>1<li>2</ul><dl><dt>k<dd>v</dl><hr>end<br/>x",
    "&lt;p&gt; &eacute;&#233;&#xe9; &copy 2 &notit; &hearts; &#128; &#0; &unknown; &", "x\u00a0\u3000 y\u2028z", "<sup>[<b>3</b>]</sup>t", "<p>a</p>\n\n  <p> </p><p>b",
]


def test_whole_pages(spark):
    assert paragraphs(spark, ODD, main=False) == [parsed(x) for x in ODD]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_pages(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("html").collect()]
    assert paragraphs(spark, pages, main=False) == [parsed(x) for x in pages]


WITHOUT = "<html lang='en'><body><div class=menu><a href=1>Home</a> <a href=2>About us</a></div><div id=c><p>The first paragraph of the story, long enough.</p><p>The second with <a href=3>a link</a>.</p></div><div>Also a part of the story, in a part of its own.</div><div>ad</div></body></html>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><nav>menu</nav><article><nav>menu</nav><header><h1>Head</h1></header><p>a</p><aside>side</aside></article><footer>f</footer></body>", "Head\n\na"),
        ("<article><p>one</p></article><p>between</p><article><p>two</p></article>", "one\n\ntwo"),
        ("<article><p>outer</p><article><p>inner</p></article><p>after the inner end</p></article><p>out</p>", "outer\n\ninner\n\nafter the inner end"),
        ("<article> <img></article><main><p>m</p></main><p>rest</p>", "m"),
        ("<body><header>h</header><main><header>kept</header>m<pre>l1\n l2</pre></main>", "kept\n\nm\n\nl1\n\nl2"),
        (WITHOUT, "The first paragraph of the story, long enough.\n\nThe second with a link.\n\nAlso a part of the story, in a part of its own."),
        ("<p>no body</p>text", "no body\n\ntext"),
        ("<p>x<sup>[<br>4]</sup>y<sup>[5]</sup></p>", "xy"),
        ("a<!-->b<!--->c<!-- never closed <p>d", "abc"),
        ("<article><p>x<sup>[1]</sup></p><div id='siteSub'>From</div><h2>H<span class='a mw-editsection'>[edit]</span></h2><p>日本\n語</p><p title=\"a>b\">q</p></article>", "x\n\nH\n\n日本語\n\nq"),
    ],
)
def test_main_content(spark, page, text):
    assert html.articles(frame(spark, [page])).first().text == text


def test_articles(spark):
    said = "<html lang=ja><head><title> A &amp; B\n</title><meta content='Site &quot;x&quot;' property='og:site_name'></head><body>"
    pages = [said + "<article><p>text</p></article>", said, None, "", "<title>text</title><p>text of the page</p>", "<title>text of</title><p>text</p>", said + "<svg><title>other</title></svg><p>x"]
    rows = [tuple(r)[1:] for r in html.articles(frame(spark, pages)).orderBy("page_id").collect()]
    head = ("A & B", 'Site "x"', "ja")
    assert rows == [
        (*head, "A & B\n\ntext", None), (*head, None, "unextractable"), ("", None, None, None, "unextractable"), ("", None, None, None, "unextractable"),
        ("text", None, None, "text\n\ntext of the page", None), ("text of", None, None, "text", None), (*head, "A & B\n\nx", None),
    ]
    # Repeated pages, ids that repeat or are null, other columns.
    twice = spark.createDataFrame([(1, "<p>a", 5), (1, "<p>a", 6), (1, "<p>b", 7), (None, "<p>c", 8), (None, "<p>c", 8)], "page_id long, html string, _pos int")
    assert sorted((str(r.page_id), r.text) for r in html.articles(twice).collect()) == [("1", "a"), ("1", "a"), ("1", "b"), ("None", "c"), ("None", "c")]
    assert html.articles(twice.limit(0)).count() == 0


def test_one_shuffle(spark):
    plan = html.articles(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan and plan.count("FileScan") == 1


def test_every_name(spark):
    """The 252 names, and every name that counts without a semicolon."""
    names = [f"&{x};" for x in html.name2codepoint] + [f"&{x}" for x in html.LEGACY] + [f"&amp;{x};" for x in ("lt", "amp", "eacute")]
    assert len(html.name2codepoint) == 252
    texts = [(f"a{x} b",) for x in names] + [(f"&#{i}; &#x{i:X};&#{i}",) for i in (0, 1, 9, 10, 13, 65, 127, 128, 150, 159, 160, 233, 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**12)] + [("&#;&#x;&;& &x &#00065;",)]
    for r in spark.createDataFrame(texts, "t string").select("t", html.entities(F.col("t")).alias("u")).collect():
        assert r.u == entities.unescape(r.t), r.t


@pytest.mark.parametrize("unit", ["<script>", '<a b="', "<", "<!--", "&amp", "<a =", "</div>", "<title>", "word ", "&#"])
def test_hostile_pages(spark, unit):
    html.articles(frame(spark, ["<p>x"])).collect()
    start = time.time()
    html.articles(frame(spark, [unit * (2**20 // len(unit))])).collect()
    assert time.time() - start < 60  # seconds where going back would take hours


def test_parts_grow_with_the_pages(spark, tmp_path, monkeypatch):
    """A task's share of the pages is bounded, whatever number of parts the session asks for."""
    spark.createDataFrame([(i, f"<article><p>{i} a</p></article>") for i in range(60)], "page_id long, html string").write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    monkeypatch.setattr(shared, "PART_BYTES", 100)
    many = shared.parts(pages)
    assert many > 4 and "_hash#" in (plan := html.tokens(pages)._jdf.queryExecution().executedPlan().toString()) and f", {many}), REPARTITION_BY_NUM" in plan
    assert html.paragraphs(pages).count() == 60
