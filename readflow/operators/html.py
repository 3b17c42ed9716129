"""Pages to articles: ordered paragraphs of the main content, with built-in functions alone.

A page is cut into tokens (tags, comments, texts) by one expression that never goes back over what it has read, and
the tokens become rows. Tags are matched by windows: within a page and a name the running number of open tags gives
each tag its level, and within a level the next tag closes the one before. A subtree is then an interval of places,
and a running maximum of ends tells what lies inside. All windows share the page's hash, so pages are shuffled once.
What is read is joined again with a mark wherever a paragraph ends, and cut there.
"""

from __future__ import annotations

import html
from html.entities import html5, name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import parted

# Tags that part paragraphs, tags without text to read, and tags without content.
BLOCKS = frozenset("address article aside blockquote dd details div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p section summary ul".split())
SKIPPED = frozenset("script style noscript template svg math rt rp table".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# What a wiki puts around its articles (an id, a class), notes in brackets, and the characters between which a line break is no blank.
CHROME_ID, CHROME_CLASS = "siteSub", "mw-editsection"
NOTE = r"\[[^\[\]\x01\x02]+\]"
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"

#: Marks in the text of a page while it is joined; a page's own such characters are replaced, since HTML has none.
SUP, END, PARTED = "\x01", "\x02", "\x03"
#: Parts of a page around its content; a header only outside the content.
FRAME = ["nav", "footer", "aside"]
#: Parts of a page that may hold the content where no element says that it does.
HOLDERS = ["body", "div", "section", "td"]
#: Of these the ones stay that have this share of the best one's score or more.
LEAST_SHARE = 0.2
#: Elements whose content is text whatever it looks like.
RAW = "script|style|textarea|title"
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
TOKEN = rf"""(?is)<!--(?:-?>|.*?(?:-->|\z))|<({RAW})(?=[\s/>]){_ATTRIBUTES}(?:\z|>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z))|</?[a-z]{_ATTRIBUTES}(?:>|\z)|<[!?/][^>]*+(?:>|\z)|(?:[^<]++|<(?![a-z/!?]))++"""
_FAR = 2**31 - 1
_PAGE = ["page_id", "_hash", "_row"]


def collapsed(text: Column) -> Column:
    """White space as single blanks; a line break between two CJK characters goes."""
    space = f"[{T.SPACE}]"
    joined = F.when(text.contains("\n"), F.regexp_replace(text, rf"(?<=[{CJK}])[{T.SPACE}&&[^\n]]*\n{space}*(?=[{CJK}])", "")).otherwise(text)
    return F.trim(F.regexp_replace(joined, f"{space}+", " "))


# --- entities ------------------------------------------------------------------------------------

#: Names that count without a semicolon too, longest first, so that none hides another.
LEGACY = sorted((x for x in html5 if not x.endswith(";")), key=lambda x: (-len(x), x))
#: What most texts have no others than; the ampersand is last, so that what it makes isn't read again.
COMMON = {x: html.unescape(x) for x in ("&nbsp;", "&lt;", "&gt;", "&quot;", "&#39;", "&copy;", "&middot;", "&amp;")}
#: The code points that a page's numbers from 128 to 159 stand for.
WINDOWS = {str(i): html.unescape(f"&#{i};") for i in range(128, 160)}
_ENTITY = rf"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|(?:{'|'.join(sorted(name2codepoint, key=lambda x: (-len(x), x)))});|(?:{'|'.join(LEGACY)}))"


def _table(known: dict[str, str]) -> Column:
    """A map of fixed size, as one literal."""
    return F.str_to_map(F.lit("\1".join(f"{k}\2{v}" for k, v in known.items())), F.lit("\1"), F.lit("\2"))


def _numbered(entity: Column) -> Column:
    """The character of a numeric reference; what is no character becomes the replacement character."""
    hexadecimal = F.lower(F.substring(entity, 3, 1)) == "x"
    digits = F.regexp_replace(F.rtrim(F.substring(entity, F.when(hexadecimal, 4).otherwise(3), F.length(entity)), F.lit(";")), "^0+", "")
    number = F.conv(F.when(F.length(digits) > 8, "ffffffff").when(hexadecimal, digits).otherwise(F.conv(F.nullif(digits, F.lit("")), 10, 16)), 16, 10).cast("long")
    number = F.coalesce(number, F.lit(0))
    lost = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    none = number.between(1, 8) | (number == 11) | number.between(14, 31) | number.between(127, 159) | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(lost, "\ufffd").when(number == 13, "\r").when(number.between(128, 159), F.try_element_at(_table(WINDOWS), number.cast("string"))).when(none, "").otherwise(char)


def entities(text: Column) -> Column:
    """Named and numeric references as characters: the 252 names, and without a semicolon those that pages have always had."""
    named = {f"&{k};": html5[f"{k};"] for k in name2codepoint} | {f"&{k}": html5[k] for k in LEGACY}
    told = lambda x: F.when(x.startswith("&#"), _numbered(x)).otherwise(F.try_element_at(_table(named), x))
    whole = lambda x: F.when(F.startswith(x, F.lit("&")) & (F.length(x) > 1), told(x)).otherwise(x)
    plain = text
    for name, char in COMMON.items():
        plain = F.replace(plain, F.lit(name), F.lit(char))
    rare = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(rf"{_ENTITY}|[^&]++|&"), 0), whole), "")
    return F.when(~text.contains("&"), text).when(text.rlike(rf"&(?!(?:{'|'.join(x[1:] for x in COMMON)}))[#A-Za-z]"), rare).otherwise(plain)


# --- tokens --------------------------------------------------------------------------------------


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag as it is written; empty without it."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]++))"""
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def _over(*by: str, to_here: bool = False):
    over = W.partitionBy(*_PAGE, *by).orderBy("_pos")
    return over.rowsBetween(W.unboundedPreceding, 0) if to_here else over


def _levels(rows: DataFrame, by: list[str], step: Column, out: str) -> DataFrame:
    """rows with the number of open tags at each, where tags that close nothing don't count."""
    rows = rows.withColumn("_sum", F.sum(step).over(_over(*by, to_here=True)))
    return rows.withColumn(out, F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(_over(*by, to_here=True)))).drop("_sum")


def tokens(pages: DataFrame) -> DataFrame:
    """The tokens of pages (page_id, html), a row each, and where every element ends.

    Besides page_id and the keys of a page's row: _pos, _token, _name (of a tag, in lower case, else empty), _raw
    (an element whose content is text, in one token), _opens, _end (the place of the tag that closes an opening one,
    null if none does). A page without tokens has one row of nulls.
    """
    dealt = parted(pages.select("page_id", "html", F.xxhash64("html").alias("_hash")), "page_id", "_hash").withColumn("_row", F.monotonically_increasing_id())
    rows = dealt.select(*_PAGE, F.posexplode_outer(F.regexp_extract_all("html", F.lit(TOKEN), 0)).alias("_pos", "_token"))
    token = F.col("_token")
    name = F.when(token.startswith("<"), F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1))).otherwise("")
    rows = rows.withColumn("_name", F.coalesce(name, F.lit("")))
    tag, closes = F.col("_name") != "", token.startswith("</")
    raw = tag & ~closes & F.col("_name").isin(*RAW.split("|"))
    rows = rows.withColumns({"_raw": raw, "_opens": tag & ~closes & ~raw & ~F.col("_name").isin(*VOID) & ~token.endswith("/>")})
    step = F.when(F.col("_opens"), 1).when(closes & (F.col("_name") != ""), -1).otherwise(0)
    rows = _levels(rows, ["_name"], step, "_depth")
    level = F.when(F.col("_opens"), F.col("_depth")).when(closes & (F.col("_name") != ""), F.coalesce(F.lag("_depth").over(_over("_name")), F.lit(0)))
    rows = rows.withColumn("_level", level)
    following = F.lead(F.struct("_pos", "_opens")).over(_over("_name", "_level"))
    end = F.when(F.col("_opens") & ~following["_opens"], following["_pos"])
    return rows.withColumn("_end", end).drop("_depth", "_level")


def _within(which: Column, end: Column) -> Column:
    """Whether a token lies in one of these elements, its tags included."""
    return F.coalesce(F.max(F.when(which, end)).over(_over(to_here=True)) >= F.col("_pos"), F.lit(False))


def _pieces(rows: DataFrame, main: bool) -> DataFrame:
    """The tokens that matter (a page's first in any case), with _piece, their part of the page's text, and _title, _site, _lang.

    A piece is text with its references decoded, or a mark: PARTED where a paragraph ends, SUP and END around what is raised.
    """
    token, name, opens, end = F.col("_token"), F.col("_name"), F.col("_opens"), F.col("_end")
    far, closes = F.coalesce(end, F.lit(_FAR)), token.startswith("</")
    chrome = token.contains(CHROME_ID) & (attribute(token, "id") == CHROME_ID) | token.contains(CHROME_CLASS) & F.array_contains(F.split(attribute(token, "class"), r"\s+"), CHROME_CLASS)
    rows = rows.withColumn("_hides", opens & (name.isin(*SKIPPED) | chrome))
    # What is hidden already hides nothing more, however it ends.
    before = F.max(F.when(F.col("_hides"), end)).over(_over().rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_hides", F.col("_hides") & ~F.coalesce(before > F.col("_pos"), F.lit(False)))
    framed = _within(opens & name.isin(*FRAME), end) | (_within(opens & (name == "header"), end) & ~_within(opens & name.isin("article", "main"), far))
    rows = rows.withColumns({
        "_seen": ~(_within(F.col("_hides"), far) | (framed if main else F.lit(False))), "_pre": _within(opens & (name == "pre"), far),
        "_article": _within(opens & (name == "article"), far), "_main": _within(opens & (name == "main"), far), "_link": _within(opens & (name == "a"), end),
    })
    seen = F.col("_seen")
    kind = (
        F.when(F.col("_raw") & (name == "title"), "title").when((name == "meta") & token.contains("og:site_name") & (attribute(token, "property") == "og:site_name"), "site")
        .when((name == "html") & ~closes, "lang").when(seen & F.col("_raw") & (name == "textarea"), "text").when(seen & (name == "") & (~token.startswith("<") | token.rlike(r"\A<(?![a-zA-Z/!?])")), "text")
        .when(seen & (name == "sup"), "mark").when(seen & (~F.col("_pre") & name.isin(*BLOCKS, "br") | (name == "pre")), "mark")
    )
    holder = seen & name.isin(*HOLDERS) & (opens | closes)
    rows = rows.withColumns({"_kind": kind, "_holds": holder}).filter("_kind is not null or _holds or coalesce(_pos, 0) = 0")
    kind = F.col("_kind")
    inner = F.regexp_extract(token, r"(?is)\A<\w+[^>]*+>(.*?)(?:</[a-z]+[^>]*+>?)?\z", 1)
    value = F.when(kind == "site", attribute(token, "content")).when(kind == "lang", attribute(token, "lang")).when(kind.isin("title", "text"), F.when(F.col("_raw"), inner).otherwise(token))
    rows = rows.withColumn("_value", F.translate(entities(value), SUP + END + PARTED, "\ufffd" * 3))
    mark = F.when(kind == "mark", F.when(name != "sup", PARTED).when(closes, END).otherwise(SUP))
    text = F.when(kind == "text", F.when(F.col("_pre"), F.replace("_value", F.lit("\n"), F.lit(PARTED))).otherwise(F.col("_value")))
    said = F.when(kind == "text", F.length(F.regexp_replace("_value", f"[{T.SPACE}]+", ""))).otherwise(0) if main else F.lit(0)
    told = F.when(kind.isin("title", "site", "lang"), F.col("_value")).alias("_value")
    rows = rows.select(*_PAGE, "_pos", "_kind", told, F.coalesce(text, mark).alias("_piece"), said.alias("_said"), F.when(F.col("_holds"), F.when(closes, -1).otherwise(1)).otherwise(0).alias("_step"), "_article", "_main", "_link")
    return _chosen(rows) if main else rows


def _chosen(rows: DataFrame) -> DataFrame:
    """The tokens with no _piece outside the main content: all articles, else the main elements, else the parts with much text and few links.

    A part is the text that lies in the same innermost holder. Its score is its text at the share that is no link's; parts
    stay that reach LEAST_SHARE of the best one's score.
    """
    page = W.partitionBy(*_PAGE)
    rows = _levels(rows, [], F.col("_step"), "_depth")
    rows = rows.withColumn("_holder", F.max(F.when(F.col("_step") == 1, F.col("_pos"))).over(_over("_depth", to_here=True)))
    part = W.partitionBy(*_PAGE, "_depth", "_holder")
    text, linked = F.sum("_said").over(part), F.sum(F.when(F.col("_link"), F.col("_said")).otherwise(0)).over(part)
    rows = rows.withColumn("_score", F.when(text > 0, text * (1 - linked / text)).otherwise(0.0))
    found = lambda x: F.max(F.col(x) & (F.col("_said") > 0)).over(page)
    rows = rows.withColumns({"_articles": found("_article"), "_mains": found("_main"), "_best": F.max("_score").over(page)})
    read = (F.col("_score") > 0) & (F.col("_score") >= F.col("_best") * LEAST_SHARE) | (F.col("_kind") == "mark")
    keep = F.when(F.col("_articles"), F.col("_article")).when(F.col("_mains"), F.col("_main")).otherwise(read)
    return rows.withColumn("_piece", F.when(keep, F.col("_piece")))


def _read(pages: DataFrame, main: bool) -> DataFrame:
    """page_id, _lines (the paragraphs), _title, _site, _lang of every row of pages."""
    first = lambda kind: F.min(F.when((F.col("_kind") == kind) & F.col("_value").isNotNull(), F.struct("_pos", "_value")))["_value"].alias(f"_{kind}")
    pieces = F.array_sort(F.collect_list(F.when(F.col("_piece").isNotNull(), F.struct("_pos", "_piece"))))
    whole = F.array_join(F.transform(pieces, lambda x: x["_piece"]), "").alias("_text")
    rows = _pieces(tokens(pages), main).groupBy(*_PAGE).agg(whole, first("title"), first("site"), first("lang"))
    noted = F.when(F.col("_text").contains(SUP), F.regexp_replace("_text", rf"{SUP}[{T.SPACE}]*{NOTE}[{T.SPACE}]*{END}", "")).otherwise(F.col("_text"))
    return rows.withColumn("_lines", F.filter(F.transform(F.split(F.translate(noted, SUP + END, ""), PARTED), collapsed), lambda x: x != ""))


def paragraphs(pages: DataFrame, main: bool = True) -> DataFrame:
    """page_id, pos, paragraph of pages (page_id, html): of the main content, or of whole pages.

    Block tags and line breaks part paragraphs, preformatted text by its lines; what has no text to read, a wiki's
    chrome and notes in brackets go. A null or empty page has none.
    """
    return _read(pages, main).select("page_id", F.posexplode("_lines").alias("pos", "paragraph"))


def with_title(title: Column, text: Column) -> Column:
    """The text below its title, unless the title starts with the text's first line or is empty."""
    first = T.trim(F.regexp_extract(text, r"\A([^\n]*)", 1))
    return F.when((title != "") & ~((first != "") & title.startswith(first)), F.concat(title, F.lit("\n\n"), text)).otherwise(text)


def articles(pages: DataFrame) -> DataFrame:
    """page_id, title, site_name, lang, text, reason of pages (page_id, html) of any markup.

    The title is the first one's, the site's name and the language are those of the first tags that tell them.
    A page without text is unextractable; a null one too.
    """
    title, text = T.trim(F.coalesce("_title", F.lit(""))), F.array_join("_lines", "\n\n")
    rows = _read(pages, main=True).select("page_id", title.alias("title"), F.nullif("_site", F.lit("")).alias("site_name"), F.nullif("_lang", F.lit("")).alias("lang"), text.alias("text"))
    text = F.col("text")
    return rows.withColumns({"text": F.when(text != "", with_title(F.col("title"), text)), "reason": F.when(text == "", "unextractable")})
