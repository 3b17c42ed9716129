"""Files to texts: routing, decoding, plain texts and e-books; and the writers."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from ..functions import text as T

# Right marks (lower case), the cap on inflated sizes, tags of e-book pages.
RIGHTS = ["meta-inf/encryption.xml", "meta-inf/rights.xml", "meta-inf/license.lcpl", "meta-inf/sinf.xml"]
MOST_BYTES = 64 * 1024 * 1024
HIDDEN = frozenset("head script style rt rp".split())
BREAKING = frozenset("address article aside blockquote body br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, kind (txt, epub or null) and reason (unsupported-file) of files."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1))
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    known = kind.isin("txt", "epub")
    return rows.select("path", "content", F.when(known, kind).alias("kind"), F.when(~known, "unsupported-file").alias("reason"))


def _decoded(charset: str, errors: str):
    return F.pandas_udf(lambda x: x.map(lambda b: None if b is None else _try(bytes(b), charset, errors)), "string", PandasUDFType.SCALAR)


def _try(b: bytes, charset: str, errors: str) -> str | None:
    try:
        return b.decode(charset, errors)
    except (UnicodeDecodeError, LookupError):
        return None


def decode_text(content: Column) -> Column:
    """Strict UTF-8, else strict Shift_JIS, else null. Only what isn't UTF-8 goes to Python; a leading BOM goes."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    other = _decoded("shift_jis", "strict")(F.when(utf8.isNull(), content))
    return F.coalesce(F.regexp_replace(utf8, "\\A" + chr(0xFEFF), ""), other)


def import_texts(files: DataFrame) -> DataFrame:
    """path, text, reason of the txt files of read_files()."""
    raw = files.filter("kind = 'txt'").select("path", decode_text(F.col("content")).alias("raw"))
    rows = raw.select("path", "raw", T.import_plain(F.col("raw")).alias("text"))
    why = F.when(F.col("raw").isNull(), "unsupported-encoding").otherwise(T.empty_reason(F.col("text")))
    return rows.select("path", F.when(why.isNull(), F.col("text")).alias("text"), why.alias("reason"))


def html_charset(content: Column, content_type: Column) -> Column:
    """Charset name of a page: of its Content-Type, else of the first meta tag in 4,096 bytes that has one, else utf-8."""
    name = r"""(?i)charset\s*=\s*["']?([\w.:-]+)"""
    head = F.decode(F.encode(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), "UTF-8"), "UTF-8")
    tags = F.split(head, "(?i)<meta")
    meta = F.filter(F.transform(F.slice(tags, 2, F.greatest(F.size(tags) - 1, F.lit(0))), lambda x: F.regexp_extract(F.substring_index(x, ">", 1), name, 1)), lambda x: x != "")
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(F.coalesce(content_type, F.lit("")), name, 1), F.lit("")), F.get(meta, F.lit(0)), F.lit("utf-8")))


def decode_html(content: Column, content_type: Column) -> Column:
    """A page's text; bad bytes become replacement characters, unknown charsets are read as UTF-8."""

    def decode(x: pd.Series, names: pd.Series) -> pd.Series:
        def one(b, name):
            if b is None:
                return None
            out = _try(bytes(b), name, "replace")
            return bytes(b).decode("utf-8", "replace") if out is None else out

        return pd.Series([one(b, n) for b, n in zip(x, names, strict=True)], dtype=object)

    return F.pandas_udf(decode, "string", PandasUDFType.SCALAR)(content, html_charset(content, content_type))


def archive_entries(books: DataFrame) -> DataFrame:
    """book_id, path, declared_size, encrypted of the entries of books (book_id, content); equal paths add up."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for book, content in zip(pdf["book_id"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        rows += [(book, x.filename, x.file_size, bool(x.flag_bits & 1)) for x in z.infolist()]
                except (zipfile.BadZipFile, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=["book_id", "path", "declared_size", "encrypted"])

    raw = books.select("book_id", "content").mapInPandas(entries, "book_id string, path string, declared_size long, encrypted boolean")
    return raw.groupBy("book_id", "path").agg(F.sum("declared_size").alias("declared_size"), F.bool_or("encrypted").alias("encrypted"))


def resolve(base: str, href: str) -> str:
    """An href of a package as an archive path: no query or fragment, escapes decoded, dots collapsed."""
    from urllib.parse import unquote

    target = href.split("#")[0].split("?")[0]
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(target))).lstrip("/") if target else base


def decode_xml(content: bytes) -> str:
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace")
    return content.decode("utf-8-sig", "replace")


_named = re.compile(r"<!\[CDATA\[.*?\]\]>|<!--.*?-->|&([A-Za-z][A-Za-z0-9]*);", re.DOTALL)


def numbered(xml: str) -> str:
    """xml with named entities that XML lacks as numeric references; CDATA sections and comments stay."""

    def one(m: re.Match) -> str:
        to = html5.get(f"{m[1]};") if m[1] and m[1] not in ("amp", "lt", "gt", "quot", "apos") else None
        return "".join(f"&#{ord(c)};" for c in to) if to else m[0]

    return _named.sub(one, xml)


class _Lines(HTMLParser):
    """Lines of an e-book page and its first heading."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.part, self.hidden, self.pre, self.title, self.heading = [], [], 0, 0, None, None

    def flush(self):
        text = "".join(self.part)
        self.part = []
        for line in text.split("\n") if self.pre else [" ".join(text.split())]:
            if line := line.strip():
                self.lines.append(line)
                if self.heading and self.title is None:
                    self.title = line

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        if tag in BREAKING and not self.hidden:
            self.flush()
            self.heading = tag if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else self.heading
            self.pre += tag == "pre"

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BREAKING and not self.hidden:
            self.flush()
            self.pre = max(0, self.pre - (tag == "pre"))
            if tag == self.heading:
                self.heading = None

    def handle_data(self, data):
        if not self.hidden:
            self.part.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA[") and not self.hidden:
            self.part.append(data[6:])


def page_lines(xhtml: str) -> tuple[list[str], str | None]:
    reader = _Lines()
    reader.feed(xhtml)
    reader.close()
    reader.flush()
    return reader.lines, reader.title


def _spine(z: zipfile.ZipFile, skip_nav: bool) -> list[tuple[str, str | None]]:
    """The package's path and the spine's documents in order (path; null for one the manifest lacks)."""
    tags = lambda root, name: [x for x in root.iter() if x.tag.rpartition("}")[2] == name]
    container = ElementTree.fromstring(numbered(decode_xml(z.read("META-INF/container.xml"))))
    package = tags(container, "rootfile")[0].get("full-path")
    root = ElementTree.fromstring(numbered(decode_xml(z.read(package))))
    items = {x.get("id"): x for x in tags(root, "item")}
    out = []
    for ref in tags(root, "itemref"):
        if ref.get("linear") == "no":
            continue
        item = items.get(ref.get("idref"))
        if skip_nav and item is not None and "nav" in (item.get("properties") or "").split():
            continue
        out.append((package, None if item is None or not item.get("href") else resolve(package, item.get("href"))))
    return out


def chapters(books: DataFrame, app_rules: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """book_id, spine_pos, title, text, reason: the spine's documents of books (book_id, content).

    A book that fails has one row with its reason: drm, too-large or invalid-epub. With app_rules, rights count only
    for spine documents, navigation pages are skipped and repeated documents count again in the size.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for book, content in zip(pdf["book_id"], pdf["content"], strict=True):
                rows += [(book, *x) for x in _chapters(bytes(content), app_rules, most_bytes)]
            yield pd.DataFrame(rows, columns=["book_id", "spine_pos", "title", "text", "reason"])

    return books.select("book_id", "content").mapInPandas(read, "book_id string, spine_pos int, title string, text string, reason string")


def _chapters(content: bytes, app_rules: bool, most_bytes: int) -> list[tuple]:
    fail = lambda why: [(None, None, None, why)]
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            sizes: dict[str, int] = {}
            for x in z.infolist():
                sizes[x.filename] = sizes.get(x.filename, 0) + x.file_size
            if not app_rules and any(x.lower() in RIGHTS for x in sizes):
                return fail("drm")
            spine = _spine(z, app_rules)
            paths = [p for _, p in spine]
            if app_rules and (any(x.flag_bits & 1 for x in z.infolist()) or _ciphered(z, paths)):
                return fail("drm")
            if any(p is None or p not in sizes for p in paths):
                return fail("invalid-epub")
            counted = paths if app_rules else set(paths)
            if sum(sizes[p] for p in counted) + sum(sizes.get(p, 0) for p in {"META-INF/container.xml", *(k for k, _ in spine)}) > most_bytes:
                return fail("too-large")
            out = []
            for i, p in enumerate(paths):
                lines, title = page_lines(decode_xml(z.read(p)))
                if lines:
                    out.append((i, title or lines[0], "\n".join(lines), None))
            return out or fail("empty")
    except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError, TypeError, AttributeError):
        return fail("invalid-epub")


def _ciphered(z: zipfile.ZipFile, paths: list[str | None]) -> bool:
    """Whether a spine document is listed as encrypted."""
    name = next((x for x in z.namelist() if x.lower() == "meta-inf/encryption.xml"), None)
    if name is None:
        return False
    root = ElementTree.fromstring(decode_xml(z.read(name)))
    listed = {resolve("", x.get("URI") or "") for x in root.iter() if x.tag.rpartition("}")[2] == "CipherReference"}
    return any(p in listed for p in paths)


def book_texts(chapter_rows: DataFrame) -> DataFrame:
    """book_id, text, reason: the documents of chapters() joined in order."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("spine_pos", "text")))), lambda x: x["text"]), "\n")
    out = chapter_rows.groupBy("book_id").agg(ordered.alias("text"), F.max("reason").alias("reason"))
    return out.select("book_id", F.when(F.col("reason").isNull(), T.normalise(F.col("text"))).alias("text"), "reason")


def write_units(units: DataFrame, path: str) -> None:
    units.write.mode("overwrite").partitionBy("language").parquet(path)


def write_daily(days: DataFrame, path: str) -> None:
    days.write.mode("overwrite").partitionBy("date").parquet(path)
