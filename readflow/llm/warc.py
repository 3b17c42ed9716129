"""WARC archives of pages and their index: sorted runs of captures merged by a loser tree, range by range.

Writing. A page is a response record, HTTP head and all; of pages with equal payloads that of the smallest id is,
and the others become revisit records that refer to it. Payloads are compared by their digests, in a slim table;
texts are shuffled only where a filter can't clear them of being a repeat. Records are rows of Spark's own text
writer, whose line separator is the blank lines that end a record, so that archives go to any store that Spark
writes to, under its commit protocol, compressed as a whole file.

Reading. Spark's text reader cuts a compressed file at blank lines and keeps their order; a small parser puts the
pieces together again by the records' own lengths, whatever a payload holds. Any archive of gzip files can be read.

Index. What a task reads becomes runs of captures, each sorted by URL key and time, and written. Ranges of the keys
then get their part of every run, and a loser tree merges the parts, so that ranges and places in them are one
order of all captures. A URL with many captures lies in several ranges; none is held by one task.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import among, but_not, shared_checkpoints, stored

END = "\r\n\r\n"
#: Captures in a run and, about, in a range.
RUN, RANGE = 1 << 16, 1 << 18
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ENTRY = (
    "run long, seq long, urlkey string, time string, page_id long, record_type string, record_id string, refers_id string, payload_digest string, payload_bytes long, "
    "file string, number long, offset long, length long"
)


def base32(digest: Column) -> Column:
    """Base32 of 160 bits in hexadecimal: every 5 digits are 4 letters."""
    number = lambda i: F.conv(F.substring(digest, F.floor(i / 4).cast("int") * 5 + F.lit(1), F.lit(5)), 16, 10).cast("int")
    place = lambda i: F.floor(number(i) / F.pow(F.lit(32), 3 - i % 4)).cast("int") % 32
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substring(F.lit(LETTERS), place(i) + F.lit(1), F.lit(1))), "")


def named(pages: DataFrame, id_col: str, url_col: str, payload_col: str, time_col: str | None) -> DataFrame:
    """page_id, url, at (time), payload, digest, bytes, k1, k2 (equal for equal rows)."""
    page = F.col(id_col).cast("long")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    url = F.replace(F.replace(F.col(url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    at = F.col(time_col).cast("timestamp") if time_col else F.timestamp_seconds(F.lit(946_684_800) + F.pmod(page, F.lit(1_000_000_000)))
    slim = pages.select(page.alias("page_id"), url.alias("url"), F.coalesce(at, F.timestamp_seconds(F.lit(946_684_800))).alias("at"), payload.alias("payload"))
    slim = slim.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload").cast("long")})
    all_of = [F.col("page_id").isNull(), F.col("url").isNull(), "page_id", "url", "at", "digest"]
    return slim.withColumns({"k1": F.xxhash64(*all_of), "k2": F.xxhash64(F.lit("second"), *all_of)})


def record(kind: str, number: Column, refers: list[tuple[str, Column]], body: Column) -> Column:
    """A record without the blank lines that end it; fields of null values are left out."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    fields = [
        ("WARC-Type", F.lit(kind)), ("WARC-Record-ID", number), ("WARC-Date", stamp(F.col("at"))), ("WARC-Target-URI", F.col("url")), *refers, ("X-Page-ID", F.col("page_id").cast("string")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))), ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{name}: "), value) for name, value in fields]), F.lit(END), http, body)


def stamp(at: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def urn(k1: str, k2: str, row: Column) -> Column:
    """An identifier made of a row's key, and of its number where equal rows are records each."""
    bits = F.md5(F.concat_ws(" ", F.col(k1), F.col(k2), row))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(bits, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, least: int = 0) -> None:
    """Writes a record per row into archives in the folder ``path`` (new).

    Of payloads that are equal and have ``least`` bytes or more, the row of the smallest id (a null one last), then
    URL, is a response and the others are revisits of it; smaller ones are all responses. Of repeated rows one is
    the response. A null payload is empty, a null URL or id gives a record without that field, a line break in a
    URL is percent-encoded. Without a time column, or where it is null, the time is told by the id: so many
    seconds after the year 2000 began. An empty table makes no record. Other columns aren't read.
    """
    rows = named(pages, id_col, url_col, payload_col, time_col)
    slim = stored(rows.drop("payload").withColumn("row", F.monotonically_increasing_id()))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.coalesce("url", F.lit("")).alias("by"), "row", "url", "at", "k1", "k2")
    groups = slim.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    firsts = stored(groups.filter("n > 1").select("digest", *[F.col(f"first.{x}").alias(f"first_{x}") for x in ("row", "url", "at", "k1", "k2")]))
    later = stored(slim.join(firsts, "digest").filter("row <> first_row"))
    refers = [
        ("WARC-Refers-To", urn("first_k1", "first_k2", F.lit(""))), ("WARC-Refers-To-Target-URI", F.col("first_url")),
        ("WARC-Refers-To-Date", stamp(F.col("first_at"))), ("WARC-Profile", F.lit(REVISIT)),
    ]
    revisits = later.select(record("revisit", urn("k1", "k2", F.col("row")), refers, F.lit("")).alias("value"))
    again = "k1 = first_k1 and k2 = first_k2"
    responses = but_not(rows, ["k1", "k2"], later.filter(f"not ({again})").select("k1", "k2").distinct())
    doubled = later.filter(again).select("k1", "k2").distinct()
    if not doubled.isEmpty():
        once = among(responses, ["k1", "k2"], doubled).dropDuplicates(["k1", "k2"])
        responses = but_not(responses, ["k1", "k2"], doubled).unionByName(once.select(*responses.columns))
    row = F.when(F.col("bytes") < least, F.monotonically_increasing_id().cast("string")).otherwise("") if least else F.lit("")
    whole = responses.select(record("response", urn("k1", "k2", row), [], F.col("payload")).alias("value"))
    whole.unionByName(revisits).write.option("lineSep", END).option("compression", "gzip").text(path)


def parsed(pieces: Iterable[bytes]) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, fields (names in lower case) and block of the records whose stream was cut at blank lines into these pieces."""
    gap, held, start, need, fields, begin = END.encode(), bytearray(), 0, 0, None, 0
    for piece in pieces:
        held += piece
        held += gap
        while True:
            if fields is None:
                while held.startswith(b"\r\n"):
                    del held[:2]
                    start += 2
                end = held.find(gap)
                if end < 0:
                    break
                lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                if not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdigit():
                    raise ValueError("no WARC record")
                begin = end + len(gap)
                need = begin + int(fields["content-length"])
            if len(held) < need + len(gap):
                break
            yield start, need, fields, bytes(held[begin:need])
            del held[: need + len(gap)]
            start, fields = start + need + len(gap), None
    if fields is not None:
        raise ValueError("the last record is cut off")


def urlkey(url: str | None) -> str:
    """The host's parts, last first, then path and query, all in lower case: what sorts a site's pages together."""
    try:
        at = urlsplit((url or "").strip())
        host, port = (at.hostname or "").removeprefix("www."), f":{at.port}" if at.port not in (None, 80, 443) else ""
    except ValueError:
        return (url or "").lower()
    query = f"?{at.query}" if at.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){at.path or '/'}{query}".lower()


def entry(file: str, number: int, offset: int, length: int, fields: dict[str, str], block: bytes) -> dict:
    """What the index has of a record."""
    head, found, payload = block.partition(END.encode()) if "application/http" in fields.get("content-type", "") else (b"", b"", block)
    http = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    kind = fields.get("warc-type", "")
    if kind == "revisit":  # of the full payload
        said = http.get(b"content-length", b"").strip()
        size, digest = int(said) if said.isdigit() else None, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    page = fields.get("x-page-id")
    return {
        "urlkey": urlkey(fields.get("warc-target-uri")), "time": "".join(x for x in fields.get("warc-date", "") if x.isdigit()), "page_id": int(page) if page else None, "record_type": kind,
        "record_id": fields.get("warc-record-id"), "refers_id": fields.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "file": file, "number": number, "offset": offset, "length": length,
    }


def order_of(x: dict) -> tuple:
    """The order of captures: URL key, time, then what tells equal ones apart."""
    return x["urlkey"], x["time"], x["page_id"] is None, x["page_id"] or 0, x["file"], x["number"]


SCHEMA = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in ENTRY.split(", "))])


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archives in a folder, in runs that are sorted each: run and seq, and what entry() tells."""
    pieces = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = of_files(batches)
        ahead = next(rows, None)
        while ahead:
            file = ahead[0]

            def mine() -> Iterator[bytes]:
                nonlocal ahead
                while ahead and ahead[0] == file:
                    yield ahead[1]
                    ahead = next(rows, None)

            for number, (offset, length, fields, block) in enumerate(parsed(mine())):
                yield entry(file, number, offset, length, fields, block)

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held = TaskContext.get().partitionId() << 24, []

        def sealed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([x | {"run": run, "seq": i} for i, x in enumerate(sorted(held, key=order_of))], SCHEMA)

        for x in captures(batches):
            held.append(x)
            if len(held) == RUN:
                yield sealed()
                run, held = run + 1, []
        yield sealed()

    return pieces.mapInArrow(sorted_runs, ENTRY)


class LoserTree:
    """The least of the heads of k sorted runs; every inner node remembers who lost there, so a step replays one path."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * max(k, 1)
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; a run that has ended comes last, equal heads go by the run."""
        if self.at[a] == len(self.runs[a]):
            return False
        if self.at[b] == len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or x == y and a < b

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """Runs and places in them, in the order of all."""
        for _ in range(sum(map(len, self.runs))):
            now = self.winner
            yield now, self.at[now]
            self.at[now] += 1
            node = (now + len(self.runs)) // 2
            while node > 0:
                if self._before(self.losers[node], now):
                    self.losers[node], now = now, self.losers[node]
                node //= 2
            self.winner = now


def merged(captures: DataFrame) -> DataFrame:
    """The captures of runs() with part and pos: parts, and places in a part, are the order of all captures."""
    spark = captures.sparkSession
    parts = max(math.ceil(captures.count() / RANGE), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = captures.repartitionByRange(parts, "urlkey", "time", F.asc_nulls_last("page_id"), "file", "number")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), SCHEMA)  # a range
        held = held.sort_by([("run", "ascending"), ("seq", "ascending")])  # shuffled blocks come in any order, runs are whole again
        if not held.num_rows:
            return
        run = held["run"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        keys = [order_of(dict(zip(KEYS, x, strict=True))) for x in zip(*(held[c].to_pylist() for c in KEYS), strict=True)]
        ends = np.append(starts[1:], len(run))
        tree = LoserTree([keys[a:b] for a, b in zip(starts, ends, strict=True)])
        at = np.fromiter((starts[r] + i for r, i in tree), np.int64, len(run))
        part = np.full(len(at), TaskContext.get().partitionId())
        whole = held.take(pa.array(at)).append_column("part", pa.array(part, pa.int64())).append_column("pos", pa.array(np.arange(len(at))))
        yield from whole.to_batches(max_chunksize=10_000)

    return ranged.mapInArrow(merge, f"{ENTRY}, part long, pos long")


KEYS = ["urlkey", "time", "page_id", "file", "number"]


def index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives in a folder, in one order (part, pos) by URL key and time.

    Columns: part, pos, urlkey, time, page_id, record_type, payload_digest, payload_bytes, refers_to (the page_id
    of the record that a revisit refers to; null if the archives lack it), and the record's file, number in
    it, and offset and length in the file's uncompressed stream. Captures of equal key and time go by their page_id, a
    null one last, then by their place. A payload's size and digest are those of what was read; of a revisit, those
    of the full payload that it names. Archives without records give no rows; a file that is no WARC, or whose
    last record is cut off, is an error.
    """
    captures = stored(merged(stored(runs(spark, path))))
    known = captures.filter("record_type <> 'revisit' and record_id is not null").groupBy(F.col("record_id").alias("refers_id")).agg(F.min("page_id").alias("refers_to"))
    found = captures.filter("refers_id is not null").select("part", "pos", "refers_id").join(stored(known), "refers_id").select("part", "pos", "refers_to")
    cols = ["part", "pos", "urlkey", "time", "page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "file", "number", "offset", "length"]
    return captures.join(found, ["part", "pos"], "left").select(*cols)


def histories(captures: DataFrame) -> DataFrame:
    """urlkey, captures, first, last, payloads: how often and when a URL was captured, and with how many payloads in a row that differ."""
    was = F.lag("payload_digest").over(W.partitionBy("urlkey").orderBy("part", "pos"))
    changed = captures.withColumn("_new", F.when(was.isNull() | (was != F.col("payload_digest")), 1).otherwise(0))
    return changed.groupBy("urlkey").agg(F.count("*").alias("captures"), F.min("time").alias("first"), F.max("time").alias("last"), F.sum("_new").alias("payloads"))


def archived(pages: DataFrame, path: str | None = None, **named_cols) -> DataFrame:
    """index() of the archives that write_warc() makes of pages, by default in a new folder of the shared one."""
    spark = pages.sparkSession
    if path is None:
        shared_checkpoints(spark)
        path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/warc-{uuid.uuid4()}"
    write_warc(pages, path, **named_cols)
    return index(spark, path)
