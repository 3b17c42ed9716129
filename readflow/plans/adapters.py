"""The driver's tables as inputs of the jobs (same rules as in the SQL twins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reader, ts, ts_ms, seq, event_type, value, k of the events table."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("reader"), "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("seq"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader actions: view plays, error pauses, click advances, purchase finishes; the text is k."""
    kind = F.when(F.col("event_type") == "view", "play").when(F.col("event_type") == "error", "pause").when(F.col("event_type") == "click", "advance").when(F.col("event_type") == "purchase", "finish")
    return events(spark, sf_dir).select("reader", F.col("k").cast("string").alias("text_hash"), "ts_ms", "seq", kind.alias("action"), F.lit(0).alias("arg")).filter("action is not null")


def finishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'purchase'").select(
        "reader", F.col("k").cast("string").alias("text_hash"), F.col("ts").alias("finished_at"), "seq", F.col("k").cast("long").alias("ja_characters"),
        F.floor("value").alias("en_words"), F.floor(F.col("value") * 1000).alias("played_ms"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'click'").select("reader", F.col("k").cast("string").alias("text_hash"), F.col("k").alias("unit_index"), F.lit(100).alias("unit_count"), F.col("ts").alias("saved_at"), "seq")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (as imported) and text_hash of the documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.import_plain(F.col("text")).alias("text"))
    return rows.withColumn("text_hash", T.text_hash(F.col("text")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.canonical(url).alias("canonical_url"), urls.host(url).alias("host"), urls.path(url).alias("path"), urls.reason(url).alias("reason"))


#: Robots files by the class of a host, the length of its name modulo 3.
ROBOTS = {
    0: "User-agent: *\nDisallow: /en/\nAllow: /en/*5\n",
    1: "User-agent: readbot\nDisallow: /*.html$\nAllow: /fr\n\nUser-agent: *\nDisallow: /\n",
    2: "User-agent: other\nUser-agent: *\nDisallow: /de # no German\nAllow: /de\nDisallow: /*ref=\n",
}


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = pages(spark, sf_dir).filter("reason is null").select("host").distinct()
    which = F.length("host") % 3
    text = F.when(which == 0, ROBOTS[0]).when(which == 1, ROBOTS[1]).otherwise(ROBOTS[2])
    return hosts.withColumn("robots_text", text)


def robots_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """url, status, robots_text of fetches of robots files, and their redirects (from_url, to_url), by the length of the host's name.

    Modulo 5, none is there (0), the host fails (1), or the file lies behind two hops (2, the second one relative); modulo 10, a
    hop leads to an address that isn't public (3).
    """
    rows = robots_files(spark, sf_dir).withColumn("n", F.length("host"))
    own, far, last = (F.concat(F.lit("https://"), F.lit(sub), "host", F.lit(path)) for sub, path in (("", "/robots.txt"), ("files.", "/a/b.txt"), ("files.", "/robots/all.txt")))
    status = F.when(F.col("n") % 5 == 0, 404).when(F.col("n") % 5 == 1, 503).otherwise(200)
    log = rows.select(F.when(F.col("n") % 5 == 2, last).otherwise(own).alias("url"), status.alias("status"), F.when(status == 200, F.col("robots_text")).alias("robots_text"))
    hops = rows.filter("n % 5 = 2").select(own.alias("from_url"), far.alias("to_url")).unionByName(rows.filter("n % 5 = 2").select(far.alias("from_url"), F.lit("../robots/all.txt").alias("to_url")))
    return log, hops.unionByName(rows.filter("n % 10 = 3").select(own.alias("from_url"), F.lit("http://10.0.0.1/robots.txt").alias("to_url")))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url (canonical), page_id, status, content_type, size: what a fetch of each page answers, by its number, without its text; of pages with one URL the first."""
    rows = table(spark, sf_dir, "pages").select(urls.canonical(F.col("url")).alias("url"), "page_id", F.octet_length("html").alias("size"))
    status = F.when(F.col("page_id") % 11 == 0, 404).when(F.col("page_id") % 11 == 1, 503).otherwise(200)
    kind = F.when(F.col("page_id") % 13 == 0, "application/pdf").otherwise("text/html; charset=utf-8")
    return rows.withColumns({"status": status, "content_type": kind}).groupBy("url").agg(F.min_by(F.struct("page_id", "status", "content_type", "size"), "page_id").alias("r")).select("url", "r.*")


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_url, to_url: page i leads to page i + 1 where i % 7 < 3."""
    rows = pages(spark, sf_dir).select("page_id", "canonical_url")
    after = rows.select((F.col("page_id") - 1).alias("page_id"), F.col("canonical_url").alias("to_url"))
    return rows.filter("page_id % 7 < 3").join(after, "page_id").select(F.col("canonical_url").alias("from_url"), "to_url")
