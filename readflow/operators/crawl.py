"""From crawled pages to admitted ones: robots rules, redirects, responses and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from .shared import written

# Hops, sizes and limits.
MOST_HOPS = 5
ROBOTS_BYTES, PAGE_BYTES = 500 * 1024, 5 * 1024 * 1024
PERIOD, REQUESTS, MODEL_PER_KEY, MODEL_IN_ALL = 60, 30, 2, 3
# Reasons that a downstream service may name, and the HTTP status of each.
STATUSES = {"invalid-url": 400, "blocked-url": 400, "robots-disallowed": 403, "page-too-large": 413, "page-unavailable": 502, "unextractable": 422, "rate-limited": 429}


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """host, allow, pattern: the rules of files (host, robots_text) that hold for agent.

    Lines of user agents that follow each other share a group; the first one after a rule opens a new
    group. Groups that name the agent win over those for all.
    """
    line = F.posexplode(F.split("robots_text", "\r\n|\r|\n")).alias("line", "raw")
    rows = files.select("host", line).withColumn("raw", F.regexp_replace("raw", "#.*", ""))
    key = F.lower(T.trim(F.regexp_extract("raw", r"^([^:]*):", 1)))
    value = T.trim(F.regexp_extract("raw", r"^[^:]*:(.*)$", 1))
    rows = rows.select("host", "line", key.alias("key"), value.alias("value")).filter(F.col("key").isin("user-agent", "allow", "disallow"))
    order = W.partitionBy("host").orderBy("line")
    rows = rows.withColumn("opens", ((F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")).cast("int"))
    rows = rows.withColumn("group", F.sum("opens").over(order)).filter("group > 0")
    token = F.lower("value")
    agents = rows.filter("key = 'user-agent'").groupBy("host", "group").agg(F.bool_or(token == agent.lower()).alias("ours"), F.bool_or(token == "*").alias("all"))
    agents = agents.withColumn("named", F.bool_or("ours").over(W.partitionBy("host"))).filter("ours or (all and not named)").select("host", "group")
    kept = rows.filter("key <> 'user-agent' and value <> ''").join(agents, ["host", "group"])
    return kept.select("host", (F.col("key") == "allow").alias("allow"), urls.normal_path(F.col("value")).alias("pattern"))


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (page_id, host, path) with allowed: the longest matching pattern decides, on a tie it allows."""
    rows = pages.withColumn("_path", urls.normal_path(F.col("path")))
    hits = rows.select("page_id", "host", "_path").join(rules, "host").filter(urls.matches(F.col("pattern"), F.col("_path")))
    best = hits.groupBy("page_id").agg(F.max_by("allow", F.struct(F.length("pattern"), F.col("allow"))).alias("_allow"))
    return rows.join(best, "page_id", "left").withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_path", "_allow")


def robots_state(log: DataFrame) -> DataFrame:
    """host, robots_text, reason from a fetch log of robots files (host, status, robots_text, blocked_reason).

    A client error means no rules; another failure makes the host's pages unavailable; too large a file disallows.
    """
    ok = F.col("status").between(200, 299)
    why = (
        F.when(F.col("blocked_reason").isNotNull(), F.col("blocked_reason"))
        .when(F.col("status").between(400, 499), None)
        .when(~F.coalesce(ok, F.lit(False)), "page-unavailable")
        .when(F.octet_length("robots_text") > ROBOTS_BYTES, "robots-disallowed")
    )
    return log.select("host", F.when(ok & why.isNull(), F.col("robots_text")).alias("robots_text"), why.alias("reason"))


def robots_fetched(hosts: DataFrame, log: DataFrame, redirects: DataFrame, scheme: str = "https", most: int = MOST_HOPS) -> DataFrame:
    """host, status, robots_text, blocked_reason: each host's robots file, behind its redirects.

    hosts: host. log: url, status, robots_text, what a fetch of each URL answers. redirects: from_url, to_url, of which
    those of robots files count too. Every hop's URL is checked, but no hop by robots rules; a refused hop, or more
    than ``most``, passes its reason on. A file that the log lacks has no status.
    """
    start = hosts.select(F.col("host").alias("page_id"), F.concat(F.lit(f"{scheme}://"), "host", F.lit("/robots.txt")).alias("url")).distinct()
    ends = follow(start, redirects, most=most).select(F.col("page_id").alias("host"), F.col("final_url").alias("_url"), F.col("reason").alias("blocked_reason"))
    answers = written(log.groupBy("url").agg(F.min(F.struct("status", "robots_text")).alias("_got")))
    found = ends.join(answers, F.col("_url") == F.col("url"), "left")
    return found.select("host", F.col("_got.status").alias("status"), F.col("_got.robots_text").alias("robots_text"), "blocked_reason")


def follow(pages: DataFrame, redirects: DataFrame, rules: DataFrame | None = None, most: int = MOST_HOPS, closed: DataFrame | None = None) -> DataFrame:
    """page_id, final_url, hops, reason: pages (page_id, url) after redirects (from_url, to_url), every hop checked.

    A hop is checked by its URL, then by the state of its host's robots file (closed: host, reason, as of
    robots_state()), then by the host's rules. A hop's relative target is resolved against its page. More than ``most`` hops make a page unavailable. Settled pages
    leave the join after each round; the rounds are a fixed few, and each is written to the shared folder.
    """
    known = written(redirects.groupBy("from_url").agg(F.min("to_url").alias("to_url")))
    rules = None if rules is None else written(rules)
    closed = None if closed is None else written(closed.filter("reason is not null").select(F.col("host").alias("_host"), F.col("reason").alias("_closed")))
    open_ = pages.select("page_id", urls.canonical(F.col("url")).alias("at"), F.lit(0).alias("hops"))
    done = []
    for hop in range(most + 2):
        why = urls.reason(F.col("at"))
        rows = open_.withColumn("reason", F.when(F.lit(hop > most), "page-unavailable").otherwise(why))
        if closed is not None:
            rows = rows.join(closed, urls.host(F.col("at")) == F.col("_host"), "left").withColumn("reason", F.coalesce("reason", "_closed")).select("page_id", "at", "hops", "reason")
        if rules is not None:
            rows = rows.withColumns({"host": urls.host(F.col("at")), "path": urls.path(F.col("at"))})
            rows = allowed(rows, rules).withColumn("reason", F.coalesce("reason", F.when(~F.col("allowed"), "robots-disallowed"))).select("page_id", "at", "hops", "reason")
        rows = written(rows.join(known, F.col("at") == F.col("from_url"), "left"))
        ends = F.col("reason").isNotNull() | F.col("to_url").isNull()
        done.append(rows.filter(ends).select("page_id", F.col("at").alias("final_url"), "hops", "reason"))
        if hop <= most:
            if rows.filter(~ends).isEmpty():
                break
            open_ = rows.filter(~ends).select("page_id", urls.canonical(resolved(F.col("at"), F.col("to_url"))).alias("at"), (F.col("hops") + 1).alias("hops"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def resolved(base: Column, target: Column) -> Column:
    """A redirect's target against the page that sent it; dot segments go, a fragment stays."""
    root = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"\A([^?#]*/)", 1)
    whole = (
        F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.-]*:)", 1), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(F.regexp_extract(base, r"\A([^?#]*)", 1), target))
        .when((target == "") | target.startswith("#"), F.concat(F.regexp_extract(base, r"\A([^#]*)", 1), target))
        .otherwise(F.concat(F.when(F.length(folder) > F.length(root), folder).otherwise(F.concat(root, F.lit("/"))), target))
    )
    return urls.bound(whole, _without_dots)


def _without_dots(url: Column) -> Column:
    """A URL with a host, with the segments . and .. of its path (also as escapes) carried out."""
    root = F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path, rest = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"(?s)\A[^?#]*(.*)\z", 1)
    plain = lambda x: F.regexp_replace(x, "(?i)%2e", ".")
    parts = F.slice(F.split(path, "/", -1), 2, F.length(path) + 1)

    def step(kept: Column, x: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(plain(x) == "..", up).when(plain(x) == ".", kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    folder = F.when(plain(F.element_at(parts, -1)).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when((root != "") & plain(path).rlike(r"/\.\.?(/|\z)"), F.concat(root, F.lit("/"), F.array_join(F.concat(kept, folder), "/"), rest)).otherwise(url)


def response_reason(status: Column, content_type: Column, size: Column) -> Column:
    """The first rule that a response fails, or null."""
    html = F.lower(content_type).rlike(r"\A\s*(text/html|application/xhtml\+xml)\s*(;|\z)")
    return (
        F.when(~F.coalesce(status.between(200, 299), F.lit(False)), "page-unavailable")
        .when(~F.coalesce(html, F.lit(False)), "unextractable")
        .when(size > PAGE_BYTES, "page-too-large")
    )


def service_reason(status: Column, body: Column) -> Column:
    """The reason behind a failed answer of an extraction service."""
    named = F.get_json_object(body, "$.error")
    return F.when(named.isin(list(STATUSES)), named).when(status == 429, "rate-limited").otherwise("network")


def rate_limited(requests: DataFrame, limit: int = REQUESTS, period: int = PERIOD) -> DataFrame:
    """requests (request_id, key, ts) with limited: whether more than limit of a key came in its period."""
    bucket = F.floor(F.unix_seconds("ts") / period)
    place = F.row_number().over(W.partitionBy("key", bucket).orderBy("ts", "request_id"))
    return requests.withColumn("limited", place > limit)


def two_level_limit(requests: DataFrame, per_key: int = MODEL_PER_KEY, in_all: int = MODEL_IN_ALL, period: int = PERIOD) -> DataFrame:
    """requests (request_id, key, ts, has_work) with granted: first per key, then, of those with work, over all.

    Of a key only its first rows of a period can be granted, so the window over a period sees few rows.
    """
    rows = requests.withColumn("_bucket", F.floor(F.unix_seconds("ts") / period))
    rows = rows.withColumn("_own", F.row_number().over(W.partitionBy("key", "_bucket").orderBy("ts", "request_id")) <= per_key)
    asks = rows.filter("_own and has_work")
    first = asks.withColumn("_all", F.row_number().over(W.partitionBy("_bucket").orderBy("ts", "request_id"))).filter(F.col("_all") <= in_all).select("request_id", F.lit(True).alias("_granted"))
    return rows.join(first, "request_id", "left").withColumn("granted", F.coalesce("_granted", F.lit(False))).drop("_bucket", "_own", "_granted")


def report(admitted: DataFrame) -> DataFrame:
    """host, reason, pages, with totals per host and over all (nulls; level tells them apart)."""
    return admitted.withColumn("reason", F.coalesce("reason", F.lit("ok"))).rollup("host", "reason").agg(F.count("*").alias("pages"), F.grouping_id().cast("long").alias("level"))
