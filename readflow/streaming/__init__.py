"""Structured Streaming forms of the activity and admission jobs.

Events: reader, text_hash, ts (timestamp), seq, action, arg. Watermarks bound the state; what comes later
than the lateness is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..operators import activity, crawl, segment

#: A live state row: what replay() tells, what is needed to go on from it, and why it is there.
LIVE = f"{activity.STATE}, ja_cpm double, en_wpm double, since_ms long, finished_at_ms long, last_ms long, cause string"
_KEPT = "unit int, status string, since long, played long, ja_cpm double, en_wpm double, a0 long, a1 long, a2 long, a3 long, finished_at long, last long, seq long"


class _Reader(StatefulProcessor):
    """A reader in a text: one value of a few numbers, and two timers, for the pause and for leaving."""

    def __init__(self, idle_ms: int, keep_ms: int):
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("reading", _KEPT)

    def close(self) -> None:
        pass

    def _load(self, count: int) -> tuple[activity.Reading, int, int]:
        reading, s = activity.Reading(count), self.kept.get() if self.kept.exists() else None
        if s is None:
            return reading, -1, -1
        reading.unit, reading.status, reading.since, reading.played, reading.ja_cpm, reading.en_wpm = s[0], s[1], (None if s[2] < 0 else s[2]), s[3], s[4], s[5]
        reading.amount, reading.finished_at = list(s[6:10]), (None if s[10] < 0 else s[10])
        return reading, s[11], s[12]

    def _save(self, r: activity.Reading, last: int, seq: int) -> None:
        none = lambda x: -1 if x is None else int(x)
        self.kept.update((int(r.unit), r.status, none(r.since), int(r.played), float(r.ja_cpm), float(r.en_wpm), *map(int, r.amount), none(r.finished_at), int(last), int(seq)))

    def _timers(self, start: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(start + self.idle_ms)
        self.handle.registerTimer(start + self.keep_ms)

    def _row(self, key: tuple, r: activity.Reading, last: int, seq: int, cause: str) -> pd.DataFrame:
        row = (key[0], key[1], last, seq, r.status, r.unit, r.played, *r.amount, False, r.ja_cpm, r.en_wpm, r.since, r.finished_at, last, cause)
        return pd.DataFrame([row], columns=_names(LIVE)).astype({"since_ms": "Int64", "finished_at_ms": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values(["ts_ms", "seq"], kind="stable")
        known = {int(u["unit_index"]): (u["sentence_index"], u["language"], int(u["characters"]), float(u["pause_units"])) for u in pdf["units"].iloc[0]}
        reading, last, seq = self._load(len(known))
        out = []
        for x in pdf.itertuples(index=False):
            state = next(activity.fold(pd.DataFrame([x]), known, reading))
            if x.ts_ms >= last:
                last, seq = int(x.ts_ms), int(x.seq)
            out.append((*state, reading.ja_cpm, reading.en_wpm, reading.since, reading.finished_at, last, "action"))
        self._save(reading, last, seq)
        self._timers(max(last, timerValues.getCurrentWatermarkInMs()))
        yield pd.DataFrame(out, columns=_names(LIVE)).astype({"since_ms": "Int64", "finished_at_ms": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        reading, last, seq = self._load(0)
        leaves = not [t for t in self.handle.listTimers() if t > expiredTimerInfo.getExpiryTimeInMs()]  # the later one of the two
        if reading.status == "playing":
            reading.stop(last, "paused")
            self._save(reading, last, seq)
            yield self._row(key, reading, last, seq, "idle")
        if leaves:
            self.kept.clear()
            yield self._row(key, reading, last, seq, "left")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        s = initialState.sort_values(["last_ms", "seq"]).iloc[-1]
        some = lambda x: None if pd.isna(x) else int(x)
        reading = activity.Reading(0, int(s.unit_index), s.status, some(s.since_ms), int(s.played_ms), s.ja_cpm, s.en_wpm, [int(s[c]) for c in ("ja_characters", "en_words", "ja_ms", "en_ms")], some(s.finished_at_ms))
        self._save(reading, int(s.last_ms), int(s.seq))
        self._timers(max(int(s.last_ms), timerValues.getCurrentWatermarkInMs()))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def reader_states(events: DataFrame, units: DataFrame, lateness: str = "10 minutes", idle_ms: int = 30 * 60 * 1000, keep_ms: int = 90 * 24 * 3600 * 1000, saved: DataFrame | None = None) -> DataFrame:
    """LIVE rows: the state after every action, by the fold that replay() uses, and at two times without one.

    units: activity.unit_table(), a static table; it is joined per text as one array, so that the state of a
    reader and text holds numbers only. ``cause`` is ``action``; or ``idle`` when a reader who plays has been silent for
    idle_ms and is paused as of the last action; or ``left`` when keep_ms (more than idle_ms) have passed without an
    action: that row goes out with all that is known, and the state is gone. One who goes on before that goes on from
    there; to bring back those who have left, start a query with the table of rows that it wrote (saved: states_to_resume()).

    Timers need the RocksDB state store, which this call chooses where the session is at its default.
    """
    if keep_ms <= idle_ms:
        raise ValueError("keep_ms must be more than idle_ms")
    spark, store = events.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(store):
        spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    packed = units.groupBy("text_hash").agg(F.collect_list(F.struct("unit_index", "sentence_index", "language", "characters", "pause_units")).alias("units"))
    rows = events.withWatermark("ts", lateness).join(packed, "text_hash").withColumn("ts_ms", F.unix_millis("ts"))
    rows = rows.select("reader", "text_hash", "ts", "ts_ms", "seq", "action", "arg", "units")
    first = None if saved is None else saved.select(*_names(LIVE)).groupBy("reader", "text_hash")
    return rows.groupBy("reader", "text_hash").transformWithStateInPandas(_Reader(idle_ms, keep_ms), LIVE, "Append", "EventTime", initialState=first)


def states_to_resume(written: DataFrame) -> DataFrame:
    """Of LIVE rows that a query wrote the last of each reader and text: the initial states of a new query."""
    order = F.struct("last_ms", F.when(F.col("cause") == "action", 0).otherwise(1), "seq")
    return written.groupBy("reader", "text_hash").agg(F.max_by(F.struct(*_names(LIVE)), order).alias("_s")).select("_s.*")


def request_counts(requests: DataFrame, limit: int = crawl.REQUESTS, period: str = "60 seconds", lateness: str = "2 minutes") -> DataFrame:
    """key, start, requests, limited: requests (key, ts) per key and period."""
    found = requests.withWatermark("ts", lateness).groupBy("key", F.window("ts", period).alias("w")).agg(F.count("*").alias("requests"))
    return found.select("key", F.col("w.start").alias("start"), "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("limited"))


#: Hours between the first and the last zone of the world.
ZONES_APART = 26


def _by_local_day(events: DataFrame, at: str, lateness: str, tz: str | Column | None) -> tuple[DataFrame, Column]:
    """events with a watermark, and the window of a day: in UTC, or on the wall clock of tz (a zone, or a column of events).

    Wall clocks of different zones are up to ZONES_APART hours apart, so much later the days of a column of zones end.
    """
    if tz is None:
        return events.withWatermark(at, lateness), F.window(at, "1 day")
    later = lateness if isinstance(tz, str) else f"{lateness} {ZONES_APART} hours"
    return events.withColumn("_wall", activity.local_time(F.col(at), tz).cast("timestamp")).withWatermark("_wall", later), F.window("_wall", "1 day")


def daily_totals(finishes: DataFrame, lateness: str = "1 day", tz: str | Column | None = None) -> DataFrame:
    """reader, date, finishes, ja_characters, en_words, played_ms of finishes with finished_at, by UTC days or those of tz; late ones are dropped."""
    rows, day = _by_local_day(finishes, "finished_at", lateness, tz)
    found = rows.groupBy("reader", day.alias("w")).agg(
        F.count("*").alias("finishes"), F.sum("ja_characters").alias("ja_characters"), F.sum("en_words").alias("en_words"), F.sum("played_ms").alias("played_ms")
    )
    return found.select("reader", F.to_date("w.start").alias("date"), "finishes", "ja_characters", "en_words", "played_ms")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    return activity.sessions(events.withWatermark("ts", lateness), gap)


def distinct_finishes(finishes: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """finishes once per reader and time, as long as the watermark holds them."""
    return finishes.withWatermark("finished_at", lateness).dropDuplicatesWithinWatermark(["reader", "finished_at"])


def ingest(texts: DataFrame, path: str, checkpoint: str):
    """Starts the continuous job texts (doc_id, text) -> units under path; a text that came before adds nothing.

    Every batch keeps the texts whose hash the folder of hashes lacks, and appends their units. Hashes lie in 256
    partitions by their first two digits, of which a batch reads those that its own hashes fall in.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        plain = batch.select("doc_id", T.import_plain(F.col("text")).alias("text"))
        fresh = plain.filter(F.coalesce("text", F.lit("")) != "").withColumn("text_hash", T.text_hash(F.col("text"))).dropDuplicates(["text_hash"]).persist()
        try:
            known = known_hashes(spark, path, batch_id, fresh)
            new = fresh if known is None else fresh.join(known, "text_hash", "left_anti")
            new = new.persist()
            try:
                segment.units(new.select("doc_id", "text")).write.mode("overwrite").parquet(f"{path}/units/batch={batch_id}")
                new.select("text_hash", _prefix().alias("prefix")).write.mode("overwrite").partitionBy("prefix").parquet(f"{path}/hashes/batch={batch_id}")
            finally:
                new.unpersist()
        finally:
            fresh.unpersist()

    return texts.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def _prefix() -> Column:
    return F.substring("text_hash", 1, 2)


def known_hashes(spark: SparkSession, path: str, batch_id: int, fresh: DataFrame) -> DataFrame | None:
    """text_hash of earlier batches that begin as one of fresh does; None before the first. A repeated batch isn't known to itself."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/hashes")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    begun = [r.prefix for r in fresh.select(_prefix().alias("prefix")).distinct().collect()]  # 256 at most
    known = spark.read.schema("text_hash string, batch long, prefix string").parquet(f"{path}/hashes")
    return known.filter((F.col("batch") != batch_id) & F.col("prefix").isin(begun)).select("text_hash")


def english_days(finished_units: DataFrame, shown: DataFrame, lateness: str = "1 day", tz: str | None = None) -> DataFrame:
    """reader, date, english_read, translations per day, from unit ends (reader, ts, language) and rises (reader, ts) of a shown translation.

    Both streams are put together as one, so that a day is one row of one window; what comes later than the lateness is
    dropped. Days are those of UTC, of the zone tz, or, if tz names a column of both streams, of each row's zone.
    """
    zone = [F.col(tz)] if tz and tz in finished_units.columns else []
    ends = finished_units.select("reader", "ts", (F.col("language") == "en").alias("english"), F.lit(0).alias("rise"), *zone)
    both = ends.unionByName(shown.select("reader", "ts", F.lit(False).alias("english"), F.lit(1).alias("rise"), *zone))
    rows, day = _by_local_day(both, "ts", lateness, zone[0] if zone else tz)
    found = rows.groupBy("reader", day.alias("w")).agg(F.max("english").alias("english_read"), F.sum("rise").alias("translations"))
    return found.select("reader", F.to_date("w.start").alias("date"), "english_read", "translations")


def request_verdicts(requests: DataFrame, limit: int = crawl.REQUESTS, period: int = crawl.PERIOD, lateness: str = "2 minutes") -> DataFrame:
    """request_id, key, ts, limited: a verdict per request (request_id, key, ts) as it comes; the state of a key and period is one number.

    In a batch requests count by time and id; those of a later batch count after them.
    """
    bucket = F.floor(F.unix_seconds("ts") / period)
    rows = requests.withWatermark("ts", lateness).select("request_id", "key", "ts", bucket.alias("bucket"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["ts", "request_id"], kind="stable")
        before = state.get[0] if state.exists else 0
        state.update((before + len(pdf),))
        state.setTimeoutTimestamp(max((int(key[1]) + 1) * period * 1000, state.getCurrentWatermarkMs() + 1))
        yield pdf[["request_id", "key", "ts"]].assign(limited=[before + i >= limit for i in range(len(pdf))])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("request_id", "key", "ts"))
    return rows.groupBy("key", "bucket").applyInPandasWithState(step, f"{kinds}, limited boolean", "n long", "append", GroupStateTimeout.EventTimeTimeout)


class _Places(StatefulProcessor):
    """Numbers the rows of a key, in a batch by time and id; one number of state, which ends with the period."""

    def __init__(self, period_ms: int, counts: str, out: str):
        self.period_ms, self.counts, self.out = period_ms, counts, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.n = handle, handle.getValueState("n", "n long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values(["ts", "request_id"], kind="stable")
        before = self.n.get()[0] if self.n.exists() else 0
        asks = pdf[self.counts].astype(bool)
        place = before + asks.cumsum()
        self.n.update((int(place.iloc[-1]),))
        if not before:
            self.handle.registerTimer(max((int(key[0]) + 1) * self.period_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pdf.assign(**{self.out: place.where(asks, 0).astype("int64")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.n.clear()
        return iter(())


def grants(requests: DataFrame, per_key: int = crawl.MODEL_PER_KEY, in_all: int = crawl.MODEL_IN_ALL, period: int = crawl.PERIOD, lateness: str = "2 minutes") -> DataFrame:
    """request_id, key, ts, granted: crawl.two_level_limit() of requests (request_id, key, ts, has_work) as they come.

    Two stateful operators, one after the other in append mode: the first numbers a key's requests of a period, the
    second, over all keys, those that come through and have work. Only these meet under one key (at most per_key of each
    key and period); the others pass in 64 lanes. Requests of a later batch count after those of an earlier one.
    """
    spark, store = requests.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(store):
        spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = requests.withWatermark("ts", lateness).select(F.floor(F.unix_seconds("ts") / period).alias("bucket"), "key", "request_id", "ts", "has_work", F.lit(True).alias("asks"))
    kind = lambda df: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    own = rows.groupBy("bucket", "key").transformWithStateInPandas(_Places(period * 1000, "asks", "own"), f"{kind(rows)}, own long", "Append", "EventTime", eventTimeColumnName="ts")
    asks = (F.col("own") <= per_key) & F.col("has_work")
    lane = F.when(asks, 0).otherwise(1 + F.pmod(F.xxhash64("request_id"), F.lit(64)))
    dealt = own.select("bucket", lane.cast("long").alias("lane"), "key", "request_id", "ts", F.coalesce(asks, F.lit(False)).alias("asks"))
    placed = dealt.groupBy("bucket", "lane").transformWithStateInPandas(_Places(period * 1000, "asks", "place"), f"{kind(dealt)}, place long", "Append", "EventTime", eventTimeColumnName="ts")
    return placed.select("request_id", "key", "ts", (F.col("asks") & (F.col("place") <= in_all)).alias("granted"))
