"""Reading activity: states, amounts, daily and weekly totals, positions. Records hold hashes and numbers, no texts.

Actions: reader, text_hash, ts_ms, action, arg, and seq for the order of equal times.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import timing

# Records kept per reader, days shown, days of a week, thresholds of the weekly rule.
KEPT, SHOWN_DAYS, WEEK = 100, 14, 7
DAYS_GO_ON, DAYS_STOP = 4, 2
CHARACTERS_GO_ON, CHARACTERS_STOP = 50_000, 10_000
TRANSLATED_SHARE = 0.5


@dataclass
class Reading:
    """The state of one reader in one text; the same fold serves batch and stream."""

    count: int
    unit: int = 0
    status: str = "paused"
    since: int | None = None
    played: int = 0
    ja_cpm: float = timing.JA_CPM
    en_wpm: float = timing.EN_WPM
    amount: list[int] = field(default_factory=lambda: [0, 0, 0, 0])  # ja characters, en words, ja ms, en ms
    finished_at: int | None = None

    def reset(self) -> None:
        self.unit, self.status, self.since, self.played, self.amount, self.finished_at = 0, "paused", None, 0, [0, 0, 0, 0], None

    def stop(self, now: int, status: str) -> None:
        self.played += now - self.since
        self.status, self.since = status, None

    def go(self, to: int) -> None:
        to = min(max(to, 0), self.count - 1)
        if self.status == "finished":
            if to == self.unit:
                return
            self.reset()
        self.unit = to

    def play(self, now: int) -> None:
        if self.status == "finished":
            self.reset()
        if self.status == "paused" and self.count:
            self.status, self.since = "playing", now

    def apply(self, action: str, arg: int, now: int, units: dict[int, tuple]) -> bool:
        """Applies one action; units: unit -> (sentence, language, characters, pause units). True on finishing."""
        if action == "toggle":
            action = "pause" if self.status == "playing" else "play"
        if action == "play":
            self.play(now)
        elif action == "pause" and self.status == "playing":
            self.stop(now, "paused")
        elif action == "advance" and self.status == "playing":
            _, language, characters, pause = units.get(self.unit, (0, "en", 0, 0.0))
            ja = language == "ja"
            ms = 60_000 / self.ja_cpm * (characters + pause * timing.MEAN_UNIT) if ja else 60_000 / self.en_wpm * (1 + pause)
            self.amount[0 if ja else 1] += characters if ja else 1
            self.amount[2 if ja else 3] += int(ms + 0.5)
            if self.unit == self.count - 1:
                self.stop(now, "finished")
                self.finished_at = now
                return True
            self.unit += 1
        elif action == "restart":
            self.reset()
        elif action == "move" and self.count:
            self.go(self.unit + arg)
        elif action == "sentence" and self.count:
            self.by_sentence(arg, units)
        elif action == "play_from" and self.count:
            if self.status == "finished":
                self.reset()
            self.go(arg)
            self.play(now)
        elif action in ("speed_ja", "speed_en"):
            name = "ja_cpm" if action == "speed_ja" else "en_wpm"
            low, high, step = timing.LIMITS[action[-2:]]
            setattr(self, name, min(max(getattr(self, name) + step * arg, low), high))
        return False

    def by_sentence(self, arg: int, units: dict[int, tuple]) -> None:
        of = lambda i: units.get(i, (0,))[0]
        first = self.unit
        while first > 0 and of(first - 1) == of(first):
            first -= 1
        if arg > 0:
            after = self.unit + 1
            while after < self.count and of(after) == of(self.unit):
                after += 1
            if after < self.count:
                self.go(after)
            return
        if self.unit == first and first > 0:
            first -= 1
            while first > 0 and of(first - 1) == of(first):
                first -= 1
        self.go(first)


STATE = "reader long, text_hash string, ts_ms long, seq long, status string, unit_index int, played_ms long, ja_characters long, en_words long, ja_ms long, en_ms long, finished boolean"
_FIELDS = [c.split() for c in STATE.split(", ")]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_Action = namedtuple("_Action", "reader text_hash ts_ms seq action arg")
#: Actions on one text that share a copy of its units.
SHARE = 20_000


def after(x, units: dict[int, tuple], state: Reading) -> tuple:
    """The row of STATE after one action."""
    finished = state.apply(x.action, int(x.arg) if x.arg == x.arg and x.arg is not None else 0, int(x.ts_ms), units)
    played = state.played + (int(x.ts_ms) - state.since if state.since is not None else 0)
    return (x.reader, x.text_hash, x.ts_ms, x.seq, state.status, state.unit, played, *state.amount, finished)


def fold(rows: pd.DataFrame, units: dict[int, tuple], state: Reading) -> Iterator[tuple]:
    """The state after each action of rows, which are in order."""
    for x in rows.itertuples(index=False):
        yield after(x, units, state)


def unit_table(units: DataFrame) -> DataFrame:
    """text_hash, unit_index, sentence_index, language, characters, pause_units, from units with a text_hash."""
    from ..functions import text as T

    return units.select("text_hash", "unit_index", "sentence_index", "language", T.character_count(F.col("text")).alias("characters"), timing.pause_units(F.col("pause")).alias("pause_units"))


def replay(actions: DataFrame, units: DataFrame) -> DataFrame:
    """The reader's state after every action (STATE), as an ordered fold per reader and text.

    units: a unit_table(). A text's units come before its actions in one sorted table, once and once more for every SHARE
    actions on it, whose readers are dealt to these copies. A task passes over its rows and holds one text's units at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = who = known = state = None
        for batch in batches:
            out = []
            for text, share, is_action, reader, ts, seq, action, arg, unit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != (text, share):
                    place, who, known, state = (text, share), None, {}, None
                if not is_action:
                    known[unit["unit_index"]] = (unit["sentence_index"], unit["language"], unit["characters"], unit["pause_units"])
                    continue
                if state is None or who != reader:
                    who, state = reader, Reading(len(known))
                out.append(after(_Action(reader, text, ts, seq, action, arg), known, state))
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS])

    shares = actions.groupBy("text_hash").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("_n"))
    dealt = actions.join(shares.withColumnRenamed("text_hash", "_of"), F.col("text_hash").eqNullSafe(F.col("_of")))
    unit = "struct<unit_index:int,sentence_index:int,language:string,characters:int,pause_units:double>"
    asked = dealt.select(
        F.col("text_hash").cast("string").alias("text_hash"), F.pmod(F.xxhash64("reader"), F.col("_n")).cast("int").alias("share"), F.lit(True).alias("is_action"),
        *[F.col(c).cast("long").alias(c) for c in ("reader", "ts_ms", "seq")], "action", F.col("arg").cast("long").alias("arg"), F.lit(None).cast(unit).alias("unit"),
    )
    none = [F.lit(None).cast("string" if c == "action" else "long").alias(c) for c in ("reader", "ts_ms", "seq", "action", "arg")]
    told = F.struct("unit_index", "sentence_index", "language", "characters", "pause_units").cast(unit).alias("unit")
    held = units.join(shares, "text_hash").select(F.col("text_hash").cast("string").alias("text_hash"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("share"), F.lit(False).alias("is_action"), *none, told)
    rows = held.unionByName(asked).repartition("text_hash", "share").sortWithinPartitions("text_hash", "share", "is_action", "reader", "ts_ms", "seq")
    return rows.mapInArrow(run, STATE)


def finishes(states: DataFrame) -> DataFrame:
    """reader, text_hash, finished_at, seq, ja_characters, en_words, ja_ms, en_ms, played_ms: the records of the actions that finished a text (states: replay())."""
    return states.filter("finished").select("reader", "text_hash", F.timestamp_millis("ts_ms").alias("finished_at"), "seq", "ja_characters", "en_words", "ja_ms", "en_ms", "played_ms")


def played(actions: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """reader, text_hash, played_ms from play, pause and finish alone: windows, no fold.

    Only changes count; an open stretch counts up to now_ms (default: not at all).
    """
    order = W.partitionBy("reader", "text_hash").orderBy("ts_ms", "seq")
    on = F.when(F.col("action") == "play", 1).when(F.col("action").isin("pause", "finish"), 0)
    rows = actions.withColumn("on", on).filter("on is not null").withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(0)))
    rows = rows.filter("on <> was").withColumn("until", F.lead("ts_ms").over(order))
    until = F.coalesce("until", now_ms) if now_ms is not None else F.col("until")
    return rows.groupBy("reader", "text_hash").agg(F.sum(F.when(F.col("on") == 1, F.coalesce(until - F.col("ts_ms"), F.lit(0))).otherwise(0)).alias("played_ms"))


def amounts(advances: DataFrame, units: DataFrame, speeds: DataFrame) -> DataFrame:
    """reader, text_hash, ja_characters, en_words, ja_ms, en_ms: what finished units add, at the speed then in force.

    advances: reader, text_hash, unit_index, ts_ms; units: unit_table(); speeds: reader, ts_ms, ja_cpm, en_wpm.
    """
    marks = speeds.select("reader", "ts_ms", F.lit(0).alias("kind"), F.struct("ja_cpm", "en_wpm").alias("speed"), F.lit(None).cast("string").alias("text_hash"), F.lit(None).cast("int").alias("unit_index"))
    asked = advances.select("reader", "ts_ms", F.lit(1).alias("kind"), F.lit(None).cast("struct<ja_cpm:double,en_wpm:double>").alias("speed"), "text_hash", F.col("unit_index").cast("int").alias("unit_index"))
    order = W.partitionBy("reader").orderBy("ts_ms", "kind").rowsBetween(W.unboundedPreceding, 0)
    rows = marks.unionByName(asked).withColumn("speed", F.last("speed", ignorenulls=True).over(order)).filter("kind = 1")
    cpm, wpm = F.coalesce("speed.ja_cpm", F.lit(timing.JA_CPM)), F.coalesce("speed.en_wpm", F.lit(timing.EN_WPM))
    rows = rows.join(units, ["text_hash", "unit_index"])
    ja = F.col("language") == "ja"
    ms = timing.rounded(F.when(ja, F.lit(60_000.0) / cpm * (F.col("characters") + F.col("pause_units") * timing.MEAN_UNIT)).otherwise(F.lit(60_000.0) / wpm * (F.lit(1.0) + F.col("pause_units"))))
    put = lambda when, x: F.sum(F.when(when, x).otherwise(0)).cast("long")
    return rows.groupBy("reader", "text_hash").agg(put(ja, F.col("characters")).alias("ja_characters"), put(~ja, F.lit(1)).alias("en_words"), put(ja, ms).alias("ja_ms"), put(~ja, ms).alias("en_ms"))


def effective_speed(amount: Column, language_ms: Column, total_ms: Column, played_ms: Column) -> Column:
    """Amount per minute of the playing time that falls to the language; null without amount or time."""
    rate = amount.cast("double") * 60_000.0 * total_ms.cast("double") / (played_ms.cast("double") * language_ms.cast("double"))
    return F.when((amount > 0) & (played_ms > 0), timing.rounded(rate))


def local_time(ts: Column, tz: str | Column = "UTC") -> Column:
    """The wall clock (without a zone) at ts in a zone: one for all, or each row's own; a null zone is UTC."""
    zone = F.lit(tz) if isinstance(tz, str) else F.coalesce(tz, F.lit("UTC"))
    return F.convert_timezone(F.current_timezone(), zone, ts.cast("timestamp_ntz"))


def local_date(ts: Column, tz: str | Column = "UTC") -> Column:
    """The date at ts on the wall clock of a zone, over its changes of daylight-saving time."""
    return F.to_date(local_time(ts, tz))


def distinct_finishes(finishes: DataFrame) -> DataFrame:
    """finishes (reader, finished_at, ..., seq) once per reader and time: the first by seq."""
    first = F.row_number().over(W.partitionBy("reader", "finished_at").orderBy("seq"))
    return finishes.withColumn("_n", first).filter("_n = 1").drop("_n")


def daily_totals(finishes: DataFrame, tz: str | Column = "UTC", shown: int | None = None) -> DataFrame:
    """reader, date (in tz, a zone or a column of finishes), finishes, ja_characters, en_words, played_ms; with shown, the newest days of each reader."""
    days = finishes.groupBy("reader", local_date(F.col("finished_at"), tz).alias("date")).agg(
        F.count("*").alias("finishes"), F.sum("ja_characters").alias("ja_characters"), F.sum("en_words").alias("en_words"), F.sum("played_ms").alias("played_ms")
    )
    if shown is None:
        return days
    return days.withColumn("_n", F.row_number().over(W.partitionBy("reader").orderBy(F.desc("date")))).filter(F.col("_n") <= shown).drop("_n")


def week_and_all(days: DataFrame, as_of: Column) -> DataFrame:
    """reader, the totals of the last 7 calendar days and those of all, in one pass over daily_totals()."""
    recent = F.col("date").between(F.date_sub(as_of, WEEK - 1), as_of)
    out = []
    for c in ("ja_characters", "en_words", "played_ms"):
        out += [F.sum(F.when(recent, F.col(c)).otherwise(0)).alias(f"week_{c}"), F.sum(c).alias(f"all_{c}")]
    return days.groupBy("reader").agg(*out)


def english_days(finished_units: DataFrame, shown: DataFrame, tz: str | Column = "UTC") -> DataFrame:
    """reader, date, english_read, translations, from unit ends (reader, ts, language) and flags (reader, ts, seq, visible).

    Dates are those of tz, a zone or a column that both have.
    A translation counts on each rise of visible (the conjunction of shown, ready, English sentence, unfinished).
    """
    read = finished_units.groupBy("reader", local_date(F.col("ts"), tz).alias("date")).agg(F.bool_or(F.col("language") == "en").alias("english_read"))
    order = W.partitionBy("reader").orderBy("ts", "seq")
    rises = shown.withColumn("_was", F.coalesce(F.lag("visible").over(order), F.lit(False))).filter("visible and not _was")
    counts = rises.groupBy("reader", local_date(F.col("ts"), tz).alias("date")).agg(F.count("*").alias("translations"))
    both = read.join(counts, ["reader", "date"], "full_outer")
    return both.select("reader", "date", F.coalesce("english_read", F.lit(False)).alias("english_read"), F.coalesce("translations", F.lit(0)).cast("long").alias("translations"))


def english_summary(days: DataFrame, as_of: Column) -> DataFrame:
    """reader, english_days and translated_days of the last 7 days; days without English drop out."""
    recent = days.filter("english_read").filter(F.col("date").between(F.date_sub(as_of, WEEK - 1), as_of))
    return recent.groupBy("reader").agg(F.count("*").alias("english_days"), F.count_if(F.col("translations") > 0).alias("translated_days"))


def upsert_positions(positions: DataFrame, kept: int = KEPT) -> DataFrame:
    """The latest position of each reader and text, and of those the newest ``kept`` per reader.

    positions: reader, text_hash, unit_index, unit_count, saved_at, seq (order of equal times).
    """
    newest = F.max_by(F.struct("unit_index", "unit_count", "saved_at", "seq"), F.struct("saved_at", "seq"))
    last = positions.groupBy("reader", "text_hash").agg(newest.alias("p")).select("reader", "text_hash", "p.*")
    place = F.row_number().over(W.partitionBy("reader").orderBy(F.desc("saved_at"), F.desc("seq")))
    return last.withColumn("_n", place).filter(F.col("_n") <= kept).drop("_n")


def upsert_boundaries(saved: DataFrame, positions: DataFrame, kept: int = KEPT) -> DataFrame:
    """Saved cut lists (reader, text_hash, boundaries, saved_at, just_written): texts in progress and new ones first."""
    last = saved.groupBy("reader", "text_hash").agg(F.max_by(F.struct("boundaries", "saved_at", "just_written"), "saved_at").alias("b")).select("reader", "text_hash", "b.*")
    rows = last.join(positions.select("reader", "text_hash", F.lit(True).alias("_open")).distinct(), ["reader", "text_hash"], "left")
    first = F.coalesce("_open", F.lit(False)) | F.coalesce("just_written", F.lit(False))
    place = F.row_number().over(W.partitionBy("reader").orderBy(F.desc(first), F.desc("saved_at"), "text_hash"))
    return rows.withColumn("_n", place).filter(F.col("_n") <= kept).drop("_n", "_open")


def resume(positions: DataFrame, counts: DataFrame, clamp_only: bool = False) -> DataFrame:
    """reader, text_hash, unit_index to open at: positions against today's unit counts (text_hash, units).

    A position of another count, or past the end, is not used (0); with clamp_only it is moved within.
    """
    rows = positions.join(counts, "text_hash")
    last = F.greatest(F.col("units") - 1, F.lit(0))
    usable = (F.col("unit_count") == F.col("units")) & (F.col("unit_index") < F.col("units"))
    at = F.least(F.greatest(F.col("unit_index"), F.lit(0)), last)
    return rows.select("reader", "text_hash", (at if clamp_only else F.when(usable, at).otherwise(0)).cast("int").alias("unit_index"))


def opening_boundaries(received: DataFrame, saved: DataFrame, positions: DataFrame) -> DataFrame:
    """reader, text_hash, boundaries on opening: the saved ones, none if read without them, else the received."""
    rows = received.join(saved.select("reader", "text_hash", F.col("boundaries").alias("_saved")), ["reader", "text_hash"], "left")
    rows = rows.join(positions.select("reader", "text_hash", F.lit(True).alias("_open")).distinct(), ["reader", "text_hash"], "left")
    use = F.when(F.col("_saved").isNotNull(), F.col("_saved")).when(F.col("_open").isNull(), F.col("boundaries"))
    return rows.select("reader", "text_hash", use.alias("boundaries"))


def open_positions(positions: DataFrame, finishes: DataFrame) -> DataFrame:
    """positions without those that a later finish (reader, text_hash, finished_at) of their text removed."""
    last = finishes.groupBy("reader", "text_hash").agg(F.max("finished_at").alias("_finished"))
    on = [positions[c] == last[c] for c in ("reader", "text_hash")] + [last["_finished"] >= positions["saved_at"]]
    return positions.join(last, on, "left_anti")


def weekly_verdict(days: DataFrame) -> DataFrame:
    """reader, week, days_opened, ja_characters, english_days, translated_days, verdict.

    days: reader, date, opened, ja_characters, english_read, translations. Weeks without rows count as 0,
    between a reader's first and last week. Two weeks in a row below a floor stop; all goals met go on.
    """
    week = F.date_trunc("week", "date").cast("date")
    sums = days.groupBy("reader", week.alias("week")).agg(
        F.count_if("opened").alias("days_opened"), F.sum("ja_characters").alias("ja_characters"), F.count_if("english_read").alias("english_days"),
        F.count_if(F.col("english_read") & (F.col("translations") > 0)).alias("translated_days"),
    )
    spine = sums.groupBy("reader").agg(F.min("week").alias("a"), F.max("week").alias("b")).select("reader", F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))
    rows = spine.join(sums, ["reader", "week"], "left").na.fill(0)
    order = W.partitionBy("reader").orderBy("week")
    twice = lambda low: low & F.coalesce(F.lag(low).over(order), F.lit(False))
    stop = twice(F.col("days_opened") < DAYS_STOP) | twice(F.col("ja_characters") < CHARACTERS_STOP) | twice(F.col("english_days") == 0)
    goes = (F.col("days_opened") >= DAYS_GO_ON) & (F.col("ja_characters") >= CHARACTERS_GO_ON) & (F.col("english_days") > 0) & (F.col("translated_days") >= F.col("english_days") * TRANSLATED_SHARE)
    return rows.withColumn("verdict", F.when(stop, "stop").when(goes, "continue").otherwise("watch"))


def translator_states(events: DataFrame) -> DataFrame:
    """reader, ts, seq, status, visible, ready after each translator event (reader, ts, seq, event).

    Events: available, unavailable, created, failed, toggle. The first word on availability counts; before it, and if
    it is unavailable, nothing has an effect. A toggle starts the making of a translator and shows the translation;
    while it is being made, and when it is ready, a toggle shows or hides. Created and failed count only while it is
    being made; a failure hides, and the next toggle starts anew.
    """
    order = W.partitionBy("reader").orderBy("ts", "seq")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    told = F.first(F.when(F.col("event").isin("available", "unavailable"), F.col("event")), ignorenulls=True).over(order)
    rows = events.withColumn("_told", told)
    rows = rows.withColumn("_kind", F.when((F.col("_told") == "available") & F.col("event").isin("toggle", "created", "failed"), F.col("event")))
    # It is being made where a toggle came last; the first created of that kind ends all making.
    rows = rows.withColumn("_making", F.coalesce(F.last("_kind", ignorenulls=True).over(before) == "toggle", F.lit(False)))
    rows = rows.withColumn("_ready", F.coalesce(F.max((F.col("_kind") == "created") & F.col("_making")).over(order), F.lit(False)))
    broke = F.coalesce((F.col("_kind") == "failed") & F.col("_making") & ~F.col("_ready"), F.lit(False))
    ends = F.coalesce(F.col("_kind").isin("created", "failed") & ~F.col("_ready"), F.lit(False))
    rows = rows.withColumns({"_failed": F.max(broke).over(order), "_epoch": F.sum(ends.cast("int")).over(order)})
    toggles = F.sum(F.coalesce(F.col("_kind") == "toggle", F.lit(False)).cast("int")).over(W.partitionBy("reader", "_epoch").orderBy("ts", "seq"))
    rows = rows.withColumn("_toggles", toggles)
    status = (
        F.when(F.col("_told").isNull(), "checking").when(F.col("_told") == "unavailable", "unavailable").when(F.col("_ready"), "ready")
        .when(F.col("_toggles") > 0, "creating").when(F.col("_failed"), "failed").otherwise("available")
    )
    return rows.select("reader", "ts", "seq", status.alias("status"), (F.col("_toggles") % 2 == 1).alias("visible"), F.col("_ready").alias("ready"))


def to_translate(shown: DataFrame, units: DataFrame) -> DataFrame:
    """reader, text_hash, sentence_index: English sentences that were on screen (reader, text_hash, unit_index) while
    translation was shown, each once. units: text_hash, unit_index, sentence_index, paragraph_language."""
    rows = shown.join(units, ["text_hash", "unit_index"]).filter("paragraph_language = 'en'")
    return rows.select("reader", "text_hash", "sentence_index").distinct()


def current_speed(readers: DataFrame, saved: DataFrame) -> DataFrame:
    """reader, ja_cpm, en_wpm: the latest saved speed within the limits, else the default."""
    within = lambda c, lang: F.col(c).between(*timing.LIMITS[lang][:2])
    last = saved.filter(within("ja_cpm", "ja") & within("en_wpm", "en")).groupBy("reader").agg(F.max_by(F.struct("ja_cpm", "en_wpm"), "saved_at").alias("s"))
    return readers.join(last, "reader", "left").select("reader", F.coalesce("s.ja_cpm", F.lit(timing.JA_CPM)).alias("ja_cpm"), F.coalesce("s.en_wpm", F.lit(timing.EN_WPM)).alias("en_wpm"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """reader, start, end, events: stretches of activity (reader, ts) parted by idle gaps; batch or stream."""
    found = events.groupBy("reader", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return found.select("reader", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
