"""Reading times of units, sentences and documents. Speeds: Japanese characters and English words a minute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import segment
from .shared import parts, spread

# Default speeds, their limits and steps, pauses in units, characters of a mean Japanese unit.
JA_CPM, EN_WPM = 600.0, 300.0
LIMITS = {"ja": (100.0, 3000.0, 50.0), "en": (50.0, 1500.0, 25.0)}
PAUSES = {"none": 0.0, "comma": 0.5, "sentence": 1.0, "paragraph": 2.0}
MEAN_UNIT = 5.0
#: Scenarios of one comparison, which travel as one value.
MOST_SCENARIOS = 100_000


def _number(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def rounded(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def pause_units(pause: Column) -> Column:
    out = F.lit(0.0)
    for name, n in PAUSES.items():
        out = F.when(pause == name, F.lit(n)).otherwise(out)
    return out


def display_ms(text: Column, language: Column, pause: Column, ja_cpm=JA_CPM, en_wpm=EN_WPM, rounding: bool = True) -> Column:
    """How long a unit is shown. A speed of 0 or less is an error; without rounding it counts as 1 and the result is in seconds."""
    ja, en = _number(ja_cpm), _number(en_wpm)
    if not rounding:
        ja, en = F.greatest(ja, F.lit(1.0)), F.greatest(en, F.lit(1.0))
    minute = 60_000.0 if rounding else 60.0
    p = pause_units(pause)
    raw = F.when(language == "ja", F.lit(minute) / ja * (T.character_count(text) + p * MEAN_UNIT)).otherwise(F.lit(minute) / en * (F.lit(1.0) + p))
    if not rounding:
        return raw
    return F.when((ja > 0) & (en > 0), rounded(raw)).otherwise(F.raise_error(F.lit("a reading speed must be above 0")).cast("long"))


def step_speed(speed: Column, language: str, steps: Column) -> Column:
    """The speed after so many steps up or down, within its limits."""
    low, high, step = LIMITS[language]
    return F.least(F.greatest(speed + steps * F.lit(step), F.lit(low)), F.lit(high))


def with_times(units: DataFrame, ja_cpm=JA_CPM, en_wpm=EN_WPM) -> DataFrame:
    """units with ms, remaining_ms (from the unit on), start_ms and end_ms of the playback, remaining_fraction."""
    inside = W.partitionBy("doc_id").orderBy("unit_index")
    whole = inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = units.withColumn("ms", display_ms(F.col("text"), F.col("language"), F.col("pause"), ja_cpm, en_wpm))
    upto = F.sum("ms").over(inside.rowsBetween(W.unboundedPreceding, 0))
    last = F.max("end").over(whole)
    return rows.withColumns({
        # Not as a sum onward, which adds up the rest anew for every row.
        "remaining_ms": F.sum("ms").over(whole) - upto + F.col("ms"),
        "start_ms": upto - F.col("ms"),
        "end_ms": upto,
        "remaining_fraction": (last - F.col("start")) / (last - F.min("start").over(whole)),
    })


def plan(units: DataFrame, ja_cpm=JA_CPM, en_wpm=EN_WPM) -> DataFrame:
    """Per document: units, sentences, ja_chars, en_words, total_ms, has_ja, has_en, has_en_sentence."""
    ja = F.col("language") == "ja"
    ms = display_ms(F.col("text"), F.col("language"), F.col("pause"), ja_cpm, en_wpm)
    return units.groupBy("doc_id").agg(
        F.count("*").alias("units"),
        (F.max("sentence_index") + 1).cast("long").alias("sentences"),
        F.sum(F.when(ja, T.character_count(F.col("text"))).otherwise(0)).alias("ja_chars"),
        F.count_if(~ja).alias("en_words"),
        F.sum(ms).alias("total_ms"),
        F.bool_or(ja).alias("has_ja"),
        F.bool_or(~ja).alias("has_en"),
        F.bool_or(F.col("paragraph_language") == "en").alias("has_en_sentence"),
    )


def plan_documents(docs: DataFrame, ja_cpm=JA_CPM, en_wpm=EN_WPM, **options) -> DataFrame:
    """plan() of the units of docs (doc_id, unique; text), without making the units of texts that have no Japanese.

    A plan of English words needs numbers only: of words, paragraphs, sentences and commas. They are counted in the
    text, without a shuffle if there are parts for all cores. Japanese texts, and those given with options of segment.units(), go by way of their units.
    """
    if options:
        return plan(segment.units(docs, **options), ja_cpm, en_wpm)
    docs = spread(docs)
    ja = F.coalesce(T.is_japanese(F.col("text")), F.lit(False))
    n = {k: v.cast("long") for k, v in T.english_counts(F.col("text")).items()}
    rows = docs.filter(~ja & F.col("text").rlike(f"[{T.SOLID}]")).select("doc_id", *[v.alias(k) for k, v in n.items()])
    ms = lambda pause: display_ms(F.lit(""), F.lit("en"), F.lit(pause), ja_cpm, en_wpm)
    rest = F.col("words") - F.col("paragraphs") - F.col("ends") - F.col("commas")
    total = F.col("paragraphs") * ms("paragraph") + F.col("ends") * ms("sentence") + F.col("commas") * ms("comma") + rest * ms("none")
    english = rows.select(
        "doc_id", F.col("words").alias("units"), (F.col("paragraphs") + F.col("ends")).alias("sentences"), F.lit(0).cast("long").alias("ja_chars"),
        F.col("words").alias("en_words"), total.alias("total_ms"), F.lit(False).alias("has_ja"), F.lit(True).alias("has_en"), F.lit(True).alias("has_en_sentence"),
    )
    return english.unionByName(plan(segment.units(docs.filter(ja)), ja_cpm, en_wpm))


def plan_at_speeds(units: DataFrame, speeds: DataFrame) -> DataFrame:
    """doc_id, scenario, total_ms for each row of speeds (scenario, ja_cpm, en_wpm), however many.

    Units are first grouped by what decides their time; then every document's few groups travel as one array
    and meet each scenario once, so the scenarios multiply rows of the result only.
    """
    size = F.when(F.col("language") == "ja", T.character_count(F.col("text"))).otherwise(1)
    kinds = units.groupBy("doc_id", "language", "pause", size.alias("size")).agg(F.count("*").alias("n"))
    docs = kinds.groupBy("doc_id").agg(F.collect_list(F.struct("language", "pause", "size", "n")).alias("kinds"))

    def ms(x: Column) -> Column:
        p = pause_units(x["pause"])
        raw = F.when(x["language"] == "ja", F.lit(60_000.0) / F.col("ja_cpm") * (x["size"] + p * MEAN_UNIT)).otherwise(F.lit(60_000.0) / F.col("en_wpm") * (F.lit(1.0) + p))
        return rounded(raw) * x["n"]

    speeds = speeds.select("scenario", F.col("ja_cpm").cast("double"), F.col("en_wpm").cast("double"))
    # The scenarios are one value, computed once; the result has a row per document and scenario.
    many = F.collect_list(F.struct(*speeds.columns))
    listed = speeds.agg(F.when(F.count("*") > MOST_SCENARIOS, F.raise_error(F.lit(f"more than {MOST_SCENARIOS} scenarios"))).otherwise(many).alias("scenarios"))
    each = docs.withColumn("scenarios", listed.scalar()).select("doc_id", "kinds", F.inline("scenarios"))
    return each.select("doc_id", "scenario", F.aggregate("kinds", F.lit(0).cast("long"), lambda s, x: s + ms(x)).alias("total_ms"))


def unit_at_offset(units: DataFrame, probes: DataFrame) -> DataFrame:
    """doc_id, probe_id, offset, unit_index: the unit at a text offset, as an as-of join within documents.

    A blank between units belongs to the next one; before the first unit is the first, past the end the
    last. Documents without units give null.
    """
    marks = units.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("kind"), "unit_index", "end", F.lit(None).cast("long").alias("probe_id"))
    asked = probes.select("doc_id", F.col("offset").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("unit_index"), F.lit(None).cast("int").alias("end"), "probe_id")
    order = W.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("doc_id")
    # Both sides in the same parts, so that the units aren't shuffled again.
    rows = marks.unionByName(asked.repartition(parts(units), "doc_id")).withColumns({"hit": F.last("unit_index", ignorenulls=True).over(order), "upto": F.last("end", ignorenulls=True).over(order), "most": F.max("unit_index").over(whole)})
    found = F.when(F.col("most").isNull(), None).when(F.col("hit").isNull(), 0).when(F.col("at") < F.col("upto"), F.col("hit")).otherwise(F.least(F.col("hit") + 1, F.col("most")))
    return rows.filter("kind = 1").select("doc_id", "probe_id", F.col("at").alias("offset"), found.cast("int").alias("unit_index"))


def moves(units: DataFrame) -> DataFrame:
    """doc_id, unit_index, first_of_sentence, previous_sentence, next_sentence: where sentence moves lead."""
    line, back = W.partitionBy("doc_id").orderBy("unit_index"), W.partitionBy("doc_id").orderBy(F.desc("unit_index"))
    start = F.coalesce(F.lag("sentence_index").over(line) != F.col("sentence_index"), F.lit(True))
    rows = units.select("doc_id", "unit_index", "sentence_index").withColumn("_start", F.when(start, F.col("unit_index")))
    before = F.max("_start").over(line.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_before", F.when(F.col("_start").isNotNull(), before))
    upto = line.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"first_of_sentence": F.max("_start").over(upto), "_before": F.max("_before").over(upto)})
    rows = rows.withColumn("_after", F.min("_start").over(back.rowsBetween(W.unboundedPreceding, -1)))
    here = F.col("first_of_sentence")
    earlier = F.when(F.col("unit_index") > here, here).otherwise(F.coalesce("_before", F.lit(0)))
    return rows.select("doc_id", "unit_index", "first_of_sentence", earlier.alias("previous_sentence"), F.coalesce("_after", "unit_index").alias("next_sentence"))


def moved(unit_index: Column, delta: Column, units: Column) -> Column:
    """A move by units, kept within the text."""
    return F.least(F.greatest(unit_index + delta, F.lit(0)), units - 1)


def clock(ms: Column) -> tuple[Column, Column, Column]:
    """Hours, minutes and seconds of a duration, rounded to the second."""
    s = rounded(ms / 1000)
    return F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), (s % 60).cast("long")


def remaining_clock(ms: Column) -> tuple[Column, Column]:
    """About how long is left: hours and minutes, rounded to the minute (0 and 0: under a minute)."""
    m = rounded(ms / 60_000)
    return F.floor(m / 60).cast("long"), (m % 60).cast("long")


def played_text(ms: Column) -> Column:
    h, m, s = clock(ms)
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def amount_text(characters: Column, words: Column) -> Column:
    """The amount read, with separators; a language without any is left out."""
    part = lambda n, name: F.when(n > 0, F.concat(F.format_number(n, 0), F.lit(f" {name}")))
    both = F.concat_ws(", ", part(characters, "characters"), part(words, "words"))
    return F.when(both == "", F.lit("0 characters")).otherwise(both)


def around(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, unit_index, before, unit, after: the text split around chosen units (doc_id, unit_index, start, end)."""
    rows = chosen.select("doc_id", "unit_index", "start", "end").join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id")
    part = lambda a, n: F.substring("_text", a, n)
    return rows.select("doc_id", "unit_index", part(F.lit(1), F.col("start")).alias("before"), part(F.col("start") + 1, F.col("end") - F.col("start")).alias("unit"), part(F.col("end") + 1, F.length("_text")).alias("after"))
