"""JSON stores of readers, read with their bad items dropped one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import boundaries, timing

AMOUNTS = ["japaneseCharacters", "englishWords", "japaneseDurationMs", "englishDurationMs"]


def _whole(x: Column) -> Column:
    """A JSON number that is a whole number of at least 0, else null."""
    return F.when(x.rlike(r"\A\d{1,18}(\.0+)?\z"), F.regexp_replace(x, r"\..*", "").try_cast("long"))


def _raw(item: Column, path: str) -> Column:
    """A number as it stands in the item; null for strings, so that "1" is no number."""
    name = path.split(".")[-1]
    return F.when(F.regexp_extract(item, rf'"{name}"\s*:\s*("?)', 1) == "", F.get_json_object(item, f"$.{path}"))


def _items(rows: DataFrame, json_col: str) -> DataFrame:
    """rows with text_hash and item: the entries of a JSON object, each still as text."""
    return rows.select("reader", F.explode(F.from_json(json_col, "map<string,string>")).alias("name", "item"))


def _kept(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    out = rows.withColumns(columns)
    for c in columns:
        out = out.filter(F.col(c).isNotNull())
    return out.drop("item")


def positions(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """reader, text_hash and the eight numbers of each position; all must be whole and at least 0."""
    names = {"unit_index": "unitIndex", "unit_count": "unitCount", "saved_at": "savedAt", "played_ms": "playedMs"}
    numbers = {a: _whole(_raw(F.col("item"), b)) for a, b in names.items()}
    numbers |= {a: _whole(_raw(F.col("item"), f"readAmount.{b}")) for a, b in zip(("ja_characters", "en_words", "ja_ms", "en_ms"), AMOUNTS, strict=True)}
    return _kept(_items(rows, json_col), numbers).withColumnRenamed("name", "text_hash")


def finished_readings(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """reader, pos, finished_at, ja_characters, en_words, played_ms of a JSON array."""
    items = rows.select("reader", F.posexplode(F.from_json(json_col, "array<string>")).alias("pos", "item"))
    names = {"finished_at": "finishedAt", "ja_characters": "japaneseCharacters", "en_words": "englishWords", "played_ms": "playedMs"}
    return _kept(items, {a: _whole(_raw(F.col("item"), b)) for a, b in names.items()})


def english_days(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """reader, date (string), english_read, translations; keys must look like dates, arrays give nothing."""
    objects = rows.filter(~F.trim(json_col).startswith("["))
    flag = _raw(F.col("item"), "englishRead")
    cols = {"english_read": F.when(flag.isin("true", "false"), flag == "true"), "translations": _whole(_raw(F.col("item"), "translationDisplayCount"))}
    return _kept(_items(objects, json_col).filter(F.col("name").rlike(r"\A\d{4}-\d{2}-\d{2}\z")), cols).withColumnRenamed("name", "date")


def speed(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """reader, ja_cpm, en_wpm; null unless both are numbers within their limits."""
    ja, en = (_raw(F.col(json_col), x).try_cast("double") for x in ("japaneseCharactersPerMinute", "englishWordsPerMinute"))
    good = ja.between(*timing.LIMITS["ja"][:2]) & en.between(*timing.LIMITS["en"][:2])
    return rows.select("reader", F.when(good, ja).alias("ja_cpm"), F.when(good, en).alias("en_wpm"))


def saved_boundaries(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """reader, text_hash, boundaries, saved_at; lists must ascend in whole numbers."""
    objects = rows.filter(~F.trim(json_col).startswith("["))
    text = F.get_json_object("item", "$.paragraphBoundaries")
    lists = F.from_json(text, "array<array<int>>")
    fine = ~text.rlike(r"[.eE]|\"") & boundaries.valid(lists)
    return _kept(_items(objects, json_col), {"boundaries": F.when(fine, lists), "saved_at": _whole(_raw(F.col("item"), "savedAt"))}).withColumnRenamed("name", "text_hash")


def export_positions(rows: DataFrame) -> DataFrame:
    """reader, json: positions() rows as one JSON object per reader (at most 100 texts each)."""
    amount = F.struct(*[F.col(a).alias(b) for a, b in zip(("ja_characters", "en_words", "ja_ms", "en_ms"), AMOUNTS, strict=True)])
    item = F.struct(F.col("unit_index").alias("unitIndex"), F.col("played_ms").alias("playedMs"), amount.alias("readAmount"), F.col("unit_count").alias("unitCount"), F.col("saved_at").alias("savedAt"))
    return rows.groupBy("reader").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("text_hash", item)))).alias("json"))


def export_finished(rows: DataFrame) -> DataFrame:
    """reader, json: finished readings (pos or any order column, finished_at, ja_characters, en_words, played_ms) as a JSON array per reader, in their order."""
    item = F.struct(F.col("finished_at").alias("finishedAt"), F.col("ja_characters").alias("japaneseCharacters"), F.col("en_words").alias("englishWords"), F.col("played_ms").alias("playedMs"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))), lambda x: x["item"])
    return rows.groupBy("reader").agg(F.to_json(listed).alias("json"))


def _object(rows: DataFrame, key: str, item: Column) -> DataFrame:
    return rows.groupBy("reader").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), item.alias("item")))))).alias("json"))


def export_english_days(rows: DataFrame) -> DataFrame:
    """reader, json: days (date, english_read, translations) as one JSON object per reader."""
    return _object(rows.withColumn("_day", F.col("date").cast("string")), "_day", F.struct(F.col("english_read").alias("englishRead"), F.col("translations").alias("translationDisplayCount")))


def export_boundaries(rows: DataFrame) -> DataFrame:
    """reader, json: saved cut lists (text_hash, boundaries, saved_at) as one JSON object per reader (at most 100 texts each); a paragraph without a list stays null."""
    return _object(rows, "text_hash", F.struct(F.col("boundaries").alias("paragraphBoundaries"), F.col("saved_at").alias("savedAt")))


def export_speed(rows: DataFrame) -> DataFrame:
    """reader, json of each reader's speed (ja_cpm, en_wpm)."""
    return rows.select("reader", F.to_json(F.struct(F.col("ja_cpm").alias("japaneseCharactersPerMinute"), F.col("en_wpm").alias("englishWordsPerMinute"))).alias("json"))
