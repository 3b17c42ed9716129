"""Cut lists of paragraphs: given, proposed by a model, aligned to an imported text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import bound

# Longest proposed unit, what can't start one, and the work budget of a document.
LONGEST_UNIT = 30
CANT_START = r"\A[。．！？!?、，,;；:：」』）)】〕］\]”’]"
MOST_PARAGRAPHS, MOST_CHARACTERS, MOST_IN_ALL = 30, 1_000, 20_000
#: Numbers that running() adds up at a time, and how often it sums up sums.
BLOCK, LEVELS = 16, 5


def valid(lists: Column) -> Column:
    """Whether every element is null or ascends strictly from at least 1."""
    rising = lambda a: F.forall(F.transform(a, lambda x, i: x > F.coalesce(F.when(i > 0, F.get(a, i - 1)), F.lit(0))), lambda ok: F.coalesce(ok, F.lit(False)))
    return lists.isNotNull() & F.forall(lists, lambda a: a.isNull() | rising(a))


def running(numbers: Column, levels: int = LEVELS) -> Column:
    """Running sums of an array: those of blocks first (by running sums of their own), so that a number isn't added up anew for each place behind it."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    plain = lambda n: F.transform(n, lambda _, i: total(F.slice(n, 1, i + 1)))
    if not levels:
        return bound(numbers, plain)
    block = lambda i: F.floor(i / BLOCK).cast("int")
    sums = lambda n: F.transform(F.sequence(F.lit(0), block(F.size(n) - 1)), lambda b: total(F.slice(n, b * BLOCK + 1, BLOCK)))
    places = lambda n, before: F.transform(n, lambda _, i: F.when(i < BLOCK, 0).otherwise(F.get(before, block(i) - 1)) + total(F.slice(n, block(i) * BLOCK + 1, i % BLOCK + 1)))
    return bound(numbers, lambda n: F.when(F.size(n) <= BLOCK, plain(n)).otherwise(bound(running(sums(n), levels - 1), lambda before: places(n, before))))


def from_units(paragraph: Column, units: Column) -> Column:
    """Cut places that proposed units give (UTF-16), or null if they don't make up the paragraph."""
    # Nearly all units are short and start with a letter; the rest are looked at closely.
    short = lambda u: (F.length(u) <= LONGEST_UNIT) & F.ascii(u).between(97, 122)
    fine = lambda u: short(u) | ((T.trim(u) != "") & (F.length(T.trim(u)) <= LONGEST_UNIT) & ~u.rlike(CANT_START))

    def cuts(u: Column) -> Column:
        wide = F.length(paragraph) != T.utf16_length(paragraph)
        ends = running(F.when(wide, F.transform(u, T.utf16_length)).otherwise(F.transform(u, F.length)))
        return F.when((F.size(u) > 0) & (F.array_join(u, "") == paragraph) & F.forall(u, fine), F.slice(ends, 1, F.size(u) - 1))

    return bound(units, cuts)


def response_units(response: Column) -> Column:
    """The units of a model's answer in either of its shapes, without thoughts and code fences; null if it has none."""
    said = F.coalesce(F.get_json_object(response, "$.response"), F.get_json_object(response, "$.choices[0].message.content"))
    bare = T.trim(F.regexp_replace(F.regexp_replace(said, "(?s)<think>.*?</think>", ""), r"(?m)^```\w*\s*$", ""))
    whole = F.from_json(bare, "units array<string>")
    return F.coalesce(whole["units"], F.from_json(F.get_json_object(bare, "$.units"), "array<string>"))


def targets(documents: DataFrame) -> DataFrame:
    """doc_id, pos: the paragraphs (doc_id, paragraphs array) that a model is asked to cut.

    In order, a Japanese paragraph is taken if it is short enough and still fits what is left of the
    document's budget; a paragraph left out uses nothing.
    """
    size = lambda p: F.length(p)
    start = F.struct(F.lit(0).alias("n"), F.lit(MOST_IN_ALL).alias("rest"), F.array().cast("array<int>").alias("taken"), F.lit(0).alias("at"))

    def step(s: Column, p: Column) -> Column:
        takes = T.is_japanese(p) & (size(p) <= MOST_CHARACTERS) & (s["n"] < MOST_PARAGRAPHS) & (size(p) <= s["rest"])
        return F.struct(
            F.when(takes, s["n"] + 1).otherwise(s["n"]).alias("n"),
            F.when(takes, s["rest"] - size(p)).otherwise(s["rest"]).alias("rest"),
            F.when(takes, F.concat(s["taken"], F.array(s["at"]))).otherwise(s["taken"]).alias("taken"),
            (s["at"] + 1).alias("at"),
        )

    return documents.select("doc_id", F.explode(F.aggregate("paragraphs", start, step, lambda s: s["taken"])).alias("pos"))


def aligned(received: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """doc_id, pos, boundaries: received cut lists (doc_id, pos, paragraph, boundaries) on a text's paragraphs.

    Paragraphs match by their text; of equal ones the first list that isn't null counts. Joined by the hash of the
    text, then compared.
    """
    code = F.xxhash64("paragraph")
    known = received.filter("boundaries is not null").groupBy("doc_id", code.alias("_code"), F.col("paragraph").alias("_text")).agg(F.min_by("boundaries", "pos").alias("boundaries"))
    rows = paragraphs.withColumn("_code", code).join(known, ["doc_id", "_code"], "left")
    same = F.col("paragraph") == F.col("_text")
    return rows.groupBy("doc_id", "pos").agg(F.max_by(F.when(same, F.col("boundaries")), F.coalesce(same, F.lit(False))).alias("boundaries"))
