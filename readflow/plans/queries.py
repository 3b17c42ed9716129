"""Registered queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5, name2codepoint

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..operators import activity, boundaries, crawl, html, segment, timing
from ..operators.shared import parted, written
from . import adapters as A

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.units(A.table(spark, sf_dir, "documents"))


# --- texts, units, times -------------------------------------------------------------------------

_UNITS = r"""
p AS (
  SELECT doc_id, unnest(range(len(ps))) AS paragraph_index, unnest(ps) AS piece
  FROM (SELECT doc_id, regexp_extract_all(text, '[\r\n]*[^\r\n]+') AS ps FROM documents)
), q AS (
  SELECT doc_id, paragraph_index, regexp_replace(piece, '^[\r\n]+', '') AS paragraph,
    sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY paragraph_index) - length(regexp_replace(piece, '^[\r\n]+', '')) AS start FROM p
), w AS (
  SELECT doc_id, paragraph_index, start, unnest(range(len(ws))) AS pos, unnest(ws) AS piece
  FROM (SELECT *, regexp_extract_all(paragraph, '\s*\S+') AS ws FROM q)
), x AS (
  SELECT *, regexp_replace(piece, '^\s+', '') AS text,
    start + sum(length(piece)) OVER (PARTITION BY doc_id, paragraph_index ORDER BY pos) AS stop FROM w
), y AS (
  SELECT *, regexp_matches(text, '[.!?]+["''”’)\]]*$') AND lower(regexp_replace(text, '^["''“‘(\[]+', ''))
    NOT IN ('mr.', 'mrs.', 'ms.', 'dr.', 'prof.', 'st.', 'vs.', 'e.g.', 'i.e.') AS ends FROM x
), z AS (
  SELECT *, coalesce(lag(ends) OVER (PARTITION BY doc_id, paragraph_index ORDER BY pos), true) AS begins,
    lead(pos) OVER (PARTITION BY doc_id, paragraph_index ORDER BY pos) IS NULL AS last FROM y
), units AS (
  SELECT doc_id, CAST(row_number() OVER o - 1 AS INTEGER) AS unit_index, CAST(paragraph_index AS INTEGER) AS paragraph_index,
    CAST(sum(begins::INT) OVER o - 1 AS INTEGER) AS sentence_index, text, CAST(stop - length(text) AS INTEGER) AS "start", CAST(stop AS INTEGER) AS "end",
    'en' AS language, 'en' AS paragraph_language,
    CASE WHEN last THEN 'paragraph' WHEN ends THEN 'sentence' WHEN regexp_matches(text, '[,;:]["''”’)\]]*$') THEN 'comma' ELSE 'none' END AS pause
  FROM z WINDOW o AS (PARTITION BY doc_id ORDER BY paragraph_index, pos)
)"""
_TIMED = (
    _UNITS
    + """, timed AS (
  SELECT *, CAST(floor(60000.0 / 300.0 * (1 + CASE pause WHEN 'none' THEN 0 WHEN 'comma' THEN 0.5 WHEN 'sentence' THEN 1 ELSE 2 END) + 0.5) AS BIGINT) AS ms FROM units
)"""
)


@query("a13_import", r"""
SELECT doc_id, CASE WHEN t <> '' THEN sha256(t) END AS text_hash, CAST(length(t) AS BIGINT) AS chars, CASE WHEN t = '' THEN 'empty' END AS reason
FROM (SELECT doc_id, trim(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents)""")
def a13_import(spark, sf_dir):
    """Texts as imported, with their identity."""
    rows = A.documents(spark, sf_dir)
    why = T.empty_reason(F.col("text"))
    return rows.select("doc_id", F.when(why.isNull(), F.col("text_hash")).alias("text_hash"), F.length("text").cast("long").alias("chars"), why.alias("reason"))


@query("w1_units", f"WITH {_UNITS} SELECT * FROM units")
def w1_units(spark, sf_dir):
    """Reading units of all documents."""
    return _units(spark, sf_dir)


@query("c14_sentences", f'WITH {_UNITS} SELECT doc_id, sentence_index, min("start") AS "start", max("end") AS "end", \'en\' AS language FROM units GROUP BY ALL')
def c14_sentences(spark, sf_dir):
    return segment.sentences(_units(spark, sf_dir))


@query("c22_quality", f"""WITH {_UNITS} SELECT language, count(*) AS units, round(avg(length(text)), 6) AS mean_length,
  round(avg(CASE WHEN length(text) <= 2 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS short_share, count(*) FILTER (WHERE length(text) > 15) AS over_15, max(length(text)) AS longest FROM units GROUP BY language""")
def c22_quality(spark, sf_dir):
    return segment.quality(_units(spark, sf_dir))


@query("d5_timeline", f"""WITH {_TIMED} SELECT doc_id, unit_index, ms, CAST(sum(ms) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS remaining_ms,
  CAST(sum(ms) OVER w - ms AS BIGINT) AS start_ms, CAST(sum(ms) OVER w AS BIGINT) AS end_ms,
  round((max("end") OVER d - "start") / (max("end") OVER d - min("start") OVER d)::DOUBLE, 9) AS remaining_fraction
  FROM timed WINDOW w AS (PARTITION BY doc_id ORDER BY unit_index), d AS (PARTITION BY doc_id)""")
def d5_timeline(spark, sf_dir):
    """Display time, time left, playback and share left of every unit."""
    return timing.with_times(_units(spark, sf_dir)).select("doc_id", "unit_index", "ms", "remaining_ms", "start_ms", "end_ms", F.round("remaining_fraction", 9).alias("remaining_fraction"))


_PLAN = f"""WITH {_TIMED} SELECT doc_id, count(*) AS units, CAST(max(sentence_index) + 1 AS BIGINT) AS sentences, CAST(0 AS BIGINT) AS ja_chars, count(*) AS en_words,
  CAST(sum(ms) AS BIGINT) AS total_ms, false AS has_ja, true AS has_en, true AS has_en_sentence FROM timed GROUP BY doc_id"""


@query("d8_plan", _PLAN)
def d8_plan(spark, sf_dir):
    """The reading plan of every document."""
    return timing.plan_documents(A.table(spark, sf_dir, "documents"))


@query("d9_offsets", f"""WITH {_UNITS}, probes AS (SELECT doc_id, i AS probe_id, CAST(length(text) * i / 3 AS INTEGER) AS "offset" FROM (SELECT doc_id, text, unnest([0, 1, 2, 3, 4]) AS i FROM documents)),
m AS (SELECT doc_id, max(unit_index) AS most FROM units GROUP BY doc_id),
h AS (SELECT p.doc_id, probe_id, "offset", max(unit_index) AS hit, max("end") AS upto FROM probes p LEFT JOIN units u ON u.doc_id = p.doc_id AND u."start" <= p."offset" GROUP BY ALL)
SELECT h.doc_id, CAST(probe_id AS BIGINT) AS probe_id, "offset", CAST(CASE WHEN most IS NULL THEN NULL WHEN hit IS NULL THEN 0 WHEN "offset" < upto THEN hit ELSE least(hit + 1, most) END AS INTEGER) AS unit_index FROM h LEFT JOIN m USING (doc_id)""".replace("CAST(length(text) * i / 3 AS INTEGER)", "CAST(floor(length(text) * i / 3) AS INTEGER)"))
def d9_offsets(spark, sf_dir):
    """As-of join of five offsets per document with its units."""
    docs = A.table(spark, sf_dir, "documents")
    probes = docs.select("doc_id", F.length("text").alias("n"), F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("i"))
    probes = probes.select("doc_id", F.col("i").cast("long").alias("probe_id"), F.floor(F.col("n") * F.col("i") / 3).cast("int").alias("offset"))
    return timing.unit_at_offset(_units(spark, sf_dir), probes)


@query("d10_moves", f"""WITH {_UNITS}, s AS (SELECT doc_id, sentence_index, min(unit_index) AS first FROM units GROUP BY ALL),
t AS (SELECT *, lag(first) OVER w AS before, lead(first) OVER w AS after FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY sentence_index))
SELECT doc_id, unit_index, first AS first_of_sentence, CASE WHEN unit_index > first THEN first ELSE coalesce(before, 0) END AS previous_sentence, coalesce(after, unit_index) AS next_sentence FROM units JOIN t USING (doc_id, sentence_index)""")
def d10_moves(spark, sf_dir):
    return timing.moves(_units(spark, sf_dir))


@query("d11_clock", f"""WITH {_TIMED}, t AS (SELECT doc_id, CAST(sum(ms) AS BIGINT) AS ms FROM timed GROUP BY doc_id), u AS (SELECT *, CAST(floor(ms / 1000.0 + 0.5) AS BIGINT) AS s, CAST(floor(ms / 60000.0 + 0.5) AS BIGINT) AS m FROM t)
SELECT doc_id, s // 3600 AS hours, s % 3600 // 60 AS minutes, s % 60 AS seconds, m // 60 AS about_hours, m % 60 AS about_minutes FROM u""")
def d11_clock(spark, sf_dir):
    rows = d8_plan(spark, sf_dir)
    h, m, s = timing.clock(F.col("total_ms"))
    about = timing.remaining_clock(F.col("total_ms"))
    return rows.select("doc_id", h.alias("hours"), m.alias("minutes"), s.alias("seconds"), about[0].alias("about_hours"), about[1].alias("about_minutes"))


@query("d12_speeds", f"""WITH {_UNITS}, v(scenario, wpm) AS (VALUES ('slow', 150.0), ('default', 300.0), ('fast', 475.0))
SELECT doc_id, scenario, CAST(sum(floor(60000.0::DOUBLE / wpm * (1 + CASE pause WHEN 'none' THEN 0 WHEN 'comma' THEN 0.5 WHEN 'sentence' THEN 1 ELSE 2 END) + 0.5)) AS BIGINT) AS total_ms FROM units, v GROUP BY ALL""")
def d12_speeds(spark, sf_dir):
    """Every document's time at three speeds."""
    speeds = spark.createDataFrame([("slow", 300.0, 150.0), ("default", 600.0, 300.0), ("fast", 950.0, 475.0)], "scenario string, ja_cpm double, en_wpm double")
    return timing.plan_at_speeds(_units(spark, sf_dir), speeds)


@query("d13_longest", _PLAN.replace("GROUP BY doc_id", "GROUP BY doc_id ORDER BY total_ms DESC, doc_id LIMIT 20"))
def d13_longest(spark, sf_dir):
    return timing.plan_documents(A.table(spark, sf_dir, "documents")).orderBy(F.desc("total_ms"), "doc_id").limit(20)


@query("d14_around", f"""WITH {_UNITS}, c AS (SELECT doc_id, max(unit_index) // 2 AS unit_index FROM units GROUP BY doc_id)
SELECT u.doc_id, unit_index, left(d.text, u."start") AS before, substr(d.text, u."start" + 1, u."end" - u."start") AS unit, substr(d.text, u."end" + 1) AS after
FROM units u JOIN c USING (doc_id, unit_index) JOIN documents d ON d.doc_id = u.doc_id""")
def d14_around(spark, sf_dir):
    """Each text split around its middle unit."""
    units = _units(spark, sf_dir).select("doc_id", "unit_index", "start", "end").withColumn("_most", F.max("unit_index").over(W.partitionBy("doc_id")))
    return timing.around(A.table(spark, sf_dir, "documents"), units.filter(F.col("unit_index") == F.floor(F.col("_most") / 2)))


#: Fixed letters that make Japanese text of the documents, the same in SQL: letters become kana and kanji, stops and blanks Japanese ones.
LATIN, KANA = "abcdefghijklmnopqrstuvwxyz., ", "かきくけこさしすせそたちつてとなにぬねの漢字読書本文。、の"
#: What makes one of their lines Japanese. A line without it is English: it is cut at blanks, whatever cuts are given.
_LETTER = "[か-ん漢字読書本文。、]"
_JA = f"""ja AS (SELECT doc_id, translate(text, '{LATIN}', '{KANA}') AS text FROM documents WHERE text IS NOT NULL),
jl AS (SELECT doc_id, unnest(range(len(ls))) AS paragraph_index, unnest(ls) AS line FROM (SELECT doc_id, list_filter(string_split_regex(text, '[\\r\\n]+'), lambda x: x <> '') AS ls, text FROM ja)),
js AS (SELECT doc_id, paragraph_index, line, unnest(range(len(ss))) AS k, unnest(ss) AS s FROM (SELECT *, regexp_extract_all(line, '(?s).[^。．！？!?]*(?:[。．！？!?]+[」』）)】〕］"”’]*)?') AS ss FROM jl WHERE regexp_matches(line, '{_LETTER}'))),
jb AS (SELECT *, length(s) AS n, sum(length(s)) OVER (PARTITION BY doc_id, paragraph_index ORDER BY k) - length(s) AS base FROM js),
jp AS (SELECT doc_id, paragraph_index, k, line, greatest(base, 4 * j) AS a, least(base + n, 4 * j + 4) AS b, base + n AS stop FROM (SELECT *, unnest(range(CAST(base // 4 AS BIGINT), CAST((base + n - 1) // 4 + 1 AS BIGINT))) AS j FROM jb)),
ju AS (SELECT doc_id, paragraph_index, k, substr(line, CAST(a AS INT) + 1, CAST(b - a AS INT)) AS unit, a, CASE WHEN b = length(line) THEN 'paragraph' WHEN b = stop THEN 'sentence' WHEN regexp_matches(substr(line, CAST(a AS INT) + 1, CAST(b - a AS INT)), '[、，,;；:：]["''”’)\\]」』）】〕］]*$') THEN 'comma' ELSE 'none' END AS pause FROM jp),
jw AS (SELECT doc_id, paragraph_index, unnest(range(len(ws))) AS pos, unnest(ws) AS unit, len(ws) AS many FROM (SELECT *, regexp_extract_all(line, '[^{T.SPACE}]+') AS ws FROM jl WHERE NOT regexp_matches(line, '{_LETTER}'))),
je AS (SELECT *, regexp_matches(unit, '[.!?]+["''”’)\\]]*$') AND lower(regexp_replace(unit, '^["''“‘(\\[]+', '')) NOT IN ({", ".join(f"'{x}'" for x in T.ABBREVIATIONS)}) AS ends FROM jw),
jx AS (SELECT doc_id, paragraph_index, k, unit, pause, CASE WHEN regexp_matches(unit, '{_LETTER}') THEN 'ja' ELSE 'en' END AS language FROM ju WHERE regexp_matches(unit, '[^\\s]')
  UNION ALL SELECT doc_id, paragraph_index, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, paragraph_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), unit,
  CASE WHEN pos = many - 1 THEN 'paragraph' WHEN ends THEN 'sentence' WHEN regexp_matches(unit, '[、，,;；:：]["''”’)\\]」』）】〕］]*$') THEN 'comma' ELSE 'none' END, 'en' FROM je),
jm AS (SELECT *, CASE WHEN language = 'ja' THEN length(regexp_replace(unit, '\\s', '', 'g')) ELSE 0 END AS chars,
  CASE pause WHEN 'none' THEN 0 WHEN 'comma' THEN 0.5 WHEN 'sentence' THEN 1 ELSE 2 END AS p FROM jx)"""


def _japanese(spark, sf_dir):
    """Units of the documents in Japanese letters, lines without blanks and cut at every fourth character."""
    docs = A.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.translate("text", LATIN, KANA).alias("text"))
    lines = F.filter(F.split("text", r"[\r\n]+"), lambda x: x != "")
    cuts = F.transform(lines, lambda x: F.when(F.length(x) > 4, F.sequence(F.lit(4), F.length(x) - 1, F.lit(4))).otherwise(F.array().cast("array<int>")))
    return segment.units(docs.withColumn("boundaries", cuts), boundaries_col="boundaries")


@query("c6_given_cuts", f"WITH {_JA} SELECT doc_id, CAST(paragraph_index AS INTEGER) AS paragraph_index, unit AS text, pause, language, count(*) AS n FROM jx GROUP BY ALL")
def c6_given_cuts(spark, sf_dir):
    """Units of Japanese texts by given cuts, with sentences, commas and paragraphs."""
    return _japanese(spark, sf_dir).groupBy("doc_id", "paragraph_index", "text", "pause", "language").agg(F.count("*").alias("n"))


@query("d1_japanese_plan", f"""WITH {_JA}, jn AS (SELECT doc_id, count(DISTINCT (paragraph_index, k)) AS n FROM jx GROUP BY 1)
SELECT doc_id, count(*) AS units, max(n) AS sentences, CAST(sum(chars) AS BIGINT) AS ja_chars, count(*) FILTER (WHERE language = 'en') AS en_words,
  CAST(sum(floor(CASE WHEN language = 'ja' THEN 60000.0::DOUBLE / 600.0 * (chars + p * 5.0) ELSE 60000.0::DOUBLE / 300.0 * (1 + p) END + 0.5)) AS BIGINT) AS total_ms FROM jm JOIN jn USING (doc_id) GROUP BY doc_id""")
def d1_japanese_plan(spark, sf_dir):
    """Character counts and reading times of Japanese texts."""
    return timing.plan(_japanese(spark, sf_dir)).select("doc_id", "units", "sentences", "ja_chars", "en_words", "total_ms")


@query("d4_steps", "SELECT doc_id, least(greatest(600 + 50.0 * (doc_id % 121 - 60), 100), 3000)::DOUBLE AS ja_cpm, least(greatest(300 + 25.0 * (doc_id % 121 - 60), 50), 1500)::DOUBLE AS en_wpm FROM documents")
def d4_steps(spark, sf_dir):
    steps = F.col("doc_id") % 121 - 60
    return A.table(spark, sf_dir, "documents").select("doc_id", timing.step_speed(F.lit(timing.JA_CPM), "ja", steps).alias("ja_cpm"), timing.step_speed(F.lit(timing.EN_WPM), "en", steps).alias("en_wpm"))


@query("c17_proposed", """WITH p AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS paragraph FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
u AS (SELECT doc_id, pos, paragraph, regexp_extract_all(CASE WHEN (doc_id + pos) % 5 = 0 THEN paragraph[2:] ELSE paragraph END, '[^ ]+ *') AS units FROM p)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN len(units) > 0 AND array_to_string(units, '') = paragraph
  AND len(list_filter(units, lambda u: length(trim(u)) = 0 OR length(trim(u)) > 30 OR regexp_matches(u, '^[!?,;:)\\]”’]'))) = 0
  THEN to_json(list_transform(range(1, len(units)), lambda i: length(array_to_string(units[1:i], '')))) END AS boundaries FROM u""")
def c17_proposed(spark, sf_dir):
    """Cut places from the words of all lines, every fifth of them damaged."""
    rows = parted(A.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "paragraph")).filter("pos is not null")
    given = F.when((F.col("doc_id") + F.col("pos")) % 5 == 0, F.substring("paragraph", 2, 10**9)).otherwise(F.col("paragraph"))
    cuts = boundaries.from_units(F.col("paragraph"), F.regexp_extract_all(given, F.lit("([^ ]+ *)"), F.lit(1)))
    return rows.select("doc_id", "pos", F.to_json(cuts).alias("boundaries"))


@query("c20_aligned", """WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS paragraph FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, paragraph, min_by(length(paragraph), pos) FILTER (WHERE pos % 3 <> 0) AS cut FROM l GROUP BY ALL)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(cut AS INTEGER) AS cut FROM l JOIN k USING (doc_id, paragraph)""")
def c20_aligned(spark, sf_dir):
    """C20: cut lists of some lines, on all lines of equal text."""
    lines = A.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "paragraph"))
    received = lines.withColumn("boundaries", F.when(F.col("pos") % 3 != 0, F.array(F.length("paragraph"))))
    return boundaries.aligned(received, lines).select("doc_id", "pos", F.get("boundaries", F.lit(0)).alias("cut"))


#: Parts of speech, their details and base forms: one for every rule of phrases, and some that start one.
KINDS = [("名詞", "", "x"), ("助詞", "格助詞", "x"), ("動詞", "自立", "x"), ("接頭詞", "", "x"), ("助動詞", "", "x"), ("記号", "括弧開", "x"), ("記号", "読点", "x"), ("名詞", "接尾", "x"), ("動詞", "非自立", "x"), ("動詞", "自立", "する"), ("形容詞", "", "x")]


@query("c11_phrases", f"""WITH w AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS surface FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM documents)),
m AS (SELECT *, {", ".join(f"{[k[i] for k in KINDS]}[CAST((length(surface) * 3 + pos) % {len(KINDS)} AS INT) + 1] AS {name}" for i, name in enumerate(("p1", "p2", "base")))} FROM w),
s AS (SELECT *, lag(p1) OVER (PARTITION BY doc_id ORDER BY pos) AS q1, lag(p2) OVER (PARTITION BY doc_id ORDER BY pos) AS q2 FROM m),
t AS (SELECT *, CASE WHEN q1 IS NULL THEN 1 WHEN q1 = '接頭詞' THEN 0 WHEN q1 = '記号' AND q2 = '括弧開' THEN 0 WHEN p1 IN ('助詞', '助動詞') THEN 0 WHEN p1 = '記号' AND p2 <> '括弧開' THEN 0
  WHEN p2 IN ('非自立', '接尾') THEN 0 WHEN p1 = '動詞' AND base = 'する' THEN 0 WHEN p1 = '名詞' AND q1 = '名詞' THEN 0 ELSE 1 END AS starts FROM s),
f AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS phrase FROM t)
SELECT doc_id, 0 AS sentence_index, CAST(phrase AS INTEGER) AS phrase, string_agg(surface, '' ORDER BY pos) AS text, CAST(min(pos) AS INTEGER) AS "start" FROM f GROUP BY doc_id, phrase""")
def c11_phrases(spark, sf_dir):
    """C11: phrases of a morpheme table; here words with a part of speech by their length and place, so that every rule has its rows."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = parted(A.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(words).alias("pos", "surface"))
    kind = F.element_at(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(k, ("pos1", "pos2", "base_form"), strict=True)]) for k in KINDS]), ((F.length("surface") * 3 + F.col("pos")) % len(KINDS) + 1).cast("int"))
    return segment.phrases(rows.withColumn("kind", kind).select("doc_id", F.lit(0).alias("sentence_index"), "pos", "surface", "kind.*", F.col("pos").alias("start")))


@query("c10_brackets", """WITH w AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS s FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM documents)),
m AS (SELECT doc_id, pos, CASE pos % 4 WHEN 1 THEN '「' || s WHEN 2 THEN s || '」' ELSE s END AS s, sum(length(s) + 1 + CASE WHEN pos % 4 IN (1, 2) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w),
n AS (SELECT *, lag(s) OVER o AS prev, lead(s) OVER o AS next, upto - length(s) - 1 AS start FROM m WINDOW o AS (PARTITION BY doc_id, pos // 12 ORDER BY pos)),
j AS (SELECT *, pos % 4 = 1 AND next IS NOT NULL AND length(s) + length(next) <= 15 AS takes, pos % 4 = 2 AND prev IS NOT NULL AND length(s) + length(prev) <= 15 AS taken FROM n)
SELECT doc_id, CAST(pos // 12 AS INTEGER) AS sentence_index, CAST(row_number() OVER (PARTITION BY doc_id, pos // 12 ORDER BY pos) - 1 AS INTEGER) AS phrase, CASE WHEN takes THEN s || ' ' || next ELSE s END AS text, CAST(start AS INTEGER) AS "start" FROM j WHERE NOT taken""")
def c10_brackets(spark, sf_dir):
    """Phrases joined by brackets; here words, of which two in four share a pair of brackets, twelve to a sentence."""
    words = F.regexp_extract_all("text", F.lit(r"\S++"), F.lit(0))
    # Outer, as Spark would else cut the words once more to see whether there are any.
    rows = parted(A.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode_outer(words).alias("pos", "s")).filter("s is not null")
    rows = rows.withColumn("s", F.when(F.col("pos") % 4 == 1, F.concat(F.lit("「"), "s")).when(F.col("pos") % 4 == 2, F.concat("s", F.lit("」"))).otherwise(F.col("s")))
    start = F.sum(F.length("s") + 1).over(W.partitionBy("doc_id").orderBy("pos")) - F.length("s") - 1
    return segment.joined_phrases(rows.select("doc_id", F.floor(F.col("pos") / 12).cast("int").alias("sentence_index"), F.col("pos").alias("phrase"), F.col("s").alias("text"), start.cast("int").alias("start")))


@query("c8_units")
def c8_units(spark, sf_dir):
    """Units of Japanese texts (the documents in other letters) by the built-in phrase starts and the rules of joining."""
    rows = A.table(spark, sf_dir, "documents").select("doc_id", F.translate("text", LATIN, KANA).alias("text"))
    return segment.units(rows).select("doc_id", "unit_index", "sentence_index", "text", "start", "end", "language", "pause")


# --- pages ---------------------------------------------------------------------------------------


def _content(x: str) -> str:
    """Text with a line per paragraph of markup as plain as the given pages'."""
    for tag in sorted(html.SKIPPED):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)</?({'|'.join(sorted(html.BLOCKS | {'br', 'pre'}))})\\b[^>]*>', chr(10), 'g')"
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"


#: The references of html.entities(): the names, those that need no semicolon, and numbers.
_NAMED = {f"&{k};": html5[f"{k};"] for k in name2codepoint} | {f"&{k}": html5[k] for k in html.LEGACY}
_NAMES = f"MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v.replace(chr(39), chr(39) * 2)}{chr(39)}' for k, v in _NAMED.items())}}}"
_WINDOWS = f"MAP {{{', '.join(f'{k}: chr({ord(v)})' for k, v in html.WINDOWS.items())}}}"


def _entities(x: str) -> str:
    number = "CASE WHEN lower(e[3]) = 'x' THEN coalesce(TRY_CAST('0x' || e[4:] AS BIGINT), 1114112) ELSE coalesce(TRY_CAST(e[3:] AS BIGINT), 1114112) END"
    number = number.replace("e[4:]", "rtrim(e[4:], ';')").replace("e[3:]", "rtrim(e[3:], ';')")
    char = (
        "CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n = 13 THEN chr(13) "
        f"WHEN n BETWEEN 128 AND 159 THEN {_WINDOWS}[n] WHEN n < 9 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(CAST(n AS INTEGER)) END"
    )
    told = f"CASE WHEN starts_with(e, '&#') AND length(e) > 2 THEN list_transform([{number}], lambda n: {char})[1] ELSE coalesce({_NAMES}[e], e) END"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '{html._ENTITY}|[^&]+|&'), lambda e: {told}), '')"


def _paragraphs(content: str) -> str:
    return f"list_filter(list_transform(string_split({_entities(_content(content))}, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '')"


_PARAGRAPHS = _paragraphs("regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1)")
_WHOLE = _paragraphs("regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<title[^>]*>.*?</title\\s*>', '', 'g')")


@query("a16_paragraphs", f"SELECT page_id, CAST(unnest(range(len(ps))) AS INTEGER) AS pos, unnest(ps) AS paragraph FROM (SELECT page_id, {_PARAGRAPHS} AS ps FROM pages)")
def a16_paragraphs(spark, sf_dir):
    """Paragraphs of the main content."""
    return html.paragraphs(A.table(spark, sf_dir, "pages"))


_ARTICLES = f"""SELECT page_id, title, lang, CASE WHEN body <> '' THEN CASE WHEN title <> '' AND NOT starts_with(title, string_split(body, chr(10))[1]) THEN title || chr(10) || chr(10) || body ELSE body END END AS text,
  CASE WHEN body = '' THEN 'unextractable' END AS reason FROM (SELECT page_id, trim({_entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)")}) AS title,
  nullif(regexp_extract(html, '(?is)<html\\b[^>]*\\blang=["'']?([^"''\\s>]+)', 1), '') AS lang, array_to_string({_PARAGRAPHS}, chr(10) || chr(10)) AS body FROM pages)"""


@query("a22_articles", _ARTICLES)
def a22_articles(spark, sf_dir):
    """Articles with title and language."""
    return html.articles(A.table(spark, sf_dir, "pages")).drop("site_name")


@query("a16_parsed", f"SELECT page_id, CAST(unnest(range(len(ps))) AS INTEGER) AS pos, unnest(ps) AS paragraph FROM (SELECT page_id, {_WHOLE} AS ps FROM pages)")
def a16_parsed(spark, sf_dir):
    """Paragraphs of whole pages."""
    return html.paragraphs(A.table(spark, sf_dir, "pages"), main=False)


_HOST = "lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
_PAGES = f"""pg AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS canonical_url, {_HOST} AS host, regexp_extract(url, '://([^/?#]*)', 1) AS auth,
  CASE WHEN starts_with(regexp_extract(regexp_replace(url, '#.*$', ''), '://[^/?#]*(.*)$', 1), '/') THEN '' ELSE '/' END || regexp_extract(regexp_replace(url, '#.*$', ''), '://[^/?#]*(.*)$', 1) AS path FROM pages),
pr AS (SELECT *, CASE WHEN length(url) > 2048 OR NOT regexp_matches(url, '(?i)^https?:') OR host = '' THEN 'invalid-url'
  WHEN contains(auth, '@') OR regexp_extract(auth, ':([0-9]+)$', 1) NOT IN ('', '80', '443') OR NOT contains(host, '.')
    OR regexp_matches(host, '(^|\\.)(localhost|local|test|invalid|internal|home\\.arpa|lan|intranet|corp|localdomain)$') THEN 'blocked-url' END AS reason FROM pg)"""


@query("b1_urls", f"WITH {_PAGES} SELECT page_id, canonical_url, host, path, reason FROM pr")
def b1_urls(spark, sf_dir):
    """Canonical URL, host, path and reason of every page."""
    return A.pages(spark, sf_dir).drop("url")


_RULES = f"""{_PAGES}, rules(class, allow, pattern) AS (VALUES (0, false, '/en/'), (0, true, '/en/*5'), (1, false, '/*.html$'), (1, true, '/fr'), (2, false, '/de'), (2, true, '/de'), (2, false, '/*ref=')),
hit AS (SELECT page_id, max_by(allow, length(pattern) * 2 + allow::INT) AS allow FROM pr JOIN rules ON class = length(host) % 3
  AND regexp_matches(path, '^' || replace(replace(replace(replace(pattern, '.', '\\.'), '?', '\\?'), '=', '\\='), '*', '.*')) GROUP BY page_id),
ok AS (SELECT pr.*, coalesce(allow, true) AS allowed FROM pr LEFT JOIN hit USING (page_id))"""


def _allowed(spark, sf_dir):
    pages = A.pages(spark, sf_dir).select("page_id", "host", "path", "reason")
    return crawl.allowed(pages, crawl.robots_rules(A.robots_files(spark, sf_dir), "readbot"))


@query("b12_robots", f"WITH {_RULES} SELECT page_id, host, allowed FROM ok")
def b12_robots(spark, sf_dir):
    """Robots files to rules to a verdict per page."""
    return _allowed(spark, sf_dir).select("page_id", "host", "allowed")


@query("b14_redirects", f"""WITH RECURSIVE {_RULES}, r AS (SELECT a.canonical_url AS from_url, min(b.canonical_url) AS to_url FROM pr a JOIN pr b ON b.page_id = a.page_id + 1 WHERE a.page_id % 7 < 3 GROUP BY 1),
v AS (SELECT canonical_url, min(coalesce(reason, CASE WHEN NOT allowed THEN 'robots-disallowed' END)) AS why FROM ok GROUP BY 1),
f AS (SELECT page_id, canonical_url AS loc, 0 AS hops FROM pr UNION ALL SELECT page_id, r.to_url, hops + 1 FROM f JOIN v ON canonical_url = loc AND why IS NULL JOIN r ON loc = from_url WHERE hops < 6)
SELECT page_id, loc AS final_url, hops, CASE WHEN hops > 5 THEN 'page-unavailable' ELSE why END AS reason FROM f JOIN v ON canonical_url = loc QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY hops DESC) = 1""")
def b14_redirects(spark, sf_dir):
    """Pages after their redirects, the robots rules tested at every hop."""
    pages = A.table(spark, sf_dir, "pages").select("page_id", "url")
    return crawl.follow(pages, A.redirects(spark, sf_dir), crawl.robots_rules(A.robots_files(spark, sf_dir), "readbot"))


@query("w2_plan", f"""WITH RECURSIVE {_RULES}, r AS (SELECT a.canonical_url AS from_url, min(b.canonical_url) AS to_url FROM pr a JOIN pr b ON b.page_id = a.page_id + 1 WHERE a.page_id % 7 < 3 GROUP BY 1),
v AS (SELECT canonical_url, min(page_id) AS target, min(CASE WHEN reason IS NOT NULL THEN reason WHEN length(host) % 5 = 1 THEN 'page-unavailable' WHEN length(host) % 10 = 3 THEN 'blocked-url' WHEN length(host) % 5 <> 0 AND NOT allowed THEN 'robots-disallowed' END) AS why FROM ok GROUP BY 1),
rq AS (SELECT page_id, canonical_url, row_number() OVER (PARTITION BY page_id % 7, page_id // 60 ORDER BY page_id) > 8 AS limited FROM pr),
f AS (SELECT page_id, canonical_url AS loc, 0 AS hops FROM rq WHERE NOT limited UNION ALL SELECT page_id, r.to_url, hops + 1 FROM f JOIN v ON canonical_url = loc AND why IS NULL JOIN r ON loc = from_url WHERE hops < 6),
g AS (SELECT page_id, loc, hops, target, why FROM f JOIN v ON canonical_url = loc QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY hops DESC) = 1),
art AS ({_ARTICLES}),
h AS (SELECT rq.page_id, loc, art.text, CASE WHEN limited THEN 'rate-limited' WHEN hops > 5 THEN 'page-unavailable' WHEN why IS NOT NULL THEN why WHEN target % 11 < 2 THEN 'page-unavailable'
  WHEN target % 13 = 0 THEN 'unextractable' WHEN strlen(html) > 5242880 THEN 'page-too-large' ELSE art.reason END AS reason
  FROM rq LEFT JOIN g USING (page_id) LEFT JOIN pages ON pages.page_id = target LEFT JOIN art ON art.page_id = target),
documents AS (SELECT page_id AS doc_id, text FROM h WHERE reason IS NULL), {_TIMED}
SELECT h.page_id, loc AS final_url, reason, count(doc_id) AS units, CAST(coalesce(sum(ms), 0) AS BIGINT) AS total_ms FROM h LEFT JOIN timed ON doc_id = h.page_id GROUP BY ALL""")
def w2_plan(spark, sf_dir):
    """Pages to reading plans, with one reason per page: rate limit, URL, redirects with robots (behind redirects of their own) at every hop, response, content."""
    pages = A.table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 7).alias("key"), F.timestamp_seconds("page_id").alias("ts"))
    asked = crawl.rate_limited(pages.withColumnRenamed("page_id", "request_id"), 8).select(F.col("request_id").alias("page_id"), "url", "limited")
    log, hops = A.robots_log(spark, sf_dir)
    log = written(crawl.robots_state(crawl.robots_fetched(A.robots_files(spark, sf_dir), log, hops)))
    rules = crawl.robots_rules(log.filter("robots_text is not null"), "readbot")
    found = crawl.follow(asked.filter("not limited").select("page_id", "url"), A.redirects(spark, sf_dir), rules, closed=log.select("host", "reason"))
    got = A.responses(spark, sf_dir).withColumn("_why", crawl.response_reason(F.col("status"), F.col("content_type"), F.col("size")))
    got = got.select("url", F.col("page_id").alias("_target"), "_why")
    found = found.join(got, F.col("final_url") == F.col("url"), "left").select("page_id", "final_url", F.coalesce("reason", "_why").alias("reason"), "_target")
    needed = found.filter("reason is null").select(F.col("_target").alias("page_id")).distinct()
    texts = html.articles(A.table(spark, sf_dir, "pages").join(needed, "page_id", "left_semi")).select(F.col("page_id").alias("_target"), "text", F.col("reason").alias("_content"))
    read = found.join(texts, "_target", "left").select("page_id", "final_url", F.coalesce("reason", "_content").alias("reason"), "text")
    plans = timing.plan_documents(read.filter("reason is null").select(F.col("page_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("page_id"), "units", "total_ms")
    rows = asked.select("page_id", "limited").join(read.drop("text"), "page_id", "left").join(plans, "page_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("page_id", "final_url", F.when(F.col("limited"), "rate-limited").otherwise(F.col("reason")).alias("reason"), none("units"), none("total_ms"))


@query("b13_robots_files", f"""WITH {_PAGES}, h AS (SELECT DISTINCT host, length(host) AS n FROM pr WHERE reason IS NULL)
SELECT host, CASE n % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'html' ELSE 'de' END AS file, CASE WHEN n % 5 = 1 THEN 'page-unavailable' WHEN n % 10 = 3 THEN 'blocked-url' END AS reason, n % 5 > 1 AND n % 10 <> 3 AS has_rules FROM h""")
def b13_robots_files(spark, sf_dir):
    """Robots files behind their redirects, or why a host has none."""
    log, hops = A.robots_log(spark, sf_dir)
    files = A.robots_files(spark, sf_dir)
    found = crawl.robots_state(crawl.robots_fetched(files, log, hops)).withColumnRenamed("robots_text", "got")
    own = F.when(F.col("robots_text").contains("/en/"), "en").when(F.col("robots_text").contains("html"), "html").otherwise("de")
    return files.join(found, "host").select("host", own.alias("file"), "reason", (F.col("got") == F.col("robots_text")).alias("has_rules")).na.fill(False)


@query("b15_responses", """SELECT page_id, CASE WHEN CASE page_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END <> 200 THEN 'page-unavailable' WHEN page_id % 13 = 0 THEN 'unextractable' WHEN strlen(html) > 5242880 THEN 'page-too-large' END AS reason FROM pages""")
def b15_responses(spark, sf_dir):
    """The first rule that a fetched page fails."""
    status = F.when(F.col("page_id") % 11 == 0, 404).when(F.col("page_id") % 11 == 1, 503).otherwise(200)
    kind = F.when(F.col("page_id") % 13 == 0, "application/pdf").otherwise("text/html; charset=utf-8")
    return A.table(spark, sf_dir, "pages").select("page_id", crawl.response_reason(status, kind, F.octet_length("html")).alias("reason"))


@query("b18_rate_limit", "SELECT event_id AS request_id, row_number() OVER (PARTITION BY user_id % 10, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) > 1 AS limited FROM events")
def b18_rate_limit(spark, sf_dir):
    """One request an hour and key."""
    rows = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 10).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return crawl.rate_limited(rows, 1, 3600).select("request_id", "limited")


@query("b19_two_levels", """WITH a AS (SELECT *, epoch_us(ts) // 3600000000 AS b, row_number() OVER (PARTITION BY user_id % 10, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT event_id, row_number() OVER (PARTITION BY b ORDER BY ts, event_id) AS m FROM a WHERE n <= 2 AND event_type <> 'view')
SELECT a.event_id AS request_id, coalesce(m <= 3, false) AS granted FROM a LEFT JOIN g USING (event_id)""")
def b19_two_levels(spark, sf_dir):
    """Two an hour and key, then three an hour over all that have work."""
    rows = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 10).alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "view").alias("has_work"))
    return crawl.two_level_limit(rows, 2, 3, 3600).select("request_id", "granted")


@query("b20_report", f"""WITH {_RULES} SELECT host, reason, count(*) AS pages, CAST(grouping(host, reason) AS BIGINT) AS level
FROM (SELECT host, coalesce(reason, CASE WHEN NOT allowed THEN 'robots-disallowed' ELSE 'ok' END) AS reason FROM ok) GROUP BY ROLLUP (host, reason)""")
def b20_report(spark, sf_dir):
    """Pages per host and reason, with totals."""
    rows = _allowed(spark, sf_dir).withColumn("reason", F.coalesce("reason", F.when(~F.col("allowed"), "robots-disallowed")))
    return crawl.report(rows)


@query("a15_outcomes", f"""WITH o AS (SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM ({_ARTICLES}) GROUP BY 1)
SELECT reason, n, CASE reason WHEN 'ok' THEN 200 WHEN 'unextractable' THEN 422 END AS status FROM o""")
def a15_outcomes(spark, sf_dir):
    """Outcomes with their HTTP status, by a lookup of fixed size."""
    status = spark.createDataFrame([("ok", 200), *crawl.STATUSES.items()], "reason string, status int")
    found = html.articles(A.table(spark, sf_dir, "pages")).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))
    return found.join(F.broadcast(status), "reason", "left")


# --- reading activity ----------------------------------------------------------------------------

_EV = "ev AS (SELECT user_id AS reader, ts, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms, event_id AS seq, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"
_FIN = _EV + ", fin AS (SELECT reader, CAST(k AS VARCHAR) AS text_hash, ts AS finished_at, seq, CAST(k AS BIGINT) AS ja_characters, CAST(floor(value) AS BIGINT) AS en_words, CAST(floor(value * 1000) AS BIGINT) AS played_ms FROM ev WHERE event_type = 'purchase')"
_DAYS = _FIN + ", days AS (SELECT reader, CAST(finished_at AS DATE) AS date, count(*) AS finishes, CAST(sum(ja_characters) AS BIGINT) AS ja_characters, CAST(sum(en_words) AS BIGINT) AS en_words, CAST(sum(played_ms) AS BIGINT) AS played_ms FROM fin GROUP BY ALL)"
AS_OF = "2024-01-30"


@query("e2_played", f"""WITH {_EV}, a AS (SELECT reader, k, ts_ms, seq, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS on_ FROM ev WHERE event_type IN ('view', 'error', 'purchase')),
c AS (SELECT *, coalesce(lag(on_) OVER w, 0) AS was FROM a WINDOW w AS (PARTITION BY reader, k ORDER BY ts_ms, seq)),
d AS (SELECT *, lead(ts_ms) OVER (PARTITION BY reader, k ORDER BY ts_ms, seq) AS until FROM c WHERE on_ <> was)
SELECT reader, CAST(k AS VARCHAR) AS text_hash, CAST(sum(CASE WHEN on_ = 1 THEN coalesce(until - ts_ms, 0) ELSE 0 END) AS BIGINT) AS played_ms FROM d GROUP BY ALL""")
def e2_played(spark, sf_dir):
    return activity.played(A.actions(spark, sf_dir))


def _spoken(spark, sf_dir):
    """Units of the documents that events name by k."""
    named = A.events(spark, sf_dir).select(F.col("k").cast("long").alias("doc_id")).distinct()
    docs = A.table(spark, sf_dir, "documents").join(named, "doc_id", "left_semi")
    return segment.units(docs).withColumn("text_hash", F.col("doc_id").cast("string"))


@query("e3_amounts", f"""WITH {_UNITS}, {_EV}, sp AS (SELECT reader, ts_ms, seq, 300.0 + 25 * (k % 5) AS wpm FROM ev WHERE event_type = 'signup'),
adv AS (SELECT reader, k, ts_ms FROM ev WHERE event_type = 'click'),
last AS (SELECT reader, ts_ms, max_by(wpm, seq) AS wpm FROM sp GROUP BY ALL),
j AS (SELECT a.reader, a.k, u.pause, coalesce(s.wpm, 300.0) AS wpm FROM adv a ASOF LEFT JOIN last s ON a.reader = s.reader AND a.ts_ms >= s.ts_ms JOIN units u ON u.doc_id = a.k AND u.unit_index = a.k)
SELECT reader, CAST(k AS VARCHAR) AS text_hash, CAST(0 AS BIGINT) AS ja_characters, count(*) AS en_words, CAST(0 AS BIGINT) AS ja_ms,
  CAST(sum(floor(60000.0::DOUBLE / wpm * (1 + CASE pause WHEN 'none' THEN 0 WHEN 'comma' THEN 0.5 WHEN 'sentence' THEN 1 ELSE 2 END) + 0.5)) AS BIGINT) AS en_ms FROM j GROUP BY ALL""")
def e3_amounts(spark, sf_dir):
    """Units read, at the speed then in force."""
    ev = A.events(spark, sf_dir)
    speeds = ev.filter("event_type = 'signup'").groupBy("reader", "ts_ms").agg(F.max_by("k", "seq").alias("k")).select("reader", "ts_ms", F.lit(600.0).alias("ja_cpm"), (F.lit(300.0) + F.col("k") % 5 * 25).alias("en_wpm"))
    advances = ev.filter("event_type = 'click'").select("reader", F.col("k").cast("string").alias("text_hash"), F.col("k").alias("unit_index"), "ts_ms")
    return activity.amounts(advances, activity.unit_table(_spoken(spark, sf_dir)), speeds)


@query("e5_speed", f"""WITH {_FIN} SELECT seq, CASE WHEN ja_characters > 0 AND played_ms > 0 THEN CAST(floor(ja_characters::DOUBLE * 60000 * (ja_characters * 100 + en_words * 200) / (played_ms::DOUBLE * (ja_characters * 100)) + 0.5) AS BIGINT) END AS ja_cpm,
  CASE WHEN en_words > 0 AND played_ms > 0 THEN CAST(floor(en_words::DOUBLE * 60000 * (ja_characters * 100 + en_words * 200) / (played_ms::DOUBLE * (en_words * 200)) + 0.5) AS BIGINT) END AS en_wpm FROM fin""")
def e5_speed(spark, sf_dir):
    rows = A.finishes(spark, sf_dir).withColumns({"ja_ms": F.col("ja_characters") * 100, "en_ms": F.col("en_words") * 200})
    total = F.col("ja_ms") + F.col("en_ms")
    of = lambda n, ms: activity.effective_speed(F.col(n), F.col(ms), total, F.col("played_ms"))
    return rows.select("seq", of("ja_characters", "ja_ms").alias("ja_cpm"), of("en_words", "en_ms").alias("en_wpm"))


@query("e6_finishes", f"WITH {_FIN} SELECT reader, date_trunc('hour', finished_at) AS finished_at, min(seq) AS seq FROM fin GROUP BY ALL")
def e6_finishes(spark, sf_dir):
    """One record per reader and finish time (here to the hour), the first kept."""
    return activity.distinct_finishes(A.finishes(spark, sf_dir).withColumn("finished_at", F.date_trunc("hour", "finished_at"))).select("reader", "finished_at", "seq")


@query("e7_daily", f"WITH {_DAYS} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM days QUALIFY row_number() OVER (PARTITION BY reader ORDER BY date DESC) <= 14")
def e7_daily(spark, sf_dir):
    return activity.daily_totals(A.finishes(spark, sf_dir), shown=activity.SHOWN_DAYS).withColumn("date", F.col("date").cast("string"))


#: Zones of readers by their number: whole and half hours, both sides of the date line, with and without daylight-saving time.
ZONES = ["UTC", "Asia/Tokyo", "America/New_York", "Pacific/Kiritimati", "Europe/Berlin", "Pacific/Pago_Pago", "Australia/Adelaide", None]


@query("e7_zones", f"""WITH {_FIN}, z AS (SELECT *, timezone(CASE reader % {len(ZONES)} {" ".join(f"WHEN {i} THEN '{z or 'UTC'}'" for i, z in enumerate(ZONES))} END, timezone('UTC', finished_at + to_days(CAST(seq % 300 AS INTEGER)))) AS wall FROM fin)
SELECT reader, CAST(CAST(wall AS DATE) AS VARCHAR) AS date, count(*) AS finishes, CAST(sum(ja_characters) AS BIGINT) AS ja_characters, CAST(sum(en_words) AS BIGINT) AS en_words, CAST(sum(played_ms) AS BIGINT) AS played_ms FROM z GROUP BY ALL""")
def e7_zones(spark, sf_dir):
    """Daily totals by the dates of each reader's zone, over most of a year with its changes of the clock."""
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.col("reader") % len(ZONES) + 1).cast("int"))
    rows = A.finishes(spark, sf_dir).withColumn("finished_at", F.col("finished_at").cast("timestamp") + F.make_dt_interval((F.col("seq") % 300).cast("int"))).withColumn("zone", zone)
    return activity.daily_totals(rows, F.col("zone")).withColumn("date", F.col("date").cast("string"))


@query("e8_week", f"""WITH {_DAYS} SELECT reader, {", ".join(f"CAST(sum(CASE WHEN date BETWEEN DATE '{AS_OF}' - 6 AND DATE '{AS_OF}' THEN {c} ELSE 0 END) AS BIGINT) AS week_{c}, CAST(sum({c}) AS BIGINT) AS all_{c}" for c in ("ja_characters", "en_words", "played_ms"))} FROM days GROUP BY reader""")
def e8_week(spark, sf_dir):
    return activity.week_and_all(activity.daily_totals(A.finishes(spark, sf_dir)), F.lit(AS_OF).cast("date"))


_ENGLISH = f"""{_EV}, rd AS (SELECT reader, CAST(ts AS DATE) AS date, bool_or(k % 3 <> 0) AS english_read FROM ev WHERE event_type = 'click' GROUP BY ALL),
vis AS (SELECT *, (event_type = 'signup') AS v, coalesce(lag(event_type = 'signup') OVER (PARTITION BY reader ORDER BY ts, seq), false) AS was FROM ev),
tr AS (SELECT reader, CAST(ts AS DATE) AS date, count(*) AS translations FROM vis WHERE v AND NOT was GROUP BY ALL),
ed AS (SELECT coalesce(rd.reader, tr.reader) AS reader, coalesce(rd.date, tr.date) AS date, coalesce(english_read, false) AS english_read, coalesce(translations, 0) AS translations FROM rd FULL JOIN tr ON rd.reader = tr.reader AND rd.date = tr.date)"""


def _english(spark, sf_dir):
    ev = A.events(spark, sf_dir)
    ends = ev.filter("event_type = 'click'").select("reader", "ts", F.when(F.col("k") % 3 == 0, "ja").otherwise("en").alias("language"))
    return activity.english_days(ends, ev.select("reader", "ts", "seq", (F.col("event_type") == "signup").alias("visible")))


@query("e10_english_days", f"WITH {_ENGLISH} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM ed")
def e10_english_days(spark, sf_dir):
    """English reading days and shown translations."""
    return _english(spark, sf_dir).withColumn("date", F.col("date").cast("string"))


@query("e11_english_week", f"WITH {_ENGLISH} SELECT reader, count(*) AS english_days, count(*) FILTER (WHERE translations > 0) AS translated_days FROM ed WHERE english_read AND date BETWEEN DATE '{AS_OF}' - 6 AND DATE '{AS_OF}' GROUP BY reader")
def e11_english_week(spark, sf_dir):
    return activity.english_summary(_english(spark, sf_dir), F.lit(AS_OF).cast("date"))


_POS = f"{_EV}, ps AS (SELECT reader, CAST(k AS VARCHAR) AS text_hash, max_by(k, seq) AS unit_index, 100 AS unit_count, max(ts) AS saved_at, max(seq) AS seq FROM ev WHERE event_type = 'click' GROUP BY reader, k)"


@query("e16_positions", f"WITH {_POS} SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY reader ORDER BY saved_at DESC, seq DESC) <= 10")
def e16_positions(spark, sf_dir):
    return activity.upsert_positions(A.positions(spark, sf_dir), 10)


@query("e17_boundaries", f"""WITH {_POS}, b AS (SELECT reader, CAST(k AS VARCHAR) AS text_hash, max(ts) AS saved_at FROM ev WHERE event_type = 'view' GROUP BY reader, k)
SELECT b.reader, b.text_hash, b.saved_at FROM b LEFT JOIN ps USING (reader, text_hash) QUALIFY row_number() OVER (PARTITION BY b.reader ORDER BY (ps.seq IS NOT NULL) DESC, b.saved_at DESC, b.text_hash) <= 5""")
def e17_boundaries(spark, sf_dir):
    saved = A.events(spark, sf_dir).filter("event_type = 'view'").select("reader", F.col("k").cast("string").alias("text_hash"), F.array(F.col("k")).alias("boundaries"), F.col("ts").alias("saved_at"), F.lit(False).alias("just_written"))
    return activity.upsert_boundaries(saved, A.positions(spark, sf_dir), 5).select("reader", "text_hash", "saved_at")


@query("e18_resume", f"""WITH {_POS}, c AS (SELECT CAST(doc_id AS VARCHAR) AS text_hash, 50 + doc_id % 100 AS units FROM documents)
SELECT reader, text_hash, CASE WHEN unit_count = units AND unit_index < units THEN unit_index ELSE 0 END AS unit_index FROM ps JOIN c USING (text_hash)""")
def e18_resume(spark, sf_dir):
    counts = A.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("text_hash"), (F.lit(50) + F.col("doc_id") % 100).alias("units"))
    return activity.resume(activity.upsert_positions(A.positions(spark, sf_dir), 1_000_000), counts)


@query("e20_open", f"WITH {_POS}, f AS (SELECT reader, CAST(k AS VARCHAR) AS text_hash, max(ts) AS finished FROM ev WHERE event_type = 'purchase' GROUP BY reader, k) SELECT reader, text_hash, saved_at FROM ps WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.reader = ps.reader AND f.text_hash = ps.text_hash AND finished >= saved_at)")
def e20_open(spark, sf_dir):
    """Positions that no later finish of the text removed."""
    return activity.open_positions(activity.upsert_positions(A.positions(spark, sf_dir), 1_000_000), A.finishes(spark, sf_dir)).select("reader", "text_hash", "saved_at")


@query("e21_weekly", f"""WITH {_ENGLISH}, op AS (SELECT DISTINCT reader, CAST(ts AS DATE) AS date FROM ev WHERE event_type = 'view'),
fn AS (SELECT reader, CAST(ts AS DATE) AS date, sum(k) * 100 AS ja FROM ev WHERE event_type = 'purchase' GROUP BY ALL),
al AS (SELECT reader, date FROM op UNION SELECT reader, date FROM fn UNION SELECT reader, date FROM ed),
d AS (SELECT al.reader, al.date, op.date IS NOT NULL AS opened, coalesce(ja, 0) AS ja, coalesce(english_read, false) AS er, coalesce(translations, 0) AS tr
  FROM al LEFT JOIN op USING (reader, date) LEFT JOIN fn USING (reader, date) LEFT JOIN ed USING (reader, date)),
s AS (SELECT reader, CAST(date_trunc('week', date) AS DATE) AS week, count(*) FILTER (WHERE opened) AS days_opened, sum(ja) AS ja_characters, count(*) FILTER (WHERE er) AS english_days, count(*) FILTER (WHERE er AND tr > 0) AS translated_days FROM d GROUP BY ALL),
sp AS (SELECT reader, CAST(unnest(range(min(week), max(week) + INTERVAL 1 DAY, INTERVAL 7 DAY)) AS DATE) AS week FROM s GROUP BY reader),
r AS (SELECT sp.reader, sp.week, coalesce(days_opened, 0) AS days_opened, CAST(coalesce(ja_characters, 0) AS BIGINT) AS ja_characters, coalesce(english_days, 0) AS english_days, coalesce(translated_days, 0) AS translated_days FROM sp LEFT JOIN s USING (reader, week)),
l AS (SELECT *, lag(days_opened < 2) OVER w AS a, lag(ja_characters < 10000) OVER w AS b, lag(english_days = 0) OVER w AS c FROM r WINDOW w AS (PARTITION BY reader ORDER BY week))
SELECT reader, CAST(week AS VARCHAR) AS week, days_opened, ja_characters, english_days, translated_days, CASE WHEN (days_opened < 2 AND coalesce(a, false)) OR (ja_characters < 10000 AND coalesce(b, false)) OR (english_days = 0 AND coalesce(c, false)) THEN 'stop'
  WHEN days_opened >= 4 AND ja_characters >= 50000 AND english_days > 0 AND translated_days >= english_days * 0.5 THEN 'continue' ELSE 'watch' END AS verdict FROM l""")
def e21_weekly(spark, sf_dir):
    """Events to days to weekly verdicts."""
    ev = A.events(spark, sf_dir)
    day = activity.local_date(F.col("ts")).alias("date")
    opened = ev.filter("event_type = 'view'").select("reader", day, F.lit(True).alias("opened")).distinct()
    read = ev.filter("event_type = 'purchase'").groupBy("reader", day).agg((F.sum("k") * 100).alias("ja_characters"))
    days = opened.join(read, ["reader", "date"], "full_outer").join(_english(spark, sf_dir), ["reader", "date"], "full_outer")
    return activity.weekly_verdict(days.na.fill(False, ["opened", "english_read"]).na.fill(0, ["ja_characters", "translations"])).withColumn("week", F.col("week").cast("string"))


@query("e23_translate", f"WITH {_UNITS}, {_EV} SELECT DISTINCT reader, CAST(k AS VARCHAR) AS text_hash, sentence_index FROM ev JOIN units ON doc_id = k AND unit_index = k WHERE event_type = 'signup'")
def e23_translate(spark, sf_dir):
    shown = A.events(spark, sf_dir).filter("event_type = 'signup'").select("reader", F.col("k").cast("string").alias("text_hash"), F.col("k").alias("unit_index"))
    return activity.to_translate(shown, _spoken(spark, sf_dir))


@query("e22_translator", f"""WITH RECURSIVE {_EV}, e AS (SELECT *, CASE event_type WHEN 'signup' THEN 'unavailable' WHEN 'view' THEN 'toggle' WHEN 'click' THEN 'created' WHEN 'error' THEN 'failed' ELSE 'available' END AS event,
  row_number() OVER (PARTITION BY reader ORDER BY ts, seq) AS n FROM ev),
f AS (SELECT reader, CAST(0 AS BIGINT) AS n, NULL::BIGINT AS seq, 'checking' AS status, false AS visible FROM e WHERE n = 1
  UNION ALL SELECT f.reader, e.n, e.seq,
    CASE WHEN status = 'checking' AND event IN ('available', 'unavailable') THEN event WHEN event = 'toggle' AND status IN ('available', 'failed') THEN 'creating'
      WHEN status = 'creating' AND event = 'created' THEN 'ready' WHEN status = 'creating' AND event = 'failed' THEN 'failed' ELSE status END,
    CASE WHEN event = 'toggle' AND status IN ('available', 'failed') THEN true WHEN event = 'toggle' AND status IN ('creating', 'ready') THEN NOT visible WHEN event = 'failed' AND status = 'creating' THEN false ELSE visible END
  FROM f JOIN e ON e.reader = f.reader AND e.n = f.n + 1)
SELECT reader, seq, status, visible, status = 'ready' AS ready FROM f WHERE n > 0""")
def e22_translator(spark, sf_dir):
    """The translator's state after each event of a reader; the twin goes event by event."""
    event = F.when(F.col("event_type") == "signup", "unavailable").when(F.col("event_type") == "view", "toggle").when(F.col("event_type") == "click", "created").when(F.col("event_type") == "error", "failed").otherwise("available")
    return activity.translator_states(A.events(spark, sf_dir).select("reader", "ts", "seq", event.alias("event"))).drop("ts")


@query("e24_speed", f"""WITH {_EV}, s AS (SELECT reader, 100.0 + 40 * k AS ja, 50.0 + 20 * k AS en, seq FROM ev WHERE event_type = 'signup'),
l AS (SELECT reader, max_by(ja, seq) AS ja, max_by(en, seq) AS en FROM s WHERE ja BETWEEN 100 AND 3000 AND en BETWEEN 50 AND 1500 GROUP BY reader)
SELECT DISTINCT reader, coalesce(ja, 600)::DOUBLE AS ja_cpm, coalesce(en, 300)::DOUBLE AS en_wpm FROM ev LEFT JOIN l USING (reader)""")
def e24_speed(spark, sf_dir):
    ev = A.events(spark, sf_dir)
    saved = ev.filter("event_type = 'signup'").select("reader", (F.lit(100.0) + F.col("k") * 40).alias("ja_cpm"), (F.lit(50.0) + F.col("k") * 20).alias("en_wpm"), F.col("seq").alias("saved_at"))
    return activity.current_speed(ev.select("reader").distinct(), saved)


@query("s4_sessions", f"""WITH {_EV}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY reader ORDER BY ts, seq)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY reader ORDER BY ts, seq) AS s FROM g)
SELECT reader, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM n GROUP BY reader, s""")
def s4_sessions(spark, sf_dir):
    return activity.sessions(A.events(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import rules  # noqa: F401  registers its queries

    return dict(Q)


def oracle_sql() -> dict[str, str]:
    from . import rules  # noqa: F401

    return dict(SQL)
