"""More queries with their SQL: single rules over values that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..operators import activity, boundaries, crawl, segment, timing
from ..operators.shared import parted
from ..sources import files, stores
from . import adapters as A
from .queries import _ENGLISH, _EV, _FIN, _JA, _TIMED, _UNITS, KANA, LATIN, _english, query

# --- texts ---------------------------------------------------------------------------------------

#: A head with a description of symbols, and a footer, as the notation has them.
_RULE = "-" * 30
_HEAD = f"題\n著者\n\n{_RULE}\n【テキスト中に現れる記号について】\n\n《》：ルビ\n（例）漢字《かんじ》\n{_RULE}\n\n\n\n"
_FOOT = "\n\n\n底本：「本」出版\n入力：人\nこのファイルは、インターネットの図書館、青空文庫で作られました。\n"


@query("a8_aozora", """WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[｜《》［］\\r]', '', 'g') AS b FROM documents),
u AS (SELECT doc_id, trim(regexp_replace('題' || repeat(chr(10), 1) || '著者' || repeat(chr(10), 5) || b || repeat(chr(10), 3), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM t)
SELECT doc_id, sha256(t) AS text_hash, CAST(length(t) AS BIGINT) AS chars FROM u""")
def a8_aozora(spark, sf_dir):
    """Every text in the Aozora Bunko notation (head, readings, nested and open notes, footer), read back as it was."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "[｜《》［］\r]", "")
    marked = F.concat(F.lit(_HEAD), F.regexp_replace(body, " ", "《よみ》 ｜［＃注［＃中］記］"), F.when(F.col("doc_id") % 3 == 0, "\n\n［＃" + "［深" * 12 + "］" * 5).otherwise(_FOOT))
    rows = parted(A.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.import_plain(marked).alias("t"))
    return rows.select("doc_id", T.text_hash(F.col("t")).alias("text_hash"), F.length("t").cast("long").alias("chars"))


@query("d3_seconds", f"WITH {_TIMED} SELECT doc_id, unit_index, round(60.0::DOUBLE / 1.0 * (1 + CASE pause WHEN 'none' THEN 0 WHEN 'comma' THEN 0.5 WHEN 'sentence' THEN 1 ELSE 2 END), 6) AS seconds FROM timed")
def d3_seconds(spark, sf_dir):
    """D3: display times without rounding, in seconds; a speed below 1 counts as 1."""
    shown = timing.display_ms(F.col("text"), F.col("language"), F.col("pause"), ja_cpm=0.0, en_wpm=0.5, rounding=False)
    return segment.units(A.table(spark, sf_dir, "documents")).select("doc_id", "unit_index", F.round(shown, 6).alias("seconds"))


@query("d11_amounts", """SELECT event_id, CASE WHEN s >= 3600 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm ' || s % 60 || 's' WHEN s >= 60 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s || 's' END AS played,
  CASE WHEN c > 0 AND w > 0 THEN format('{:,}', c) || ' characters, ' || format('{:,}', w) || ' words' WHEN w > 0 THEN format('{:,}', w) || ' words' ELSE format('{:,}', c) || ' characters' END AS amount
FROM (SELECT event_id, CAST(floor(event_id * 977 / 1000.0 + 0.5) AS BIGINT) AS s, event_id * 31 % 7000 AS c, event_id % 5 * 400 AS w FROM events)""")
def d11_amounts(spark, sf_dir):
    """Durations and amounts as texts."""
    rows = A.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 31 % 7000).alias("c"), (F.col("event_id") % 5 * 400).alias("w"))
    return rows.select("event_id", timing.played_text(F.col("event_id") * 977).alias("played"), timing.amount_text(F.col("c"), F.col("w")).alias("amount"))


@query("d10_steps", f"WITH {_UNITS}, n AS (SELECT doc_id, count(*) AS n FROM units GROUP BY doc_id) SELECT doc_id, unit_index, CAST(least(greatest(unit_index + (unit_index * 7 % 41 - 20), 0), n - 1) AS BIGINT) AS target FROM units JOIN n USING (doc_id)")
def d10_steps(spark, sf_dir):
    """Moves by units, kept within the text."""
    units = segment.units(A.table(spark, sf_dir, "documents")).select("doc_id", "unit_index")
    counted = units.withColumn("n", F.count("*").over(W.partitionBy("doc_id")))
    return counted.select("doc_id", "unit_index", timing.moved(F.col("unit_index"), F.col("unit_index") * 7 % 41 - 20, F.col("n")).cast("long").alias("target"))


_LINES = "SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"


@query("c18_answers", f"""WITH l AS ({_LINES}), w AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM l)
SELECT doc_id, pos, CASE WHEN pos % 4 <> 3 THEN len(ws) END AS units, CASE WHEN pos % 4 <> 3 THEN sha256(array_to_string(ws, '|')) END AS joined FROM w""")
def c18_answers(spark, sf_dir):
    """The units in a model's answers of either shape, with thoughts and fences; every fourth answer has none."""
    lines = A.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    said = F.to_json(F.struct(F.filter(F.split("line", " "), lambda x: x != "").alias("units")))
    fenced = F.concat(F.lit("<think>units: []\n</think>\n```json\n"), said, F.lit("\n```"))
    kind = F.col("pos") % 4
    answer = (
        F.when(kind == 0, F.to_json(F.struct(said.alias("response")))).when(kind == 1, F.to_json(F.struct(fenced.alias("response"))))
        .when(kind == 2, F.to_json(F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("message"))).alias("choices")))).otherwise('{"response": "no"}')
    )
    units = boundaries.response_units(F.col("answer"))
    rows = lines.select("doc_id", "pos", answer.alias("answer")).select("doc_id", "pos", units.alias("u"))
    return rows.select("doc_id", "pos", F.when(F.col("u").isNotNull(), F.size("u").cast("long")).alias("units"), F.sha2(F.array_join("u", "|"), 256).alias("joined"))


@query("c19_targets", f"""WITH RECURSIVE {_JA}, t AS (SELECT doc_id, paragraph_index AS pos, length(line) AS n, regexp_matches(line, '[か-ん漢字読書本文。、]') AS ja FROM jl),
f AS (SELECT doc_id, CAST(-1 AS BIGINT) AS pos, 0 AS taken, CAST(20000 AS BIGINT) AS rest, false AS takes FROM t GROUP BY doc_id
  UNION ALL SELECT t.doc_id, t.pos, taken + (ja AND n <= 1000 AND taken < 30 AND n <= rest)::INT, rest - CASE WHEN ja AND n <= 1000 AND taken < 30 AND n <= rest THEN n ELSE 0 END, ja AND n <= 1000 AND taken < 30 AND n <= rest
  FROM f JOIN t ON t.doc_id = f.doc_id AND t.pos = f.pos + 1)
SELECT doc_id, CAST(pos AS INTEGER) AS pos FROM f WHERE takes""")
def c19_targets(spark, sf_dir):
    """The paragraphs that a model is asked to cut, within a document's budget."""
    docs = A.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.translate("text", LATIN, KANA).alias("text"))
    return boundaries.targets(docs.select("doc_id", F.filter(F.split("text", r"[\r\n]+"), lambda x: x != "").alias("paragraphs")))


# --- pages ---------------------------------------------------------------------------------------


@query("b17_rate_keys", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '192.0.2.' || user_id % 256 WHEN 1 THEN '2001:db8:' || printf('%x', user_id % 65536) || ':' || printf('%x', event_id % 65536) || '::/64'
  WHEN 2 THEN '::ffff:192.0.2.' || user_id % 256 WHEN 3 THEN 'unknown' ELSE '2001:zz::1' END AS key FROM events""")
def b17_rate_keys(spark, sf_dir):
    """Keys of addresses in several notations."""
    four, hexed = F.concat(F.lit("192.0.2."), (F.col("user_id") % 256).cast("string")), lambda c: F.lower(F.hex(F.col(c) % 65536))
    six = F.concat(F.lit("2001:DB8:"), hexed("user_id"), F.lit(":0"), F.lpad(hexed("event_id"), 3, "0"), F.lit("::"), hexed("user_id"))
    six = F.when(F.col("event_id") % 65536 < 4096, six).otherwise(F.concat(F.lit("2001:DB8:"), hexed("user_id"), F.lit(":"), hexed("event_id"), F.lit(":0:0:0:1")))
    kind = F.col("event_id") % 5
    ip = F.when(kind == 0, four).when(kind == 1, six).when(kind == 2, F.concat(F.lit("::ffff:"), four)).when(kind == 3, None).otherwise("2001:zz::1")
    return A.table(spark, sf_dir, "events").select("event_id", urls.rate_key(ip).alias("key"))


#: What comes before and after a page's host or number, and what the URL is then refused for; {h} host, {n} number, {t} a tab.
ODD_URLS = [
    ("http://{h}:080/{n}", None), ("  http://{h}/{n} ", None), ("ht{t}tp://{h}{t}/", None), ("https:\\\\{h}\\{n}", None), ("http://{h}:8080/", "blocked-url"), ("http://{h}:70000/", "invalid-url"),
    ("http:/127.0.0.1/{n}", "blocked-url"), ("http://%31%32%37.0.0.1/{n}", "blocked-url"), ("http://①②⑦.0.0.1/{n}", "blocked-url"), ("http://127。0．0｡1/", "blocked-url"), ("http://１２７.1/{n}", "blocked-url"),
    ("http://1.2.3.4.{n}/", "invalid-url"), ("http://{h}.{n}/", "invalid-url"), ("http://0x0000000000000000000000000000007f000001/", "blocked-url"), ("http://0x00000000000000000000000008080808/", None),
    ("http://010.8.8.8/", None), ("http://012.8.8.8/", "blocked-url"), ("http://08.8.8.8/", "invalid-url"), ("http://256.8.8.8/", "invalid-url"), ("http://8.8.8.8./", None), ("http://lo\u00adcalhost/", "blocked-url"),
    ("http://a b.com/", "invalid-url"), ("http://{h}%2f.com/", "invalid-url"), ("http://[::ffff:8.8.4.4]/{n}", None), ("http://[::ffff:10.0.0.1]/{n}", "blocked-url"), ("http://user@{h}/", "blocked-url"), ("http://{h}:8x/", "invalid-url"),
    ("http://𝐞xample.com/", None), ("http:{h}/{n}", None), ("http:///{h}/{n}", None), ("//{h}/", "invalid-url"), ("http://./", "invalid-url"), ("ftp://{h}/", "invalid-url"),
]


@query("b1_odd_urls", f"SELECT page_id, CASE page_id % {len(ODD_URLS)} " + " ".join(f"WHEN {i} THEN '{why}'" for i, (_, why) in enumerate(ODD_URLS) if why) + " END AS reason FROM pages")
def b1_odd_urls(spark, sf_dir):
    """URLs as a parser reads them: blanks, slashes, escapes, compatible characters, numbers and ports of any notation."""
    pages = A.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#:]*)", 1).alias("host"))
    odd = F.element_at(F.array(*[F.lit(x) for x, _ in ODD_URLS]), (F.col("page_id") % len(ODD_URLS) + 1).cast("int"))
    for mark, to in (("{h}", F.col("host")), ("{n}", F.col("page_id").cast("string")), ("{t}", F.lit("\t"))):
        odd = F.replace(odd, F.lit(mark), to)
    return pages.select("page_id", urls.reason(odd).alias("reason"))


@query("b5_addresses", """WITH a AS (SELECT event_id, event_id % 8 AS kind, event_id * 7919 % 256 AS a, user_id % 256 AS b FROM events)
SELECT event_id, CASE WHEN kind < 3 THEN a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (0, 168)) OR (a = 198 AND b IN (18, 19))
  WHEN kind = 3 THEN true WHEN kind = 4 THEN false WHEN kind = 5 THEN true WHEN kind = 6 THEN false ELSE true END AS blocked FROM a""")
def b5_addresses(spark, sf_dir):
    """Whether URLs lead to addresses that aren't public: IPv4 as such, mapped and translated, own ranges of IPv6."""
    a, b = F.col("event_id") * 7919 % 256, F.col("user_id") % 256
    pair = lambda x, y: F.lower(F.hex(x * 256 + y))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    hosts = [
        text(a, ".", b, ".3.4"), text("[::ffff:", pair(a, b), ":304]"), text("[64:ff9b::", pair(a, b), ":304]"), text("[fe80::", pair(a, b), "]"),
        text("[2606:4700::", pair(a, b), "]"), text("[fd", F.lpad(F.lower(F.hex(a)), 2, "0"), "::1]"), text("[2620:1ec:", pair(a, b), "::1]"), text("[", pair(a, b), ":1]"),
    ]
    host = F.element_at(F.array(*hosts), (F.col("event_id") % 8 + 1).cast("int"))
    return A.table(spark, sf_dir, "events").select("event_id", F.coalesce(urls.reason(F.concat(F.lit("http://"), host, F.lit("/"))) == "blocked-url", F.lit(False)).alias("blocked"))


@query("b10_paths", """SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '#.*$', '') || '%2F%C3%A9' AS pattern FROM pages""")
def b10_paths(spark, sf_dir):
    """Paths whose letters are escaped, and others that must stay so, in one form."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "#.*$", "")
    odd = F.concat(F.regexp_replace(F.regexp_replace(path, "e", "%65"), "a", "%61"), F.lit("%2fé"))
    return A.table(spark, sf_dir, "pages").select("page_id", urls.normal_path(odd).alias("pattern"))


@query("b16_service", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'unextractable' WHEN event_id % 4 = 1 THEN 'rate-limited' ELSE 'network' END AS reason FROM events""")
def b16_service(spark, sf_dir):
    """The reasons behind failed answers of the extraction service."""
    kind = F.col("event_id") % 4
    body = F.when(kind == 0, '{"error":"unextractable"}').when(kind == 1, "busy").when(kind == 2, '{"error":"other"}')
    return A.table(spark, sf_dir, "events").select("event_id", crawl.service_reason(F.when(kind == 1, 429).otherwise(502), body).alias("reason"))


# --- reading activity ----------------------------------------------------------------------------

_REPLAY = f"""WITH RECURSIVE {_UNITS}, {_EV}, cn AS (SELECT doc_id, count(*) AS c FROM units GROUP BY doc_id),
ac AS (SELECT reader, k, ts_ms, seq, event_type AS e, coalesce(c, 0) AS c, row_number() OVER (PARTITION BY reader, k ORDER BY ts_ms, seq) AS n FROM ev LEFT JOIN cn ON doc_id = k WHERE event_type IN ('view', 'error', 'click')),
st AS (SELECT reader, k, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ts_ms, CAST(0 AS BIGINT) AS seq, 'paused' AS status, CAST(0 AS BIGINT) AS unit, CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS played, CAST(0 AS BIGINT) AS words, CAST(0 AS BIGINT) AS en_ms, false AS fin FROM ac WHERE n = 1
 UNION ALL SELECT s.reader, s.k, a.n, a.ts_ms, a.seq,
  CASE WHEN e = 'view' AND c > 0 THEN 'playing' WHEN e = 'view' THEN 'paused' WHEN e = 'error' AND status = 'playing' THEN 'paused' WHEN e = 'click' AND status = 'playing' AND unit = c - 1 THEN 'finished' ELSE status END,
  CASE WHEN e = 'view' AND status = 'finished' THEN 0 WHEN e = 'click' AND status = 'playing' AND unit < c - 1 THEN unit + 1 ELSE unit END,
  CASE WHEN e = 'view' AND status <> 'playing' THEN a.ts_ms ELSE since END,
  CASE WHEN e = 'view' AND status = 'finished' THEN 0 WHEN status = 'playing' AND (e = 'error' OR (e = 'click' AND unit = c - 1)) THEN played + a.ts_ms - since ELSE played END,
  CASE WHEN e = 'view' AND status = 'finished' THEN 0 WHEN e = 'click' AND status = 'playing' THEN words + 1 ELSE words END,
  CASE WHEN e = 'view' AND status = 'finished' THEN 0 WHEN e = 'click' AND status = 'playing' THEN s.en_ms + CAST(floor(60000.0 / 300.0 * (1 + CASE pause WHEN 'none' THEN 0 WHEN 'comma' THEN 0.5 WHEN 'sentence' THEN 1 ELSE 2 END) + 0.5) AS BIGINT) ELSE s.en_ms END,
  e = 'click' AND status = 'playing' AND unit = c - 1
 FROM st s JOIN ac a ON a.reader = s.reader AND a.k = s.k AND a.n = s.n + 1 LEFT JOIN units u ON u.doc_id = s.k AND u.unit_index = s.unit)"""


def _replayed(spark, sf_dir, texts):
    """The replay of all actions on texts (doc_id, text)."""
    acts = A.actions(spark, sf_dir).filter("action <> 'finish'")
    docs = texts.join(acts.select(F.col("text_hash").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    units = segment.units(docs).withColumn("text_hash", F.col("doc_id").cast("string"))
    return activity.replay(acts, activity.unit_table(units))


@query("e1_replay", _REPLAY + """ SELECT reader, CAST(k AS VARCHAR) AS text_hash, ts_ms, seq, status, CAST(unit AS INTEGER) AS unit_index, CASE WHEN status = 'playing' THEN played + ts_ms - since ELSE played END AS played_ms,
  CAST(0 AS BIGINT) AS ja_characters, words AS en_words, CAST(0 AS BIGINT) AS ja_ms, en_ms, fin AS finished FROM st WHERE n > 0""")
def e1_replay(spark, sf_dir):
    """The state after every action, with the units of the documents that the actions name; the twin goes action by action."""
    return _replayed(spark, sf_dir, A.table(spark, sf_dir, "documents"))


@query("e4_finishes", _REPLAY.replace("WITH RECURSIVE", "WITH RECURSIVE documents AS (SELECT p_partkey AS doc_id, p_name AS text FROM part),") + """, fi AS (SELECT reader, CAST(k AS VARCHAR) AS text_hash, epoch_ms(ts_ms) AS finished_at, seq, CASE WHEN status = 'playing' THEN played + ts_ms - since ELSE played END AS played_ms, words FROM st WHERE fin),
fd AS (SELECT * FROM fi QUALIFY row_number() OVER (PARTITION BY reader, finished_at ORDER BY seq) = 1)
SELECT reader, CAST(CAST(finished_at AS DATE) AS VARCHAR) AS date, count(*) AS finishes, CAST(0 AS BIGINT) AS ja_characters, CAST(sum(words) AS BIGINT) AS en_words, CAST(sum(played_ms) AS BIGINT) AS played_ms FROM fd GROUP BY ALL""")
def e4_finishes(spark, sf_dir):
    """The finishes that the replay finds in short texts (names of parts), once per reader and time, in daily totals."""
    texts = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    found = activity.distinct_finishes(activity.finishes(_replayed(spark, sf_dir, texts)))
    return activity.daily_totals(found).withColumn("date", F.col("date").cast("string"))


_PLACE = f"{_EV}, pl AS (SELECT reader, k, max_by(ts_ms, seq) AS ts_ms, max(seq) AS seq FROM ev WHERE event_type = 'click' GROUP BY reader, k)"


@query("e12_positions", f"WITH {_PLACE} SELECT reader, CAST(k AS VARCHAR) AS text_hash, CAST(k AS BIGINT) AS unit_index, CAST(k + 5 AS BIGINT) AS unit_count, ts_ms AS saved_at, seq AS played_ms, CAST(k * 3 AS BIGINT) AS ja_characters, CAST(1 AS BIGINT) AS en_words, CAST(2 AS BIGINT) AS ja_ms, seq AS en_ms FROM pl WHERE k % 7 <> 3")
def e12_positions(spark, sf_dir):
    """Positions written as one JSON object per reader and read again; every seventh text's entry is broken."""
    rows = A.events(spark, sf_dir).filter("event_type = 'click'").groupBy("reader", "k").agg(F.max_by("ts_ms", "seq").alias("saved_at"), F.max("seq").alias("seq"))
    whole = lambda c: F.col(c).cast("long") if isinstance(c, str) else c.cast("long")
    rows = rows.select(
        "reader", F.col("k").cast("string").alias("text_hash"), F.when(F.col("k") % 7 == 3, -1).otherwise(whole("k")).alias("unit_index"), whole(F.col("k") + 5).alias("unit_count"), "saved_at", F.col("seq").alias("played_ms"),
        whole(F.col("k") * 3).alias("ja_characters"), F.lit(1).cast("long").alias("en_words"), F.lit(2).cast("long").alias("ja_ms"), F.col("seq").alias("en_ms"),
    )
    return stores.positions(stores.export_positions(rows))


@query("e13_readings", f"WITH {_FIN} SELECT reader, CAST(epoch_us(finished_at) // 1000 AS BIGINT) AS finished_at, ja_characters, en_words, played_ms FROM fin WHERE seq % 6 <> 0")
def e13_readings(spark, sf_dir):
    """Finished readings from a JSON array per reader; every sixth has a number in quotes."""
    rows = A.finishes(spark, sf_dir).withColumn("at", F.unix_millis(F.col("finished_at").cast("timestamp")))
    item = F.to_json(F.struct(F.col("at").alias("finishedAt"), F.col("ja_characters").alias("japaneseCharacters"), F.col("en_words").alias("englishWords"), F.col("played_ms").alias("playedMs")))
    item = F.when(F.col("seq") % 6 == 0, F.regexp_replace(item, r'"playedMs":(\d+)', '"playedMs":"$1"')).otherwise(item)
    lists = rows.groupBy("reader").agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("json"))
    return stores.finished_readings(lists).drop("pos")


@query("e15_speeds", f"WITH {_EV} SELECT seq, CASE WHEN seq % 3 <> 2 AND k * 40 BETWEEN 100 AND 3000 AND k * 20 BETWEEN 50 AND 1500 THEN k * 40.0::DOUBLE END AS ja_cpm, CASE WHEN seq % 3 <> 2 AND k * 40 BETWEEN 100 AND 3000 AND k * 20 BETWEEN 50 AND 1500 THEN k * 20.0::DOUBLE END AS en_wpm FROM ev")
def e15_speeds(spark, sf_dir):
    """Saved speeds, none unless both are numbers within their limits."""
    quote = F.when(F.col("seq") % 3 == 2, '"').otherwise("")
    json = F.concat(F.lit('{"japaneseCharactersPerMinute":'), quote, (F.col("k") * 40).cast("string"), quote, F.lit(',"englishWordsPerMinute": '), (F.col("k") * 20).cast("string"), F.lit("}"))
    return stores.speed(A.events(spark, sf_dir).select(F.col("seq").alias("reader"), json.alias("json"))).withColumnRenamed("reader", "seq")


@query("e14_english_days", f"WITH {_ENGLISH} SELECT reader, CAST(date AS VARCHAR) AS date, english_read, translations FROM ed WHERE translations <> 2")
def e14_english_days(spark, sf_dir):
    """English days written as one JSON object per reader and read again; days of two translations have their number in quotes."""
    written = stores.export_english_days(_english(spark, sf_dir))
    return stores.english_days(written.withColumn("json", F.regexp_replace("json", r'"translationDisplayCount":2}', '"translationDisplayCount":"2"}')))


@query("a5_readings", f"WITH {_FIN} SELECT reader, CAST(row_number() OVER (PARTITION BY reader ORDER BY seq) - 1 AS INTEGER) AS pos, CAST(epoch_us(finished_at) // 1000 AS BIGINT) AS finished_at, ja_characters, en_words, played_ms FROM fin")
def a5_readings(spark, sf_dir):
    """Finished readings written as a JSON array per reader, in order, and read again."""
    rows = A.finishes(spark, sf_dir).withColumns({"finished_at": F.unix_millis(F.col("finished_at").cast("timestamp")), "pos": F.col("seq")})
    return stores.finished_readings(stores.export_finished(rows))


@query("a5_cut_lists", f"""WITH {_EV}, b AS (SELECT reader, k, max(seq) AS seq FROM ev WHERE event_type = 'view' GROUP BY ALL)
SELECT reader, CAST(k AS VARCHAR) AS text_hash, to_json([[k + 1, k + 3], NULL]) AS lists, seq AS saved_at FROM b WHERE k % 4 <> 1""")
def a5_cut_lists(spark, sf_dir):
    """Saved cut lists written as one JSON object per reader and read again; every fourth doesn't ascend."""
    rows = A.events(spark, sf_dir).filter("event_type = 'view'").groupBy("reader", "k").agg(F.max("seq").alias("saved_at"))
    k = F.col("k").cast("int")
    lists = F.array(F.array(k + 1, F.when(k % 4 == 1, k).otherwise(k + 3)), F.lit(None))
    found = stores.saved_boundaries(stores.export_boundaries(rows.select("reader", k.cast("string").alias("text_hash"), lists.alias("boundaries"), "saved_at")))
    return found.select("reader", "text_hash", F.to_json("boundaries").alias("lists"), "saved_at")


@query("a6_charsets", """SELECT page_id, sha256(CASE page_id % 4 WHEN 1 THEN replace(html, '<meta charset="utf-8">', '<meta name=x><META http-equiv="Content-Type" content="text/html; charset=ISO-8859-1">') ELSE html END) AS sha FROM pages""")
def a6_charsets(spark, sf_dir):
    """Pages in the charset of their meta tag, of their Content-Type (which wins over the tag), and of neither."""
    html, which = F.col("html"), F.col("page_id") % 4
    marked = F.replace(html, F.lit('<meta charset="utf-8">'), F.lit('<meta name=x><META http-equiv="Content-Type" content="text/html; charset=ISO-8859-1">'))
    content = F.when(which == 1, F.encode(marked, "ISO-8859-1")).when(which == 2, F.encode(html, "UTF-16")).otherwise(F.encode(html, "UTF-8"))
    kind = F.when(which == 2, "text/html; charset=UTF-16").when(which == 3, "text/html;charset=no-such-name")
    return A.table(spark, sf_dir, "pages").select("page_id", F.sha2(files.decode_html(content, kind), 256).alias("sha"))


@query("e19_opening", f"""WITH {_EV}, rc AS (SELECT DISTINCT reader, k FROM ev), sv AS (SELECT DISTINCT reader, k FROM ev WHERE event_type = 'view'), po AS (SELECT DISTINCT reader, k FROM ev WHERE event_type = 'click')
SELECT rc.reader, CAST(rc.k AS VARCHAR) AS text_hash, CASE WHEN sv.k IS NOT NULL THEN rc.k + 1000 WHEN po.k IS NULL THEN rc.k END AS cut FROM rc LEFT JOIN sv ON sv.reader = rc.reader AND sv.k = rc.k LEFT JOIN po ON po.reader = rc.reader AND po.k = rc.k""")
def e19_opening(spark, sf_dir):
    """The cut list that an opened text is read with: the saved one, none if it was read without, else the received."""
    ev = A.events(spark, sf_dir).select("reader", "event_type", F.col("k").cast("string").alias("text_hash"), "k")
    received = ev.select("reader", "text_hash", F.array("k").alias("boundaries")).distinct()
    saved = ev.filter("event_type = 'view'").select("reader", "text_hash", F.array(F.col("k") + 1000).alias("boundaries")).distinct()
    return activity.opening_boundaries(received, saved, ev.filter("event_type = 'click'")).select("reader", "text_hash", F.get("boundaries", F.lit(0)).alias("cut"))
