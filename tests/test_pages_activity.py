import datetime as dt
import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from readflow import streaming
from readflow.functions import urls
from readflow.operators import activity, crawl
from readflow.sources import files, stores


def test_url_reasons(spark):
    cases = {
        "https://example.com/a#b": None, "http://example.com:80/": None, "ftp://example.com/": "invalid-url", "nonsense": "invalid-url",
        "https://u:p@example.com/": "blocked-url", "https://example.com:8080/": "blocked-url", "http://localhost/": "blocked-url", "http://intra/": "blocked-url",
        "http://a.internal./": "blocked-url", "http://127.1/": "blocked-url", "http://2130706433/": "blocked-url", "http://0x7f.0.0.1/": "blocked-url",
        "http://10.1.2.3/": "blocked-url", "http://8.8.8.8/": None, "http://[::1]/": "blocked-url", "http://[::ffff:7f00:1]/": "blocked-url",
        "http://[2606:4700::1]/": None, "http://[64:ff9b::a00:1]/": "blocked-url", "https://e.com/" + "a" * 2048: "invalid-url",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.reason(F.col("u")).alias("r")).collect()
    assert {r.u: r.r for r in rows} == cases


def test_rate_keys(spark):
    cases = {"192.0.2.1": "192.0.2.1", "2001:db8::1": "2001:db8:0:0::/64", "::ffff:192.0.2.1": "::ffff:192.0.2.1", "x:y": "x:y"}
    rows = spark.createDataFrame([(u,) for u in cases] + [(None,)], "u string").select("u", urls.rate_key(F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in rows} == {**cases, None: "unknown"}


def test_robots(spark):
    text = "Disallow: /early\nUser-agent: other\nUser-agent: *\nDisallow: /\nAllow: /p\nUser-agent: ReadBot # us\nDisallow: /*.php$\nDisallow: /a%2fb\nAllow: /x\nDisallow: /x\nDisallow:"
    rules = crawl.robots_rules(spark.createDataFrame([("h", text)], "host string, robots_text string"), "readbot")
    paths = {"/index.php": False, "/index.php?x": True, "/a%2Fb": False, "/x": True, "/early": True, "/q": True}
    pages = spark.createDataFrame([(i, "h", p) for i, p in enumerate(paths)], "page_id long, host string, path string")
    assert {r.path: r.allowed for r in crawl.allowed(pages, rules).collect()} == paths
    tabs = crawl.robots_rules(spark.createDataFrame([("h", "User-agent:\t*\nDisallow:\t/x\u00a0")], "host string, robots_text string"), "readbot")
    assert [(r.allow, r.pattern) for r in tabs.collect()] == [(False, "/x")]
    hard = spark.createDataFrame([("/" + "a*" * 30 + "b", "/" + "a" * 2000)], "p string, q string")
    assert hard.select(urls.matches(F.col("p"), F.col("q"))).first()[0] is False


def test_redirects(spark):
    u = [f"http://e{i}.com/" for i in range(8)]
    hops = spark.createDataFrame([*zip(u, u[1:], strict=False), ("http://s.com/a/b", "c?d"), ("http://t.com/", "http://10.0.0.1/")], "from_url string, to_url string")
    pages = spark.createDataFrame([(0, u[0]), (1, u[3]), (2, "http://s.com/a/b#x"), (3, "http://t.com/")], "page_id long, url string")
    got = {r.page_id: (r.final_url, r.reason) for r in crawl.follow(pages, hops).collect()}
    assert got == {0: (u[6], "page-unavailable"), 1: (u[7], None), 2: ("http://s.com/a/c?d", None), 3: ("http://10.0.0.1/", "blocked-url")}


def test_redirect_targets(spark):
    cases = {
        "?q=1": "http://e.com/a/b?q=1", "../c": "http://e.com/c", "../../../c": "http://e.com/c", "": "http://e.com/a/b?x", "#f": "http://e.com/a/b?x#f", "c": "http://e.com/a/c", "./c/.": "http://e.com/a/c/",
        "//o.com/p": "http://o.com/p", "/r?./..": "http://e.com/r?./..", "https://o.com/a/./b/../c?d": "https://o.com/a/c?d", "%2e%2E/c": "http://e.com/c", "..": "http://e.com/", ".c": "http://e.com/a/.c",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", crawl.resolved(F.lit("http://e.com/a/b?x#y"), F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in rows} == cases
    assert spark.range(1).select(crawl.resolved(F.lit("http://e.com"), F.lit("c"))).first()[0] == "http://e.com/c"


def test_robots_at_every_hop(spark):
    hops = spark.createDataFrame([("http://a.com/", "http://b.com/no"), ("http://b.com/yes", "http://c.com/"), ("http://a.com/2", "http://d.com/")], "from_url string, to_url string")
    rules = crawl.robots_rules(spark.createDataFrame([("b.com", "User-agent: *\nDisallow: /no")], "host string, robots_text string"), "readbot")
    log = spark.createDataFrame([("c.com", 404, None, None), ("d.com", 503, None, None), ("b.com", 200, "x", None)], "host string, status int, robots_text string, blocked_reason string")
    state = crawl.robots_state(log)
    assert {r.host: (r.robots_text, r.reason) for r in state.collect()} == {"c.com": (None, None), "d.com": (None, "page-unavailable"), "b.com": ("x", None)}
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, "http://b.com/yes"), (3, "http://a.com/2")], "page_id long, url string")
    got = {r.page_id: (r.final_url, r.hops, r.reason) for r in crawl.follow(pages, hops, rules, closed=state).collect()}
    assert got == {1: ("http://b.com/no", 1, "robots-disallowed"), 2: ("http://c.com/", 1, None), 3: ("http://d.com/", 1, "page-unavailable")}


def test_robots_behind_redirects(spark):
    hosts = spark.createDataFrame([(x,) for x in ("a.com", "b.com", "c.com", "d.com", "e.com")], "host string")
    log = spark.createDataFrame([("https://a.com/robots.txt", 200, "own"), ("https://x.b.com/r.txt", 200, "far"), ("https://e.com/robots.txt", 404, None)], "url string, status int, robots_text string")
    hops = [("https://b.com/robots.txt", "https://x.b.com/one"), ("https://x.b.com/one", "/r.txt"), ("https://c.com/robots.txt", "http://127.1/"), ("https://d.com/robots.txt", "https://d.com/0")]
    hops += [(f"https://d.com/{i}", f"https://d.com/{i + 1}") for i in range(9)]
    found = crawl.robots_fetched(hosts, log, spark.createDataFrame(hops, "from_url string, to_url string"))
    want = {"a.com": (200, "own", None), "b.com": (200, "far", None), "c.com": (None, None, "blocked-url"), "d.com": (None, None, "page-unavailable"), "e.com": (404, None, None)}
    assert {r.host: (r.status, r.robots_text, r.blocked_reason) for r in found.collect()} == want


def test_plans_are_built_without_jobs(spark):
    from readflow.operators import html, timing

    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.001/{x}.parquet") for x in ("documents", "pages"))
    spark.sparkContext.setJobGroup("building", "no job")
    try:
        joined = docs.join(docs.select("doc_id").filter("doc_id % 2 = 0"), "doc_id")
        plans = [timing.plan_documents(joined), html.articles(pages)]
        assert len(plans) == 2 and not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_translator(spark):
    """Toggles have no effect before availability; a failure hides; what comes when nothing is being made counts for nothing."""
    events = "toggle created available toggle toggle failed toggle failed failed created toggle toggle toggle created failed toggle available unavailable".split()
    want = [("checking", False)] * 2 + [
        ("available", False), ("creating", True), ("creating", False), ("failed", False), ("creating", True), ("failed", False), ("failed", False), ("failed", False),
        ("creating", True), ("creating", False), ("creating", True), ("ready", True), ("ready", True), ("ready", False), ("ready", False), ("ready", False),
    ]
    rows = [(1, i, i, e) for i, e in enumerate(events)] + [(2, i, i, e) for i, e in enumerate(["unavailable", "toggle", "available", "toggle"])]
    found = activity.translator_states(spark.createDataFrame(rows, "reader long, ts long, seq long, event string")).orderBy("reader", "seq").collect()
    assert [(r.status, r.visible) for r in found if r.reader == 1] == want and all(r.ready == (r.status == "ready") for r in found)
    assert [(r.status, r.visible) for r in found if r.reader == 2] == [("unavailable", False)] * 4


def test_named_entities_of_packages():
    assert files.numbered("<a b='x&amp;y&eacute;'/><!-- &eacute; --><![CDATA[&eacute;]]>&nbsp;&none;") == "<a b='x&amp;y&#233;'/><!-- &eacute; --><![CDATA[&eacute;]]>&#160;&none;"


def test_replay_matches_windows(spark):
    acts = [("play", 0, 0), ("advance", 0, 200), ("pause", 0, 300), ("play", 0, 1000), ("advance", 0, 1200), ("play", 0, 2000), ("move", 5, 2100)]
    rows = spark.createDataFrame([(1, "t", ts, i, a, arg) for i, (a, arg, ts) in enumerate(acts)], "reader long, text_hash string, ts_ms long, seq long, action string, arg int")
    units = spark.createDataFrame([("t", 0, 0, "en", 1, 0.0), ("t", 1, 0, "ja", 3, 2.0)], "text_hash string, unit_index int, sentence_index int, language string, characters int, pause_units double")
    got = activity.replay(rows, units).orderBy("seq").collect()
    assert [g.status for g in got] == ["playing", "playing", "paused", "playing", "finished", "playing", "playing"]
    end = got[4]
    assert end.finished and end.played_ms == 500 and (end.ja_characters, end.en_words, end.ja_ms, end.en_ms) == (3, 1, 1300, 200)
    assert got[5].unit_index == 0 and got[6].unit_index == 1


def test_replay_shares_units(spark, monkeypatch):
    """The units of a text come once for its readers, and once more where it has many actions; no text or an unknown one has none."""
    units = spark.createDataFrame([("t", i, i // 2, "en", 1, 0.0) for i in range(6)] + [("u", 0, 0, "en", 1, 2.0)], "text_hash string, unit_index int, sentence_index int, language string, characters int, pause_units double")
    rows = [(r, t, 10 * i, 2**60 + i, ["play", "advance", "sentence", "pause"][i % 4], 1) for r in (None, *range(40)) for t in ("t", "u", "none", None) for i in range(8)]
    acts = spark.createDataFrame(rows, "reader long, text_hash string, ts_ms long, seq long, action string, arg int")
    known = {"t": {i: (i // 2, "en", 1, 0.0) for i in range(6)}, "u": {0: (0, "en", 1, 2.0)}}
    want = []
    for r in (None, *range(40)):
        for t in ("t", "u", "none", None):
            mine = pd.DataFrame([x for x in rows if x[:2] == (r, t)], columns=["reader", "text_hash", "ts_ms", "seq", "action", "arg"], dtype=object)
            want += activity.fold(mine, known.get(t, {}), activity.Reading(len(known.get(t, {}))))
    for share in (activity.SHARE, 100):
        monkeypatch.setattr(activity, "SHARE", share)
        found = activity.replay(acts, units)
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # A copy of all units for every reader was what made large logs slow.
    assert "CoGroup" not in plan and "FlatMapGroups" not in plan


def test_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(r, "t", start + dt.timedelta(seconds=i), i, ["play", "advance", "pause"][i % 3], 0) for r in (1, 2) for i in range(12)]
    schema = "reader long, text_hash string, ts timestamp, seq long, action string, arg int"
    events = spark.createDataFrame(rows, schema)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    units = spark.createDataFrame([("t", i, i // 2, "en", 1, 0.0) for i in range(5)], "text_hash string, unit_index int, sentence_index int, language string, characters int, pause_units double")
    stream = streaming.reader_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), units)
    q = stream.writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted(map(tuple, d.collect()))
    batch = activity.replay(events.withColumn("ts_ms", F.unix_millis("ts")), units)
    live = spark.table("states")
    assert key(live.filter("cause = 'action'").select(*batch.columns)) == key(batch)


def test_stores(spark):
    good = '{"unitIndex":1,"unitCount":2,"savedAt":3,"playedMs":4,"readAmount":{"japaneseCharacters":5,"englishWords":6,"japaneseDurationMs":7,"englishDurationMs":8}}'
    js = '{"a":%s,"b":%s,"c":null,"d":%s}' % (good, good.replace(":1,", ":-1,"), good.replace('"savedAt":3,', ""))
    rows = spark.createDataFrame([(1, js), (2, "broken"), (3, None)], "reader long, json string")
    assert [(r.text_hash, r.unit_index, r.en_ms) for r in stores.positions(rows).collect()] == [("a", 1, 8)]
    days = spark.createDataFrame([(1, '{"2024-01-01":{"englishRead":true,"translationDisplayCount":2},"x":{"englishRead":true,"translationDisplayCount":1},"2024-01-02":{"englishRead":"true","translationDisplayCount":1}}')], "reader long, json string")
    assert [(r.date, r.translations) for r in stores.english_days(days).collect()] == [("2024-01-01", 2)]
    cuts = spark.createDataFrame([(1, '{"a":{"paragraphBoundaries":[[1,2],null],"savedAt":1},"b":{"paragraphBoundaries":[[2,1]],"savedAt":1},"c":{"paragraphBoundaries":[[1.5]],"savedAt":1}}')], "reader long, json string")
    assert [r.text_hash for r in stores.saved_boundaries(cuts).collect()] == ["a"]


def _book(extra=(), spine='<itemref idref="b"/><itemref idref="a"/><itemref idref="n" linear="no"/>'):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", f'<package><manifest><item id="a" href="a%20b.xhtml"/><item id="b" href="../b.xhtml#x"/><item id="n" href="n.xhtml"/></manifest><spine>{spine}</spine></package>')
        z.writestr("O/a b.xhtml", "<html><head><title>T</title></head><body><h1>First</h1><p>x <ruby>y<rt>z</rt></ruby></p></body></html>")
        z.writestr("b.xhtml", "<html><body><p>second</p></body></html>".encode("utf-16"))
        for name in extra:
            z.writestr(name, "x")
    return out.getvalue()


def test_books(spark):
    rows = [("good", bytearray(_book())), ("drm", bytearray(_book(["META-INF/Rights.xml"]))), ("miss", bytearray(_book(spine='<itemref idref="zz"/>'))), ("bad", bytearray(b"no zip"))]
    books = spark.createDataFrame(rows, "book_id string, content binary")
    got = {r.book_id: (r.text, r.reason) for r in files.book_texts(files.chapters(books)).collect()}
    assert got["good"] == ("second\nFirst\nx y", None)
    assert (got["drm"][1], got["miss"][1], got["bad"][1]) == ("drm", "invalid-epub", "invalid-epub")
    small = files.chapters(books.filter("book_id = 'good'"), most_bytes=10).collect()
    assert [r.reason for r in small] == ["too-large"]


def test_decoding(spark):
    rows = spark.createDataFrame([(bytearray(x),) for x in ("日本".encode(), "日本".encode("shift_jis"), b"\xff\xfe\xff", b"")], "c binary")
    assert [r[0] for r in rows.select(files.decode_text(F.col("c"))).collect()] == ["日本", "日本", None, ""]
    page = '<meta charset="shift_jis">日本'.encode("shift_jis")
    rows = spark.createDataFrame([(bytearray(page), None), (bytearray("日本".encode("euc_jp")), "text/html; charset=EUC-JP"), (bytearray("日".encode()), "text/html; charset=none-such")], "c binary, t string")
    assert [r[0][-1] for r in rows.select(files.decode_html(F.col("c"), F.col("t"))).collect()] == ["本", "本", "日"]


def test_summaries(spark):
    base = dt.date(2024, 1, 10)
    rows = [(1, dt.datetime(2024, 1, 10), 800, 100, 1), (1, dt.datetime(2024, 1, 4), 1000, 100, 1), (1, dt.datetime(2024, 1, 3), 7000, 10, 1)]
    fin = spark.createDataFrame(rows, "reader long, finished_at timestamp, ja_characters long, en_words long, played_ms long")
    r = activity.week_and_all(activity.daily_totals(fin), F.lit(base)).first()
    assert (r.week_ja_characters, r.week_en_words, r.all_ja_characters, r.all_en_words) == (1800, 200, 8800, 210)
    assert pd.notna(r.all_played_ms)


def test_readers_return(spark, tmp_path):
    """A reader who was silent for long goes on at the unit and with the totals of before, paused."""
    schema = "reader long, text_hash string, ts timestamp, seq long, action string, arg int"
    units = spark.createDataFrame([("t", i, i // 2, "en", 1, 0.0) for i in range(9)], "text_hash string, unit_index int, sentence_index int, language string, characters int, pause_units double")
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    (tmp_path / "in").mkdir()
    stream = streaming.reader_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), units)
    q = stream.writeStream.format("memory").queryName("returns").option("checkpointLocation", str(tmp_path / "cp")).start()
    parts = [
        [(1, "t", at(0), 1, "play", 0), (1, "t", at(5), 2, "advance", 0), (1, "t", at(7), 3, "advance", 0)],
        [(2, "t", at(10_000), 1, "play", 0)],
        [(2, "t", at(10_001), 2, "pause", 0)],
        [(1, "t", at(20_000), 4, "move", 1)],
    ]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    last = spark.table("returns").filter("reader = 1").orderBy("seq").collect()[-1]
    assert (last.status, last.unit_index, last.played_ms, last.en_words) == ("paused", 3, 7_000, 2)


def test_readers_pause_leave_and_come_back(spark, tmp_path):
    """A silent reader is paused by a timer, later the state leaves, and a new query goes on from the rows that the first one wrote."""
    schema = "reader long, text_hash string, ts timestamp, seq long, action string, arg int"
    units = spark.createDataFrame([("t", i, i // 2, "en", 1, 0.0) for i in range(9)], "text_hash string, unit_index int, sentence_index int, language string, characters int, pause_units double")
    start = dt.datetime(2024, 1, 1)
    at = lambda s: start + dt.timedelta(seconds=s)
    ms = lambda s: int(at(s).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    # Reader 1 falls silent while playing, reader 3 after a pause; reader 2 moves the time on.
    first = [
        [(1, "t", at(0), 1, "play", 0), (1, "t", at(5), 2, "advance", 0), (1, "t", at(7), 3, "advance", 0), (3, "t", at(1), 1, "speed_en", 2), (3, "t", at(2), 2, "move", 4)],
        [(2, "t", at(4_000), 1, "play", 0)], [(2, "t", at(4_001), 2, "advance", 0)], [(2, "t", at(30_000), 3, "advance", 0)], [(2, "t", at(30_001), 4, "pause", 0)],
    ]
    run = lambda name, parts, saved=None: _streamed(spark, tmp_path, name, lambda s: streaming.reader_states(s, units, idle_ms=1_800_000, keep_ms=7_200_000, saved=saved), (f"in-{name}", parts, schema))
    rows = run("leaving", first)
    others = sorted((r.reader, r.cause, r.status, r.unit_index, r.played_ms, r.ts_ms - ms(0)) for r in rows if r.cause != "action")
    assert [x for x in others if x[0] != 2] == [(1, "idle", "paused", 2, 7_000, 7_000), (1, "left", "paused", 2, 7_000, 7_000), (3, "left", "paused", 4, 0, 2_000)]
    saved = streaming.states_to_resume(spark.table("leaving"))
    assert {r.reader for r in saved.collect()} == {1, 2, 3}
    back = {r.reader: r for r in run("back", [[(1, "t", at(40_000), 9, "move", 1), (3, "t", at(40_000), 9, "advance", 0), (3, "t", at(40_001), 10, "play", 0), (3, "t", at(40_002), 11, "advance", 0)]], saved) if r.cause == "action"}
    assert (back[1].unit_index, back[1].played_ms, back[1].en_words) == (3, 7_000, 2)
    assert (back[3].unit_index, back[3].en_wpm, back[3].en_words, back[3].status) == (5, 350.0, 1, "playing")


def test_request_counts(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    parts = [[("a", at(i)) for i in range(5)] + [("b", at(59)), ("b", at(60))], [("c", at(9_000))], [("c", at(9_001))]]
    got = _streamed(spark, tmp_path, "counts", lambda s: streaming.request_counts(s, limit=3), ("in", parts, "key string, ts timestamp"))
    assert {(r.key, r.start, r.requests, r.limited) for r in got if r.key != "c"} == {("a", at(0), 5, 2), ("b", at(0), 1, 0), ("b", at(60), 1, 0)}


def test_resume_within_or_not(spark):
    """A position of another count or past the end isn't used; by the other rule it is moved within."""
    rows = spark.createDataFrame([(1, "a", 5, 10), (1, "b", 5, 9), (2, "a", 40, 10), (2, "c", 3, 4)], "reader long, text_hash string, unit_index int, unit_count int")
    counts = spark.createDataFrame([("a", 10), ("b", 10)], "text_hash string, units long")
    at = lambda clamp: {(r.reader, r.text_hash): r.unit_index for r in activity.resume(rows, counts, clamp_only=clamp).collect() if r.text_hash != "c"}
    assert at(False) == {(1, "a"): 5, (1, "b"): 0, (2, "a"): 0}
    assert at(True) == {(1, "a"): 5, (1, "b"): 5, (2, "a"): 9}


def test_grants_equal_the_batch(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(i, f"k{i % 5}", at(i * 7 // 2), i % 3 > 0) for i in range(120)]
    schema = "request_id long, key string, ts timestamp, has_work boolean"
    parts = [rows[i : i + 17] for i in range(0, len(rows), 17)]
    got = {r.request_id: r.granted for r in _streamed(spark, tmp_path, "grants", streaming.grants, ("asked", parts, schema))}
    want = {r.request_id: r.granted for r in crawl.two_level_limit(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and 0 < sum(want.values()) < 40


def _streamed(spark, tmp_path, name, make, *inputs, mode="append"):
    """The rows of a stream over inputs, each a (folder name, batches of rows, schema); batches come one by one."""
    streams = []
    for folder, _, schema in inputs:
        (tmp_path / folder).mkdir()
        streams.append(spark.readStream.schema(schema).parquet(str(tmp_path / folder)))
    q = make(*streams).writeStream.format("memory").outputMode(mode).queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    for i in range(max(len(parts) for _, parts, _ in inputs)):
        for folder, parts, schema in inputs:
            if i < len(parts):
                spark.createDataFrame(parts[i], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / folder))
        q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_live_verdicts(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    parts = [[(i, "k", at(i)) for i in range(4)] + [(10, "other", at(1))], [(4, "k", at(30)), (5, "k", at(61))]]
    got = {r.request_id: r.limited for r in _streamed(spark, tmp_path, "verdicts", lambda s: streaming.request_verdicts(s, limit=3), ("in", parts, "request_id long, key string, ts timestamp"))}
    assert got == {0: False, 1: False, 2: False, 3: True, 10: False, 4: True, 5: False}


def test_live_days(spark, tmp_path):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    ends = [[(1, at(1, 5), "en"), (1, at(1, 6), "ja"), (1, at(2, 1), "ja")], [(2, at(9, 1), "en")]]
    shown = [[(1, at(1, 7)), (1, at(2, 8)), (1, at(2, 9))], [(2, at(9, 1))]]
    got = _streamed(spark, tmp_path, "english", streaming.english_days, ("ends", ends, "reader long, ts timestamp, language string"), ("shown", shown, "reader long, ts timestamp"))
    assert {(r.reader, str(r.date)): (r.english_read, r.translations) for r in got} == {(1, "2024-01-01"): (True, 1), (1, "2024-01-02"): (False, 2)}


def test_days_of_each_zone(spark, tmp_path):
    """Wall dates around the changes of the clock, alike in batch and stream."""
    at = lambda m, d, h, mi=0: dt.datetime(2024, m, d, h, mi)
    rows = [
        (1, at(3, 10, 4, 59), "America/New_York"), (1, at(3, 10, 5, 1), "America/New_York"), (1, at(3, 11, 3, 59), "America/New_York"), (1, at(3, 11, 4, 1), "America/New_York"),
        (2, at(3, 9, 15), "Asia/Tokyo"), (2, at(3, 9, 14, 59), "Asia/Tokyo"), (3, at(3, 10, 9, 59), "Pacific/Kiritimati"), (3, at(3, 10, 10), "Pacific/Kiritimati"), (4, at(3, 10, 12), None), (5, at(3, 10, 10, 59), "Pacific/Pago_Pago"),
    ]
    rows = [(*r, 1, 2, 3) for r in rows]
    schema = "reader long, finished_at timestamp, zone string, ja_characters long, en_words long, played_ms long"
    want = {(1, "2024-03-09"): 1, (1, "2024-03-10"): 2, (1, "2024-03-11"): 1, (2, "2024-03-10"): 1, (2, "2024-03-09"): 1, (3, "2024-03-10"): 1, (3, "2024-03-11"): 1, (4, "2024-03-10"): 1, (5, "2024-03-09"): 1}
    batch = activity.daily_totals(spark.createDataFrame(rows, schema), F.col("zone"))
    assert {(r.reader, str(r.date)): r.finishes for r in batch.collect()} == want
    parts = [rows, [(9, at(3, 20, 0), "UTC", 0, 0, 0)], [(9, at(3, 20, 1), "UTC", 0, 0, 0)]]
    got = _streamed(spark, tmp_path, "zones", lambda s: streaming.daily_totals(s, tz=F.col("zone")), ("in", parts, schema))
    assert {(r.reader, str(r.date)): r.finishes for r in got if r.reader < 9} == want
    ends = spark.createDataFrame([(1, at(3, 9, 15), "en", "Asia/Tokyo")], "reader long, ts timestamp, language string, zone string")
    shown = spark.createDataFrame([(1, at(3, 9, 15), 1, True, "Asia/Tokyo")], "reader long, ts timestamp, seq long, visible boolean, zone string")
    assert [str(r.date) for r in activity.english_days(ends, shown, F.col("zone")).collect()] == ["2024-03-10"]


def test_live_sessions_and_finishes(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    got = _streamed(spark, tmp_path, "sittings", streaming.sessions, ("in", [[(1, at(0)), (1, at(10)), (1, at(50))], [(2, at(500))]], "reader long, ts timestamp"))
    assert sorted((r.reader, r.start, r.events) for r in got) == [(1, at(0), 2), (1, at(50), 1)]
    rows = [[(1, at(0), 5), (1, at(0), 6), (1, at(1), 7)], [(1, at(0), 8)]]
    kept = _streamed(spark, tmp_path, "once", streaming.distinct_finishes, ("done", rows, "reader long, finished_at timestamp, seq long"))
    assert sorted(r.finished_at for r in kept) == [at(0), at(1)]


def test_ingest_adds_new_texts_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    for rows in ([(1, "a b."), (2, " a b. \r\n"), (3, "")], [(4, "a b."), (5, "c")]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = streaming.ingest(texts, str(tmp_path / "out"), str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    units = spark.read.parquet(str(tmp_path / "out" / "units"))
    assert sorted(r.text for r in units.collect()) == ["a", "b.", "c"]
    assert spark.read.parquet(str(tmp_path / "out" / "hashes")).count() == 2
    # A batch reads the files of its hashes' beginnings only.
    one = spark.createDataFrame([("a b.",)], "t string").select(F.sha2("t", 256).alias("text_hash"))
    known = streaming.known_hashes(spark, str(tmp_path / "out"), 99, one)
    scan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and known.count() == 1
    many = spark.range(300).select(F.sha2(F.concat(F.lit("w "), "id"), 256).alias("text_hash"))
    many.coalesce(1).select("text_hash", F.substring("text_hash", 1, 2).alias("prefix")).write.partitionBy("prefix").parquet(str(tmp_path / "out" / "hashes" / "batch=7"))
    assert streaming.known_hashes(spark, str(tmp_path / "out"), 99, one).select(F.input_file_name().alias("f")).distinct().count() <= 2


def test_files_and_writers(spark, tmp_path):
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "a.txt").write_bytes("one\r\ntwo".encode())
    (tmp_path / "books" / "b.TXT").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "books" / "c.pdf").write_bytes(b"x")
    (tmp_path / "books" / "d.epub").write_bytes(_book())
    found = files.read_files(spark, str(tmp_path / "books"))
    assert sorted((r.kind or "", r.reason or "") for r in found.collect()) == [("", "unsupported-file"), ("epub", ""), ("txt", ""), ("txt", "")]
    assert sorted((r.text or "", r.reason or "") for r in files.import_texts(found).collect()) == [("", "unsupported-encoding"), ("one\ntwo", "")]
    entries = files.archive_entries(found.filter("kind = 'epub'").select(F.col("path").alias("book_id"), "content"))
    assert {r.path for r in entries.collect()} == {"META-INF/container.xml", "O/p.opf", "O/a b.xhtml", "b.xhtml"}
    from readflow.operators import segment

    units = segment.units(spark.createDataFrame([(1, "a b"), (2, "日本")], "doc_id long, text string"))
    files.write_units(units, str(tmp_path / "units"))
    assert {(r.language, r.text) for r in spark.read.parquet(str(tmp_path / "units")).collect()} == {("en", "a"), ("en", "b"), ("ja", "日本")}
    days = spark.createDataFrame([(1, "2024-01-01", 2)], "reader long, date string, finishes long")
    files.write_daily(days, str(tmp_path / "days"))
    assert spark.read.parquet(str(tmp_path / "days")).count() == 1
