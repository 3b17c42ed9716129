import random
import re

from pyspark.sql import functions as F

from readflow.functions import japanese, text as T
from readflow.operators import boundaries, segment, shared, timing


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def units(spark, text, **kw):
    rows = segment.units(spark.createDataFrame([(1, text)], "doc_id long, text string"), **kw).orderBy("unit_index").collect()
    for r in rows:
        assert text[r.start : r.end] == r.text
    return rows


def test_english_units(spark):
    rows = units(spark, 'Mr. Smith, hi! "Dr. No" ran.\n\nEnd')
    assert [(r.text, r.sentence_index, r.pause) for r in rows] == [
        ("Mr.", 0, "none"), ("Smith,", 0, "comma"), ("hi!", 0, "sentence"), ('"Dr.', 1, "none"), ('No"', 1, "none"), ("ran.", 1, "paragraph"), ("End", 2, "paragraph"),
    ]


def test_breaks_blanks_and_surrogates(spark):
    assert [r.text for r in units(spark, "a b   \n\U00020b9fc")] == ["a", "b", "\U00020b9fc"]
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " \n ")], "doc_id long, text string")
    assert segment.units(docs).count() == 0
    assert len(units(spark, "a\x0bb", extended_breaks=True)) == 2


def test_japanese_units(spark):
    rows = units(spark, "吾輩は猫である。名前はまだ無い。\n　どこ")
    assert [r.sentence_index for r in rows] == sorted(r.sentence_index for r in rows)
    assert rows[-1].paragraph_index == 1 and rows[-1].start == 18 and rows[0].language == "ja"


def test_given_boundaries(spark):
    docs = spark.createDataFrame([(1, "吾輩は猫である。\nab c", [[3, 4, 99], None])], "doc_id long, text string, cuts array<array<int>>")
    rows = segment.units(docs, boundaries_col="cuts").orderBy("unit_index").collect()
    assert [r.text for r in rows] == ["吾輩は", "猫", "である。", "ab", "c"]


def test_joining_rules():
    cut = lambda s, *c: [s[a:b] for a, b in japanese.joined(s, japanese.pieces(s, list(c)))]
    assert cut("信じられているため、", 7) == ["信じられているため、"]
    assert cut("強壮・スタミナ増進作用があると", 12) == ["強壮・スタミナ増進作用が", "あると"]
    assert cut("「ニンニクの芽」", 6) == ["「ニンニクの芽」"]
    assert cut("猫、して", 2) == ["猫、", "して"]
    assert cut("猫 して", 2) == ["猫", "して"]
    assert japanese.code_points("a\U00020b9fb", [1, 2, 3]) == [1, 2]


def test_joining_as_a_fold(spark):
    """The column expressions cut and join as the plain rules do, by both sets of rules."""
    random.seed(9)
    letters = ["あ", "いう", "の", "は", "漢字", "カタカナ", "abc", "（", "）", "「", "」", "、", "。", "！", " ", "\u3000", "”", "”、", "きくけこ", "て", "𠮟"]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 30))) for _ in range(1_500)]
    texts += ["", " ", "（" * 5, "）", "「ニンニクの芽」を食べる。", "信じられているため、", "「長い長い長い長い長い長い長い長い長い長い」です", "（の ）", "の「（」）」の", "さき、「の」は"]
    col = F.col("t")
    text = lambda units: F.transform(units, lambda u: u["text"])
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(
        "t", text(japanese.joined_pieces(japanese.pieces_of(col))).alias("web"), text(japanese.joined_pieces(japanese.pieces_of(col), commas=False, hang=False)).alias("given"), japanese.items(col).alias("items")
    )
    for r in rows.collect():
        spans = japanese.pieces(r.t, japanese.default_chunker(r.t))
        assert r.web == [r.t[a:b] for a, b in japanese.joined(r.t, spans)], r.t
        assert r.given == [r.t[a:b] for a, b in japanese.joined(r.t, spans, commas=False, hang=False)], r.t
        assert [(x.piece, x.ends) for x in r["items"]] == [(x["piece"], x["ends"]) for x in japanese._items(r.t, None, japanese.default_chunker)], r.t
    plan = segment.units(spark.createDataFrame([(1, "日本")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") == 1


def test_units_by_columns(spark):
    """Units by the built-in rules and by given cuts are made without Python and equal the plain rules, whatever the texts and cuts."""
    random.seed(11)
    letters = ["あ", "いう", "の", "漢字", "カ", "abc.", "X, y", "（", "）", "「", "」", "、", "。", "！", " ", "\u3000", "”", "𠮟", "𠮟𠮟", "\n", "\r\n", " \n ", "\x85", "\x0b", "\x01", "\x02a", "\ufeff", "が（の）は"]
    docs = [(i, "".join(random.choice(letters) for _ in range(random.randint(0, 40))), [random.choice([None, [], [random.randint(-1, 40) for _ in range(9)], list(range(40))]) for _ in range(random.randint(0, 5))]) for i in range(600)]
    docs += [(600, None, None), (601, "", []), (602, "の漢字" * 200 + "。\n" + "か" * 100, [list(range(4, 600, 4)), [33, 64, 96]]), (603, "Mr. B is, 5.\n日本", None), (604, "の" * 64, [[32, 64]])]
    ja = re.compile(f"[{T.JAPANESE_CHARACTERS}]")

    def plain(text, cuts, breaks):
        rows, sentence, begins = [], -1, True
        for p, m in enumerate(re.finditer(f"[^{breaks}]+", text or "")):
            x, given = m[0], cuts[p] if cuts and p < len(cuts) else None
            kind = "ja" if ja.search(x) else "en"
            units = japanese.paragraph_units(x, given, japanese.default_chunker) if kind == "ja" else [(*w.span(), bool(re.search(r"[.!?]$", w[0])) and w[0] != "Mr.") for w in japanese.WORD.finditer(x)]
            for k, (a, b, ends) in enumerate(units):
                sentence, begins = sentence + begins, ends or k == len(units) - 1
                pause = "paragraph" if k == len(units) - 1 else "sentence" if ends else "comma" if japanese.COMMA.search(x[a:b]) else "none"
                rows.append((len(rows), p, sentence, x[a:b], m.start() + a, m.start() + b, "ja" if ja.search(x[a:b]) else "en", kind, pause))
        return rows

    df = spark.createDataFrame(docs, "doc_id long, text string, cuts array<array<int>>")
    for extended in (False, True):
        for cuts in (None, "cuts"):
            units = segment.units(df, extended_breaks=extended, boundaries_col=cuts)
            plan = units._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan and plan.count("Exchange") == 1
            found = {}
            for r in units.orderBy("doc_id", "unit_index").collect():
                found.setdefault(r.doc_id, []).append(tuple(r)[1:])
            for i, text, given in docs:
                assert found.get(i, []) == plain(text, given if cuts else None, T.EXTENDED_BREAK if extended else T.BREAK), (text, given, extended)


def test_texts_keep_their_control_characters(spark):
    """No character of a text stands for a phrase start: units are what the text has between their places."""
    for text in ("の\x01漢字\x02aの、漢", "「の\x01漢」\x01の本"):
        assert "".join(r.text for r in units(spark, text)) == text


def test_outside_chunker_a_few_texts_at_a_time(spark, monkeypatch):
    """A chunker from outside gives the same units, with cut lists too, however many texts it gets at a time; a paragraph row holds its own units alone."""
    docs = spark.createDataFrame([(i, f"の漢字{i}を読む。\nab c\nかきく", [None, None, [1]]) for i in range(100)], "doc_id long, text string, cuts array<array<int>>")
    key = lambda chunker: sorted(map(tuple, segment.units(docs, chunker=chunker, boundaries_col="cuts").collect()))
    assert key(lambda x: japanese.default_chunker(x)) == key(japanese.default_chunker)
    made = []
    monkeypatch.setattr(japanese, "pd", type("", (), {"Series": lambda x, dtype: made.append(len(x)) or x}))
    cut = japanese.units_of(T.BREAK, lambda x: []).func
    assert sum(map(len, cut([(["の"] * 100, [None] * 100)]))) == 100 and max(made) <= japanese.TEXTS


def test_blank_pieces_are_told_by_the_piece(spark):
    """Where places aren't asked for, Spark takes the filter on blank pieces down to them; it mustn't make each unit's text once more there."""
    found = segment.units(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).select("doc_id", "text")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("rtrim(") == 1


def test_partition_counts_do_not_matter(spark):
    docs = spark.createDataFrame([(i, f"One two, {i}. Three\nfour {i}") for i in range(40)], "doc_id long, text string")
    key = lambda d: sorted(map(tuple, segment.units(d).collect()))
    assert key(docs.repartition(1)) == key(docs.repartition(17))


def test_one_exchange(spark):
    docs = spark.createDataFrame([(1, "a b. c")], "doc_id long, text string")
    df = timing.with_times(segment.units(docs, chunker=None))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("Exchange hashpartitioning(doc_id") == 1


def test_plans_by_counting(spark):
    """Plans of English texts are counted in the text; they equal those of the units, and nothing is shuffled."""
    texts = ['Mr. Smith, hi! "Dr. No" ran.\n\nEnd', "a", " \n ", "", None, "One. Two\nthree, four. (Mrs. X) 'e.g. y' z.\" w", "no. end.", "x:  y;\tz ,\u2028 q.” r", "MR. mr.! st.", "a.b, c .. d"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(50, "日本。Go on. そう"), (51, "吾輩は猫、である")], "doc_id long, text string")
    fast, slow = timing.plan_documents(docs, en_wpm=250.0), timing.plan(segment.units(docs), en_wpm=250.0)
    key = lambda d: sorted(map(tuple, d.select(slow.columns).collect()))
    assert key(fast) == key(slow) and len(key(fast)) == 9
    words = timing.plan_documents(docs.filter("doc_id < 50")).filter("not has_ja")
    assert words.filter("doc_id = 9").first().total_ms == 300 + 200 + 400 + 600


def test_many_speeds(spark):
    docs = spark.createDataFrame([(1, "a b, c.")], "doc_id long, text string")
    speeds = spark.range(1_200).select(F.col("id").cast("string").alias("scenario"), F.lit(600.0).alias("ja_cpm"), (F.col("id") + 60).cast("double").alias("en_wpm"))
    rows = {r.scenario: r.total_ms for r in timing.plan_at_speeds(segment.units(docs), speeds).collect()}
    assert len(rows) == 1_200 and rows["0"] == 1000 + 1500 + 3000
    assert [r.total_ms for r in timing.plan_at_speeds(segment.units(docs), speeds.filter("id = 0")).collect()] == [5500]


def test_running_sums(spark):
    n = [(i * 7) % 5 for i in range(1000)]
    got = one(spark, ",".join(map(str, n)), lambda t: boundaries.running(F.transform(F.split(t, ","), lambda x: x.cast("int"))))
    assert got == [sum(n[: i + 1]) for i in range(1000)]


def test_durations(spark):
    def ms(text, language, pause, **kw):
        return spark.range(1).select(timing.display_ms(F.lit(text), F.lit(language), F.lit(pause), **kw)).first()[0]

    assert ms("吾輩は", "ja", "none") == 300 and ms("吾輩は", "ja", "paragraph") == 1300
    assert [ms("word", "en", p) for p in ("none", "comma", "sentence", "paragraph")] == [200, 300, 400, 600]
    assert abs(ms("word", "en", "none", en_wpm=0, rounding=False) - 60.0) < 1e-9


def test_offsets(spark):
    docs = spark.createDataFrame([(1, "Hello world. Bye")], "doc_id long, text string")
    probes = spark.createDataFrame([(1, i, o) for i, o in enumerate([0, 5, 6, 11, 12, 100])], "doc_id long, probe_id long, offset int")
    rows = timing.unit_at_offset(segment.units(docs), probes).orderBy("probe_id").collect()
    assert [r.unit_index for r in rows] == [0, 1, 1, 1, 2, 2]


_rule = re.compile(f"[{T.SPACE}]*-{{10,}}[{T.SPACE}]*")


def aozora_body(text: str) -> str:
    """text less its description of symbols (between two rules) and its source-book footer (from its first line, if the credit stands in a later one)."""
    lines = text.split("\n")
    rules = [i for i, x in enumerate(lines) if _rule.fullmatch(x)][:2]
    if len(rules) == 2 and any(T.SYMBOL_HEADING in x for x in lines[rules[0] : rules[1]]):
        head, rest = lines[: rules[0]], lines[rules[1] + 1 :]
    else:
        head, rest = [], lines
    foot = next((i for i, x in enumerate(rest) if x.startswith(T.SOURCE_BOOK)), len(rest))
    if any(T.CREDIT in x for x in rest[foot + 1 :]):
        rest = rest[:foot]
    return "\n".join([*head, *rest])


def without_notes(text: str) -> str:
    """text less inputter's notes; brackets nest inside a note, and an open note goes on to the end."""
    out, depth, at = [], 0, 0
    while at < len(text):
        if not depth:
            start = text.find(T.NOTE_START, at)
            out.append(text[at:] if start < 0 else text[at:start])
            if start < 0:
                break
            depth, at = 1, start + 1
        else:
            depth += {"［": 1, "］": -1}.get(text[at], 0)
            at += 1
    return "".join(out)


def test_aozora(spark):
    rule = "-" * 55
    text = f"題名\n著者\n\n{rule}\n【テキスト中に現れる記号について】\n\n《》：ルビ\n{rule}\n\n吾輩《わがはい》は｜猫［＃「※［＃二の字点］」に傍点］である\n\n底本：「本」\nインターネットの図書館、青空文庫（x）"
    assert one(spark, text, T.import_plain) == "題名\n著者\n\n吾輩は猫である"
    assert one(spark, "ふつう\r\nの文 ", T.import_plain) == "ふつう\nの文"
    assert one(spark, "書評\n底本：引用だけ", T.import_plain) == "書評\n底本：引用だけ"


def test_aozora_equals_a_plain_reader(spark):
    random.seed(6)
    rule, marks = "-" * 12, ["［＃", "［", "］", "あ", "\n", "＃", "本文"]
    texts = ["".join(random.choice(marks) for _ in range(random.randint(0, 40))) for _ in range(400)]
    texts += ["［＃" + "［" * n + "x" + "］" * n + "］y" for n in (0, 6, 7, 8, 9, 30)] + ["［＃" * n + "z" for n in (1, 8, 9, 20)] + ["a［＃b［c］d］e［＃open", "［［＃x］＃y］z", "［＃" * 3000 + "］" * 3000 + "end"]
    lines = [rule, f" {rule} ", "-" * 9, T.SYMBOL_HEADING, f"x{T.SYMBOL_HEADING}", T.SOURCE_BOOK + "「本」", "引用" + T.SOURCE_BOOK, T.CREDIT, "", "本文"]
    texts += ["\n".join(random.choice(lines) for _ in range(random.randint(0, 9))) for _ in range(600)]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.aozora_body(F.col("t")).alias("body"), T.without_notes(F.col("t")).alias("rest")).collect()
    for r in rows:
        assert (r.body, r.rest) == (aozora_body(r.t), without_notes(r.t)), r.t[:200]
    assert "Python" not in spark.createDataFrame([("x",)], "t string").select(T.import_plain(F.col("t")))._jdf.queryExecution().executedPlan().toString()


def test_boundary_lists(spark):
    df = spark.createDataFrame([([[1, 3], None],), ([[3, 3]],), ([[0]],), ([],)], "b array<array<int>>")
    assert [r[0] for r in df.select(boundaries.valid(F.col("b"))).collect()] == [True, False, False, True]
    df = spark.createDataFrame([("吾輩は猫", ["吾輩は", "猫"]), ("吾輩は猫", ["吾輩", "猫"]), ("猫。", ["猫", "。"])], "p string, u array<string>")
    assert [r[0] for r in df.select(boundaries.from_units(F.col("p"), F.col("u"))).collect()] == [[3], None, None]
    answers = ['{"response": "<think>x</think>```json\\n{\\"units\\": [\\"a\\", \\"b\\"]}\\n```"}', '{"choices": [{"message": {"content": "{\\"units\\": [\\"c\\"]}"}}]}', "broken"]
    df = spark.createDataFrame([(a,) for a in answers], "r string")
    assert [r[0] for r in df.select(boundaries.response_units(F.col("r"))).collect()] == [["a", "b"], ["c"], None]


def test_targets(spark):
    docs = spark.createDataFrame([(1, ["あ"] * 31), (2, ["あ" * 1000] * 21), (3, ["あ" * 1001, "en", "あ"])], "doc_id long, paragraphs array<string>")
    got = {}
    for r in boundaries.targets(docs).collect():
        got.setdefault(r.doc_id, []).append(r.pos)
    assert got == {1: list(range(30)), 2: list(range(20)), 3: [2]}


def test_parts_grow_with_the_texts(spark, tmp_path, monkeypatch):
    """A task's share of the texts is bounded, and one shuffle of them serves all windows."""
    rows = [(i, f"One, two {i}. Three\nfour") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert segment.units(docs).rdd.getNumPartitions() <= 4
    monkeypatch.setattr(shared, "PART_BYTES", 100)
    many = shared.parts(docs)
    assert many > 4 and segment.units(docs).rdd.getNumPartitions() == many
    asked = docs.select("doc_id", F.lit(0).cast("long").alias("probe_id"), F.lit(12).alias("offset"))
    units = segment.units(docs)
    for found, shuffles in ((timing.with_times(units), 1), (timing.moves(units), 1), (timing.unit_at_offset(units, asked), 2)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == shuffles and "RowFrame, currentrow$(), unboundedfollowing$()" not in plan


def test_moves_and_times_of_long_texts(spark):
    """Sums onward and places of sentences, against plain loops; a text of many units takes no time for each pair of them."""
    random.seed(3)
    rows, want = [], {}
    for doc, n in ((1, 1), (2, 40), (3, 20_000)):
        sentence, firsts, ms = 0, [0], []
        for i in range(n):
            if i and random.random() < 0.3:
                sentence += 1
                firsts.append(i)
            pause = random.choice(["none", "comma"])
            ms.append(200 if pause == "none" else 300)
            rows.append((doc, i, sentence, "x", i, i + 1, "en", "en", pause))
            want[doc, i] = [sentence]
        left = sum(ms)
        for i in range(n):
            k = want[doc, i][0]
            want[doc, i] = (firsts[k], firsts[k] if i > firsts[k] else firsts[k - 1] if k else 0, firsts[k + 1] if k + 1 < len(firsts) else i, left)
            left -= ms[i]
    units = spark.createDataFrame(rows, "doc_id long, unit_index int, sentence_index int, text string, start int, end int, language string, paragraph_language string, pause string")
    moves = {(r.doc_id, r.unit_index): (r.first_of_sentence, r.previous_sentence, r.next_sentence) for r in timing.moves(units).collect()}
    left = {(r.doc_id, r.unit_index): r.remaining_ms for r in timing.with_times(units).collect()}
    assert moves == {k: v[:3] for k, v in want.items()} and left == {k: v[3] for k, v in want.items()}


def test_english_units_need_one_window(spark):
    """Texts without Japanese characters are cut at once, without windows for paragraphs; blanks of all kinds, and paragraphs of blanks alone, count as in the others."""
    texts = ["a  b.\n \n\t\n“Mr. c,” d!)", "\n \n x　y;\r\n", "", None, " \n ", "\x0b a ﻿b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = segment.units(df)
    tree = found._jdf.queryExecution().optimizedPlan().toString().split("Window [")
    assert "Union" in tree[0] and len(found._jdf.queryExecution().optimizedPlan().children().apply(0).toString().split("Window [")) == 2
    rows = [(r.doc_id, r.unit_index, r.paragraph_index, r.sentence_index, r.text, r.start, r.end, r.pause) for r in found.orderBy("doc_id", "unit_index").collect()]
    assert rows == [
        (0, 0, 0, 0, "a", 0, 1, "none"), (0, 1, 0, 0, "b.", 3, 5, "paragraph"), (0, 2, 3, 1, "“Mr.", 10, 14, "none"), (0, 3, 3, 1, "c,”", 15, 18, "comma"), (0, 4, 3, 1, "d!)", 19, 22, "paragraph"),
        (1, 0, 1, 0, "x", 4, 5, "none"), (1, 1, 1, 0, "y;", 6, 8, "paragraph"), (5, 0, 0, 0, "a", 2, 3, "paragraph"), (5, 1, 1, 1, "b", 5, 6, "paragraph"),
    ]


def test_joined_phrases_equal_plain_rules(spark):
    """Phrases in rows join as the plain rules say, whatever characters they have, and no fold goes over a sentence."""
    random.seed(10)
    letters = ["「", "」", "（", "）", "a", "bc", "漢字", "\x01", "\x02", "x" * 16, "」「", "「「", "( )", "\x02a"]
    plain, rows = {}, []
    for sentence in range(300):
        text, spans = "", []
        for k in range(random.randint(1, 25)):
            text += " " * random.choice([0, 0, 1, 3]) if k else ""
            piece = "".join(random.choice(letters) for _ in range(random.randint(1, 3)))
            spans.append((len(text), len(text) + len(piece)))
            text += piece
        plain[sentence] = [(k, text[a:b], a + 7) for k, (a, b) in enumerate(japanese.joined(text, spans, commas=False, hang=False))]
        rows += [(1, sentence, k + 5, text[a:b], a + 7) for k, (a, b) in enumerate(spans)]
    df = segment.joined_phrases(spark.createDataFrame(rows, "doc_id long, sentence_index int, phrase int, text string, start int"))
    found = {}
    for r in sorted(df.collect()):
        found.setdefault(r.sentence_index, []).append((r.phrase, r.text, r.start))
    assert found == plain
    assert any(len(x) < sum(r[1] == k for r in rows) for k, x in plain.items())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "collect_list" not in plan


def test_aozora_is_read_once(spark):
    """A text is made once for all rules, and deep notes anywhere leave what is around them."""
    once = spark.createDataFrame([("x",)], "t string").select(T.import_plain(F.reverse("t")).alias("t"))
    assert once._jdf.queryExecution().analyzed().toString().count("reverse(") == 1
    deep = "［＃" + "［深" * 12 + "］" * 13
    for text in (f"a［＃b］c{deep}d［＃e］f", f"{deep}［［＃x］＃y］z{deep}", "［＃n］" * 3 + deep + "g［＃" * 2 + "］h"):
        assert one(spark, text, T.without_notes) == without_notes(text)


def test_proposed_units_are_cut_once(spark):
    df = spark.createDataFrame([("one two 𠮟 three", 1), ("a  b", 2), (" a", 3), ("a " + "x" * 31, 4), ("a " * 5000, 5)], "p string, i int")
    cut = df.select("i", boundaries.from_units(F.col("p"), F.regexp_extract_all("p", F.lit("([^ ]+ *)"), F.lit(1))).alias("c"))
    assert cut._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1
    assert {r.i: r.c for r in cut.collect()} == {1: [4, 8, 11], 2: [3], 3: None, 4: None, 5: list(range(2, 10_000, 2))}
