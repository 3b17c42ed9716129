import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from readflow.llm import chat, components, fingerprints, jaccard_join, langid, mixing, quality, sentence_pieces, substring_dedup, token_counts, topk

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(5)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]


def prose(n, words=WORDS):
    return " ".join(random.choice(words) + str(random.randint(0, 60)) for _ in range(n))


BASE = prose(120)
TEXTS = {
    1: BASE, 2: BASE, 3: BASE + " tail", 4: None, 5: "", 6: " \n", 7: "one", 8: "One", 9: "a b", 10: prose(60) + " " + BASE[:500], 11: prose(5000),
    12: "日本語のテキスト🎉", 13: "x" * 3000, 14: prose(80), 20: BASE.replace("alpha", "ALPHA"), 25: BASE + " more tail",
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "fr", None][k % 3], ["a", "b", None][k % 3], len(t or ""), "clash", 0.5) for k, t in TEXTS.items()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def repeated(spark, docs):
    extra = spark.createDataFrame([(None, BASE, None, None, None, None, None), (None, None, None, None, None, None, None)], SCHEMA)
    return docs.unionByName(docs.filter("doc_id in (1, 7)")).unionByName(extra)


def test_fingerprints(spark, docs, none):
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    ids = sorted(TEXTS)
    for k, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, nxt = TEXTS[k] or "", TEXTS[after] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + nxt[:q]
        assert got[k].n_chars == len(text) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if text == nxt:
            assert got[k].near_next == 1.0
    assert got[1].fingerprint == got[2].fingerprint != got[14].fingerprint
    assert got[11].near_edited > 0.5 > got[14].near_next
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert plain == {k: got[k].fingerprint for k in ids}
    assert fingerprints.edited_fingerprints(none).count() == 0
    assert fingerprints.edited_fingerprints(repeated(spark, docs)).count() == len(TEXTS) + 4


def test_likeness_is_jaccard(spark):
    n = 60
    pairs = [(i, " ".join(f"w{i}x{j}" for j in range(40)), " ".join(f"w{i}x{j}" for j in range(20, 60))) for i in range(n)]
    df = spark.createDataFrame(pairs, "doc_id long, a string, b string")
    marks = [{r.doc_id: r.fingerprint for r in fingerprints.fingerprints(df, text_col=c).collect()} for c in "ab"]
    same = np.mean([marks[0][i][k : k + 8] == marks[1][i][k : k + 8] for i in range(n) for k in range(0, len(marks[0][i]), 8)])
    assert abs(same - 1 / 3) < 0.05


def test_token_counts(spark, docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    more = [(100 + i, t) for i, t in enumerate(["<|endoftext|>a <|endoftext|>", "a\x1c\x85 　 b  c\n\n", "'ll it's 12³", "a" * 5000])]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    known = {**TEXTS, **dict(more)}
    for r in token_counts.token_counts(rows, path).collect():
        text = known[r.doc_id] or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 512)
    assert token_counts.token_counts(none, path).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(40)] + [(400, None), (401, [float("nan")] * 6), (402, [None, 1.0]), (None, [1.0]), (450, [float("inf")]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int" if False else "vec_id long, embedding array<double>")
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = collections.defaultdict(list)
    for r in topk.topk(df, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q, v in {i: v for i, v in good if i % 50 == 0}.items():
        want = sorted(((-int(v @ w), i) for i, w in good if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in want]
    assert topk.topk(df.limit(0)).count() == 0
    assert topk.topk(spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<double>")).count() == 0


def test_segmentations(spark, docs, none):
    path = P.path("piece_bpe_32k.model")
    out = sentence_pieces.sample_pieces(docs, path, k=3, decoded=True)
    rows = out.withColumn("back", sentence_pieces.decode(F.col("ids"), path)).collect()
    seen = collections.defaultdict(set)
    for r in rows:
        assert r.back == r.decoded == (TEXTS[r.doc_id] or "") and r.log_inclusion <= 0 and tuple(r.ids) not in seen[r.doc_id]
        seen[r.doc_id].add(tuple(r.ids))
    assert seen[4] == {()} and len(seen[1]) == 3
    again = {(r.doc_id, r.sample): r.ids for r in sentence_pieces.sample_pieces(docs.repartition(3), path, k=3).collect()}
    assert again == {(r.doc_id, r.sample): r.ids for r in rows}
    assert sentence_pieces.sample_pieces(none, path).count() == 0
    vocab = sentence_pieces.vocabulary(path)
    keys = sentence_pieces.mixed(np.arange(3000, dtype=np.uint64) + np.uint64(9))
    firsts, prob = collections.Counter(), {}
    for s in sentence_pieces.sample_slice(["the at"] * 3000, keys, vocab, 2, 0.5):
        firsts[tuple(s[0][0])] += 1
        prob |= {tuple(x[0]): np.exp(x[1]) for x in s}
    assert all(abs(firsts[x] / 3000 - p) < 0.04 for x, p in prob.items())


def brute_links(texts, percent, width):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for k, t in texts.items():
        w = WORD.findall((t or "").translate(low))
        sets[k] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_jaccard(spark, docs, none):
    texts = dict(TEXTS)
    words = BASE.split()
    for i in range(60):  # near copies around the threshold
        w = list(words)
        for _ in range(i % 5):
            w[random.randrange(len(w))] = f"edit{i}"
        texts[200 + i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for percent, width in ((90, 3), (80, 5)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, percent=percent, width=width).collect()}
        assert got == brute_links(texts, percent, width)
    assert jaccard_join.jaccard_components(none).count() == 0
    rows = jaccard_join.jaccard_components(repeated(spark, docs)).collect()
    assert len(rows) == len(TEXTS) + 4 and sum(r.component_id is None for r in rows) == 2
    assert jaccard_join.one_of_each(docs, 90, 3).columns == docs.columns


def test_jaccard_of_families(spark, monkeypatch):
    """Texts of one source that differ enough meet their lists' leaders, not all others; those that link are found, whoever leads."""
    rnd, words = random.Random(3), [f"w{i}" for i in range(40)]
    source = [rnd.choice(words) for _ in range(1500)]

    def edited(share):
        return " ".join(rnd.choice(words) if rnd.random() < share else w for w in source)

    texts = {i: edited(0.035 if i < 20 else 0.011) for i in range(30)}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in texts.items()}
    want = {k: k for k in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in linked:
            want[a] = want[b] = min(want[a], want[b])
    calls, true = [], jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *a: calls.append(pairs.count()) or true(pairs, *a))
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent=80, width=5).collect()
    assert 0 < len(linked) and 5 < len(set(want.values())) < 30 and {r.doc_id: r.component_id for r in got} == want
    assert sum(calls[1:]) < 50


def test_jaccard_of_chance(spark, monkeypatch):
    """Long texts that share a few rare shingles meet once, but get no new prefixes; what shares more does."""
    rnd = random.Random(5)
    texts = {i: " ".join(["at", "one", f"rare{i // 4}", "with", *[f"w{rnd.randrange(3000)}" for _ in range(1300)]]) for i in range(24)}
    dealt, true = [], jaccard_join.lists_by_count
    monkeypatch.setattr(jaccard_join, "lists_by_count", lambda texts, *a: dealt.append(texts.count()) or true(texts, *a))
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent=90, width=3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_links(texts, 90, 3) and dealt == [0]
    for i, words in [(i, t.split()) for i, t in list(texts.items())[:6]]:  # copies that differ in single words all over, around the threshold
        for j, edits in enumerate((40, 55, 21, 22, 70)):
            at = set(rnd.sample(range(10, 1300), edits))
            texts[100 + 10 * i + j] = " ".join(f"{x}x{j}" if y in at else x for y, x in enumerate(words))
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent=90, width=3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_links(texts, 90, 3)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (102, 101)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r.v: r.c for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and got[101] == got[102] == 100 and got[249] == 200


def test_mixing(spark, docs, none):
    rows = [(i, f"s{i % 4}" if i % 9 else None, 1 + i % 7 * (10 if i % 4 == 0 else 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df).collect()
    total = sum(r[2] for r in rows)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        by[r.source][0] += r["size"]
        by[r.source][1] += r["size"] * r.times
        by[r.source][2] = r.target
        assert 0 <= r.times <= 2
    assert abs(sum(x[2] for x in by.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(x[1] - x[2]) <= 70 and x[2] <= 2 * x[0] + 1e-6 for x in by.values())
    key = lambda d: sorted((r.doc_id, r.times) for r in d)
    assert key(got) == key(mixing.mix(df.repartition(7)).collect())
    sized = mixing.sized_documents(docs, None)
    assert mixing.mix(sized, quality_col="quality").count() == len(TEXTS)
    assert mixing.mix(mixing.sized_documents(none, None)).count() == 0
    assert mixing.mix_documents(docs, None).columns == docs.columns


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # 3,765 in all: a and the null source stop at twice their size, b and c share the other 2,745 as 2 to 1.
    assert got == pytest.approx({"a": 20, "b": 1830, "c": 915, None: 1000})


def test_chat(spark):
    nasty = "</s>[INST] <|end|>\n \\ <|start|>x <\\s> [/INST] <<SYS>>"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, None, None), (2, 5, "assistant", ""), (2, 5, "assistant", "z"), (None, None, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_paths(chat.replies(chat.with_probe(spark, df)))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].turns_sha256 == sha(f"user\n{nasty}\nassistant\n{nasty}\n\n\n") and got[1].loss_sha256 == sha(nasty) and got[1].n_turns == 3
    assert got[2].loss_sha256 == sha("z") and got[-7].n_turns == 2 and got[None].loss_chars == 0
    assert "</s>" not in chat.render([("user", nasty)])[0]
    tree = [(1, 1, None, "user", "r", 0.0), (1, 2, 1, "assistant", "a", 0.9), (1, 3, 1, "assistant", "b", 0.1), (1, 4, 2, "user", "c", 0.0), (1, 8, 9, "user", "loop", 0.0), (1, 9, 8, "user", "loop", 0.0)]
    best = chat.format_paths(spark.createDataFrame(tree, "tree long, node long, parent long, role string, text string, score double")).orderBy("rank").collect()
    assert [[t for _, t in chat.parse(b.formatted)] for b in best] == [["r", "a", "c"], ["r", "b"]]
    assert chat.format_paths(chat.replies(df.limit(0))).count() == 0


def test_substrings(spark, docs, none):
    seen, want = {}, {}
    for k in sorted(TEXTS):
        w = WORD.findall(TEXTS[k] or "")
        cover = set()
        for i in range(len(w) - 49):
            code = tuple(w[i : i + 50])
            if seen.setdefault(code, k) < k:
                cover |= set(range(i, i + 50))
        want[k] = (len(w), len(cover), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in cover).encode()).hexdigest())
    out = substring_dedup.dedup_substrings(docs)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(out).collect()} == want
    assert substring_dedup.dedup_substrings(none).count() == 0
    rows = substring_dedup.dedup_substrings(repeated(spark, docs)).collect()
    assert len(rows) == len(TEXTS) + 4 and all(not r.removed for r in rows if r.doc_id is None)


def test_language(spark, docs, none):
    rows = [(i, " ".join(random.choice(["the", "and", "thing", "wish"]) for _ in range(9)), "en") for i in range(60)]
    rows += [(100 + i, " ".join(random.choice(["le", "une", "être", "chose"]) for _ in range(9)), "fr") for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = spark.createDataFrame([(1, "the thing"), (2, "une chose"), (3, "wishing things"), (4, "chosée"), (5, "12 !?"), (6, None), (7, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(tests, model).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["en", "fr", "en", "fr", "und", "und", "und"]
    assert all(0 <= s <= 1 for _, s in got.values())
    empty = langid.fit(none)
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    marks = spark.createDataFrame([(1, "\u0301\u0301 \u0308"), (2, "\u0301 the thing")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(marks, model).collect()} == {1: "und", 2: "en"}


def test_quality(spark, docs, none):
    good = [(i, prose(40), "en", "s") for i in range(120)]
    bad = [(500 + i, " ".join(x.upper() + "!!" for x in prose(40).split()), "en", "t") for i in range(60)]
    df = spark.createDataFrame([*good, *bad], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 500)) for r in [*good, *bad] if r[0] % 2], "doc_id long, quality int")
    model = quality.fit(df, labels)
    held = [r for r in quality.score(df, model).collect() if r.doc_id % 2 == 0]
    assert np.mean([r.keep == (r.doc_id < 500) for r in held]) > 0.97
    assert quality.score(docs, model).count() == len(TEXTS)
    assert quality.score(docs, quality.fit(none, labels)).count() == len(TEXTS)


def test_language_counts_are_whole(spark, monkeypatch):
    """A broadcast of few words and n-grams changes no score: the others are joined."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "and", "thing", "wish"]) for _ in range(40)), "en") for i in range(40)]
    rows += [(100, "zirna kolp zirna", "xx"), (101, "日本語" * 40, "ja"), (102, "zirna and thing", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tests = spark.createDataFrame([(1, "zirna kolp"), (2, "kolpa"), (3, "the wishing zirna kolps"), (4, "日本"), (5, "日本語" * 40), (6, "zirna kolp"), (7, "ß"), (8, None)], "doc_id long, text string")
    got = []
    for words, parts in ((2, 2), (100_000, 100_000)):
        monkeypatch.setattr(langid, "MAX_WORDS", words)
        monkeypatch.setattr(langid, "MAX_GRAMS", parts)
        model = langid.fit(df)
        got.append({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(tests, model).collect()})
    assert got[0] == got[1] and len(got[0]) == 8
    assert [got[0][i][0] for i in (1, 2, 5)] == ["xx", "xx", "ja"] and got[0][1] == got[0][6] and got[0][8] == ("und", 0.0)
    told = {r.doc_id for r in langid.told(tests, model, 0.4).collect()}
    assert told == {k for k, (x, p) in got[0].items() if x != "und" and p >= 0.4}


def test_ngrams_of_whole_words(spark):
    """In scripts without spaces a word is a clause: what follows its 64th letter counts too."""
    rows = [(1, "あ" * 70 + "漢字仮名", "ja"), (2, "い" * 70 + "文章", "zz")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {"漢字仮", "字仮名$", "漢"} <= {r.name for r in model.grams.collect()}
    tests = spark.createDataFrame([(1, "漢字仮名漢"), (2, "文章文")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(tests, model).collect()} == {1: "ja", 2: "zz"}
    parts = next(langid._count_grams(iter([langid.pd.DataFrame({"lang": ["ja"], "name": ["あ" * 70 + "漢"], "n": [3]})])))
    counts = dict(zip(parts["name"], parts["n"], strict=True))
    assert counts["あ"] == 210 and counts["漢$"] == 3 and "あ$" not in counts


def test_quality_learns_from_all_others(spark, monkeypatch):
    """Every document without a label is in the pool, so that a rare source's words are learned too."""
    rows = [(i, f"fine{i % 7} words", "en", "s") for i in range(60)] + [(1000 + i, f"POOR{i % 7} stuff!!", "en", "t") for i in range(60)]
    rows += [(5000 + i, f"fine{i % 7} words rarely", "en", "s") for i in range(300)] + [(9000 + i, f"POOR{i % 7} stuff!! seldom", "en", "t") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in rows if r[0] < 5000], "doc_id long, quality int")
    sizes, real = [], quality._passed
    monkeypatch.setattr(quality, "_passed", lambda pool, past, counted: sizes.append((counted, real(pool, past, counted))) or (sizes[-1][1]))
    model = quality.fit(df, labels)
    first = sizes[0][1]
    assert first["n"][first["kind"] == 0].sum() == 600
    chosen = [int(x["n"][x["kind"] >= 4].sum()) for counted, x in sizes if counted]
    left = [int(x["n"][x["kind"] == 0].sum()) for counted, x in sizes if not counted]
    assert len(chosen) == quality.ROUNDS and all(0 < n <= 2 * quality.GROWTH * 600 * 2 for n in chosen)
    assert left == [600 - sum(chosen[:i]) for i in range(quality.ROUNDS)]
    at = quality._hash(np.array(["rarely", "seldom"], object), quality.BUCKETS)
    assert model.text[at[0]] > 0 > model.text[at[1]]
    flat, odds = quality.lists_odds((model.text, model.meta), quality.pa.array([np.array(sorted(at), np.int32).tobytes(), b""]), quality.pa.array([b"", b""], quality.pa.binary()))
    assert np.allclose(odds[0], [quality.mean_odds(model.text, np.sort(at)), 0.0])


def test_fingerprints_of_padded_texts(spark):
    """White space doesn't take samples away: at 2% of word characters every position has one."""
    texts = [" ".join(f"{side}{i:02}x" + " " * 200 for i in range(30)) for side in "abcdefgh"] + [" " * 500, "\n\t" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in fingerprints.edited_fingerprints(df).collect()}
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(df).collect()}
    missing = lambda x: [x[i : i + 8] for i in range(0, len(x), 8)].count("ffffffff")
    assert all(missing(rows[k].fingerprint) == missing(rows[k].edited_fingerprint) == 0 for k in range(8))
    assert plain == {k: r.fingerprint for k, r in rows.items()}
    assert all(rows[k].near_next == 0 for k in range(8)) and rows[8].near_next == 1.0 and rows[9].near_next == 0


def test_co_training_rounds_by_hand(spark):
    """Which documents each view labels in each round, ties by hash included, against plain loops over 30 documents."""
    rng = np.random.default_rng(12)
    row = lambda: np.sort(rng.choice(40, 6, replace=False)).astype(np.int32)
    meta = lambda: rng.choice(12, 5, replace=False).astype(np.int32)
    labelled = [(row(), meta(), i % 3 > 0) for i in range(12)]
    pool = [(row(), meta(), int(h)) for h in rng.integers(-(2**63), 2**63 - 1, 22)]
    pool += [(pool[i][0], pool[i][1], int(h)) for i, h in zip((0, 0, 0, 1, 1, 2, 3, 3), rng.integers(-(2**63), 2**63 - 1, 8), strict=True)]  # equal odds
    y, held = np.array([int(x[2]) for x in labelled]), np.array([i > 8 for i in range(12)])
    frame = spark.createDataFrame([(bytearray(w.tobytes()), bytearray(m.tobytes()), h) for w, m, h in pool], "words binary, meta binary, h long").repartition(3)
    growth, good = 0.3, float(np.mean(y))
    model = quality.co_train([x[0] for x in labelled], [x[1] for x in labelled], y, held, frame, rounds=3, growth=growth)

    views = [quality.Bayes(quality.BUCKETS + quality.SHAPES), quality.Bayes(quality.META)]
    for k, view in enumerate(views):
        view.learn([x[k] for x, h in zip(labelled, held, strict=True) if not h], y[~held])
    free, taken = list(range(len(pool))), 0
    for turn in range(3):
        odds = [[quality.mean_odds(view.weights(), x[k]) for x in pool] for k, view in enumerate(views)]
        label = {}
        for k in (0, 1):
            place = lambda i, k=k: math.floor(odds[k][i] * quality.FINE)
            for c, wanted in ((0, max(1, int(int(growth * len(pool)) * (1 - good)))), (1, max(1, int(int(growth * len(pool)) * good)))):
                ranked = sorted({place(i) for i in free}, reverse=c == 1)
                for x in ranked:
                    mine = [i for i in free if place(i) == x]
                    part = min(1.0, wanted / len(mine))
                    for i in mine:
                        share = int(quality.mixed(np.array([pool[i][2]], np.int64).view(np.uint64) ^ np.uint64(turn))[0] >> np.uint64(11)) * 0.5**53
                        if (part == 1.0 or share < part) and (odds[k][i] < 0 if c == 0 else odds[k][i] > 0):
                            label[i] = c
                    wanted -= len(mine)
                    if wanted <= 0:
                        break
        for i, c in label.items():
            for k, view in enumerate(views):
                view.counts[c, pool[i][k]] += 1
                view.docs[c] += 1
        free, taken = [i for i in free if i not in label], taken + len(label)
    assert taken > 12
    assert np.allclose(model.text, views[0].weights()) and np.allclose(model.meta, views[1].weights())
