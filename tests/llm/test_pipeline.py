"""The pipeline's stages on small tables, each against a plain computation on its own input; and the classifiers' scores."""

import collections
import math
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from readflow.llm import langid, quality, sentence_pieces

from test_llm import brute_links

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(11)
VOCABULARY = {"en": ["the", "and", "thing", "wish", "over", "river"], "fr": ["le", "une", "être", "chose", "dans", "fleuve"]}


def prose(lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(["", "", "s", "ly", "ment"]) for _ in range(n))


PASSAGE = " ".join(f"{w}{i}" for i, w in enumerate(prose("en", 60).split()))
ROWS = [(i, prose(lang := ["en", "fr"][i % 2], 30 + i), lang, ["a", "b", None][i % 3], 7, "own") for i in range(40)]
ROWS += [(100, ROWS[4][1], "en", "a", 7, "own"), (101, ROWS[5][1] + " fin", None, "b", 7, "own"), (102, PASSAGE + " " + prose("en", 20), "en", "a", 7, "own"), (103, prose("en", 9) + "\n" + PASSAGE + "  " + prose("en", 30), "en", "c", 7, "own")]
ROWS += [(104, None, "en", "a", None, None), (105, "", None, None, 0, "own"), (106, "12 34 !?", "en", "a", 8, "own"), (107, "́́", "en", "a", 2, "own"), (None, prose("en", 25), "en", "a", 7, "own"), (None, None, None, None, None, None)]
ROWS += [ROWS[7], ROWS[7], (108, prose("fr", 60_000), "fr", "b", 7, "own")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string"


def brute_languages(train, texts):
    """Word-first backoff, plainly: lang_pred and score of each text."""
    words = lambda t: [w for w in regex.findall(r"[\p{L}\p{M}]+", (t or "").lower()) if regex.search(r"\p{L}", w)]
    counts, parts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    cuts = lambda w, n: [w] if n == 1 and len(w) == 1 else [(w if n == 1 else f"^{w}$")[i : i + n] for i in range(len(w if n == 1 else f"^{w}$") - n + 1)]
    for text, lang in train:
        if text is not None and lang is not None:
            for w in words(text):
                counts[w][lang] += 1
                for n in range(1, 5):
                    for g in cuts(w, n):
                        parts[g][lang] += 1
    langs = sorted({x for c in counts.values() for x in c})
    total = {x: sum(c[x] for c in counts.values()) for x in langs}
    of_size = {(x, n): sum(c[x] for g, c in parts.items() if len(g) == n) for x in langs for n in range(1, 5)}
    unit = lambda x: math.floor(x * langid.UNIT + 0.5)

    def score(w):
        if w in counts:
            return [unit(math.log(counts[w][x] + 0.5) - math.log(total[x] + 1)) for x in langs]
        for n in range(4, 0, -1):
            known = [g for g in cuts(w, n) if g in parts]
            if known:
                mean = [sum(unit(math.log(parts[g][x] + 0.5) - math.log(of_size[x, n] + 1)) for g in known) / len(known) for x in langs]
                return [math.floor(m - max(mean) - (4 - n) * langid.STEP * langid.UNIT + 0.5) for m in mean]
        return [0] * len(langs)

    out = []
    for t in texts:
        found = words(t)
        if not found:
            out.append(("und", 0.0))
            continue
        sums = [sum(x) / langid.UNIT for x in zip(*map(score, found), strict=True)]
        best, n = max(sums), len(found)
        out.append((langs[sums.index(best)], 1 / sum(math.exp((x - best) * min(n, 20) / n) for x in sums)))
    return out


def test_language_scores(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    train = [r for r in ROWS if r[0] is None or r[0] % 4]
    model = langid.fit(spark.createDataFrame(train, SCHEMA))
    tests = [(r[0], r[1]) for r in ROWS] + [(900, "wishing thés fleuver"), (901, "日本"), (902, "Ünknöwn")]
    got = collections.Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in langid.identify(spark.createDataFrame(tests, "doc_id long, text string"), model).collect())
    want = brute_languages([(r[1], r[2]) for r in train], [t for _, t in tests])
    assert got == collections.Counter((k, x, round(s, 6)) for (k, _), (x, s) in zip(tests, want, strict=True))
    assert df.count() == len(ROWS)


def test_quality_scores(spark):
    """Scores of a fitted model, recomputed plainly from its weights."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 40, 2)] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    rows = [r for r in ROWS if r[1] is None or len(r[1]) < 10_000]
    got = collections.Counter((r.doc_id, round(r.score, 9)) for r in quality.score(spark.createDataFrame(rows, SCHEMA), model).collect())
    code = lambda x, n: int(quality._hash(np.array([x], object), n)[0])

    def plain(text, lang, source):
        words = WORD.findall(text or "")
        low = {code(re.sub("[A-Z]", lambda m: m[0].lower(), w), quality.BUCKETS) for w in words}
        form = lambda w: regex.sub(r"\p{N}+", "0", regex.sub(r"[\p{L}\p{M}]*[^\P{L}A][\p{L}\p{M}]*", "a", regex.sub(r"\p{Lu}{2,}", "A", w)))
        shapes = {quality.BUCKETS + code(form(w), quality.SHAPES) for w in words}
        a = sum(float(np.mean([model.text[i] for i in x])) for x in (low, shapes) if x)
        chars, lines = float(len(text or "")), 1.0 + (text or "").count("\n")
        names = [f"source={source}", f"lang={lang}", f"chars={int(np.log2(1 + chars))}", f"lines={int(np.log2(lines))}", f"width={int(2 * np.log2(1 + chars / lines))}"]
        b = float(np.mean([model.meta[code(x, quality.META)] for x in names]))
        return 1 / (1 + math.exp(-sum(s * x + t for (s, t), x in zip(model.curves, (a, b), strict=True)) / 2))

    assert got == collections.Counter((r[0], round(plain(r[1], r[2], r[3]), 9)) for r in rows)


def test_stages(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), [ROWS]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append([tuple(r) for r in docs.collect()])
        assert name == "segmentations" or docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    start, told, single, cut, mixed, pieces = seen
    same = lambda a, b: collections.Counter(a) == collections.Counter(b)
    verdicts = brute_languages([(r[1], r[2]) for r in start], [r[1] for r in start])
    assert same(told, [r for r, (x, p) in zip(start, verdicts, strict=True) if x != "und" and p >= corpus_pipeline.LEAST_CONFIDENCE])
    assert {r[0] for r in start} - {r[0] for r in told} == {104, 105, 106, 107}
    links = brute_links({r[0]: r[1] for r in told if r[0] is not None}, 80, 5)
    assert same(single, [r for r in told if r[0] is None or links[r[0]][1] == r[0]]) and {100, 101}.isdisjoint(r[0] for r in single)
    windows, want = {}, []
    for r in sorted((r for r in single if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(r[1])
        for i in range(len(w) - 49):
            windows.setdefault(tuple(w[i : i + 50]), r[0])
    for r in single:
        spans = [m.span() for m in WORD.finditer(r[1] or "")]
        w = [r[1][a:b] for a, b in spans]
        gone = {i + j for i in range(len(w) - 49) if r[0] is not None and windows[tuple(w[i : i + 50])] < r[0] for j in range(50)}
        text = r[1] if not gone else r[1][: spans[0][0]] + "".join(r[1][spans[i][0] : spans[i + 1][0] if i + 1 < len(spans) else len(r[1])] for i in range(len(w)) if i not in gone)
        if not gone or WORD.search(text):
            want.append((r[0], text, r[2], r[3], len(text) if gone else r[4], r[5]))
    assert same(cut, want) and next(r for r in cut if r[0] == 103)[1].count("\n") == 1
    times = collections.Counter(mixed)
    assert set(times) <= set(cut) and all(times[r] <= 2 * n for r, n in collections.Counter(cut).items())
    size = lambda rows: sum(len(WORD.findall(r[1])) for r in rows)
    largest = max(len(WORD.findall(r[1])) for r in cut if r[0] != 108)
    assert size([r for r in mixed if r[3] == "a"]) == pytest.approx(2 * size([r for r in cut if r[3] == "a"]), abs=largest)
    vocab = sentence_pieces.vocabulary(P.path("piece_bpe_32k.model"))
    back = collections.defaultdict(list)
    for r in docs.collect():
        back[r.doc_id].append((r["sample"], sentence_pieces.decode_lists(sentence_pieces.pa.array([r.ids], sentence_pieces.pa.list_(sentence_pieces.pa.int32())), vocab)[0].as_py()))
    copies = collections.Counter(r[0] for r in mixed)
    for k, rows in back.items():
        assert {t for _, t in rows} == {r[1] for r in mixed if r[0] == k} and len(rows) == 2 * copies[k]
    assert set(back) == set(copies) and len(pieces) == 2 * len(mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_stages_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert all(f(spark, docs, str(tmp_path)).filter(F.lit(True)).count() == 0 for _, f in corpus_pipeline.STAGES)
