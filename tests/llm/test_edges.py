"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from readflow.llm import chat, fingerprints, jaccard_join, langid, mixing, quality, sentence_pieces, substring_dedup, token_counts, topk

P = pytest.importorskip("public_tokenizers")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(120_000))  # about a megabyte
SHARED = " ".join(f"s{i}" for i in range(70))
ROWS = [
    (1, "the cat and the dog", "en", "a", 19), (2, "the cat and the dog", "en", "a", 19), (3, None, None, None, None), (4, "", "en", None, 0),
    (5, LONG, "fr", "b", len(LONG)), (6, SHARED + " one", "en", "b", None), (7, "two " + SHARED, None, "b", 1), (None, SHARED, "en", "a", 2),
    (None, None, None, None, None), (8, " \n\t", "de", "c", 3), (9, "le chat et le chien", "fr", "a", 19), (9, "le chat et le chien", "fr", "a", 19),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = (
    "k h n l p g1 g2 a b c tok row rows id ids key keys x v u t marks mark starts start removed low high first last times target source_size size quality cut "
    "_id _h _k _w _at _bits _maybe _row _source _size _key _share _copy _times _same _hash _bin _end score lang_pred word words w total term sample t1 t2 gone rep"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).withColumn("nothing", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (2, None), (5, 0), (6, 1), (None, 1), (77, 0)], "doc_id long, quality int")


def same(a, b):
    """Equal rows, whatever their order and their floats' last digits."""
    key = lambda df: collections.Counter(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert a.columns == b.columns
    assert key(a) == key(b)


def test_operators(docs, wide, labels):
    bpe, pieces = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    told = langid.fit(docs)
    good = quality.fit(docs, labels)
    each = [
        (lambda d: fingerprints.edited_fingerprints(d), 12), (lambda d: token_counts.token_counts(d, bpe), 12), (lambda d: langid.identify(d, told), 12), (lambda d: quality.score(d, good), 12),
        (lambda d: sentence_pieces.sample_pieces(d, pieces).withColumn("ids", F.sha2(F.to_json("ids"), 256)), None),
    ]
    for f, n in each:
        same(f(docs), f(wide))
        assert n is None or f(docs).count() == n
        assert f(docs.limit(0)).count() == 0


def test_kept_columns(docs, wide, labels):
    """Operators that return the rows of their input leave all other columns alone."""
    one = jaccard_join.one_of_each(wide)
    assert one.columns == wide.columns
    rows = one.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    assert collections.Counter(r.doc_id for r in rows) == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1, 9: 2, None: 2}
    cut = substring_dedup.dedup_substrings(wide)
    assert sorted(cut.columns) == sorted(wide.columns)
    got = {(r.doc_id, r.text): r for r in cut.collect()}
    assert all(r[c] == f"own {c}" for r in got.values() for c in CLASHES if c != "removed")
    assert (7, "two ") in got and got[7, "two "].removed[0].asDict() == {"start": 1, "end": 71} and (2, "the cat and the dog") in got and (None, SHARED) in got and (3, None) in got
    mixed = mixing.mix(wide.drop("size").withColumn("size", F.length("text")))
    assert collections.Counter(mixed.columns).most_common(1)[0][1] == 1 and {"source_size", "target", "times"} <= set(mixed.columns)
    assert mixed.count() == 12 and all(r[c] == f"own {c}" for r in mixed.collect() for c in CLASHES if c not in ("source_size", "target", "times", "size"))
    same(mixing.mix_documents(wide, labels).select(docs.columns), mixing.mix_documents(docs, labels))
    told = langid.told(wide, langid.fit(docs), 0.4)
    assert told.columns == wide.columns and {r.doc_id for r in told.collect()} == {1, 2, 5, 6, 7, 9, None}
    for f in (lambda d: jaccard_join.one_of_each(d), lambda d: substring_dedup.dedup_substrings(d), lambda d: mixing.mix_documents(d, labels), lambda d: langid.told(d, langid.fit(d))):
        assert f(docs.limit(0)).count() == 0


def test_vectors_and_turns(spark):
    rows = [(50, [0.5, 0.25], "x"), (50, [0.5, 0.25], "y"), (1, [1.0], "x"), (2, [1.0], "x"), (3, None, "x"), (None, [9.0], "x"), (4, [2.0, 4.0], None), (5, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    want = [(50, 1, 4, 128 * 512 + 64 * 1024), (50, 2, 1, 128 * 256), (50, 3, 2, 128 * 256), (50, 4, 5, 0)]
    for d in (df, df.withColumns({c: F.lit(c) for c in ("query_id", "rank", "id", "vec", "q", "c", "low")})):
        assert [tuple(r) for r in topk.topk(d).orderBy("rank").collect()] == want
    turns = [(1, 0, "user", "x" * 1_000_000), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 0, None, None)]
    talk = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    read = lambda d: chat.read_back(chat.format_paths(chat.replies(d)))
    same(read(talk), read(talk.withColumns({c: F.lit(c) for c in ("tree", "leaf", "node", "parent", "rank", "up", "said", "score", "above")})))
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in read(talk).collect()} == {1: (3, 0), None: (1, 0)}


def test_mixing_takes_by_hand(spark):
    """The sampling, recomputed plainly from the same hash."""
    rows = [(i, f"s{i % 3}", (i * 37) % 90, [1.0, 2.0, 0.5, None][i % 4]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, q double")
    hashed = {r.doc_id: r.h & (2**64 - 1) for r in df.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), "size", F.lit(0), F.lit(7)).alias("h")).collect()}
    got = {r.doc_id: (r.times, r.target) for r in mixing.mix(df, quality_col="q").collect()}
    sizes = collections.Counter()
    for _, s, n, _ in rows:
        sizes[s] += n
    weights, cap, left, goal = dict(zip(sorted(sizes), (5.0, 2.0, 1.0), strict=True)), {s: 2.0 * n for s, n in sizes.items()}, 1.5 * sum(sizes.values()), {}
    free = set(sizes)
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap[s]]
        goal |= {s: cap[s] for s in over} if over else share
        left -= sum(cap[s] for s in over)
        free = free - set(over) if over else set()
    for s in sizes:
        mine = [r for r in rows if r[1] == s]
        full = math.floor(goal[s] / sizes[s] + 1e-9)
        rest, run, want = goal[s] - full * sizes[s], 0, {}
        for i, _, n, q in sorted(mine, key=lambda r: -math.log(((hashed[r[0]] >> 11) + 0.5) * 0.5**53) / (r[3] if r[3] and r[3] > 0 else 1.0)):
            run += n
            want[i] = full + (full < 2 and rest > 0 and run - n / 2 < rest)
        assert all(abs(got[i][1] - goal[s]) < 1e-6 for i in want)
        # A document that ends where the budget ends may go either way by how the sum was rounded.
        assert sum(got[i][0] != want[i] for i in want) <= 1


def test_segmentations_by_enumeration(spark):
    """Probabilities of a short text's segmentations, and inclusion in two samples, against all of them."""
    vocab = sentence_pieces.vocabulary(P.path("piece_bpe_32k.model"))
    text, names = "▁at▁an", {x: i for i, x in enumerate(vocab.names)}
    found = []
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1]):
            if c:
                parts.append(text[at : i + 1])
                at = i + 1
        if all(x in names for x in parts) and not any("▁" in x[1:] for x in parts):
            found.append(tuple(names[x] for x in parts))
    mass = {x: math.exp(sum(vocab.weight[i] for i in x)) for x in found}
    p = {x: m / sum(mass.values()) for x, m in mass.items()}
    keys = sentence_pieces.mixed(np.arange(4000, dtype=np.uint64) + np.uint64(77))
    drawn, lean = collections.Counter(), []
    for s in sentence_pieces.sample_slice(["at an"] * 4000, keys, vocab, 2, 1.0):
        assert s[0][0].tolist() != s[1][0].tolist()
        for ids, log_prob, log_inclusion in s:
            assert abs(log_prob - math.log(p[tuple(ids.tolist())])) < 1e-9 and log_inclusion <= 0
            drawn[tuple(ids.tolist())] += 1
        lean.append(sum(math.exp(q - w) for _, q, w in s))
    # Drawn without replacement: first x, then y with p(y) / (1 - p(x)).
    for x in found:
        both = p[x] + sum(p[y] * p[x] / (1 - p[y]) for y in found if y != x)
        assert abs(drawn[x] / 4000 - both) < 0.035
    assert abs(np.mean(lean) - 1) < 0.1  # the weights by inclusion add up to the whole


def test_signatures_by_hand(spark):
    """Marks of short texts, recomputed plainly from the same hashes."""
    texts = {1: "a bb a ccc", 2: "bb bb", 3: "x"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    words = sorted({w for t in texts.values() for w in t.split()})
    terms = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("term"))
    cols = [F.xxhash64("term", F.lit(j)).alias(f"h{j}") for j in range(2 * fingerprints.SAMPLES)]
    hashes = {r.w: [r[f"h{j}"] & (2**64 - 1) for j in range(2 * fingerprints.SAMPLES)] for r in terms.select("w", *cols).collect()}
    u = lambda bits, shift, n: ((bits >> shift & (2**n - 1)) + 0.5) * 0.5**n

    def rank(word, i, weight):
        first, second = hashes[word][2 * i], hashes[word][2 * i + 1]
        r, b = -math.log(u(first, 0, 14) * u(first, 14, 14)), u(second, 11, 53)
        c = -math.log(u(first, 28, 18) * u(first, 46, 18))
        return math.log(c) - r * (math.floor(math.log(weight) / r + b) + 1 - b)

    best = {}
    for k, t in texts.items():
        weight = collections.Counter()
        for w in t.split():
            weight[w] += len(w)
        best[k] = [min((rank(w, i, n), w) for w, n in weight.items()) for i in range(fingerprints.SAMPLES)]
    weights = [(k, w, float(len(w) * t.split().count(w)), float(len(t.replace(" ", "")))) for k, t in texts.items() for w in set(t.split())]
    rows = spark.createDataFrame(weights, "k long, word string, w double, total double").withColumn("term", F.xxhash64("word"))
    found = {r.k: [r[f"s{i}"] for i in range(fingerprints.SAMPLES)] for r in fingerprints.signatures(rows, ["k"]).collect()}
    assert all(np.allclose(found[k], [x for x, _ in best[k]], atol=1e-9) for k in texts)
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(df).collect()}
    ranks = spark.createDataFrame([(k, i, x) for k, v in found.items() for i, x in enumerate(v)], "k long, i int, r double").select("k", "i", F.hash("r").alias("m")).collect()
    assert all(got[r.k][8 * r.i : 8 * r.i + 8] == f"{r.m & 0xFFFFFFFF:08x}" for r in ranks)
