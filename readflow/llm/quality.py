"""Document quality by co-training two naive Bayes views: the words of the text, and the page's metadata.

Both views learn from the labelled documents. In each round either view labels the other documents of
which it is surest, some of each class, and both learn from them. Each view's log odds are calibrated by
a logistic curve on labelled documents that it didn't learn from (a fifth of the sample, by hash); the mean
of the calibrated log odds scores a document.

The labelled documents are a bounded sample, MAX_LABELLED by the hash of their id. The rounds run in Spark
over all documents without a label, whose features are computed once: one pass tells the histogram of each
view's odds, one counts the features of those that are chosen. The driver holds tables of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, slices, stored, word_codes

MAX_LABELLED = 10_000
BUCKETS, SHAPES = 1 << 17, 1 << 12
META = 4_096
ROUNDS, GROWTH = 4, 0.05
#: One labelled document in so many calibrates, the others teach.
FOLDS = 5
#: Classes of odds per unit in the histograms.
FINE = 4_096
COLUMNS = ["text", "source", "lang"]


def _hash(words: np.ndarray, n: int) -> np.ndarray:
    return (pd.util.hash_array(words, categorize=False) % np.uint64(n)).astype(np.int64) if len(words) else np.empty(0, np.int64)


def text_features(texts: pa.Array) -> list[np.ndarray]:
    """Buckets of the distinct words of each text, A-Z lower-cased, then of their shapes.

    A word's shape has runs of capitals, other letters and digits as A, a and 0 and keeps what else it has.
    """
    codes, ends, words = word_codes(pc.fill_null(texts, ""))
    shapes = pa.array(words, pa.string())
    for pattern, to in ((r"\p{Lu}{2,}", "A"), (r"[\pL\pM]*[^\P{L}A][\pL\pM]*", "a"), (r"\pN+", "0")):
        shapes = pc.replace_substring_regex(shapes, pattern, to)
    lower = pc.ascii_lower(pa.array(words, pa.string()))
    at, form = _hash(lower.to_numpy(zero_copy_only=False), BUCKETS), BUCKETS + _hash(shapes.to_numpy(zero_copy_only=False), SHAPES)
    own = [np.unique(codes[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return [np.concatenate([np.unique(at[x]), np.unique(form[x])]) for x in own]


def mean_odds(w: np.ndarray, row: np.ndarray) -> float:
    """Mean weight of a row's words and, apart, of its shapes; 0 for a row without any."""
    cut = np.searchsorted(row, BUCKETS)
    return sum(float(w[x].mean()) for x in (row[:cut], row[cut:]) if len(x))


def meta_features(texts: pa.Array, source: pa.Array, lang: pa.Array) -> np.ndarray:
    """Five buckets per document: its source, its language, and the sizes of text, lines and line length."""
    texts = pc.fill_null(texts, "")
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)
    lines = 1.0 + pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False)
    names = [
        [f"source={x}" for x in source.to_pylist()],
        [f"lang={x}" for x in lang.to_pylist()],
        [f"chars={int(x)}" for x in np.log2(1 + chars)],
        [f"lines={int(x)}" for x in np.log2(lines)],
        [f"width={int(x)}" for x in 2 * np.log2(1 + chars / lines)],
    ]
    return np.stack([_hash(np.array(x, object), META) for x in names], axis=1)


class Bayes:
    """Naive Bayes of two classes over buckets of present features."""

    def __init__(self, size: int):
        self.counts = np.zeros((2, size))
        self.docs = np.zeros(2)

    def learn(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        for c in (0, 1):
            mine = [r for r, y in zip(rows, labels, strict=True) if y == c]
            if mine:
                self.counts[c] += np.bincount(np.concatenate(mine), minlength=self.counts.shape[1])
            self.docs[c] += len(mine)

    def weights(self) -> np.ndarray:
        """Log odds of each feature, by the share of the class's documents that have it."""
        p = (self.counts + 0.5) / (self.docs[:, None] + 1.0)
        return np.log(p[1]) - np.log(p[0])

    def odds(self, rows: list[np.ndarray]) -> np.ndarray:
        """Mean log odds of a row's features; 0 for a row without any."""
        w = self.weights()
        return np.array([mean_odds(w, r) for r in rows])


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from x to y, by damped Newton steps; the slope is at least 0."""
    scale = float(np.abs(x).mean()) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (p - y) + 1e-2 * w)
        w -= np.clip(step, -5, 5)
    return max(0.0, float(w[0])) / scale, float(w[1])


class Model:
    """Both views' weights and calibrations."""

    def __init__(self, text: Bayes, meta: Bayes, curves: tuple[tuple[float, float], tuple[float, float]]):
        self.text, self.meta, self.curves = text.weights(), meta.weights(), curves

    def score(self, texts: pa.Array, source: pa.Array, lang: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by text, by metadata, and combined."""
        a = np.array([mean_odds(self.text, r) for r in text_features(texts)])
        b = self.meta[meta_features(texts, source, lang)].mean(axis=1) if len(texts) else np.zeros(0)
        logits = [s * x + t for (s, t), x in zip(self.curves, (a, b), strict=True)]
        return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (*logits, (logits[0] + logits[1]) / 2))


def lists_odds(w: tuple[np.ndarray, np.ndarray], words: pa.Array, meta: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    """Features (row, bucket) of each view, from binary columns of 32-bit buckets, and the odds of the rows as of mean_odds()."""
    flat = []
    for x in (words, meta):
        n = pc.binary_length(x).to_numpy(zero_copy_only=False) // 4
        buckets = np.frombuffer(b"".join(x.to_pylist()), np.int32)
        flat.append((np.repeat(np.arange(len(x)), n), buckets))
    odds = [np.zeros(len(words)), np.zeros(len(words))]
    for i, (row, bucket) in enumerate(flat):
        for part in ((bucket < BUCKETS), (bucket >= BUCKETS)):
            n = np.bincount(row[part], minlength=len(words))
            odds[i] += np.bincount(row[part], weights=w[i][bucket[part]], minlength=len(words)) / np.maximum(n, 1)
    return flat, odds


class Choice:
    """The weights of both views at a round, and how far each of them labels: (class of odds, share of that class) at either end."""

    def __init__(self, weights: tuple[np.ndarray, np.ndarray], turn: int, ends: list[tuple[tuple[int, float], tuple[int, float]]] | None = None):
        self.weights, self.turn, self.ends = weights, turn, ends

    def labels(self, odds: list[np.ndarray], h: np.ndarray) -> np.ndarray:
        """0, 1, or -1 for rows that neither view is sure of; where both are, the metadata decide. Each round draws its own shares."""
        share = (mixed(h ^ np.uint64(self.turn)) >> np.uint64(11)) * 0.5**53
        y = np.full(len(h), -1)
        for x, ((low, below), (high, above)) in zip(odds, self.ends, strict=True):
            at = _fine(x)
            y[(x < 0) & ((at < low) | ((at == low) & (share < below)))] = 0
            y[(x > 0) & ((at > high) | ((at == high) & (share < above)))] = 1
        return y


def _fine(odds: np.ndarray) -> np.ndarray:
    return np.floor(odds * FINE).astype(np.int64)


def _end(at: np.ndarray, n: np.ndarray, wanted: int) -> tuple[int, float]:
    """Of classes in order: the one in which the first ``wanted`` rows end, and the share of its rows among them."""
    total = np.cumsum(n)
    i = min(int(np.searchsorted(total, wanted)), len(at) - 1)
    return int(at[i]), float(min(1.0, (wanted - (total[i] - n[i])) / n[i]))


def _passed(pool: DataFrame, rounds: list[Choice], counted: bool) -> dict[str, np.ndarray]:
    """Columns kind, at, n over the pool rows that no earlier round chose.

    Without ``counted``, n rows are in class ``at`` of the odds of view ``kind`` by the last round's weights. With it,
    n rows that the last round gives the class kind % 2 have the feature ``at`` of view kind // 2; kind 4 + class counts the rows.
    """
    shared = pool.sparkSession.sparkContext.broadcast(rounds)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *before, now = shared.value
        sums = [np.zeros(BUCKETS + SHAPES, np.int64) if k < 2 else np.zeros(META, np.int64) for k in range(4)] + [np.zeros(1, np.int64)] * 2
        found: dict[tuple[int, int], int] = {}
        for batch in batches:
            for part in slices(batch, 0):
                words, meta, h = part.column(0), part.column(1), part.column(2).to_numpy().view(np.uint64)
                free = np.ones(len(h), bool)
                for r in before:
                    free &= r.labels(lists_odds(r.weights, words, meta)[1], h) < 0
                flat, odds = lists_odds(now.weights, words, meta)
                if not counted:
                    for k, x in enumerate(odds):
                        for at, n in zip(*np.unique(_fine(x[free]), return_counts=True), strict=True):
                            found[k, int(at)] = found.get((k, int(at)), 0) + int(n)
                    continue
                y = np.where(free, now.labels(odds, h), -1)
                for c in (0, 1):
                    sums[4 + c] = sums[4 + c] + np.sum(y == c)
                    for k, (row, bucket) in enumerate(flat):
                        sums[2 * k + c] += np.bincount(bucket[y[row] == c], minlength=len(sums[2 * k + c]))
        kinds = [(k, i, int(x[i])) for k, x in enumerate(sums) for i in np.flatnonzero(x).tolist()] if counted else [(k, at, n) for (k, at), n in found.items()]
        if kinds:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*kinds, strict=True)], ["kind", "at", "n"])

    rows = pool.mapInArrow(each, "kind long, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).orderBy("kind", "at").toArrow()
    return {c: rows[c].to_numpy() for c in ("kind", "at", "n")}


def co_train(text: list[np.ndarray], meta: list[np.ndarray], labels: np.ndarray, held: np.ndarray, pool: DataFrame | None, rounds: int = ROUNDS, growth: float = GROWTH) -> Model:
    """From the labelled rows' features and labels (0 or 1), and all others' (words, meta, h; h is a hash of the id).

    In each round a view labels about ``growth`` of the pool at most. The rows that are held calibrate, if they are
    of both classes; else all do.
    """
    views = (Bayes(BUCKETS + SHAPES), Bayes(META))
    rows = (text, meta)
    if len(set(labels[held].tolist())) < 2:
        held = np.zeros(len(labels), bool)
    for view, r in zip(views, rows, strict=True):
        view.learn([x for x, h in zip(r, held, strict=True) if not h], labels[~held])
    good = float(np.mean(labels)) if len(labels) else 0.5
    past: list[Choice] = []
    size = 0
    for turn in range(rounds if pool is not None else 0):
        past.append(Choice(tuple(view.weights() for view in views), turn))
        sizes = _passed(pool, past, False)
        size = size or int(sizes["n"][sizes["kind"] == 0].sum())
        if not len(sizes["n"]):
            break
        each = max(1, int(growth * size))
        ends = []
        for k in (0, 1):
            at, n = (sizes[c][sizes["kind"] == k] for c in ("at", "n"))
            # As many of each class as the labelled documents suggest, and only on the right side of 0.
            ends.append((_end(at, n, max(1, int(each * (1 - good)))), _end(at[::-1], n[::-1], max(1, int(each * good)))))
        past[-1].ends = ends
        found = _passed(pool, past, True)
        if not len(found["n"]):
            break
        for k, at, n in zip(found["kind"], found["at"], found["n"], strict=True):
            if k < 4:
                views[k // 2].counts[k % 2, at] += n
            else:
                for view in views:
                    view.docs[k - 4] += n
    some = held if held.any() else ~held
    y = labels[some].astype(float)
    curves = tuple(calibrate(view.odds(r)[some], y) if len(y) else (0.0, 0.0) for view, r in zip(views, rows, strict=True))
    return Model(*views, curves)


def _inputs(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), *[F.col(c).cast("string") for c in COLUMNS])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """A model from df (id_col, text, source, lang) and labels (id_col, label_col: above 0 is good).

    Null labels count for nothing; of several labels the best counts. Without labels of both classes every score is near
    the labelled share, as with an empty table. Labelled documents beyond max_labelled are left out; all others with an id
    are the pool. Rows that repeat an id are documents of their own with its label. Documents with equal odds at the end of
    what a round takes are taken by hash. Texts are taken whole; a very long one has at most BUCKETS + SHAPES features.
    """
    known = stored(labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y")))
    ids = df.select(F.col(id_col).alias("id")).filter("id is not null").distinct()
    order = F.xxhash64(F.col("id").cast("string"))
    taken = known.join(ids, "id", "left_semi").orderBy(order, "id").limit(max_labelled)  # so many rows at most
    inputs = _inputs(df, id_col).filter("id is not null")
    found = _features(inputs.join(F.broadcast(taken), "id")).toArrow()
    names = np.array([str(x) for x in found["id"].to_pylist()], object)
    at = np.argsort(names.astype(str), kind="stable")
    held = pd.util.hash_array(names, categorize=False) % np.uint64(FOLDS) == 0 if len(names) else np.zeros(0, bool)
    words, meta = ([np.frombuffer(x, np.int32) for x in found[c].to_pylist()] for c in ("words", "meta"))
    y = found["y"].to_numpy()
    pool = None
    if 0 < np.sum(y) < len(y):
        # The labels grow with the documents, so at every size both sides are shuffled; each is a row per id, and features are short.
        rest = _features(inputs.withColumn("y", F.lit(-1))).hint("merge").join(known.select("id"), "id", "left_anti")
        pool = stored(rest.select("words", "meta", order.alias("h")))
    return co_train([words[i] for i in at], [meta[i] for i in at], y[at], held[at], pool)


def _features(rows: DataFrame) -> DataFrame:
    """id, y, words and meta (32-bit buckets, as binary) of rows (id, text, source, lang, y)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cols = [part.column(i) for i in range(1, 4)]
                words, meta = text_features(cols[0]), meta_features(*cols)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(4), *[pa.array([x.astype(np.int32).tobytes() for x in v], pa.binary()) for v in (words, meta)]], ["id", "y", "words", "meta"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(features, f"id {id_type}, y int, words binary, meta binary")


def score(df: DataFrame, model: Model, id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """id_col, p_text, p_meta, score (0 to 1) and keep (score >= least) of every row of df.

    Null texts, sources and languages are features of their own, as empty or null values. Equal rows have equal
    scores, one row each; very long texts are taken whole; an empty table gives no rows. Columns other than id_col,
    text, source and lang aren't read, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                p = m.score(*[part.column(i) for i in range(1, 4)])
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, pa.float64()) for x in p]], ["id", "p_text", "p_meta", "score"])

    rows = _inputs(df, id_col)
    id_type = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(each, f"id {id_type}, p_text double, p_meta double, score double")
    return found.select(F.col("id").alias(id_col), "p_text", "p_meta", "score", (F.col("score") >= least).alias("keep"))
