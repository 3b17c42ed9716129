"""Hard negatives by rotated one-bit codes: intervals of the scores decide what is scored exactly.

Every vector x, floor(scale * x), is turned by a fixed orthogonal map (sign flips and Walsh-Hadamard steps) and
stored with the signs of the turned vector as its code and its alignment a = <x, c> with the unit vector c of
the code. One code leaves six tenths of a vector's length, so what it leaves is coded in turn, LEVELS times, each
time with the signs, the alignment and the length of the rest r. An anchor q is turned likewise and cut into BITS
bit planes, so popcounts of codes and planes give every <c, q> up to the known length of the cut-off part. Then

    <x, q> = sum of a <c, q> + <r, q>,   |<r, q>| <= |r| * sqrt(|q|^2 - <c, q>^2)

by Cauchy and Schwarz, as r is orthogonal to the last c: an interval that surely holds the score. Pairs whose
interval can't reach what is asked (the kth best so far, the window of a positive) go, level by level; all others
get their whole-numbered inner product, so the result is exact whatever the codes are worth.

Vectors stay where they are. Anchors come by in rounds of bounded size, twice: for their positives and then,
with the positives' scores, for the negatives. Only the best of each task are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, stored_all
from .topk import LONG, NONE, SCORE_CELLS, first_of, matrix, products, round_cells

#: Codes of a vector, bit planes of an anchor, rounds of flips and steps of the turn, and its seed.
LEVELS, BITS, TURNS, SEED = 4, 8, 3, 20
#: Rows of vectors that are compared at once: the best of one lot rule out pairs of the next.
LOT = 1024
#: Slack for rounding, times the lengths of both vectors.
SLACK = 1e-9


def padded(width: int) -> int:
    """The power of 2, 64 or more, to which vectors are padded."""
    return max(64, 1 << (max(width, 1) - 1).bit_length())


def turned(x: np.ndarray, size: int) -> np.ndarray:
    """The rows of x, padded to size (a power of 2), under the fixed orthogonal map."""
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    flips = np.random.default_rng(SEED).integers(0, 2, (TURNS, size)) * 2.0 - 1
    for flip in flips:
        y = y * flip
        step = 1
        while step < size:
            z = y.reshape(len(y), size // (2 * step), 2, step)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), size)
            step *= 2
        y = y / math.sqrt(size)
    return y


def codes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of turned vectors: packed signs, one code after the other, and per code its alignment, the length of the rest and that of what is told."""
    root, rest, packed, sizes = math.sqrt(y.shape[1]), y, [], []
    for _ in range(LEVELS):
        along = np.abs(rest).sum(axis=1) / root
        packed.append(np.packbits(rest > 0, axis=1))
        rest = rest - np.where(rest > 0, 1.0, -1.0) * (along / root)[:, None]
        sizes += [along, np.sqrt((rest * rest).sum(axis=1)), np.sqrt(((y - rest) ** 2).sum(axis=1))]
    return np.concatenate(packed, axis=1), np.stack(sizes, axis=1)


class Coded:
    """Vectors' codes by level: words of signs, and the numbers of codes()."""

    def __init__(self, code: np.ndarray, sizes: np.ndarray):
        words = np.ascontiguousarray(code).view(np.uint64).reshape(len(code), LEVELS, -1)
        self.words, self.sizes = words, sizes.reshape(len(code), LEVELS, 3)
        self.signs = 2 * np.bitwise_count(words).sum(axis=2, dtype=np.int64) - 64 * words.shape[2]


class Planes:
    """Anchors, turned and cut into bit planes."""

    def __init__(self, vecs: np.ndarray, size: int):
        y = turned(vecs, size)
        self.root, self.length = math.sqrt(size), np.sqrt((y * y).sum(axis=1))
        self.low = y.min(axis=1, initial=0)
        self.step = np.maximum(y.max(axis=1, initial=0) - self.low, 1e-300) / ((1 << BITS) - 1)
        u = np.rint((y - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        left = y - self.low[:, None] - u * self.step[:, None]
        self.left = np.sqrt((left * left).sum(axis=1))
        self.planes = np.stack([np.packbits((u >> j) & 1 > 0, axis=1).view(np.uint64) for j in range(BITS)], axis=1)
        self.ones = np.bitwise_count(self.planes).sum(axis=2, dtype=np.int64) @ (1 << np.arange(BITS))

    def told(self, at: np.ndarray, rows: np.ndarray, coded: Coded, level: int) -> np.ndarray:
        """<c, q> of pairs of anchors' places and rows (arrays that broadcast), up to what cutting has left."""
        hits = np.zeros(np.broadcast_shapes(at.shape, rows.shape), np.int32)
        for j in range(BITS):
            for w in range(self.planes.shape[2]):
                hits += np.bitwise_count(self.planes[at, j, w] & coded.words[rows, level, w]).astype(np.int32) << j
        return (self.low[at] * coded.signs[rows, level] + self.step[at] * (2.0 * hits - self.ones[at])) / self.root

    def interval(self, at: np.ndarray, rows: np.ndarray, coded: Coded, level: int, so_far: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The estimate by the codes up to this level, and the lowest and highest score, of pairs."""
        along, rest, told = (coded.sizes[rows, level, i] for i in range(3))
        c = self.told(at, rows, coded, level)
        guess = so_far + along * c
        near = np.maximum(0, np.abs(c) - self.left[at])
        half = told * self.left[at] + rest * np.sqrt(np.maximum(0, self.length[at] ** 2 - near**2))
        half += SLACK * (told + rest + 1) * (self.length[at] + 1)
        return guess, guess - half, guess + half


def kth(x: np.ndarray, k: int) -> np.ndarray:
    """The kth greatest of each row; NONE or -inf fills rows that have fewer."""
    if x.shape[1] < k:
        return np.full(len(x), NONE if x.dtype == np.int64 else -np.inf)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


class Round:
    """The anchors of a round; after the first pass, the window of scores of each of their positives."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, size: int, k: int, windows: list[tuple[np.ndarray, np.ndarray]] | None = None):
        self.ids, self.labels, self.vecs, self.size, self.k = ids, labels, vecs, size, k
        #: Per place of a positive: lowest and highest score asked for. Without positives yet: one open window.
        self.alike, self.windows = windows is None, windows or [(np.full(len(ids), NONE + 1), np.full(len(ids), LONG))]

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of anchors and of rows that are to meet: of one label in the first pass, of others in the second."""
        label = batch.column(1).to_numpy()
        for x in np.unique(self.labels):
            rows = np.flatnonzero(label == x if self.alike else label != x)
            at = np.flatnonzero(self.labels == x)
            step = max(1, SCORE_CELLS // max(1, len(rows)))
            for start in range(0, len(at) if len(rows) else 0, step):
                yield at[start : start + step], rows

    def hopeful(self, planes: Planes, coded: Coded, at: np.ndarray, rows: np.ndarray, apart: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (places in at and rows) whose intervals reach a window's kth score so far; apart: none of an anchor with its own rows."""
        lowest, highest = least[at].astype(float), np.stack([high for _, high in self.windows], axis=1)[at].astype(float)
        lowest, highest = lowest - np.abs(lowest) * 1e-15, highest + np.abs(highest) * 1e-15  # 64 bits don't fit a float
        floor, top = lowest.min(axis=1), highest.max(axis=1)
        guess, low, high = planes.interval(at[:, None], rows[None, :], coded, 0, 0.0)
        r, c = np.nonzero(apart & (high >= floor[:, None]) & (low <= top[:, None]))
        guess = guess[r, c]
        for level in range(1, LEVELS):
            guess, low, high = planes.interval(at[r], rows[c], coded, level, guess)
            keep = (high >= floor[r]) & (low <= top[r])
            r, c, guess, low, high = (x[keep] for x in (r, c, guess, low, high))
        # As many as k pairs surely lie in the window and score at least this.
        for p in range(len(self.windows)):
            sure = np.full(apart.shape, -np.inf)
            inside = (low >= lowest[r, p]) & (high <= highest[r, p])
            sure[r[inside], c[inside]] = low[inside]
            lowest[:, p] = np.maximum(lowest[:, p], kth(sure, self.k))
        keep = np.any([(high >= lowest[r, p]) & (low <= highest[r, p]) for p in range(len(self.windows))], axis=0)
        return r[keep], c[keep]

    def best(self, batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors' places, places of positives, ids and scores: the k best of each window, ties to smaller ids."""
        planes, places = Planes(self.vecs, self.size), len(self.windows)
        found = [np.empty(0, np.int64) for _ in range(3)]  # place of anchor and positive in one number, id, score
        least = np.stack([low for low, _ in self.windows], axis=1)  # grows to the kth score found so far
        for batch in (b.slice(i, LOT) for b in batches for i in range(0, b.num_rows, LOT)):
            ids, vecs = batch.column(0).to_numpy(), matrix(batch.column(2))
            code = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(ids), -1)
            coded = Coded(code, batch.column(4).flatten().to_numpy())
            for at, rows in self.blocks(batch):
                r, c = self.hopeful(planes, coded, at, rows, self.ids[at, None] != ids[rows][None, :], least)
                scores = np.full((len(at), len(rows)), NONE, np.int64)
                scores[r, c] = self.scored(at[r], vecs, rows[c])
                for p, (lowest, highest) in enumerate(self.windows):
                    s = np.where((scores >= lowest[at, None]) & (scores <= highest[at, None]), scores, NONE)
                    x, y = np.nonzero((s != NONE) & (s >= np.maximum(kth(s, self.k), least[at, p])[:, None]))
                    found = [np.concatenate(z) for z in zip(found, (at[x] * places + p, ids[rows[y]], s[x, y]), strict=True)]
            keep = first_of(found[0], [-found[2], found[1]], np.ones(len(found[0]), np.int64), self.k)
            found = [x[keep] for x in found]
            full, n = np.unique(found[0], return_counts=True)
            worst = np.full(least.size, LONG)
            np.minimum.at(worst, found[0], found[2])
            full = full[n >= self.k]
            least.ravel()[full] = np.maximum(least.ravel()[full], worst[full])
        return found[0] // places, found[0] % places, found[1], found[2]

    def scored(self, at: np.ndarray, vecs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Inner products, whole numbers, of pairs; beyond 64 bits the nearest within."""
        w = min(self.vecs.shape[1], vecs.shape[1])
        if np.abs(self.vecs).max(initial=0) * np.abs(vecs).max(initial=0) * max(w, 1) >= 2**53:
            return np.array([products(self.vecs[a : a + 1], vecs[b : b + 1])[0, 0] for a, b in zip(at, rows, strict=True)], np.int64)
        step = max(1, SCORE_CELLS // max(1, w))
        parts = [np.einsum("ij,ij->i", self.vecs[at[i : i + step], :w], vecs[rows[i : i + step], :w]) for i in range(0, len(at), step)]
        return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)


def coded(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: float) -> tuple[DataFrame, int]:
    """id, label, vec, code, sizes of the rows that take part, stored, and the size of a code in bits."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    usable = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec")).filter("id is not null and label is not null and vec is not null")
    fine = usable.filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    whole = fine.withColumn("vec", F.transform("vec", lambda x: F.floor(x * F.lit(scale)).cast("double")))
    size = padded(whole.agg(F.max(F.size("vec"))).first()[0] or 1)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step := max(1, SCORE_CELLS // size)):
                part = batch.slice(start, step)
                signs, sizes = codes(turned(matrix(part.column(2)), size))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * sizes.shape[1]), pa.array(sizes.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in signs], pa.binary()), lists], ["id", "label", "vec", "code", "sizes"])

    return stored(whole.mapInArrow(code, "id long, label long, vec array<double>, code binary, sizes array<double>")), size


def _round(rows: DataFrame, anchors: DataFrame, size: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of a round's anchors."""
    sc = rows.sparkSession.sparkContext
    known = anchors.toArrow().sort_by("id").combine_chunks()  # at most the round's numbers
    ids, labels, vecs = known["id"].to_numpy(), known["label"].to_numpy(), matrix(known["vec"].combine_chunks())
    first = sc.broadcast(Round(ids, labels, vecs, size, positives))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, _, mine, score = first.value.best(batches)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (first.value.ids[at], mine, score)], ["anchor_id", "id", "score"])

    order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = rows.mapInArrow(alike, "anchor_id long, id long, score long").withColumn("place", F.row_number().over(order))
    taken = best.filter(F.col("place") <= positives).toArrow().combine_chunks()  # a few rows per anchor of the round
    at, place, score = np.searchsorted(ids, taken["anchor_id"].to_numpy()), taken["place"].to_numpy() - 1, taken["score"].to_numpy()
    kept, scores = np.full((len(ids), positives), NONE), np.full((len(ids), positives), NONE)
    kept[at, place], scores[at, place] = taken["id"].to_numpy(), score
    windows = []
    for p in range(positives):
        lowest, highest = np.full(len(ids), LONG), np.full(len(ids), NONE)  # an empty window where there is no such positive
        for i in at[place == p]:
            lowest[i], highest[i] = -(-low * int(scores[i, p]) // 100), high * int(scores[i, p]) // 100
        windows.append((lowest, highest))
    second = sc.broadcast((Round(ids, labels, vecs, size, negatives, windows), kept, scores))

    def unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, scores = second.value
        at, p, mine, score = now.best(batches)
        out = (now.ids[at], p, kept[at, p], mine, scores[at, p], score)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["anchor_id", "place", "positive_id", "negative_id", "positive_score", "negative_score"])

    order = W.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = rows.mapInArrow(unlike, "anchor_id long, place long, positive_id long, negative_id long, positive_score long, negative_score long")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)


def mine(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = 100,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of every anchor and positive.

    Anchors are the rows whose id is divisible by ``every``; their positives the best other rows of the same
    label; the negatives of a positive the best rows of other labels that score from low to high percent of
    the positive's score (with a score below 0 there are none). Ties go to smaller ids.

    Rows with a null id or label, or a vector that is null or holds a null or non-finite component, take no
    part. Of vectors of unequal length the missing components count as 0; an empty one scores 0. Rows that repeat
    an anchor's id are its own and neither positives nor negatives of it; of them the one with the least
    label and vector asks. Other repeated rows count each. A score beyond 64 bits counts as the nearest one
    within. Without anchors, positives or negatives there are no rows. Other columns aren't read.
    """
    rows, size = coded(df, id_col, vec_col, label_col, scale)
    anchors = stored(rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("_v")).select("id", "_v.label", "_v.vec"))
    n = anchors.count()
    rounds = max(1, math.ceil(n * size / round_cells(df.sparkSession)))
    parts = (_round(rows, anchors.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == i), size, positives, negatives, low, high) for i in range(rounds))
    return stored_all(parts).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
