"""Exact top-k by inner product: global histograms of the scores are refined until they give each kth value.

Vectors become integers floor(scale * x) and are written once. Queries are taken in rounds of bounded size:
a round's queries are broadcast and pass by all vectors, which stay where they are, so nothing but
histograms and results is shuffled. A first pass counts each query's scores in coarse bins, a second one in
bins of width 1 within the bin that holds its kth score (more passes if the coarse bins are wide). The last
pass keeps the scores above the kth and, of those equal to it, the smallest ids. A task sends only what can
matter: bins from its own best down to its own kth.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, stored_all

#: Numbers in the queries of a round, and scores that a task holds at once.
QUERY_CELLS, SCORE_CELLS = 1 << 22, 1 << 21
#: Width of the first bins and how much finer each pass is, as powers of 2.
FIRST, FINER = 9, 10
LONG, NONE = 2**63 - 1, -(2**63)


def round_cells(spark: SparkSession) -> int:
    """Numbers in the queries of a round: a 64th of an executor's memory, or QUERY_CELLS if that is more."""
    given = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get("spark.executor.memory", "1g").strip().lower())
    number = int(given[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[given[2]] if given else 0
    return max(QUERY_CELLS, number >> 9)  # 8 bytes each


def matrix(vecs: pa.ListArray, width: int = 0) -> np.ndarray:
    """Vectors as rows; missing components are 0. Wider than the longest vector if width asks for it."""
    n = pc.list_value_length(vecs).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vecs), max(width, n.max(initial=0))))
    row = np.repeat(np.arange(len(vecs)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = vecs.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, whole numbers; beyond 64 bits the nearest within."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(w, 1) < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in v] for v in a], [[int(x) for x in v] for v in b]
    return np.array([[min(LONG, max(-LONG, sum(map(int.__mul__, x, y)))) for y in whole[1]] for x in whole[0]], np.int64).reshape(len(a), len(b))


def first_of(row: np.ndarray, order: list[np.ndarray], n: np.ndarray, k: int) -> np.ndarray:
    """Places of the entries that belong to the first k of their row, by order; an entry counts n times."""
    at = np.lexsort((*order[::-1], row))
    row, n = row[at], n[at]
    upto = np.cumsum(n) - n
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, int)
    begun = np.repeat(upto[starts], np.diff(np.append(starts, len(row))))
    return at[upto - begun < k]


class Round:
    """The queries of a round, and for each the bin of its kth score so far (width 2**shift); none before the first pass."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int, shift: int | None = None, low: np.ndarray | None = None):
        self.ids, self.vecs, self.k, self.shift, self.low = ids, vecs, k, shift, low

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First query, scores and candidates' ids of each part of the batch; NONE where a row is the query's own."""
        widest = pc.max(pc.list_value_length(batch.column(1))).as_py() or 1
        rows = max(1, QUERY_CELLS // widest)
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            ids, vecs = part.column(0).to_numpy(), matrix(part.column(1))
            step = max(1, SCORE_CELLS // len(ids))
            for q in range(0, len(self.ids), step):
                s = products(self.vecs[q : q + step], vecs)
                s[self.ids[q : q + step, None] == ids[None, :]] = NONE
                yield q, s, ids

    def _kth(self, s: np.ndarray) -> np.ndarray:
        """The kth greatest of each row, or its least."""
        k = min(self.k, s.shape[1])
        return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]

    def counted(self, batches: Iterator[pa.RecordBatch], shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries' places, bins of width 2**shift within the known bin, and counts: the best down to the kth."""
        row, bins, n = (np.empty(0, np.int64) for _ in range(3))
        for batch in batches:
            for q, s, _ in self.scores(batch):
                if self.low is not None:
                    s[(s >> self.shift) != self.low[q : q + len(s), None]] = NONE
                b = np.where(s == NONE, NONE, s >> shift)
                r, c = np.nonzero((b != NONE) & (b >= self._kth(b)[:, None]))
                both, times = np.unique(np.stack([r + q, b[r, c]]), axis=1, return_counts=True)
                row, bins, n = np.concatenate([row, both[0]]), np.concatenate([bins, both[1]]), np.concatenate([n, times])
            both, at = np.unique(np.stack([row, bins]), axis=1, return_inverse=True)
            row, bins, n = both[0], both[1], np.bincount(at.ravel(), weights=n).astype(np.int64)
            keep = first_of(row, [-bins], n, self.k)
            row, bins, n = row[keep], bins[keep], n[keep]
        return row, bins, n

    def best(self, batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries' places, ids and scores of the k best from the known score on, ties to smaller ids."""
        row, ids, score = (np.empty(0, np.int64) for _ in range(3))
        for batch in batches:
            for q, s, mine in self.scores(batch):
                r, c = np.nonzero((s != NONE) & (s >= self.low[q : q + len(s), None]))
                row, ids, score = np.concatenate([row, r + q]), np.concatenate([ids, mine[c]]), np.concatenate([score, s[r, c]])
            keep = first_of(row, [-score, ids], np.ones(len(row), np.int64), self.k)
            row, ids, score = row[keep], ids[keep], score[keep]
        return row, ids, score


def _kth(hist: DataFrame, want: Column, k: int) -> DataFrame:
    """query_id, bin, need: the bin that holds each query's kth score, and how many of it are needed.

    hist: query_id, bin, n and want, the number to go (null: k). With fewer in all it is the lowest bin, whole.
    """
    run = hist.groupBy("query_id", "bin").agg(F.sum("n").alias("n"), F.first("want").alias("want")).withColumn("want", F.coalesce(want, F.lit(k)))
    down = W.partitionBy("query_id").orderBy(F.desc("bin"))
    run = run.withColumn("upto", F.sum("n").over(down))
    last = F.row_number().over(W.partitionBy("query_id").orderBy("bin")) == 1
    hit = (F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want"))
    run = run.withColumns({"hit": hit, "short": last & (F.col("upto") < F.col("want"))}).filter("hit or short")
    return run.select("query_id", "bin", F.when(F.col("hit"), F.col("want") - (F.col("upto") - F.col("n"))).otherwise(F.col("n")).cast("long").alias("need"))


def _round(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score of a round's queries."""
    sc = rows.sparkSession.sparkContext
    known = queries.toArrow().sort_by("id").combine_chunks()  # QUERY_CELLS numbers or so
    ids, vecs = known["id"].to_numpy(), matrix(known["vec"].combine_chunks())
    need = np.full(len(ids), k)
    now, shift = Round(ids, vecs, k), FIRST
    while True:
        shared, wants = sc.broadcast(now), need

        def histogram(batches: Iterator[pa.RecordBatch], shared=shared, shift=shift, wants=wants) -> Iterator[pa.RecordBatch]:
            row, bins, n = shared.value.counted(batches, shift)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shared.value.ids[row], bins, n, wants[row])], ["query_id", "bin", "n", "want"])

        hist = rows.mapInArrow(histogram, "query_id long, bin long, n long, want long")
        found = _kth(hist, F.col("want"), k).toArrow()  # a row per query of the round
        at = np.searchsorted(ids, found["query_id"].to_numpy())
        low, need = np.full(len(ids), LONG), np.zeros(len(ids), np.int64)
        low[at], need[at] = found["bin"].to_numpy(), found["need"].to_numpy()
        now = Round(ids, vecs, k, shift, low)
        if not shift:
            break
        shift = max(0, shift - FINER)
    shared = sc.broadcast(now)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, mine, score = shared.value.best(batches)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shared.value.ids[row], mine, score)], ["query_id", "id", "score"])

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = rows.mapInArrow(select, "query_id long, id long, score long")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def topk(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """query_id, rank, id_col, score: for every row whose id is divisible by ``every`` the k best other rows.

    Ties go to smaller ids. Rows with a null id, or a vector that is null or holds a null or non-finite
    component, take no part. Of vectors of unequal length the missing components count as 0. Rows that
    repeat a query's id are its own and no candidates of it; other repeated rows are candidates each.
    A score beyond 64 bits counts as the nearest one within. Without queries or candidates there are no
    rows. Other columns, whatever their names, aren't read.
    """
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    usable = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter("id is not null and vec is not null")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = stored(usable.filter(fine).select("id", F.transform("vec", lambda x: F.floor(x * F.lit(scale)).cast("double")).alias("vec")))
    # Of a query's rows the one with the least vector asks.
    queries = stored(rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec")))
    n, width = queries.agg(F.count("*"), F.max(F.size("vec"))).first()
    rounds = max(1, math.ceil(n * max(1, width or 1) / round_cells(df.sparkSession)))
    parts = (_round(rows, queries.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == i), k) for i in range(rounds))
    return stored_all(parts).select("query_id", "rank", F.col("id").alias(id_col), "score")
