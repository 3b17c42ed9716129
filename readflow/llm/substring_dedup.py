"""Removal of long word passages that an earlier document has.

A window is ``width`` consecutive words of one document; it is removed where the same words start in a
document with a smaller id. Windows are compared by Rabin-Karp hashes (64 bits, over 64-bit hashes of
the words), kept beside the hash of their minimizer, so 128 bits in all decide.

Few windows repeat, so not all of them are shuffled. The minimizer of a window is the smallest hash of
the short grams in it, a function of the window's words: equal windows have equal minimizers. First
only the distinct minimizers of each document are counted (a few per cent of the windows); windows whose
minimizer is found in one document alone can't repeat. The others are hashed and the smallest id of
each hash is found, with partial sums before the shuffle, so that a passage in a third of all documents
is no hot group. What is found goes back to its document, where it merges into maximal intervals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP, NO_ID, WORD, but_not, mixed, slices, stored, word_hashes

WIDTH, GRAM = 50, 8
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]))
        for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``width`` values: sums of h[i + j] * BASE**j modulo 2**64."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    up, down = powers(len(h))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up, dtype=np.uint64)])
    return (sums[width:] - sums[:-width]) * down[: len(h) - width + 1]


def minimizers(h: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The smallest mixed gram hash within each window of ``width`` words."""
    m, have, want = mixed(rolling(h, gram)), 1, width - gram + 1
    while 2 * have <= want:
        m, have = np.minimum(m[:-have], m[have:]), 2 * have
    if have < want:
        m = np.minimum(m[: len(m) - (want - have)], m[want - have :])
    return m


def _texts(batches: Iterator[pa.RecordBatch], at: int):
    """Slices of the batches with the word hashes of each of their texts."""
    for batch in batches:
        for part in slices(batch, at):
            h, ends = word_hashes(part.column(at))
            yield part, [h[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _out(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns], [f"c{i}" for i in range(len(columns))])


def _keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k and h, a null-free key of the row's id and text (null as empty), and row, all columns of df."""
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), F.struct("*").alias("row"))


def repeated_windows(rows: DataFrame, text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """k, h, starts (int array): where the repeated windows of a row of _keys() start.

    Exact copies of an earlier text are all repeated: for them starts is the array of -1 alone. Rows
    with a null id neither give nor lose windows; rows that repeat a key share their windows.
    """
    gram = min(gram, width)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, docs in _texts(batches, 3):
            long = [i for i, d in enumerate(docs) if len(d) >= width]
            found = [np.unique(minimizers(docs[i], width, gram)) for i in long]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            marks = pa.array(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64))
            keys = [part.column(i).take(pa.array(long, pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(ends), marks)], ["k", "h", "g", "marks"])

    text = F.col("row").getField(text_col)
    usable = rows.filter(F.col("k") != F.lit(NO_ID)).select("k", "h", F.hash(text).alias("g"), text.alias("text"))
    docs = stored(usable.mapInArrow(anchors, "k long, h long, g int, marks array<long>"))
    # Copies are told by two hashes of the text; the first of them stands for all.
    first = stored(docs.groupBy("h", "g").agg(F.min("k").alias("first"), F.max("k").alias("last")).filter("first < last").select("h", "g", "first"))
    copies = stored(docs.select("k", "h", "g").join(first, ["h", "g"]).filter("k > first").select("k", "h").distinct())
    marks = but_not(docs.select("k", "h", "marks"), ["k", "h"], copies).select("k", "h", F.explode("marks").alias("mark"))
    shared = marks.groupBy("mark").agg(F.min("k").alias("low"), F.max("k").alias("high")).filter("low < high").select("mark")
    mine = marks.join(shared, "mark").groupBy("k", "h").agg(F.collect_set("mark").alias("marks"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).field(text_col), b.column(3)], ["k", "h", "text", "marks"]) for b in batches)
        for part, texts in _texts(flat, 2):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for k, h, d, known in zip(part.column(0).to_numpy(), part.column(1).to_numpy(), texts, part.column(3), strict=True):
                low = minimizers(d, width, gram)
                here = np.flatnonzero(np.isin(low, known.values.to_numpy().view(np.uint64)))
                for x, y in zip(out, (np.full(len(here), k), np.full(len(here), h), low[here], rolling(d, width)[here], here.astype(np.int32)), strict=True):
                    x.append(y)
            if out[0]:
                yield _out(*[np.concatenate(x) for x in out])

    # Whole rows go in, so that this shuffle of the texts is the one that the caller uses again.
    found = rows.join(mine, ["k", "h"]).select("k", "h", "row", "marks")
    found = found.mapInArrow(windows, "k long, h long, mark long, code long, start int")
    # The lows are dealt out anew, so that the join has a shuffle on either side and a frequent window can be split.
    lows = found.groupBy("mark", "code").agg(F.min("k").alias("low"), F.max("k").alias("high")).filter("low < high").select("mark", "code", "low").repartition("low")
    later = found.join(lows, ["mark", "code"]).filter("k > low")
    return later.groupBy("k", "h").agg(F.collect_list("start").alias("starts")).unionByName(copies.withColumn("starts", F.array(F.lit(-1))))


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal half-open word intervals that the windows cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + width).tolist(), strict=True))


_word = re.compile(WORD)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text less the words of the intervals, each with the gap that follows it."""
    at = [m.start() for m in _word.finditer(text)] + [len(text)]
    keep, upto = [], 0
    for a, b in spans:
        keep.append(text[upto : at[a]])
        upto = at[b]
    return "".join([*keep, text[upto:]])


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """df with text_col less its repeated passages, and removed: the word intervals that went.

    A null text stays null, a short one as it is; removed is then empty. Rows with a null id stay as they
    are. Rows of one id don't take words from each other, so repeated rows stay. Windows are judged on the
    input, not on what is left. Kept words keep the gaps between them. Texts count whole; a task holds the
    windows of one slice of texts, or of one very long text. An empty table stays empty. All other columns
    stay as they are, whatever their names; one named removed gives way to the result's.
    """
    rows = _keys(df, id_col, text_col)
    found = rows.join(repeated_windows(rows, text_col, width, gram), ["k", "h"], "left")

    @F.pandas_udf("text string, removed array<struct<start:int,end:int>>")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for text, x in zip(texts, starts, strict=True):
            if x is None:
                out.append((None, []))
                continue
            x = np.unique(np.asarray(x, np.int64))
            spans = [(0, len(_word.findall(text)))] if x[0] < 0 else intervals(x, width)
            out.append((without(text, spans), [{"start": a, "end": b} for a, b in spans]))
        return pd.DataFrame(out, columns=["text", "removed"])

    # Texts that lose nothing don't go to Python.
    lost, own = F.col("starts").isNotNull(), lambda c: F.col("row").getField(c)
    found = found.withColumn("cut", cut(F.when(lost, own(text_col)), F.col("starts")))
    kept = [(F.when(lost, F.col("cut.text")).otherwise(own(c)) if c == text_col else own(c)).alias(c) for c in df.columns if c.lower() != "removed"]
    return found.select(*kept, F.col("cut.removed").alias("removed"))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words (before), n_removed, kept_sha256 of what dedup_substrings() returns."""
    kept = F.filter(F.split(F.coalesce(text_col, F.lit("")), GAP), lambda x: x != "")
    gone = F.aggregate("removed", F.lit(0), lambda s, x: s + x["end"] - x["start"]).cast("long")
    return df.select(id_col, (F.size(kept) + gone).cast("long").alias("n_words"), gone.alias("n_removed"), F.sha2(F.array_join(kept, " "), 256).alias("kept_sha256"))

