"""Small things the operators share: the shared folder, word hashing and safe keys."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import shared_checkpoints

#: A word is a run of characters other than these (space and U+0009 to U+000D).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Stands for a null id in keys; a null id sorts first, as in Spark. A real id of this value counts as null.
NO_ID = -(2**63)
#: Bits of the filters before joins with few keys.
FILTER_BITS = 1 << 22


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there on."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet into the shared folder."""
    spark = df.sparkSession
    shared_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4()}"
    df.write.parquet(path)
    released()  # of what the driver's Python has gathered
    return spark.read.schema(df.schema).parquet(path)


def stored_all(parts: Iterable[DataFrame]) -> DataFrame:
    """The rows of all parts (at least one, of one schema), each computed once and written into one folder; the plan that reads them doesn't grow with their number."""
    path = schema = spark = None
    for i, df in enumerate(parts):
        if path is None:
            spark, schema = df.sparkSession, df.schema
            shared_checkpoints(spark)
            path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4()}"
        df.write.parquet(f"{path}/part={i}")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def _maybe(df: DataFrame, keys: list[str], ids: DataFrame) -> DataFrame:
    """df with _maybe: false where the keys surely are no row of ids, by a broadcast of FILTER_BITS bits."""
    place = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(FILTER_BITS))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), (x % 64).cast("int"))
    at = place(ids.columns)
    bits = ids.select(F.floor(at / 64).alias("_w"), bit(at).alias("_bit")).groupBy("_w").agg(F.bit_or("_bit").alias("_bits"))
    marked = df.withColumn("_at", place(keys)).withColumn("_w", F.floor(F.col("_at") / 64)).join(F.broadcast(bits), "_w", "left")
    return marked.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit(F.col("_at"))) != 0, F.lit(False))).drop("_at", "_w", "_bits")


def among(df: DataFrame, keys: list[str], ids: DataFrame) -> DataFrame:
    """Rows of df whose keys are a row of ids (in its columns' order): a semi-join of those that a filter lets through.

    The filter is made in Spark and has a fixed size; with very many ids it lets all through, and the join decides.
    """
    return _maybe(df, keys, ids).filter("_maybe").drop("_maybe").join(ids.toDF(*keys), keys, "left_semi")


def joined(df: DataFrame, keys: list[str], rows: DataFrame) -> DataFrame:
    """Rows of df with the other columns of rows, whose keys (under the same names) are distinct: a join of those that the filter of among() lets through."""
    return _maybe(df, keys, rows.select(*keys)).filter("_maybe").drop("_maybe").join(rows, keys)


def but_not(df: DataFrame, keys: list[str], ids: DataFrame) -> DataFrame:
    """Rows of df whose keys are no row of ids; only those that the filter of among() can't clear are joined."""
    marked = _maybe(df, keys, ids)
    rest = marked.filter("_maybe").join(ids.toDF(*keys), keys, "left_anti")
    return marked.filter("not _maybe").unionByName(rest).select(*df.columns)


def small_batches(spark: SparkSession, rows: int = 250) -> None:
    """Has Spark hand Python at most ``rows`` rows at once, unless the session says otherwise itself.

    With the default of 10,000, a batch of texts takes more memory outside the heap than the work on it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns k, h, text: a null-free key (id, hash of the text) and the text, null as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"),
        F.xxhash64(text, F.col(id_col).isNull()).alias("h"),
        text.alias("text"),
    )


def real_id(k: Column) -> Column:
    """The id behind a key of keyed()."""
    return F.when(k != F.lit(NO_ID), k)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, text_at: int = 1, chars: int = 4_000_000, rows: int = 2_000):
    """batch in pieces of a bounded number of rows and text bytes (a row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    start, seen = 0, 0
    for i, n in enumerate(size):
        if i > start and (seen + n > chars or i - start >= rows):
            yield batch.slice(start, i - start)
            start, seen = i, 0
        seen += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
    released()


def released() -> None:
    """Gives freed memory back to the system: a worker serves many stages, and what it keeps adds to what the next one needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text: codes into the distinct words, offsets of the texts, the distinct words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    found = lists.flatten().dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = found.dictionary.to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    blank = np.flatnonzero(words == "")
    if len(blank):
        keep = codes != blank[0]
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        codes = codes[keep]
    return codes, ends.astype(np.int64), words


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every text, one after the other, and the offsets of the texts."""
    codes, ends, words = word_codes(texts)
    if not len(codes):
        return np.empty(0, np.uint64), ends
    return pd.util.hash_array(words, categorize=False)[codes], ends


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that their order and low bits look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
