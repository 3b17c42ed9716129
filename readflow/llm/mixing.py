"""Mixing sources to target weights, in DataFrame functions alone.

Targets: ``epochs`` times the size of everything is shared among the sources by weight; no source gets
more than ``most`` times its own size and what is left over goes to the others by weight. Selection:
a source first takes all its documents as often as its target allows. For the rest, Efraimidis-Spirakis
sampling: a document's key is -ln(u) / quality, u a hash of the document, so that the smallest keys are
a weighted sample without replacement; documents in order of their keys fill what is left of the budget.

No source is sorted whole. The keys of n documents fall into about the root of n bins of as many documents;
bins before the one in which a source's budget ends are taken whole, and only that bin is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpointed

PATTERN = (5.0, 2.0, 1.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = PATTERN, epochs: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from rows (source, source_size), one per source.

    The weights repeat over the sources by code point, null last. One row per source is all that is
    sorted. The level at which weight * level is below the cap for just the right sources is found by
    going through them by cap / weight: with those before at their cap, the rest share by weight.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumns({"weight": w, "cap": F.col("source_size") * F.lit(float(most))})
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("share", (F.sum("source_size").over(every) * F.lit(float(epochs)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # The first source whose share is below its cap sets the level; those before it are at their caps.
    free = F.col("share") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("share").alias("share")))).over(every)["share"]
    target = F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return rows.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def mix(sized: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", quality_col: str | None = None, weights: tuple[float, ...] = PATTERN, epochs: float = 1.5, most: float = 2.0, seed: int = 7, tie: Column | None = None) -> DataFrame:
    """sized with the columns source_size, target and times: how often the mix takes the row.

    A null source is a source of its own; a null or negative size counts as 0, a quality that is null
    or not above 0 as 1. Rows of a size of 0 are taken with the complete epochs only. Equal rows have equal keys and one
    size, so which of them is taken makes no difference. Documents with equal keys are taken by id, then by size, a
    null id first. Reruns agree. A document counts whole, however long. An empty table stays empty. Other columns stay
    as they are, whatever their names; those named as the three new ones give way to them. sized is read twice; give
    it from a shuffle or a written table if it is costly.
    """
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    quality = F.lit(1.0) if quality_col is None else F.when(F.col(quality_col) > 0, F.col(quality_col).cast("double")).otherwise(1.0)
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), size, tie if tie is not None else F.lit(0), F.lit(seed)), 11) + F.lit(0.5)) * F.lit(0.5**53)
    own = [c for c in sized.columns if c.lower() not in ("source_size", "target", "times")]
    rows = sized.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), size.alias("_size"), (-F.ln(u) / quality).alias("_key"))
    by_source = rows.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("_rows"))
    goal = targets(by_source.select(F.col("_source").alias("source"), "source_size"), weights, epochs, most)
    goal = _join(by_source.select("_source", "_rows"), goal.withColumnRenamed("source", "_goal"), "_source", "_goal")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(0)
    bins = F.greatest(F.lit(1), F.ceil(F.sqrt("_rows")))
    goal = goal.select("_source", "source_size", "target", full.alias("_full"), bins.alias("_bins"))
    goal = goal.withColumn("_left", F.greatest(F.lit(0.0), F.col("target") - F.col("_full") * F.col("source_size")))
    placed = _join(rows, goal.withColumnRenamed("_source", "_goal"), "_source", "_goal")
    # exp(-key) is uniform for a quality of 1: bins in the order of the keys.
    placed = placed.withColumn("_bin", F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * F.col("_bins")))
    filled = placed.groupBy("_source", "_bin").agg(F.sum("_size").alias("_in"), F.first("_left").alias("_left"))
    order = W.partitionBy("_source").orderBy("_bin")
    upto = F.sum("_in").over(order)
    # The bin where the budget ends, and what the bins before it leave of the budget.
    ends = filled.withColumn("_upto", upto).filter((F.col("_upto") > F.col("_left")) & (F.col("_upto") - F.col("_in") <= F.col("_left")))
    ends = ends.groupBy("_source").agg(F.min("_bin").alias("_end"), F.min_by(F.col("_left") - (F.col("_upto") - F.col("_in")), "_bin").alias("_rest"))
    placed = _join(placed, ends.withColumnRenamed("_source", "_ended"), "_source", "_ended", "left")
    whole, split = F.col("_end").isNull() | (F.col("_bin") < F.col("_end")), F.col("_bin") == F.col("_end")
    sure = placed.filter(~F.coalesce(split, F.lit(False))).withColumn("_more", (whole & (F.col("_left") > 0)).cast("long"))
    inside = W.partitionBy("_source").orderBy("_key", "_id", "_size").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = placed.filter(split).withColumn("_run", F.sum("_size").over(inside))
    # The document that crosses the end is taken if that comes nearer to the target.
    cut = cut.withColumn("_more", (F.col("_run") - F.col("_size") / 2 < F.col("_rest")).cast("long")).drop("_run")
    out = sure.unionByName(cut)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in own], "source_size", "target", (F.col("_full") + F.when(F.col("_full") < F.floor(F.lit(most)), F.col("_more")).otherwise(0)).cast("long").alias("times"))


def _join(left: DataFrame, right: DataFrame, a: str, b: str, how: str = "inner") -> DataFrame:
    """left with the columns of right, which has one row per source; null joins null."""
    return left.join(right, F.col(a).eqNullSafe(F.col(b)), how).drop(b)


def sized_documents(df: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, text_hash, size (words of the text, null 0) and quality of every row, written to the shared folder.

    quality is 2 for documents labelled good, 0.5 for bad, else 1; of several labels the best counts.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_hash"), size.alias("size"))
    if labels is not None:
        best = labels.filter("quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.when(F.max("quality") > 0, 2.0).otherwise(0.5).alias("quality"))
        sized = sized.join(best, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    else:
        sized = sized.withColumn("quality", F.lit(1.0))
    return checkpointed(sized.withColumn("quality", F.coalesce("quality", F.lit(1.0))))


def mix_documents(df: DataFrame, labels: DataFrame | None, **options) -> DataFrame:
    """The rows of df as often as the mix takes them. df has the columns doc_id, text and source.

    Null ids, texts and sources are as in mix(); rows with one id and text share what the mix takes of them, so
    the rows that come out are the same on every run. All columns stay as they are, whatever their names.
    """
    sized = sized_documents(df, labels)
    times = mix(sized, quality_col="quality", tie=F.col("text_hash"), **options)
    times = times.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.sum("times").alias("_times"), F.count("*").alias("_same"))
    rows = df.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_k"), F.xxhash64("text").alias("_h"))
    both = rows.join(times, F.col("_k").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    place = F.when(F.col("_same") == 1, F.lit(1)).otherwise(F.row_number().over(W.partitionBy("_id", "_hash").orderBy("_h")))
    share = F.floor(F.col("_times") / F.col("_same")) + (place <= F.col("_times") % F.col("_same")).cast("int")
    out = both.withColumn("_share", share.cast("int")).filter("_share > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_share")))).select("_row.*")
