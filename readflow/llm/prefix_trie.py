"""The trie of all prefixes of conversations, by collapsing whole sequences.

A turn is 128 bits of hash of its role and text, a prefix the exclusive or of its turns' hashes with their places:
128 bits and a depth decide which prefixes are equal. Texts are hashed where they are read and never shuffled.

1. Conversations of equal whole sequences become one weighted sequence with a list of those that end there.
2. Sequences that are proper prefixes of others go by an anti-join; what stays are the leaves.
3. Only leaves are taken apart into prefixes. A node belongs to the smallest leaf below it, and a leaf owns its
   sequence from some depth on down, so a sum over a node's subtree is a sum over the leaves below it of running
   sums along each of them: every node, and every end, counts once, where it is owned. The rows are as many as the
   turns of the leaves; no pairs of nodes and ancestors are made.

Running values along a sequence are worked in blocks of BLOCK turns, so a conversation that holds a large part
of all turns is no single task; its turns are ordered by ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored

#: Turns of a sequence that one task works through, and conversations in a part of an end list.
BLOCK, LISTED = 4096, 4096
NODE = ["depth", "x1", "x2"]
#: Running aggregates: the aggregate, and how the value of the blocks before joins that of the own block.
RUNS = {
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(F.coalesce(b, F.lit(0).cast("long")))),
    "sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0).cast("long"))),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(df: DataFrame, key: str, at: str, size: str, runs: dict[str, tuple[str, str]], down: bool = False) -> DataFrame:
    """df with running aggregates (new column: kind, column) along ``at`` (1 to size, unique) inside each key, or from its end."""
    blocked = df.withColumn("_block", F.when(F.col(size) > BLOCK, F.floor((F.col(at) - 1) / BLOCK)).otherwise(0))
    order = F.desc if down else F.asc
    near = W.partitionBy(key, "_block").orderBy(order(at)).rowsBetween(W.unboundedPreceding, 0)
    beyond = W.partitionBy(key).orderBy(order("_block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocked.filter(F.col(size) > BLOCK).groupBy(key, "_block").agg(*[RUNS[kind][0](col).alias(f"_{new}") for new, (kind, col) in runs.items()])
    carried = blocks.select(key, "_block", *[RUNS[kind][0](f"_{new}").over(beyond).alias(f"_{new}") for new, (kind, _) in runs.items()])
    own = blocked.withColumns({new: RUNS[kind][0](col).over(near) for new, (kind, col) in runs.items()})
    both = own.join(carried, [key, "_block"], "left")
    return both.withColumns({new: RUNS[kind][1](F.col(new), F.col(f"_{new}")) for new, (kind, _) in runs.items()}).drop("_block", *[f"_{new}" for new in runs])


def turns_of(df: DataFrame) -> DataFrame:
    """c, at (from 1), t1, t2, words: the turns of conversations (conv_id, turn, role, text) in order, without their texts.

    A null turn comes first; equal turns are ordered by the hash of role and text, so repeated rows are turns
    each. A null role or text is empty. Rows without a conv_id are no conversation's and go.
    """
    said = [F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text")]
    slim = df.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), F.xxhash64(*said).alias("t1"), F.xxhash64(F.lit("second"), *said).alias("t2"),
        F.regexp_count(said[1], F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    # Ranges split even a conversation that is most of the table; few of them share a conversation.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("turn"), "t1", "t2", "row"]
    ranged = stored(slim.repartitionByRange(parts, "c", *order).withColumn("part", F.spark_partition_id()))
    of = ranged.groupBy("c", "part").agg(F.count("*").alias("n"))
    before = of.select("c", "part", F.sum("n").over(W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    placed = ranged.withColumn("near", F.row_number().over(W.partitionBy("c", "part").orderBy(*order)))
    # Only a range that starts amid a conversation has rows before it: no more rows than ranges.
    whole = placed.join(F.broadcast(before.filter("before is not null")), ["c", "part"], "left")
    return whole.select("c", (F.col("near") + F.coalesce("before", F.lit(0))).cast("long").alias("at"), "t1", "t2", "words")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 3, share: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, n) and turns (c, at, n, t1, t2, words) rebuilt: each begins as the first of its group does.

    share: how many turns (at most ``most``) conversation c takes from conversation c - c % group, if that exists and
    has as many, in place of as many of its own; by default the checksum of its number says it.
    """
    head = F.col("c") - F.col("c") % group
    share = F.crc32(F.col("c").cast("string").cast("binary")) % (most + 1) if share is None else share
    turns = stored(turns)
    convs = turns.groupBy("c").agg(F.count("*").alias("own")).withColumns({"head": head, "share": share})
    taken = F.sort_array(F.collect_list(F.struct("at", "t1", "t2", "words")))
    heads = turns.filter((F.col("at") <= most) & (F.col("c") % group == 0)).groupBy(F.col("c").alias("head")).agg(taken.alias("begun"))
    begun = F.slice(F.coalesce("begun", F.array().cast(heads.schema["begun"].dataType)), F.lit(1), F.col("share").cast("int"))
    convs = convs.join(heads, "head", "left").withColumn("begun", begun).withColumn("n", F.size("begun") + F.greatest(F.lit(0), F.col("own") - F.col("share")))
    convs = stored(convs.select("c", "share", "begun", F.col("n").cast("long").alias("n")))
    later = turns.join(convs, "c").filter("at > share").withColumn("at", F.size("begun") + F.col("at") - F.col("share"))
    cols = ["c", "at", "n", "t1", "t2", "words"]
    first = convs.select("c", "n", F.inline("begun")).select(*cols)
    return convs.select("c", "n"), later.withColumn("at", F.col("at").cast("long")).select(*cols).unionByName(first)


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, x1, x2, ends_sha256: the digest of the comma-joined ascending c of each node that has ends.

    Lists are joined in parts of bounded size, by ranges, and the parts of a node hashed one after the other, so no
    list is held whole.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.select(*NODE, "c").repartitionByRange(parts, *NODE, "c").sortWithinPartitions(*NODE, "c")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in cols[:3]], axis=0)
            starts = np.unique(np.concatenate([np.flatnonzero(new), np.arange(0, batch.num_rows, LISTED)]))
            text = [",".join(map(str, x.tolist())) for x in np.split(cols[3], starts[1:])] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*(pa.array(x[starts]) for x in cols), pa.array(text, pa.string())], [*NODE, "c", "ids"])

    joined = ranged.mapInArrow(join, "depth long, x1 long, x2 long, c long, ids string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for batch in batches:
            for *now, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if now == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = now, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)
            out = []
        if node:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*node, sha.hexdigest()), strict=True))], schema)

    schema = pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())])
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "c").mapInArrow(digest, "depth long, x1 long, x2 long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie of conversations (c, n) with turns (c, at, n, t1, t2, words), and which end where.

    Nodes: depth, x1, x2 (their key), conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. Ends:
    depth, x1, x2, c. A conversation without turns ends at the root; without conversations there are no nodes.
    """
    hashed = turns.withColumns({"g1": F.xxhash64("at", "t1", "t2"), "g2": F.xxhash64(F.lit("second"), "at", "t1", "t2")})
    coded = stored(running(hashed, "c", "at", "n", {"x1": ("xor", "g1"), "x2": ("xor", "g2")}).select("c", F.col("at").alias("depth"), "n", "x1", "x2", "g1", "g2", "words"))
    zero = F.lit(0).cast("long")
    empty = convs.filter("n = 0").select("c", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"))
    ends = stored(coded.filter("depth = n").select("c", *NODE).unionByName(empty))
    # Whole sequences, weighted; then the turns of one conversation for each.
    whole = stored(ends.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("c").alias("low")))
    rows = coded.join(whole.select(F.col("low").alias("c")), "c", "left_semi")
    inner = rows.filter("depth < n").select(*NODE).unionByName(whole.filter("depth > 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"))).distinct()
    leaves = stored(whole.join(inner, NODE, "left_anti").select(F.col("low").alias("leaf"), F.col("depth").alias("n")))
    root = leaves.select("leaf", zero.alias("depth"), "n", zero.alias("x1"), zero.alias("x2"), zero.alias("p1"), zero.alias("p2"), zero.alias("words"))
    path = rows.join(leaves.select(F.col("leaf").alias("c")), "c", "left_semi").select(
        F.col("c").alias("leaf"), "depth", "n", "x1", "x2", F.col("x1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("g2")).alias("p2"), "words"
    )
    path = stored(path.unionByName(root).withColumns({"at": F.col("depth") + 1, "size": F.col("n") + 1}))
    nodes = stored(path.groupBy(*NODE).agg(F.min("leaf").alias("leaf"), F.count("*").alias("n_leaves"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words")))
    # Ends count at the leaf that owns their node, and so do the tokens that a node saves.
    own = whole.join(nodes, NODE).select("leaf", "depth", "weight", "low")
    below = running(path.join(own, ["leaf", "depth"], "left").withColumn("weight", F.coalesce("weight", zero)), "leaf", "at", "size", {"n_convs": ("sum", "weight"), "conv_id": ("min", "low")}, down=True)
    sized = below.groupBy(*NODE).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = stored(nodes.join(sized, NODE).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))
    below = running(path.join(nodes.select("leaf", "depth", "saved"), ["leaf", "depth"], "left").withColumn("saved", F.coalesce("saved", zero)), "leaf", "at", "size", {"saved_tokens": ("sum", "saved")}, down=True)
    saved = below.groupBy(*NODE).agg(F.sum("saved_tokens").alias("saved_tokens"))
    above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    children = nodes.filter("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(saved, NODE).join(children, NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
    return out.select(*NODE, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens"), ends


def nodes_with_ends(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of trie(), with ends_sha256 instead of their key: a row per distinct prefix of conversations."""
    nodes, ends = trie(convs, turns)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    told = nodes.join(ends_digests(ends), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
