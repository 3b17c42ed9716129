"""Reply trees to formatted conversations.

Messages name their parent. Iterative self-joins enumerate the root-to-leaf paths: in each round every
path doubles its length by the ancestors twice as far up, so a tree of depth d takes log2(d) rounds, on
ids alone. Branches are ranked by their mean score; a chosen path becomes one text.

Template: ``<|start|>role<|text|>text<|end|>`` and a newline per turn. In roles and texts a backslash
is doubled and every control string, of this template or of other common ones, gets a backslash after its
first character, so no text can end a turn, and the reader takes one backslash off again. The loss mask
is a list of spans (code points) over the formatted text: the texts of the assistant's turns.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, checkpointed

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>\n"
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_turn = re.compile(r"<\|start\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.DOTALL)
_slash = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for x in CONTROLS:
        text = text.replace(x, f"{x[0]}\\{x[1:]}")
    return text


def unescape(text: str) -> str:
    return _slash.sub(r"\1", text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{TEXT}", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(a), unescape(b)) for a, b in _turn.findall(formatted)]


def replies(rows: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each replies to the one before.

    Turns that are equal are ordered by role, then text, so repeated rows are turns of their own; a null turn
    comes first. A null conv_id is a conversation of its own, null roles and texts are empty. An empty table
    has no messages. Other columns, whatever their names, aren't read.
    """
    tree = F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID))
    named = rows.select(tree.alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    node = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return named.select("tree", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """tree, leaf, node, up: the nodes of each root-to-leaf path, up steps above its leaf.

    messages: tree, node, parent. A parent that the tree lacks counts as none. Messages in a cycle are on
    no path. Repeated nodes count once.
    """
    nodes = messages.groupBy("tree", "node").agg(F.min("parent").alias("parent"))
    known = nodes.select("tree", F.col("node").alias("parent"))
    links = checkpointed(nodes.select("tree", "node", "parent").join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("above")))
    leaves = nodes.join(links.select("tree", F.col("above").alias("node")), ["tree", "node"], "left_anti")
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    jumps, reach = links, 1
    size = nodes.count()
    for _ in range(math.ceil(math.log2(size + 1)) + 1 if size else 0):
        if jumps.isEmpty():
            break
        further = found.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + reach).alias("up"))
        found = checkpointed(found.unionByName(further))
        over = jumps.select("tree", F.col("node").alias("above"), F.col("above").alias("over"))
        jumps, reach = checkpointed(jumps.join(over, ["tree", "above"]).select("tree", "node", F.col("over").alias("above"))), 2 * reach
    # A path is whole if it ends in a root; what hangs on a cycle never does.
    whole = found.join(links, ["tree", "node"], "left_anti").select("tree", "leaf").distinct()
    return found.join(whole, ["tree", "leaf"], "left_semi")


def ranked(messages: DataFrame, found: DataFrame, keep: int | None = None) -> DataFrame:
    """tree, leaf, score, rank: the paths of each tree by mean score, ties to the smaller leaf; the first keep."""
    scores = messages.groupBy("tree", "node").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    of = found.join(scores, ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    place = of.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    return place if keep is None else place.filter(F.col("rank") <= keep)


def format_paths(messages: DataFrame, keep: int | None = None, learn: str = "assistant") -> DataFrame:
    """tree, leaf, rank, n_turns, formatted, loss (spans) of the best paths of each tree (all by default).

    messages: tree, node, parent, role, text, score (null roles and texts count as empty, a null score as 0). Of
    a node's repeated rows the first by role and text counts; branches of equal scores go by their leaf. A
    conversation is one text, so its turns meet in one row, however long; nothing else is gathered. Without
    messages there are no rows.
    """
    found = paths(messages)
    best = ranked(messages, found, keep)
    said = messages.groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("said"))
    turns = found.join(best, ["tree", "leaf"]).join(said, ["tree", "node"])
    listed = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "said.role", "said.text"))).alias("turns"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                text, spans = render([(x["role"], x["text"]) for x in row.turns], learn)
                out.append((row.tree, row.leaf, row.rank, len(row.turns), text, [{"start": a, "end": b} for a, b in spans]))
            yield pd.DataFrame(out, columns=["tree", "leaf", "rank", "n_turns", "formatted", "loss"])

    return listed.mapInPandas(make, "tree long, leaf long, rank int, n_turns long, formatted string, loss array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the formatted texts."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tree, text, loss in zip(pdf["tree"], pdf["formatted"], pdf["loss"], strict=True):
                turns = parse(text)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                learnt = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
                out.append((None if tree == NO_ID else tree, len(turns), said, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return formatted.select("tree", "formatted", "loss").mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows and conversation -7, whose two turns hold another template's control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)
