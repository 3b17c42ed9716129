"""Token counts of a byte-level BPE vocabulary, by merging alone: no identifiers are made.

A text is cut into pieces by the vocabulary's pattern. The bytes of a piece are symbols in a linked
list; the adjacent pair of the lowest rank (leftmost first) is popped from a heap and merged until no
pair has a rank. The piece's count is its bytes less the merges. Pieces repeat, so each Python worker
keeps the counts it has found, in a table of bounded size. The job has no shuffle.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed pattern of the vocabulary, with the white space of Unicode spelt out.
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Counts that a worker keeps before it starts anew.
KEPT = 1_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def count_symbols(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left after all merges."""
    n = len(symbols)
    if n < 2:
        return n
    symbols = list(symbols)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j < 0 or symbols[j] != b:
            continue  # one of the two has merged meanwhile
        merges += 1
        symbols[i], symbols[j] = a + b, ""
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get((a + b, symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, a + b, symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], a + b))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], a + b))
    return n - merges


class Counter(dict):
    """Piece -> count; a miss is merged and kept."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (tuple(x) if isinstance(x, list) else tuple(x.split(" ", 1)) for x in spec["model"]["merges"])
        self.ranks = {x: i for i, x in enumerate(pairs)}
        self.letters = byte_letters()
        self.pieces = regex.compile(PIECE).findall
        special = [x["content"] for x in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = special

    def __missing__(self, piece: str) -> int:
        n = count_symbols([self.letters[b] for b in piece.encode()], self.ranks)
        if len(piece) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = n
        return n

    def plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.pieces(text)))

    def count(self, text: str) -> int:
        """Tokens of text; a special string inside it is one token, as the library takes it."""
        if self.special and any(x in text for x in self.marks):
            parts = self.special.split(text)
            return sum(map(self.plain, parts)) + len(parts) - 1
        return self.plain(text)


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of df.

    path is a vocabulary file of the tokenizers library (byte-level BPE) that every worker can read.
    A null text counts as empty: 0 bytes, 0 tokens. Rows repeat as they come, equal ones with equal counts; an empty
    table gives none. Texts count whole; a run of letters in a very long one is merged in time that grows with its
    length times its logarithm. Other columns, whatever their names, aren't read.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in batches:
            texts = batch.column(1)
            n = pa.array([tokens.count(x.as_py()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.compute.binary_length(texts).cast(pa.int64())], ["id", "n", "size"])

    id_type = rows.schema[0].dataType.simpleString()
    found = rows.mapInArrow(count, f"id {id_type}, n long, size long")
    return found.select(F.col("id").alias(id_col), F.col("size").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
