"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """v, c: every vertex of the links (a, b; long) but the components' smallest, and that smallest one.

    Each round hangs neighbours below the smallest vertex that they see, first from above, then from
    below, until nothing moves. Minima are partial sums and a hub's rows are joined, not gathered, so a
    hub needs no task that holds all its links. Rounds are written to the shared folder. Every round but the
    last moves an edge to a smaller vertex, so the rounds end; their number grows with the logarithm of a path.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        # Large star: every greater neighbour of u goes below the smallest of u and its neighbours.
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go below the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("v"), F.col("v").alias("c"))
