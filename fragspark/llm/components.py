"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node tells its larger neighbours of the smallest node that it sees (itself included)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v")))


def _joined_up(batches):
    """(node, root) for every node of all the edges (u, v)."""
    least, kind = {}, None

    def top(x):
        while (up := least.setdefault(x, x)) != x:
            least[x] = x = least[up]
        return x

    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(u), top(v)
            least[max(a, b)] = min(a, b)
    if least:
        nodes = list(least)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(map(top, nodes), kind)], names=["node", "root"])


def components(edges: DataFrame, most_rounds: int = 100, at_once: int = 0) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; root is the smallest node it can reach.

    Links stay in Spark; only the count and a checksum of each round reach the driver. The number
    of rounds grows with the logarithm of the longest chain. Loops and repeated edges are allowed. Up to
    ``at_once`` edges are joined up by one task instead, so that they take no rounds, whose plans and tasks
    the driver would keep.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), few=True)
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = print_of(edges)
    if 0 < seen[0] <= at_once:
        kind = edges.schema["u"].dataType.simpleString()
        return cut(edges.coalesce(1).mapInArrow(_joined_up, f"node {kind}, root {kind}"))
    for _ in range(most_rounds):
        if not seen[0]:
            break
        edges = cut(_small_star(_large_star(edges).distinct()).distinct(), few=True)
        now = print_of(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
