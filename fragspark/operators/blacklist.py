"""Blacklists: which fragments to drop, and how much of a window is masked."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import int_div
from . import intervals


class Strategy(Enum):
    ANY = "any"
    ALL = "all"
    MIDPOINT = "midpoint"
    PROPORTION = "proportion"


def prepare(*lists: DataFrame, min_size: int = 1, halo: int = 0) -> DataFrame:
    """Lists as one: short intervals go, a halo is added on both sides, touching and overlapping ones merge."""
    every = lists[0].select("chrom", "start_pos", "end_pos")
    for more in lists[1:]:
        every = every.unionByName(more.select("chrom", "start_pos", "end_pos"))
    sized = every.where(F.col("end_pos") - F.col("start_pos") >= min_size)
    return intervals.merge(sized.withColumn("start_pos", F.greatest(F.lit(0), F.col("start_pos") - halo)).withColumn("end_pos", F.col("end_pos") + halo))


#: Bins of a merged blacklist that are broadcast at most, each with its few intervals.
MOST_BROADCAST = 200_000


def drop(frags: DataFrame, blacklist: DataFrame, how: Strategy = Strategy.ANY, proportion: float = 0.5, width: int = intervals.BIN) -> DataFrame:
    """Fragments that the merged blacklist does not hit.

    any: a shared base; all: one interval holds the fragment; midpoint: a central base (both of an even
    length) is hit; proportion: at least that share of the fragment is covered (0 drops everything).

    A fragment of at most ``width`` bases touches two bins; it looks up the intervals of both and is judged in its row.
    Lists of up to MOST_BROADCAST bins are broadcast, longer ones joined by bin. Longer fragments are cut
    into bins, judged by their span and joined back.
    """
    if how is Strategy.PROPORTION and proportion <= 0:
        return frags.limit(0)
    merged = intervals.merge(blacklist)
    placed = merged.withColumn("_bin", F.explode(F.sequence(int_div("start_pos", width), int_div(F.col("end_pos") - 1, width))))
    bins = placed.groupBy("chrom", "_bin").agg(F.collect_list(F.struct(F.col("start_pos").alias("s"), F.col("end_pos").alias("e"))).alias("_mask"))  # disjoint, so at most `width` of them
    small = merged.agg(F.sum(int_div(F.col("end_pos") - 1, width) - int_div("start_pos", width) + 1)).first()[0] or 0
    bins = F.broadcast(bins) if small <= MOST_BROADCAST else bins
    size = F.col("end_pos") - F.col("start_pos")
    out = frags.where(size <= width)
    for k, edge in enumerate((F.col("start_pos"), F.col("end_pos") - 1)):
        looked = bins.select(F.col("chrom").alias(f"_c{k}"), F.col("_bin").alias(f"_b{k}"), F.col("_mask").alias(f"_m{k}"))
        out = out.join(looked, (F.col("chrom") == F.col(f"_c{k}")) & (int_div(edge, width) == F.col(f"_b{k}")), "left")
    none = F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)")
    masks = F.array_union(F.coalesce("_m0", none), F.coalesce("_m1", none))  # one that lies in both bins counts once
    shared = lambda x: F.least(x["e"], F.col("end_pos")) - F.greatest(x["s"], F.col("start_pos"))
    left, right = F.col("start_pos") + int_div(size - 1, 2), F.col("start_pos") + int_div(size, 2)
    inside = lambda x, p: (x["s"] <= p) & (p < x["e"])
    covered = lambda m: F.aggregate(m, F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.lit(0).cast("long"), shared(x)))
    hit = {
        Strategy.ANY: lambda m: F.exists(m, lambda x: shared(x) > 0), Strategy.ALL: lambda m: F.exists(m, lambda x: shared(x) == size),
        Strategy.MIDPOINT: lambda m: F.exists(m, lambda x: inside(x, left) | inside(x, right)), Strategy.PROPORTION: lambda m: covered(m) >= F.lit(float(proportion)) * size,
    }[how]
    short = out.where(~hit(masks)).select(*frags.columns)
    return short.unionByName(_drop_long(frags.where(size > width), merged, how, proportion))


def _drop_long(frags: DataFrame, merged: DataFrame, how: Strategy, proportion: float) -> DataFrame:
    """The same by an overlap join; equal fragments share their fate, so none needs a key."""
    places = frags.select("chrom", "start_pos", "end_pos").distinct()
    size = F.col("end_pos") - F.col("start_pos")
    hit = intervals.with_overlap(intervals.overlap_join(places, intervals.renamed(merged)))
    if how is Strategy.ALL:
        hit = hit.where(F.col("overlap") == size)
    elif how is Strategy.MIDPOINT:
        left = F.col("start_pos") + int_div(size - 1, 2)
        right = F.col("start_pos") + int_div(size, 2)
        inside = lambda p: (F.col("b_start") <= p) & (p < F.col("b_end"))
        hit = hit.where(inside(left) | inside(right))
    elif how is Strategy.PROPORTION:
        hit = hit.groupBy("chrom", "start_pos", "end_pos").agg(F.sum("overlap").alias("overlap")).where(F.col("overlap") >= proportion * size)
    return frags.join(hit.select("chrom", "start_pos", "end_pos").distinct(), ["chrom", "start_pos", "end_pos"], "left_anti").select(*frags.columns)
