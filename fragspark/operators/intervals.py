"""Interval operators: merge, overlap join, nearest, subtraction, tiling. Coordinates are 0-based, half-open.

Columns are ``chrom, start_pos, end_pos`` unless named otherwise. None of the operators puts a whole chromosome in one
task where fact rows are concerned: overlap joins and subtraction go by bins, merges and nearest lookups by tiles
first and by the few survivors of each tile afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import int_div, overlap_bp

#: Bin width of overlap joins; rows wider than SPAN bins go to bins SPAN times as wide.
BIN, SPAN, LEVELS = 1_000, 64, 3
#: Tile width of running sums and merges.
TILE = 1_000_000


def _islands(df: DataFrame, keys: list[str], order: list, touching: bool, gap: int) -> DataFrame:
    """df with an ``island`` number within each combination of keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("start_pos") > reach + gap if touching else F.col("start_pos") >= reach + gap
    return df.withColumn("island", F.sum(F.when(apart | reach.isNull(), 1).otherwise(0)).over(w))


def merge(df: DataFrame, keys: list[str] = ["chrom"], touching: bool = True, gap: int = 0, aggregates: list[Column] | None = None, tile: int = TILE) -> DataFrame:  # noqa: B006
    """Unions of intervals per key: overlapping, optionally touching, optionally gap-separated ones as one.

    Where touching ones merge, intervals are cut at tile edges and merged within tiles; only unions that come near an edge, two
    of a tile at most, meet again per key. Else unions of tiles are merged per key. ``aggregates`` (over all
    members of a union) switches the tile step off, as they need not be decomposable. Returns keys, start_pos, end_pos.
    """
    bounds = (F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    if aggregates is not None:
        return _islands(df, keys, ["start_pos", "end_pos"], touching, gap).groupBy(*keys, "island").agg(*bounds, *aggregates).drop("island")
    own = df.select(*keys, "start_pos", "end_pos")
    own = by_tile(own, tile) if touching else own.withColumn("tile", int_div("start_pos", tile))
    local = _islands(own, [*keys, "tile"], ["start_pos", "end_pos"], touching, gap).groupBy(*keys, "tile", "island").agg(*bounds)
    if not touching:
        return _islands(local.drop("island"), keys, ["start_pos", "end_pos"], touching, gap).groupBy(*keys, "island").agg(*bounds).drop("island")
    edge = (F.col("start_pos") - gap <= F.col("tile") * tile) | (F.col("end_pos") + gap >= (F.col("tile") + 1) * tile)
    near = local.withColumn("_part", F.when(edge, F.lit(-1)).otherwise(F.col("tile"))).drop("tile", "island")
    return _islands(near, [*keys, "_part"], ["start_pos", "end_pos"], touching, gap).groupBy(*keys, "_part", "island").agg(*bounds).drop("_part", "island")


def _level(start: Column, end: Column, width: int, levels: int) -> Column:
    """The first level whose bins hold the interval within SPAN of them."""
    out = F.lit(levels - 1)
    for k in reversed(range(levels - 1)):
        out = F.when(end - start <= width * SPAN ** (k + 1), F.lit(k)).otherwise(out)
    return out


def _bins(start: str, end: str, width: int) -> Column:
    return F.sequence(int_div(start, width), int_div(F.col(end) - 1, width))


def _placed(bins: Column, level: int) -> Column:
    return F.transform(bins, lambda x: F.struct(F.lit(level).alias("_level"), x.alias("_bin")))


def overlap_join(a: DataFrame, b: DataFrame, width: int = BIN, levels: int = LEVELS) -> DataFrame:
    """Pairs of rows of a(chrom, start_pos, end_pos, ...) and b(chrom, b_start, b_end, ...) that share a base.

    Other column names must not clash. Each row of b is placed in bins of the level that suits its width, so wide
    windows don't explode; rows of a look in the bins of every level that b has (a small job over b tells which). A
    pair is reported in one bin only, that of its first shared base. Catalyst picks a broadcast or a shuffled join
    on (chrom, level, bin) by the sizes it sees.
    """
    b_level = b.withColumn("_level", _level(F.col("b_start"), F.col("b_end"), width, levels))
    held = range(levels) if a.isStreaming or b.isStreaming else sorted(r[0] for r in b_level.select("_level").distinct().collect()) or [0]
    b_sequence = F.lit(None)
    a_places = []
    for k in held:
        w = width * SPAN**k
        b_sequence = F.when(F.col("_level") == k, _bins("b_start", "b_end", w)).otherwise(b_sequence)
        a_places.append(_placed(_bins("start_pos", "end_pos", w), k))
    right = b_level.withColumn("_bin", F.explode(b_sequence)).withColumnRenamed("chrom", "_b_chrom").withColumnRenamed("_level", "_b_level").withColumnRenamed("_bin", "_b_bin")
    left = a.withColumn("_place", F.explode(F.concat(*a_places))).withColumn("_level", F.col("_place._level")).withColumn("_bin", F.col("_place._bin")).drop("_place")
    first = F.greatest("start_pos", "b_start")
    at = F.lit(None)
    for k in held:
        at = F.when(F.col("_level") == k, int_div(first, width * SPAN**k)).otherwise(at)
    same = (F.col("chrom") == F.col("_b_chrom")) & (F.col("_level") == F.col("_b_level")) & (F.col("_bin") == F.col("_b_bin"))
    met = (F.col("start_pos") < F.col("b_end")) & (F.col("b_start") < F.col("end_pos")) & (F.col("_bin") == at)
    return left.join(right, same & met).drop("_level", "_bin", "_b_level", "_b_bin", "_b_chrom")


def with_overlap(joined: DataFrame) -> DataFrame:
    """Adds overlap, the bases that the two intervals of an overlap join share."""
    return joined.withColumn("overlap", overlap_bp("start_pos", "end_pos", "b_start", "b_end"))


def renamed(b: DataFrame) -> DataFrame:
    """b(chrom, start_pos, end_pos, ...) as the right side of an overlap join."""
    return b.withColumnRenamed("start_pos", "b_start").withColumnRenamed("end_pos", "b_end")


def subtract(df: DataFrame, mask: DataFrame, keep: list[str]) -> DataFrame:
    """The parts of df's intervals that no interval of mask covers, with the columns ``keep`` of df.

    mask is merged first. Rows need no key of their own: each is cut where masks begin and end.
    """
    row = df.withColumn("_row", F.struct("start_pos", "end_pos", *keep))
    merged = renamed(merge(mask))
    hit = overlap_join(row.select("chrom", "start_pos", "end_pos", "_row").distinct(), merged)
    cuts = hit.groupBy("chrom", "_row").agg(F.array_sort(F.collect_list(F.struct("b_start", "b_end"))).alias("_cuts"))
    with_cuts = row.join(cuts, ["chrom", "_row"], "left")
    starts = F.expr("concat(array(start_pos), transform(_cuts, x -> x.b_end))")
    ends = F.expr("concat(transform(_cuts, x -> x.b_start), array(end_pos))")
    pieces = F.when(F.col("_cuts").isNull(), F.array(F.struct(F.col("start_pos").alias("s"), F.col("end_pos").alias("e"))))
    pieces = pieces.otherwise(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))))
    out = with_cuts.withColumn("_piece", F.explode(pieces)).where("_piece.s < _piece.e")
    return out.select("chrom", F.col("_piece.s").alias("start_pos"), F.col("_piece.e").alias("end_pos"), *keep)


def by_tile(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Intervals cut at tile edges, with the tile's number: rows of one tile add up without their neighbours."""
    cut = df.withColumn("tile", F.explode(_bins("start_pos", "end_pos", tile)))
    return cut.withColumn("start_pos", F.greatest("start_pos", F.col("tile") * tile)).withColumn("end_pos", F.least("end_pos", (F.col("tile") + 1) * tile))


def clip(df: DataFrame, low, high) -> DataFrame:
    """Intervals clipped to [low, high); those with nothing left go."""
    out = df.withColumn("start_pos", F.greatest("start_pos", F.lit(low) if isinstance(low, int) else low)).withColumn("end_pos", F.least("end_pos", F.lit(high) if isinstance(high, int) else high))
    return out.where("start_pos < end_pos")


def nearest(windows: DataFrame, targets: DataFrame, tile: int = 10_000) -> DataFrame:
    """As-of lookup on both sides: windows with left_pos, right_pos (null if there is none) and left_gap, right_gap.

    targets(chrom, pos) are single bases. The left target is the last at or before start_pos, the right one the first at
    or after start_pos; gaps run from the window's edges (0 inside). Each tile knows the last target before
    it and the first behind it from running extremes over tiles, so no task needs a whole chromosome of rows.
    """
    t = targets.select("chrom", "pos").distinct().withColumn("tile", int_div("pos", tile))
    w = windows.withColumn("tile", int_div("start_pos", tile))
    spans = t.groupBy("chrom", "tile").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    every = spans.select("chrom", "tile", "lo", "hi").unionByName(w.select("chrom", "tile").distinct(), allowMissingColumns=True)
    every = every.groupBy("chrom", "tile").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    order = Window.partitionBy("chrom").orderBy("tile")
    edges = every.select(
        "chrom", "tile",
        F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.min("lo").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("behind"),
    )
    marked = w.withColumn("_at", F.col("start_pos")).withColumn("_is", F.lit(1))
    both = marked.unionByName(t.select("chrom", "tile", F.col("pos").alias("_at"), F.lit(0).alias("_is"), F.col("pos").alias("_pos")), allowMissingColumns=True)
    here = Window.partitionBy("chrom", "tile").orderBy("_at", "_is")
    back = Window.partitionBy("chrom", "tile").orderBy(F.desc("_at"), F.asc("_is"))
    both = both.withColumn("_l", F.last("_pos", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_r", F.last("_pos", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    out = both.where("_is = 1").join(edges, ["chrom", "tile"], "left")
    out = out.withColumn("left_pos", F.coalesce("_l", "before")).withColumn("right_pos", F.coalesce("_r", "behind"))
    out = out.withColumn("left_gap", F.col("start_pos") - F.col("left_pos")).withColumn("right_gap", F.greatest(F.lit(0), F.col("right_pos") - F.col("end_pos") + 1))
    return out.drop("_at", "_is", "_pos", "_l", "_r", "before", "behind", "tile")
