"""Preparing windows: labels, duplicates, merging, thinning, nearest annotations, exclusion, minimum counts, resizing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col, distance_label, int_div
from ..storage import settled
from . import coverage, intervals


def group_label(columns: list[str], separator: str = "__", empty: str = "[NA]") -> Column:
    """Label columns joined to one group name; empty ones read as ``[NA]``."""
    return F.concat_ws(separator, *[F.coalesce(F.nullif(col(c), F.lit("")), F.lit(empty)) for c in columns])


def deduplicate(windows: DataFrame, keys: list[str], keep: str = "first", order: str = "window_idx", score: str = "score") -> DataFrame:
    """One window of each key: the first, or the one of highest or lowest score (ties: the first)."""
    by = {"first": [F.col(order)], "highest": [F.desc(score), F.col(order)], "lowest": [F.asc(score), F.col(order)]}[keep]
    return windows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def merge_within(windows: DataFrame, gap: int = 0, group: str = "group_name") -> DataFrame:
    """Windows of a group on a chromosome merged when the next starts at most ``gap`` behind the end."""
    return intervals.merge(windows, ["chrom", group], gap=gap)


def merge_across(windows: DataFrame, gap: int = 0, group: str = "group_name", labels: str = "join") -> DataFrame:
    """Windows merged whatever their group; groups are joined (distinct, sorted, ',') or the first one stands."""
    if labels == "join":
        label = F.array_join(F.array_sort(F.collect_set(group)), ",")
    else:
        label = F.min_by(group, F.struct("start_pos", "end_pos", group))
    return intervals.merge(windows, gap=gap, aggregates=[label.alias(group)])


def thin(windows: DataFrame, limit: int, keep: str = "first", group: str = "group_name", score: str = "score") -> DataFrame:
    """Windows at least ``limit`` apart within chromosome and group, chosen greedily from the left.

    A run is a window and those behind it that start closer than ``limit`` to its end; one of it stays by ``keep`` (first,
    highest, lowest, longest) and the next run is measured from the winner's end. State never runs over a gap of
    ``limit`` or more behind all earlier ends, so each stretch between such gaps is handled by itself in pandas.
    """
    better = {"first": lambda x, y: False, "highest": lambda x, y: x[2] > y[2], "lowest": lambda x, y: x[2] < y[2], "longest": lambda x, y: x[1] - x[0] > y[1] - y[0]}[keep]
    keys = ["chrom", group, "island"]

    def run(batches):
        """Rows of a partition come stretch by stretch; what a stretch leaves pending is kept over the batches."""
        told, last_end, pending, reach, held = None, None, None, None, None
        for batch in batches:
            kept, before = [], None
            columns = (batch.column(c).to_pylist() for c in ("start_pos", "end_pos", score))
            for i, (key, row) in enumerate(zip(zip(*(batch.column(c).to_pylist() for c in keys)), zip(*columns))):
                if key != told:
                    if pending is not None:
                        before = _stays(kept, before, held)
                    told, last_end, pending = key, None, None
                start, end, _ = row
                if last_end is not None and start - last_end < limit:
                    continue  # too close to the last window that stays
                if pending is None:
                    pending, reach, held = row, end, i
                elif start - reach < limit:
                    if better(row, pending):
                        pending, held = row, i
                else:
                    before = _stays(kept, before, held)
                    last_end, pending = pending[1], None
                    if start - last_end >= limit:
                        pending, reach, held = row, end, i
            if before is not None:
                yield before
            rows = batch.drop_columns(["island"])
            if kept:
                yield rows.take(pa.array(kept, pa.int64()))
            if pending is not None and isinstance(held, int):
                held = rows.take(pa.array([held], pa.int64()))
        if pending is not None:
            yield held

    def _stays(kept, before, held):
        """Notes a winner by its place in this batch; one of an earlier batch is a row by itself."""
        if isinstance(held, int):
            kept.append(held)
            return before
        return held

    stretches = intervals._islands(windows, ["chrom", group], ["start_pos", "end_pos", score], False, limit)
    dealt = stretches.repartition(*keys).sortWithinPartitions(*keys, "start_pos", "end_pos", score)
    return dealt.select(*windows.columns, "island").mapInArrow(run, windows.schema)


def cluster_label(windows: DataFrame, depth: int, keys: list[str]) -> DataFrame:
    """windows with ``clustered``: the mean number of windows over its bases, itself included, is at least ``depth``."""
    piled = coverage.segments(windows)
    told = coverage.sums(piled, windows, keys)
    return windows.join(told.select(*keys, "total", "span"), keys).withColumn("clustered", F.col("total") >= depth * F.col("span")).drop("total", "span")


def annotate_nearest(windows: DataFrame, targets: DataFrame, rules: list[str] | None = None, direction: str = "both") -> DataFrame:
    """windows with distance (signed: left ones negative) and near_pos of the nearest target, and its label if rules are given.

    A target inside the window has distance 0; of two at the same distance the left one is reported and ``tied`` is set.
    """
    found = intervals.nearest(windows, targets)
    inside = (F.col("right_gap") == 0) | (F.col("left_gap") == 0)
    left, right = F.col("left_gap"), F.col("right_gap")
    if direction == "left":
        distance, pos = -left, F.col("left_pos")
    elif direction == "right":
        distance, pos = right, F.col("right_pos")
    else:
        to_left = right.isNull() | (left <= right)
        distance = F.when(inside, 0).when(to_left, -left).otherwise(right)
        pos = F.when(to_left, F.col("left_pos")).otherwise(F.col("right_pos"))
    out = found.withColumn("distance", distance).withColumn("near_pos", pos).withColumn("tied", F.coalesce((left == right) & ~inside, F.lit(False)))
    if rules:
        out = out.withColumn("distance_label", distance_label(F.abs("distance"), rules))
    return out.drop("left_pos", "right_pos", "left_gap", "right_gap")


def near_edges(targets: DataFrame, edge: str = "nearest", duplicates: str = "keep-first", order: str | None = None, label: str | None = None) -> DataFrame:
    """(chrom, pos[, label]): the single bases that intervals are near by.

    ``edge``: left (the first base), right (the last one), nearest (both), upstream or downstream (by ``strand``; intervals
    without one have their left and right edge there). Where several intervals share an edge one of them stays by ``order`` ('keep-first'),
    none ('drop-all'), they become one whose labels are joined ('merge'), or it is an error ('error').
    """
    left, right = F.col("start_pos"), F.col("end_pos") - 1
    if edge in ("upstream", "downstream"):
        minus = F.coalesce(F.col("strand") == "-", F.lit(False))
        at = F.when(minus == F.lit(edge == "upstream"), right).otherwise(left)
        places = F.array(at)
    else:
        places = {"left": F.array(left), "right": F.array(right), "nearest": F.array_distinct(F.array(left, right))}[edge]
    spread = targets.withColumn("pos", F.explode(places))
    first = F.min_by(label, order) if label and order else F.min(label) if label else None
    told = spread.groupBy("chrom", "pos").agg(F.count("*").alias("_n"), *([first.alias(label)] if label else []), *([F.array_join(F.array_sort(F.collect_set(label)), ",").alias("_all")] if label else []))
    if duplicates == "drop-all":
        told = told.where("_n = 1")
    elif duplicates == "error":
        told = told.withColumn("pos", F.when(F.col("_n") == 1, F.col("pos")).otherwise(F.raise_error(F.format_string("several intervals share the edge %s:%d", "chrom", "pos")).cast("long")))
    elif duplicates == "merge" and label:
        told = told.withColumn(label, F.col("_all"))
    elif duplicates not in ("keep-first", "merge"):
        raise ValueError(f"unknown policy: {duplicates}")
    return told.select("chrom", "pos", *([label] if label else []))


def compositions(windows: DataFrame, specs: list[str], separator: str = ".") -> DataFrame:
    """windows with a column for each spec ``NAME=PART,PART``: the parts' columns joined, empty ones kept."""
    out = windows
    for spec in specs:
        name, _, parts = spec.partition("=")
        names = [p.strip() for p in parts.split(",")]
        if not name.strip() or not all(names) or not parts:
            raise ValueError(f"bad composition: {spec}")
        if missing := [p for p in names if p not in out.columns]:
            raise ValueError(f"unknown labels in {spec}: {missing}")
        out = out.withColumn(name.strip(), compose(names, separator))
    return out


def ordered(windows: DataFrame, by: str = "place", group: str = "group_name") -> DataFrame:
    """Windows sorted by place (chromosome, start, end, group) or by group first."""
    place = ["chrom", "start_pos", "end_pos"]
    return windows.orderBy(*{"place": [*place, group], "group": [group, *place]}[by])


def compose(parts: list[str], separator: str = ".") -> Column:
    """A label of several parts, empty ones kept."""
    return F.concat_ws(separator, *[F.coalesce(col(p), F.lit("")) for p in parts])


def exclude(windows: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """Windows none of whose label columns holds an excluded term."""
    out = windows
    for label, terms in rules.items():
        out = out.where(~F.coalesce(F.col(label).isin(*terms), F.lit(False)))
    return out


def min_per(windows: DataFrame, least: dict[str, int], most_rounds: int = 1000) -> DataFrame:
    """Windows whose label values all keep at least so many windows in the result itself.

    Dropping windows of one label lowers the counts of another, so it repeats until nothing changes. Each round counts
    with a partial aggregate, joins the surviving values back and cuts the lineage with a checkpoint.
    """
    n = windows.count()
    for _ in range(most_rounds):
        out = windows
        for label, k in least.items():
            kept = windows.groupBy(label).count().where(F.col("count") >= k).select(F.col(label).alias("_v"))
            out = out.join(kept, F.col(label).eqNullSafe(F.col("_v")), "left_semi")
        windows = settled(out)
        now = windows.count()
        if now == n or len(least) == 1:
            return windows
        n = now
    raise RuntimeError("min_per did not settle")


def resize(windows: DataFrame, size: int, chroms: DataFrame | None = None, outside: str = "drop") -> DataFrame:
    """Windows of one size around their centres; where parities differ an arithmetic rule settles the odd base.

    ``outside``: windows beyond chroms(chrom, chrom_len) are dropped, trimmed or allowed.
    """
    span = F.col("end_pos") - F.col("start_pos")
    centre = F.col("start_pos") + int_div(span, 2)
    odd = F.when((span % 2) != (size % 2), (F.col("start_pos") * 31 + span * 17) % 2).otherwise(F.lit(0))
    shift = F.when((span % 2) == 0, -odd).otherwise(odd)
    start = centre - size // 2 + F.when((span % 2) != (size % 2), shift).otherwise(F.lit(0))
    out = windows.withColumn("_s", start).withColumn("start_pos", F.col("_s")).withColumn("end_pos", F.col("_s") + size).drop("_s")
    if chroms is None or outside == "allow":
        return out
    out = out.join(F.broadcast(chroms.select("chrom", "chrom_len")), "chrom")  # a row for each chromosome
    if outside == "drop":
        out = out.where("start_pos >= 0 and end_pos <= chrom_len")
    else:
        out = intervals.clip(out, 0, F.col("chrom_len"))
    return out.drop("chrom_len")
