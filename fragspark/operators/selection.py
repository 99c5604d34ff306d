"""Selections on outputs: rows, groups, motifs, length and position ranges of long-form results, dense or sparse.

An output is a long table with one row axis (windows, groups or one global row), further axes of bins or labels, and a
value. Selections are filters and joins with small tables of what was asked for, so they push down to the scan.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import col

#: Bytes that a dense form may take at most.
MOST_DENSE = 5 << 30


@dataclass(frozen=True)
class Bins:
    """An axis of half-open bins: the column that holds a bin's start, and all edges."""

    column: str
    edges: tuple[int, ...]

    @property
    def starts(self) -> list[int]:
        return list(self.edges[:-1])

    def overlapping(self, low: int, high: int) -> list[int]:
        if low >= high:
            raise ValueError(f"empty range: {low}..{high}")
        found = [a for a, b in zip(self.edges, self.edges[1:]) if a < high and low < b]
        if not found:
            raise ValueError(f"no bin overlaps {low}..{high}")
        return found


@dataclass(frozen=True)
class Output:
    """A long-form result. ``row`` names its row axis (none: one global row), ``motif`` a label axis; rows are what the
    result has beyond its values, such as blacklisted_fraction or a group's name, by row."""

    values: DataFrame
    value: str = "count"
    row: str | None = None
    rows: DataFrame | None = None
    lengths: Bins | None = None
    positions: Bins | None = None
    motif: str | None = None
    motifs: tuple[str, ...] = ()
    meta: dict = field(default_factory=dict)

    # --- what to keep

    def _picked(self, column: str, wanted: Sequence, order: str) -> Output:
        if len(set(wanted)) != len(wanted):
            raise ValueError(f"asked for twice: {sorted(x for x in set(wanted) if list(wanted).count(x) > 1)}")
        place = F.element_at(F.create_map(*[F.lit(x) for k, w in enumerate(wanted) for x in (w, k)]), col(column)) if wanted else F.lit(None)
        keep = lambda df: df.where(col(column).isin(list(wanted)))
        rows = self.rows
        if rows is not None and column in rows.columns:
            rows = keep(rows).withColumn(order, place)
        return replace(self, values=keep(self.values).withColumn(order, place), rows=rows)

    def select_rows(self, *wanted) -> Output:
        """These rows; ``row_order`` tells the order in which they were asked for. No row may be asked for twice."""
        if self.row is None:
            raise ValueError("a global result has one row")
        return self._picked(self.row, wanted, "row_order")

    windows = select_rows
    groups = select_rows

    def groups_by_name(self, *names: str, column: str = "group_name") -> Output:
        """The rows whose name is one of these, by the names of ``rows``."""
        if self.rows is None or column not in self.rows.columns:
            raise ValueError(f"no {column} among the rows")
        if len(set(names)) != len(names):
            raise ValueError("a name was asked for twice")
        rows = self.rows.where(F.col(column).isin(list(names)))
        return replace(self, values=self.values.join(rows.select(self.row), self.row, "left_semi"), rows=rows)

    def select_motifs(self, *wanted: str) -> Output:
        """These motifs; ``motif_order`` tells the order in which they were asked for."""
        if self.motif is None:
            raise ValueError("no motif axis")
        if self.motifs and set(wanted) - set(self.motifs):
            raise ValueError(f"unknown motifs: {sorted(set(wanted) - set(self.motifs))}")
        return replace(self._picked(self.motif, wanted, "motif_order"), motifs=tuple(wanted))

    def _bins(self, axis: str, wanted: Sequence[int]) -> Output:
        bins = getattr(self, axis)
        if bins is None:
            raise ValueError(f"no axis of {axis}")
        if set(wanted) - set(bins.starts):
            raise ValueError(f"unknown bins: {sorted(set(wanted) - set(bins.starts))}")
        ends = dict(zip(bins.edges, bins.edges[1:]))
        kept = sorted(wanted)
        together = all(ends[a] == b for a, b in zip(kept, kept[1:]))
        edges = (*kept, ends[kept[-1]]) if together else bins.edges
        return replace(self, values=self.values.where(col(bins.column).isin(kept)), **{axis: Bins(bins.column, edges)})

    def length_bins(self, *starts: int) -> Output:
        return self._bins("lengths", starts)

    def length_range(self, low: int, high: int) -> Output:
        """The length bins that overlap [low, high)."""
        return self._bins("lengths", self.lengths.overlapping(low, high) if self.lengths else [])

    def position_bins(self, *starts: int) -> Output:
        return self._bins("positions", starts)

    def position_range(self, low: int, high: int) -> Output:
        """The position bins that overlap [low, high)."""
        return self._bins("positions", self.positions.overlapping(low, high) if self.positions else [])

    def max_blacklisted(self, fraction: float, column: str = "blacklisted_fraction") -> Output:
        """The rows of at most that masked fraction; rows without one go."""
        if self.rows is None or column not in self.rows.columns:
            raise ValueError(f"no {column} among the rows")
        rows = self.rows.where(F.col(column) <= fraction)
        return replace(self, values=self.values.join(rows.select(self.row), self.row, "left_semi"), rows=rows)

    # --- how to see it

    def _axes(self) -> list[str]:
        bins = [b.column for b in (self.lengths, self.positions) if b is not None]
        return [*([self.row] if self.row else []), *bins, *([self.motif] if self.motif else [])]

    def entries(self) -> DataFrame:
        """The non-zero values with their axes (sparse form)."""
        return self.values.where(col(self.value) != 0).select(*self._axes(), self.value)

    def dense(self) -> DataFrame:
        """Every combination of rows, bins and motifs, with zeros where the result has nothing.

        Rows come from ``rows`` if given, else from the values. More than MOST_DENSE bytes are refused before anything is joined.
        """
        axes = [(b.column, b.starts) for b in (self.lengths, self.positions) if b is not None]
        if self.motif:
            if not self.motifs:
                raise ValueError("a dense form needs the list of motifs")
            axes.append((self.motif, list(self.motifs)))
        width = 1
        for _, told in axes:
            width *= len(told)
        spark = self.values.sparkSession
        if self.row:
            rows = (self.values if self.rows is None else self.rows).select(self.row).distinct()
        else:
            rows = spark.range(1).drop("id")
        if 8 * width * (rows.count() if self.row else 1) > MOST_DENSE:
            raise ValueError(f"a dense form of {width} values a row is too large; use entries()")
        out = rows
        for name, told in axes:  # literal arrays of the axes: a row becomes `width` rows without a join
            out = out.withColumn(name, F.explode(F.array(*[F.lit(x) for x in told])))
        keys = [*([self.row] if self.row else []), *[n for n, _ in axes]]
        casts = {f.name: f.dataType for f in self.values.schema.fields}
        out = out.select(*[F.col(k).cast(casts[k]) for k in keys])
        return out.join(self.values.select(*keys, self.value), keys, "left").withColumn(self.value, F.coalesce(self.value, F.lit(0.0)))

    def lookup(self, **axes) -> float:
        """The value at one place of all axes; 0 where the result has nothing."""
        if set(axes) != set(self._axes()):
            raise ValueError(f"needs {self._axes()}")
        found = self.values.where(F.lit(True))
        for name, x in axes.items():
            found = found.where(col(name) == F.lit(x))
        told = found.agg(F.sum(self.value)).first()[0]
        return 0.0 if told is None else float(told)

    def profile(self, row=None) -> DataFrame:
        """(position, value): one row's values by position, over all length bins that are left."""
        if self.positions is None:
            raise ValueError("no position axis")
        own = self.values if row is None else self.values.where(col(self.row) == F.lit(row))
        return own.groupBy(self.positions.column).agg(F.sum(self.value).alias(self.value))

    def counts(self, frequency: str = "frequency", scale: str = "row_scaling_factor", name: str = "count") -> Output:
        """Counts again, out of frequencies and the row's scaling factor."""
        return replace(self, values=self.values.withColumn(name, F.col(frequency) * F.col(scale)), value=name)

    def ratio(self, short: tuple[int, int], longer: tuple[int, int]) -> DataFrame:
        """(row, short, long, ratio): sums over the bins that begin in two half-open ranges; NaN without long ones."""
        at = col(self.lengths.column)
        part = lambda r: F.sum(F.when((at >= r[0]) & (at < r[1]), F.col(self.value)).otherwise(0.0))
        out = self.values.groupBy(*([self.row] if self.row else [])).agg(part(short).alias("short"), part(longer).alias("long"))
        return out.withColumn("ratio", F.when(F.col("long") == 0, F.lit(float("nan"))).otherwise(F.try_divide("short", "long")))

    def frame(self, wide: bool = False) -> DataFrame:
        """Values with what is known of their rows: long, or with one column for each length bin."""
        out = self.values
        if wide:
            name = lambda a, b: f"{self.value}_{a}" if b == a + 1 else f"{self.value}_{a}_{b}"
            ends = dict(zip(self.lengths.edges, self.lengths.edges[1:]))
            at: Column = col(self.lengths.column)
            cells = [F.coalesce(F.sum(F.when(at == a, col(self.value))), F.lit(0.0)).alias(name(a, b)) for a, b in ends.items()]
            keys = [k for k in self._axes() if k != self.lengths.column]
            out = out.groupBy(*keys).agg(*cells) if keys else out.agg(*cells)
        if self.rows is not None and self.row:
            more = [c for c in self.rows.columns if c not in out.columns]
            out = out.join(self.rows.select(self.row, *more), self.row)
        return out

    # --- files

    def write(self, path: str) -> None:
        """As Parquet: values, rows and a description, in folders of ``path``."""
        self.values.write.parquet(f"{path}/values")
        if self.rows is not None:
            self.rows.write.parquet(f"{path}/rows")
        axis = lambda b: None if b is None else [b.column, list(b.edges)]
        told = {"value": self.value, "row": self.row, "rows": self.rows is not None, "lengths": axis(self.lengths), "positions": axis(self.positions), "motif": self.motif, "motifs": list(self.motifs), "meta": self.meta}
        self.values.sparkSession.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(f"{path}/about")


def load(spark: SparkSession, path: str) -> Output:
    """What ``Output.write`` wrote."""
    told = json.loads(spark.read.text(f"{path}/about").first().value)
    axis = lambda b: None if b is None else Bins(b[0], tuple(b[1]))
    rows = spark.read.parquet(f"{path}/rows") if told["rows"] else None
    return Output(
        spark.read.parquet(f"{path}/values"), told["value"], told["row"], rows, axis(told["lengths"]), axis(told["positions"]), told["motif"], tuple(told["motifs"]), told["meta"]
    )
