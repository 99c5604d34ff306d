"""Run counters: what a run read, kept and dropped, observed while it runs, without a pass of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.reads import REVERSE, has


class Counters:
    """Named counts of a plan's stages; ``told`` has them once an action has run the plan."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def count(self, df: DataFrame, stage: str, **more: Column) -> DataFrame:
        """df, with its rows (and further aggregates) counted under this name as they pass."""
        if stage in self._seen:
            raise ValueError(f"counted twice: {stage}")
        self._seen[stage] = Observation(stage)
        return df.observe(self._seen[stage], F.count(F.lit(1)).alias("rows"), *[x.alias(n) for n, x in more.items()])

    def reads(self, df: DataFrame, stage: str = "reads") -> DataFrame:
        """Reads, with how many are forward and reverse."""
        return self.count(df, stage, forward=F.count_if(~has(REVERSE)), reverse=F.count_if(has(REVERSE)))

    def told(self) -> dict[str, dict]:
        return {stage: dict(o.get) for stage, o in self._seen.items()}
