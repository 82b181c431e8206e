"""Counts taken while a query runs, so that they cost no pass of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Counters:
    """Counts by name, from rows that pass a place of a plan and from numbers known already. get() waits for the first action on each
    observed plan; only that action counts."""

    def __init__(self) -> None:
        self._seen: list[Observation] = []
        self._known: dict[str, int] = {}

    def observe(self, df: DataFrame, **counts: Column) -> DataFrame:
        """df, whose rows are counted as they pass: a condition counts the rows it holds for, a number is summed."""
        o = Observation()
        self._seen.append(o)
        return df.observe(o, *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name) for name, c in counts.items()])

    def put(self, **counts: int) -> None:
        self._known |= counts

    def get(self) -> dict[str, int]:
        out = dict(self._known)
        for o in self._seen:
            out |= {k: int(v) for k, v in o.get.items()}
        return out
