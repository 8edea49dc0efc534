"""How many rows pass the points of a job, counted in the pass that makes its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Counts:
    """Named points of one plan. The numbers are there once an action has run it to its end.

    A point is a metric that tasks send with their results, so nothing is read or moved for it. Filters do
    not move past a point: set it where they stand anyway. Tasks that are run twice
    after an executor was lost may count twice in stages before a shuffle.
    """

    def __init__(self) -> None:
        self._points: dict[str, Observation] = {}

    def at(self, name: str, df: DataFrame) -> DataFrame:
        """``df``, counted under ``name``."""
        if name in self._points:
            raise ValueError(f"rows are already counted as '{name}'")
        self._points[name] = Observation()
        return df.observe(self._points[name], F.count(F.lit(1)).alias("rows"))

    def result(self) -> dict[str, int]:
        """Rows by point, in the order in which the points were set. Waits for the first action."""
        return {name: point.get["rows"] for name, point in self._points.items()}
