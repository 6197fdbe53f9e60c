"""Counts of a running plan, step by step, without an action of their own.

A step is a place in a plan; what passes it is counted while the plan runs, and reported once the action, or a stream's
micro-batch, has ended.  A task that runs again is counted once.  A step that the optimizer proves empty reports nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

Report = Callable[[str, dict[str, Any]], None]


class Steps:
    """The steps of one action: placed on DataFrames, reported in the order in which they were placed."""

    def __init__(self, report: Report):
        self.report = report
        self.placed: list[tuple[str, Observation]] = []

    def step(self, df: DataFrame, name: str, **counts: Column) -> DataFrame:
        """df, counted where it stands in the plan: its rows, and other aggregates by name."""
        own = Observation(name)
        self.placed.append((name, own))
        return df.observe(own, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in counts.items()))

    def done(self) -> None:
        """After the action: report all steps placed since the last time."""
        for name, own in self.placed:
            self.report(name, own.get)
        self.placed.clear()


class Batches(StreamingQueryListener):
    """Reports the steps of each micro-batch; spark.streams.addListener() takes it."""

    def __init__(self, report: Report):
        super().__init__()
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.report(name, {"batch": event.progress.batchId, **row.asDict()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def step_of_stream(stream: DataFrame, name: str, **counts: Column) -> DataFrame:
    """stream, counted by micro-batch where it stands in the plan."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in counts.items()))


def as_table(spark: SparkSession, told: list[tuple[str, dict[str, Any]]]) -> DataFrame:
    """step, what, value of reported numbers."""
    rows = [(name, k, int(v)) for name, counts in told for k, v in counts.items() if v is not None]
    return spark.createDataFrame(rows, "step string, what string, value long")
