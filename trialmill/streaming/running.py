"""Running summaries of a stream of trials, for operations whose state is a few sums for each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import descriptive, name, number
from ..plans.rules import Target

#: Medians, modes and fits need all values of a cell and have no running form.
RUNNING = ("Mean", "Count", "Standard Deviation", "Max", "Min", "Variance", "Standard Error")


def running_summary(stream: DataFrame, keys: list[str], targets: list[str], time: str | None = None, window: str | None = None, late: str = "0 seconds") -> DataFrame:
    """keys and one column for each target, updated as trials arrive.

    With time and window the cells are also split by event-time windows, which a watermark of `late` closes.
    """
    wanted = [Target.parse(t) for t in targets]
    for t in wanted:
        if t.op not in RUNNING:
            raise ValueError(f"{t.op!r} has no running form; there are {', '.join(RUNNING)}")
    by = [name(k) for k in keys]
    if time and window:
        stream = stream.withWatermark(time, late)
        by.append(F.window(name(time), window).alias("window"))
    aggs = [descriptive(t.op, number(stream, t.var), bool(keys)).alias(t.text()) for t in wanted]
    return stream.groupBy(*by).agg(*aggs)
