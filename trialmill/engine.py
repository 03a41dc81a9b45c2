"""The library's front door: load trial tables, compute variables, filter, summarise, save."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from .functions import expressions
from .functions.stats import name, shape
from .operators import cdf, filters, summary
from .plans.rules import SummaryPlan, Target
from .sources import matlab, tables

log = logging.getLogger("trialmill")


class TrialData:
    """A trial table and what can be done with it. Nothing runs before a result is asked for, but for what needs a look at the data."""

    def __init__(self, spark: SparkSession, data: DataFrame | None = None, compat: frozenset[str] | set[str] = frozenset()):
        self.spark, self.data, self.compat = spark, data, frozenset(compat)
        self.results: list[DataFrame] = []

    # --- load and save -----------------------------------------------------------------------------------------------
    def _take(self, new: DataFrame, append: bool) -> TrialData:
        """new as the table, or together with the one there is; variables that either lacks are missing there."""
        self.data = tables.union([new, self.data]) if append and self.data is not None else new
        return self

    def read_piped(self, paths: list[str], append: bool = False) -> TrialData:
        return self._take(tables.read_piped(self.spark, paths), append)

    def read_text(self, paths: list[str], header: bool = True, encoding: str = "utf-8", delimiter: str = r"\s", append: bool = False) -> TrialData:
        return self._take(tables.read_texts(self.spark, paths, header, encoding, delimiter), append)

    def read_matlab(self, paths: list[str], append: bool = False) -> TrialData:
        self.data = matlab.read_matlab(self.spark, paths, self.data if append else None)
        return self

    def read(self, paths: list[str], append: bool = False, **options) -> TrialData:
        return self._take(tables.read_any(self.spark, paths, **options), append)

    def save_piped(self, path: str, rows: list[str] | None = None, cols: list[str] | None = None, rules: list[str] | None = None) -> None:
        """The table, or what rules leave of it."""
        tables.write_piped(self.filter(rows or [], cols or [], rules) if rules else self.data, path)

    def sort(self, variables: list[str]) -> TrialData:
        """Rows in the order of variables, which slices count by; files that are read in several parts come in no order of their own."""
        self.data = self.data.orderBy(*map(name, variables))
        return self

    # --- variables ---------------------------------------------------------------------------------------------------
    def compute(self, target: str, expression: str, overwrite: bool = True) -> TrialData:
        self.data = expressions.compute(self.data, target, expression, overwrite)
        return self

    # --- filter and summarise ----------------------------------------------------------------------------------------
    def filter(self, rows: list[str], cols: list[str], rules: list[str], omegas: list | None = None, keep: str = "above", skewed: bool | None = None) -> DataFrame:
        return filters.apply_rules(self.data, rules, [*rows, *cols], omegas, self.compat, keep, skewed)

    def summarize(self, rows: list[str], cols: list[str], rules: list[str], targets: list[str], omegas: list | None = None, strict: bool = False, keep: str = "above", skewed: bool | None = None) -> DataFrame:
        """The long result. strict: keys must be known everywhere and a variable may have one role only."""
        if strict:
            SummaryPlan(rows, cols, rules, targets, omegas).validate()
            filters.check_keys(self.data, [*rows, *cols])
        data = self.data
        for t in dict.fromkeys(Target.parse(t).var for t in targets):
            data = data.withColumn(t, filters.number(data, t))
        keys, known_as = [*rows, *cols], None
        if skewed is None and (filters.needs_shape(rules, keys, self.compat) or any(Target.parse(t).op in summary.GATHERED for t in targets)):
            known_as = shape(data, keys)  # cells only shrink when rules drop rows
        kept = filters.apply_rules(data, rules, keys, omegas, self.compat, keep, skewed, known_as)
        result = summary.summarize(kept, rows, cols, targets, skewed, known_as)
        self.results.append(result)
        log.info("summary of %s by %s and %s under %s", targets, rows, cols, rules)
        return result

    def run(self, plan: SummaryPlan, **options) -> DataFrame:
        return self.summarize(plan.rows, plan.cols, plan.rules, plan.targets, plan.omegas, **options)

    def wide(self, result: DataFrame, rows: list[str], cols: list[str], targets: list[str]) -> list[DataFrame]:
        """One wide view for each target and parameter, in order."""
        return [summary.pivot(result, rows, cols, t, p) for t in targets for p in Target.parse(t).parameters()]

    def text(self, result: DataFrame, rules: list[str] | None = None, decimals: int = 4) -> str:
        """A long result as text."""
        return summary.to_text(result, "result", rules, decimals)

    def save_text(self, wide: DataFrame, path: str, title: str, rules: list[str] | None = None, decimals: int = 4, order: list[str] | None = None) -> None:
        """A wide result of any size as a folder of text."""
        summary.write_text(wide, path, title, rules, decimals, order)

    def omega(self, var: str, keys: list[str]) -> tuple[float, float]:
        """(p, omega) estimated from pooled probabilities."""
        return cdf.fit_omega(cdf.pooled(self.data, var, keys), f"{var}_cdf")
