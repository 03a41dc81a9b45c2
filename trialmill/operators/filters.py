"""Outlier rules as DataFrame stages. Each rule sees the survivors of the one before it."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.stats import MAD_SCALE, Shape, beside, fresh, name, number, shape, shifting_z
from ..plans.rules import Cutoff, Rule, parse_rule
from . import cdf, selection

_COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_STATISTICS = ("mean", "sd", "n", "median", "mad")
_NEEDS = {"raw": (), "sd": ("mean", "sd"), "shifting": ("mean", "sd", "n"), "mad": ("median", "mad")}


def _cut(c: Cutoff, x: Column, s: dict[str, Column]) -> Column:
    """x against a cutoff; the comparator decides on which side of the centre the cutoff lies."""
    if c.kind == "raw":
        return _COMPARE[c.op](x, F.lit(c.number))
    centre = s["median"] if c.kind == "mad" else s["mean"]
    width = {"sd": lambda: c.number * s["sd"], "shifting": lambda: shifting_z(s["n"]) * s["sd"], "mad": lambda: c.number * MAD_SCALE * s["mad"]}[c.kind]()
    return _COMPARE[c.op](x, centre - width if c.op.startswith(">") else centre + width)


def _windowed(df: DataFrame, x: Column, keys: list[str], needs: set[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Statistics of a row's cell by one window; rows stay where the keys put them, so more rules need no more shuffles. For cells that fit a task."""
    cell, names = W.partitionBy(*map(name, keys)), _names(df)
    made = {"mean": lambda: F.avg(x), "sd": lambda: F.stddev_samp(x), "n": lambda: F.count(x), "median": lambda: F.median(x)}
    out = df
    for need in sorted(needs & made.keys() | ({"median"} if "mad" in needs else set())):
        out = out.withColumn(names[need], made[need]().over(cell))
    if "mad" in needs:
        out = out.withColumn(names["mad"], F.median(F.abs(x - name(names["median"]))).over(cell))
    return out, {n: name(names[n]) for n in needs}


def _names(df: DataFrame) -> dict[str, str]:
    """Columns for statistics that df doesn't have yet."""
    return dict(zip(_STATISTICS, fresh(df, *_STATISTICS), strict=True))


def _aggregates(x: Column, needs: set[str], grouped: bool, names: dict[str, str]) -> list[Column]:
    made = {"mean": F.avg(x), "sd": F.stddev_samp(x), "n": F.count(x) if grouped else F.count(F.lit(1))}
    return [made[n].alias(names[n]) for n in sorted(needs & made.keys())]


def _joined(df: DataFrame, x: Column, keys: list[str], needs: set[str], known_as: Shape | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """The same for cells of any size: sums combine before the shuffle, medians are found by counts, and the rows of a large cell meet them in several tasks."""
    names = _names(df)
    sums, found = _aggregates(x, needs, True, names), []
    if sums:
        found.append(df.groupBy(*map(name, keys)).agg(*sums))
    if "mad" in needs:
        found.append(selection.deviations(df, keys, x, names["median"], names["mad"], known_as))
    elif "median" in needs:
        found.append(selection.medians(df, keys, x, names["median"], known_as))
    cells = found[0] if len(found) == 1 else found[0].join(found[1], keys, "left")
    return beside(df, cells, keys, known_as), {n: name(names[n]) for n in needs}


def _overall(df: DataFrame, x: Column, needs: set[str], compat: frozenset[str], skewed: bool) -> dict[str, Column]:
    """Statistics of the whole table as constants: one row, never a window over everything. skewed: the table is too large for one buffer of values."""
    sums = _aggregates(x, needs, False, {n: n for n in _STATISTICS})
    row = df.agg(*sums).first().asDict() if sums else {}
    if "mad" in needs:
        if skewed:
            middle, mad = selection.deviations(df, [], x, "median", "mad").first() or (None, None)
        else:
            middle = df.agg(F.median(x)).first()[0]
            mad = df.agg(F.median(F.abs(x - F.lit(middle).cast("double")))).first()[0]
        row |= {"median": middle, "mad": None if "global_mad_nulls" in compat and not df.filter(x.isNull()).isEmpty() else mad}
    return {k: F.lit(v).cast("double") for k, v in row.items()}


def apply_range(df: DataFrame, rule: Rule, keys: list[str], compat: frozenset[str] = frozenset(), skewed: bool = True, known_as: Shape | None = None) -> DataFrame:
    x = number(df, rule.var)
    needs = {n for c in rule.cutoffs for n in _NEEDS[c.kind]}
    out, stats = df, {}
    if needs and keys:
        # Rows with a missing key belong to no cell.
        own = df.filter(" and ".join(f"`{k}` is not null" for k in keys))
        out, stats = _joined(own, x, keys, needs, known_as) if skewed else _windowed(own, x, keys, needs)
    elif needs:
        stats = _overall(df, x, needs, compat, skewed)
    tests = [_cut(c, x, stats) for c in rule.cutoffs]
    keep = tests[0] if len(tests) == 1 else (tests[0] & tests[1]) if rule.joint == "and" else (tests[0] | tests[1])
    return out.filter(keep).select(*map(name, df.columns))


def apply_checklist(df: DataFrame, rule: Rule, compat: frozenset[str] = frozenset()) -> DataFrame:
    """Rows whose value is listed. A number is compared as a number also with text, unless types are strict."""
    text = isinstance(df.schema[rule.var].dataType, T.StringType)
    numbers = [v for v in rule.values if isinstance(v, float)]
    words = [v for v in rule.values if isinstance(v, str)]
    tests = []
    if numbers and not (text and "strict_types" in compat):
        tests.append(number(df, rule.var).isin(numbers))
    if words and text:
        tests.append(name(rule.var).isin(words))
    elif words and "strict_types" not in compat:
        tests.append(name(rule.var).cast("string").isin(words) | number(df, rule.var).isin([float(w) for w in words if _is_number(w)]))
    keep = F.lit(False)
    for t in tests:
        keep = keep | F.coalesce(t, F.lit(False))
    return df.filter(keep)


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def needs_shape(rules: list[str], keys: list[str], compat: frozenset[str] = frozenset()) -> bool:
    """Whether rules ask for statistics of cells, whose size then decides how they are made."""
    kinds = {c.kind for text in rules for c in parse_rule(text, compat).cutoffs}
    return bool(kinds - {"raw"} if keys else kinds & {"mad"})


def apply_rules(df: DataFrame, rules: list[str], keys: list[str], omegas: list | None = None, compat: frozenset[str] = frozenset(), keep: str = "above", skewed: bool | None = None, known_as: Shape | None = None) -> DataFrame:
    """All rules in order. skewed: whether a cell may be too large for a task; if not, rules on the same keys share one
    exchange; None: it is measured, by one count over the keys, unless known_as has it. omegas: one for each rule; only pooled-CDF rules use theirs (None or -1: only mark the rows)."""
    if skewed is None and known_as is None and needs_shape(rules, keys, compat):
        known_as = shape(df, keys)
    if skewed is None:
        skewed = known_as is not None and known_as.skewed
    for i, text in enumerate(rules):
        rule = parse_rule(text, compat)
        if rule.var not in df.columns:
            raise ValueError(f"no variable {rule.var!r}")
        if rule.kind == "range":
            df = apply_range(df, rule, keys, compat, skewed, known_as)
        elif rule.kind == "checklist":
            df = apply_checklist(df, rule, compat)
        else:
            df = cdf.apply_rule(df, rule.var, keys, omegas[i] if omegas else None, keep)
    return df


def check_keys(df: DataFrame, keys: list[str]) -> None:
    """Raise if a key is missing or empty anywhere; one aggregation for all keys."""
    if keys:
        row = df.agg(*(F.count_if(name(k).isNull() | (F.length(F.trim(name(k).cast("string"))) == 0)).alias(f"k{i}") for i, k in enumerate(keys))).first()
        bad = [k for i, k in enumerate(keys) if row[i]]
        if bad:
            raise ValueError(f"missing or empty values in {bad}; filter them out first")


def distinct_values(df: DataFrame, var: str) -> DataFrame:
    """The known distinct values of a variable."""
    return df.select(name(var)).dropna().distinct()


def looks_numeric(df: DataFrame, var: str) -> bool:
    """Whether every value that is not blank is a number."""
    blank = F.length(F.trim(name(var).cast("string"))) == 0
    return df.filter(name(var).isNotNull() & ~blank & number(df, var).isNull()).isEmpty()
