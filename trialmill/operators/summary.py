"""Grouped summaries: one aggregation for all targets, a long result, and wide views of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fits
from ..functions.stats import Shape, descriptive, fresh, name, number, shape
from ..plans.rules import FITTED, Target
from ..shared import stored
from . import selection

LONG = ("variable", "operation", "parameter", "value")


#: Operations that need all values of a cell together, unless they are found by counts.
GATHERED = ("Median", "Mode")


def _iterative(t: Target) -> bool:
    return t.op in fits.ITERATIVE or t.bounds is not None


def summarize(df: DataFrame, rows: list[str], cols: list[str], targets: list[str], skewed: bool | None = None, known_as: Shape | None = None) -> DataFrame:
    """(rows..., cols..., variable, operation, parameter, value), one row for each cell, target and parameter with a value.

    Rows with a missing key belong to no cell. All targets that are sums or means share one aggregation; iterative fits
    share one for each variable. skewed: whether a cell, or without keys the table, may be too large for a task: then medians and modes come from
    counts; None: it is measured, by one count over the keys, if there are such targets and known_as doesn't have it.
    """
    keys = [*rows, *cols]
    if clash := {k.lower() for k in keys} & {*LONG}:
        raise ValueError(f"the result has columns {sorted(clash)} of its own; rename these keys")
    wanted = list(dict.fromkeys(map(Target.parse, targets)))
    if keys:
        df = df.filter(" and ".join(f"`{k}` is not null" for k in keys))
    found = fresh(df.select(*map(name, keys)), *(f"t{i}" for i in range(len(wanted))))
    alias = dict(zip(dict.fromkeys(t.var for t in wanted), fresh(df.select(*map(name, keys)), *(f"x{i}" for i in range(len(wanted)))), strict=False))
    data = df.select(*map(name, keys), *(number(df, v).alias(a) for v, a in alias.items()))
    if any(t.op in GATHERED for t in wanted) and skewed is None:
        known_as = known_as or shape(data, keys)
        skewed = known_as.skewed
    counted = {i for i, t in enumerate(wanted) if t.op in GATHERED and skewed}
    aggs = []
    for i, t in enumerate(wanted):
        x = F.col(alias[t.var])
        if t.op not in FITTED and i not in counted:
            aggs.append(F.array(descriptive(t.op, x, bool(keys)).cast("double")).alias(found[i]))
        elif t.op in FITTED and not _iterative(t):
            aggs.append(fits.from_means(t.op, x).alias(found[i]))
    cells = data.groupBy(*map(name, keys)).agg(*aggs) if aggs else data.select(*map(name, keys)).distinct() if keys else df.sparkSession.range(1).drop("id")
    for i, t in enumerate(wanted):
        if t.op == "Gamma (k, θ)" and not t.bounds:
            cells = cells.withColumn(found[i], fits.gamma_parameters(F.col(found[i])))
        if i in counted:
            x = F.col(alias[t.var])
            own = selection.medians(data, keys, x, found[i], known_as) if t.op == "Median" else selection.modes(data, keys, x, found[i])
            if keys:
                cells = cells.join(own, keys, "left")
            else:
                cells = cells.withColumn(found[i], own.scalar())
            cells = cells.withColumn(found[i], F.array(F.col(found[i]).cast("double")))
    for v, a in alias.items():
        own = [(i, t) for i, t in enumerate(wanted) if t.var == v and _iterative(t)]
        if own:
            fitted = fits.fit_cells(data, keys, a, [(t.op, t.bounds) for _, t in own], known_as=known_as)
            fitted = fitted.select(*map(name, keys), *(name(c).alias(found[i]) for c, (i, _) in zip(fitted.columns[len(keys) :], own, strict=True)))
            if keys:
                cells = cells.join(fitted, keys, "left")
            else:
                got = fitted.first()
                cells = cells.withColumns({found[i]: F.lit(got[found[i]] if got else None).cast("array<double>") for i, _ in own})
    parts = [F.struct(F.lit(t.var).alias("variable"), F.lit(t.operation()).alias("operation"), F.lit(p).alias("parameter"), F.get(F.col(found[i]), F.lit(k)).alias("value")) for i, t in enumerate(wanted) for k, p in enumerate(t.parameters())]
    return cells.select(*map(name, keys), F.inline(F.array(*parts))).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def pivot(long: DataFrame, rows: list[str], cols: list[str], target: str, parameter: str = "", values: list | None = None, separator: str = " | ") -> DataFrame:
    """Wide view of one target: rows down, column cells across, both sorted; a columns-only view has one row named after the variable.

    values: the column cells, if known; otherwise they are found by a distinct over the (small) long result.
    """
    t = Target.parse(target)
    own = long.filter((F.col("variable") == t.var) & (F.col("operation") == t.operation()) & (F.col("parameter") == parameter))
    if not cols:
        return own.select(*map(name, rows), F.col("value").alias(t.var)).orderBy(*map(name, rows))
    (across,) = fresh(own, "across")
    label = F.concat_ws(separator, *(name(c).cast("string") for c in cols)).alias(across)
    if values is None:
        found = own.select(*map(name, cols)).distinct().orderBy(*map(name, cols)).collect()
        values = [separator.join(_label(v) for v in r) for r in found]
    flat = own.select(*map(name, rows), label, "value")
    if rows:
        return flat.groupBy(*map(name, rows)).pivot(across, values).agg(F.first("value")).orderBy(*map(name, rows))
    return flat.groupBy(F.lit(t.var).alias("variable")).pivot(across, values).agg(F.first("value"))


#: Columns of a wide view that are made and named at once.
BLOCK = 1000


def write_wide(long: DataFrame, rows: list[str], cols: list[str], target: str, path: str, parameter: str = "", separator: str = " | ", block: int = BLOCK) -> int:
    """A wide view with more columns than a driver should hold or a plan should name: Parquet folders path/block=0, 1, ..., side by side.

    Column cells are numbered in their order; each block has the row variables and the next so many of them, and a row only
    where it has a value in the block. The driver holds the names of one block at a time. Returns the number of blocks.
    """
    t = Target.parse(target)
    at, across = fresh(long, "at", "across")
    own = long.filter((F.col("variable") == t.var) & (F.col("operation") == t.operation()) & (F.col("parameter") == parameter))
    label = F.concat_ws(separator, *(name(c).cast("string") for c in cols)).alias(across)
    cells = own.select(*map(name, cols), label).distinct().withColumn(at, F.row_number().over(W.orderBy(*map(name, cols))) - 1)
    numbered = stored(own.join(cells.drop(across), cols).select(*map(name, rows), label, (F.col(at) / block).cast("int").alias("block"), at, "value"))
    count = (numbered.agg(F.max("block")).first()[0] or 0) + 1 if not numbered.isEmpty() else 0
    for b in range(count):
        mine = numbered.filter(F.col("block") == b)
        names = [r[0] for r in mine.select(across, at).distinct().orderBy(at).collect()]
        keys = [name(r) for r in rows] or [F.lit(t.var).alias("variable")]
        mine.groupBy(*keys).pivot(across, names).agg(F.first("value")).write.parquet(f"{path}/block={b}")
    return count


def _label(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def _cell(v, decimals: int) -> str:
    if v is None:
        return ""
    if isinstance(v, float):
        return f"{v:.0f}" if v.is_integer() else f"{v:.{decimals}f}"
    return str(v)


def _head(columns: list[str], title: str, rules: list[str] | None, decimals: int) -> list[str]:
    if not 0 <= decimals <= 12:
        raise ValueError("0 to 12 decimals")
    return [*([*rules, ""] if rules else []), title, "".join(f"{c}\t" for c in columns)]


def to_text(wide: DataFrame, title: str, rules: list[str] | None = None, decimals: int = 4) -> str:
    """A small wide result as text, such as for a clipboard: rules, a blank line, then cells each followed by a tab. Large results are for write_text()."""
    lines = _head(wide.columns, title, rules, decimals)
    lines += ["".join(f"{_cell(v, decimals)}\t" for v in r) for r in wide.collect()]
    return "\n".join(lines) + "\n"


def lines_of(wide: DataFrame, decimals: int = 4) -> DataFrame:
    """(value): the rows of a wide result as lines of text, made where they lie and in their order."""

    def cell(c: str, kind: str):
        v = name(c)
        if kind in ("double", "float"):
            whole = F.abs(v) < 2**53
            v = F.when(whole & (v == F.floor(v)), F.floor(v).cast("string")).otherwise(F.format_string(f"%.{decimals}f", v.cast("double")))
        return F.concat(F.coalesce(v.cast("string"), F.lit("")), F.lit("\t"))

    return wide.select(F.concat(*(cell(c, k) for c, k in wide.dtypes)).alias("value"))


def write_text(wide: DataFrame, path: str, title: str, rules: list[str] | None = None, decimals: int = 4, order: list[str] | None = None) -> None:
    """A wide result of any size as a folder of text parts, which read one after another are its text: what to_text() has above the rows, then the
    rows, sorted by the columns of order by ranges. Nothing is collected."""
    head = wide.sparkSession.createDataFrame([(line,) for line in _head(wide.columns, title, rules, decimals)], "value string").coalesce(1)
    rows = wide.orderBy(*map(name, order)) if order else wide
    head.union(lines_of(rows, decimals)).write.text(path)
