"""Column factories: numbers from text, descriptive aggregates, sample-size adjusted z."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sample size and z of the adjusted cutoff. Up to 14 trials z is looked up; from 15 on it is interpolated
# between neighbouring knots; from 100 on it stays; below 4 it is 1.
Z_SMALL = ((4, 1.458), (5, 1.68), (6, 1.841), (7, 1.961), (8, 2.05), (9, 2.12), (10, 2.173), (11, 2.22), (12, 2.246), (13, 2.274), (14, 2.31))
Z_KNOTS = ((15, 2.326), (20, 2.391), (25, 2.41), (30, 2.431), (35, 2.45), (50, 2.48), (100, 2.5))
MAD_SCALE = 1.4826


def name(column: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


#: Rows of a cell that one task takes, tasks over which the rows of one cell are spread when they meet its statistics if nothing is
#: known about its size, the most such tasks, and cells whose statistics may be broadcast.
CELL_ROWS, SALTS, MOST_SALTS, FEW = 1_000_000, 16, 1024, 10_000


class Shape(NamedTuple):
    """What is known about the cells of a table: rows of the largest one, and how many there are. Both only shrink when rows go."""

    largest: int
    cells: int

    @property
    def skewed(self) -> bool:
        """Whether a cell may be too large for a task."""
        return self.largest > CELL_ROWS


def shape(df: DataFrame, keys: list[str]) -> Shape:
    """Measured by one count over the keys."""
    n, cells = df.groupBy(*map(name, keys)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count(F.lit(1))).first()
    return Shape(n or 0, cells)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like these that df doesn't have, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in wanted:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def beside(df: DataFrame, cells: DataFrame, keys: list[str], known_as: Shape | None = None) -> DataFrame:
    """df with the columns of its row of cells, one for each combination of keys; rows whose keys cells doesn't have go.

    Few cells, if that was measured, are broadcast. Else cells stand there once for each salt, so a cell with a large share
    of all rows meets its statistics in several tasks: as many as its measured size asks for.
    """
    if known_as is not None and known_as.cells <= FEW:
        return df.join(F.broadcast(cells), keys)
    salts = SALTS if known_as is None else min(MOST_SALTS, 1 + known_as.largest // CELL_ROWS)
    (salt,) = fresh(df.join(cells.limit(0), keys) if keys else df, "salt")
    salted = df.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    spread = cells.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*keys, salt]).drop(salt)


def known(c: Column) -> Column:
    """NaN is a missing value."""
    return F.when(F.isnan(c), None).otherwise(c)


def number(df: DataFrame, column: str) -> Column:
    """A column as double; text that is no number is missing, and so are Java's numbers with a type suffix."""
    kind, c = df.schema[column].dataType, name(column)
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        text = F.trim(c)
        return known(F.when(~text.rlike("[0-9.][fFdD]$"), text.try_cast("double")))
    return known(c.cast("double"))


def shifting_z(n: Column) -> Column:
    """z for a sample size."""
    out = F.when(n >= Z_KNOTS[-1][0], F.lit(Z_KNOTS[-1][1]))
    for (a, za), (b, zb) in reversed(list(zip(Z_KNOTS, Z_KNOTS[1:], strict=False))):
        out = out.when(n >= a, za + (n - a) * ((zb - za) / (b - a)))
    for k, z in reversed(Z_SMALL):
        out = out.when(n == k, F.lit(z))
    return out.otherwise(F.lit(1.0))


#: Operations of a program's own, by name: what makes their aggregate from a column of numbers.
OWN: dict[str, Callable[[Column], Column]] = {}


def register(op: str, made: Callable[[Column], Column]) -> None:
    """Make an operation that targets can name. made turns a column of numbers, missing ones among them, into one aggregate Column of built-in
    aggregates, so it combines before the shuffle and shares one exchange with all other targets."""
    if not op.strip() or op != op.strip() or "@" in op or "[" in op:
        raise ValueError(f"an operation's name has no blanks around it, no @ and no bracket: {op!r}")
    OWN[op] = made


def descriptive(op: str, x: Column, grouped: bool) -> Column:
    """The aggregate of an operation; missing values are left out.

    The standard error divides by the root of all rows of a cell, but over a whole table by that of its known values.
    """
    if op in OWN:
        return OWN[op](x)
    n = F.count(F.lit(1)) if grouped else F.count(x)
    made: dict[str, functools.partial] = {
        "Mean": functools.partial(F.avg, x),
        "Median": functools.partial(F.median, x),
        "Mode": functools.partial(F.mode, x, True),
        "Count": functools.partial(lambda c: F.count(c).cast("double"), x),
        "Standard Deviation": functools.partial(F.stddev_samp, x),
        "Max": functools.partial(F.max, x),
        "Min": functools.partial(F.min, x),
        "Variance": functools.partial(F.var_samp, x),
        "Standard Error": functools.partial(lambda c: F.stddev_samp(c) / F.sqrt(n), x),
    }
    if op not in made:
        raise ValueError(f"no descriptive operation {op!r}")
    return made[op]()
