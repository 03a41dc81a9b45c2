"""Exact medians, modes and median deviations of cells of any size.

A median is found by narrowing: a level counts the trials of each bin of a cell, running sums over the bins find the ones
that hold the middle ranks, and the next level cuts only those bins finer. Counts combine before their shuffle, so no task
holds the trials of a cell, however large. The first bins are powers of two cut into STEPS parts, the next ones are LEVELS
linear cuts between the least and the largest value of a bin, and the last are single values; as a double has 53 bits, few
of these are left by then. Bins keep the order of the values whatever rounding does, so results are exact.

A mode is the largest count of a (cell, value); counts combine as well, and their maximum needs no buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import Shape, beside, fresh, name

#: Parts of each power of two, linear cuts of a bin, and how often they are made.
STEPS, CUTS, LEVELS = 256, 1 << 16, 2
#: More than the bins on either side of zero.
_FAR = 1 << 20


def _first_bin(x: Column) -> Column:
    """A bin for each double that never falls when x rises; infinities have bins of their own."""
    size = F.when(F.abs(x) == float("inf"), F.lit(2 * _FAR)).otherwise(F.floor(F.log2(F.abs(x)) * STEPS) + _FAR)
    return F.when(x == 0, F.lit(0)).otherwise(F.when(x > 0, size).otherwise(-size)).cast("long")


def _cut(x: Column, low: Column, high: Column) -> Column:
    """One of CUTS equal bins between low and high."""
    return F.when(low < high, F.floor((x - low) / (high - low) * CUTS)).otherwise(0).cast("long")


def medians(df: DataFrame, keys: list[str], x: Column, label: str, known_as: Shape | None = None) -> DataFrame:
    """keys, label: the exact median of the known values of each cell; a cell without any has no row, an empty table none at all.

    Without keys the table is one cell; then each level runs at once and hands the next one its two bins as constants. All values but NaN count, infinities too. Rows with a missing key belong to no cell.
    """
    v, low, high, n, at, ranks, picks, before, origin = fresh(df, "x", "low", "high", "n", "bin", "ranks", "picks", "before", "origin")
    cell = [name(k) for k in keys]
    given = df.select(*cell, x.cast("double").alias(v)).filter(" and ".join(f"{c} is not null" for c in [*(f"`{k}`" for k in keys), v]) + f" and not isnan({v})")

    def holding(bins: DataFrame, whole: bool) -> DataFrame:
        """(keys, low, high, ranks): the bins that hold a wanted rank, as ranks within the bin; of whole cells the middle ranks are wanted."""
        part = W.partitionBy(*cell) if whole else W.partitionBy(*cell, origin)
        sums = bins.withColumn(before, F.coalesce(F.sum(n).over(part.orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        if whole:
            size = F.sum(n).over(part)
            sums = sums.withColumn(ranks, F.array_distinct(F.array(F.shiftright(size + 1, 1), F.shiftright(size + 2, 1))))
        inside = F.filter(F.transform(ranks, lambda r: r - F.col(before)), lambda r: (r > 0) & (r <= F.col(n)))
        return sums.select(*cell, low, high, inside.alias(ranks)).filter(F.size(ranks) > 0)

    def counted(rows: DataFrame, *by: Column) -> DataFrame:
        return rows.groupBy(*cell, *by).agg(F.count(F.lit(1)).alias(n), F.min(v).alias(low), F.max(v).alias(high))

    found = holding(counted(given, _first_bin(F.col(v)).alias(at)), True)
    for level in range(LEVELS + 1):
        # At most two bins of a cell hold a middle rank.
        held = found.groupBy(*cell).agg(F.collect_list(F.struct(low, high, ranks)).alias(picks))
        if keys:
            faced = beside(given, held, keys, known_as)
        else:
            bounds = [F.struct(F.lit(p[0]).alias(low), F.lit(p[1]).alias(high), F.array(*map(F.lit, p[2])).cast("array<long>").alias(ranks)) for p in held.first()[0]]
            faced = given.withColumn(picks, F.array(*bounds)) if bounds else given.limit(0).withColumn(picks, F.lit(None).cast(held.schema[0].dataType))
        pick = F.get(F.filter(picks, lambda p: (p[low] <= F.col(v)) & (F.col(v) <= p[high])), F.lit(0))
        own = faced.withColumn(picks, pick).filter(F.col(picks).isNotNull()).select(*cell, v, F.col(f"{picks}.*"))
        place = F.col(v) if level == LEVELS else _cut(F.col(v), F.col(low), F.col(high))
        found = holding(counted(own, F.col(low).alias(origin), F.col(ranks), place.alias(at)), False)
    # One value, or the two in the middle.
    return found.groupBy(*cell).agg((F.min(low) * 0.5 + F.max(low) * 0.5).alias(label)).filter(name(label).isNotNull())


def modes(df: DataFrame, keys: list[str], x: Column, label: str) -> DataFrame:
    """keys, label: the most frequent known value of each cell, the smallest of equals; a cell without any has null."""
    v, n = fresh(df, "x", "n")
    counts = df.select(*map(name, keys), x.alias(v)).groupBy(*map(name, keys), v).agg(F.count(v).alias(n))
    best = F.min(F.when(F.col(v).isNotNull(), F.struct((-F.col(n)).alias(n), F.col(v)))).alias(n)
    return counts.groupBy(*map(name, keys)).agg(best).select(*map(name, keys), F.col(f"{n}.{v}").alias(label))


def deviations(df: DataFrame, keys: list[str], x: Column, centre: str, label: str, known_as: Shape | None = None) -> DataFrame:
    """keys, centre, label: the median of each cell and the median of the distances from it."""
    (v,) = fresh(df.select(*map(name, keys)), "x")
    own = df.select(*map(name, keys), x.alias(v))
    middle = medians(own, keys, F.col(v), centre, known_as)
    if keys:
        facing = beside(own, middle, keys, known_as)
        return middle.join(medians(facing, keys, F.abs(F.col(v) - name(centre)), label, known_as), keys)
    # Of one cell there is one number, so the second search starts from a constant.
    one = middle.first()
    m = F.lit(one[0] if one else None).cast("double")
    return medians(own, [], F.abs(F.col(v) - m), label).select(m.alias(centre), name(label))
