"""How far the sources of a language differ in their words: divergences of all pairs, and each source's most overused terms.

Every group (lang, source) gives every term that its language keeps a share, an integer. Two searches avoid to write
all shares down:

* Terms: the terms of a group fall into buckets of equal counts, and so of equal shares. The least and the largest count
  that a bucket's terms have in the language bound what its terms can reach. Buckets that cannot reach the last rank go;
  of the rest the best bound comes first, and evaluation stops once the bounds left are strictly below the kth value.
* Pairs: a term that a source lacks has the source's least share. What this gives follows from buckets alone; the
  postings of the terms correct it where both sources have a term.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, slices, stored, table

#: Documents of its language that a term must be in, ranks of part `term`, and what shares are of.
LEAST_DOCS, TOP, WHOLE = 30, 50, 1_000_000_000
#: Terms that a counting task holds before it hands them on.
HELD = 200_000
#: Parts that a group's candidates are dealt to, and parts that the sources of a language are faced in.
SALTS, BLOCKS = 8, 16
#: Candidates that are evaluated before the bound is looked at again.
STRIDE = 256

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAPS = np.ones(256, dtype=bool)
_GAPS[128:] = _GAPS[65:91] = _GAPS[97:123] = False


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of terms, summed over parts of the tasks; each group also has rows without a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = {}
        d: dict[tuple, Counter] = {}
        held = 0

        def out() -> pa.RecordBatch:
            keys = [(k, t) for k in n for t in (*n[k], None)]
            columns = [[k[0] for k, _ in keys], [k[1] for k, _ in keys], [t for _, t in keys], [n[k][t] for k, t in keys], [d[k][t] for k, t in keys]]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["lang", "source", "term", "n", "d"])

        for whole in batches:
            for begin in range(0, whole.num_rows, STRIDE):
                b = whole.slice(begin, STRIDE)
                for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].to_pylist(), strict=True):
                    all_, in_docs, seen = n.setdefault((lang, source), Counter()), d.setdefault((lang, source), Counter()), set()
                    before = len(all_)
                    for part in slices(text, _GAPS):
                        words = _TERM.findall(part.lower())
                        all_.update(words)
                        seen.update(words)
                    in_docs.update(seen)
                    held += len(all_) - before
                if held > HELD:
                    yield out()
                    n, d, held = {}, {}, 0
        if n:
            yield out()

    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return given.mapInArrow(count, "lang string, source string, term binary, n long, d long")


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(WHOLE * (count + 5) / (total + 5 * terms)) by long division, three decimal digits at a time, so nothing overflows; null without terms."""
    d = f"nullif({total} + 5L * {terms}, 0L)"
    q, r = f"(({count} + 5L) div {d})", f"(({count} + 5L) % {d})"
    for _ in range(3):
        q, r = f"({q} * 1000L + ({r} * 1000L) div {d})", f"(({r} * 1000L) % {d})"
    return F.expr(f"1L + {q}")


def share(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The same over arrays of long."""
    d = total + 5 * terms
    q, r = (count + 5) // d, (count + 5) % d
    for _ in range(3):
        q, r = q * 1000 + r * 1000 // d, r * 1000 % d
    return 1 + q


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, total, head): the occurrences of each kept term in each group that has it and in the language; head marks one row of a
    term; a row without term stands for each group."""
    counts = partial_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    term = W.partitionBy("lang", "term")
    named = counts.withColumns({"total": F.sum("n").over(term), "docs": F.sum("d").over(term), "head": F.col("source") == F.min("source").over(term)})
    return named.filter(F.col("term").isNull() | (F.col("docs") >= least_docs)).select("lang", "source", "term", "n", "total", (F.col("head") & F.col("term").isNotNull()).alias("head"))


def _groups(kept: DataFrame) -> DataFrame:
    """(lang, source, size, own, lang_size, terms, rest): sums over kept terms, terms the group has, terms of the language, share of a term it lacks."""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("term").alias("own"), F.count_if("head").alias("heads"))
    langs = groups.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.sum("heads").alias("terms"))
    return groups.drop("heads").join(langs, "lang").withColumn("rest", F.coalesce(_share("0L", "size", "terms"), F.lit(0).cast("long")))


def _buckets(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, n, members, p, high, low): the terms of a group with equal counts, their share, and bounds of what it exceeds the language's by."""
    buckets = kept.filter("term is not null").groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("members"), F.min("total").alias("least"), F.max("total").alias("most"))
    sized = buckets.join(groups, ["lang", "source"]).withColumn("p", _share("n", "size", "terms"))
    return sized.withColumns({"high": F.col("p") - _share("least", "lang_size", "terms"), "low": F.col("p") - _share("most", "lang_size", "terms")})


def top_terms(kept: DataFrame, groups: DataFrame, buckets: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms whose share in a group most exceeds that in its language."""
    group = W.partitionBy("lang", "source")
    # So many terms reach at least `low`: below the low bound that covers the last rank no bucket is needed.
    covered = F.sum("members").over(group.orderBy(F.desc("low")).rowsBetween(W.unboundedPreceding, 0))
    needed = F.greatest(F.max(F.when(F.col("covered") >= top, F.col("low"))).over(group), F.lit(1))
    open_ = buckets.withColumn("covered", covered).withColumn("needed", needed).filter("high >= needed")
    facing = kept.filter("term is not null").join(open_.select("lang", "source", "n", "p", "high", "lang_size", "terms"), ["lang", "source", "n"])
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("salt")
    dealt = facing.select("lang", "source", salt, "term", "total", "p", "high", "lang_size", "terms").repartition("lang", "source", "salt").sortWithinPartitions("lang", "source", "salt", F.desc("high"))

    def best_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, best = None, []

        def out() -> pd.DataFrame:
            return pd.DataFrame([(*key[:2], term, -f) for f, term in best], columns=["lang", "source", "item", "value"])

        for b in batches:
            keys = list(zip(b["lang"], b["source"], b["salt"], strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            total, p, high, lang_size, terms = (b[c].to_numpy() for c in ("total", "p", "high", "lang_size", "terms"))
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                if keys[begin] != key:
                    if best:
                        yield out()
                    key, best = keys[begin], []
                for at in range(begin, end, STRIDE):
                    if len(best) == top and high[at] < -best[-1][0]:
                        break  # bounds fall, so nothing that follows can rank
                    s = slice(at, min(end, at + STRIDE))
                    f = p[s] - share(total[s], lang_size[s], terms[s])
                    best = sorted([*best, *((-int(v), t) for v, t in zip(f, b["term"][s], strict=True) if v > 0)])[:top]
        if best:
            yield out()

    found = dealt.mapInPandas(best_first, "lang string, source string, item binary, value long")
    ranked = found.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.col("item").cast("string").alias("item"), "value", "rank")


def pair_divergences(kept: DataFrame, groups: DataFrame, buckets: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): for every two sources of a language the differences of their shares, summed over all kept terms.

    The sum over terms of |p - q| is that of the terms that one source has against the other's share of absent terms, both
    ways round, and of absent terms for all others; where both have a term, a correction from its postings.
    """
    steps = buckets.groupBy("lang", "source").agg(F.array_sort(F.collect_list(F.struct("p", "members"))).alias("steps"))
    near = groups.join(steps, ["lang", "source"], "left")
    block = F.pmod(F.xxhash64("source"), F.lit(BLOCKS)).alias("block")
    far = groups.groupBy("lang", block).agg(F.collect_list(F.struct("source", "rest")).alias("far"))
    faced = near.select("lang", "source", "own", "terms", "rest", "steps").join(far, "lang")

    @F.pandas_udf("array<long>")
    def against(p: pd.Series, members: pd.Series, own: pd.Series, rest: pd.Series, rests: pd.Series) -> pd.Series:
        """Of each source of a block: the terms that are there against its absent share, less the same of absent terms."""
        out = []
        for ps, ms, n, r, far_ in zip(p, members, own, rest, rests, strict=True):
            q = np.asarray(far_, dtype=np.int64)
            if ps is None or not len(ps):
                out.append(np.zeros(len(q), dtype=np.int64))
                continue
            ps, ms = np.asarray(ps, dtype=np.int64), np.asarray(ms, dtype=np.int64)
            counts, sums = np.concatenate(([0], np.cumsum(ms))), np.concatenate(([0], np.cumsum(ms * ps)))
            at = np.searchsorted(ps, q)
            out.append(q * counts[at] - sums[at] + sums[-1] - sums[at] - q * (counts[-1] - counts[at]) - int(n) * np.abs(int(r) - q))
        return pd.Series(out)

    sums = faced.withColumn("sum", against("steps.p", "steps.members", "own", "rest", "far.rest"))
    faced_one = F.arrays_zip("far.source", "far.rest", "sum")
    one = sums.select("lang", "source", "terms", "rest", F.explode(faced_one).alias("o")).filter("source <> o.source")
    one = one.select("lang", "source", F.col("o.source").alias("item"), "o.sum", (F.col("terms") * F.abs(F.col("rest") - F.col("o.rest"))).alias("absent"))
    ends = (F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"))
    bases = one.select("lang", *ends, (F.col("sum") + F.when(F.col("source") < F.col("item"), F.col("absent")).otherwise(0)).alias("value"))
    posted = kept.filter("term is not null").join(groups.select("lang", "source", "size", "terms", "rest"), ["lang", "source"]).select("lang", "term", "source", _share("n", "size", "terms").alias("p"), "rest")
    x, y = (posted.select("lang", "term", *(F.col(c).alias(f"{c}_{k}") for c in ("source", "p", "rest"))) for k in "ab")
    both = x.join(y, ["lang", "term"]).filter("source_a < source_b")
    more = F.abs(F.col("p_a") - F.col("p_b")) - F.abs(F.col("p_a") - F.col("rest_b")) - F.abs(F.col("p_b") - F.col("rest_a")) + F.abs(F.col("rest_a") - F.col("rest_b"))
    shared = both.select("lang", F.col("source_a").alias("a"), F.col("source_b").alias("b"), more.alias("value"))
    pairs = bases.unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.*", "value").withColumn("rank", rank)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) of docs.

    Terms are runs of ASCII letters and other than ASCII characters of whole texts, only A-Z lower-cased. Each lang keeps
    the terms of at least least_docs of its rows. A term's share of a group or a language is 1 + floor(10^9 (count + 5) /
    (N + 5 V)), with N the occurrences of all V kept terms there. Part `pair` ranks the other sources of the language by
    the differences of all shares, part `term` the terms whose share is above the language's by how much it is. Null
    lang, source and text are empty strings; rows that repeat count each, also as documents; ties go by item; a language
    without kept terms has pairs of value 0; an empty table gives an empty result; long texts are read in parts; other columns are ignored. Shares
    are exact up to 9 * 10^15 words of a language.
    """
    kept = stored(kept_terms(docs, least_docs))
    groups = materialise(_groups(kept))
    buckets = materialise(_buckets(kept, groups))
    out = [(part, found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))) for part, found in (("pair", pair_divergences(kept, groups, buckets)), ("term", top_terms(kept, groups, buckets, top)))]
    return out[0][1].unionByName(out[1][1])


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op11_divergence": op11_divergence}
ORACLE = {
    "op11_divergence": r"""
WITH t AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
u AS (SELECT id, lang, source, unnest(words) AS term FROM t),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM u GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM t),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM u GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n
      FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
y AS (SELECT lang, source, term, n,
             1 + 1000000000 * (n + 5) // (sum(n) OVER w + 5 * count(*) OVER w) AS p,
             1 + 1000000000 * (total + 5) // (sum(total) OVER w + 5 * count(*) OVER w) AS q
      FROM x WINDOW w AS (PARTITION BY lang, source)),
d AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM y a JOIN y b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM y WHERE n > 0 AND p > q),
s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM s WHERE part = 'pair' OR rank <= 50
"""
}
