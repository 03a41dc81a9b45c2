"""The trial-table engine against pandas and hand-made cases."""

import math
import os
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialmill.engine import TrialData
from trialmill.functions import expressions, fits, special
from trialmill.functions.stats import Shape, number, shifting_z
from trialmill.operators import cdf, filters, summary
from trialmill.plans.rules import OPERATIONS, Rule, SummaryPlan, Target, next_operation, parse_rule
from trialmill.sources import matlab, tables

SCHEMA = "subj string, cond string, `target.rt` double"


def odd_frame():
    rng = np.random.default_rng(3)
    rows = [(None, "a", 1.0), ("", "a", 2.0), ("s0", "a", None), ("s0", "a", float("nan")), ("s1", "b", 5.0), ("s2", "a", None), ("s2", "a", None)]
    rows += [("s3", "a", v) for v in (1.0, 1.0, 2.0, 2.0, 3.0)] + [("s4", "b", 4.0)] * 5
    for n in (3, 4, 14, 15, 20, 25, 30, 35, 50, 99, 100):
        rows += [(f"n{n}", "c", float(v)) for v in rng.lognormal(6, 0.6, n)]
    return rows


def pandas_frame():
    return pd.DataFrame(odd_frame(), columns=["subj", "cond", "target.rt"])


# --- rules and plans -------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text",
    ["rt:< mean + 2.5 * SD", "rt:>= mean - 3 * SD", "rt:<= median + 3 * MAD", "rt:> mean - Shifting Z * SD", "rt:> 100 and < 2000", "rt:< 1 or >= 9", "a.b: = 'x' = 3", "rt:Pooling CDF"],
)
def test_rules_are_written_as_they_are_read(text):
    assert parse_rule(parse_rule(text).text()) == parse_rule(text)


def test_rule_details():
    assert parse_rule("rt:> 1 and >= 3").cutoffs[1].op == ">="
    assert parse_rule("rt:> 1 and >= 3", frozenset({"second_op"})).cutoffs[1].op == ">"
    for text, number, loose in (("rt:< .5", 0.5, 5), ("rt:< 1e3", 1000, 1), ("rt:> -2.5", -2.5, -2.5), ("rt:> mean -2.5 * SD", 2.5, -2.5), ("rt:< median + 1.5e0 * MAD", 1.5, 1.5), ("rt:< 0.1234567891", 0.1234567891, 0.1234567891)):
        assert parse_rule(text).cutoffs[0].number == number and parse_rule(parse_rule(text).text()) == parse_rule(text)
        assert parse_rule(text, frozenset({"loose_numbers"})).cutoffs[0].number == loose  # the first run of digits
    assert parse_rule("w: = 'a=b<c:d' = 2").values == ("a=b<c:d", 2.0)
    assert parse_rule("rt: Pooling CDF").kind == "cdf" and parse_rule("rt:") == Rule("rt", "checklist")
    for bad in ("rt", ":< 3", "rt:< x", "rt:< 1 and < 2 and < 3", "rt:< 1.5 or > 3 and < 9", "rt:< mean + -2 * SD", "rt:< 3 ms", "rt:< mean * SD", "rt:< 1 2"):
        with pytest.raises(ValueError):
            parse_rule(bad)
    with pytest.raises(ValueError):
        Target.parse("rt@ex-Gaussian")
    assert next_operation(["Mean", "Median"]) == "Mode" and len(OPERATIONS) == 18


def test_plan_round_trip_and_validation(tmp_path):
    plan = SummaryPlan(["subj"], ["cond"], ["rt:< mean + 2 * SD", "rt:Pooling CDF"], ["rt@Mean"], [None, 0.95])
    back = SummaryPlan.from_config(plan.to_config())
    assert (back.rows, back.cols, back.rules, back.targets) == (plan.rows, plan.cols, plan.rules, plan.targets)
    assert plan.omega_list() == [-1, 0.95]
    compile(plan.to_script(["a.txt"], computed=[("x", "self.data['rt'] * 2")]), "script", "exec")
    plan.validate()
    with pytest.raises(ValueError):
        SummaryPlan(["rt"], [], [], ["rt@Mean"]).validate()
    with pytest.raises((ValueError, SyntaxError)):
        SummaryPlan.from_config("rowList: __import__('os')\ncolumnList: []\ndataList: []\nfilterList: []\n")
    plan.add_rule("rt:> 3", 0)
    plan.move_rule(0, 2)
    assert plan.rules[-1] == "rt:> 3"
    plan.drop_rule(2)
    plan.clear_rules()
    assert plan.rules == []


# --- statistics ------------------------------------------------------------------------------------------------------
def test_shifting_z_knots(spark):
    want = {1: 1, 3: 1, 4: 1.458, 5: 1.68, 14: 2.31, 15: 2.326, 20: 2.391, 25: 2.41, 30: 2.431, 35: 2.45, 50: 2.48, 75: 2.49, 100: 2.5, 500: 2.5}
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in want], "n long").select("n", shifting_z(F.col("n"))).collect()}
    assert all(math.isclose(got[k], v) for k, v in want.items())


def test_numbers_from_text(spark):
    texts = ["1e3", " 2 ", "abc", "", "1.5f", "1d", "inf", "-3", None, "NaN"]
    df = spark.createDataFrame([(t,) for t in texts], "`a.b` string")
    assert [r[0] for r in df.select(number(df, "a.b")).collect()] == [1000.0, 2.0, None, None, None, None, math.inf, -3.0, None, None]


PANDAS = {"Mean": "mean", "Median": "median", "Standard Deviation": "std", "Max": "max", "Min": "min", "Variance": "var", "Count": "count"}


@pytest.mark.parametrize("op", [*PANDAS, "Mode", "Standard Error"])
def test_descriptive_against_pandas(spark, op):
    data = TrialData(spark, spark.createDataFrame(odd_frame(), SCHEMA))
    got = {(r["subj"], r["cond"]): r["value"] for r in data.summarize(["subj"], ["cond"], [], [f"target.rt@{op}"]).collect()}
    groups = pandas_frame().groupby(["subj", "cond"])["target.rt"]
    if op == "Mode":
        want = groups.apply(lambda s: s.mode().iloc[0] if len(s.mode()) else np.nan)
    elif op == "Standard Error":
        want = groups.apply(lambda s: s.std() / math.sqrt(len(s)))
    else:
        want = getattr(groups, PANDAS[op])()
    want = want.dropna().to_dict()
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_global_standard_error_uses_known_values(spark):
    data = TrialData(spark, spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double"))
    assert math.isclose(data.summarize([], [], [], ["x@Standard Error"]).first()["value"], pd.Series([1.0, 2.0, 4.0]).sem())


# --- filters ---------------------------------------------------------------------------------------------------------
def pandas_rule(d, kind, keys):
    x = d["target.rt"]
    by = d.groupby(keys)["target.rt"] if keys else None
    stat = lambda f: by.transform(f) if keys else f(x)
    if kind == "mad":
        m = stat(lambda s: s.median())
        dev = (x - m).abs()
        mad = dev.groupby([d[k] for k in keys]).transform("median") if keys else dev.median()
        return d[x <= m + 2 * 1.4826 * mad]
    if kind == "sd":
        return d[x < stat(lambda s: s.mean()) + 1.5 * stat(lambda s: s.std())]


@pytest.mark.parametrize("kind,rule", [("sd", "target.rt:< mean + 1.5 * SD"), ("mad", "target.rt:<= median + 2 * MAD")])
@pytest.mark.parametrize("keys", [[], ["subj"], ["subj", "cond"]])
@pytest.mark.parametrize("skewed", [False, True])
def test_stat_rules_against_pandas(spark, kind, rule, keys, skewed):
    df = spark.createDataFrame(odd_frame(), SCHEMA)
    got = filters.apply_rules(df, [rule], keys, skewed=skewed).toPandas()
    want = pandas_rule(pandas_frame(), kind, keys)
    assert got.columns.tolist() == want.columns.tolist()
    assert sorted(got["target.rt"]) == sorted(want["target.rt"]) and len(got) == len(want)


def test_rules_see_survivors_and_share_one_exchange(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 1000)] * 1 + [("b", 1.0)], "k string, x double").repartition(3)
    rules = ["x:< 500", "x:< mean + 1 * SD", "x:>= median - 3 * MAD"]
    out = filters.apply_rules(df, rules, ["k"])
    assert sorted(r["x"] for r in out.collect()) == [1.0, 2.0, 3.0]
    result = summary.summarize(out, ["k"], [], ["x@Mean"])
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1


def test_checklists(spark):
    df = spark.createDataFrame([("1", 1.0), ("x=y", 2.0), (None, 3.0), ("1.0", 4.0)], "t string, n double")
    ids = lambda rule, compat=frozenset(): sorted(r["n"] for r in filters.apply_rules(df, [rule], [], compat=compat).collect())
    assert ids("t: = 1") == [1.0, 4.0] and ids("t: = 1", frozenset({"strict_types"})) == []
    assert ids("t: = 'x=y' = '1'") == [1.0, 2.0] and ids("n: = 1 = 4") == [1.0, 4.0] and ids("t:") == []
    assert ids("n: = '1'") == [1.0] and ids("n: = '1'", frozenset({"strict_types"})) == []


def test_guards_and_helpers(spark):
    df = spark.createDataFrame(odd_frame(), SCHEMA)
    with pytest.raises(ValueError):
        filters.check_keys(df, ["subj"])
    with pytest.raises(ValueError):
        TrialData(spark, df).summarize(["subj"], [], [], ["target.rt@Mean"], strict=True)
    assert filters.distinct_values(df, "cond").count() == 3
    texts = spark.createDataFrame([("1", "a"), (" ", "2")], "n string, t string")
    assert filters.looks_numeric(texts, "n") and not filters.looks_numeric(texts, "t")


# --- expressions -----------------------------------------------------------------------------------------------------
def test_expressions_against_pandas(spark):
    p = pd.DataFrame({"a.b": [1.0, 0.0, -2.0, None], "c": [2.0, 0.0, 3.0, 1.0]})
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None).values.tolist(), "`a.b` double, c double").coalesce(1)
    a, c = p["a.b"], p["c"]
    with np.errstate(all="ignore"):
        cases = {
            "self.data['a.b'] + 2 * self.data['c']": a + 2 * c,
            "aggData.data['a.b'] / self.dataFrame['c']": a / c,
            "-self.data['c'] ** 2 - +1": -(c**2) - 1,
            "np.log(self.data['a.b'])": np.log(a),
            "np.exp(self.data['c'])": np.exp(c),
            "self.data['a.b'] != 1": a != 1,
            "~(self.data['a.b'] > 0)": ~(a > 0),
            "np.logical_and(self.data['a.b'], self.data['c'] > 0)": np.logical_and(a, c > 0),
            "(self.data['a.b'] <= 1) & (self.data['c'] >= 1)": (a <= 1) & (c >= 1),
            "(self.data['a.b'] == 1) | (self.data['c'] < 1)": (a == 1) | (c < 1),
            "self.data['c'][1:3]": c[1:3].reindex(c.index),
        }
    for text, want in cases.items():
        got = [r["y"] for r in expressions.compute(df, "y", text).sort("c").collect()]
        order = c.sort_values(kind="stable").index
        want = [None if isinstance(v, float) and math.isnan(v) else v for v in want[order].tolist()]
        assert all((g is None and w is None) or g == w or math.isclose(g, w) for g, w in zip(got, want)), (text, got, want)


def test_expressions_refuse_everything_else(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    for bad in ("__import__('os')", "self.data['x'].mean()", "np.sin(self.data['x'])", "self.data['y']", "1 < self.data['x'] < 2", "self.data[['x']]", "np.log(**{})", "[1]", "lambda: 1", "self.x"):
        with pytest.raises((ValueError, SyntaxError)):
            expressions.compute(df, "z", bad)
    with pytest.raises(ValueError):
        expressions.compute(df, "x", "1", overwrite=False)


def test_boxcox_lambda(spark):
    x = np.exp(np.random.default_rng(1).normal(3, 0.4, 2000))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    from trialmill.functions import boxcox

    assert abs(boxcox.best_lambda(df, F.col("x"))) < 0.15
    with pytest.raises(ValueError):
        boxcox.best_lambda(df.union(df.limit(1).select(F.lit(-1.0))), F.col("x"))


def test_boxcox_beyond_the_first_grid(spark):
    from trialmill.functions import boxcox

    rng = np.random.default_rng(2)
    for true in (8.0, -7.0):
        x = (1 + true * rng.normal(0, 0.01, 3000)) ** (1 / true)
        df = spark.createDataFrame([(float(v) * 300,) for v in x], "x double")
        got = boxcox.best_lambda(df, F.col("x"))
        y = np.log(x / np.exp(np.log(x).mean()))
        loss = lambda v: np.var(np.expm1(v * y) / v)
        assert loss(got) <= min(loss(v) for v in np.linspace(-40, 40, 2001)) * (1 + 1e-9)


@pytest.mark.parametrize("true", [3.0, 0.0, 0.0002, -0.5])
def test_boxcox_in_three_reads(spark, true):
    from trialmill.functions import boxcox

    rng = np.random.default_rng(4)
    z = np.clip(rng.normal(0, 0.1, 20_000), -0.3, 0.3)
    x = np.exp(z) if true == 0 else (1 + true * z) ** (1 / true)
    df = spark.createDataFrame(pd.DataFrame({"x": x * 50})).repartition(3)
    got, jobs = jobs_of(spark, lambda: boxcox.best_lambda(df, F.col("x")))
    y = np.log(x) - np.log(x).mean()
    slope = lambda v: np.cov(np.expm1(v * y) / v, (y * np.exp(v * y) - np.expm1(v * y) / v) / v)[0, 1]
    # The slope of the variance changes its sign within a millionth.
    assert slope(got - 1e-6) < 0 < slope(got + 1e-6)
    assert jobs <= 9  # three aggregations, each of three stages here
    assert abs(got - true) < 0.3


def test_boxcox_without_spread(spark):
    from trialmill.functions import boxcox

    of = lambda *v: boxcox.best_lambda(spark.createDataFrame([(x,) for x in v], "x double"), F.col("x"))
    assert of() == of(None) == of(3.0) == of(2.0, 2.0) == 1.0
    with pytest.raises(ValueError):
        of(1.0, 0.0)


def test_columns_named_like_helpers_stay(spark):
    names = ["mean", "__mean", "sd", "n", "median", "mad", "salt", "fit", "fit0", "x", "place", "part", "row", "first", "low", "quartiles"]
    rows = [("s", float(v), *(111 + v for _ in names)) for v in range(60)]
    df = spark.createDataFrame(rows, ["key", "rt", *names])
    for skewed in (True, False):
        kept = filters.apply_rules(df, ["rt:< mean + 1 * SD", "rt:> median - 3 * MAD", "rt:< mean + Shifting Z * SD"], ["key"], skewed=skewed)
        assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} < set(rows)
    placed = expressions.compute(df, "z", "self.data['rt'][1:]")
    assert placed.select(df.columns).exceptAll(df).isEmpty()
    from trialmill.operators import cdf

    assert cdf.pooled(df, "rt", ["key"]).select(df.columns).exceptAll(df).isEmpty()


def test_a_large_cell_is_spread_over_tasks(spark):
    from trialmill.functions import stats

    df = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("key"), F.rand(1).alias("rt"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = stats.beside(df, df.groupBy("key").agg(F.avg("rt").alias("m")), ["key"])
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 40_000 and max(sizes) < 12_000  # the cell has 36,000 rows


# --- fits ------------------------------------------------------------------------------------------------------------
CASES = {
    "Gamma (k, θ)": [2.5, 120],
    "Weibull (k, θ)": [2.5, 120],
    "LogNormal (k, θ)": [0.8, 120],
    "Wald (m, a)": [1.5, 0.8],
    "Ex-Wald (m, a, τ)": [1.5, 0.8, 0.5],
    "Shifted Wald (m, a, shift)": [1.5, 0.8, 0.5],
    "Ex-Gaussian (μ, σ, τ)": [900, 150, 300],
    "Inv-Gaussian (μ, λ)": [500, 200],
    "Shifted Inv-Gaussian (μ, λ, shift)": [500, 200, 50],
}


def single_values(x):
    """So many draws that the maximum of their likelihood lies close to the truth."""
    return {op: fits.simulate(op, want, 40_000) for op, want in x.items()}


def test_parameter_recovery(spark):
    """All families within a tenth, each from a start that knows nothing of the truth."""
    rows = [(op, float(v)) for op, x in single_values(CASES).items() for v in x]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "x"]))
    for op, want in CASES.items():
        got = [r["value"] for r in summary.summarize(df.filter(F.col("k") == op), ["k"], [], [f"x@{op}"]).collect()]
        assert len(got) == len(want) and all(abs(g - w) <= 0.1 * abs(w) for g, w in zip(got, want)), (op, got)


def newton_left(op, x, params, bounds=None):
    """How far the coordinates still are from the maximum over all single values."""
    scale = fits.Scale(op, bounds, x.min(), x.max(), fits._spread(x, np.ones(len(x))))
    u = scale.forth(params)
    return np.abs(np.linalg.solve(scale.curvature(x, np.ones(len(x)), u), scale.scores(x, u).sum(axis=0))).max()


@pytest.mark.parametrize("op, n", [("Weibull (k, θ)", 1_000_000), ("Shifted Wald (m, a, shift)", 60_000), ("Ex-Gaussian (μ, σ, τ)", 100_000), ("Ex-Wald (m, a, τ)", 30_000), ("Shifted Inv-Gaussian (μ, λ, shift)", 60_000)])
def test_fits_are_the_maximum_over_single_trials(spark, op, n):
    x = fits.simulate(op, CASES[op], n)
    df = spark.createDataFrame(pd.DataFrame({"k": np.where(np.arange(n) % 10 < 9, "large", "small"), "x": x})).repartition(8)
    for r in fits.fit_cells(df, ["k"], "x", [op], known_as=Shape(n, 2)).collect():
        assert newton_left(op, x[(np.arange(n) % 10 < 9) == (r.k == "large")], r[1]) < 1e-6


def test_one_fit_whatever_the_way_to_the_rows(spark):
    op = "Shifted Wald (m, a, shift)"
    x = fits.simulate(op, CASES[op], 20_000)
    df = spark.createDataFrame(pd.DataFrame({"k": "g", "x": x})).repartition(3)
    whole, salted, broadcast = (fits.fit_cells(df, keys, "x", [op], known_as=known_as).first()[-1] for keys, known_as in (([], None), (["k"], None), (["k"], Shape(20_000, 1))))
    assert newton_left(op, x, whole) < 1e-6 and np.allclose(whole, salted, rtol=1e-9) and np.allclose(whole, broadcast, rtol=1e-9)


@pytest.mark.parametrize("outlier", [None, 10_000.0, 1_000_000.0, 1e12])
def test_binned_fit_is_the_exact_one_with_outliers_too(spark, outlier):
    x = fits.simulate("Ex-Gaussian (μ, σ, τ)", [500, 50, 150], 5000)
    x = x if outlier is None else np.append(x, outlier)
    for op in ("Ex-Gaussian (μ, σ, τ)", "Weibull (k, θ)", "Shifted Wald (m, a, shift)"):
        df = spark.createDataFrame([("g", float(v)) for v in x], "k string, x double").repartition(3)
        got = fits.fit_cells(df, ["k"], "x", [op]).first()[1]
        single = fits.ITERATIVE[op](np.sort(x), np.ones(len(x)))
        # The search over single values, and a likelihood that is not below its own; where it is flat, the two may lie apart.
        assert fits.logs(op, x, got, None).sum() >= fits.logs(op, x, single, None).sum() - 1e-6, op
        assert newton_left(op, x, got) < 1e-5, op
    points = fits.weighted_values(df, ["k"], "x").first()["points"]
    assert points[-1]["x"] == x.max() and points[0]["x"] == x.min() and sum(p["w"] for p in points) == len(x)
    whole = fits.weighted_values(df, [], "x").first()["points"]
    assert (whole[0]["x"], whole[-1]["x"]) == (x.min(), x.max()) and sum(p["w"] for p in whole) == len(x)


def test_points_do_not_grow_with_trials(spark):
    df = spark.range(300_000).select((F.rand(5) * 100 + 300).alias("x"))
    assert fits.weighted_values(df, [], "x").select(F.size("points")).first()[0] < 2 * fits.STEPS


def test_bounded_fits_recover_what_was_cut_off(spark):
    """Through a summary, from unbounded starts; values beyond the bounds are an error."""
    for op in ("Weibull (k, θ)", "LogNormal (k, θ)", "Ex-Gaussian (μ, σ, τ)", "Inv-Gaussian (μ, λ)", "Gamma (k, θ)", "Wald (m, a)"):
        x = fits.simulate(op, CASES[op], 60_000)
        bounds = tuple(float(f"{q:.4g}") for q in np.quantile(x, [0.03, 0.95]))
        seen = x[(x >= bounds[0]) & (x <= bounds[1])]
        df = spark.createDataFrame(pd.DataFrame({"k": "g", "x": seen}))
        target = f"x@{op} [{bounds[0]:g}, {bounds[1]:g}]"
        rows = summary.summarize(df, ["k"], [], [target]).collect()
        got = [r["value"] for r in rows]
        assert {r["operation"] for r in rows} == {target[2:]}
        assert all(abs(g - v) < 0.1 * abs(v) for g, v in zip(got, CASES[op], strict=True)), (op, got)
        assert newton_left(op, seen, got, bounds) < 1e-6
    with pytest.raises(Exception, match="beyond the bounds"):
        summary.summarize(df, ["k"], [], ["x@Gamma (k, θ) [0.1, 0.2]"]).collect()


def test_bounds_of_targets():
    t = Target.parse("a@b@Gamma (k, θ) [ -1.5, inf ]")
    assert (t.var, t.op, t.bounds, t.text()) == ("a@b", "Gamma (k, θ)", (-1.5, math.inf), "a@b@Gamma (k, θ) [-1.5, inf]")
    assert Target.parse(t.text()) == t and Target.parse("a@Gamma (k, θ)").bounds is None
    for bad in ("a@Mean [1, 2]", "a@Gamma (k, θ) [2, 1]", "a@Gamma (k, θ) [1]", "a@Gamma (k, θ) []"):
        with pytest.raises(ValueError):
            Target.parse(bad)


def test_cells_that_cannot_be_fitted(spark):
    rows = [("one", 3.0), ("same", 2.0), ("same", 2.0), ("none", None), ("low", -1.0), ("low", -2.0)] + [("good", float(v)) for v in fits.simulate("Weibull (k, θ)", [2.5, 120], 200)]
    df = spark.createDataFrame(rows, "k string, x double")
    for r in fits.fit_cells(df, ["k"], "x", list(fits.ITERATIVE)).collect():
        assert all(v is None or all(map(math.isfinite, v)) for v in r[1:]) and (r.k != "good" or None not in r)
    assert fits.fit_cells(df.limit(0), ["k"], "x", ["Weibull (k, θ)"]).collect() == []


def test_special_functions():
    assert np.isclose(special.digamma(1.0), -0.5772156649015329) and np.isclose(special.trigamma(1.0), math.pi**2 / 6)
    z = np.array([0.5 + 0.5j, 2 + 1j, 0.01 + 3j])
    assert np.allclose(special.faddeeva(1j * np.array([0.5, 1.0, 2.0])).real, np.exp([0.25, 1.0, 4.0]) * special.erfc(np.array([0.5, 1.0, 2.0])), atol=1e-10)
    assert np.isfinite(special.faddeeva(z)).all() and np.isclose(special.log_phi(np.array([-20.0]))[0], -203.917155, atol=1e-5)
    t = np.linspace(0.001, 60, 400001)
    for m, tau in ((1.5, 0.5), (2.5, 0.8)):  # both branches
        pdf = special.exwald_pdf(t, m, 0.8, tau)
        assert np.isclose(np.trapezoid(pdf, t), 1, atol=1e-3)
        assert np.isclose(special.exwald_cdf(np.array([1.0]), m, 0.8, tau)[0], np.trapezoid(pdf[t <= 1], t[t <= 1]), atol=1e-3)
    assert np.isclose(special.gamma_cdf(np.array([1.0]), 1.0, 1.0)[0], 1 - math.exp(-1)) and np.isclose(special.invgauss_cdf(np.array([1.0]), 1.0, 1.0)[0], 0.6681020012)


# --- pooled probabilities --------------------------------------------------------------------------------------------
def test_pooled_cdf_and_omega(spark):
    x = fits.simulate("Ex-Gaussian (μ, σ, τ)", [900, 150, 300], 400)
    df = spark.createDataFrame([("ab"[i % 2], float(v)) for i, v in enumerate(x)], "k string, `target.rt` double")
    marked = cdf.pooled(df, "target.rt", ["k"])
    values = np.sort([r["target.rt_cdf"] for r in marked.collect()])
    assert np.abs(values - np.arange(400) / 400).max() < 0.06
    assert filters.apply_rules(df, ["target.rt:Pooling CDF"], ["k"], [0.9]).count() < filters.apply_rules(df, ["target.rt:Pooling CDF"], ["k"], [0.9], keep="below").count()
    assert filters.apply_rules(df, ["target.rt:Pooling CDF"], [], None).count() == 400
    assert cdf.histogram(marked, "target.rt_cdf").agg(F.sum("n")).first()[0] == 400
    with pytest.raises(ValueError):
        cdf.pooled(df.limit(40), "target.rt", ["k"])
    sample = spark.createDataFrame([(float(c),) for c in cdf.simulate(20000, 0.05, 0.95)], "c double")
    p, omega = cdf.fit_omega(sample, "c")
    assert abs(p - 0.05) < 0.02 and abs(omega - 0.95) < 0.02


# --- reshape ---------------------------------------------------------------------------------------------------------
def test_pivots_and_text(spark):
    df = spark.createDataFrame([("a", 1.0, "x", 10.0), ("a", 2.0, "y", 20.5), ("b", 1.0, "x", 30.0)], "r string, c double, d string, v double")
    long = summary.summarize(df, ["r"], ["c", "d"], ["v@Mean"])
    wide = summary.pivot(long, ["r"], ["c", "d"], "v@Mean")
    assert wide.columns == ["r", "1.0 | x", "2.0 | y"] and [tuple(r) for r in wide.collect()] == [("a", 10.0, 20.5), ("b", 30.0, None)]
    assert summary.to_text(wide, "v@Mean", ["v:> 1"]).splitlines() == ["v:> 1", "", "v@Mean", "r\t1.0 | x\t2.0 | y\t", "a\t10\t20.5000\t", "b\t30\t\t"]
    cols = summary.pivot(summary.summarize(df, [], ["d"], ["v@Max"]), [], ["d"], "v@Max")
    assert [tuple(r) for r in cols.collect()] == [("v", 30.0, 20.5)]
    singles = summary.summarize(df, ["r", "d"], [], ["v@Standard Deviation", "v@Count"])
    assert {r["operation"] for r in singles.collect()} == {"Count"}


def test_text_of_a_large_result(spark, tmp_path):
    df = spark.createDataFrame([(f"r{i:05}", i / 3, float(i), None if i % 2 else "x") for i in range(3000)], "`r.k` string, a double, b double, c string").repartition(5)
    summary.write_text(df, str(tmp_path / "text"), "title", ["v:> 1"], order=["r.k"])
    parts = sorted((tmp_path / "text").glob("part-*"))
    assert len(parts) > 1 and "".join(p.read_text() for p in parts) == summary.to_text(df.orderBy("`r.k`"), "title", ["v:> 1"])


def test_wide_views_in_blocks(spark, tmp_path):
    n = 2500
    df = spark.range(3 * n).select((F.col("id") % 3).alias("r"), F.floor(F.col("id") / 3).alias("c"), F.lit("d").alias("d"), F.col("id").cast("double").alias("v")).filter("r < 2 or c < 10")
    long = summary.summarize(df, ["r"], ["c", "d"], ["v@Mean"])
    assert summary.write_wide(long, ["r"], ["c", "d"], "v@Mean", str(tmp_path / "w"), block=1000) == 3
    first, last = (spark.read.parquet(str(tmp_path / f"w/block={b}")) for b in (0, 2))
    assert first.columns == ["r", *(f"{c} | d" for c in range(1000))] and last.columns == ["r", *(f"{c} | d" for c in range(2000, n))]
    assert sorted((r.r, r["7 | d"]) for r in first.collect()) == [(0, 21.0), (1, 22.0), (2, 23.0)] and first.filter("r = 2").first()["10 | d"] is None
    assert sorted(r.r for r in last.collect()) == [0, 1]
    assert summary.write_wide(long.limit(0), ["r"], ["c", "d"], "v@Mean", str(tmp_path / "x")) == 0


def test_registered_operations_share_one_exchange(spark):
    from trialmill.functions.stats import OWN, register

    register("Spread", lambda x: F.max(x) - F.min(x))
    try:
        df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 4.0), ("b", None)], "k string, x double")
        out = summary.summarize(df, ["k"], [], ["x@Spread", "x@Mean"])
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert sorted(map(tuple, out.collect())) == [("a", "x", "Mean", "", 2.5), ("a", "x", "Spread", "", 3.0)]
        assert SummaryPlan(["k"], [], [], ["x@Spread"]).validate() is None
    finally:
        del OWN["Spread"]
    with pytest.raises(ValueError):
        Target.parse("x@Spread")
    with pytest.raises(ValueError):
        register("a@b", F.max)


# --- files -----------------------------------------------------------------------------------------------------------
def test_piped_round_trip(spark, tmp_path):
    one = tmp_path / "1.txt"
    one.write_text('"name"|"age"|"target.rt"|"note"\n"al"|"24"|0.5|""\n"bo"|"25"|""|"x ""q"""\n')
    two = tmp_path / "2.txt"
    two.write_text('"name"|"extra"\n"cy"|7\n')
    df = tables.read_piped(spark, [str(one), str(two)])
    assert dict(df.dtypes) == {"name": "string", "age": "double", "target.rt": "double", "note": "string", "extra": "double"}
    tables.write_piped(df, str(tmp_path / "out"))
    back = tables.read_piped(spark, [str(tmp_path / "out")])
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    TrialData(spark, df).save_piped(str(tmp_path / "kept"), rules=["age:> 24"])
    assert tables.read_piped(spark, [str(tmp_path / "kept")]).count() == 1


def test_delimited_text(spark, tmp_path):
    a = tmp_path / "a.txt"
    a.write_text("  subj rt \n s1 10\n s2 20 extra\n s3\n")
    df = tables.read_any(spark, [str(a)])
    assert df.columns == ["subj", "rt", "untitled0", "fileName"]
    assert sorted(tuple(r) for r in df.collect()) == [("s1", "10", None, "a.txt"), ("s2", "20", "extra", "a.txt"), ("s3", None, None, "a.txt")]
    b = tmp_path / "b.csv"
    b.write_bytes("名,x\n甲,1\n".encode("gbk"))
    g = tables.read_text(spark, str(b), encoding="gbk", delimiter=",", file_name=False)
    assert [tuple(r) for r in g.collect()] == [("甲", "1")] and g.columns == ["名", "x"]
    c = tmp_path / "c.dat"
    c.write_text("1|2\n3|4\n")
    n = tables.read_text(spark, str(c), header=False, delimiter="|")
    assert n.columns == ["Column1", "Column2", "fileName"] and n.count() == 2
    assert tables.preview(n, 1).count() == 1
    with pytest.raises(ValueError):
        tables.read_any(spark, ["x.zip"])
    assert tables.legal_names(spark.createDataFrame([(1, 2, 3)], "`a b` int, `1x` int, `ab` int")).columns == ["ab", "col1x", "ab_1"]


def test_names_are_unique():
    assert tables.unique(["a", "a", "a_1"]) == ["a", "a_2", "a_1"]
    assert tables.unique(["a", "A", "a", "b"]) == ["a", "A_1", "a_2", "b"]
    for names in (["x_1", "x", "x", "x_1"], ["", "", "_1"]):
        assert len({n.lower() for n in tables.unique(names)}) == len(names)


def jobs_of(spark, made):
    sc, group = spark.sparkContext, f"counted-{uuid.uuid4()}"
    sc.setJobGroup(group, group)
    out = made()
    found = len(sc.statusTracker().getJobIdsForGroup(group))
    sc.setLocalProperty("spark.jobGroup.id", None)
    return out, found


def test_many_files_are_one_scan(spark, tmp_path):
    n = 400
    for i in range(n):
        head, row = ('"id"|"rt"', f"{i}|0.5") if i % 3 else ('"rt"|"extra"|"id"', f'0.25|"e"|{i}')
        (tmp_path / f"f {i}.txt").write_text(f"{head}\n{row}\n")
    paths = [str(tmp_path / f"f {i}.txt") for i in range(n)]
    df, jobs = jobs_of(spark, lambda: tables.read_piped(spark, paths))
    _, few = jobs_of(spark, lambda: tables.read_piped(spark, paths[:40]))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # As many jobs for 40 files: for headers, for types, and to list paths beyond 32.
    assert jobs == few <= 7 and plan.count("Relation [") == 1 and df.columns == ["rt", "extra", "id"]
    assert df.agg(F.count("extra"), F.sum("id"), F.sum("rt")).first() == (134, sum(range(n)), 0.25 * 134 + 0.5 * 266)


def test_a_large_gbk_file_is_read_by_several_tasks(spark, tmp_path):
    rows = ["名 值"] + [f"甲{i} {i}乙" for i in range(60_000)]
    one, two = tmp_path / "g.txt", tmp_path / "u.txt"
    one.write_bytes("\r\n".join(rows).encode("gbk"))
    two.write_text("\n".join(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        g = tables.read_texts(spark, [str(one)], encoding="gbk", file_name=False)
        assert g.rdd.getNumPartitions() > 3 and g.columns == ["名", "值"] and g.count() == 60_000
        assert g.exceptAll(tables.read_texts(spark, [str(two)], file_name=False)).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(ValueError):
        tables.read_texts(spark, [str(one)], encoding="utf-16")


def test_files_of_different_headers_and_appending(spark, tmp_path):
    for i, text in enumerate(("\n a b\n1 2\n\n3 4 5\n", "b c\nx y\n", "", "a\n")):
        (tmp_path / f"{i}.txt").write_text(text)
    paths = [str(tmp_path / f"{i}.txt") for i in range(4)]
    df = tables.read_texts(spark, paths)
    assert df.columns == ["a", "b", "untitled0", "c", "fileName"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("1", "2", None, None, "0.txt"), ("3", "4", "5", None, "0.txt"), (None, "x", None, "y", "1.txt")], key=str)
    data = TrialData(spark).read_text(paths[:1]).read(paths[1:2], append=True)
    assert set(data.data.columns) == set(df.columns) and data.data.count() == 3
    (tmp_path / "p.psydata").write_text('"a"|"rt"\n"z"|1\n')
    assert data.read_piped([str(tmp_path / "p.psydata")], append=True).data.count() == 4
    assert tables.read_piped(spark, [paths[2]]).count() == 0


def mat_element(kind, data):
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def mat_array(value, name=b""):
    cls, body, dims = 6, b"", (1, 1)
    if isinstance(value, list) and value and isinstance(value[0], list):
        cls, dims = 1, (len(value), len(value[0]))
        body = b"".join(mat_array(value[r][c]) for c in range(dims[1]) for r in range(dims[0]))
    elif isinstance(value, str):
        cls, dims, body = 4, (1, len(value)), mat_element(17, value.encode("utf-16-le"))
    else:
        numbers = value if isinstance(value, list) else [value]
        dims, body = (1, len(numbers)), mat_element(9, struct.pack(f"<{len(numbers)}d", *numbers))
    inner = mat_element(6, struct.pack("<II", cls, 0)) + mat_element(5, struct.pack("<2i", *dims)) + mat_element(1, name) + body
    return mat_element(14, inner)


def test_matlab_files(spark, tmp_path):
    cells = [["subj", "rt", []], ["s1", 0.5, [1.0, 2.0]], ["s2", [], 3.0]]
    header = b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    plain, packed, other = tmp_path / "a.mat", tmp_path / "b.mat", tmp_path / "c.mat"
    plain.write_bytes(header + mat_array(cells, b"allResults_APL"))
    z = zlib.compress(mat_array(cells, b"allResults_APL"))
    packed.write_bytes(header + struct.pack("<II", 15, len(z)) + z)
    other.write_bytes(header + mat_array(1.0, b"x"))
    assert matlab.version(header) == 1
    df = TrialData(spark).read_matlab([str(plain), str(packed), str(other)]).data
    assert sorted(df.columns) == ["filename", "rt", "subj", "untitled1"] and df.count() == 4
    row = df.filter("subj = 's1' and filename = 'a.mat'").first()
    assert row["rt"] == 0.5 and row["untitled1"] == "1,2"
    assert df.filter("subj = 's2' and rt is null").count() == 2
    new = b"MATLAB 7.3".ljust(124) + struct.pack("<H", 0x0200) + b"IM"
    with pytest.raises(ValueError):
        matlab.decode(new)
    assert (matlab.flatten_73([1.0, 2.0]), matlab.flatten_73([1.0, 2.0], True), matlab.flatten_73(True), matlab.flatten_73([]), matlab.flatten_73(["a"])) == (-3.0, 3.0, 1.0, None, "a")


def test_entry_and_catalogue(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "bench.py"))


def test_slices_count_in_the_order_that_is_asked_for(spark):
    """Two slices in a row, with rows spread over partitions in another order and no join broadcast by itself."""
    df = spark.range(400).select(F.col("id"), (F.col("id") * 2.0).alias("v")).repartition(7)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        data = TrialData(spark, df).sort(["id"]).compute("part", "self.data['v'][100:300:3]").compute("rest", "self.data['v'][7:] + 1")
        got = sorted(map(tuple, data.data.select("id", "part", "rest").collect()))
        loaded = expressions.compute(expressions.compute(df, "a", "self.data['v'][5:]"), "b", "self.data['v'][:40]").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(i, i * 2.0 if 100 <= i < 300 and (i - 100) % 3 == 0 else None, i * 2.0 + 1 if i >= 7 else None) for i in range(400)]
    assert len(loaded) == 400 and sum(r["a"] is None for r in loaded) == 5 and sum(r["b"] is not None for r in loaded) == 40


def test_shifted_inverse_gaussian_beside_zero(spark):
    """A least value of zero leaves the shift no place; one close to it wants more than two rounds."""
    op = "Shifted Inv-Gaussian (μ, λ, shift)"
    x = np.round(np.random.default_rng(7).exponential(50, 20_000), 2)
    near = np.append(x[x > 0.05], 0.01)
    df = spark.createDataFrame([("zero", 0.0), ("zero", 1.0), ("zero", 4.0), *(("near", float(v)) for v in near)], "k string, x double")
    got = {r[0]: r[1] for r in fits.fit_cells(df, ["k"], "x", [op]).collect()}
    assert got["zero"] == [0.0, pytest.approx(5 / 3), 0.0] and math.copysign(1, got["zero"][2]) == 1
    # Here the likelihood falls in the shift, so the shift is zero and the shape has its closed form.
    assert got["near"] == pytest.approx([1 / (np.mean(1 / near) - 1 / near.mean()), near.mean(), 0.0], rel=1e-8, abs=1e-9)
