"""Medians, modes and deviations found by counts: exact, and without a task that holds a cell."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from trialmill.engine import TrialData
from trialmill.functions.stats import Shape
from trialmill.operators import selection, summary

SCHEMA = "k string, x double, n string"


def values(kind, n, rng):
    return {
        "near": lambda: [rng.gauss(0.5, 1e-9) for _ in range(n)],
        "wide": lambda: [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)],
        "ties": lambda: [float(rng.randrange(4)) for _ in range(n)],
        "outlier": lambda: [rng.random() for _ in range(n - 1)] + [1e18],
        "small": lambda: [rng.choice([5e-324, -5e-324, 0.0, -0.0]) for _ in range(n)],
        "powers": lambda: [2.0 ** rng.randint(-3, 3) * (1 + rng.choice([-1, 0, 1]) * 2.0**-52) for _ in range(n)],
    }[kind]()


@pytest.mark.parametrize("n", [1, 2, 501])
def test_medians_are_exact(spark, n):
    rng = random.Random(n)
    cells = {k: values(k, n, rng) for k in ("near", "wide", "ties", "outlier", "small", "powers")}
    rows = [(k, v, "c") for k, vs in cells.items() for v in vs] + [("near", None, "c"), ("none", None, "c"), (None, 7.0, "c"), ("near", float("nan"), "c")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for known_as in (None, Shape(n, 6)):
        got = {r.k: r.m for r in selection.medians(df, ["k"], F.col("x"), "m", known_as).collect()}
        assert got == {k: statistics.median(vs) for k, vs in cells.items()}
    every = [r[1] for r in rows if r[1] is not None and r[1] == r[1]]
    assert selection.medians(df, [], F.col("x"), "m").collect()[0].m == statistics.median(every)


def test_infinities_have_bins_of_their_own(spark):
    df = spark.createDataFrame([("a", v, "") for v in (float("-inf"), 1.0, 2.0, float("inf"), float("inf"))], SCHEMA)
    assert selection.medians(df, ["k"], F.col("x"), "m").first().m == 2.0
    assert selection.medians(df.filter("x > 1"), ["k"], F.col("x"), "m").first().m == float("inf")


def test_modes_and_deviations(spark):
    rng = random.Random(5)
    cells = {k: values(k, 301, rng) for k in ("near", "ties", "outlier", "powers")}
    df = spark.createDataFrame([(k, v, "c") for k, vs in cells.items() for v in vs] + [("none", None, "c")], SCHEMA).repartition(3)
    best = {k: min(vs, key=lambda v: (-vs.count(v), v)) for k, vs in cells.items()}
    assert {r.k: r.n for r in selection.modes(df, ["k"], F.col("x"), "n").collect()} == best | {"none": None}
    for r in selection.deviations(df, ["k"], F.col("x"), "n", "deviation").collect():
        m = statistics.median(cells[r.k])
        assert (r.n, r.deviation) == (m, statistics.median(abs(v - m) for v in cells[r.k]))
    (one,) = selection.deviations(df, [], F.col("x"), "median", "mad").collect()
    every = [v for vs in cells.values() for v in vs]
    assert (one.median, one.mad) == (statistics.median(every), statistics.median(abs(v - one.median) for v in every))


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert selection.medians(df, ["k"], F.col("x"), "m").collect() == []
    assert selection.medians(df, [], F.col("x"), "m").collect() == []
    assert summary.summarize(df, ["k"], [], ["x@Median"]).collect() == []
    assert summary.summarize(df, [], [], ["x@Median", "x@Mode"]).collect() == []


@pytest.mark.parametrize("keys", [["k"], []])
def test_summaries_are_the_same_either_way(spark, keys):
    rng = random.Random(6)
    df = spark.createDataFrame([(rng.choice("ab"), rng.choice([None, float(rng.randrange(30))]), "") for _ in range(400)], SCHEMA)
    targets = ["x@Median", "x@Mode", "x@Mean", "x@Count"]
    a, b = (sorted(map(tuple, TrialData(spark, df).summarize(keys, [], [], targets, skewed=s).collect())) for s in (True, False))
    assert a == b and len(a) == 4 * (2 if keys else 1)


def test_result_columns_cannot_be_keys(spark):
    with pytest.raises(ValueError, match="rename"):
        summary.summarize(spark.createDataFrame([("a", 1.0, "")], "value string, x double, n string"), ["value"], [], ["x@Mean"])


def most_rows_of_a_task(spark, df):
    """Rows that the largest task of a job read from shuffles."""
    sc = spark.sparkContext
    sc.setJobGroup("largest", "largest")
    df.collect()
    store, most = sc._jsc.sc().statusStore(), 0
    for job in sc.statusTracker().getJobIdsForGroup("largest"):
        for stage in sc.statusTracker().getJobInfo(job).stageIds:
            tasks = store.taskList(stage, 0, 100_000)
            for i in range(tasks.size()):
                m = tasks.apply(i).taskMetrics()
                if m.isDefined():
                    most = max(most, m.get().shuffleReadMetrics().recordsRead())
    sc.setLocalProperty("spark.jobGroup.id", None)
    return most


@pytest.mark.parametrize("keys", [["k"], []])
def test_no_task_holds_a_cell(spark, keys):
    """One cell of 400,000 different values, broadcasts off: the largest task reads bins, not trials."""
    n = 400_000
    df = spark.range(n).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % n / 1000.0 + 3).alias("x"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = selection.medians(df, keys, F.col("x"), "m", Shape(n, 1) if keys else None)
        assert "percentile" not in got._jdf.queryExecution().executedPlan().toString()
        assert most_rows_of_a_task(spark, got) < n / 20
        assert got.first().m == pytest.approx(3 + (n - 1) / 2000, abs=1e-12)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
