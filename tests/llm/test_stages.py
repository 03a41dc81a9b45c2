"""The filtering stages decide for each row: no text goes without an equal or similar one that stays."""

import random

import pytest

from trialmill.llm import decontam, exact, pieces, simhash, toxicity

LOW = -(2**63)
SF = "/root/testdata/sf0.001"


def kept(stage, spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(3)
    out = stage(spark, docs, SF, **options)
    assert out.columns == docs.columns
    return sorted(map(tuple, out.collect()), key=repr)


STAGES = [exact.keep_one, simhash.keep_one]


@pytest.mark.parametrize("stage", STAGES)
def test_rows_that_share_an_id(spark, stage):
    assert [r[:2] for r in kept(stage, spark, [(1, "a", "x"), (2, "b", "x"), (2, "a", "x")])] == [(1, "a"), (2, "b")]
    assert kept(stage, spark, [(1, "a", "x")] * 5) == [(1, "a", "x")]
    assert len(kept(stage, spark, [(1, "a", "x"), (1, "a", "y")])) == 1


@pytest.mark.parametrize("stage", STAGES)
def test_extreme_ids_and_empty_texts(spark, stage):
    assert kept(stage, spark, [(LOW, "a", "x"), (2**63 - 1, "a", "x"), (0, "b", None)]) == sorted([(LOW, "a", "x"), (0, "b", None)], key=repr)
    assert [r[0] for r in kept(stage, spark, [(3, None, "x"), (4, "", "x"), (5, " ", "y")])] == ([5] if stage is exact.keep_one else [3])
    assert kept(stage, spark, []) == []


def test_exact_rows_without_id(spark):
    assert kept(exact.keep_one, spark, [(None, "a", "x"), (None, "a", "x"), (None, "b", "x")]) == [(None, "a", "x"), (None, "b", "x")]
    assert kept(exact.keep_one, spark, [(None, "a", "x"), (7, "a", "x")]) == [(7, "a", "x")]
    assert kept(exact.keep_one, spark, [(None, "a  ", "x"), (7, "a", "x")]) == [(None, "a  ", "x")]


def test_near_copies_rows_without_id_stay(spark):
    assert len(kept(simhash.keep_one, spark, [(None, "a", "x"), (None, "a", "x"), (7, "a", "x")])) == 3


@pytest.mark.parametrize("weak", [False, True])
def test_exact_stage_matches_brute_force(spark, weak):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(rng.choice([None, LOW, *range(12)]), rng.choice([None, "", "a", "a b", "ab", " ab", "b", "é x", "\tb"]), rng.choice("xy")) for _ in range(150)]
    digest = (lambda c: F.substring(exact.sha256(c), 1, 1)) if weak else exact.sha256
    got = kept(exact.keep_one, spark, rows, digest=digest, salts=3)
    best = {}
    for i, t, _ in rows:
        t = t or ""
        key = "".join(t.split())
        rank = (len(t), i is not None, -(i or 0))
        best[key] = max(best.get(key, rank), rank)
    assert sorted(("".join((t or "").split()), (len(t or ""), i is not None, -(i or 0))) for i, t, _ in got) == sorted(best.items())


def test_exact_stage_shuffles_distinct_texts_once(spark):
    """A row whose digest no other has is written to one shuffle; the copies' content goes through one more."""

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    rng = random.Random(5)
    rows = [(i, rng.randbytes(5000).hex(), "x") for i in range(400)]
    docs = spark.createDataFrame(rows + [(400 + i, " " + rows[i][1], "y") for i in range(20)], "doc_id long, text string, note string")
    before = written()
    got = sorted(map(tuple, exact.keep_one(spark, docs, SF).collect()))
    assert got == rows[20:] + [(400 + i, " " + rows[i][1], "y") for i in range(20)]
    assert written() - before < 1.5 * sum(len(t) for _, t, _ in rows)


def test_clashing_names(spark):
    """Columns of docs that are named like helpers stay what they are, in every stage."""
    names = ["digest", "salt", "norm", "points", "row", "mark", "node", "score", "x", "key", "found", "stretch", "item_id", "keep_id", "size"]
    values = {"doc_id": [900001, 900002, 900003], "text": ["one two three four five six", "one two three four five six", "other words"]}
    rows = [(values["doc_id"][k], values["text"][k], *(f"{n}{k}" for n in names)) for k in range(3)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    for stage, left in ((toxicity.reject, 3), (exact.keep_one, 2), (simhash.keep_one, 2), (decontam.drop_leaks, 3), (pieces.encode_stage, 3)):
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns, stage
        got = out.select(docs.columns).collect()
        assert len(got) == left and {tuple(r) for r in got} <= set(rows), stage


def test_a_task_holds_one_python_worker(spark):
    """Hits are dealt anew before they are verified, also where items are broadcast, and features and score are one node."""
    docs = spark.createDataFrame([(1, "one two three four five six", "x")], "doc_id long, text string, note string")
    plan = decontam.drop_leaks(spark, docs, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") >= 2 and "RepartitionByExpression" in plan
    plan = toxicity.reject(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1
