"""Sharding against a row-by-row brute force; balance, movement and odd tables."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trialmill.llm import sharding

SCHEMA = "doc_id long, text string, shard string, slot long, cell long, n int"


def table_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", 0, 0, 0) for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA).repartition(3)


def some_texts(n, seed=1):
    rng = random.Random(seed)
    hot = ["the same text"] * (n // 3)
    return hot + [rng.choice(["", None, "é", "a b", f"text {rng.randrange(n)}"]) for _ in range(n - n // 3)]


def brute_shards(spark, texts, shards, nodes, bits):
    """Rows of each (shard, arc they belong to), row by row: every row asks node after node clockwise until a shard has room."""
    ring = sorted((r.last, r.shard) for r in sharding.ring(spark, shards, nodes, bits).collect())
    spots = spark.createDataFrame([(t,) for t in texts], "t string").select(F.shiftrightunsigned(F.xxhash64(F.coalesce("t", F.lit(""))), 64 - bits).alias("c")).collect()
    start = [next((k for k, (last, _) in enumerate(ring) if last >= r.c), 0) for r in spots]
    room = [len(texts) // shards + (s < len(texts) % shards) for s in range(shards)]
    waiting, out, turn = sorted(start), Counter(), 0
    while waiting:
        left = []
        for arc in waiting:
            shard = ring[(arc + turn) % len(ring)][1]
            if room[shard]:
                room[shard] -= 1
                out[shard, arc] += 1
            else:
                left.append(arc)
        waiting, turn = left, turn + 1
    return out, start


@pytest.mark.parametrize("unit_rows", [7, 10_000])
def test_matches_row_by_row_placement(spark, unit_rows):
    texts = some_texts(900)
    got = sharding.assign(table_of(spark, texts), shards=7, nodes=5, unit_rows=unit_rows, bits=8).collect()
    want, start = brute_shards(spark, texts, 7, 5, 8)
    assert sorted(r.doc_id for r in got) == list(range(900))
    assert Counter((r.shard, start[r.doc_id]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(map(len, slots.values())) == [128] * 3 + [129] * 4


def test_equal_texts_stay_together_until_a_shard_is_full(spark):
    texts = [f"t{i % 300}" for i in range(900)]
    where = defaultdict(set)
    for r in sharding.assign(table_of(spark, texts)).collect():
        where[texts[r.doc_id]].add(r.shard)
    assert sum(len(v) == 1 for v in where.values()) > 0.8 * len(where)


def test_most_rows_stay_where_the_ring_puts_them(spark):
    """A tenth more rows moves few of the old ones."""
    texts = [f"text {i}" for i in range(4400)]
    before = {r.doc_id: r.shard for r in sharding.assign(table_of(spark, texts[:4000]), shards=10, nodes=64).collect()}
    after = {r.doc_id: r.shard for r in sharding.assign(table_of(spark, texts), shards=10, nodes=64).collect()}
    assert sum(after[i] != s for i, s in before.items()) < 0.1 * len(before)


def test_odd_tables(spark):
    assert sharding.assign(table_of(spark, [])).collect() == []
    (one,) = sharding.assign(table_of(spark, [None], [None])).collect()
    assert (one.doc_id, one["size"], one.text_crc32, one.slot) == (None, 16, 0, 0)
    same = sharding.assign(table_of(spark, ["x"] * 85, [5] * 85), shards=8, nodes=4).collect()
    assert sorted(Counter(r.shard for r in same).values()) == [10] * 3 + [11] * 5
    assert len({(r.shard, r.slot) for r in same}) == 85
    long = sharding.assign(table_of(spark, ["ä" * 3_000_000, "b"])).collect()
    assert sorted(r["size"] for r in long) == [17, 6_000_016]


def test_no_python_on_the_way(spark):
    plan = sharding.assign(table_of(spark, ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_shards_without_a_node_get_rows_too():
    moves = sharding.spread([10, 0, 4], [0, 0, 1], shards=3)
    assert Counter({s: 0 for s in range(3)}) + Counter({s: sum(e - b for _, b, e, t, _ in moves if t == s) for s in range(3)}) == Counter({0: 5, 1: 5, 2: 4})
