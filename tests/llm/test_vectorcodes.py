"""Vector codes against whole-number brute force; the screening intervals under hostile matrix products."""

import hashlib
import math
import random

import numpy as np
import pytest

from trialmill.llm import vectorcodes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def brute(rows, rounds=6):
    kept = [(r[0], [math.floor(4096 * float(v)) for v in r[1]], r[2]) for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    if not kept:
        return []
    m = len(kept[0][1]) // 8
    parts = [[x[i * m : (i + 1) * m] for i in range(8)] for _, x, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:16]
    books = [[parts[k][i] for k in order] for i in range(8)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        at = [[min((dist(p[i], e), k) for k, e in enumerate(books[i])) for i in range(8)] for p in parts]
        if turn < rounds:
            for i in range(8):
                for e in range(len(books[i])):
                    mine = [p[i] for p, a in zip(parts, at, strict=True) if a[i][1] == e]
                    if mine:
                        books[i][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(d for d, _ in a) for a in at]
    by = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by[label] = by.get(label, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in a), e, by[label], digest) for (i, _, label), a, e in zip(kept, at, error, strict=True)), key=repr)


def coded(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(3)
    return sorted(map(tuple, vc.compress(df).collect()), key=repr)


def vectors(seed, n, d=16, scale=1.0):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0, scale))) for _ in range(d)], rng.choice([None, 1, 2])) for i in range(n)]


def test_matches_brute_force(spark):
    rows = vectors(1, 120)
    rows += rows[:30] + [(500, rows[3][1], 2), (None, rows[5][1], None), (None, rows[4][1], 1)]
    rows += [(600, None, 1), (601, [None] * 16, 1), (602, [*rows[0][1][:15], None], 1), (603, [float("nan")] * 16, 2), (604, [*rows[0][1][:15], float("-inf")], 2), (605, [], 3)]
    rng = random.Random(2)
    rng.shuffle(rows)
    assert coded(spark, rows) == brute(rows)


def test_ties_go_to_the_lower_index(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 0, 1]) / 4096 for _ in range(16)], i % 2) for i in range(90)]
    assert coded(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 5, 17])
def test_few_rows(spark, n):
    assert coded(spark, vectors(4, n)) == brute(vectors(4, n))


def test_large_components(spark):
    rows = vectors(5, 60, scale=10_000.0)
    assert coded(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="don't fit a long"):
        coded(spark, [(1, [1e15] * 16, 1)])
    with pytest.raises(Exception, match="one length"):
        coded(spark, [(1, [1.0] * 16, 1), (2, [1.0] * 24, 1)])


@pytest.mark.parametrize("scale", [1, 1000, 100_000_000])
def test_intervals_hold_for_any_order_of_summation(scale):
    """Products that sum in float32 one by one, in either order, or that err by the whole bound, give the same codes."""
    rng = np.random.default_rng(6)
    x = rng.integers(-scale, scale + 1, (400, 8)) + 7 * scale
    entries = np.concatenate((x[:6], x[:6] + 1, x[:4][::-1]))
    want = ((x[:, None] - entries) ** 2).sum(axis=2).argmin(axis=1)

    def one_by_one(a, b, order):
        out = np.zeros((len(a), b.shape[1]), dtype=np.float32)
        for k in order:
            out += a[:, k : k + 1] * b[k]
        return out

    def worst(sign):
        def product(a, b):
            exact = a.astype(np.float64) @ b.astype(np.float64)
            bound = 7 * vc.U32 * np.abs(a).astype(np.float64) @ np.abs(b).astype(np.float64)
            return (exact + sign * bound * rng.choice([-1, 1], exact.shape)).astype(np.float32)

        return product

    for product in (np.matmul, lambda a, b: one_by_one(a, b, range(8)), lambda a, b: one_by_one(a, b, range(7, -1, -1)), worst(1), worst(0.5)):
        assert (vc.nearest(x, entries, product) == want).all()


def test_screening_settles_most_rows():
    rng = np.random.default_rng(7)
    x, entries = rng.integers(-4096, 4096, (2000, 8)), rng.integers(-4096, 4096, (16, 8))
    assert (vc.screened(x, entries).sum(axis=1) == 1).mean() > 0.99
