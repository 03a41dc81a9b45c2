"""Decontamination with short benchmark items."""

import itertools
import math

import numpy as np
import pytest

from trialmill.llm import decontam

ITEMS = {n: [f"i{n}x{k}" for k in range(n)] for n in range(1, 18)}


def patterns(n):
    """The tokens of an item of n (or of its window) that may differ."""
    size = min(n, decontam.WINDOW)
    return [p for k in range(size - math.ceil(decontam.SHARE * size - 1e-9) + 1) for p in itertools.combinations(range(size), k)]


@pytest.mark.parametrize("n", ITEMS)
def test_masks_reach_every_pattern(n):
    size = min(n, decontam.WINDOW)
    places = [{at + i for i, c in enumerate(m) if c == "1"} for m in (*decontam.MASKS, *decontam.SHORT.get(n, ())) for at in range(size - len(m) + 1)]
    assert all(any(not place & set(p) for place in places) for p in patterns(n))


def test_substituted_short_items_are_found(spark):
    docs, want = [], set()
    for n, item in ITEMS.items():
        for p in patterns(n):
            if len(p) > 2 and sum(p) % 7:
                continue
            own = ["other" if k in p else w for k, w in enumerate(item)]
            # Lone items too: what hangs over an end of the document differs like any other token.
            while own and own[0] == "other" and len(docs) % 2:
                own.pop(0)
            want.add((len(docs), n))
            docs.append((len(docs), " ".join(own if len(docs) % 3 else ["a", "b", "c", *own, "d", "e"])))
        if n > 1:
            docs.append((len(docs), " ".join(["other" if k <= n - math.ceil(decontam.SHARE * min(n, 16) - 1e-9) else w for k, w in enumerate(item)])))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in ITEMS.items()], "item_id long, text string")
    found = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want


@pytest.mark.parametrize("n", [16_000, 420_000])
def test_a_text_that_repeats_a_short_item(spark, n):
    """What carries tokens around grows neither with the hits of a text nor with its length; the first place is reported."""
    bench = spark.createDataFrame([(1, "the"), (2, "sat the cat sat"), (3, "no such thing")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "so " + "the cat sat " * n), (8, "cat")], "doc_id long, text string")
    got = decontam.overlaps(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.token_at, r.n_same, r.n_compared) for r in got) == [(7, 1, 1, 1, 1), (7, 2, 3, 4, 4)]


def test_hits_that_look_alike_are_one():
    h, first = decontam.token_runs(["the cat sat " * 5000, "", "the cat sat the"])
    assert first.tolist() == [0, 15_000, 15_000, 15_004]
    at = np.flatnonzero(h == h[0])
    of = np.searchsorted(first, at, side="right") - 1
    low, high = decontam.neighbourhoods(h, first, at, of, np.ones(len(at), dtype=np.int64))
    keep = decontam.unlike(h, at, of, h[at], low, high)
    assert 0 < len(keep) < 20 and keep[0] == 0 and set(of[keep]) == {0, 2}


def test_long_texts_have_the_tokens_of_short_ones():
    words = [f"w{i % 977} é{i}" for i in range(150_000)]
    text = " ".join(words)
    h, first = decontam.token_runs([text])
    parts = np.concatenate([decontam.token_hashes(w) for w in words])
    assert len(text) > 1_500_000 and first.tolist() == [0, 300_000] and (h == parts).all()


def test_leaks_are_dropped_row_by_row(spark, tmp_path):
    item = "the quick brown fox jumps over the lazy dog again"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, f"x {item} y", "a"), (1, "a clean text that shares the id", "b"), (None, item, "c"), (None, "clean", "d"), (2, "clean", "e"), (2, None, "f"), (3, "", "g"), (4, f"x {item} y", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, salt string").repartition(3)
    out = decontam.drop_leaks(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r.salt for r in out.collect()) == ["b", "d", "e", "f", "g"]
    assert decontam.drop_leaks(spark, docs.limit(0), str(tmp_path)).collect() == []
