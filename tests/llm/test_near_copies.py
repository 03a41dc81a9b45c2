"""The near-duplicate stage of the pipeline against exact Jaccard similarity."""

import itertools
import random

import pytest

from trialmill.llm import similar, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w)} if len(w) < 5 else {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def edited(rng, words, n):
    c = list(words)
    for k in rng.sample(range(len(c)), n):
        c[k] = f"x{rng.randrange(10**6)}"
    return c


@pytest.mark.parametrize(("small", "block", "shingles"), [(32, 1024, 20_000), (2, 16, 100)])
def test_edited_copies_go(spark, monkeypatch, small, block, shingles):
    monkeypatch.setattr(similar, "SMALL", small)
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "SHINGLES", shingles)
    rng = random.Random(6)
    texts = [None, "", " \n", "one", "ONE", "two words"]
    for _ in range(40):
        b = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(150, 400))]
        texts += [" ".join(b)] + [" ".join(edited(rng, b, n)) for n in (1, 2, 3, len(b) // 50, len(b) // 45, len(b) // 25)]
    hot = [f"h{rng.randrange(3000)}" for _ in range(300)]
    texts += [" ".join(edited(rng, hot, rng.randint(0, 5))) for _ in range(120)]
    rng.shuffle(texts)
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = {(a, b): s for a, b in itertools.combinations(range(len(texts)), 2) if (s := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= similar.LEAST}
    assert sum(0.8 <= s < 0.95 for s in near.values()) > 300
    for a, b in near:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 0)], SCHEMA).repartition(3)
    kept = simhash.keep_one(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [i for i in range(len(texts)) if find(i) == i]
    assert kept.filter("doc_id is null").count() == 1 and simhash.keep_one(spark, docs.limit(0), "").count() == 0


def test_fingerprints_decide_by_vantage_points(spark, monkeypatch):
    """What op1's shards link goes from the pipeline too, also where shingles share less than LEAST."""
    routed = []
    real = simhash.linked
    monkeypatch.setattr(simhash, "linked", lambda distinct, *more: routed.append(distinct.count()) or real(distinct, *more))
    texts = ["la " * 100 + "one", "la " * 100 + "two", "three other words", " ".join(f"w{i}" for i in range(50)), "la " * 100 + "two"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 0)], SCHEMA)
    assert len(grams(texts[0]) & grams(texts[1])) < similar.LEAST * len(grams(texts[0]) | grams(texts[1]))
    root = {r["doc_id"]: r["component_id"] for r in simhash.near_dups(docs.filter("doc_id is not null")).collect()}
    kept = [r["doc_id"] for r in simhash.keep_one(spark, docs, "").collect()]
    assert sorted(i for i in kept if i is not None) == [i for i in range(len(texts)) if root[i] == i] == [0, 2, 3]
    assert kept.count(None) == 1 and len(routed) == 2
