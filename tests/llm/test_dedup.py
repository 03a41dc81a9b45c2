"""SimHash, exact and substring deduplication against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from trialmill.llm import exact, simhash, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(4)
WORDS = ["w%d" % i for i in range(400)]


def words(n):
    return [rng.choice(WORDS) for _ in range(n)]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA).repartition(3)


def odd_texts():
    long = " ".join(words(3000))
    return [None, "", "   \n", "one", "One", "two words", long, long + " tail", long, "▁ é 漢字", "a\x00b c d", "x" * 5000]


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def near_texts():
    base = [words(200) for _ in range(12)]
    out = []
    for b in base:
        for _ in range(4):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(len(c))] = rng.choice(WORDS)
            out.append(" ".join(c))
    return out


def test_near_dups_match_brute_force(spark):
    texts = odd_texts() + near_texts()
    got = {r["doc_id"]: r for r in simhash.near_dups(frame(spark, texts)).collect()}
    fp = [brute_fingerprint(t) for t in texts]
    assert all(got[i]["fingerprint"] == f"{f:016x}" for i, f in enumerate(fp))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert [got[i]["component_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]


def test_vantage_point_shards_lose_no_pair():
    r = np.random.default_rng(2)
    centres = r.integers(0, 2**63, 60, dtype=np.uint64)
    points = [c ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for c in centres for a, b in r.integers(0, 64, (30, 2))]
    points = np.unique(np.concatenate([centres, np.array(points, dtype=np.uint64), r.integers(0, 2**63, 1500, dtype=np.uint64)]))
    want = {(i, j) for i in range(len(points)) for j in (np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= 2) + i + 1)}

    def classes(links):
        label = list(range(len(points)))
        changed = True
        while changed:
            changed = False
            for a, b in links:
                m = min(label[a], label[b])
                if (label[a], label[b]) != (m, m):
                    label[a] = label[b] = m
                    changed = True
        return label

    tree = simhash.Tree(4, points[::3])
    at, shard = tree.route(points, 2)
    links = []
    for s in np.unique(shard):
        own = at[shard == s]
        a, b = simhash.close_links(points[own], 2, block=32)
        links += list(zip(own[a], own[b]))
    assert classes(links) == classes(want)


def test_simhash_edge_tables(spark):
    assert simhash.near_dups(frame(spark, []).limit(0)).count() == 0
    one = frame(spark, ["a b c", "a b c"], [7, 7])
    assert {r["component_id"] for r in simhash.near_dups(one).collect()} == {7}
    named = frame(spark, ["a b c"]).withColumnsRenamed({"source": "fp", "lang": "component_id"})
    assert simhash.near_dups(named).count() == 1


def brute_exact(texts):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    out = {}
    for i, n in enumerate(norm):
        own = [j for j, m in enumerate(norm) if m == n]
        keep = max(own, key=lambda j: (len(texts[j] or ""), -j))
        out[i] = (keep, len(own), keep == i, hashlib.sha256(n.encode()).hexdigest())
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_match_brute_force(spark, weak):
    texts = odd_texts() + ["a b", "ab", "a  b", "b", "\tab"] * 5
    from pyspark.sql import functions as F

    digest = (lambda c: F.substring(exact.sha256(c), 1, 1)) if weak else exact.sha256
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact.groups(frame(spark, texts), digest=digest).collect()}
    assert got == brute_exact(texts)


def test_exact_edge_tables(spark):
    assert exact.groups(frame(spark, []).limit(0)).count() == 0
    rows = exact.groups(frame(spark, ["a", "a"], [None, None])).collect()
    assert len(rows) == 2 and all(r["group_size"] == 2 for r in rows)
    named = frame(spark, ["a", "a "]).withColumnsRenamed({"source": "digest", "lang": "salt"})
    assert sorted(r["kept"] for r in exact.groups(named).collect()) == [False, True]
    docs = frame(spark, ["a", "a ", "b"])
    assert sorted(r["doc_id"] for r in exact.keep_one(spark, docs, "").collect()) == [1, 2]


def brute_substrings(texts, ids, size):
    first, out = {}, {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for i, w in sorted(zip(ids, split), key=lambda x: x[0]):
        for k in range(len(w) - size + 1):
            first[tuple(w[k : k + size])] = min(i, first.get(tuple(w[k : k + size]), i))
    for i, w in zip(ids, split):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_substrings_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 3000)
    passages = [words(60), words(50), words(49), words(130)]
    texts = odd_texts()
    for _ in range(40):
        body = []
        for _ in range(rng.randint(0, 4)):
            body += words(rng.randint(0, 60)) + (rng.choice(passages) if rng.random() < 0.7 else [])
        texts.append((" " if rng.random() < 0.5 else "\n").join(body))
    texts += [texts[20], texts[21], "a a a " * 80, "a " * 120, " ".join(["p", "q"] * 70)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.repeats(frame(spark, texts, ids), hot=hot).collect()}
    assert got == brute_substrings(texts, ids, 50)


def test_wavelet_rank_and_backward_search():
    r = np.random.default_rng(1)
    values = r.integers(0, 37, 1000)
    tree = substrings.WaveletTree(values, 37)
    begin = tree.rank(np.arange(37), np.zeros(37, dtype=np.int64))
    for at in (0, 1, 63, 64, 65, 500, 1000):
        assert [(values[:at] == s).sum() for s in range(37)] == (tree.rank(np.arange(37), np.full(37, at)) - begin).tolist()
    segments = [r.integers(0, 3, 30) for _ in range(20)]
    docs = r.permutation(20)
    got = substrings.window_owners(segments, docs, 5)
    for s, own in zip(segments, got):
        for k, o in enumerate(own):
            assert o == min(d for t, d in zip(segments, docs) if any((t[j : j + 5] == s[k : k + 5]).all() for j in range(26)))


def test_substring_edge_tables(spark):
    assert substrings.repeats(frame(spark, []).limit(0)).count() == 0
    w = " ".join(words(60))
    rows = substrings.repeats(frame(spark, [w, w, w], [5, 5, None])).collect()
    assert len(rows) == 3 and all(r["n_removed"] == 0 for r in rows)
