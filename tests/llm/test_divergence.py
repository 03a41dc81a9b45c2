"""The divergence audit against brute force, on odd tables, and its search for the best terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from trialmill.llm import divergence

SCHEMA = "doc_id long, lang string, source string, text string, term string, n long"


def brute(rows, least_docs, top):
    docs = [(r[1] or "", r[2] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[3] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, counts, groups = Counter(), Counter(), defaultdict(Counter)
        for lang_, source, words in docs:
            if lang_ == lang:
                df.update(set(words))
                counts.update(words)
                groups[source].update(words)
        kept = [t for t in df if df[t] >= least_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[t] for t in kept) + 5 * len(kept)) for t in kept}
        q, p = share(counts), {s: share(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def audited(spark, rows, least_docs=3, top=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, divergence.audit(df, least_docs, top).collect()))


def corpus(seed, n=150, words=60):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["w", "É", "ß", "Ab", "漢"]) + "xyz"[: rng.randint(0, 3)] + chr(97 + i % 26) for i in range(words)]
    text = lambda: rng.choice([" ", "1", "\n", "-"]).join(rng.choices(vocabulary, weights=range(1, words + 1), k=rng.randint(0, 40)))
    return [(rng.choice([None, i]), rng.choice([None, "en", "en", "en", "de"]), rng.choice([None, "a", "b", "ü", "z"]), rng.choice([None, text(), text(), text()]), "x", 7) for i in range(n)]


def test_matches_brute_force(spark):
    rows = corpus(1)
    rows += rows[:20]
    got = audited(spark, rows)
    assert got == brute(rows, 3, 5)
    assert {r[2] for r in got} == {"pair", "term"}


def test_ties_at_the_last_rank(spark):
    rows = [(i, "en", "ab"[i % 2], "aa bb cc dd ee ff gg" if i % 2 else "hh ii jj kk ll mm nn", None, None) for i in range(12)]
    got = audited(spark, rows)
    assert got == brute(rows, 3, 5)
    assert [r[3] for r in got if r[1:3] == ("a", "term")] == ["hh", "ii", "jj", "kk", "ll"]


def test_odd_tables(spark):
    assert audited(spark, []) == []
    none = [(1, "en", "a", None, None, None), (2, "en", "b", "12 34", None, None), (3, None, None, "word", None, None)]
    assert audited(spark, none) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_a_very_long_text_counts_in_parts(spark):
    long = "alpha beta " * 300_000
    rows = [(i, "en", s, t, None, None) for i, (s, t) in enumerate([("a", long), ("a", "beta"), ("b", "alpha gamma"), ("b", "gamma")])]
    assert audited(spark, rows, least_docs=2) == brute(rows, 2, 5)


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 0, 3), (7, 10**12, 10**6), (9 * 10**14, 9 * 10**14, 10**7), (123456789012, 5 * 10**14 + 1, 999983)]
    want = [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in cases]
    assert divergence.share(*(np.array(x, dtype=np.int64) for x in zip(*cases, strict=True))).tolist() == want
    df = spark.createDataFrame(cases, "c long, n long, v long").select(divergence._share("c", "n", "v").alias("p"))
    assert sorted(r.p for r in df.collect()) == sorted(want)


def test_buckets_that_cannot_rank_are_not_evaluated(spark):
    rows = corpus(2, n=400, words=200)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = divergence.kept_terms(df, 3)
    groups = divergence._groups(kept)
    buckets = divergence._buckets(kept, groups)
    # A bucket's bounds hold for each of its terms.
    facing = kept.filter("term is not null").join(buckets, ["lang", "source", "n"]).select("p", "high", "low", "total", "lang_size", "terms")
    for r in facing.withColumn("f", F.col("p") - divergence._share("total", "lang_size", "terms")).collect():
        assert r.low <= r.f <= r.high
    assert sorted(map(tuple, divergence.audit(df, 3, 2).collect())) == brute(rows, 3, 2)
