"""The toxicity models against Kneser-Ney probabilities computed by plain dictionaries."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trialmill.llm import toxicity

SCHEMA = "doc_id long, text string"
TEXTS = [
    ("you idiot, you IDIOT and scum", 1), ("the cat sat on the mat", 0), ("idiots are idiotic: trash", 1), ("das ist gut und schön", 0),
    ("漢字かな 漢字", 0), ("schöne katze, the the the the end", 0), ("", 0), ("  \n", 1), ("trashy trash trash", 1), ("a b c a b a", 0),
    ("good idea, good ideal, ideally", 0), ("same line\nsame line\nsame line", 0), ("same line\nidiot line", 1), ("x" * 40 + " y", 0),
]


def words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode())


def events(text, order):
    for w in words(text):
        spelled = b" " + w + b" "
        for i in range(1, len(spelled)):
            yield spelled[max(0, i + 1 - order) : i + 1]


def discount(counts):
    n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * y for k in (1, 2, 3)]
    d = [min(max(v, toxicity.LEAST), k - toxicity.LEAST) for k, v in zip((1, 2, 3), d)]
    return lambda c: 0.0 if c == 0 else d[min(c, 3) - 1]


def brute(labelled, order):
    """A function from a word to the difference of its log-likelihoods."""
    n = [Counter(), Counter()]
    for text, toxic in labelled:
        n[toxic].update(events(text, order))
    both = n[0] + n[1]
    levels = {order: {e: c for e, c in both.items() if len(e) == order}}
    for k in range(order - 1, 0, -1):
        levels[k] = dict(Counter(e[1:] for e in levels[k + 1])) | {e: c for e, c in both.items() if len(e) == k}
    p = {}
    for k in range(1, order + 1):
        d, total, freed = discount(levels[k]), Counter(), Counter()
        for e, a in levels[k].items():
            total[e[:-1]] += a
            freed[e[:-1]] += d(a)
        for e, a in levels[k].items():
            p[e] = (a - d(a) + freed[e[:-1]] * (p[e[1:]] if k > 1 else 1 / 256)) / total[e[:-1]]
    d, total, freed = [discount(c) for c in n], [Counter(), Counter()], [Counter(), Counter()]
    for c in (0, 1):
        for e, k in n[c].items():
            total[c][e[:-1]] += k
            freed[c][e[:-1]] += d[c](k)

    def ratio(e):
        h, out = e[:-1], []
        for c in (0, 1):
            share = freed[c][h] / total[c][h] if total[c][h] else 1.0
            if e in p:
                out.append((n[c][e] - d[c](n[c][e])) / total[c][h] * (total[c][h] > 0) + share * p[e] if total[c][h] else p[e])
            else:
                out.append(share)  # the shared part is the same for both
        return math.log(out[1] / out[0])

    return ratio, p


@pytest.mark.parametrize("order", [2, 4, 8])
def test_events_and_ratios_match_plain_kneser_ney(spark, order):
    counts = toxicity.count_events(spark.createDataFrame(TEXTS, "text string, toxic int"), order)
    seen = [Counter(), Counter()]
    for text, toxic in TEXTS:
        seen[toxic].update(events(text, order))
    name = lambda key: (key % 2**64).to_bytes(8, "big").lstrip(b"\0")
    assert {name(r["key"]): (r["n0"], r["n1"]) for r in counts.collect()} == {e: (seen[0][e], seen[1][e]) for e in seen[0] | seen[1]}
    ratio, p = brute(TEXTS, order)
    shared = {name(r["key"]): r["p"] for r in toxicity.shared_model(counts, order).collect()}
    assert shared.keys() == (seen[0] | seen[1]).keys() and all(abs(v - p[e]) < 1e-9 for e, v in shared.items())
    rows = toxicity.ratios(counts, order).collect()
    assert len({r["key"] for r in rows}) == len(rows)
    found = {name(r["key"]): r["r"] for r in rows if not -(1 << 56) <= r["key"] + 1 <= 0}
    assert found.keys() == shared.keys() and all(abs(r - ratio(e)) < 1e-9 for e, r in found.items())
    # Probabilities after a context add up to what is left for unseen bytes.
    sums = defaultdict(float)
    for e, v in shared.items():
        sums[e[:-1]] += v
    assert all(0 < s < 1 + 1e-9 for s in sums.values())


@pytest.mark.parametrize("hot", [1 << 20, 40])
def test_scores_match_plain_sums_whether_entries_are_held_or_joined(spark, hot):
    labelled = [(i, t, x) for i, (t, x) in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame([r[:2] for r in labelled], SCHEMA)
    models = toxicity.fit(docs, spark.createDataFrame([(i, x) for i, _, x in labelled], "doc_id long, toxic int"), hot=hot)
    assert models.scorer.whole == (hot > 40)
    back = {r[0] for r in spark.sql("select id from range(42) where pmod(xxhash64(id, 'calibration'), 4) = 0").collect()}
    ratio, _ = brute([(t, x) for i, t, x in labelled if i not in back], toxicity.ORDER)
    odd = [None, "", "unseen wörter 漢字", "idiot " * 30, "you idiot, the cat", "trash", "same line"]
    given = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(odd)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r["x"] for r in toxicity._featured(given, models, ["doc_id"]).collect()}
    for i, t in enumerate(odd):
        each = sorted(sum(ratio((b" " + w + b" ")[max(0, k + 1 - toxicity.ORDER) : k + 1]) for k in range(1, len(w) + 2)) for w in words(t or ""))
        if each:
            usual = each[len(each) // 2]
            tail = sum(max(e - usual - toxicity.MARGIN, 0) for e in each) / len(each)
            assert np.allclose(got[i], [sum(each) / len(each), sum(each) / len(each) - usual, math.sqrt(tail)], atol=1e-7), t
        else:
            assert got[i] == [0, 0, 0]
    assert len(toxicity.scores(given, models).collect()) == len(odd)
    kept = toxicity.scored(given, models, "again")
    assert kept.columns == ["doc_id", "text", "score", "again"]


def test_very_long_texts_are_read_in_parts_alike(spark, monkeypatch):
    labelled = [(i, t, x) for i, (t, x) in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame([r[:2] for r in labelled], SCHEMA)
    scorer = toxicity.fit(docs, spark.createDataFrame([(i, x) for i, _, x in labelled], "doc_id long, toxic int")).scorer
    text = " ".join(t for t, _ in TEXTS).lower().encode() * 40
    whole = scorer.features([text, b"idiot"])
    monkeypatch.setattr(toxicity, "STEP", 100)
    assert np.allclose(scorer.features([text, b"idiot"]), whole)
    assert b"".join(toxicity.slices(text, toxicity.word_mask(), 100)) == text


@pytest.mark.parametrize("hot", [1 << 20, 150])
def test_held_entries_reach_the_driver_part_by_part(spark, monkeypatch, hot):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS * 3)], SCHEMA)
    labels, sizes = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(TEXTS * 3)], "doc_id long, toxic int"), []

    def collect(self, own=type(docs).collect):
        rows = own(self)
        sizes.append(sum(len(v) for row in rows for v in row if isinstance(v, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(type(docs), "collect", collect)
    monkeypatch.setattr(toxicity, "PART", 50, raising=False)
    models = toxicity.fit(docs, labels, hot=hot)
    assert sizes and not any(sizes)  # nothing packed is collected as a whole
    assert not any(isinstance(v, toxicity.Scorer) for v in vars(models).values())  # nor kept beside the broadcast
    monkeypatch.undo()
    rows = sorted(models.entries.orderBy("n", "key", ascending=[False, True]).select("key", "r").limit(hot).collect())
    assert models.scorer.keys.tolist() == [r["key"] for r in rows] and models.scorer.r.tolist() == [r["r"] for r in rows]
    monkeypatch.setattr(toxicity, "PART", 50)
    own = [sum(len(r["keys"]) for r in rows) // 8 for rows in toxicity._packed(models.entries, models.entries.count()).rdd.glom().collect()]
    assert sum(own) == models.entries.count() > 150 and max(own) <= 100
