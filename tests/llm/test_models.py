"""Language identification, toxicity, personal data, secrets."""

import hashlib
import random
import re

import numpy as np
import regex

from trialmill.llm import common, langid, pii, secrets, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "é", "123 !!", "a" * 3000, "漢字 かな", "same", "same"]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA).repartition(2)


def test_langid_held_out_accuracy(spark):
    rows = langid.op2_language_id(spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in common.table(spark, SF, "documents").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and 200 < len(held) < 500
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_langid_odd_texts(spark):
    docs = common.table(spark, SF, "documents").limit(200)
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.identify(frame(spark, ODD), model).collect()}
    assert [got[i]["lang_pred"] == "und" for i in range(len(ODD))] == [not any(map(str.isalpha, t or "")) for t in ODD]
    assert langid.identify(frame(spark, ODD).limit(0), model).count() == 0
    nothing = langid.fit(docs.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(frame(spark, ["hello"], [None]), nothing).collect()} == {("und", 0.0)}


def test_langid_features_are_of_each_text_alone():
    texts = [b"the cat", b"", b"der hund und die katze" * 50, b"le chat"]
    both = langid.features(texts)
    for i, t in enumerate(texts):
        assert np.allclose(both[i], langid.features([t])[0])


def test_langid_draws_rows_and_counts_long_texts_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text number {k} of one id", "en", "s", 0) for k in range(300)] + [(1, "same", "en", "s", 0)] * 50 + [(None, "ohne id", "de", "s", 0)], SCHEMA)
    seen = []
    monkeypatch.setattr(langid, "Model", lambda x, langs: seen.append((len(x), sorted(set(langs)))))
    langid.fit(docs, 21)
    langid.fit(docs, 1000)
    assert seen[0][0] == 21 and seen[1] == (302, ["de", "en"])
    text = "der hund und die katze, été ".encode() * 50
    whole = langid.features([text, b"a", b"the cat" * 30])
    monkeypatch.setattr(langid, "STEP", 37)
    assert np.allclose(langid.features([text, b"a", b"the cat" * 30]), whole)


def test_toxicity_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, SF, "labels").collect()}
    rows = [r for r in toxicity.op8_toxicity(spark, SF).collect()]
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    assert sum(b > g for b in bad for g in good) / (len(bad) * len(good)) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity_odd_texts(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    models = toxicity.fit(docs, labels)
    got = toxicity.scores(frame(spark, ODD), models).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] < 0.5 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (7, 8)}) == 1
    assert toxicity.scores(frame(spark, ODD).limit(0), models).count() == 0
    assert {r["score"] for r in toxicity.scores(frame(spark, ODD), toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def brute_base(text):
    spans = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            spans.append((m.start(), m.end(), "card"))
    spans += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(spans, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_match_the_patterns():
    rng = random.Random(3)
    fixed = ["a@b.com.x_y@z.de", "@@a@b@c.d", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.255", "4111 1111 1111 1111", "+49 (30) 123-4567.", "++1 2", "a@b..c", "x@y.z@w.v", "é@é.de é.a@b.c"]
    texts = fixed + ["".join(rng.choice("ab1234567890.@+-() _%") for _ in range(60)) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == brute_base(t), t


def test_pii_query_and_added_spans(spark):
    texts = ODD + ["mail jo@mail.example.com or call (212) 555-0143, please", "write ann at example dot com thanks", "version 3.12 of 2021"]
    got = {r["doc_id"]: r for r in pii.find(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [(s["start"], s["end"], s["kind"]) for s in got[i]["base"]] == brute_base(t or "")
    added = lambda i: {(s["kind"], texts[i][s["start"] : s["end"]]) for s in got[i]["added"]}
    assert ("phone", "(212) 555-0143") in added(9) and ("email", "ann at example dot com") in added(10) and not added(11)
    docs = {r["doc_id"]: r["text"] or "" for r in common.table(spark, SF, "documents").collect()}
    for r in pii.op5_pii(spark, SF).collect():
        base = brute_base(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, z, k in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert {f"{k}:{a}:{z}" for a, z, k in base} <= set(r["spans"].split(","))
    assert pii.find(frame(spark, ODD).limit(0)).count() == 0


def test_crf_gradient_and_viterbi():
    field = pii.Field([(["x", "d3", "x"], [0, 4, 0])], epochs=3)
    codes, labels = field.codes(["x", "d3", "-", "x"]), np.array([0, 4, 4, 0])
    import itertools

    def score(path):
        e = field.scores(codes)
        return sum(e[t, p] for t, p in enumerate(path)) + sum(field.step[a, b] for a, b in zip(path, path[1:]))

    paths = list(itertools.product(range(5), repeat=4))
    assert tuple(field.decode([["x", "d3", "-", "x"], ["d3"]])[0]) == max(paths, key=score)
    total = np.logaddexp.reduce([score(p) for p in paths])
    emit, step = field.gradient(codes, labels)
    expected = sum(np.exp(score(p) - total) * sum(a == 0 and b == 4 for a, b in zip(p, p[1:])) for p in paths)
    assert abs(step[0, 4] - (1 - expected)) < 1e-8


def test_tokens_and_paths_against_plain_versions():
    rng, field = random.Random(1), pii.trained()
    for _ in range(200):
        t = "".join(rng.choice("aAbZ 09\n.@é漢-+/\x1f\u3000ÿdotDOTat") for _ in range(rng.randint(0, 200)))
        raw = pii.narrow(t)
        start, end, kind = pii.tokens(raw)
        plain = list(pii._TOKEN.finditer(t))
        assert [m.span() for m in plain] == list(zip(start, end))
        assert [pii.SHAPES[i] for i in pii.shape_places(raw, start, end, kind)] == [pii.shape(m[0]) for m in plain]
    known = list(field.at)
    batch = [[rng.choice(known) for _ in range(n)] for n in (0, 1, 5, 63, 64, 65, 0, 128, 129, 300, 2000, 3)]
    for shapes, labels in zip(batch, field.decode(batch), strict=True):
        assert len(shapes) == len(labels)
        if shapes:
            e = field.scores(field.codes(shapes))
            best, came = e[0], []
            for row in e[1:]:
                ways = best[:, None] + field.step
                came.append(ways.argmax(axis=0))
                best = ways.max(axis=0) + row
            path = [int(best.argmax())]
            for c in came[::-1]:
                path.append(int(c[path[-1]]))
            assert labels.tolist() == path[::-1]


def test_added_spans_on_held_out_rows():
    rows = [pii.sentence(r) for r in pii.labelled_table(77)] + [("x " * 300_000 + "call (212) 555-0143, ok", [(600_005, 600_019, "phone")])]
    base = [pii.base_spans(t) for t, _ in rows]
    added = pii.added_spans(pii.trained(), [t for t, _ in rows], base)
    hit = found = real = 0
    for (_, spans), b, a in zip(rows, base, added, strict=True):
        want = {s for s in spans if not any(s[0] < e and z < s[1] for z, e, _ in b)}
        hit, found, real = hit + len(want & set(a)), found + len(a), real + len(want)
    assert real > 100 and hit / found > 0.95 and hit / real > 0.9
    assert added[-1] == rows[-1][1]


def test_secrets_match_a_plain_scan(spark):
    key = "d7a8fbb307d7809469ca9abcb0082e4f8d5651e4"
    texts = ODD + [f'x token = "{key}" y', f"commit {key} ok", f"é漢 password: Zx9{key[:20]}Q\nsecret={key}", "see https://www.example.com/path/index2/page.html", "plainwordswithoutdigits " * 20, "550e8400-e29b-41d4-a716-446655440000", key * 3 + "_", "password = Tr0ub4dor&3, ok", "é token: required. pwd:'s3cr!t9x' secret == short", "-----BEGIN RSA PRIVATE KEY-----\nMIIB+/a9\nxyz=\n-----END RSA PRIVATE KEY----- end", "key aBcdEFghIjkLmnOPqrSTuvWX here"]
    model = secrets.forest(spark)
    got = secrets.findings(frame(spark, texts), model).collect()
    pattern = secrets.CANDIDATE
    want = {(i, m.start(), m.end(), m[0]) for i, t in enumerate(texts) for m in regex.finditer(pattern, t or "")}
    assert {(r["doc_id"], r["start"], r["end"], r["secret"]) for r in got} == want
    sure = {(r["doc_id"], r["secret"]) for r in got if r["is_secret"]}
    assert (9, key) in sure and (11, key) in sure and (10, key) not in sure and not any(i in (12, 14) for i, _ in sure)
    assert secrets.findings(frame(spark, ODD).limit(0), model).count() == 0


def test_forest_on_held_out_findings(spark):
    rows = secrets.labelled_findings(seed=404, each=12)
    docs = frame(spark, [a + c + z for a, c, z, _ in rows])
    got = {}
    for r in secrets.findings(docs, secrets.forest(spark)).collect():
        got.setdefault(r["doc_id"], []).append((r["secret"], r["is_secret"]))
    found = [any(c.startswith(x[0]) and x[1] or x[0] == c and x[1] for x in got.get(i, [])) for i, (_, c, _, _) in enumerate(rows)]
    hit = sum(f and y for f, (*_, y) in zip(found, rows, strict=True))
    print("precision", hit / sum(found), "recall", hit / sum(y for *_, y in rows))
    assert hit / sum(found) > 0.95 and hit / sum(y for *_, y in rows) > 0.95


def test_forest_column_equals_its_trees(spark):
    rng = np.random.default_rng(0)
    x = rng.random((200, 3))
    forest = secrets.Forest(x, (x[:, 0] > 0.5).astype(float), ["a", "b", "c"])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "a double, b double, c double").withColumn("s", forest.column())
    assert all(abs(r["s"] - forest.score([r["a"], r["b"], r["c"]])) < 1e-9 for r in df.collect())


def test_findings_compile(spark):
    """With fallbacks off, code that cannot be compiled is an error."""
    docs = spark.createDataFrame([(1, "token = ghp_" + "aB3dE6gH9j" * 4 + " and more"), (2, None), (3, "plain words")], "doc_id long, text string")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.codegen.factoryMode", "spark.sql.codegen.fallback")}
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        found = secrets.findings(docs, secrets.forest(spark)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert [(r.doc_id, r.is_secret) for r in found] == [(1, True)]


def test_features_of_few_rows_are_held_at_once(spark, monkeypatch):
    """Ten thousand short texts, one batch: what is made at once is bounded by rows."""
    most = []
    plain = langid.features
    monkeypatch.setattr(langid, "features", lambda texts: most.append(len(texts)) or plain(texts))
    rows = [(i, ("the cat and dog", "der hund und die")[i % 2], ("en", "de")[i % 2]) for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict(["the cat"] * 3)[0] == ["en"] * 3 and max(most) <= langid.ROWS
    docs = spark.createDataFrame([(i, "der hund") for i in range(2000)], "doc_id long, text string").coalesce(1)
    got = langid.identify(docs, model).collect()
    assert len(got) == 2000 and {r.lang_pred for r in got} == {"de"}


def test_added_spans_touch_no_base_span():
    text = "call +49 30 1234567 or a.b@c.de now, 10.0.0.1 and (212) 555-0143\n" * 3000
    base = pii.base_spans(text)
    (added,) = pii.added_spans(pii.trained(), [text], [base])
    edges = sorted((s, e) for s, e, _ in base)
    assert len(base) > 5000 and added
    import bisect

    for s, e, _ in added:
        k = bisect.bisect_left(edges, (e, 0))
        assert all(z <= s for _, z in edges[max(0, k - 3) : k])
