"""Decontamination, SentencePiece, chat formatting, the pipeline."""

import hashlib
import itertools
import random
import re

import numpy as np
import sentencepiece

import corpus_pipeline
from trialmill.llm import chat, common, decontam, exact, pieces, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "é", "a" * 3000, "漢字 かな", "same", "same", "▁ literal ▁ marks", "  two  blanks\n\nlines\t", "🙂🙂", "\x00\x01"]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA).repartition(2)


def tokens(t):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())


def brute_leaks(docs, items):
    out = set()
    for (i, d), (k, b) in itertools.product(docs.items(), items.items()):
        d, b = tokens(d), tokens(b)
        n = min(len(b), decontam.WINDOW)
        if len(b) < decontam.LEAST:
            continue
        for shift in range(-len(b) + 1, len(d)):
            same = [0 <= j + shift < len(d) and d[j + shift] == b[j] for j in range(len(b))]
            if any(sum(same[j : j + n]) >= decontam.SHARE * n for j in range(len(b) - n + 1)):
                out.add((i, k))
                break
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["w%d" % i for i in range(300)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {k: " ".join(some(n)) for k, n in enumerate([30, 18, 16, 40, 7, 5, 4, 0])} | {90: None}
    docs = dict(enumerate(ODD))
    for k in range(6):
        b = items[k].split()
        docs[100 + k] = " ".join(some(40) + b + some(40))
        docs[120 + k] = " ".join(b)
        docs[140 + k] = ("- ".join(some(10) + b)).upper() + "!"
        if len(b) > 15:  # substituted words, and halves
            for n, step in ((200, 9), (220, 7)):
                c = list(b)
                c[4::step] = ["other"] * len(c[4::step])
                docs[n + k] = " ".join(some(30) + c + some(5))
            docs[240 + k] = " ".join(some(20) + b[: len(b) // 4] + some(20))
    for i in range(20):
        docs[300 + i] = " ".join(some(rng.randint(0, 300)))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = decontam.overlaps(frame(spark, list(docs.values()), list(docs)), bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert got == brute_leaks(docs, items)
    assert all(r["n_same"] >= decontam.SHARE * r["n_compared"] for r in found) and len(found) == len(got)
    assert decontam.overlaps(frame(spark, []).limit(0), bench).count() == 0
    assert decontam.overlaps(frame(spark, ["a b c d e f g"]), bench.limit(0)).count() == 0


def test_nbest_matches_brute_force():
    lat = pieces.lattice(pieces.default_model(), 4)

    def all_paths(u):
        if not u:
            return [(0.0, ())]
        out = []
        for n in range(1, len(u) + 1):
            hit = lat.pieces.get(u[:n])
            if hit:
                out += [(hit[1] + s, (hit[0], *ids)) for s, ids in all_paths(u[n:])]
            elif n == 1:
                b = u[0].encode()
                out += [(lat.byte_score * len(b) + s, (*(lat.byte_id[x] for x in b), *ids)) for s, ids in all_paths(u[1:])]
        return out

    for text in ("the", "in on", "été x", "a  b", "x\ny", "漢"):
        ids, scores, others = next(lat.encode_all([text]))
        want = sorted(all_paths(" " + text), key=lambda p: -p[0])[:4]
        assert np.allclose(scores, [s for s, _ in want])
        every = [ids.tolist(), *(x.tolist() for x in others)]
        known = dict.fromkeys(all_paths(" " + text))
        assert all((s, tuple(i)) in {(round(a, 6), b) for a, b in known} for s, i in zip(np.round(scores, 6), every))


def test_viterbi_batches_equal_the_search():
    lat = pieces.Lattice(pieces.default_model(), 3)
    rng = random.Random(1)
    units = [" " + "".join(rng.choice("etaoinshré漢🙂zq") for _ in range(rng.randint(1, 70))) for _ in range(400)]
    lat.learn(list(dict.fromkeys(units)))
    for u in units:
        found, k = lat.search(u), lat.at[u]
        assert np.isclose(lat.score[k], found[0][0]) and np.isclose(lat.gap[k], found[0][0] - found[1][0] if len(found) > 1 else np.inf)
        assert tuple(lat.ids[lat.ends[k] : lat.ends[k + 1]]) == found[0][1]


def test_encoding_round_trip(spark):
    extra = frame(spark, ODD).withColumnRenamed("source", "decoded_before")
    got = pieces.decode(pieces.encode(extra)).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert len(got) == len(ODD)
    for r in got:
        t = r["text"] or ""
        assert r["decoded"] == t
        if "▁" not in t and t:
            assert sp.decode(list(r["piece_ids"])) == t
        assert r["piece_scores"] == sorted(r["piece_scores"], reverse=True)
    assert all(r["round_trip"] for r in pieces.op7_sentencepiece(spark, SF).collect())
    assert pieces.encode(extra.limit(0)).count() == 0


CHATS = [(1, 0, "user", "hi\n"), (1, 1, "assistant", " ### Assistant: </turn> \\h \\"), (1, 2, None, None), (1, 2, "assistant", ""), (2, 5, "assistant", "é漢🙂 x"), (2, 5, "assistant", "é漢🙂 x"), (None, 1, "user", "lone"), (None, None, "assistant", "first"), (3, 0, "sys:#<tem", "a" * 5000)]


def test_chat_format_round_trip(spark):
    given = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").repartition(3)
    for r in chat.format_chats(given).collect():
        own = sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text in CHATS if c == r["conv_id"])
        turns = [(role, text) for _, _, role, text in own]
        assert chat.parse(r["formatted"]) == turns
        loss = "".join(r["formatted"][a:z] for a, z in r["loss_spans"])
        assert chat.unescape(loss) == "".join(t for role, t in turns if role == "assistant")
        for s, e, m in zip(r["token_starts"], r["token_ends"], r["loss_mask"]):
            assert m == any(s < z and e > a for a, z in r["loss_spans"])
    assert chat.format_chats(given.limit(0)).count() == 0


def test_chat_query_digests(spark):
    rows = {r["conv_id"]: r for r in chat.op10_chat_format(spark, SF).collect()}
    said = "\\### Assistant: </turn> ok"
    assert rows[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and rows[-7]["loss_chars"] == len(said) and rows[-7]["n_turns"] == 2


def test_pipeline_stages_and_whole(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]
    docs = common.table(spark, SF, "documents")
    out = corpus_pipeline.run(spark, SF).collect()
    # The same decisions one after the other, by brute force where the stage has one.
    rows = {r["doc_id"]: r for r in docs.collect()}
    score = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, toxicity.fit(docs, common.table(spark, SF, "labels"))).collect()}
    kept = {i: r["text"] or "" for i, r in rows.items() if score[i] < 0.5}
    best: dict[str, int] = {}
    for i, t in sorted(kept.items(), key=lambda x: (-len(x[1]), x[0])):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), i)
    kept = {i: kept[i] for i in best.values()}
    # The stage's rule is a similarity of 0.8 of five-word shingles (op1_simhash has its own, in test_dedup.py).
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in kept.items()}
    sets = {i: {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    near = lambda a, b: min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)
    close = [(a, b) for a, b in itertools.combinations(kept, 2) if near(sets[a], sets[b])]
    root: dict[int, int] = {i: i for i in kept}
    changed = True
    while changed:
        changed = False
        for a, b in close:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    kept = {i: t for i, t in kept.items() if root[i] == i}
    items = {r["item_id"]: r["text"] for r in common.table(spark, SF, "benchmark").collect()}
    grams = {k: {tuple(tokens(b)[j : j + 8]) for j in range(len(tokens(b)) - 7)} for k, b in items.items()}
    leaks = {i for i, t in kept.items() for own in [{tuple(tokens(t)[j : j + 8]) for j in range(len(tokens(t)) - 7)}] if any(own & g for g in grams.values())}
    assert {r["doc_id"] for r in out} == set(kept) - leaks
    assert all(len(r["piece_ids"]) > 0 for r in out if r["text"])
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert exact.keep_one(spark, docs, SF).columns == docs.columns
