"""All N best segmentations reach the query and the pipeline's stage."""

import hashlib

import numpy as np

from trialmill.llm import common, pieces

SF = "/root/testdata/sf0.001"


def sha(ids):
    return hashlib.sha256(np.array(ids, dtype="<i4").tobytes()).hexdigest()


def test_every_rank_is_spelled(spark):
    docs = common.table(spark, SF, "documents")
    lat = pieces.lattice(pieces.default_model(), pieces.NBEST)
    score = {i: s for i, s in lat.pieces.values()} | dict.fromkeys(lat.byte_id.values(), lat.byte_score)
    stage = {r["doc_id"]: r for r in pieces.encode_stage(spark, docs, SF).collect()}
    rows = pieces.op7_sentencepiece(spark, SF).collect()
    assert len(rows) == docs.count() == len(stage)
    for r in rows:
        s = stage[r["doc_id"]]
        every = [s["piece_ids"], *s["piece_nbest"]]
        assert r["nbest_sha256"] == [sha(x) for x in every] and len(set(r["nbest_sha256"])) == r["n_best"] == len(r["nbest_scores"])
        assert r["n_best"] == pieces.NBEST or len(s["text"] or "") < 3
        assert np.allclose(r["nbest_scores"], [sum(score[i] for i in x) for x in every]) and list(r["nbest_scores"]) == sorted(r["nbest_scores"], reverse=True)
        assert r["round_trip"] and all(lat.decode(x) == (s["text"] or "") for x in every)
        assert (r["ids_sha256"], r["score"]) == (r["nbest_sha256"][0], r["nbest_scores"][0])
