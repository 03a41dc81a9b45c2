"""SentencePiece encoding with N-best segmentation, and decoding.

The lattice of a text has an arc for every vocabulary piece that matches, and byte arcs for characters without a piece.
Forward Viterbi scores are exact heuristics for a backward A-star search, so an agenda of N entries suffices. No piece
has a blank after another character, so a text falls apart into units at its blanks: units are searched once and kept,
and the N best segmentations of the whole text are put together by the same best-first search over the units.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Segmentations for each text.
NBEST = 3
#: Units and their characters that a worker keeps; beyond either the store is emptied and filled anew.
KEPT, KEPT_CHARS = 120_000, 4_000_000
#: Longest units that one vectorised Viterbi pass takes; longer ones are searched alone.
SHORT = (4, 6, 8, 10, 12, 14, 16, 18, 20, 24, 32, 48, 64)
#: Units in one such pass.
LANES = 10_000
#: Characters of text that are encoded in one go.
STEP = 1 << 19
#: Pieces of best segmentations that are handed on at once.
HELD = 1 << 17
#: A byte costs so much more than the worst piece.
BYTE_PENALTY = 10.0
#: Of the rolling hash by which the Viterbi pass finds pieces.
BASE = 0x9E3779B97F4A7C15


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """Vocabulary, scores and the store of searched units."""

    def __init__(self, path: str, nbest: int):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.nbest, self.pieces, self.bytes_of = nbest, {}, []
        self.byte_id: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace("▁", " ").encode())
                self.pieces[piece.replace("▁", " ")] = (i, float(sp.get_score(i)))
        usual = [s for _, s in self.pieces.values() if s > -1e8]
        # The bare blank and its runs carry a marker instead of a score; they rank behind the worst piece.
        self.pieces = {p: (i, s if s > -1e8 else min(usual) - 1) for p, (i, s) in self.pieces.items()}
        self.byte_score = min(usual) - BYTE_PENALTY
        self.longest = max(map(len, self.pieces))
        apart = not any(re.search("[^ ] ", p) for p in self.pieces)
        lines = not any("\n" in p for p in self.pieces)
        self.units = re.compile("(?s:.+)" if not apart else r" +[^ \n]*|\n|[^ \n]+" if lines else " +[^ ]*|[^ ]+")
        self._index()
        self.clear()

    def clear(self) -> None:
        self.chars = 0
        self.at: dict[str, int] = {}
        self.names: list[str] = []
        self.searched: dict[int, list[tuple[float, tuple[int, ...]]]] = {}
        self.ids = np.empty(0, dtype=np.int32)
        self.ends = np.zeros(1, dtype=np.int64)
        self.score = self.gap = np.empty(0)

    def _index(self) -> None:
        """Hashes of the pieces, and two tables by different bits of a hash; the few that share a place of one lie in the other."""
        texts = list(self.pieces)
        self.piece_hash = np.array([self._hash(t) for t in texts], dtype=np.uint64)
        self.piece_id = np.array([self.pieces[t][0] for t in texts], dtype=np.int32)
        self.piece_score = np.array([self.pieces[t][1] for t in texts])
        self.tables = [np.zeros(1 << 20, dtype=np.int32) for _ in range(2)]
        for i, h in enumerate(self.piece_hash.tolist()):
            places = [h >> 44, (h >> 20) & 0xFFFFF]
            free = [t for t in (0, 1) if not self.tables[t][places[t]]]
            if not free:
                raise ValueError("two pieces fall on the same places; choose another base")
            self.tables[free[0]][places[free[0]]] = i + 1

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * BASE + ord(c) + 1) % 2**64
        return h * BASE % 2**64

    def _match(self, h: np.ndarray) -> np.ndarray:
        """Place of the piece with each hash in piece_hash, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        for t, place in ((0, h >> np.uint64(44)), (1, (h >> np.uint64(20)) & np.uint64(0xFFFFF))):
            i = self.tables[t][place.astype(np.int64)].astype(np.int64) - 1
            np.copyto(out, i, where=(i >= 0) & (self.piece_hash[i] == h))
        return out

    def viterbi(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of units of up to SHORT[-1] characters: best ids one after another, how many are of each unit (0 where bytes are needed), best score, distance of the second best."""
        m, lengths = len(units), np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        wide = int(lengths.max())
        codes = np.zeros((m, wide), dtype=np.uint64)
        codes[np.arange(wide)[None, :] < lengths[:, None]] = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        base = np.uint64(BASE)
        sums = np.zeros((wide + 1, m), dtype=np.uint64)
        for k in range(wide):
            sums[k + 1] = sums[k] * base + codes[:, k] + np.uint64(1)
        power = np.cumprod(np.array([1] + [BASE] * self.longest, dtype=np.uint64), dtype=np.uint64)
        low = -np.inf
        one, two = np.full((wide + 1, m), low), np.full((wide + 1, m), low)
        came, piece = np.zeros((wide + 1, m), dtype=np.int16), np.full((wide + 1, m), -1, dtype=np.int64)
        one[0] = 0
        for k in range(1, wide + 1):
            for size in range(min(self.longest, k), 0, -1):
                j = k - size
                hit = self._match((sums[k] - sums[j] * power[size]) * base)
                own = np.flatnonzero(hit >= 0)
                gain, hit = self.piece_score[hit[own]], hit[own]
                if size == 1 and len(own) < m:
                    bare = np.ones(m, dtype=bool)
                    bare[own] = False
                    bare = np.flatnonzero(bare)
                    code = codes[bare, j]
                    own = np.concatenate((own, bare))
                    gain = np.concatenate((gain, self.byte_score * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))))
                    hit = np.concatenate((hit, np.full(len(bare), -1)))
                if not len(own):
                    continue
                first, second, top, next_ = one[j, own] + gain, two[j, own] + gain, one[k, own], two[k, own]
                better = first > top
                two[k, own] = np.where(better, np.maximum(top, second), np.maximum(next_, first))
                one[k, own] = np.where(better, first, top)
                came[k, own[better]] = size
                piece[k, own[better]] = hit[better]
        rows, place = np.arange(m), lengths.copy()
        path, byte = np.full((wide, m), -1, dtype=np.int32), np.zeros(m, dtype=bool)
        for step in range(wide - 1, -1, -1):
            live = place > 0
            if not live.any():
                break
            p = piece[place, rows]
            byte |= live & (p < 0)
            path[step] = np.where(live, self.piece_id[p], -1)
            place = place - np.where(live, came[place, rows], 0)
        path[:, byte] = -1
        best = path.T
        return best[best >= 0], (best >= 0).sum(axis=1), one[lengths, rows], one[lengths, rows] - two[lengths, rows]

    def learn(self, units: list[str]) -> None:
        """Search units that are new to the store; those that the vectorised pass takes come first, by length."""
        length = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        order = np.argsort(length, kind="stable")
        sized, names, ids, counts, score, gap, alone = length[order], [], [], [], [], [], []
        for below, upto in zip((0, *SHORT), SHORT, strict=False):
            x, end = np.searchsorted(sized, (below, upto), side="right")
            for begin in range(x, end, LANES):
                part = [units[i] for i in order[begin : min(begin + LANES, end)]]
                flat, n, best, second = self.viterbi(part)
                whole = n > 0
                names += itertools.compress(part, whole)
                alone += itertools.compress(part, ~whole)
                ids.append(flat)
                for held, new in ((counts, n), (score, best), (gap, second)):
                    held.append(new[whole])
        alone += [units[i] for i in order[np.searchsorted(sized, SHORT[-1], side="right") :]]
        begin = len(self.names)
        if alone:
            found = [self.search(u) for u in alone]
            self.searched.update(zip(range(begin + len(names), begin + len(units)), found, strict=True))
            ids += [np.array(r[0][1], dtype=np.int32) for r in found]
            counts.append(np.array([len(r[0][1]) for r in found]))
            score.append(np.array([r[0][0] for r in found]))
            gap.append(np.array([r[0][0] - r[1][0] if len(r) > 1 else np.inf for r in found]))
            names += alone
        self.at.update(zip(names, range(begin, begin + len(names)), strict=True))
        self.names += names
        self.chars += int(length.sum())
        self.ids = np.concatenate([self.ids, *ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])
        self.score, self.gap = np.concatenate([self.score, *score]), np.concatenate([self.gap, *gap])

    def results(self, which: int) -> list[tuple[float, tuple[int, ...]]]:
        """The N best segmentations of a kept unit."""
        if which not in self.searched:
            self.searched[which] = self.search(self.names[which])
        return self.searched[which]

    def search(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best segmentations of a unit, best first: forward Viterbi, then backward A-star.

        Only scores are kept on the way forward; the arcs into a place are found again when the search takes it.
        """
        n, get = len(unit), self.pieces.get
        forward = array("d", [0.0]) + array("d", [-float("inf")]) * n
        for j in range(n):
            here = forward[j]
            for k in range(j + 1, min(n, j + self.longest) + 1):
                hit = get(unit[j:k])
                if hit:
                    if here + hit[1] > forward[k]:
                        forward[k] = here + hit[1]
                elif k == j + 1:
                    forward[k] = max(forward[k], here + self.byte_score * len(unit[j].encode("utf-8", "surrogatepass")))
        # Entries: (-(score behind + forward score), order, place, score behind, path); each is completed at just that value.
        order, agenda, done = itertools.count(), [], []
        agenda.append((-forward[n], next(order), n, 0.0, None))
        while agenda and len(done) < self.nbest:
            value, _, place, behind, path = heapq.heappop(agenda)
            if place == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                done.append((-value, tuple(ids)))
                continue
            for j in range(max(0, place - self.longest), place):
                hit = get(unit[j:place])
                if hit:
                    g, piece = behind + hit[1], (hit[0],)
                elif j == place - 1:
                    piece = tuple(self.byte_id[x] for x in unit[j].encode("utf-8", "surrogatepass"))
                    g = behind + self.byte_score * len(piece)
                else:
                    continue
                heapq.heappush(agenda, (-(g + forward[j]), next(order), j, g, (piece, path)))
            if len(agenda) > self.nbest:
                agenda = heapq.nsmallest(self.nbest, agenda)
        return done

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[float], list[np.ndarray]]]:
        """Of each text: ids of the best segmentation, scores of the N best, ids of the others of those."""
        if len(self.at) > KEPT or self.chars > KEPT_CHARS:
            self.clear()
        units = [self.units.findall(" " + t) if t else [] for t in texts]
        new = list({u: None for own in units for u in own if u not in self.at})
        if new:
            self.learn(new)
        for own in units:
            yield self._encoded(np.fromiter(map(self.at.__getitem__, own), dtype=np.int64, count=len(own)))

    def _encoded(self, which: np.ndarray) -> tuple[np.ndarray, list[float], list[np.ndarray]]:
        if not len(which):
            return np.empty(0, dtype=np.int32), [0.0], []
        begin, size = self.ends[which], self.ends[which + 1] - self.ends[which]
        upto = np.cumsum(size)
        ids = self.ids[np.arange(upto[-1]) + np.repeat(begin - upto + size, size)]
        total = float(self.score[which].sum())
        # Only the units with the smallest steps down can take part in the N best.
        gaps = self.gap[which]
        near = np.argsort(gaps, kind="stable")[: self.nbest - 1] if len(gaps) < 64 else np.sort(np.argpartition(gaps, self.nbest)[: self.nbest - 1])
        near = [int(k) for k in near if np.isfinite(gaps[k])]
        found = [self.results(int(which[k])) for k in near]
        ranked = [[r[0][0] - s for s, _ in r] for r in found]
        agenda, seen, done = [(0.0, (0,) * len(near))], set(), []
        while agenda and len(done) < self.nbest:
            loss, state = heapq.heappop(agenda)
            if state in seen:
                continue
            seen.add(state)
            done.append((loss, state))
            for i, r in enumerate(state):
                if r + 1 < len(ranked[i]):
                    step = state[:i] + (r + 1,) + state[i + 1 :]
                    heapq.heappush(agenda, (sum(ranked[k][x] for k, x in enumerate(step)), step))
        others = []
        for _, state in done[1:]:
            # Between the units that differ stands what the best segmentation has there.
            parts, at = [], 0
            for k, i in sorted((near[i], i) for i, r in enumerate(state) if r):
                parts += [ids[at : upto[k] - size[k]], np.array(found[i][state[i]][1], dtype=np.int32)]
                at = upto[k]
            others.append(np.concatenate([*parts, ids[at:]]))
        return ids, [total - loss for loss, _ in done], others

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[float], list[np.ndarray]]]:
        """encode() in steps of bounded size."""
        begin = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > STEP or i + 1 == len(texts):
                yield from self.encode(texts[begin : i + 1])
                begin, size = i + 1, 0

    def decode(self, ids) -> str:
        """Ids -> text; the blank that encoding puts in front goes."""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")[1:]


_LATTICES: dict[tuple[str, int], Lattice] = {}


def lattice(path: str, nbest: int) -> Lattice:
    if (path, nbest) not in _LATTICES:
        _LATTICES[path, nbest] = Lattice(path, nbest)
    return _LATTICES[path, nbest]


def encode(docs: DataFrame, nbest: int = NBEST, model: str | None = None) -> DataFrame:
    """docs plus piece_ids (the best segmentation), piece_scores (of the N best, best first) and piece_nbest (the others' ids).

    Null and empty texts have no pieces and the score 0. Columns of docs with the names of the new ones are replaced;
    all others, rows that repeat and rows without id included, stay as they are. An empty table gives an empty result.
    """
    model = model or default_model()

    @F.pandas_udf("struct<ids array<int>, scores array<double>, others array<array<int>>>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lat = lattice(model, nbest)
        for texts in batches:
            held, size = [], 0
            for ids, scores, others in lat.encode_all(texts.fillna("").tolist()):
                held.append((ids, scores, others))
                size += len(ids)
                if size > HELD:
                    yield pd.DataFrame(held, columns=["ids", "scores", "others"])
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=["ids", "scores", "others"])

    at = docs.withColumn("piece_ids", pieces("text"))
    return at.withColumns({"piece_scores": F.col("piece_ids.scores"), "piece_nbest": F.col("piece_ids.others")}).withColumn("piece_ids", F.col("piece_ids.ids"))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded plus decoded, the text of piece_ids; null ids give null."""
    model = model or default_model()

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        lat = lattice(model, 1)
        return pd.Series([None if x is None else lat.decode(x) for x in ids], dtype=object)

    return encoded.withColumn("decoded", text("piece_ids"))


def digests(docs: DataFrame, nbest: int = NBEST, model: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, score, n_best, second_score, round_trip, nbest_sha256, nbest_scores): the N best encodings of whole texts.

    The first ones are of the best; round_trip says whether each of the N decodes to the text. nbest_sha256 and
    nbest_scores have all N, best first. Digests are over the ids as little-endian 32-bit integers.
    """
    model = model or default_model()
    sha = lambda ids: hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()
    columns = ["doc_id", "n_pieces", "ids_sha256", "score", "n_best", "second_score", "round_trip", "nbest_sha256", "nbest_scores"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lat = lattice(model, nbest)
        for b in batches:
            rows = []
            for doc, text, (ids, scores, others) in zip(b["doc_id"], b["text"], lat.encode_all(b["text"].tolist()), strict=True):
                every = [ids, *others]
                digest = [sha(x) for x in every]
                same = all(lat.decode(x.tolist()) == text for x in every)
                rows.append((doc, len(ids), digest[0], scores[0], len(scores), scores[1] if len(scores) > 1 else None, same, digest, scores))
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64", "second_score": "float64"})

    kinds = "long, string, double, long, double, boolean, array<string>, array<double>".split(", ")
    schema = "doc_id long, " + ", ".join(f"{c} {k}" for c, k in zip(columns[1:], kinds, strict=True))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(each, schema)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with the piece ids and scores of its N best segmentations."""
    return encode(docs)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLE: dict[str, str] = {}
