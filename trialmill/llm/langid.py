"""Language identification by hierarchical discrimination: first the family, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialise, powers, table

#: Families of closely related languages. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
}
#: Labelled rows that the SVMs are fitted on at most, and buckets of hashed byte n-grams.
SAMPLE, BUCKETS = 4000, 2048
GRAMS = (1, 2, 3)
#: Bytes of text that are counted at once, and rows whose features are held at once.
STEP, ROWS = 1 << 19, 512
EPOCHS, COST = 12, 1.0


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def features(texts: list[bytes]) -> np.ndarray:
    """Rows of unit length: square roots of the shares of hashed byte n-grams of whole lower-cased texts."""
    out = np.zeros((len(texts), BUCKETS))
    p = powers(0x9E3779B97F4A7C15, 5)
    for begin, end in chunks(texts, STEP):
        joined = b"".join(b" " + t + b" " for t in texts[begin:end])
        lengths = np.fromiter((len(t) + 2 for t in texts[begin:end]), dtype=np.int64, count=end - begin)
        last = np.cumsum(lengths)
        # A long text comes in parts, each with the bytes before it that its first grams need.
        for at in range(0, len(joined), 2 * STEP):
            before = min(at, max(GRAMS) - 1)
            data = np.frombuffer(joined, dtype=np.uint8, count=min(2 * STEP, len(joined) - at) + before, offset=at - before).astype(np.uint64)
            row = np.searchsorted(last, np.arange(at - before, at - before + len(data)), side="right")
            for n in GRAMS:
                own = len(row) - n + 1
                code = np.zeros(max(own, 0), dtype=np.uint64)
                for k in range(n):
                    code += (data[k : k + own] + np.uint64(1)) * p[k + 1]
                bucket = ((code ^ (code >> np.uint64(29))) * p[1] >> np.uint64(40)) % np.uint64(BUCKETS)
                inside = (row[:own] == row[n - 1 :]) & (np.arange(own) + n > before)  # no gram reaches into the next text or was counted before
                counts = np.bincount((row[:own] * BUCKETS + bucket.astype(np.int64))[inside], minlength=(end - begin) * BUCKETS)
                out[begin:end] += counts.reshape(end - begin, BUCKETS)
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def svm(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Weights of a linear support vector machine (last: bias) by dual coordinate descent; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    norm, alpha, w = (x * x).sum(axis=1), np.zeros(len(x)), np.zeros(x.shape[1])
    weight = COST * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))  # classes weigh alike
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / norm[i], 0.0), weight[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class OneVersusOne:
    """Linear SVMs for each pair of classes; the class with the most sure votes wins."""

    def __init__(self, x: np.ndarray, y: list[str]):
        self.classes, labels, rng = sorted(set(y)), np.asarray(y), np.random.default_rng(3)
        self.pairs, self.weights = list(itertools.combinations(range(len(self.classes)), 2)), []
        for a, b in self.pairs:
            own = (labels == self.classes[a]) | (labels == self.classes[b])
            self.weights.append(svm(x[own], np.where(labels[own] == self.classes[a], 1.0, -1.0), rng))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers and shares between 0 and 1."""
        k = len(self.classes)
        if k == 1:
            return np.zeros(len(x), dtype=np.int64), np.ones(len(x))
        votes = np.zeros((len(x), k))
        for (a, b), w in zip(self.pairs, self.weights, strict=True):
            p = 1 / (1 + np.exp(-np.clip(3 * (x @ w[:-1] + w[-1]), -30, 30)))
            votes[:, a] += p
            votes[:, b] += 1 - p
        best = votes.argmax(axis=1)
        return best, votes[np.arange(len(x)), best] / (k - 1)


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        of = [family(lang) for lang in langs]
        self.families = OneVersusOne(x, of) if langs else None
        self.within = {f: OneVersusOne(x[[g == f for g in of]], [lang for lang, g in zip(langs, of, strict=True) if g == f]) for f in sorted(set(of))}

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))]
        if known and self.families:
            x = features([texts[i].lower().encode("utf-8", "surrogatepass") for i in known])
            which, sure = self.families.predict(x)
            for f, name in enumerate(self.families.classes):
                own = np.flatnonzero(which == f)
                if len(own):
                    inner, share = self.within[name].predict(x[own])
                    for i, lang, p in zip(own, inner, share * sure[own], strict=True):
                        langs[known[i]], score[known[i]] = self.within[name].classes[lang], p
        return langs, score


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from text and lang of labelled rows: those `sample` rows whose id hashes lowest; rows without lang or text are left out.

    Rows are drawn, not ids: rows that share an id count each, and identical rows count once.
    """
    rows = labelled.filter("lang is not null and text is not null").select("doc_id", "lang", F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    own = ["doc_id", "lang", "mark"]
    ids = materialise(rows.select(own).distinct().orderBy(F.xxhash64("doc_id"), *own).limit(sample))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = [any(map(str.isalpha, t)) for t in b["text"]]
            b = b[known]
            for at in range(0, len(b), ROWS):
                part = b.iloc[at : at + ROWS]
                x = features([t.lower().encode("utf-8", "surrogatepass") for t in part["text"]]).astype(np.float32)
                yield pd.DataFrame({"doc_id": part["doc_id"], "lang": part["lang"], "x": [r.tobytes() for r in x]})

    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"i.{c}")) for c in own]
    drawn = rows.alias("r").join(F.broadcast(ids.alias("i")), same, "left_semi").dropDuplicates(own)
    drawn = drawn.select("doc_id", "lang", "text").mapInPandas(each, "doc_id long, lang string, x binary").toPandas()
    drawn = drawn.sort_values(["doc_id", "lang", "x"])
    x = np.frombuffer(b"".join(drawn["x"]), dtype=np.float32).reshape(-1, BUCKETS).astype(np.float64)
    return Model(x, drawn["lang"].tolist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row from its whole text alone.

    Null texts and texts without a letter are `und` with score 0, and so is every text if there was nothing to learn
    from. Rows that repeat get a row each, null ids stay null, other columns are ignored; an empty table gives an empty
    result. Texts of any length are read whole; features of ROWS texts are held at once, so memory doesn't grow with the texts of a batch.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # one weight row for each pair of languages

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.iloc[at : at + ROWS]
                langs, score = held.value.predict(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "lang_pred": langs, "score": score})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(each, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    found = identify(docs, fit(docs.filter(fold != 1)))
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLE: dict[str, str] = {}
