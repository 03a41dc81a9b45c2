"""Toxicity by class-conditional Kneser-Ney models.

The models spell words: an event is a byte of a word, or its end, after up to ORDER - 1 bytes that never reach beyond
the word's beginning. So every whole word is read, inflected and compound forms share what they have in common, and
scripts without blanks are read like any other. Occurrences in all labelled texts are counted for the toxic and the
ordinary class. Both counts together give an interpolated Kneser-Ney model, whose lower orders use continuation counts;
each class's model takes discounts off its own counts and backs off to that shared model, so a rare expression weighs
little. There are three discounts for each order and class, for counts of one, two and more, found from counts of counts
(modified Kneser-Ney). Keys are the bytes themselves: there are no hash buckets and nothing is dropped.

A text is scored by the length-normalised difference of its two log-likelihoods. What language and topic owe to the
classes shifts all words of a text alike, so the difference is also taken against the text's median word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, fresh, materialise, slices, stored, table, word_mask

#: Bytes of an event with its context; at most 8, so that a key is a long. UTF-8 has no byte above 244, so keys lie apart from those of contexts.
ORDER = 8
#: Entries of the model that executors hold in memory; the most frequent ones. All others are joined.
HOT = 1 << 22
#: Of them, about so many reach the driver at once.
PART = 1 << 18
#: Labelled rows at most on which the two-class threshold is calibrated, all of the calibration fold.
CALIBRATION = 5000
#: Labelled ids are broadcast up to this many rows; more are joined by a shuffle of the texts.
BROADCAST_ROWS = 2_000_000
#: Counted events that a task holds before it hands them on.
FLUSH = 1_000_000
#: Bytes of text that a task counts or scores at once.
STEP = 1 << 19
#: Rows whose texts a task takes out of an Arrow batch at once.
ROWS = 256
#: By so much a word's difference has to exceed the text's median to stand out.
MARGIN = 2.0
FEATURES = 3
#: A discount keeps so far from none and from all of a count.
LEAST = 0.05

_BLANK = 32


def _bytes(texts: Iterable[str | None]) -> list[bytes]:
    """Texts as bytes, null as empty."""
    return [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of few rows, so that the texts of one slice at a time stand in memory a second and third time."""
    for b in batches:
        for i in range(0, len(b), ROWS):
            yield b.slice(i, ROWS)


def distinct_words(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of a run of texts, the place of one of each kind, and the kind of every word."""
    words = Words(texts, word_mask())
    _, place, kind = np.unique(words.hashes(), return_index=True, return_inverse=True)
    return words, place, kind


def events(words: Words, place: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Of the words at these places: the key of every event, bytes from the word's leading blank on, and each word's first event."""
    size = words.end[place] - words.start[place] + 2  # a blank on either side
    first = np.concatenate(([0], np.cumsum(size)))
    of = np.repeat(np.arange(len(place)), size)
    within = np.arange(first[-1]) - first[of]
    raw = np.frombuffer(words.data, dtype=np.uint8)
    own = (within > 0) & (within < size[of] - 1)
    spelled = np.full(first[-1], _BLANK, dtype=np.uint64)
    spelled[own] = raw[words.start[place][of[own]] + within[own] - 1]
    padded = np.concatenate((np.zeros(order - 1, dtype=np.uint64), spelled))
    key = np.zeros(len(spelled), dtype=np.uint64)
    for i in range(order):
        key = (key << np.uint64(8)) | padded[i : i + len(spelled)]
    short = np.flatnonzero(within + 1 < order)
    key[short] &= (np.uint64(1) << (8 * (within[short] + 1)).astype(np.uint64)) - np.uint64(1)
    keep = within > 0
    return key[keep].view(np.int64), first[:-1] - np.arange(len(place))


def contexts(key: np.ndarray) -> np.ndarray:
    """The keys of events' contexts."""
    return -1 - (key.view(np.uint64) >> np.uint64(8)).view(np.int64)


def count_events(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(text, toxic) -> (key, n0, n1): how often each event occurs in ordinary and toxic texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, n = np.concatenate([k for k, _ in held]), np.concatenate([w for _, w in held])
            held.clear()
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sums = np.add.reduceat(n, first, axis=0, dtype=np.int64)
            return pa.RecordBatch.from_pydict({"key": keys[first], "n0": np.ascontiguousarray(sums[:, 0]), "n1": np.ascontiguousarray(sums[:, 1])})

        for b in _rows(batches):
            parts = [slices(t, word_mask(), STEP) for t in _bytes(b.column("text").to_pylist())]
            toxic, texts = np.repeat(b.column("toxic").to_numpy(zero_copy_only=False) == 1, list(map(len, parts))), [p for own in parts for p in own]
            for begin, end in chunks(texts, STEP):
                words, place, kind = distinct_words(texts[begin:end])
                if not len(place):
                    continue
                of = np.repeat(toxic[begin:end], np.diff(words.first))
                times = np.stack([np.bincount(kind[of == c], minlength=len(place)) for c in (False, True)], axis=1)
                key, first = events(words, place, order)
                keys, at = np.unique(key, return_inverse=True)
                of = np.repeat(np.arange(len(place)), np.diff(np.append(first, len(key))))
                # A chunk has fewer than 2^31 bytes, so its counts take four.
                held.append((keys, np.stack([np.bincount(at, times[of, c], len(keys)) for c in (0, 1)], axis=1).astype(np.int32)))
                if sum(len(k) for k, _ in held) > FLUSH:
                    yield flush()
        if held:
            yield flush()

    found = labelled.select("text", "toxic").mapInArrow(each, "key long, n0 long, n1 long")
    return found.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _context(key: str = "key") -> Column:
    return F.shiftrightunsigned(key, 8)


def _length(key: str, order: int) -> Column:
    """Bytes of a key; no byte of a word or blank is zero, and only the longest keys are negative."""
    out = F.lit(1)
    for k in range(1, order):
        out = F.when(F.col(key) >= 1 << (8 * k), k + 1).otherwise(out)
    return F.when(F.col(key) < 0, order).otherwise(out)


def discounts(of: list[int]) -> list[float]:
    """What is taken off counts of one, two and more, from how many events have the counts one to four."""
    y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.5
    raw = [k - (k + 1) * y * of[k] / of[k - 1] if of[k - 1] else k * y for k in (1, 2, 3)]
    return [min(max(d, LEAST), k - LEAST) for k, d in zip((1, 2, 3), raw, strict=True)]


def _taken(count: str, d: list[float]) -> Column:
    """The discount of a count."""
    c = F.col(count)
    return F.when(c == 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def _few(count: str) -> list[Column]:
    return [F.count_if(F.col(count) == k).alias(f"{count}_{k}") for k in (1, 2, 3, 4)]


def shared_model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, p): the interpolated Kneser-Ney probability of each counted event in both classes' counts.

    An event of the highest order or at a word's beginning has its own count, every other the number of distinct bytes
    before it. Below the shortest events all bytes are alike.
    """
    sized = counts.select("key", (F.col("n0") + F.col("n1")).alias("a"), _length("key", order).alias("size"))
    level = stored(sized.filter(F.col("size") == order).select("key", "a"))
    levels = []
    for k in range(order, 0, -1):
        levels.append(level)
        cut = level.select(F.col("key").bitwiseAND((1 << (8 * (k - 1))) - 1).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("a"))
        level = stored(cut.unionByName(sized.filter(F.col("size") == k - 1).select("key", "a"))) if k > 1 else level
    below, done = None, None
    for k, rows in enumerate(reversed(levels), 1):
        d = discounts(list(rows.agg(*_few("a")).first()))
        around = rows.groupBy(_context().alias("context")).agg(F.sum("a").alias("all"), F.sum(_taken("a", d)).alias("freed"))
        own = rows.withColumn("context", _context()).join(around, "context").withColumn("low", F.col("key").bitwiseAND((1 << (8 * (k - 1))) - 1))
        own = own.withColumn("p_low", F.lit(1 / 256)) if below is None else own.join(below, "low")
        p = (F.col("a") - _taken("a", d) + F.col("freed") * F.col("p_low")) / F.col("all")
        # What the next order reads is cut from its lineage, or each order would repeat all those below it.
        level = own.select("key", p.alias("p"))
        level = stored(level) if k < order else level
        below = level.select(F.col("key").alias("low"), F.col("p").alias("p_low"))
        done = level if done is None else done.unionByName(level)
    return counts.select("key").join(done, "key")


def ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, r, n): log P(toxic) - log P(ordinary) of each counted event, and of a context before what it was never
    seen with, under the key -1 - context; n is how often it was seen."""
    few = list(counts.agg(*_few("n0"), *_few("n1")).first())
    d = [discounts(few[:4]), discounts(few[4:])]
    context = _context().alias("context")
    total = [F.sum(f"n{c}").alias(f"all{c}") for c in (0, 1)] + [F.sum(_taken(f"n{c}", d[c])).alias(f"freed{c}") for c in (0, 1)]
    around = stored(counts.groupBy(context).agg(*total))
    share = lambda c: F.when(F.col(f"all{c}") > 0, F.col(f"freed{c}") / F.col(f"all{c}")).otherwise(1.0)
    own = lambda c: F.when(F.col(f"all{c}") > 0, (F.col(f"n{c}") - _taken(f"n{c}", d[c])) / F.col(f"all{c}")).otherwise(0.0)
    known = counts.join(shared_model(counts, order), "key").withColumn("context", context).join(around, "context")
    p = [own(c) + share(c) * F.col("p") for c in (0, 1)]
    seen = known.select("key", (F.ln(p[1]) - F.ln(p[0])).alias("r"), (F.col("n0") + F.col("n1")).alias("n"))
    unseen = around.select((-1 - F.col("context")).alias("key"), (F.ln(share(1)) - F.ln(share(0))).alias("r"), (F.col("all0") + F.col("all1")).alias("n"))
    return seen.unionByName(unseen)


class Scorer:
    """What an executor needs: the most frequent entries of the model in the order of their keys, and whether they are all."""

    def __init__(self, keys: np.ndarray, r: np.ndarray, whole: bool, order: int):
        self.keys, self.r, self.whole, self.order = keys, r, whole, order

    def look(self, keys: np.ndarray, more: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Entries of keys and whether there are any, in memory or in `more`."""
        out, hit = np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
        for have, r in ((self.keys, self.r), more or (self.keys[:0], self.r[:0])):
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                own = have[at] == keys
                out[own], hit = r[at[own]], hit | own
        return out, hit

    def events(self, key: np.ndarray, more: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The difference that each event makes: its own, or its context's, or none."""
        out, hit = self.look(key, more)
        out[~hit] = self.look(contexts(key[~hit]), more)[0]
        return out

    def missing(self, text: bytes) -> np.ndarray:
        """Keys of a text that decide its score and are not in memory."""
        key = np.empty(0, dtype=np.int64)
        for part in slices(text, word_mask(), STEP):
            words, place, _ = distinct_words([part])
            key = np.union1d(key, events(words, place, self.order)[0])
        key = key[~self.look(key)[1]]
        context = np.unique(contexts(key))
        return np.concatenate((key, context[~self.look(context)[1]]))

    def differences(self, texts: list[bytes], more: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The difference of each kind of word, the kind of each word and the first word of each text."""
        words, place, kind = distinct_words(texts)
        if not len(place):
            return np.empty(0), kind, words.first
        key, first = events(words, place, self.order)
        keys, at = np.unique(key, return_inverse=True)
        return np.add.reduceat(self.events(keys, more)[at], first), kind, words.first

    def features(self, texts: list[bytes], more: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Of each text: the mean of its words' differences, by how much that exceeds their median, and the mean of what exceeds the median by more than MARGIN."""
        out = np.zeros((len(texts), FEATURES))
        for begin, end in chunks(texts, STEP):
            if end - begin == 1 and len(texts[begin]) > 2 * STEP:
                # A very long text comes in parts; of each word only its difference is kept.
                parts = [self.differences([p], more) for p in slices(texts[begin], word_mask(), STEP)]
                own = np.sort(np.concatenate([each[kind] for each, kind, _ in parts]))
                if len(own):
                    usual = own[len(own) // 2]
                    out[begin] = own.mean(), own.mean() - usual, np.sqrt(np.maximum(own - usual - MARGIN, 0).mean())
                continue
            each, kind, first = self.differences(texts[begin:end], more)
            if not len(each):
                continue
            n = np.diff(first)
            of = np.repeat(np.arange(end - begin), n)
            mean = np.bincount(of, each[kind], minlength=end - begin) / np.maximum(n, 1)
            # Ranks of the kinds make the median of each text a sort of numbers.
            rank = np.empty(len(each), dtype=np.int64)
            by_rank = np.argsort(each, kind="stable")
            rank[by_rank] = np.arange(len(each))
            sorted_ = np.sort(of * len(each) + rank[kind]) % len(each)
            usual = each[by_rank[sorted_[np.minimum(first[:-1] + n // 2, len(sorted_) - 1)]]]
            usual[n == 0] = 0
            excess = np.maximum(each[kind] - np.repeat(usual, n) - MARGIN, 0)
            tail = np.bincount(of, excess, minlength=end - begin) / np.maximum(n, 1)
            out[begin:end] = np.stack([mean, mean - usual, np.sqrt(tail)], axis=1)
        return out


def calibrated(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps with a weak ridge."""
    x, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(FEATURES + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - toxic) + 1e-3 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(FEATURES + 1), g)
    return w


class Models:
    """The fitted model: a table of all entries, the most frequent ones for the executors, and the calibration. Nothing was learnt if held is None."""

    def __init__(self, entries: DataFrame | None, scorer: Scorer | None):
        self.entries, self.whole, self.weights = entries, scorer is not None and scorer.whole, np.zeros(FEATURES + 1)
        # HOT entries at most. The driver keeps no arrays of its own besides the broadcast.
        self.held = entries.sparkSession.sparkContext.broadcast(scorer) if scorer else None

    @property
    def scorer(self) -> Scorer | None:
        """Read back from the broadcast."""
        return self.held.value if self.held else None


def _packed(entries: DataFrame, n: int) -> DataFrame:
    """(keys, r): n entries by key in partitions of about PART, in binary rows."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"keys": [b["key"].to_numpy(dtype=np.int64).tobytes()], "r": [b["r"].to_numpy(dtype=np.float64).tobytes()]})

    dealt = entries.select("key", "r").repartitionByRange(max(1, -(-n // PART)), "key").sortWithinPartitions("key")
    return dealt.mapInPandas(packed, "keys binary, r binary")


def _held_entries(entries: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of n entries in order and what they hold; executors sort and pack them, the driver fills two arrays from one partition after the other."""
    keys, r, at = np.empty(n, dtype=np.int64), np.empty(n), 0
    for part in _packed(entries, n).toLocalIterator():
        own = np.frombuffer(part["keys"], dtype=np.int64)
        keys[at : at + len(own)], r[at : at + len(own)] = own, np.frombuffer(part["r"])
        at += len(own)
    return keys, r


def _featured(docs: DataFrame, models: Models, columns: list[str], name: str = "x") -> DataFrame:
    """columns of docs and x, or another name: the features of the column text, null counting as empty; rows stay where they are unless entries have to be joined."""
    held = models.held

    @F.arrow_udf("array<double>")
    def direct(texts: pa.Array) -> pa.Array:
        found = [held.value.features(_bytes(texts.slice(i, ROWS).to_pylist())) for i in range(0, len(texts), ROWS)]
        x = np.concatenate(found) if found else np.zeros((0, FEATURES))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))

    if models.whole:
        return docs.select(*columns, direct("text").alias(name))

    @F.pandas_udf("array<long>")
    def missing(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.missing(t) for t in _bytes(texts)])

    @F.arrow_udf("array<double>")
    def joined(texts: pa.Array, keys: pa.Array, r: pa.Array) -> pa.Array:
        out = []
        for i in range(len(texts)):
            k, more = keys[i].values, None
            if k is not None:
                k = k.to_numpy()
                order = np.argsort(k)
                more = k[order], r[i].values.to_numpy()[order]
            out.append(held.value.features(_bytes([texts[i].as_py()]), more)[0])
        return pa.array(out, pa.list_(pa.float64()))

    # A score depends on nothing but the text, so texts are named by their digest.
    mark, of, more = F.sha2(F.col("text").cast("binary"), 256), fresh(docs, "digest"), fresh(docs, "entries")
    wanted = docs.filter("text is not null").select(mark.alias(of), F.explode(missing("text")).alias("key")).distinct()
    found = wanted.join(models.entries.select("key", "r"), "key").groupBy(of).agg(F.collect_list(F.struct("key", "r")).alias(more))
    faced = docs.withColumn(of, mark).join(found, of, "left")
    return faced.select(*columns, joined("text", F.col(f"{more}.key"), F.col(f"{more}.r")).alias(name))


def fit(docs: DataFrame, labels: DataFrame, calibration: int = CALIBRATION, order: int = ORDER, hot: int = HOT) -> Models:
    """Models from all labelled rows; a quarter of them, by hash of doc_id, is held back to calibrate the score.

    Rows without label, text or id teach nothing; of several labels of a document the largest counts.
    """
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.filter("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = materialise(marks)
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
    back = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0
    labelled = texts.join(marks, "doc_id")
    counts = stored(count_events(labelled.filter(~back), order))
    if counts.isEmpty():
        return Models(None, None)
    entries = stored(ratios(counts, order))
    n = entries.count()
    whole = n <= hot
    models = Models(entries, Scorer(*_held_entries(entries if whole else entries.orderBy(F.desc("n"), "key").limit(hot), min(n, hot)), whole, order))
    # Rows are bounded, not ids: what repeats an id has its own place in the order.
    mark = F.xxhash64("text").alias("mark")
    drawn = materialise(labelled.filter(back).select("doc_id", mark).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(calibration))
    own = labelled.filter(back).withColumn("mark", mark).join(F.broadcast(drawn), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    got = _featured(own, models, ["doc_id", "mark", "toxic"]).orderBy("doc_id", "mark").toPandas()
    if len(got):
        models.weights = calibrated(np.stack(got["x"].to_numpy()), got["toxic"].to_numpy(dtype=np.float64))
    return models


def scored(docs: DataFrame, models: Models, name: str = "score") -> DataFrame:
    """docs with the score of the column text as a further column; null counts as empty."""
    if models.held is None:
        return docs.withColumn(name, F.lit(0.0))
    weights = models.weights

    # Of the same kind as what makes x, so that one worker of a task does both.
    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        at = np.hstack([x.flatten().to_numpy().reshape(-1, FEATURES), np.ones((len(x), 1))])
        return pa.array(1 / (1 + np.exp(-np.clip(at @ weights, -30, 30))))

    names, x = [f"`{c}`" for c in docs.columns], fresh(docs, "x")
    return _featured(docs, models, names, x).withColumn(name, score(x)).drop(x)


def scores(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, score), score from 0 to 1, of every whole text in docs; null counts as empty.

    Empty texts get the score of a text without evidence. If there was nothing to learn from every score is 0. Rows
    that repeat get a row each, null ids stay null; other columns are ignored; an empty table gives an empty result.
    """
    return scored(docs.select("doc_id", "text"), models).select("doc_id", "score")


def reject(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score is 0.5 or more go; labels teach, but never decide.

    Rows are judged one by one: rows that repeat go or stay together, rows without id are judged like any other, null and
    empty texts stay unless most labelled empty texts are toxic. All columns stay as they are; an empty table gives an
    empty result. Texts of any length are read in whole.
    """
    models = fit(docs, table(spark, sf_dir, "labels"))
    mark = fresh(docs, "score")
    return scored(docs, models, mark).filter(F.col(f"`{mark}`") < 0.5).drop(mark)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    models = fit(docs.filter(~fold), table(spark, sf_dir, "labels").filter(~fold))
    return scores(docs, models).select("doc_id", fold.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE: dict[str, str] = {}
