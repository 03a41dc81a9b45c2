"""Substring deduplication with a compressed FM-index for each shard.

Winnowing picks anchors so that every window of SIZE words has one, the same wherever the window stands. Only
anchors that occur in more than one document matter; the words around them form segments, and equal segments collapse.
A shard indexes its segments as a whole: suffixes sorted by as many words as a search needs, the Burrows-Wheeler
transform in a wavelet tree with packed bits. Segments are then streamed word by word through backward search, all in
step; the matching statistics are capped at SIZE, so that after each word the interval of the current window is known
and with it the smallest document that has the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, id_text, materialise, mix, powers, stored, table, white_mask

#: Words of a window; words of an anchor.
SIZE, ANCHOR = 50, 8
#: Words that a shard should index, and the most shards.
SHARD_WORDS, SHARDS = 400_000, 100_000
#: An anchor in more documents than this hands on its windows one by one, so that no shard gathers all its surroundings.
HOT = 2000
#: Tasks over which the copies of one document are spread.
SALTS = 16

_GRAM = 0xA24BAED4963EE407


def owners(h: np.ndarray, size: int = SIZE, gram: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes -> the anchor of each window (the place of its smallest gram, the rightmost of equals) and the hash of every gram."""
    n, span = len(h) - gram + 1, size - gram + 1
    if len(h) < size:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    total, p = np.zeros(n, dtype=np.uint64), powers(_GRAM, gram)
    for i in range(gram):
        total += h[i : i + n] * p[i]
    g = mix(total)
    # Minima of runs of grams with their places, by doubling.
    low, place, width = g, np.arange(n), 1
    while width < span:
        step = min(width, span - width)
        right = low[step:] <= low[: len(low) - step]
        low = np.where(right, low[step:], low[: len(low) - step])
        place = np.where(right, place[step:], place[: len(place) - step])
        width += step
    return place, g


class Anchored:
    """The windows of a run of texts, dealt to their anchors: text, anchor hash, first and last window of each."""

    def __init__(self, texts: list[bytes], size: int):
        self.words = Words(texts, white_mask())
        place, g = owners(self.words.hashes(), size)
        begin = np.repeat(np.arange(len(texts)), np.diff(self.words.first))[: len(place)]
        windows = np.flatnonzero(np.arange(len(place)) + size <= self.words.first[begin + 1]) if len(place) else place
        place, begin = place[windows], begin[windows]
        cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(begin) != 0)) + 1
        heads = np.concatenate(([0], cut)).astype(np.int64) if len(place) else place
        self.text, self.gram = begin[heads], g[place[heads]].view(np.int64)
        self.head = windows[heads]
        self.tail = windows[np.concatenate((cut, [len(place)])) - 1] if len(place) else place
        #: The anchors of text i are those from of[i] to of[i + 1].
        self.of = np.searchsorted(self.text, np.arange(len(texts) + 1))


class WaveletTree:
    """Rank queries over a sequence of numbers: a bit row for each level, packed, with running counts (matrix layout)."""

    def __init__(self, values: np.ndarray, kinds: int):
        self.levels, self.n = max(1, int(kinds - 1).bit_length()), len(values)
        self.rows, self.zeros = [], []
        words = self.n // 64 + 1
        for level in range(self.levels - 1, -1, -1):
            bits = ((values >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate((bits, np.zeros(words * 64 - self.n, dtype=bool))), bitorder="little").view(np.uint64)
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]))
            self.rows.append((packed, counts))
            self.zeros.append(self.n - int(bits.sum()))
            values = np.concatenate((values[~bits], values[bits]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place, plus where the symbol's own run begins; see start()."""
        for level, ((packed, counts), zeros) in enumerate(zip(self.rows, self.zeros, strict=True)):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            ones = counts[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            at = np.where((symbol >> (self.levels - 1 - level)) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Segments (lists of words as numbers) -> backward search of windows of up to `size` words."""

    def __init__(self, segments: list[np.ndarray], size: int = SIZE):
        self.size = size
        # A separator after each segment; its number is the smallest.
        text = np.concatenate([np.concatenate((s + 1, [0])) for s in segments]) if segments else np.zeros(1, dtype=np.int64)
        n, self.kinds = len(text), int(text.max()) + 1
        # Suffixes by their first 2**k > size words (ties as they stand), by prefix doubling on the cyclic text; on the way
        # the runs of suffixes that agree in just `size` words.
        rank, step, agree = text.astype(np.int64), 1, None
        while step <= size:
            if size < 2 * step:
                agree = np.unique(rank * (int(rank.max()) + 1) + np.roll(rank, -(size - step)), return_inverse=True)[1] if size > step else rank.copy()
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        own = agree[self.order]
        self.same = np.concatenate(([0], np.cumsum(own[1:] != own[:-1])))
        self.tree = WaveletTree(text[self.order - 1], self.kinds)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.kinds))))
        self.begin = self.tree.rank(np.arange(self.kinds), np.zeros(self.kinds, dtype=np.int64))

    def smallest(self, values: np.ndarray) -> None:
        """values: a number for each place of the text; kept is the smallest over each run of equal windows."""
        starts = np.flatnonzero(np.concatenate(([True], np.diff(self.same) > 0)))
        self.least = np.minimum.reduceat(values[self.order], starts)
        self.run_begin, self.run_end = starts, np.concatenate((starts[1:], [len(self.order)]))

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals [low, high) of patterns -> those of symbol + pattern."""
        base = self.before[symbol] - self.begin[symbol]
        return base + self.tree.rank(symbol, low), base + self.tree.rank(symbol, high)


def window_owners(segments: list[np.ndarray], docs: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """For each window of each segment the smallest of docs among all segments that have the window."""
    index = FMIndex(segments, size)
    lengths = np.array([len(s) for s in segments])
    index.smallest(np.repeat(docs, lengths + 1))
    n = len(index.order)
    # All segments are streamed from their ends, the longest first, so that those still running stand together.
    order = np.argsort(-lengths, kind="stable")
    sized = lengths[order]
    wide = int(sized[0]) if len(sized) else 0
    padded = np.zeros((len(segments), wide), dtype=np.int64)
    for row, k in enumerate(order):
        padded[row, wide - lengths[k] :] = segments[k] + 1
    low, high = np.zeros(len(segments), dtype=np.int64), np.full(len(segments), n, dtype=np.int64)
    found = np.zeros((len(segments), wide), dtype=np.int64)
    for t in range(1, wide + 1):
        live = int(np.searchsorted(-sized, -t, side="right"))
        a, z = index.step(low[:live], high[:live], padded[:live, wide - t])
        if t >= size:  # the window is complete: its run of suffixes is the interval, shortened to `size` words
            run = index.same[a]
            a, z = index.run_begin[run], index.run_end[run]
            found[:live, wide - t] = index.least[run]
        low[:live], high[:live] = a, z
    out: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(segments)
    for row, k in enumerate(order):
        out[k] = found[row, wide - lengths[k] : wide - size + 1]
    return out


def _runs(mask: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge.reshape(-1, 2).tolist()


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def repeats(docs: DataFrame, size: int = SIZE, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed) for each row of docs; removed lists the stretches of words that go, as (first, end).

    A word goes if a window of `size` consecutive words covers it whose words also start in a document with a smaller
    doc_id. Words are runs of other than white space, unchanged; null texts have none. Documents with fewer words lose
    nothing. Rows that share a doc_id each get a row and count as one document; rows with null doc_id neither lose nor
    take anything. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    given = id_text(docs)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            rows = []
            for begin, end in chunks(texts):
                held = Anchored(texts[begin:end], size)
                n = np.diff(held.words.first)
                rows += [(int(n[i]), _digest(texts[begin + i].split()), held.gram[held.of[i] : held.of[i + 1]].tolist()) for i in range(end - begin)]
            out = pd.DataFrame(rows, columns=["n_words", "words_sha256", "anchors"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out.astype({"doc_id": "Int64"})

    scanned = materialise(given.mapInPandas(scan, "doc_id long, n_words long, words_sha256 string, anchors array<long>"))
    # Documents with the very same words stand for each other: all but the smallest lose all their words. A group of
    # copies is dealt to SALTS tasks, on the way to its smallest document and back.
    scanned = scanned.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    by_salt = scanned.filter((F.col("n_words") >= size) & F.col("doc_id").isNotNull()).groupBy("words_sha256", "salt").agg(F.min("doc_id").alias("least"))
    same = materialise(by_salt.groupBy("words_sha256").agg(F.min("least").alias("least"), F.collect_set("salt").alias("salts")))
    spread = same.select("words_sha256", "least", F.explode("salts").alias("salt"))
    known = scanned.join(spread, ["words_sha256", "salt"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    first = known.filter((F.col("doc_id") == F.col("least")))
    grams = first.select("doc_id", F.explode(F.array_distinct("anchors")).alias("gram"))
    shared = grams.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count(F.lit(1)).alias("n")).filter("a < z").select("gram", (F.col("n") > hot).alias("hot"))
    near = materialise(grams.join(shared, "gram").groupBy("doc_id").agg(F.collect_list(F.struct("gram", "hot")).alias("found")).select("doc_id", F.col("found.gram").alias("grams"), F.col("found.hot").alias("hots")))
    # Only documents with a shared anchor are read again; all others have their result already.
    texts = stored(given.join(near, "doc_id").withColumn("row", F.monotonically_increasing_id()))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["row", "doc_id", "begin", "windows", "key", "segment"]
        for b in batches:
            raw, rows = [t.encode("utf-8", "surrogatepass") for t in b["text"]], []
            ids, docs_ = b["row"].to_numpy(), b["doc_id"].to_numpy()
            for begin, end in chunks(raw):
                held = Anchored(raw[begin:end], size)
                words, data = held.words, held.words.data
                for i in range(end - begin):
                    some = dict(zip(b["grams"].iloc[begin + i].tolist(), b["hots"].iloc[begin + i].tolist(), strict=True))
                    for k in range(held.of[i], held.of[i + 1]):
                        gram, a, z = int(held.gram[k]), int(held.head[k]), int(held.tail[k])
                        if gram not in some:
                            continue
                        for f, l_ in [(x, x) for x in range(a, z + 1)] if some[gram] else [(a, z)]:
                            segment = b" ".join(data[words.start[f] : words.end[l_ + size - 1]].split())
                            key = int.from_bytes(hashlib.blake2b(segment, digest_size=8).digest(), "little", signed=True) if some[gram] else gram
                            rows.append((ids[begin + i], docs_[begin + i], f - int(words.first[i]), l_ - f + 1, key, segment.decode("utf-8", "surrogatepass")))
                    if len(rows) > 4000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    segments = texts.mapInPandas(cut, "row long, doc_id long, begin long, windows long, key long, segment string")
    mark = F.sha2(F.col("segment").cast("binary"), 256).alias("mark")
    distinct = segments.groupBy("key", "segment").agg(F.min("doc_id").alias("least")).select("key", "segment", "least", mark)
    total = near.agg(F.sum(F.size("grams"))).first()[0] or 0
    shards = max(1, min(SHARDS, int(total * 2.2 * size // SHARD_WORDS) + 1))

    def search(_: tuple, b: pd.DataFrame) -> pd.DataFrame:
        ids: dict[str, int] = {}
        lists = [np.array([ids.setdefault(w, len(ids)) for w in s.split(" ")], dtype=np.int64) for s in b["segment"]]
        least = b["least"].to_numpy(dtype=np.int64)
        gone = [_runs(w < d) for w, d in zip(window_owners(lists, least, size), least, strict=True)]
        return pd.DataFrame({"mark": b["mark"], "key": b["key"], "first": least, "gone": gone})

    found = distinct.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(search, "mark string, key long, first long, gone array<array<long>>")
    # The smallest document of a segment loses what its index found; every other has all windows in that one.
    placed = segments.select("row", "doc_id", "begin", "windows", "key", mark).join(found, ["key", "mark"])
    whole = F.array(F.array(F.lit(0).cast("long"), F.col("windows")))
    gone = placed.select("row", "begin", F.explode(F.when(F.col("doc_id") > F.col("first"), whole).otherwise(F.col("gone"))).alias("w"))
    stretches = gone.select("row", F.array(F.col("begin") + F.col("w")[0], F.col("begin") + F.col("w")[1] + size - 1).alias("s")).groupBy("row").agg(F.collect_list("s").alias("gone"))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, gone_ in zip(b["doc_id"], b["text"], b["gone"], strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                mask = np.zeros(len(words) + 1, dtype=np.int64)
                for a, z in gone_:
                    mask[a] += 1
                    mask[z] -= 1
                out = np.cumsum(mask[:-1]) > 0
                rows.append((doc, int(out.sum()), _digest([w for w, o in zip(words, out, strict=True) if not o]), _runs(out), _digest(words)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_removed", "kept_sha256", "removed", "words_sha256"])

    shortened = texts.join(stretches, "row").select("doc_id", "text", "gone").mapInPandas(remove, "doc_id long, n_removed long, kept_sha256 string, removed array<array<long>>, words_sha256 string").dropDuplicates(["doc_id", "words_sha256"])
    nothing = hashlib.sha256(b"").hexdigest()
    none = F.array().cast("array<array<long>>")
    everything = F.array(F.array(F.lit(0).cast("long"), F.col("n_words")))
    joined = known.select("doc_id", "n_words", "words_sha256", "copy").join(shortened, ["doc_id", "words_sha256"], "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
        F.when(F.col("copy"), everything).otherwise(F.coalesce("removed", none)).alias("removed"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).drop("removed")


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLE: dict[str, str] = {}
