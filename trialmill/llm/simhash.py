"""SimHash near-duplicates: 64-bit fingerprints, exact pairs from vantage-point shards, components of links.

Fingerprints are made in Arrow batches. Equal fingerprints collapse first, so a group of copies is one row. A routing
tree of vantage points, fitted on a bounded sample of fingerprints, deals the distinct fingerprints to shards; a point
whose distance to a vantage point lies within the radius of the split goes down both sides, which the triangle
inequality shows to be enough for every close pair to meet. Inside its shard the same split recurs down to small blocks
that are compared exactly, and each block reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, materialise, table
from .components import components
from .similar import near_copies, text_mark

#: Fixed values of the contract: hash seed, words of a shingle, bits by which linked fingerprints may differ.
SEED, SHINGLE, RADIUS = 42, 3, 2
#: The routing tree is fitted on this many fingerprints at most and has this many leaves at most.
SAMPLE, LEAVES = 16384, 4096
#: Fingerprints that a shard should hold, and a block inside a shard that is compared at once.
SHARD, BLOCK = 8000, 256

_hash = functools.partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Of a UTF-8 text: the majority of each bit over the hashes of all its shingles; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    h = np.fromiter(map(_hash, grams), dtype=np.uint64)
    # Bits are counted in slices that fit a byte, so no array is larger than 64 bytes a hash of one slice.
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 8192):
        bits = np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        while len(bits) > 255:
            whole = len(bits) // 128 * 128
            counts += bits[whole:].sum(axis=0, dtype=np.int64)
            part = bits[:whole].reshape(128, -1, 64).sum(axis=0, dtype=np.uint8)
            counts += part.sum(axis=0, dtype=np.int64)
            bits = bits[:0]
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fingerprints(docs: DataFrame, width: int = SHINGLE, *more: Column) -> DataFrame:
    """(doc_id, the columns more, fp): fp is the fingerprint's 64 bits as a long. Null text counts as empty."""
    given = id_text(docs, *more)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.encode("utf-8", "surrogatepass"), width) for t in b["text"]), dtype=np.uint64, count=len(b))
            yield b.drop(columns="text").assign(fp=signed(fp))

    return given.mapInPandas(each, ", ".join(f"{c} {kind}" for c, kind in given.drop("text").dtypes) + ", fp long")


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


class Tree:
    """A balanced routing tree: node i has children 2i+1 and 2i+2; the last level's children are the shards."""

    def __init__(self, depth: int, sample: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth, self.vantage, self.split = depth, np.zeros(2**depth - 1, dtype=np.uint64), np.zeros(2**depth - 1, dtype=np.uint8)
        held = {0: sample}
        for node in range(2**depth - 1):
            own = held.pop(node)
            pick = own if len(own) else sample
            v = pick[rng.integers(len(pick))] if len(pick) else rng.integers(0, 2**63, dtype=np.uint64)
            d = distances(own, v)
            self.vantage[node], self.split[node] = v, np.median(d) if len(d) else 32
            held[2 * node + 1], held[2 * node + 2] = own[d <= self.split[node]], own[d > self.split[node]]

    def route(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the point, shard) for every shard a point has to visit.

        A point within the split goes left, one beyond it right. Two points within radius of each other on opposite
        sides of the split have the nearer one in the last `radius` distances of the left side: such points go right too.
        """
        at, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            d, mu = distances(points[at], self.vantage[node]).astype(np.int16), self.split[node].astype(np.int16)
            left, right = d <= mu, d > mu - radius
            at, node = np.concatenate((at[left], at[right])), np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
        return at, node - (2**self.depth - 1)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links -> (member, root) of their components, by label minima and pointer jumping."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def close_links(points: np.ndarray, radius: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Distinct points of a shard -> links that join just what pairs within radius join; vantage-point recursion, then exact blocks."""
    found_a, found_b, todo = [], [], [(np.arange(len(points)), 0)]
    rng = np.random.default_rng(len(points))
    while todo:
        own, failed = todo.pop()
        if len(own) < 2:
            continue
        if len(own) > block and failed < 4:
            d = distances(points[own], points[own[rng.integers(len(own))]]).astype(np.int16)
            mu = int(np.median(d))
            left, right = own[d <= mu], own[d > mu - radius]
            # A cut that hardly shortens the larger side is tried again with other vantage points, then given up.
            poor = max(len(left), len(right)) > 0.9 * len(own)
            todo += [(own, failed + 1)] if poor else [(left, 0), (right, 0)]
            continue
        for i in range(0, len(own), 1024):  # in strips, so that memory stays within bounds
            rows = points[own[i : i + 1024]]
            for j in range(i, len(own), 1024):
                x, y = np.nonzero(np.bitwise_count(rows[:, None] ^ points[own[j : j + 1024]][None, :]) <= radius)
                keep = x + i < y + j
                member, root = _forest(x[keep] + i, y[keep] + j, len(own)) if keep.any() else ((), ())
                if len(member):
                    found_a.append(own[member])
                    found_b.append(own[root])
    if not found_a:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return _forest(np.concatenate(found_a), np.concatenate(found_b), len(points))


def linked(distinct: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, leaves: int = LEAVES, shard: int = SHARD) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) between fingerprints within radius bits, enough of them for the components."""
    spark = distinct.sparkSession
    n = distinct.count()
    drawn = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    depth = 0
    while 2**depth < min(leaves, n / shard):
        depth += 1
    tree = spark.sparkContext.broadcast(Tree(depth, drawn))  # bounded by leaves

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(dtype=np.int64)
            for i in range(0, len(fp), 65536):
                at, to = tree.value.route(fp[i : i + 65536].view(np.uint64), radius)
                yield pd.DataFrame({"shard": to, "fp": fp[i : i + 65536][at]})

    def pairs(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        fp = b["fp"].to_numpy(dtype=np.int64)
        member, root = close_links(np.ascontiguousarray(fp).view(np.uint64), radius)
        return pd.DataFrame({"a": fp[member], "b": fp[root]})

    return distinct.mapInPandas(route, "shard long, fp long").groupBy("shard").applyInPandas(pairs, "a long, b long")


def near_dups(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the smallest doc_id that links of at most radius differing bits reach. Documents without words
    have fingerprint zero and link like any other; null text counts as empty; rows with the same doc_id each get a row;
    rows with null doc_id take part and return null ids only if no other document is reachable. Of an
    empty table the result is empty. Other columns are ignored.
    """
    marked = materialise(fingerprints(docs, width))
    lowest = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = materialise(lowest)
    root = components(linked(distinct.select("fp"), radius))
    # Lone fingerprints are their own root; each root's smallest doc_id is a minimum that combines before the shuffle.
    rooted = distinct.join(root, distinct["fp"] == root["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_links(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """Links (a, b) between rows whose fingerprints differ in at most radius bits, enough of them for the components.

    A row is named by (doc_id, mark of its text); rows without doc_id take no part. Null text counts as empty.
    """
    marked = materialise(fingerprints(docs.filter("doc_id is not null"), width, text_mark(F.col("text")).alias("mark")).select("fp", F.struct("doc_id", "mark").alias("node")))
    distinct = materialise(marked.groupBy("fp").agg(F.min("node").alias("least")))
    equal = marked.join(distinct, "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    end = lambda x: distinct.select(F.col("fp").alias(f"fp_{x}"), F.col("least").alias(x))
    close = linked(distinct.select("fp"), radius).toDF("fp_a", "fp_b").join(end("a"), "fp_a").join(end("b"), "fp_b").select("a", "b")
    return equal.unionByName(close).distinct()


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of near copies the row with the smallest doc_id stays.

    Near copies are what the fingerprints link, as in near_dups: vantage-point shards find every pair within two bits.
    Copies that share 0.8 of their five-word shingles but lie farther apart (about a quarter of the bits, where vantage
    points rule out nothing) are linked as well, by keys of shingles and an exact comparison; rows reached by links of either kind are one group.
    It is decided for each row, not for each doc_id: rows that share an id but not a text are told apart, and of rows
    with the same id and text one stays. Rows without doc_id stay. Null and empty texts are copies of each other; all
    columns stay as they are, whatever their names; an empty table gives an empty result; texts are compared whole.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), row)
    gone = near_copies(docs, row_links(docs)).filter("node <> root").select("node.doc_id", "node.mark")
    kept = marked.join(gone, ["doc_id", "mark"], "left_anti")
    twice = marked.filter("doc_id is not null").groupBy("doc_id", "mark").count().filter("count > 1")
    if not twice.isEmpty():
        kept = kept.filter("doc_id is not null").dropDuplicates(["doc_id", "mark"]).unionByName(kept.filter("doc_id is null"))
    return kept.select("row.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash}
ORACLE: dict[str, str] = {}
