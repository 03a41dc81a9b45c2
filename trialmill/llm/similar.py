"""Near copies by five-word shingles: candidates by banded minima, exact Jaccard similarity, components.

Texts at a Jaccard similarity s agree in the least shingle under a random order with probability s. A key is made of
ROWS such minima and each text has BANDS keys, so a pair at the similarity 0.8 shares no key in 6 of 100,000 cases.
Every member of a key is first compared with the key's smallest document; what this joins is one component, so a large
group of copies never makes all its pairs. Members of a large key that still lie in several components are compared
with another member that the key draws, as long as this joins any number of them; each such round takes as many
comparisons as there are members. At the end every pair of a key that still lies in two components is decided: pairs of
small keys one by one, those of large keys in blocks, where sketches rule out what is far from similar and shingles
decide the rest before a pair leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, id_text, materialise, mix, powers, stored, white_mask
from .components import components

#: Words of a shingle, and the Jaccard similarity from which documents are near copies.
WIDTH, LEAST = 5, 0.8
#: Keys of a text and minima of a key.
BANDS, ROWS = 32, 6
#: Members of a key up to which its pairs are compared one by one, and members of a block of a larger key.
SMALL, BLOCK = 32, 1024
#: Rounds with drawn members at most; a round that joins less than this share of its pairs is the last.
ROUNDS, JOINED = 6, 0.02
#: Minima that have to agree in one byte, of BANDS * ROWS: at the similarity LEAST fewer do in one of a million cases.
AGREE = 126
#: Shingles up to which a text's go into the blocks; pairs with longer texts are decided outside.
SHINGLES = 20_000

_BASE = 0xA0761D6478BD642F
_ORDERS = np.random.default_rng(11).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts and where each text's begin; a shorter text is one shingle, one without words the shingle zero."""
    words = Words(texts, white_mask())
    n = np.diff(words.first)
    count = np.maximum(n - WIDTH + 1, 1)
    first = np.concatenate(([0], np.cumsum(count)))
    of = np.repeat(np.arange(len(texts)), count)
    at = words.first[of] + np.arange(first[-1]) - first[of]
    hashes = np.concatenate((words.hashes(), np.zeros(WIDTH, dtype=np.uint64)))
    p, total = powers(_BASE, WIDTH + 1), np.zeros(len(at), dtype=np.uint64)
    for k in range(WIDTH):
        total += np.where(k < n[of], hashes[np.minimum(at + k, len(hashes) - 1)], np.uint64(0)) * p[k + 1]
    return mix(total), first


def keys(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each text, a row each, and a byte of each of its minima."""
    out, sketch = np.zeros((len(first) - 1, BANDS), dtype=np.uint64), np.zeros((len(first) - 1, BANDS * ROWS), dtype=np.uint8)
    for i in range(BANDS * ROWS):
        low = mix(np.minimum.reduceat((grams ^ _ORDERS[0, i]) * _ORDERS[1, i], first[:-1]) + np.uint64(i))
        out[:, i // ROWS] = mix(out[:, i // ROWS] + low)
        sketch[:, i] = low >> np.uint64(56)
    return out, sketch


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct shingles."""
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def text_mark(text: Column) -> Column:
    """Tells the texts of rows with the same id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose texts are at least LEAST similar."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets: dict[str, np.ndarray] = {}
            good = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                for t in (x, y):
                    if t not in sets:
                        sets[t] = np.unique(shingles([_bytes(t)])[0])
                small, large = sorted((len(sets[x]), len(sets[y])))
                good.append(small / large >= LEAST and similarity(sets[x], sets[y]) >= LEAST)
            yield batch.loc[good, ["a_id", "a_mark", "b_id", "b_mark"]]

    side = lambda key, text: texts.select(F.col("node").alias(key), F.col("text").alias(text))
    flat = [F.col(f"{x}.{y}").alias(f"{x}_{z}") for x in "ab" for y, z in (("doc_id", "id"), ("mark", "mark"))]
    faced = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select(*flat, "x", "y")
    good = faced.mapInPandas(each, "a_id long, a_mark long, b_id long, b_mark long")
    packed = lambda x: F.struct(F.col(f"{x}_id").alias("doc_id"), F.col(f"{x}_mark").alias("mark")).alias(x)
    return good.select(packed("a"), packed("b")).distinct()


def near_copies(docs: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(node, root): each row that links of similar texts join to others, and the smallest that they reach.

    links: pairs (a, b) of rows that are known to belong together, such as those of near fingerprints; they count as they
    are, and what they join is not compared again beyond the first round.
    A row is named by (doc_id, mark of its text), so rows that share an id but not a text are told apart. Null text counts
    as empty; texts without words are copies of each other; rows without doc_id take no part.
    """
    given = id_text(docs).filter("doc_id is not null").withColumn("mark", text_mark(F.col("text")))

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, own, texts = b["doc_id"].to_numpy(), b["mark"].to_numpy(), [_bytes(t) for t in b["text"]]
            for begin, end in chunks(texts):
                held, sketch = keys(*shingles(texts[begin:end]))
                yield pd.DataFrame({"doc_id": ids[begin:end], "mark": own[begin:end], "keys": list(held.view(np.int64)), "sketch": [s.tobytes() for s in sketch]})

    node = F.struct("doc_id", "mark").alias("node")
    marked = stored(given.mapInPandas(marks, "doc_id long, mark long, keys array<long>, sketch binary"))
    placed = marked.select(node, F.explode("keys").alias("key"))
    shared = placed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("key", "least")
    members = materialise(placed.join(shared, "key").select("key", "node", "least"))
    texts = stored(given.select(node, "text").join(members.select("node").distinct(), "node").dropDuplicates(["node"]))
    near = materialise(members.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    sure = materialise(_verified(near, texts) if links is None else _verified(near, texts).unionByName(links))
    done, joined = near, True
    for n in range(ROUNDS + 1):
        known = components(sure).withColumnRenamed("node", "member")
        rooted = members.join(known, F.col("node") == F.col("member"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high")
        left = materialise(rooted.join(mixed.select("key", "n"), "key"))
        large = left.filter(F.col("n") > SMALL)
        if n == ROUNDS or not joined or large.isEmpty():
            break
        # Keys that name one group draw different members of it.
        draw = F.min_by(F.struct("node", "root"), F.xxhash64("node", "key", F.lit(n))).alias("centre")
        faced = large.join(large.groupBy("key").agg(draw), "key").filter("root <> centre.root")
        new = materialise(faced.select(F.greatest("node", "centre.node").alias("a"), F.least("node", "centre.node").alias("b")).distinct().join(done, ["a", "b"], "left_anti"))
        found = materialise(_verified(new, texts))
        done, sure = done.unionByName(new), materialise(sure.unionByName(found))
        joined = found.count() > JOINED * new.count()
    small = left.filter(F.col("n") <= SMALL).select("key", "node", "root")
    facing = small.alias("s").join(small.alias("t"), F.expr("s.key = t.key and s.node < t.node and s.root <> t.root"))
    rest = facing.select(F.col("t.node").alias("a"), F.col("s.node").alias("b"))
    near_enough = _agreeing(large, marked.select(node, "sketch").dropDuplicates(["node"]), texts)
    rest = rest.unionByName(near_enough.filter("not sure").select("a", "b")).distinct().join(done, ["a", "b"], "left_anti")
    return components(sure.unionByName(near_enough.filter("sure").select("a", "b")).unionByName(_verified(rest, texts)))


def _agreeing(large: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, node, root, n) -> pairs (a, b, sure) of nodes of a key in different components: those that are similar, and those not decided here.

    The n members of a key are dealt to blocks; a task has two blocks, or one against itself, so however large a key is
    no task holds more than two blocks of it.
    """

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [np.unique(shingles([_bytes(t)])[0]) for t in b["text"]]
            yield b[["id", "mark", "sketch"]].assign(grams=[None if len(s) > SHINGLES else s.tobytes() for s in sets])

    flat = [F.col("node.doc_id").alias("id"), F.col("node.mark").alias("mark")]
    held = large.select("node").distinct().join(sketches, "node").join(texts, "node").select(*flat, "sketch", "text")
    held = stored(held.mapInPandas(shingled, "id long, mark long, sketch binary, grams binary"))
    blocks = F.ceil(F.col("n") / BLOCK)
    members = large.select("key", *flat, F.xxhash64("root").alias("root"), F.pmod(F.xxhash64("node"), blocks).alias("own"), blocks.alias("blocks"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).join(held, ["id", "mark"])

    def compare(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        _, low, high = key
        sketch = np.frombuffer(b"".join(b["sketch"]), dtype=np.uint8).reshape(len(b), -1)
        grams = [None if g is None else np.frombuffer(g, dtype=np.uint64) for g in b["grams"]]
        size = np.array([0 if g is None else len(g) for g in grams])
        root, own = b["root"].to_numpy(), b["own"].to_numpy()
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        found: list[tuple[int, int, bool]] = []
        for i in range(0, len(left), 64):
            rows = left[i : i + 64]
            near = (sketch[rows][:, None, :] == sketch[right][None, :, :]).sum(axis=2) >= AGREE
            near &= root[rows][:, None] != root[right][None, :]
            if low == high:
                near &= rows[:, None] < right[None, :]
            for x, y in zip(*(f.tolist() for f in np.nonzero(near)), strict=True):
                x, y = rows[x], right[y]
                if not size[x] or not size[y]:
                    found.append((x, y, False))
                elif min(size[x], size[y]) >= LEAST * max(size[x], size[y]) and similarity(grams[x], grams[y]) >= LEAST:
                    found.append((x, y, True))
        x, y = (np.array([f[k] for f in found], dtype=np.int64) for k in (0, 1))
        ids, marks = b["id"].to_numpy(), b["mark"].to_numpy()
        return pd.DataFrame({"x_id": ids[x], "x_mark": marks[x], "y_id": ids[y], "y_mark": marks[y], "sure": np.array([f[2] for f in found], dtype=bool)})

    pairs = dealt.groupBy("key", "low", "high").applyInPandas(compare, "x_id long, x_mark long, y_id long, y_mark long, sure boolean")
    x, y = (F.struct(F.col(f"{c}_id").alias("doc_id"), F.col(f"{c}_mark").alias("mark")) for c in "xy")
    return stored(pairs.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"), "sure").distinct())
