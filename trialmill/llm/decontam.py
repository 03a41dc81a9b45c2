"""Benchmark decontamination by spaced seeds.

Fixed masks ignore some positions of a short run of tokens. The hashes of what remains are made for every position of
the test items and of the documents; a filter of fixed size first rules out almost all document positions, then the two
hash tables are joined in Spark, and every hit is verified on its diagonal by comparing tokens, which tolerates
substituted words. A hit carries the tokens within the reach of a window and no more; hits of one text that look
alike as far as that are one, so a text that repeats itself has few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, Words, chunks, materialise, mix, powers, slices, table, word_mask

#: Masks over consecutive tokens: 1 is compared, 0 is ignored.
MASKS = ("111010011", "110101101", "101100111", "111111")
#: More masks for items of so many tokens: with them some mask hits whatever tokens of the item SHARE lets differ.
SHORT = {
    **{k: ("1" * k,) for k in range(1, 5)}, 5: ("1111", "11101", "11011", "10111"), 6: ("1111", "11011"), 7: ("11111", "111011", "110111"),
    8: ("1111011", "1101111"), 10: ("1110101", "11111"), 11: ("1111011",), 15: ("11110101",),
}
#: A hit is confirmed when this many aligned tokens (all of a shorter item) agree in this share, which for less than five means all; items with fewer than LEAST tokens are no evidence.
WINDOW, SHARE, LEAST = 16, 0.8, 1
#: log2 of the bits of the filter, two for each seed. Its size is fixed; a very large benchmark only makes it less selective.
FILTER_BITS = 26
#: Tokens kept on either side of a hit: a window that holds the hit reaches no farther.
REACH = WINDOW - 1
#: Tokens whose seeds are made at once, hits that are handed on at once, and tasks over which the hits of one seed are spread.
BLOCK, HITS, SALTS = 1 << 18, 20_000, 8

_MASK_BASE, _NEAR_BASE = 0xD1B54A32D192ED03, 0x8BB84B93962EACC9


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each position's masked run; positions without a whole run are left out."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    p = powers(_MASK_BASE, len(mask) + 1)
    for i, c in enumerate(mask):
        if c == "1":
            total += hashes[i : i + n] * p[i + 1]
    return mix(total + np.uint64(int(mask, 2)))


def masks_for(lengths: list[int]) -> tuple[str, ...]:
    """The fixed masks, and those for items of these lengths."""
    return tuple(dict.fromkeys((*MASKS, *(m for k in sorted(set(lengths)) for m in SHORT.get(k, ())))))


def token_hashes(text: str) -> np.ndarray:
    return Words([text.lower().encode("utf-8", "surrogatepass")], word_mask()).hashes()


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h >> np.uint64(64 - bits), (h >> np.uint64(2)) & np.uint64(2**bits - 1)


def token_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of a run of texts, and the first token of each text and the end of the last; long texts are hashed in slices."""
    split, parts, sizes = word_mask(), [], []
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    for begin, end in chunks(raw):
        if end - begin == 1:
            each = [Words([p], split).hashes() for p in slices(raw[begin], split, STEP_BYTES // 4)]
            parts += each
            sizes.append(sum(map(len, each)))
        else:
            words = Words(raw[begin:end], split)
            parts.append(words.hashes())
            sizes += np.diff(np.append(words.first[: end - begin], len(words.start))).tolist()
    return np.concatenate([np.empty(0, dtype=np.uint64), *parts]), np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64))))


def neighbourhoods(h: np.ndarray, first: np.ndarray, at: np.ndarray, of: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of tokens within reach of each hit in its text."""
    return np.maximum(first[of], at - REACH), np.minimum(first[of + 1], at + spans + REACH)


def as_lists(h: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.ListArray:
    """The tokens of each range."""
    ends = np.concatenate(([0], np.cumsum(high - low)))
    places = np.repeat(low - ends[:-1], high - low) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h[places].view(np.int64)))


def unlike(h: np.ndarray, at: np.ndarray, of: np.ndarray, seed: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The first of all hits of a text that have one seed and the same tokens around it, in order."""
    p = powers(_NEAR_BASE, len(h) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((h + np.uint64(1)) * p[: len(h)], dtype=np.uint64)))
    # Compared as if all ranges began at one place.
    near = mix((sums[high] - sums[low]) * powers(pow(_NEAR_BASE, -1, 1 << 64), len(h) + 1)[low])
    key = mix(near + seed * np.uint64(_MASK_BASE) + (at - low).astype(np.uint64) * np.uint64(977) + (high - at).astype(np.uint64))
    order = np.lexsort((at, key, of))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (of[order][1:] != of[order][:-1])
    return np.sort(order[new])


def best_window(doc: np.ndarray, lead: int, item: np.ndarray, item_lead: int, item_at: int, item_size: int, span: int) -> tuple[int, int, int]:
    """Tokens around a hit in a text and in an item, whose runs of span tokens begin at lead and item_lead.

    Returns the most agreeing tokens of any window that holds the run and lies in the item, the window's length, and
    its first token counted from the hit. A window may hang over an end of the text, where nothing agrees.
    """
    size = min(item_size, WINDOW)
    low, high = max(0, item_at + span - size), min(item_at, item_size - size)
    at = np.arange(low, high + size) - item_at  # from the hit
    there = at + lead
    inside = (there >= 0) & (there < len(doc))
    same = np.zeros(len(at), dtype=np.int64)
    same[inside] = doc[there[inside]] == item[at[inside] + item_lead]
    sums = np.concatenate(([0], np.cumsum(same)))
    runs = sums[size:] - sums[:-size]
    k = int(np.argmax(runs))
    return int(runs[k]), size, int(at[k])


def _overlaps(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(key, item_id, token_at, n_same, n_compared) for docs (key, text): a row for each key and item that overlap, with the best window."""
    spark = docs.sparkSession
    items = bench.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": np.unique(np.minimum(np.diff(token_runs(b["text"].tolist())[1]), WINDOW))})

    masks = masks_for([r.n for r in items.select("text").mapInPandas(sizes, "n long").distinct().collect()])

    def found_seeds(h: np.ndarray, first: np.ndarray, passes=None) -> tuple[np.ndarray, ...]:
        """(at, text, span, mask, seed) of the runs that lie in one text and pass."""
        parts = [[np.empty(0, dtype=np.int64)] * 4 + [np.empty(0, dtype=np.uint64)]]
        for begin in range(0, len(h), BLOCK):
            for k, m in enumerate(masks):
                s = seeds(h[begin : begin + BLOCK + len(m) - 1], m)
                at = np.arange(len(s)) if passes is None else passes(s)
                s, at = s[at], at + begin
                of = np.searchsorted(first, at, side="right") - 1
                own = at + len(m) <= first[of + 1]
                parts.append([at[own], of[own], np.full(own.sum(), len(m)), np.full(own.sum(), k), s[own]])
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, first = token_runs(b["text"].to_pylist())
            at, of, spans, kinds, seed = found_seeds(h, first)
            lengths = np.diff(first)[of]
            # The other masks are for the items of just their lengths.
            right = np.array([masks[k] in MASKS or masks[k] in SHORT.get(int(n), ()) for k, n in zip(kinds, lengths, strict=True)], dtype=bool) & (lengths >= LEAST)
            at, of, spans, seed = at[right], of[right], spans[right], seed[right]
            low, high = neighbourhoods(h, first, at, of, spans)
            for x in range(0, len(at), HITS):
                s = slice(x, x + HITS)
                columns = [pa.array(seed[s].view(np.int64)), b["item_id"].take(pa.array(of[s])), pa.array(at[s] - first[of[s]]), pa.array((at - low)[s]), as_lists(h, low[s], high[s]), pa.array(np.diff(first)[of[s]])]
                yield pa.RecordBatch.from_arrays(columns, names=["seed", "item_id", "item_at", "item_lead", "item", "item_size"])

    seeded = materialise(items.mapInArrow(item_seeds, "seed long, item_id long, item_at long, item_lead long, item array<long>, item_size long"))
    # The filter: 2**26 bits whatever the benchmark's size, put together by an aggregation over 64-bit words.
    bit = lambda c: seeded.select(c.alias("bit"))
    low_bits = F.lit(2**FILTER_BITS - 1)
    parts = bit(F.shiftrightunsigned("seed", 64 - FILTER_BITS)).unionByName(bit(F.shiftrightunsigned("seed", 2).bitwiseAND(low_bits)))
    words = parts.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toPandas()
    flags = np.zeros(2 ** (FILTER_BITS - 6), dtype=np.uint64)
    flags[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    sieve = spark.sparkContext.broadcast(flags)  # 8 MB

    def passes(h: np.ndarray) -> np.ndarray:
        table_, one, six = sieve.value, np.uint64(63), np.uint64(6)
        a, b = _bits(h, FILTER_BITS)
        at = np.flatnonzero((table_[a >> six] >> (a & one)) & np.uint64(1))
        b = b[at]
        return at[((table_[b >> six] >> (b & one)) & np.uint64(1)).astype(bool)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, end in chunks(b["text"].to_pylist()):
                part = b.slice(begin, end - begin)
                h, first = token_runs(part["text"].to_pylist())
                at, of, spans, _, seed = found_seeds(h, first, passes)
                low, high = neighbourhoods(h, first, at, of, spans)
                keep = unlike(h, at, of, seed, low, high)
                for x in range(0, len(keep), HITS):
                    k = keep[x : x + HITS]
                    columns = [part["key"].take(pa.array(of[k])), pa.array(seed[k].view(np.int64)), pa.array(at[k] - first[of[k]]), pa.array((at - low)[k]), pa.array(spans[k]), as_lists(h, low[k], high[k])]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "seed", "at", "lead", "span", "tokens"])

    key = docs.schema["key"].dataType.simpleString()
    hits = docs.select("key", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(scan, f"key {key}, seed long, at long, lead long, span long, tokens array<long>")
    # A seed that very many texts have meets its items in several tasks. They are other tasks than those that read texts, also
    # where items are broadcast: a task that did both would hold two Python workers.
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int")).repartition("seed", "salt")
    facing = hits.join(seeded.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["seed", "salt"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tokens", "lead", "item", "item_lead", "item_at", "item_size", "span"]
        for b in batches:
            doc, item = ((b[n].offsets.to_numpy(), b[n].values.to_numpy()) for n in ("tokens", "item"))
            lead, item_lead, item_at, item_size, span = (b[n].to_numpy() for n in names[1:2] + names[3:])
            found = np.array([best_window(doc[1][doc[0][i] : doc[0][i + 1]], lead[i], item[1][item[0][i] : item[0][i + 1]], item_lead[i], item_at[i], item_size[i], span[i]) for i in range(b.num_rows)], dtype=np.int64).reshape(-1, 3)
            keep = pa.array(np.flatnonzero(found[:, 0] >= SHARE * found[:, 1]))
            columns = [b["key"].take(keep), b["item_id"].take(keep), pa.array(b["at"].to_numpy() + found[:, 2]).take(keep), pa.array(found[:, 0]).take(keep), pa.array(found[:, 1]).take(keep)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "item_id", "token_at", "n_same", "n_compared"])

    confirmed = facing.select("key", "at", "lead", "span", "tokens", "item_id", "item_at", "item_lead", "item", "item_size").mapInArrow(verify, f"key {key}, item_id long, token_at long, n_same long, n_compared long")
    best = F.max(F.struct(F.col("n_same") / F.col("n_compared"), "n_compared", (-F.col("token_at")).alias("back"), "n_same")).alias("best")
    return confirmed.groupBy("key", "item_id").agg(best).select("key", "item_id", (-F.col("best.back")).alias("token_at"), "best.n_same", "best.n_compared")


def overlaps(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, item_id, token_at, n_same, n_compared): a row for each document and benchmark item that overlap.

    Tokens are runs of ASCII letters, digits and other than ASCII characters of the lower-cased text. Each row has the
    best confirmed window: its first token in the document and how many of its n_compared tokens agree, the earliest of equals. Null or empty texts have
    no overlap; empty tables give an empty result; rows that share an id, of documents or of items, are reported as one,
    with the best window of any; rows without id and other columns are ignored. Texts of any length are read whole, in slices.
    """
    given = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("key"), "text")
    return _overlaps(given, bench).withColumnRenamed("key", "doc_id")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose text overlaps a benchmark item go.

    It is decided for each text, whatever ids rows share or lack; rows of one text share its fate. Null and empty texts
    stay. All columns stay as they are, whatever their names; an empty table gives an empty result; texts of any length are read whole.
    """
    bench = table(spark, sf_dir, "benchmark")
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    found = _overlaps(docs.select(digest.alias("key"), "text"), bench).select("key").distinct()
    # Leaks stand there once for each salt, so a text that very many rows have meets them in several tasks.
    leaks = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), digest.alias("key"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    return rows.join(leaks, ["key", "salt"], "left_anti").select("row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE: dict[str, str] = {}
