"""Helpers that several operators share: shared-folder checkpoints, column hygiene, batch tokenising."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: a blank and the characters 9 to 13.
WHITE = " \t\n\x0b\x0c\r"
#: Bytes of text that one vectorised step takes; a longer text forms a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder the cluster names; a temporary one only where none is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of a bulky table: compressed Parquet in the folder of the checkpoints."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        materialise(df.limit(0))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_text(df: DataFrame, *more: str) -> DataFrame:
    """Only doc_id and text (null: empty) and the named columns, whatever else the table holds."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def chunks(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about limit bytes."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def slices(text: bytes, splits: np.ndarray, limit: int = STEP_BYTES) -> list[bytes]:
    """A text in parts of about limit bytes that are cut between words; a longer word stays in one part."""
    parts, begin = [], 0
    while len(text) - begin > limit:
        size, cut = limit, np.empty(0, dtype=np.int64)
        while not len(cut) and begin + size < len(text):
            cut = np.flatnonzero(splits[np.frombuffer(text, dtype=np.uint8, count=min(size, len(text) - begin), offset=begin)])
            size *= 2
        if not len(cut):
            break
        end = begin + int(cut[np.searchsorted(cut, limit, side="right") - 1] if cut[0] <= limit else cut[0]) + 1
        parts.append(text[begin:end])
        begin = end
    return [*parts, text[begin:]]


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 12), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 1 << 23:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of MurmurHash3 on 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def white_mask() -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[[ord(c) for c in WHITE]] = True
    return mask


def word_mask() -> np.ndarray:
    """Everything that is no ASCII letter or digit and no part of a longer character splits words."""
    mask = np.ones(256, dtype=bool)
    mask[128:] = False
    for a, b in ((48, 58), (65, 91), (97, 123)):
        mask[a:b] = False
    return mask


class Words:
    """The words of a run of texts as arrays: byte ranges, 64-bit hashes and the first word of each text."""

    def __init__(self, texts: list[bytes], splits: np.ndarray):
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, dtype=np.uint8)
        gap = splits[raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        if len(self.start) > len(self.end):
            self.start = self.start[: len(self.end)]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.text_at = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.start, self.text_at)
        self._raw = raw

    def hashes(self) -> np.ndarray:
        n = len(self._raw)
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((self._raw.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * powers(_INVERSE, n)[self.start])
