"""Product quantisation of vectors in whole numbers.

Vectors are cut into parts, each part has a codebook, and a vector's code names the nearest entry for each of its parts.
Distances are first screened by products of float32 matrices. Every screened distance comes with an interval that the
rounding errors cannot leave; entries whose interval overlaps the best are evaluated again in int64, where ties go to the
lower index. So codes are those of whole-number arithmetic, whatever a machine's matrix product does in which order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: What components are multiplied by, equal parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows that one matrix product takes, and tasks over which the rows of one label meet their sum.
BLOCK, SALTS = 4096, 16
#: Relative rounding errors of float32 and float64.
U32, U64 = 2.0**-24, 2.0**-53


def _of_one_length(lengths: np.ndarray) -> None:
    sizes = np.unique(lengths)
    if len(sizes) > 1 or (len(sizes) and sizes[0] % PARTS):
        raise ValueError(f"vectors need one length, a multiple of {PARTS}, not {sizes.tolist()}")


def whole_numbers(lists: pa.ListArray, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their components as floor(SCALE * x)); a row is kept if it has components and all are there and finite. length: that of all
    vectors, if known."""
    lengths = np.diff(lists.offsets.to_numpy())
    valid = ~np.asarray(lists.is_null()) & (lengths > 0)
    flat = lists.flatten()  # without the components of null rows
    x = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64)
    lengths = np.where(valid, lengths, 0)
    bad = np.flatnonzero(~np.isfinite(x))
    ends = np.cumsum(lengths)
    valid[np.searchsorted(ends, bad, side="right")] = False
    _of_one_length(np.append(lengths[valid], length or []))
    x = np.floor(x[np.repeat(valid, lengths)] * SCALE).reshape(int(valid.sum()), length or int(lengths[valid].max(initial=0)))
    if x.size and 4.0 * np.abs(x).max() ** 2 * x.shape[1] >= 2.0**63:
        raise ValueError("components are so large that squared distances don't fit a long")
    return valid, x.astype(np.int64)


def screened(x: np.ndarray, entries: np.ndarray, product: Callable = np.matmul) -> np.ndarray:
    """Which entries may be nearest to each row of x: those whose interval overlaps the best.

    The squared distance, less the row's own square, is |c|^2 - 2 x.c. A float32 product of m pairs, its two conversions
    included, is off by at most g |x||c| with g = (m + 2) u / (1 - (m + 2) u), in whatever order it is summed; the rest is done in
    float64, whose errors are bounded in the same way.
    """
    m = x.shape[1]
    g32, g64 = ((m + k) * u / (1 - (m + k) * u) for k, u in ((2, U32), (4, U64)))
    xf, cf = x.astype(np.float64), entries.astype(np.float64)
    squares, length = (cf * cf).sum(axis=1), np.sqrt((xf * xf).sum(axis=1)) * (1 + 2 * g64)
    norms = np.sqrt(squares) * (1 + 2 * g64)
    middle = squares - 2.0 * product(x.astype(np.float32), entries.astype(np.float32).T).astype(np.float64)
    cross = length[:, None] * norms
    radius = (2 * g32 * cross + 2 * g64 * (squares + 2 * (1 + g32) * cross)) * (1 + 8 * U64)
    return middle - radius <= (middle + radius).min(axis=1)[:, None]


def nearest(x: np.ndarray, entries: np.ndarray, product: Callable = np.matmul) -> np.ndarray:
    """The index of the nearest entry for each row, the lower one of equals."""
    out = np.empty(len(x), dtype=np.int64)
    for begin in range(0, len(x), BLOCK):
        part = x[begin : begin + BLOCK]
        open_ = screened(part, entries, product)
        best = np.argmax(open_, axis=1)
        rows = np.flatnonzero(open_.sum(axis=1) > 1)
        if len(rows):
            row, entry = np.nonzero(open_[rows])
            d = part[rows[row]] - entries[entry]
            exact = np.full((len(rows), len(entries)), np.iinfo(np.int64).max)
            exact[row, entry] = np.einsum("ij,ij->i", d, d)
            best[rows] = np.argmin(exact, axis=1)
        out[begin : begin + BLOCK] = best
    return out


def _assigned(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(rows, PARTS) indexes; books: (PARTS, entries, positions)."""
    m = books.shape[2]
    return np.stack([nearest(x[:, i * m : (i + 1) * m], books[i]) for i in range(PARTS)], axis=1) if len(x) else np.empty((0, PARTS), dtype=np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], step: int = BLOCK) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for begin in range(0, b.num_rows, step):
            yield b.slice(begin, step)


def first_entries(vectors: DataFrame, entries: int = ENTRIES) -> np.ndarray | None:
    """(PARTS, entries, positions): the parts of the kept vectors with the smallest ids; null ids come last, equal ids in the order of their components."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            valid, x = whole_numbers(b["embedding"])
            ids = b["vec_id"].filter(pa.array(valid))
            key = np.asarray(ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False))
            few = np.flatnonzero(key <= np.partition(key, entries - 1)[entries - 1]) if len(key) > entries else np.arange(len(key))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(few)), pa.array(x[few].tolist(), type=pa.list_(pa.int64()))], names=["vec_id", "x"])

    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(each, "vec_id long, x array<long>").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    if not found:
        return None
    _of_one_length(np.array([len(r.x) for r in found]))
    x = np.array([r.x for r in found], dtype=np.int64).reshape(len(found), PARTS, -1)
    return x.transpose(1, 0, 2).copy()


def improved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one more round. Tasks return sums for each part and entry, which combine before and after their shuffle; the driver gets one
    number for each component of the codebooks."""
    held = vectors.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        parts, entries, m = books.shape
        total, count = np.zeros((parts, entries, m), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for b in _pieces(batches):
            _, x = whole_numbers(b["embedding"], parts * m)
            at = _assigned(x, books)
            for i in range(parts):
                mine = x[:, i * m : (i + 1) * m]
                for e in np.unique(at[:, i]):
                    total[i, e] += mine[at[:, i] == e].sum(axis=0)
                count[i] += np.bincount(at[:, i], minlength=entries)
        used = count.ravel() > 0
        # Position -1 holds the count.
        place = np.repeat(np.flatnonzero(used), m + 1)
        position = np.tile(np.arange(-1, m), int(used.sum()))
        both = np.concatenate((count.reshape(-1, 1), total.reshape(-1, m)), axis=1)[used].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(place, type=pa.int32()), pa.array(position.astype(np.int32)), pa.array(both)], names=["place", "position", "value"])

    found = vectors.select("embedding").mapInArrow(sums, "place int, position int, value long").groupBy("place", "position").agg(F.sum("value").alias("value")).collect()
    parts, entries, m = books.shape
    both = np.zeros((parts * entries, m + 1), dtype=np.int64)
    for r in found:
        both[r.place, r.position + 1] = r.value
    used = both[:, 0] > 0
    out = books.reshape(parts * entries, m).copy()
    out[used] = both[used, 1:] // both[used, :1]  # // rounds down
    held.unpersist()
    return out.reshape(books.shape)


def fingerprint(books: np.ndarray | None) -> str:
    """SHA-256 of all components, joined by commas, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist() if books is not None else [])).encode()).hexdigest()


def codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    books = first_entries(vectors)
    for _ in range(rounds if books is not None else 0):
        books = improved(vectors, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray | None) -> DataFrame:
    """(vec_id, label, code, error) for every kept vector: two hexadecimal digits for each part, and the sum of the squared distances of all parts."""
    spark = vectors.sparkSession
    label = vectors.schema["label"].dataType if "label" in vectors.columns else "int"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label") if "label" in vectors.columns else F.lit(None).cast(label).alias("label"), "embedding")
    shape = given.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    if books is None:
        return spark.createDataFrame([], shape)
    held = spark.sparkContext.broadcast(books)
    digits = np.array([f"{i:02x}" for i in range(256)], dtype=object)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        m = books.shape[2]
        for b in _pieces(batches):
            valid, x = whole_numbers(b["embedding"], PARTS * m)
            at, mask = _assigned(x, books), pa.array(valid)
            error = np.zeros(len(x), dtype=np.int64)
            for i in range(PARTS):
                d = x[:, i * m : (i + 1) * m] - books[i][at[:, i]]
                error += np.einsum("ij,ij->i", d, d)
            code = digits[at].sum(axis=1) if len(x) else np.empty(0, dtype=object)
            yield pa.RecordBatch.from_arrays([b["vec_id"].filter(mask), b["label"].filter(mask), pa.array(code, type=pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return given.mapInArrow(each, shape)


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every kept row of vectors (vec_id, embedding, label).

    Rows whose vector is null or empty or has a null, NaN or infinite component go. Codebooks start from the kept vectors with the
    smallest ids and are improved in rounds over all vectors; an entry that no part chose stays. Fewer vectors than entries give smaller codebooks. Equal
    distances go to the lower index; repeated rows count each; null ids stay null, and null labels are one label; an
    empty table gives an empty result; other columns are ignored. Vectors of different lengths, or of one that the
    parts don't divide, and components whose squared distances exceed a long, raise an error that says so.
    """
    books = codebooks(vectors, rounds)
    coded = encode(vectors, books)
    # A label may hold any share of the rows: its errors combine before their shuffle, and its sum meets the rows in SALTS tasks.
    flat = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    sums = coded.groupBy(F.col("label").alias("name")).agg(F.sum("error").alias("label_error")).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return flat.join(sums, F.col("label").eqNullSafe(F.col("name")) & (F.col("salt") == F.col("place"))).select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The same in SQL: one row for each component, rounds written out."""
    near = """SELECT vec_id, part, entry, distance FROM (
  SELECT x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS distance,
         row_number() OVER (PARTITION BY x.vec_id, x.part ORDER BY sum((x.v - b.v) * (x.v - b.v)), b.entry) AS r
  FROM x JOIN {books} b ON x.part = b.part AND x.position = b.position GROUP BY x.vec_id, x.part, b.entry) WHERE r = 1"""
    parts = [
        """SELECT vec_id, label, embedding FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0""",
        "SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // 8 AS size FROM kept",
        "SELECT vec_id, label, i // size AS part, i % size AS position, CAST(floor(4096 * CAST(e AS DOUBLE)) AS BIGINT) AS v FROM flat",
        "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 16",
        "SELECT part, entry, position, v FROM x JOIN seeds USING (vec_id)",
    ]
    ctes = [f"{n} AS MATERIALIZED ({s})" for n, s in zip(("kept", "flat", "x", "seeds", "b0"), parts, strict=True)]
    for k in range(ROUNDS):
        ctes.append(f"n{k} AS MATERIALIZED ({near.format(books=f'b{k}')})")
        moved = f"SELECT n.part, n.entry, x.position, sum(x.v) AS s, count(*) AS c FROM n{k} n JOIN x USING (vec_id, part) GROUP BY ALL"
        ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.position, CAST(coalesce((s - ((s % c) + c) % c) // c, b.v) AS BIGINT) AS v FROM b{k} b LEFT JOIN ({moved}) m ON m.part = b.part AND m.entry = b.entry AND m.position = b.position)")
    ctes.append(f"last AS MATERIALIZED ({near.format(books=f'b{ROUNDS}')})")
    ctes.append("c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error FROM last GROUP BY vec_id)")
    digest = f"(SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, position)) FROM b{ROUNDS})"
    return f"WITH {', '.join(ctes)} SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest} AS codebooks_sha256 FROM c JOIN kept USING (vec_id)"


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLE = {"op12_vector_codes": _oracle()}
