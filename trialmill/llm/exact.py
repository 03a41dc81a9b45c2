"""Exact deduplication by salted combining; full content is compared wherever groups form.

1. Locally: each map task folds its rows by (digest, content, salt), the partial aggregation of stage 2.
2. Salted: one winner for each (digest, content, salt), so a group of copies is spread over SALTS tasks.
3. Globally: at most SALTS winners of a content meet and give its keeper and group size.
The way back to the documents goes by (digest, salt). Should two contents ever share a digest, rows of that digest go
back by their content instead.

The pipeline's stage keeps whole rows. There digests are counted first, in the same steps, and shuffled once with their
rows; only rows whose digest others have too go through the steps above, with their content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, id_text, materialise, table

#: Tasks over which one content's copies are spread.
SALTS = 64


def content(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text, WHITE, "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def _salted(docs: DataFrame, digest: Callable[[Column], Column], salts: int, *more: Column) -> DataFrame:
    """docs' doc_id, content, code points and digest; the salt comes from the row itself, so it is the same whenever the row is read."""
    salt = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(salts)).cast("int").alias("salt")
    given = id_text(docs, *more)
    rest = [c for c in given.columns if c not in ("doc_id", "text")]
    return given.select("doc_id", content(F.col("text")).alias("norm"), F.length("text").alias("points"), salt, *rest).withColumn("digest", digest(F.col("norm")))


def _winners(salted: DataFrame) -> DataFrame:
    """(digest, norm, win, size, salts): the best row of each content, as (points, ~doc_id), its copies and the salts they have."""
    # The bitwise complement turns the order of ids round and has no overflow; a missing id loses against any other.
    best = F.max(F.struct(F.col("points"), F.bitwise_not("doc_id").alias("back"))).alias("win")
    by_salt = salted.groupBy("digest", "salt", "norm").agg(best, F.count(F.lit(1)).alias("size"))
    return by_salt.groupBy("digest", "norm").agg(F.max("win").alias("win"), F.sum("size").alias("size"), F.collect_set("salt").alias("salts"))


def _collides(named: DataFrame) -> bool:
    """Whether two contents share a digest; never seen with SHA-256."""
    return not named.groupBy("digest").count().filter("count > 1").isEmpty()


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    Texts are equal when they are identical without white space; null counts as empty. Of equal texts the row with the
    most code points stays, then the smallest doc_id. Rows that repeat a doc_id count each and get a row each; a row
    with null doc_id stays only if its group holds no other of its length. An empty table gives an empty result; other
    columns are ignored; texts of any length are compared whole. digest may be weakened in tests: contents that share a
    digest are still told apart.
    """
    salted = _salted(docs, digest, salts)
    whole = _winners(salted)
    keep = F.bitwise_not("win.back").alias("keep_id")
    named = materialise(whole.select("digest", keep, F.col("size").alias("group_size"), "salts"))
    if _collides(named):
        # The content itself decides here.
        exact = whole.select("digest", "norm", keep, F.col("size").alias("group_size"))
        out = salted.join(exact, ["digest", "norm"]).select("doc_id", "keep_id", "group_size", sha256(F.col("norm")).alias("text_sha256"))
    else:
        # A row for each salt that a content has: a hot digest meets its rows in as many tasks.
        spread = named.select("digest", F.explode("salts").alias("salt"), "keep_id", "group_size")
        out = salted.select("doc_id", "digest", "salt").join(spread, ["digest", "salt"]).select("doc_id", "keep_id", "group_size", F.col("digest").alias("text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """Pipeline stage: of the rows whose texts are equal without white space one stays, all others go.

    It is decided for each row, not for each doc_id: the row with the most code points, then the smallest doc_id, then
    the largest hash of all its columns; identical rows collapse into one. A row without id stays only if its group has
    no other of its length. Null and empty texts are one group. All columns stay as they are, whatever their names; an
    empty table gives an empty result; texts of any length are compared whole. Digests are counted first: one that a
    single row has stands for a content of its own, so only rows that share theirs are shuffled again, by their content.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = _salted(docs.select("doc_id", "text", row), digest, salts, F.col("row")).select("digest", "salt", "row")
    by_salt = rows.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("size"))
    by_digest = by_salt.groupBy("digest").agg(F.sum("size").alias("size"), F.collect_set("salt").alias("salts"))
    # Both uses take the same columns of rows, so that rows are shuffled once; all else comes from the row again.
    met = rows.join(by_digest.select("digest", F.explode("salts").alias("salt"), "size"), ["digest", "salt"])
    alone = met.filter("size = 1").select("row")
    shared = id_text(met.filter("size > 1").select("row.doc_id", "row.text", "digest", "salt", "row"), "digest", "salt", "row")
    rank = F.struct(F.length("text").alias("points"), F.bitwise_not("doc_id").alias("back"), F.xxhash64("row.*").alias("mark")).alias("rank")
    best = shared.select("digest", "salt", content(F.col("text")).alias("norm"), rank, "row")
    for keys in (("digest", "salt", "norm"), ("digest", "norm")):
        best = best.groupBy(*keys).agg(F.max("rank").alias("rank"), F.max_by("row", "rank").alias("row"))
    return alone.union(best.select("row")).select("row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLE = {
    "op3_exact_dedup": """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body,
         translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(body) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
"""
}
