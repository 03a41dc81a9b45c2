"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in built-in functions only.

A row's place on the ring is the hash of its text, so equal texts lie together. Each shard has many virtual nodes on the
ring; a row belongs to the next one clockwise, unless its shard is full: then it continues clockwise. Shards are full at
floor(n / shards) rows or one more, so counts differ by one at most, and only what overflows moves on.

Rows are never brought together for this. The ring has a fixed number of cells; the rows of each arc (the cells before a
virtual node) are counted, and where whole arcs and their overflow go is worked out on these counts. It becomes a
short list of rank intervals for each arc, in which every row looks up its rank. Ranks come from counts of
units, parts of cells of bounded size, so a text that a third of all rows share is ranked in as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

#: Shards, virtual nodes of each, log2 of the ring's cells, and rows that one task ranks at once.
SHARDS, NODES, RING_BITS, UNIT_ROWS = 40, 64, 16, 10_000
#: Bytes that every row counts besides its text.
OVERHEAD = 16
LAW = "rows"


def ring(spark: SparkSession, shards: int = SHARDS, nodes: int = NODES, bits: int = RING_BITS) -> DataFrame:
    """(arc, last, shard): the arcs of the ring by their last cells, where virtual nodes lie; nodes that share a cell belong to the smallest shard."""
    each = spark.range(shards * nodes).select((F.col("id") % shards).cast("int").alias("shard"), "id")
    last = F.shiftrightunsigned(F.xxhash64(F.lit("virtual node"), "shard", "id"), 64 - bits).alias("last")
    owned = each.groupBy(last).agg(F.min("shard").alias("shard"))
    return owned.select((F.row_number().over(W.orderBy("last")) - 1).alias("arc"), "last", "shard")


def cells_of(arcs: DataFrame, bits: int = RING_BITS) -> DataFrame:
    """(cell, arc, place) for every cell of the ring; cells behind the last node are the beginning of the first arc. place orders the cells of an arc."""
    cells = arcs.sparkSession.range(2**bits).withColumnRenamed("id", "cell")
    known = cells.join(arcs, F.col("cell") == F.col("last"), "left")
    next_ = F.last("arc", True).over(W.orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, 0))
    return known.select("cell", F.coalesce(next_, F.lit(0)).alias("arc"), F.when(next_.isNull(), F.col("cell") - 2**bits).otherwise(F.col("cell")).alias("place"))


def spread(counts: list[int], owners: list[int], shards: int = SHARDS) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): which ranks of each arc go where.

    counts and owners: rows and shard of each arc in ring order. All arcs offer their rows to their own shard first; what
    a full shard leaves goes on to the next virtual node clockwise, again and again. In each turn arcs come in ring order.
    """
    total, n = sum(counts), len(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, out = [0] * shards, []
    waiting = [(arc, 0, counts[arc]) for arc in range(n) if counts[arc]]
    turn = 0
    while waiting:
        left = []
        for arc, begin, end in waiting:
            shard = owners[(arc + turn) % n]
            taken = min(end - begin, room[shard] - filled[shard])
            if taken:
                out.append((arc, begin, begin + taken, shard, filled[shard]))
                filled[shard] += taken
            if begin + taken < end:
                left.append((arc, begin + taken, end))
        waiting, turn = left, turn + 1
        if turn > n:  # a ring may lack nodes of a shard that still has room
            for shard in range(shards):
                while waiting and room[shard] > filled[shard]:
                    arc, begin, end = waiting.pop()
                    taken = min(end - begin, room[shard] - filled[shard])
                    out.append((arc, begin, begin + taken, shard, filled[shard]))
                    filled[shard] += taken
                    if begin + taken < end:
                        waiting.append((arc, begin + taken, end))
    return out


def _whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def assign(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, unit_rows: int = UNIT_ROWS, bits: int = RING_BITS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of docs.

    size: bytes of the text in UTF-8 plus OVERHEAD; law is `rows`: the shards' counts differ by one at most; slots of each
    shard start at 0 without gaps; grown_shard is null under this law. Null texts are empty; rows that repeat count
    each; null ids stay null; an empty table gives an empty result; other columns are ignored. Equal texts share a place on the
    ring and a shard, unless that is full: then the rest of them continues clockwise like any other rows. Texts are read
    once, for their hash, size and checksum; long ones cost no more memory than the row itself.
    """
    spark = docs.sparkSession
    text = _whole(F.col("text"))
    # Rows of one cell are dealt to units by a mark of their own, which lasts, as it is written.
    mark = F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("mark")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("spot"), mark)
    rows = stored(given.withColumn("cell", F.shiftrightunsigned("spot", 64 - bits)))
    arcs = stored(ring(spark, shards, nodes, bits))
    owners = [r.shard for r in arcs.orderBy("arc").collect()]
    # A row for each cell of the ring and each arc: both are of fixed size, whatever the input.
    cells = stored(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(cells_of(arcs, bits)), "cell").withColumn("units", F.ceil(F.col("n") / unit_rows)))
    counts = dict.fromkeys(range(len(owners)), 0) | {r.arc: r.n for r in cells.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    plan = ",".join(f"[{','.join(map(str, p))}]" for p in sorted(spread([counts[k] for k in range(len(owners))], owners, shards)))
    steps = spark.range(1).select(F.explode(F.from_json(F.lit(f"[{plan}]"), "array<array<long>>")).alias("s"))
    step = F.struct(*(F.col("s")[k].alias(f) for k, f in enumerate(("begin", "end", "to", "slot"), 1)))
    moves = stored(steps.groupBy(F.col("s")[0].cast("int").alias("arc")).agg(F.array_sort(F.collect_list(step)).alias("moves")))

    in_units = rows.join(F.broadcast(cells.select("cell", "arc", "place", "units")), "cell").withColumn("unit", F.pmod("mark", "units"))
    sizes = in_units.groupBy("arc", "place", "cell", "unit").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("arc").orderBy("place", "unit").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("cell", "unit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = in_units.withColumn("own", F.row_number().over(W.partitionBy("cell", "unit").orderBy("spot", "mark")) - 1)
    placed = ranked.join(starts, ["cell", "unit"]).withColumn("rank", F.col("start") + F.col("own")).join(F.broadcast(moves), "arc")
    move = F.element_at(F.filter("moves", lambda m: m["end"] > F.col("rank")), 1)
    slot = (F.col("move.slot") + F.col("rank") - F.col("move.begin")).alias("slot")
    return placed.withColumn("move", move).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("move.to").cast("int").alias("shard"), slot, F.lit(None).cast("int").alias("grown_shard"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


QUERIES = {"op13_sharding": op13_sharding}
#: The ring's hash and the passing on of overflow have no SQL; tests compare with a brute-force version.
ORACLE: dict[str, str] = {}
