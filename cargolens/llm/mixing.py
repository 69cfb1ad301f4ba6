"""Mixing sources to target weights by Pfair scheduling.

A source's rows, in an order drawn by hash, form blocks. With weight w, block i (from 0) may run from slot floor(i / w)
on and must have run by slot ceil((i + 1) / w); among the blocks that may run, the earliest deadline goes first. So at
every slot each source has had its weight's share of blocks, less than one block more or less. Weights are the stated
numbers as exact fractions of their sum. The driver goes through the blocks, not the rows, once, with one heap entry a
source, and writes their slots in chunks. ``block`` rows make a block; the default is 16, or as many more as keep the
blocks to about two million (``BLOCKS``), so that the driver's work doesn't grow with the rows: 200,000 blocks took it 9 s
in ``local[8]``, so two million are some 90 s of serial work. All rows are scheduled either way, and the deviation from
the target stays under one block.

A source that is used up leaves its later slots empty; ``position`` numbers the rows without those gaps, by counting
each source's rows before a slot, not by sorting. Numbering rows within a source takes two steps, since a source may
hold a third of all rows: rows are numbered within hash ranges of about equal size, and ranges are offset by the sizes
of those before them.

Defined results: rows with a null source are a source of their own. Null ids and repeated rows take places like any
others; rows equal in id and source take either's place. An empty table gives no rows. A source without a stated weight
above zero is an error. ``schedule`` reads the id and source only; ``in_mixed_order`` returns the columns of the input.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from fractions import Fraction
from itertools import batched

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, cut, literal_table, read_table, shared_dir, small

BLOCK = 16
#: Blocks that the driver schedules, one more a source at most; beyond 16 times as many rows, blocks have more rows instead.
BLOCKS = 2_000_000
#: Blocks that the driver holds before it writes them.
CHUNK = 20_000
#: Rows of the order (id, source, position) that are broadcast after counting them; then texts are dealt once, else twice.
ORDER_ROWS = 500_000


def earliest_deadlines(weights: list[float], sizes: list[int], block: int) -> Iterator[tuple[int, int, int, int]]:
    """(source, block, slot, rows before it) of every block, by slot; ``sizes`` are rows by source."""
    shares = [Fraction(w) for w in weights]
    unit = math.lcm(*(w.denominator for w in shares))
    parts = [int(w * unit) for w in shares]
    total, slot, before = sum(parts), 0, 0
    waiting: list[tuple[int, int, int]] = [(0, j, 0) for j, n in enumerate(sizes) if n]  # (release, source, block)
    ready: list[tuple[int, int, int]] = []  # (deadline, source, block)
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, j, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // parts[j]), j, i))
        _, j, i = heapq.heappop(ready)
        yield j, i, slot, before
        before += min(block, sizes[j] - i * block)
        slot += 1
        if (i + 1) * block < sizes[j]:
            heapq.heappush(waiting, ((i + 1) * total // parts[j], j, i + 1))


def _numbered(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (id, source) with ``ordinal`` within the source, from 0, in the order of the ids' MD5."""
    ranges = max(1, math.ceil(total / max(1000, math.isqrt(total))))
    # Null ids can't be told apart, so they are numbered as they come instead of all falling into one range.
    drawn = F.md5(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("~"), F.monotonically_increasing_id().cast("string"))).cast("binary"))
    of = F.floor(F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long") * ranges / (1 << 32))
    rows = rows.withColumns({"drawn": drawn, "range": of})
    sizes = rows.groupBy("source", "range").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), before.alias("before"))
    within = F.row_number().over(Window.partitionBy("source", "range").orderBy("drawn", "id")) - 1
    rows = rows.withColumn("within", within)
    return rows.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range"))).select("id", "source", (F.col("before") + F.col("within")).alias("ordinal"))


def schedule(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block: int | None = None) -> DataFrame:
    """id, source, block, slot, position (from 0, gapless): one row per input row.

    ``weights``: source to weight; without it a source weighs the square root of its rows. ``block``: rows of a block; without it
    as stated above.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"))
    counted = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    names = sorted(counted, key=lambda s: (s is None, s))
    sizes, shares = [counted[s] for s in names], [weights[s] if weights else math.sqrt(counted[s]) for s in names]
    if any(w <= 0 for w in shares):
        raise ValueError("a weight must be above zero")
    block = block or max(BLOCK, -(-sum(sizes) // BLOCKS))

    plan = literal_table(spark, [(s, j) for j, s in enumerate(names)], {"p_source": dict(rows.dtypes)["source"], "p_index": "int"})
    plan = F.broadcast(plan) if len(names) <= BROADCAST_ROWS else plan
    rows = _numbered(rows, sum(sizes)).withColumn("block", F.floor(F.col("ordinal") / block))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    placed = _by_block(rows, sizes, shares, block)
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "block", "slot", (F.col("before") + F.col("ordinal") % block).alias("position"))


def _by_block(rows: DataFrame, sizes: list[int], shares: list[float], block: int) -> DataFrame:
    """``rows`` (p_index, block) with ``slot`` and ``before``, from a table of all blocks."""
    spark, names = rows.sparkSession, ("b_index", "b_block", "slot", "before")
    path = f"{shared_dir(spark)}/mixing-blocks-{uuid.uuid4().hex}"
    schema = "b_index long, b_block long, slot long, before long"
    for chunk in batched(earliest_deadlines(shares, sizes, block), CHUNK):
        literal_table(spark, list(chunk), dict.fromkeys(names, "long")).write.mode("append").parquet(path)
    blocks = spark.read.schema(schema).parquet(path) if sizes else literal_table(spark, [], dict.fromkeys(names, "long"))
    return rows.join(small(blocks), (F.col("p_index") == F.col("b_index")) & (F.col("block") == F.col("b_block")))


def in_mixed_order(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block: int | None = None, position_col: str | None = None) -> DataFrame:
    """The rows and columns of ``docs``, in the order of the mix: by range of positions over partitions, sorted within each.

    With ``position_col`` the position is also a column of that name, for readers that don't keep the order of rows.
    """
    order = schedule(docs, weights, id_col, source_col, block).select(F.col(id_col).alias("__mix_id"), F.col(source_col).alias("__mix_source"), F.col("position").alias("__mix_position"))
    # Rows that repeat an id and source share the first one's place.
    order = cut(order.groupBy("__mix_id", "__mix_source").agg(F.min("__mix_position").alias("__mix_position")), "mixing-order")
    out = docs.join(small(order, ORDER_ROWS), F.col(id_col).eqNullSafe(F.col("__mix_id")) & F.col(source_col).eqNullSafe(F.col("__mix_source")), "left")
    # Positions have no gaps, so ranges of them follow from their number, without sampling the rows.
    last, parts = order.agg(F.max("__mix_position")).first()[0] or 0, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.coalesce("__mix_position", F.lit(0)) * parts / (last + 1)).cast("int")
    return out.repartitionById(parts, part).sortWithinPartitions("__mix_position").select(*(c for c in docs.columns if c != position_col), *([F.col("__mix_position").alias(position_col)] if position_col else []))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole mix, with each source weighing the square root of its rows, exactly."""
    return schedule(read_table(spark, sf_dir, "documents"))


#: The schedule by simulation: block after block, the earliest deadline among those released. Weights are whole multiples of
#: 2 ** -52, as roots of 1 and more are, so that releases and deadlines are exact.
OP7_SQL = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS c, row_number() OVER (ORDER BY source NULLS LAST) AS j FROM documents GROUP BY source),
size AS (SELECT greatest({BLOCK}, (sum(c) + {BLOCKS} - 1) // {BLOCKS})::BIGINT AS b FROM n),
k AS (SELECT list((sqrt(c) * 4503599627370496)::HUGEINT ORDER BY j) AS w, list((c + b - 1) // b ORDER BY j) AS blocks, sum((sqrt(c) * 4503599627370496)::HUGEINT)::HUGEINT AS total FROM n, size),
edf AS (
  SELECT 0::HUGEINT AS t, list_transform(blocks, lambda x: 0::HUGEINT) AS had, NULL::HUGEINT[] AS best FROM k
  UNION ALL
  SELECT now + 1, list_transform(had, lambda i, j: i + (j = best[2])::HUGEINT), list_append(best, now)
  FROM (
    SELECT had, now, list_sort(list_transform(list_filter(open, lambda x: x[1] <= now), lambda x: x[2:4]))[1] AS best
    FROM (
      SELECT had, open, greatest(t, list_min(list_transform(open, lambda x: x[1]))) AS now
      FROM (
        SELECT t, had, list_filter(list_transform(had, lambda i, j: [i * total // w[j], ((i + 1) * total + w[j] - 1) // w[j], j::HUGEINT, i]), lambda x: x[4] < blocks[x[3]::BIGINT]) AS open
        FROM edf, k)))
  WHERE best IS NOT NULL),
turns AS (SELECT best[4]::BIGINT AS slot, best[2]::BIGINT AS j, best[3]::BIGINT AS block FROM edf WHERE best IS NOT NULL),
d AS (SELECT doc_id, d.source, n.j, row_number() OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS ordinal FROM documents d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
s AS (SELECT doc_id, source, ordinal, ordinal // b AS block, slot FROM d JOIN turns USING (j), size WHERE turns.block = ordinal // b)
SELECT doc_id, source, block, slot, row_number() OVER (ORDER BY slot, ordinal) - 1 AS position FROM s
"""
