"""Rows of conversations numbered by turn, without holding a conversation in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``place``: each row's number, from 0, among those of its key by ``order`` (nulls first).

    Rows are range-partitioned and sorted by key and order and written once with their number within the partition. Only
    where each key begins in each partition is joined to them, so a key with very many rows lies in many partitions.
    Rows equal in key and order are interchangeable if ``order`` tells what they hold.
    """
    by = [key, *order]
    stored = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)  # the rest of that number counts the partition's rows
    runs = stored.groupBy(F.col(key).alias("__key"), part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = cut(runs.select("__key", "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift")), f"{name}-runs")
    return stored.join(small(runs), F.col(key).eqNullSafe(F.col("__key")) & (part == F.col("__part"))).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("place"))


#: crc32 in SQL: its table by the polynomial's rule, and the checksum of an ASCII text. Both go into a WITH list.
SQL_CRC = """crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) AS r(i))"""


def sql_crc32(text: str) -> str:
    """The unsigned crc32 of an SQL text of ASCII characters; the query reads crc_table."""
    return f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: CAST(ord(({text})[i]) AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295)"
