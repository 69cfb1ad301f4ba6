"""Gaps and islands of sorted rows, without holding a group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import kept


def islands(rows: DataFrame, group: list[str], value: str, apart: Callable[[Column, Column], Column], name: str = "islands") -> DataFrame:
    """``rows`` with ``island``, a number that goes up where a group ends or a value is ``apart`` from the one before it.

    Rows are range-partitioned by group and value and written once in order; the one before a partition's first row is the
    last of the partition before it. So a group with very many rows lies in many partitions and is told apart there.
    """
    by = [*group, value]
    stored = kept(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), name)
    stored = stored.withColumn("__part", F.shiftright("__at", 33))  # the rest of that number counts the partition's rows
    row, parts = F.struct(*by), Window.orderBy("__p")
    ends = stored.groupBy(F.col("__part").alias("__p")).agg(F.max_by(row, "__at").alias("__end"))
    ends = ends.withColumn("__end", F.lag("__end").over(parts))  # one row per partition
    within = Window.partitionBy("__part").orderBy("__at")
    before = F.coalesce(F.lag(row).over(within), F.col("__end"))
    same = F.lit(True)
    for c in group:
        same = same & before[c].eqNullSafe(F.col(c))
    starts = F.when(before.isNotNull() & same & ~apart(before[value], F.col(value)), 0).otherwise(1)
    flagged = kept(stored.join(F.broadcast(ends), F.col("__part") == F.col("__p"), "left").withColumn("__start", starts).select(*rows.columns, "__at", "__part", "__start"), name)
    sums = flagged.groupBy(F.col("__part").alias("__p")).agg(F.sum("__start").alias("__n"))
    sums = sums.select("__p", F.coalesce(F.sum("__n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__sofar"))
    number = F.col("__sofar") + F.sum("__start").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.join(F.broadcast(sums), F.col("__part") == F.col("__p")).withColumn("island", number).select(*rows.columns, "island")
