"""Tables that are kept as Parquet in buckets of their keys and changed in place, batch by batch.

A change rewrites only the buckets that it touches, by dynamic partition overwrite; other buckets keep their files. Every
change may be repeated: upserts take the last row of a key by stated columns, counters and appended rows remember the
batch that made them. So a batch that is replayed after a failure leaves a table as it was, also where the failure
came between two buckets. One writer at a time changes a table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .store import kept

_BUCKET = "__bucket"


@dataclass(frozen=True)
class StoredTable:
    """A table at ``path`` with ``schema`` (DDL), dealt in ``buckets`` by ``bucket_by``, or by ``keys`` if that isn't given.

    ``buckets`` is to be chosen so that a bucket is a few files; within a bucket, rows are dealt to files by size.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    bucket_by: tuple[str, ...] = ()
    buckets: int = 32

    def _all(self) -> DataFrame:
        """The table with its buckets; empty where nothing is written yet."""
        schema = StructType.fromDDL(f"{self.schema}, {_BUCKET} int")
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read(self, touched_by: DataFrame | None = None) -> DataFrame:
        """The table, or only the buckets of the ``bucket_by`` columns of ``touched_by``."""
        rows = self._all()
        if touched_by is not None:
            rows = rows.filter(F.col(_BUCKET).isin(self._buckets(touched_by)))
        return rows.drop(_BUCKET)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.bucket_by or self.keys)), F.lit(self.buckets)).cast("int")

    def _buckets(self, rows: DataFrame) -> list[int]:
        """The buckets that the rows are in: at most ``buckets`` numbers."""
        return [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()]

    def change(self, arrived: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Rewrite the buckets of ``arrived`` with ``merged`` (their rows, ``arrived``), which must not lose all rows of a bucket."""
        arrived = kept(arrived, "arrived")  # read once for its buckets and once for its rows, and the same both times
        touched = self._buckets(arrived)
        if touched:
            current = self._all().filter(F.col(_BUCKET).isin(touched)).drop(_BUCKET)
            columns = StructType.fromDDL(self.schema).fieldNames()
            out = merged(current, arrived).select(*columns, self._bucket().alias(_BUCKET)).hint("rebalance", _BUCKET)
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(self.path)

    def upsert(self, rows: DataFrame, order: list[str]) -> None:
        """Of the rows of a key, those stored included, the last by ``order`` stays; of equal ones any, so they should be the same."""
        rest = [c for c in StructType.fromDDL(self.schema).fieldNames() if c not in self.keys]
        last = lambda df: df.groupBy(*self.keys).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("x"))
        self.change(last(rows).select(*self.keys, "x.*"), lambda now, new: last(now.unionByName(new)).select(*self.keys, "x.*"))

    def count_up(self, rows: DataFrame, counter: str, batch: int, at: str = "batch") -> None:
        """Add to ``counter`` of each stored key how many of ``rows`` have it; keys that aren't stored aren't made.

        ``at`` is the column with the last batch that counted for a key; batches come in order, so a repeated one adds nothing.
        """
        hits = rows.groupBy(*self.keys).agg(F.count("*").alias("__n"))

        def merged(now: DataFrame, new: DataFrame) -> DataFrame:
            both = now.join(new, list(self.keys), "left")
            counts = F.col("__n").isNotNull() & (F.coalesce(F.col(at), F.lit(-1)) < batch)
            return both.withColumns({counter: F.coalesce(counter, F.lit(0)) + F.when(counts, F.col("__n")).otherwise(0), at: F.when(counts, F.lit(batch)).otherwise(F.col(at))})

        known = hits.join(self.read(hits).select(*self.keys), list(self.keys), "left_semi")
        self.change(known, merged)

    def append(self, rows: DataFrame, number: str, order: list[Column], batch: int, at: str = "batch") -> None:
        """Append ``rows`` with ``number``, which goes on from the largest of their ``bucket_by`` columns; a repeated batch replaces its rows."""
        group = list(self.bucket_by)

        def merged(now: DataFrame, new: DataFrame) -> DataFrame:
            old = now.filter(F.col(at) != batch)
            last = old.groupBy(*group).agg(F.max(number).alias("__last"))
            numbered = new.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).join(last, group, "left")
            numbered = numbered.withColumns({number: F.coalesce("__last", F.lit(0)) + F.col("__n"), at: F.lit(batch)})
            return old.unionByName(numbered.select(*now.columns))

        self.change(rows, merged)

    def mark(self, where: Column, column: str) -> None:
        """Set the boolean ``column`` of rows that satisfy ``where``; buckets without such a row aren't touched."""
        hit = F.coalesce(where, F.lit(False)) & ~F.coalesce(F.col(column), F.lit(False))
        touched = self._all().filter(hit).select(*dict.fromkeys((*self.keys, *self.bucket_by)))
        self.change(touched, lambda now, _: now.withColumn(column, F.coalesce(F.col(column), F.lit(False)) | F.coalesce(where, F.lit(False))))
