"""Stored tables: replayed batches, untouched buckets; live progress over files that arrive one after the other."""

import os
from collections import defaultdict

from pyspark.sql import functions as F

from cargolens.sources.stored import StoredTable
from cargolens.streaming import ingest as I


def rows_of(table, *columns):
    return sorted(tuple(r) for r in table.read().select(*columns).collect())


def files(path):
    out = defaultdict(set)
    for d, _, names in os.walk(path):
        out[os.path.basename(d)] |= {n for n in names if n.startswith("part-")}
    return {k: v for k, v in out.items() if v}


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), "k long, v string, at long", ("k",), (), 8)
    make = lambda *rows: spark.createDataFrame(rows, "k long, v string, at long")
    assert t.read().count() == 0
    t.upsert(make(*((k, "a", 1) for k in range(40))), ["at"])
    before = files(t.path)
    t.upsert(make((3, "b", 2), (3, "c", 0)), ["at"])
    after = files(t.path)
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) > 4
    want = sorted((k, "b" if k == 3 else "a") for k in range(40))
    assert rows_of(t, "k", "v") == want
    t.upsert(make((3, "b", 2), (3, "c", 0)), ["at"])  # again
    t.upsert(make((3, "late", 1)), ["at"])  # came late
    assert rows_of(t, "k", "v") == want
    t.upsert(make(), ["at"])
    assert rows_of(t, "k", "v") == want


def test_counters_and_appended_rows_of_replayed_batches(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "hits"), "k string, n long, batch long, deleted boolean", ("k",), (), 4)
    t.upsert(spark.createDataFrame([("a", 5, -1, False), ("b", 0, -1, False)], t.schema), ["batch"])
    looked = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    for batch, ks in ((0, "aab"), (1, "bz"), (1, "bz"), (2, "a"), (2, "a")):
        t.count_up(looked(*ks), "n", batch)
    assert rows_of(t, "k", "n") == [("a", 8), ("b", 2)]
    for _ in range(2):
        t.mark(F.col("k") == "a", "deleted")
    assert rows_of(t, "k", "deleted") == [("a", True), ("b", False)]
    g = StoredTable(spark, str(tmp_path / "rows"), "s long, i long, v string, batch long", ("s", "i"), ("s",), 4)
    new = lambda *rows: spark.createDataFrame(rows, "s long, v string")
    for batch, rows in ((0, [(1, "x"), (1, "y"), (2, "z")]), (1, [(1, "w")]), (1, [(1, "w")]), (2, [(2, "q")])):
        g.append(new(*rows), "i", [F.col("v")], batch)
    assert rows_of(g, "s", "i", "v") == [(1, 1, "x"), (1, 2, "y"), (1, 3, "w"), (2, 1, "z"), (2, 2, "q")]


def test_live_progress_over_arriving_files(spark, tmp_path):
    schema = "dossier_id long, document_id string, status string, at timestamp"
    at = lambda k: F.lit(f"2026-01-0{k}").cast("timestamp")

    def arrive(name, day, *rows):
        spark.createDataFrame(rows, "dossier_id long, document_id string, status string").withColumn("at", at(day)).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        I.live_progress(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema, str(tmp_path / "out"), str(tmp_path / "checkpoint"), lambda rows: rows, files=1, buckets=4)
        return rows_of(I.progress_tables(spark, str(tmp_path / "out"), 4)[1], "dossier_id", "n_documents", "n_done", "n_error")

    arrive("1", 1, (7, "a", "pending"), (7, "b", "pending"), (8, "c", "pending"))
    assert run() == [(7, 2, 0, 0), (8, 1, 0, 0)]
    arrive("2", 2, (7, "a", "done"))
    arrive("3", 3, (8, "c", "error"), (7, "d", "pending"))
    assert run() == [(7, 3, 1, 0), (8, 1, 0, 1)]
    arrive("4", 2, (7, "a", "done"))  # the second file again
    arrive("5", 1, (8, "c", "pending"))  # came late
    assert run() == [(7, 3, 1, 0), (8, 1, 0, 1)]
