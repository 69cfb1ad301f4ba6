"""Consensus of numbers and reading order by islands against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cargolens.operators import consensus as C
from cargolens.operators import documents as D
from cargolens.operators.islands import islands

SCHEMA = "shipment_id long, entity_type string, seq long, num double, txt string, is_num boolean, unit string, confidence double, document_id string"


def greedy(values):
    """(first number of the best cluster, its size, clusters) of (seq, num, confidence) in order."""
    clusters = []
    for seq, num, w in sorted(values):
        for c in clusters:
            if abs(c[0] - num) <= C.TOLERANCE:
                c[1] += 1
                c[2] += w
                break
        else:
            clusters.append([num, 1, w, seq])
    best = max(clusters, key=lambda c: (c[1], round(c[2], 6), -c[3]))
    return best[0], best[1], len(clusters)


def claims(seed, fields, most):
    r = random.Random(seed)
    rows = []
    for k in range(fields):
        base = [r.choice([1.0, 5.0, 1.008, 1.016, 1.024, 7.0, 7.005, 7.011, -3.0, 1e6]) + r.choice([0, 0.25]) for _ in range(r.randrange(1, most))]
        rows += [(k, "GROSS_WEIGHT", i, x, None, True, r.choice(["kg", "KG", "t", None, ""]), r.choice([0.5, 0.9]), f"{k}-{i}") for i, x in enumerate(base)]
    return rows


@pytest.mark.parametrize("large", [0, 4, C.LARGE])
def test_consensus_of_numbers(spark, large):
    rows = claims(large, 80, 30)
    a = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {k: greedy([(x[2], x[3], x[7]) for x in rows if x[0] == k]) for k in {x[0] for x in rows}}
    got = {r["shipment_id"]: (r["consensus_num"], r["n_agree"], r["n_clusters"]) for r in C.numeric_consensus(a, large).collect()}
    assert got == want
    got = {r["shipment_id"]: (r["consensus_num"], r["n_agree"], r["n_clusters"]) for r in C.resolve(a, large).collect()}
    assert got == want


def test_both_ways_resolve_the_same(spark):
    rows = claims(9, 60, 12)
    rows += [(k + 1000, "VESSEL_NAME", i, None, random.Random(k + i).choice(["Star", "star.", "Moon"]), False, None, 0.5, f"{k}-{i}") for k in range(20) for i in range(5)]
    rows += [(k + 2000, "MIXED", i, *((float(i), None, True) if i % 2 else (None, "x", False)), "kg", 0.5, f"{k}-{i}") for k in range(10) for i in range(6)]
    a = spark.createDataFrame(rows, SCHEMA)
    whole = lambda large: sorted(map(str, C.resolve(a, large).collect()))
    assert whole(C.LARGE) == whole(0) == whole(3)


def test_a_field_of_very_many_numbers(spark):
    """Its islands lie in several tasks, and none of them gathers the field."""
    n = 120_000
    a = spark.range(n).select(F.lit(1).cast("long").alias("shipment_id"), F.lit("GROSS_WEIGHT").alias("entity_type"), F.col("id").alias("seq"), (F.col("id") * 7 % n).cast("double").alias("num"), F.lit(None).cast("string").alias("txt"), F.lit(True).alias("is_num"), F.lit("kg").alias("unit"), F.lit(0.5).alias("confidence"), F.lit("d").alias("document_id"))
    r = C.resolve(a.unionByName(a.filter("seq = 77").withColumn("seq", F.lit(n).cast("long")))).first()
    assert (r["consensus_num"], r["n_agree"], r["n_clusters"], r["status"]) == (539.0, 2, n, "conflict")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # this table would be small enough for one task
    try:
        found = islands(a.select("shipment_id", "num"), ["shipment_id"], "num", lambda x, y: y - x > 0.01)
        sizes = [x["count"] for x in found.groupBy(F.spark_partition_id()).count().collect()]
        assert found.select("island").distinct().count() == n and len(sizes) > 1 and max(sizes) < 0.7 * n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_rows(tokens, gap=14.0):
    """(document, page) to the texts of its rows, by anchors from top to bottom."""
    out = {}
    for key in {t[:2] for t in tokens}:
        rows, anchor = [], None
        for mid, x, pos, text in sorted(((t[5] + t[7]) / 2, t[4], t[2], t[3]) for t in tokens if t[:2] == key):
            if anchor is None or mid - anchor > gap:
                anchor, rows = mid, [*rows, []]
            rows[-1].append((x, pos, text))
        out[key] = [" ".join(w for *_, w in sorted(r)) for r in rows]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_reading_order(spark, seed):
    r = random.Random(seed)
    tokens = []
    for d in range(12):
        for p in range(1, 4):
            for k in range(r.randrange(1, 60)):
                y = r.choice([r.randrange(0, 120), r.randrange(0, 900)])
                tokens.append((d, p, k, f"w{k}", r.randrange(0, 500), y, 0, y + r.choice([10, 12, 13])))
    t = spark.createDataFrame(tokens, "document_id long, page long, pos long, text string, x1 long, y1 long, x2 long, y2 long").repartition(4)
    got = {}
    for x in sorted(D.reading_order(t).collect(), key=lambda x: x["row"]):
        got.setdefault((x["document_id"], x["page"]), []).append((x["row"], x["text"]))
    assert {k: [text for _, text in v] for k, v in got.items()} == plain_rows(tokens) and all([n for n, _ in v] == list(range(len(v))) for v in got.values())
