"""Labels near values against plain loops over all pairs of a page."""

import random

import pytest
from pyspark.sql import functions as F

from cargolens.functions.normalize import party_role
from cargolens.operators import linkage as L
from cargolens.operators import parties as P

BOX = "x1 long, y1 long, x2 long, y2 long"
LABELS = ["Consignee", "Shipper:", "Carrier", "Notify party", "Exporter: Mills Ltd", "Consignee: Trader 5 Ltd", "total"]


def plain(value, box, labels):
    """(role, score) of a page's best label (pos, text, box, role); None if none is accepted."""
    found = []
    for pos, text, (a1, b1, a2, b2), role in labels:
        x1, y1, _, y2 = box
        down = y1 - b2
        if value.strip().lower() in text.lower() and ":" in text:
            score = 1.0
        elif abs((y1 + y2) / 2 - (b1 + b2) / 2) <= 48 and x1 >= a2 - 16:
            score = 0.92 - min(max(x1 - a2, 0), 300) / 3000
        elif -16 <= down <= 180 and abs(x1 - a1) <= 180:
            score = 0.82 - min(down, 160) / 1600
        else:
            continue
        if role and round(score, 6) >= P.ACCEPT:
            found.append((round(score, 6), -pos, role))
    return max(found)[2::-2] if found else None


@pytest.mark.parametrize("seed", range(3))
def test_evidence_against_all_pairs(spark, seed):
    r = random.Random(seed)
    box = lambda w: (x := r.choice([40, r.randrange(0, 900)]), y := r.choice([100, r.randrange(-40, 900)]), x + w, y + r.choice([10, 12]))
    tokens = [(d, p, k, r.choice(LABELS), *box(90)) for d in range(4) for p in (1, 2) for k in range(40)]
    values = [(d, p, k, r.choice(["Trader 5 Ltd", "MSA", "mills", "Sea Bank", "x"]), *box(60)) for d in range(5) for p in (1, 2) for k in range(60)]
    values = [(d, p, 100 * p + k, v, *b) for d, p, k, v, *b in values]
    t = spark.createDataFrame(tokens, f"document_id long, page long, pos long, text string, {BOX}")
    roles = {x["text"]: x["role"] for x in t.select("text", party_role(F.col("text")).alias("role")).distinct().collect()}
    v = spark.createDataFrame(values, f"document_id long, page long, value_id long, value string, {BOX}")
    got = {(x["document_id"], x["value_id"]): (x["role"], x["score"]) for x in P.label_evidence(v, t).collect()}
    want = {}
    for d, p, k, value, *b in values:
        if value != "Sea Bank" and (best := plain(value, b, [(pos, text, tuple(c), roles[text]) for e, q, pos, text, *c in tokens if (e, q) == (d, p)])):
            want[d, k] = best
    assert got == want and len(got) > 100


def test_pairs_are_those_of_neighbours(spark):
    """A page of 10,000 values and 1,000 labels makes pairs in proportion to the labels near a value."""
    n = spark.range(10_000).select(F.lit(1).alias("document_id"), F.lit(1).alias("page"), F.col("id").alias("value_id"), F.lit("v").alias("value"), F.lit(300).alias("x1"), (F.col("id") * 20).alias("y1"), F.lit(380).alias("x2"), (F.col("id") * 20 + 12).alias("y2"))
    t = spark.range(1_000).select(F.lit(1).alias("document_id"), F.lit(1).alias("page"), F.lit("shipper").alias("role"), F.col("id").alias("t_pos"), F.lit(40).alias("t_x1"), (F.col("id") * 200).alias("t_y1"), F.lit(120).alias("t_x2"), (F.col("id") * 200 + 12).alias("t_y2"))
    assert 10_000 < P._near(n, t).count() < 40_000


def test_large_pages_find_the_same(spark, monkeypatch):
    """Few pairs of a page meet each other, many by bands and by texts: the evidence is the same."""
    r = random.Random(7)
    box = lambda w: (x := r.choice([40, r.randrange(0, 900)]), y := r.choice([100, r.randrange(-40, 900)]), x + w, y + 12)
    t = spark.createDataFrame([(1, p, k, r.choice(LABELS), *box(90)) for p in (1, 2) for k in range(30)], f"document_id long, page long, pos long, text string, {BOX}")
    v = spark.createDataFrame([(1, p, 100 * p + k, r.choice(["Trader 5 Ltd", "MSA", "mills", ""]), *box(60)) for p in (1, 2) for k in range(40)], f"document_id long, page long, value_id long, value string, {BOX}")
    got = []
    for few in (0, 10**9):
        monkeypatch.setattr(L, "FEW_PAIRS", few)
        got.append({tuple(x) for x in P.label_evidence(v, t).collect()})
    assert got[0] == got[1] and len(got[0]) > 20
