"""Fields folded in arrays: nothing is gathered or sorted by Spark but what the window asks for; the same as the way of large fields."""

import random

from pyspark.sql import functions as F

from cargolens.operators import consensus as C
from cargolens.operators import explain as X
from cargolens.operators import rules as R
from cargolens.plans import catalog

SF = "/root/testdata/sf0.001"
SCHEMA = "shipment_id long, entity_type string, seq long, num double, txt string, is_num boolean, unit string, confidence double, document_id string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_and_no_gathering(spark):
    for name in ("agg04_field_rollup", "rul02_text_failures", "agg05_assertion_flags"):
        p = plan(catalog.queries()[name](spark, SF)).split("Initial Plan")[-1]
        assert p.count("Exchange") == 1 and not any(x in p for x in ("ObjectHashAggregate", "SortAggregate", "Join")), name


def rows(seed):
    r = random.Random(seed)
    out = []
    for k in range(60):
        for e in ("A", "B", "C"):
            for i in range(r.randrange(1, 9)):
                num = e == "A" or (e == "B" and r.random() < 0.5)
                x = r.choice([1.0, 1.0, 1.008, 1.016, 2.5, -3.0, 1e20, None, 7.0, 0.0, -0.0]) if num else None
                out.append((k, e, i, x, None if num else r.choice(["Star", "star.", "7", "Moon 1", "", None]), num, r.choice(["kg", "KG", "t", None, ""]), r.choice([0.5, 0.9, None]), f"{k}-{i}"))
    r.shuffle(out)
    return out


def test_same_as_large_fields(spark):
    """Also for numbers near each other, null values, fields of numbers and texts, small batches."""
    a = spark.createDataFrame(rows(3), SCHEMA).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        whole = lambda large: sorted(map(str, C.resolve(a, large).collect()))
        few = whole(C.LARGE)
        flags = lambda df: sorted(map(str, df.select("shipment_id", "entity_type", "seq", "num", "txt", "document_id", "status", "is_consensus", "is_outlier", "variance", "representative").collect()))
        judged = flags(C.judged(a, ["document_id"]))
        assert [r for r in flags(C.judged(a, ["document_id"], outliers=True))] == [r for r in judged if "is_outlier=True" in r]
        assert judged == flags(C.flagged(a, C.resolve(a)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert few == whole(0) == whole(4) and len(few) == a.select(*C.FIELD).distinct().count()
    assert a.filter(F.col("num").isNull() & F.col("is_num")).count() > 0


def test_status_of_nodes_in_one_exchange(spark):
    """Also where an assertion is there twice, and where shipments with large fields are joined."""
    a = spark.createDataFrame([(*x[:7], x[7], x[8] if i % 3 else f"{x[0]}-0") for i, x in enumerate(rows(4)) for _ in range(1 + (i % 5 == 0))], SCHEMA).repartition(3)
    own = C.resolve(a, carried=()).select(X._field_id().alias("id"), "status")
    want = sorted(map(str, X.node_status(C.judged(a, ["document_id"], carried=()), own).collect()))
    assert sorted(map(str, X.graph_status(a).collect())) == want == sorted(map(str, X.graph_status(a, large=7).collect()))
    p = plan(catalog.queries()["grf03_node_status"](spark, SF)).split("Initial Plan")[-1]
    assert p.count("Exchange") == 1 and "Aggregate" not in p and "Join" not in p


def test_options_of_discrepancies_in_one_exchange(spark):
    """Also where fields are large."""
    types = ["bl", "awb", None]
    a = spark.createDataFrame([(*x, types[i % 3]) for i, x in enumerate(rows(5))], SCHEMA + ", document_type string").repartition(3)
    sides = ("document_id", "confidence")
    found = R.discrepancies(R.failures(R.outlier_pairs(C.judged(a, ["is_num", *sides], sides, outliers=True))))
    shown = lambda df: sorted(map(str, df.select(*C.FIELD, "discrepancy_id", "options", "recommendation").collect()))
    want = shown(X.with_counterfactuals(found, a))
    assert shown(X.discrepancies_with_options(a)) == want == shown(X.discrepancies_with_options(a, large=4)) and len(want) > 50
    p = plan(catalog.queries()["xai07_all_options"](spark, SF)).split("Initial Plan")[-1]
    assert p.count("Exchange") == 1 and "Join" not in p


def test_own_choices_in_one_exchange(spark):
    """The last flagged assertion of a field stands, null values and flags included."""
    a = spark.createDataFrame(rows(6), SCHEMA).withColumn("reviewed", F.when(F.col("seq") % 3 > 0, F.col("confidence") > 0.6)).repartition(3)
    choices = C.latest(a.filter("reviewed").select(*C.FIELD, "seq", F.col("num").alias("value_num"), F.col("txt").alias("value_txt")), C.FIELD, [F.col("seq")])
    shown = lambda df: sorted(map(str, df.select(*C.FIELD, "status", "consensus_num", "consensus_txt", "n_assertions").collect()))
    want = shown(C.overlay(C.resolve(a), choices))
    assert shown(C.overlay_own(a, "reviewed")) == want == shown(C.overlay_own(a, "reviewed", large=4)) and sum("resolved" in x for x in want) > 20
    p = plan(catalog.queries()["join04_reviewer_overlay"](spark, SF)).split("Initial Plan")[-1]
    assert p.count("Exchange") == 1 and "Join" not in p


def test_edges_are_told_apart_where_they_lie(spark):
    """Repeated assertions, documents of several fields, nulls: the edges of a graph, each once, with no exchange but that of the shipments; and the assertions of each field."""
    rows = [(s, f"{s}-{k % 3}", e, k % 3 + 1) for s in (1, 2, 3) for k in range(5) for e in ("A", "B", "A")] + [(None, None, "A", 1), (None, None, "A", 1)]
    a = spark.createDataFrame(rows, "shipment_id long, document_id string, entity_type string, seq long")
    got = [tuple(r) for r in X.edges(a).collect()]
    want = set()
    for s, d, e, q in rows:
        field, said = ":".join(["shipment", *([str(s)] if s else []), "field", e]), ":".join(x for x in ("assertion", d, e, str(q)) if x)
        want |= {(str(s) if s else None, d, "CONTAINS"), (str(s) if s else None, field, "HAS_FIELD"), (said, field, "ASSERTS_VALUE_FOR")}
        if q > 1:
            want.add((said, f"assertion:{s}-{q - 1}:{e}:{q - 1}", "MUST_MATCH"))
    assert len(got) == len(set(got)) and set(got) == want
    near = X.neighbours(X.edges(a), X.nodes(a).filter("kind = 'field'"), "ASSERTS_VALUE_FOR")
    assert sorted(map(str, X.asserted(a).collect())) == sorted(map(str, near.collect()))
    for name in ("grf02_edges", "grf04_neighbours"):
        p = plan(catalog.queries()[name](spark, SF)).split("Initial Plan")[-1]
        assert p.count("Exchange") == 1 and "Aggregate" not in p and "Join" not in p, name
