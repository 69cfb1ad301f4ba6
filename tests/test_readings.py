"""The document job and linkage on documents that are one row each."""

import random

from pyspark.sql import functions as F

from cargolens.operators import extract as E
from cargolens.operators import linkage as L
from cargolens.operators import readings as R
from cargolens.plans import catalog, intake
from cargolens.sources.bindings import paper_readings, papers

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_only_dealt_out_once(spark):
    """Orders are dealt out to tasks; their lines are never sorted, joined, grouped or dealt again, nor written on the way."""
    for name in ("ext03_combined", "ext04_document_job", "join07_fuzzy_linkage", "join08_multi_token_boxes"):
        p = plan(catalog.queries()[name](spark, SF)).split("Initial Plan")[-1]
        assert p.count("Exchange") == 1 and "Join" not in p and "Aggregate" not in p and "Sort " not in p, name
        assert p.count("FileScan") == 1 and "orders.parquet" in p, name


def test_same_as_by_tables(spark):
    """The fields of documents in rows are those of tables of tokens."""
    t = papers(spark, SF).filter("document_id < 400")
    d = intake._texts(spark, SF).filter("document_id < 400")
    columns = ["document_id", "entity_type", "value", "confidence", "pos", "page", "source"]
    want = E.combined(E.by_label(t), E.by_pattern(d, t)).select(*columns).collect()
    got = R.found_fields(R.in_order(paper_readings(spark, SF).filter("document_id < 400"))).select("document_id", F.inline("found")).select(*columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 1000
    found = E.combined(E.by_label(t), E.by_pattern(d, t))
    want = E.judged(E.placed(found, t), t).filter("document_id < 100").select("document_id", "entity_type", "value", "box", "ocr", "role", "effective_type", "eligible").collect()
    every = {k: list(R.LABELS) + list(R.PATTERNS) for k in ("commercial_invoice", "packing_list", "awb", "bl", "unknown")}
    docs = R.judged_fields(R.typed(R.in_order(paper_readings(spark, SF).filter("document_id < 100"))), every)
    got = docs.select("document_id", F.inline("found")).select("document_id", "entity_type", "value", "box", "ocr", "role", "effective_type", "eligible").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_linkage_in_rows_is_linkage_of_tables(spark):
    """Random texts of few letters, in which values are held, hold parts, are alike, or fit nothing; nulls, blanks and repeats too."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcde") for _ in range(draw.randint(1, 9)))
    rows, values = [], []
    for d in range(60):
        for pos in range(draw.randint(0, 12)):
            text = draw.choice([None, "", " ", word().upper(), word(), f"{word()} {word()}", word() * 3])
            rows.append((d, pos // 5 + 1, pos, text, pos * 10, pos, pos * 10 + 5, pos + 3, 0.5 + pos / 100))
        values += [(d, draw.choice([None, "", word(), f"{word()} {word()} {word()}", word() + word().upper()])) for _ in range(8)]
    t = spark.createDataFrame(rows, "document_id long, page long, pos long, text string, x1 long, y1 long, x2 long, y2 long, confidence double")
    v = spark.createDataFrame(values, "document_id long, value string")
    tokens = t.groupBy("document_id").agg(F.collect_list(F.struct("page", "pos", "text", "x1", "y1", "x2", "y2", "confidence")).alias("tokens"))
    docs = tokens.join(v.groupBy("document_id").agg(F.collect_list("value").alias("asked")), "document_id")
    for one, other in ((L.link(v, t), L.link_within(docs, F.col("asked"))), (L.link_parts(v, t), L.link_parts_within(docs, F.col("asked")))):
        want = sorted(map(str, one.select(*other.columns).collect()))
        assert sorted(map(str, other.collect())) == want and len(want) > 20


def test_documents_without_tokens_and_labels_with_digits(spark):
    docs = spark.createDataFrame([(1, []), (2, None)], f"document_id long, tokens array<{E.RESULT_TOKEN}>")
    assert R.found_fields(R.in_order(docs)).select("document_id", F.inline("found")).count() == 0
    assert sorted(r["document_type"] for r in R.typed(R.in_order(docs)).collect()) == ["unknown", "unknown"]
    texts = spark.createDataFrame([(["box 1", "box 2", "box 1:", None, ""], [None, "box 1", None, None, None])], "t array<string>, own array<string>")
    bits = texts.select(R.label_kinds(F.col("t"), F.col("own"), {"A": ["box 1"], "B": ["box 2"]}).alias("k")).first()["k"]
    assert [(k & 3, k >> R.LABEL & 1, k >> R.OWN & 1) for k in bits] == [(1, 1, 0), (2, 1, 1), (1, 1, 0), (0, 0, 0), (0, 0, 0)]
