import pytest
from pyspark.sql import functions as F

from cargolens.functions import normalize as N
from cargolens.functions import scores as S
from cargolens.operators import consensus as C
from cargolens.operators import contracts as Q
from cargolens.operators import documents as D
from cargolens.operators import explain as X
from cargolens.operators import parties as P
from cargolens.operators import readiness as Y
from cargolens.operators import rules as R
from cargolens.operators.export import declarations
from cargolens.sources import bundles as B

RAW = [
    ("GROSS_WEIGHT", "450 KG", 450.0, None, "kg", False), ("GROSS_WEIGHT", "1,000.00 LBS", 453.592, None, "kg", False), ("GROSS_WEIGHT", "2 MT", 2000.0, None, "kg", False),
    ("GROSS_WEIGHT", "500 g", 0.5, None, "kg", False), ("GROSS_WEIGHT", "450", 450.0, None, "kg", True), ("GROSS_WEIGHT", "45O.OO KG", None, None, None, True), ("GROSS_WEIGHT", None, None, None, None, True),
    ("VOLUME", "12.5 CBM", 12.5, None, "cbm", False), ("VOLUME", "12500 liters", 12.5, None, "cbm", False), ("PACKAGE_COUNT", "25 CTNS", 25.0, None, "cartons", False), ("PACKAGE_COUNT", "25 Pieces", 25.0, None, "pieces", False),
    ("INVOICE_DATE", "15-Aug-2026", None, "2026-08-15", None, False), ("INVOICE_DATE", "08/15/2026", None, "2026-08-15", None, False), ("INVOICE_DATE", "2026.08.15", None, "2026-08-15", None, False), ("INVOICE_DATE", "31-FOO-2026", None, None, None, True),
    ("TOTAL_AMOUNT", "1,250.50", 1250.5, None, None, False), ("TOTAL_AMOUNT", "1.250,50", 1250.5, None, None, False), ("TOTAL_AMOUNT", "1,250", 1250.0, None, None, False), ("TOTAL_AMOUNT", "450,00", 450.0, None, None, False),
    ("TOTAL_AMOUNT", "USD 49,740.00", 49740.0, None, None, False), ("TOTAL_AMOUNT", "0.00", 0.0, None, None, False), ("CONTAINER_NUMBER", "MAEU 123 456 789", None, "MAEU123456789", None, False), ("AWB_NUMBER", "631-12345678", None, "63112345678", None, False),
    ("HS_CODE", "8516.72.00.00", None, "8516720000", None, False), ("INCOTERM", "FOB Colombo", None, "FOB", None, False), ("INCOTERM", "Free On Board", None, "FOB", None, False), ("CURRENCY_CODE", "US Dollar", None, "USD", None, False),
    ("CURRENCY_CODE", "Sri Lankan Rupee", None, "LKR", None, False),
]


def test_normalize(spark):
    df = spark.createDataFrame([(i, t, r) for i, (t, r, *_) in enumerate(RAW)], "i int, t string, r string")
    got = {x["i"]: x["v"] for x in df.select("i", N.by_type(F.col("t"), F.col("r")).alias("v")).collect()}
    for i, (t, r, num, text, unit, warn) in enumerate(RAW):
        assert (got[i]["num"], got[i]["text"], got[i]["unit"], got[i]["warn"]) == (num, text, unit, warn), (t, r)


def test_semantic_keys_agree(spark):
    k = spark.createDataFrame([("Colombo Custom Port",), ("Port Custom  Colombo.",)], "r string").select(N.semantic_key(F.lit("PORT"), F.col("r")).alias("k"))
    assert k.distinct().count() == 1


@pytest.mark.parametrize("ocr, match, warned, low, high", [(0.98, 0.95, False, 0.9, 0.95), (0.0, 0.0, True, 0.0, 0.2), (0.70, 0.50, False, 0.5, 0.8), (None, None, None, 0.79, 0.81)])
def test_confidence(spark, ocr, match, warned, low, high):
    df = spark.createDataFrame([(ocr, match, warned)], "o double, m double, w boolean")
    assert low <= df.select(S.entity_confidence(F.col("o"), F.col("m"), F.col("w"))).first()[0] <= high


def evidence(spark, rows, partitions=1):
    """Rows of (field, value, confidence, unit) of one shipment, in order."""
    out = []
    for i, (field, value, conf, unit) in enumerate(rows, 1):
        num, txt = (value, None) if isinstance(value, float) else (None, value)
        out.append((1, i, f"d{i}", "commercial_invoice", field, num, txt, num is not None, unit, conf))
    return spark.createDataFrame(out, "shipment_id long, seq long, document_id string, document_type string, entity_type string, num double, txt string, is_num boolean, unit string, confidence double").repartition(partitions)


DEMO = [
    ("GROSS_WEIGHT", 450.0, 0.9, "kg"), ("GROSS_WEIGHT", 450.0, 0.9, "kg"), ("GROSS_WEIGHT", 448.5, 0.9, "kg"),
    ("PACKAGE_COUNT", 25.0, 0.9, "cartons"), ("PACKAGE_COUNT", 25.0, 0.9, "cartons"), ("PACKAGE_COUNT", 25.0, 0.9, "pieces"),
    ("CONSIGNEE_NAME", "ABC Textiles Ltd", 0.9, None), ("CONSIGNEE_NAME", "ABC Textiles Ltd.", 0.9, None), ("TOTAL_AMOUNT", 1250.5, 0.9, None),
]


@pytest.mark.parametrize("partitions", [1, 64])
def test_demo_dossier(spark, partitions):
    a = evidence(spark, DEMO, partitions)
    f = C.resolve(a)
    got = {r["entity_type"]: r for r in f.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"GROSS_WEIGHT": "conflict", "PACKAGE_COUNT": "warning", "CONSIGNEE_NAME": "match", "TOTAL_AMOUNT": "pending"}
    assert got["GROSS_WEIGHT"]["consensus_num"] == 450.0 and got["CONSIGNEE_NAME"]["consensus_txt"] == "ABC Textiles Ltd"
    flagged = C.flagged(a, f)
    assert [r["seq"] for r in flagged.filter("is_outlier").collect()] == [3]
    failed = R.failures(R.outlier_pairs(flagged)).collect()
    assert len(failed) == 1 and failed[0]["delta_text"] == "difference of 1.50"
    assert X.explained(R.failures(R.outlier_pairs(flagged))).first()["recommendation"]["delta"] == 1.5


def test_numbers_cluster_around_first_members(spark):
    a = evidence(spark, [("W", 1.0, 0.9, None), ("W", 1.009, 0.9, None), ("W", 1.018, 0.9, None)])
    r = C.numeric_consensus(a).first()
    assert (r["consensus_num"], r["n_agree"], r["n_clusters"]) == (1.0, 2, 2)  # the third is near the second, not near the first


def test_one_text_makes_a_field_text(spark):
    a = evidence(spark, [("W", 450.0, 0.9, None), ("W", "450", 0.9, None)])
    r = C.resolve(a).first()
    assert r["status"] == "match" and r["consensus_txt"] == "450" and r["consensus_num"] is None


def test_overlay_and_upsert(spark):
    f = C.resolve(evidence(spark, DEMO))
    choice = spark.createDataFrame([(1, "GROSS_WEIGHT", 448.5, None)], "shipment_id long, entity_type string, value_num double, value_txt string")
    r = C.overlay(f, choice).filter("entity_type = 'GROSS_WEIGHT'").first()
    assert (r["status"], r["consensus_num"], r["n_assertions"]) == ("resolved", 448.5, 3)


def test_dedup_keeps_the_surest(spark):
    e = spark.createDataFrame([("d", "450", 0.9, 1), ("d", "450", 0.7, 2), ("d", "448", 0.85, 3)], "doc string, key string, confidence double, seq int")
    assert sorted((r["key"], r["confidence"]) for r in D.deduplicate(e, ["doc", "key"]).collect()) == [("448", 0.85), ("450", 0.9)]


def test_classifier(spark):
    docs = spark.createDataFrame([("a", "PACKING LIST: 12 carton, net weight 3, gross weight 4"), ("b", "hello"), ("c", None)], "document_id string, text string")
    got = {r["document_id"]: r for r in D.classify(docs).collect()}
    assert got["a"]["document_type"] == "packing_list" and got["b"]["document_type"] == got["c"]["document_type"] == "unknown" and got["b"]["confidence"] == 0.1429


def test_party_role_by_position(spark):
    tokens = spark.createDataFrame([("d", 1, 0, "Carrier", 100, 100, 200, 120)], "document_id string, page int, pos int, text string, x1 int, y1 int, x2 int, y2 int")
    values = spark.createDataFrame([("d", 1, 7, "MSA LTD", 100, 130, 200, 150)], "document_id string, page int, value_id int, value string, x1 int, y1 int, x2 int, y2 int")
    assert P.label_evidence(values, tokens).first()["role"] == "carrier"


def ready_fields(spark, pending=None):
    from cargolens.dims import REQUIRED_FIELDS

    value = {"TOTAL_AMOUNT": "125.0", "GROSS_WEIGHT": "10", "PACKAGE_COUNT": "2", "CURRENCY_CODE": "USD", "INCOTERM": "FOB"}
    return spark.createDataFrame([(1, f, "pending" if f == pending else "match", value.get(f, "x")) for f in REQUIRED_FIELDS], "shipment_id long, entity_type string, status string, value string")


def assessed(spark, fields, profile=None, there=True, extra=()):
    from cargolens.dims import REQUIRED_PROFILE

    s = spark.createDataFrame([(1,)], "shipment_id long")
    profile = [(1, k, "305.00" if k == "currency_rate" else "v") for k in REQUIRED_PROFILE] + list(extra) if profile is None else profile
    items = spark.createDataFrame([(1, 1, "cotton", "125.0"), (1, 2, "silk", "n/a")] if there else [(1, 1, "", "")], "shipment_id long, row_index int, description string, total_price string")
    return Y.assess(s, s if there else s.limit(0), fields, spark.createDataFrame(profile, "shipment_id long, field_name string, value string"), items), items


def test_readiness(spark):
    awb = spark.createDataFrame([(1, "AWB_NUMBER", "match", "1")], ready_fields(spark).schema)
    assert assessed(spark, ready_fields(spark).union(awb))[0].first()["export_allowed"]
    codes = lambda r: [(b["code"], b["field"]) for b in r["blockers"]]
    assert codes(assessed(spark, ready_fields(spark, "HS_CODE"))[0].first()) == [("UNRESOLVED_FIELD", "HS_CODE"), ("MISSING_TRANSPORT_DOCUMENT", "transport_document")]
    none = assessed(spark, ready_fields(spark).limit(0), [], False)[0].first()
    assert none["blocker_count"] == 12 + 11 + 3 and not none["export_allowed"] and {("NO_DOCUMENTS", "dossier"), ("MISSING_LINE_ITEMS", "line_items")} < set(codes(none))
    odd = {"TOTAL_AMOUNT": "-1", "CURRENCY_CODE": "US$", "INCOTERM": "XYZ"}
    bad = ready_fields(spark).union(awb).withColumn("value", F.coalesce(*(F.when(F.col("entity_type") == k, v) for k, v in odd.items()), "value"))
    assert {c for c, _ in codes(assessed(spark, bad)[0].first())} == {"INVALID_NUMBER", "INVALID_CURRENCY", "INVALID_INCOTERM"}


def test_declaration_xml(spark):
    awb = spark.createDataFrame([(1, "AWB_NUMBER", "match", "1"), (1, "COUNTRY_OF_ORIGIN", "match", "lk")], ready_fields(spark).schema)
    fields = ready_fields(spark).filter("entity_type != 'COUNTRY_OF_ORIGIN'").union(awb)
    xml = declarations(*assessed(spark, fields, extra=[(1, "financial_code", "F1"), (1, "trading_country", "SG")]), F.lit("2026-01-31")).first()["xml"]
    assert "<Statistical_value>38125.0</Statistical_value>" in xml and xml.count("<Item>") == 2 and xml.startswith("<?xml") and "XMLSchema-instance" in xml
    assert "<Trading_country>SG<" in xml and "<Country_of_export_code>LK<" in xml and "<Financial_code>F1<" in xml and "<Date>2026-01-31<" in xml and "<Bank>" in xml and "Branch" not in xml
    assert declarations(*assessed(spark, ready_fields(spark)), F.lit("")).count() == 0  # no transport document


def test_contracts(spark):
    import json

    good = {"document_id": "d", "document_type": "bl", "classification_confidence": 1, "classification_evidence": [], "processing_time_ms": 3, "errors": [],
            "entities": [dict.fromkeys(Q.ENTITY_KEYS, None) | {"bbox": [1, 2.5, -3, 4e1], "extraction_confidence": 0, "classification_confidence": 1.0}], "raw_ocr": [dict.fromkeys(Q.TOKEN_KEYS, None) | {"ocr_confidence": 0.5}]}
    change = lambda **x: json.dumps(good | x)
    box = lambda b: change(entities=[good["entities"][0] | {"bbox": b}])
    raw = [change(), change(classification_confidence=2), change(classification_confidence="x"), box([1, 2, 3]), box(["1", 2, 3, 4]), box(None), "[]", None, "{}", change(raw_ocr=[{"text": "a", "page": 1, "bbox": []}])]
    got = [r["v"] for r in spark.createDataFrame(list(enumerate(raw)), "i int, raw string").select("i", Q.result_violations(F.col("raw")).alias("v")).orderBy("i").collect()]
    assert got[:8] == [[], ["BAD_CONFIDENCE"], ["BAD_CONFIDENCE"], ["BAD_BOX"], ["BAD_BOX"], [], ["NOT_AN_OBJECT"], ["NOT_AN_OBJECT"]] and len(got[8]) == 8 and got[9] == ["MISSING_TOKEN_FIELD:ocr_confidence"]
    rows = [("cloth", "m", "p1", "2", "5", "10"), (" ", "m", "p1", "2", "5", "10"), ("c" * 1001, "m", "p", "2", "5", "10.2"), ("c", "m", "p", "Infinity", "5", "10"), ("c", "m", "p", "0", "-5", "0"), ("c", "m", "p", "2", "5", "10.21")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, description string, unit string, source_reference string, quantity string, unit_price string, total_price string")
    passed, refused = Q.split(df, Q.line_violations({c: F.col(c) for c in df.columns[1:]}))
    assert [r["i"] for r in passed.collect()] == [0] and [r["violations"] for r in refused.orderBy("i").collect()] == [["REQUIRED_TEXT"], ["TOO_LONG"], ["NOT_A_NUMBER"], ["NOT_POSITIVE"], ["TOTAL_MISMATCH"]]


def test_counterfactuals(spark):
    a = evidence(spark, [("GROSS_WEIGHT", 450.0, 0.9, None), ("GROSS_WEIGHT", 448.5, 0.9, None), ("CONSIGNEE_NAME", "ABC Textiles", 0.9, None), ("CONSIGNEE_NAME", "ABC Textlies", 0.9, None), ("HS_CODE", "1", 0.9, None)])
    a = a.withColumn("document_type", F.get(F.array(F.lit("awb"), F.lit("packing_list")), (F.col("seq") % 2).cast("int")))
    got = {r["entity_type"]: r for r in X.counterfactuals(a).collect()}
    w = got["GROSS_WEIGHT"]["options"]
    assert w[0] == "If the gross weight of Packing List were 448.5 instead of 450, the documents would agree." and w[2] == "Packing List and Awb differ by 0.33%" and len(w) == 3
    assert got["CONSIGNEE_NAME"]["options"][2] == "ABC Textiles and ABC Textlies are 92% alike: likely a misspelling"
    assert got["HS_CODE"]["options"] == ["Verify the hs code of Packing List: 1"] and all(r["recommendation"] and 1 <= len(r["options"]) <= 4 for r in got.values())
    many = evidence(spark, [("VOLUME", float(i % 7), 0.9, None) for i in range(300)])
    assert len(X.counterfactuals(many).first()["options"]) == 4


def test_bundles_of_many_lines(spark, tmp_path):
    import json

    (tmp_path / "b.json").write_text(json.dumps({"documents": {"a.pdf": {"document_id": "1", "entities": []}, "b.pdf": {"document_id": "2"}}}, indent=2))
    assert {(r["name"], json.loads(r["raw"])["document_id"]) for r in B.read_bundles(spark, str(tmp_path / "b.json")).collect()} == {("a.pdf", "1"), ("b.pdf", "2")}
    word = lambda t: {"text": t, "page": 1, "bbox": [1, 2, 3, 4], "confidence": 0.98765}
    (tmp_path / "p.json").write_text(json.dumps({"file_path": "x.pdf", "total_pages": 2, "pages": [{"page_number": 1, "width": 5, "height": 6, "tokens": [word("a"), word("b")]}, {"page_number": 2, "width": 5, "height": 6, "tokens": [word("c")]}]}, indent=2))
    assert [(r["pos"], r["page"], r["text"], r["x2"], r["confidence"]) for r in B.read_pages(spark, str(tmp_path / "p.json")).orderBy("pos").collect()] == [(0, 1, "a", 3.0, 0.9877), (1, 1, "b", 3.0, 0.9877), (2, 2, "c", 3.0, 0.9877)]
    (tmp_path / "m.json").write_text(json.dumps({"shipment_reference": "S", "documents": [{"file": "x.pdf", "document_type": "bl", "pages": 1, "expected_fields": {"HS_CODE": {"label": "HS", "value": "6109"}}, "expected_lines": ["a"]}]}, indent=2))
    m = B.read_manifest(spark, str(tmp_path / "m.json"))
    assert m.first()["lines"] == ["a"] and B.expected_fields(m).first()["value"] == "6109"


def test_text_conflicts(spark):
    a = evidence(spark, [("SHIPPER_NAME", "Seller Mills", 0.9, None), ("SHIPPER_NAME", "SELLER Mills", 0.9, None), ("HS_CODE", "6109100", 0.9, None), ("HS_CODE", "6109101", 0.9, None), ("INCOTERM", "FOB", 0.9, None), ("INCOTERM", "CIF", 0.9, None)])
    assert {r["entity_type"] for r in R.text_conflicts(a).collect()} == {"HS_CODE", "INCOTERM"}


def test_reading_order_uses_row_anchors(spark):
    rows = [("d", 1, i, t, x, y, x + 5, y + 2) for i, (t, x, y) in enumerate([("b", 20, 8), ("a", 0, 0), ("c", 40, 14), ("d", 0, 16)])]
    t = spark.createDataFrame(rows, "document_id string, page int, pos int, text string, x1 int, y1 int, x2 int, y2 int")
    assert [r["text"] for r in D.reading_order(t).orderBy("row").collect()] == ["a b c", "d"]
