"""Counterfactual options against plain loops over all pairs of sources."""

import random
from difflib import SequenceMatcher

import pytest

from cargolens.operators import explain as X
from cargolens.plans import catalog
from cargolens.sources import bundles as B
from cargolens.sources.bindings import assertions

SCHEMA = "shipment_id long, entity_type string, seq long, num double, txt string, document_type string"
TYPES = ["bl", "awb", "packing_list", "commercial_invoice", "letter_of_credit", "delivery_order", None]


def title(t):
    return " ".join(w.capitalize() for w in (t or "unknown").split("_"))


def shown(num, txt):
    return txt if txt is not None else "" if num is None else str(int(num)) if num == int(num) else str(num)


def plain_options(field, sources):
    label, rows = field.lower().replace("_", " "), [(title(t), shown(n, x), n) for n, x, t in sources]
    values = {v for _, v, _ in rows}
    numeric, text = all(n is not None for n, _, _ in sources), all(x is not None for _, x, _ in sources)
    out = []
    if len(values) > 1 and (numeric or text):
        for i, (d, v, n) in enumerate(rows):
            for e, w, m in rows[i + 1 :]:
                if v == w:
                    continue
                out += [f"If the {label} of {d} were {w} instead of {v}, the documents would agree.", f"If the {label} of {e} were {v} instead of {w}, the documents would agree."]
                if numeric:
                    if m and abs(n - m) / abs(m) * 100 >= 0.01:
                        out.append(f"{d} and {e} differ by {abs(n - m) / abs(m) * 100:.2f}%")
                else:
                    r = SequenceMatcher(None, v.lower(), w.lower()).ratio()
                    if r >= X.SIMILAR:
                        out.append(f"{v} and {w} are {r * 100:.0f}% alike: " + ("likely a misspelling" if r >= X.MISSPELT else "similar names: ask"))
    else:
        out = [f"Verify the {label} of {d}: {v}" for d, v, _ in rows]
    return list(dict.fromkeys(out))[: X.MOST_OPTIONS]


@pytest.mark.parametrize("seed", range(3))
def test_options_against_all_pairs(spark, seed):
    r = random.Random(seed)
    rows, want = [], {}
    for k in range(150):
        values = r.choice([[450.0, 448.5], [10.0, 10.001, 12.0], [0.0, 3.0], [1.0, 2.0, 3.0, 4.0, 7.0, 9.0], ["Seller Mills", "Seller Mils", "Other"], ["A", "B", "a"], [5.0, "x"], [None]])
        weights = [1, *([r.choice([0.05, 1])] * (len(values) - 1))]
        types = TYPES[: r.randrange(1, 8)]
        sources = []
        for _ in range(r.randrange(1, 41)):
            v = r.choices(values, weights)[0]
            sources.append((v if isinstance(v, float) else None, v if isinstance(v, str) else None, r.choice(types)))
        places = sorted(r.sample(range(1000), len(sources)))
        field = r.choice(["GROSS_WEIGHT", "CONSIGNEE_NAME"])
        rows += [(k, field, s, *x) for s, x in zip(places, sources)]
        want[k] = plain_options(field, sources)
    r.shuffle(rows)
    got = {x["shipment_id"]: x["options"] for x in X.counterfactuals(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    assert got == want


def test_the_eleventh_source(spark):
    """Ten sources of five types that agree, and a last one that doesn't."""
    sources = [(450.0, None, TYPES[i % 5]) for i in range(10)] + [(448.5, None, "delivery_order")]
    rows = [(1, "GROSS_WEIGHT", i, *x) for i, x in enumerate(sources)]
    assert X.counterfactuals(spark.createDataFrame(rows, SCHEMA)).first()["options"] == plain_options("GROSS_WEIGHT", sources)


def test_many_sources_and_values(spark):
    rows = [(1, "GROSS_WEIGHT", i, float(i % 20_000), None, TYPES[i % 7]) for i in range(60_000)]
    o = X.counterfactuals(spark.createDataFrame(rows, SCHEMA)).first()["options"]
    assert o == plain_options("GROSS_WEIGHT", [(n, x, t) for _, _, _, n, x, t in rows[:12]])


def test_options_in_one_exchange(spark):
    """A field's options come from one pass over its shipment; the way of fields with many assertions gives the same."""
    for name in ("xai05_counterfactuals", "top05_capped_options", "xai06_text_options"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan, name


def test_same_as_many_assertions(spark):
    r = random.Random(5)
    rows = [(r.randrange(40), r.choice("AB"), i, *r.choice([(1.0, None), (2.0, None), (0.0, None), (None, "Star Mill"), (None, "Star Mills"), (None, "moon"), (None, None)]), r.choice(TYPES)) for i in range(600)]
    rows += [(k, "C", i, *r.choice([(1.0, None), (2.5, None), (None, "x")][: 2 + k % 2]), r.choice(TYPES)) for k in range(40) for i in range(5)]
    rows += [(k, "D", i, None, r.choice(["Star Mill", "Star Mills", "moon"]), r.choice(TYPES)) for k in range(40) for i in range(5)]
    a = spark.createDataFrame(rows, SCHEMA).repartition(3)
    every = {large: sorted(map(str, X.counterfactuals(a, large=large).collect())) for large in (0, 6, X.LARGE)}
    assert every[0] == every[6] == every[X.LARGE] and len(every[0]) == a.select("shipment_id", "entity_type").distinct().count()
    kind = "conflict_type='text_mismatch'"
    assert sorted(map(str, X.counterfactuals(a, kinds=("text_mismatch",), large=6).collect())) == [x for x in every[0] if kind in x]


def test_graphs(spark, tmp_path):
    """A shipment's graph has the nodes and edges of its assertions, repeated ones once; it comes from one exchange and is written compressed."""
    r = random.Random(2)
    rows = [(k, r.choice("AB"), r.randrange(1, 5), f"{k}-{r.randrange(1, 5)}") for k in range(2000) for _ in range(r.randrange(1, 12))]
    a = spark.createDataFrame(rows, "shipment_id long, entity_type string, seq long, document_id string").repartition(3)
    g = X.graphs(a)
    for array, flat in (("nodes", X.nodes(a, ["shipment_id"])), ("edges", X.edges(a, ["shipment_id"]))):
        assert sorted(map(tuple, g.selectExpr("shipment_id", f"inline({array})").collect())) == sorted(map(tuple, flat.collect()))
    documents = B.graph_documents(X.graphs(assertions(spark, "/root/testdata/sf0.001")))
    plan = documents._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "Join" not in plan
    B.write_documents(documents, str(tmp_path / "graphs"))
    size = sum(p.stat().st_size for p in (tmp_path / "graphs").glob("part-*"))
    assert size * 5 < documents.selectExpr("sum(length(body))").first()[0]
