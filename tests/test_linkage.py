from difflib import SequenceMatcher

from cargolens.operators import linkage as L
from cargolens.plans import catalog

TEXTS = ["Cotton", "shirts", "Cott0n", "cotton shirts blue", "x", "Widgets", "shirts", "widgexs", "Invoice"]


def test_link_against_brute_force(spark):
    tokens = spark.createDataFrame([(1, 1 + i // 4, i, t, 0, 20 * i, 90, 20 * i + 12, 0.9) for i, t in enumerate(TEXTS)], "document_id long, page long, pos long, text string, x1 long, y1 long, x2 long, y2 long, confidence double")
    values = ["Wid0ets", "shirts", "Inv0ice", "cotton", "zzz"]
    got = {r["value"]: (r["pos"], round(r["score"], 6)) for r in L.link(spark.createDataFrame([(1, v) for v in values], "document_id long, value string"), tokens).collect()}
    want = {}
    for v in values:
        score = lambda t: 1.0 if v.lower() in t else 0.85 if t in v.lower() and len(t) > 3 else SequenceMatcher(None, v.lower(), t).ratio()  # noqa: B023, E731
        best = max((round(score(t.lower()), 6), -i) for i, t in enumerate(TEXTS))
        if best[0] >= L.THRESHOLD:
            want[v] = (-best[1], best[0])
    assert got == want
    items = [(1, 1, "Cott0n shirts"), (1, 2, "Widgets of steel"), (1, 3, "Invo1ce")]
    rows = {r["description"]: r for r in L.row_boxes(spark.createDataFrame(items, "document_id long, page long, description string"), tokens).collect()}
    for _, page, d in items:
        long = [w for w in d.lower().split() if len(w) > 4]
        s = {i: max(sum(w in t.lower() for w in long) / max(len(long), 1), SequenceMatcher(None, d.lower()[:40], t.lower()).ratio()) for i, t in enumerate(TEXTS) if 1 + i // 4 == page}
        i = max(s, key=lambda k: (s[k], -k))
        assert (rows[d]["pos"], round(rows[d]["score"], 6), rows[d]["x1"], rows[d]["y1"], rows[d]["x2"], rows[d]["y2"]) == (i, round(s[i], 6), 0, 20 * i, 595, 20 * i + 17)


SCHEMA = "document_id long, page long, pos long, text string, x1 long, y1 long, x2 long, y2 long, confidence double"


def best(value, tokens, threshold):
    """The best of a document's tokens, ties to the first; None if none reaches the threshold."""
    v, found = value.lower().strip(), []
    for t in tokens:
        text = (t[3] or "").lower().strip()
        if v and text:
            score = 1.0 if v in text else 0.85 if text in v and len(text) > 3 else SequenceMatcher(None, v, text).ratio()
            if score >= threshold:
                found.append((score, -t[2], t))
    return max(found)[2] if found else None


def test_parts_and_pages_against_brute_force(spark):
    texts = {1: TEXTS, 2: ["Trader", "Tr4der", "42", "Ltd", "steel", "pipes", None, "", "Colombo"], 3: ["alone"]}
    tokens = [(d, 1 + i // 3, i, t, 7 * i, 20 * i, 7 * i + 50, 20 * i + 12, (90 - i) / 100) for d, ts in texts.items() for i, t in enumerate(ts)]
    values = [(1, "Cotton shirts"), (1, "blue widgets"), (1, "in shirts x blue y widgets of wool"), (1, "x shirts"), (1, "q"), (2, "Trader 42 Ltd"), (2, "stee1 pipes  Col0mbo"), (2, "nothing here"), (2, None), (2, ""), (3, "alone alone"), (4, "Cotton")]
    t, v = spark.createDataFrame(tokens, SCHEMA), spark.createDataFrame([*values, values[0]], "document_id long, value string")
    of = {d: [x for x in tokens if x[0] == d] for d in range(1, 5)}

    want = {}
    for d, value in values:
        if whole := best(value or "", of[d], L.THRESHOLD):  # one token for the whole value comes first
            want[d, value] = (*(whole[k] for k in (1, 4, 5, 6, 7, 8)), 1)
            continue
        parts = [best(w, of[d], L.PART_THRESHOLD) for w in (value or "").split() if len(w) >= 2]
        parts = {x[2]: x for x in parts if x}.values()
        if parts:
            want[d, value] = (*(min(x[k] for x in parts) for k in (1, 4, 5)), *(max(x[k] for x in parts) for k in (6, 7)), min(x[8] for x in parts), len(parts))
    got = L.link_parts(v, t).collect()
    assert {(r["document_id"], r["value"]): (r["page"], r["x1"], r["y1"], r["x2"], r["y2"], r["confidence"], r["n_tokens"]) for r in got} == want and len(got) == len(want) >= 5

    want = {(d, value): (best(value or "", of[d], L.THRESHOLD) or (d, 1))[1] for d, value in values}
    got = L.value_pages(v, t).collect()
    assert {(r["document_id"], r["value"]): r["page"] for r in got} == want and len(got) == len(want) and max(want.values()) > 1


def test_linkage_of_empty_tables(spark):
    t, v = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "document_id long, value string")
    assert all(f(v, t).count() == 0 for f in (L.link, L.link_parts, L.value_pages))


def test_candidates_lose_no_pair(spark):
    """Both ways, few pairs and signatures, keep every pair that reaches the threshold; long documents make far fewer than all pairs."""
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("etaoinshrdlucmfwypvbgk0é") for _ in range(r.choice([1, 2, 3, 4, 5, 6, 8, 12, 20])))
    right = {(d, word()) for d in (1, 2) for _ in range(150)}
    left = {(d, "".join(c if r.random() < 0.8 else r.choice("xyz") for c in w)) for d, w in right}
    n, h = spark.createDataFrame(sorted(left), "document_id long, n string"), spark.createDataFrame(sorted(right), "document_id long, h string")
    everything = [(d, a, b, SequenceMatcher(None, a, b).ratio()) for d, a in left for e, b in right if d == e]
    for threshold in (L.ROW_THRESHOLD, L.THRESHOLD, L.PART_THRESHOLD):
        need = {(d, a, b) for d, a, b, s in everything if s >= threshold}
        for few in (0, 10**9):
            met = {(x["document_id"], x["n"], x["h"]): x["most"] for x in L.candidates(n, h, ["document_id"], threshold, few).collect()}
            assert need <= met.keys() and all(met[d, a, b] >= s - 1e-9 for d, a, b, s in everything if s >= threshold)
            assert few or threshold < 0.5 or len(met) < 0.5 * len(everything)


def test_long_documents_link_the_same(spark, monkeypatch):
    tokens = [(1, 1, i, f"word{i % 50}x{i}", 0, 0, 1, 1, 0.9) for i in range(120)]
    values = [(1, f"w0rd{i % 50}x{i}") for i in range(0, 120, 3)] + [(1, f"word{i}") for i in range(5)]
    t, v = spark.createDataFrame(tokens, SCHEMA), spark.createDataFrame(values, "document_id long, value string")
    got = {}
    for few in (0, 10**9):
        monkeypatch.setattr(L, "FEW_PAIRS", few)
        got[few] = {(x["value"], x["pos"], x["score"]) for x in L.link(v, t).collect()}
    want = {(value, b[2]) for _, value in values if (b := best(value, tokens, L.THRESHOLD))}
    assert got[0] == got[10**9] and {x[:2] for x in got[0]} == want


def test_linkage_of_words_in_one_exchange(spark):
    """Words lie by document once their texts are dealt out: no pairs, no grams, no joins."""
    for name in ("join07_link_values", "join10_row_boxes"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange") == 1 and "Join" not in plan, name


def test_finder_and_parts():
    import random

    r = random.Random(3)
    word = lambda n: "".join(r.choice("aab c\0é") for _ in range(n))
    for n_values in (1, 10**12):  # without and with an index of grams
        texts = [word(r.randrange(1, 9)) for _ in range(60)]
        find, at = L.finder(texts, n_values), {x: i for i, x in reversed(list(enumerate(texts)))}
        for v in [word(r.randrange(1, 12)) for _ in range(400)]:
            assert find(v) == next((i for i, t in enumerate(texts) if v in t), None)
            assert L.part_of(v, at) == next((i for i, t in enumerate(texts) if len(t) > 3 and t in v), None)


def test_large_pages_and_repeats(spark):
    """Pages with many pairs take joins, the others a fold; repeated rows and small batches change nothing."""
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("etaoinshr ") for _ in range(r.choice([3, 8, 20, 60])))
    tokens = [(d, p, i, word(), 0, 20 * i, 90, 20 * i + 12, 0.9) for d in (1, 2) for p in (1, 2) for i in range(12)]
    items = [(d, p, t[:3] + "0" + t[4:]) for d, p, i, t, *_ in tokens if i % 2] + [(1, 1, None), (1, 2, " "), (3, 1, "gone")]
    t, v = spark.createDataFrame(tokens * 2, SCHEMA).repartition(3), spark.createDataFrame(items, "document_id long, page long, description string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = [sorted(map(str, L.row_boxes(v, t, few=few).collect())) for few in (0, 300, 10**6)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] == got[2] and len(got[0]) > 10
