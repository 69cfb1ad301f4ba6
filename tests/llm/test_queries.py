import os

import pytest

from cargolens.llm import quality_rules, queries

from ..compare import database, differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    assert differences(queries.queries()[name](spark, SF), database(SF), queries.oracle_sql()[name]) == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_policy_against_labels(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no such tables")
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id").distinct()
    judged = quality_rules.ledger(spark.read.parquet(f"{sf}/documents.parquet").join(good, "doc_id", "left_semi")).filter(quality_rules.passes(1))
    assert judged.count() > 0 and [r["doc_id"] for r in judged.filter(~quality_rules.passes()).collect()] == []


def test_pipeline(spark):
    import corpus_pipeline

    rows = database(SF).execute("SELECT doc_id, text FROM documents").fetchall()
    got = corpus_pipeline.run(spark, SF).collect()
    texts = dict(rows)
    kept = {r["doc_id"] for r in got}
    assert kept and len({texts[i] for i in kept}) == len(kept)
    assert sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(stage(spark, docs, SF).columns == docs.columns for _, stage in corpus_pipeline.STAGES[:-1])


def _sequences(spark, sf_dir, monkeypatch, stages):
    import corpus_pipeline

    with monkeypatch.context() as m:
        m.setattr(corpus_pipeline, "STAGES", stages)
        return {(r["doc_id"], r["start"]): (r["sequence_id"], r["offset"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}


def test_pipeline_keeps_the_mix(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from cargolens.llm import mixing, packing

    rows = [(i, f"word{i} " * (1 + 7 * i % 40), "ab"[i % 4 == 0]) for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "pack", lambda *a, **k: packing.pack(*a, **k, capacity=256, shard_pieces=50))
    last = corpus_pipeline.STAGES[-2:]
    with_mix, without = (_sequences(spark, str(tmp_path), monkeypatch, s) for s in (last, last[1:]))
    swapped = [("mixing", lambda s, d, _: mixing.in_mixed_order(d, {"a": 1.0, "b": 30.0})), last[1]]
    other = _sequences(spark, str(tmp_path), monkeypatch, swapped)
    assert with_mix.keys() == without.keys() == other.keys() and with_mix != without and with_mix != other
    for order, weights in ((with_mix, None), (other, {"a": 1.0, "b": 30.0})):
        position = {r["doc_id"]: r["position"] for r in mixing.schedule(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights).collect()}
        shards = {}
        for (i, _), (sequence, _) in order.items():
            shards.setdefault(sequence >> 32, []).append(position[i])
        spans = [(min(v), max(v)) for _, v in sorted(shards.items())]
        assert len(spans) > 5 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
