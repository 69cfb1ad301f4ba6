"""Tables whose rows are many times their files aren't broadcast."""

from pyspark.sql import functions as F

from cargolens.operators.extract import by_label
from cargolens.operators.linkage import contained
from cargolens.plans import catalog
from cargolens.sources.bindings import papers, tokens
from cargolens.sources.store import kept

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_exploded_rows_are_shuffled(spark):
    for of, key in ((papers, ["document_id", "pos"]), (tokens, ["document_id", "pos"])):
        t = of(spark, SF)
        assert "SortMergeJoin" in plan(t.join(of(spark, SF), key)) and "BroadcastHashJoin" not in plan(t.filter("pos > 1").join(of(spark, SF), key))


def test_lines_of_papers_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in plan(catalog.queries()["ext03_combined"](spark, SF))


def test_written_tables_are_not_broadcast(spark):
    t = kept(papers(spark, SF).groupBy("document_id").count(), "counts")
    assert "BroadcastHashJoin" not in plan(t.join(spark.range(10), t["document_id"] == F.col("id")))


def test_lines_of_papers_are_made_in_many_tasks(spark):
    """The file of the orders has one part; lines joined by paper aren't dealt out again."""
    assert papers(spark, SF).rdd.getNumPartitions() == 4
    both = papers(spark, SF).join(papers(spark, SF).select("document_id", "pos"), ["document_id"])
    assert "hashpartitioning(document_id" not in both._jdf.queryExecution().executedPlan().toString()


def test_containment_of_few_pairs_takes_no_grams(spark):
    n = spark.createDataFrame([(1, "trader")], "document_id long, n string")
    h = spark.createDataFrame([(1, "trader 5 ltd", 7)], "document_id long, h string, pos long")
    found = contained(n, h, ["document_id"])
    assert [tuple(x) for x in found.select("document_id", "n", "h", "pos").collect()] == [(1, "trader", "trader 5 ltd", 7)]
    assert "substring" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_label_texts_are_made_once(spark):
    """The ratios of texts to labels are taken before the joins that use them, not once for each join."""
    assert "EvalPython" not in plan(by_label(papers(spark, SF)))
