"""Amounts at the limit of a rule, and the rate that declarations are made at."""

import os

import duckdb
import pytest

from cargolens.operators import rules as R
from cargolens.plans import catalog

from .compare import database, differences

SF = "/root/testdata/sf0.1"


def test_the_last_bits_of_a_sum_do_not_decide(spark):
    t = [top - 1 + k / 100 for top in (1024, 8192) for k in range(100)]  # a sum beyond a power of two is rounded
    rows = [(k, x, 1.0, 1.0, term, x + 1.0) for k, x in enumerate(t) for term in ("CIF", "DAP")]
    rows += [(k, x, 3.0, 1.0, "FOB", x + 3.0) for k, x in enumerate(t)] + [(1000, 10.0, 0.0, 0.0, "CIF", 11.01)]
    f = spark.createDataFrame(rows, "k long, total double, freight double, insurance double, incoterm string, declared double")
    assert [r["k"] for r in R.cif_inconsistent(f).collect()] == [1000]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_declarations_of_shipments_whose_documents_state_a_rate(spark, tmp_path):
    db = duckdb.connect()
    few = f"SELECT l_orderkey FROM '{SF}/lineitem.parquet' GROUP BY 1 HAVING count(*) > 11"
    for t, where in (("lineitem", f"l_orderkey IN ({few})"), ("orders", f"o_orderkey IN ({few})"), ("part", "true"), *((t, "true") for t in "region nation customer supplier events documents embeddings pages benchmark labels conversations".split())):
        if where == "true":
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
        else:
            db.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet' WHERE {where}) TO '{tmp_path}/{t}.parquet'")
    name = "snk11_declarations"
    assert differences(catalog.queries()[name](spark, str(tmp_path)), database(str(tmp_path)), catalog.oracle_sql()[name]) == []
