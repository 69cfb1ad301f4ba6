"""Keywords are counted in whole texts, not only in the first pages."""

import os

from cargolens.plans import catalog

from .compare import TABLES, database, differences


def test_keywords_far_behind_the_first_pages(spark, tmp_path):
    docs = [(1, "x " * 5000 + "licence ung .", "en", "s", 1), (2, "que " + "x " * 900 + "sch", "de", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for t in set(TABLES) - {"documents"}:
        os.symlink(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    q, sql, db = catalog.queries(), catalog.oracle_sql(), database(str(tmp_path))
    assert {r["keyword"]: r["n"] for r in q["join11_keyword_hits"](spark, str(tmp_path)).collect()} == {"licen": 1, "ung ": 1, "que ": 1, "sch": 1}
    assert all(differences(q[n](spark, str(tmp_path)), db, sql[n]) == [] for n in ("join11_keyword_hits", "win06_normalised_scores", "agg01_classify"))
