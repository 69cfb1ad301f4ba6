"""A tree of uploaded files and the dossiers that intake accepts of it."""

from cargolens.operators import ledger as K
from cargolens.sources.listing import file_listing


def test_dossiers_of_a_tree(spark, tmp_path):
    tree = {"d1": ["1_invoice.pdf", "2_packing list.PDF"], "d2": ["a.pdf", "notes.txt"], "sub/d3": ["x_y_z.pdf"], "d4": ["scan+1.pdf"], "d5": ["noext"]}
    for folder, names in tree.items():
        (tmp_path / folder).mkdir(parents=True)
        for n in names:
            (tmp_path / folder / n).write_bytes(b"%PDF" * len(n))
    files = file_listing(spark, str(tmp_path))
    assert "content" not in files.columns and "content" not in files._jdf.queryExecution().executedPlan().toString()
    got = {(r["dossier_id"], r["name"]): r["size"] for r in files.collect()}
    assert got == {(f.rsplit("/", 1)[-1], n): 4 * len(n) for f, names in tree.items() for n in names}
    assert {r["dossier_id"]: (r["accepted"], r["n_files"]) for r in K.intake(files).collect()} == {"d1": (True, 2), "d2": (False, 2), "d3": (True, 1), "d4": (True, 1), "d5": (False, 1)}
    named = {r["name"]: (r["file_id"], r["file_name"]) for r in K.stored_names(files).collect()}
    assert named["1_invoice.pdf"] == ("1", "invoice.pdf") and named["x_y_z.pdf"] == ("x", "y_z.pdf") and named["noext"] == ("noext", None)
    assert file_listing(spark, str(tmp_path), "*.txt").count() == 1
