"""The command line on two small network files, and LaTeX tables."""

import pytest

from marram import __main__ as shell
from marram.sources import networks as files
from marram.sources.store import Store


def test_lists_of_names():
    known = ["a", "b", "c"]
    assert shell.names(None, known, "x") == shell.names(" ALL ", known, "x") == known
    assert shell.names("c, a,c,", known, "x") == ["c", "a"]
    for wrong in ("a,d", " , "):
        with pytest.raises(ValueError):
            shell.names(wrong, known, "networks")


def test_scores_are_kept_made_again_and_verified(spark, tmp_path, capsys):
    folder, store = tmp_path / "networks", f"{tmp_path}/store"
    folder.mkdir()
    (folder / "star.edges").write_text("% comment\n10 20\n10 30\n10 40\n77 78\n")
    (folder / "path.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n4 4 2\n2 1\n3 2\n")
    assert shell.main(["networks", str(folder)]) == 0
    assert [line.split("\t")[0] for line in capsys.readouterr().out.splitlines()] == ["path", "star"]
    asked = ["score", str(folder), store, "--methods", "degree"]
    assert shell.main(asked) == 0
    assert capsys.readouterr().out.splitlines() == ["path\tdegree\tmade", "star\tdegree\tmade"]
    assert shell.main([*asked, "--networks", "star", "--verify"]) == 0
    assert capsys.readouterr().out.splitlines() == ["star\tdegree\tkept"]
    assert shell.main([*asked, "--networks", "star", "--force"]) == 0
    assert capsys.readouterr().out.splitlines() == ["star\tdegree\tmade"]
    got = {(r.graph, r["rank"]): (r.node, r.score) for r in shell.ranks(spark, store).collect()}
    assert got[("star", 1)] == (0, 1.0) and got[("path", 1)] == (1, 1.0) and len(got) == 7
    # A stored ranking that lacks a node is told.
    kept = Store(spark, store)
    digest = {r.graph: r.digest for r in spark.read.parquet(f"{store}/networks/*").collect()}["star"]
    short = spark.createDataFrame([("degree", 0, 1.0), ("degree", 1, float("nan"))], "method string, node long, score double")
    short.write.mode("overwrite").parquet(kept.path("scores", f"{digest}-degree"))
    assert shell.main([*asked, "--networks", "star", "--verify"]) == 1
    assert capsys.readouterr().out.splitlines() == ["star\tdegree\t1 of 4 scores"]
    assert shell.main([*asked, "--networks", "moon"]) == 2
    assert shell.main(["ranks", store, f"{tmp_path}/out"]) == 0
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").columns == ["graph", "method", "node", "score", "rank"]


def test_latex(spark):
    df = spark.createDataFrame([("a_b & c", 1, 0.5), (None, 2, None)], "name string, n int, x double")
    lines = files.latex(df.orderBy("n"), 2).splitlines()
    assert lines[0] == r"\begin{tabular}{lrr}" and lines[2] == r"name & n & x \\"
    assert lines[4:6] == [r"a\_b \& c & 1 & 0.50 \\", r" & 2 &  \\"]
