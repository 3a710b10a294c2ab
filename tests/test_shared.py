"""The shared folder, and the entry module without the corpus operators."""

import os
import subprocess
import sys

import pytest

from marram.sources import shared

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["xxhash", "marram.llm", "corpus_pipeline", "marram.llm.registry"])
def test_entry_without_a_module(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'score_full' in q and len(q) > 55; assert set(e.oracle_sql()) <= set(q); print(sum(k.startswith('op') for k in q), 'pipeline' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    if os.path.isdir(os.path.join(ROOT, "marram", "llm")) and missing == "corpus_pipeline":
        assert done.stdout.split()[-1] == "False"


def test_rounds_keep_the_last_results(spark):
    rounds, rows = shared.Rounds(2), []
    for k in range(4):
        rows.append(rounds.write(spark.range(k), "round"))
    assert [rows[k].count() for k in (2, 3)] == [2, 3]
    assert len(rounds.paths) == 2 and not os.path.exists(rows[0].inputFiles()[0].removeprefix("file://") if rows[0].inputFiles() else "/nowhere")


def test_no_private_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        shared.scratch(Session())


def test_tables_count_as_large_as_they_are_in_memory(spark):
    """Two million numbers in order are a small file; a join must not take them for small and broadcast them."""
    rows = shared.materialise(spark.range(2_000_000).selectExpr("id", "1L as c"))
    plan = rows.join(rows.withColumnRenamed("c", "d"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_a_search_leaves_no_level_behind(spark):
    from marram.operators import paths

    where = shared.scratch(spark).removeprefix("file://")
    left = lambda: sum(x.startswith("level-") for x in os.listdir(where))
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "u long, v long")
    before = left()
    got = {r.node: (r.reached, r.total, r.farthest) for r in paths.distance_sums(edges).collect()}
    assert got == {i: (6, sum(abs(i - j) for j in range(7)), max(i, 6 - i)) for i in range(7)}
    assert left() == before and spark.conf.get(shared.SHUFFLES_GO, "false") == "false"
