"""Run times: their shape, their counts and their failures; seconds themselves are whatever they are."""

import math

import pytest
from pyspark.sql import functions as F

from marram.operators import cliques as cl
from marram.operators import graph, ranking
from marram.plans import runtime
from marram.sources.shared import materialise


@pytest.fixture(scope="module")
def plan():
    return runtime.conditions(["ws", "ba"], [24, 40], [4])


@pytest.fixture(scope="module")
def times(spark, plan):
    return materialise(runtime.condition_times(spark, plan[:2], others=["degree", "no_such_method"]), "times")


def test_conditions(plan):
    assert [c.name for c in plan] == ["ws-24-4-0.3", "ws-40-4-0.3", "ba-24-4", "ba-40-4"]
    assert len({c.seed for c in plan}) == 4 and plan[0].seed == runtime.Condition("ws", 24, 4).seed
    assert len(runtime.conditions(["ws", "er"], [10], [4], 2, (0.1, 0.2))) == 2 * 2 + 2


def test_three_stages_of_two_sizes(spark, plan, times):
    table = runtime.wide(runtime.summary(times, ["model", "nodes"]), ["model", "nodes"], [*runtime.STAGES, "degree"])
    assert table.columns == ["model", "nodes", "preparation", "cliques", "scores", "degree"]
    rows = table.collect()
    assert [(r.model, r.nodes) for r in rows] == [("ws", 24), ("ws", 40)]
    assert all(x > 0 for r in rows for x in r[2:])
    for c in plan[:2]:
        e = materialise(c.edges(spark), "ws")
        kept = graph.largest_component(graph.simple_edges(e))
        got = {r.name: r.rows for r in times.where(F.col("graph") == c.name).collect()}
        assert got == {"preparation": kept.count(), "cliques": cl.maximal_cliques(kept).count(), "scores": graph.degrees(kept).count(), "degree": graph.degrees(kept).count(), "no_such_method": None}


def test_runs_are_counted_and_failures_kept(spark, times):
    for r in times.collect():
        if r.name == "no_such_method":
            assert r.error.startswith("ValueError") and r.rows is None
        else:
            assert r.error == "" and r.jobs > 0 and r.stages >= r.jobs and r.tasks >= r.stages and r.task_seconds > 0
    told = {(r.nodes, r.name): r for r in runtime.summary(times, ["nodes"]).collect()}
    lost, good = told[24, "no_such_method"], told[24, "degree"]
    assert (lost.instances, lost.successful, lost.failed, lost.mean) == (1, 0, 1, None)
    assert (good.instances, good.successful, good.failed, good.half_width) == (1, 1, 0, 0.0)


def test_a_failed_stage_fails_what_needs_it(spark):
    bad = spark.range(1).select(F.raise_error(F.lit("no")).cast("long").alias("u"), F.col("id").alias("v"))
    with pytest.raises(Exception, match="no"):
        runtime.stage_times(spark, "bad", lambda: bad)
    never = [runtime.Condition("ws", 6, 6), runtime.Condition("no_model", 6, 2)]
    rows = runtime.condition_times(spark, never).collect()
    assert [(r.name, r.error[:10], r.seconds) for r in rows] == [("generation", "ValueError", None)] * 2
    texts = spark.createDataFrame([("a", "b")], "u string, v string")  # ids that aren't numbers
    rows = {r.name: r.error for r in runtime.stage_times(spark, "texts", lambda: texts).collect()}
    assert all(rows[s] for s in runtime.STAGES) and "an earlier stage failed" in rows["cliques"] and "an earlier stage failed" in rows["scores"]
    with pytest.raises(ValueError):
        runtime.condition_times(spark, [])


def test_summary_by_instance_or_pooled(spark):
    rows = [("a", "s", 0, 0, 1.0), ("a", "s", 0, 1, 3.0), ("a", "s", 1, 0, 5.0), ("a", "s", 1, 1, None)]
    df = spark.createDataFrame(rows, "graph string, name string, instance int, repeat int, seconds double")
    df = df.withColumn("task_seconds", F.col("seconds")).withColumn("error", F.when(F.col("seconds").isNull(), "lost").otherwise(""))
    by, pooled = runtime.summary(df, ["graph"]).first(), runtime.summary(df, ["graph"], per_instance=False).first()
    assert (by.instances, by.successful, by.failed, by.mean, by.median) == (2, 2, 1, 3.5, 3.5)
    assert (pooled.mean, pooled.median, pooled.successful) == (3.0, 3.0, 2)
    assert by.half_width == pytest.approx(12.706205 * math.sqrt(4.5) / math.sqrt(2), rel=1e-5)


def test_graph_figures(spark, plan):
    figures = materialise(runtime.graph_figures(spark, plan), "figures")
    assert figures.count() == 4
    for c in (plan[0], plan[3]):
        kept = materialise(graph.largest_component(graph.simple_edges(c.edges(spark))), "kept")
        want, got = graph.summary(kept).first(), figures.where(F.col("graph") == c.name).first()
        assert (got.n_nodes, got.n_edges) == (want.n_nodes, want.n_edges)
        assert (got.clustering, got.transitivity, got.density) == pytest.approx((want.clustering, want.transitivity, want.density))
        assert got.degeneracy == ranking.core_numbers(kept).agg(F.max("score")).first()[0]
        assert got.retained == pytest.approx(want.n_nodes / c.nodes)
    table = runtime.graph_summary(figures).collect()
    assert [r.graph for r in table] == ["ba-24-4", "ba-40-4", "ws-24-4-0.3", "ws-40-4-0.3"] and all(r.instances == 1 and r.n_nodes_half_width == 0 for r in table)


def test_environment(spark):
    told = {r.item: r.value for r in runtime.environment(spark, sizes=[24, 40]).collect()}
    assert told["sizes"] == "[24, 40]" and told["Spark"] == spark.version and told["spark.sql.shuffle.partitions"] == "4"
