"""What a spreading simulation writes: what is reached anew, several seed sets to a row, pairs by doubling."""

from pyspark.sql import functions as F

from marram.operators import spread
from marram.sources import shared


def test_steps_write_what_is_new_and_sets_share_rows(spark, monkeypatch):
    n, rows, write = 24, {}, shared._write

    def counted(df, name):
        out = write(df, name)
        rows.setdefault(name, []).append(out[0].count())
        return out

    monkeypatch.setattr(shared, "_write", counted)
    chain = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    seeds = spark.createDataFrame([("a", 0), ("b", 0), (None, 0)], "set_id string, node long")
    plan = spread.runs(spark, 2, 10).select("run", F.lit(1.0).alias("beta"))
    got = spread.infections(chain, seeds, plan)
    assert got.groupBy("set_id", "run").agg(F.count("*").alias("n"), F.max("step").alias("far")).collect() and got.where(F.col("node") != F.col("step")).isEmpty()
    sizes = spread.final_sizes(got).collect()
    assert len(sizes) == 60 and {r.n_infected for r in sizes} == {n} and {r.set_id for r in sizes} == {"a", "b", None}
    assert sum(rows["ring"]) == n  # a row a node for three sets of twenty runs, and none again
    assert "infected" not in rows and sum(rows.get("reached", [])) + sum(rows.get("met", [])) < 5 * n
    assert spread.infections(chain, seeds, plan, 3).agg(F.max("step")).first()[0] == 3


def test_more_runs_than_a_word_and_nested_rates(spark):
    edges = spark.createDataFrame([(a, b) for a in range(9) for b in range(a + 1, 9) if (a * b) % 4 != 1], "u long, v long")
    seeds = spark.createDataFrame([("x", 0), ("y", 3), ("y", 5)], "set_id string, node long")
    plan = spread.runs(spark, 3, 15).select("run", F.explode(F.array(F.lit(0.1), F.lit(0.3))).alias("beta"))
    ties = edges.union(edges.select("v", "u")).crossJoin(plan)
    opened = {(r.run, r.beta, r.u, r.v) for r in ties.where(spread.uniform("run", "u", "v") < F.col("beta")).collect()}
    want = {}
    for run, beta in [tuple(r) for r in plan.collect()]:
        for name, start in (("x", {0}), ("y", {3, 5})):
            seen, ring, step = dict.fromkeys(start, 0), start, 0
            while ring:
                step += 1
                ring = {v for u in ring for v in range(9) if (run, beta, u, v) in opened and v not in seen}
                seen |= dict.fromkeys(ring, step)
            want |= {(name, run, beta, node, at): 1 for node, at in seen.items()}
    got = [(r.set_id, r.run, r.beta, r.node, r.step) for r in spread.infections(edges, seeds, plan).collect()]
    assert sorted(got) == sorted(want)


def test_single_nodes_on_a_long_way_are_closed_by_doubling(spark, monkeypatch):
    names, write = [], shared._write

    def counted(df, name):
        names.append(name)
        return write(df, name)

    monkeypatch.setattr(shared, "_write", counted)
    n = 48
    ring = spark.range(n).select(F.col("id").alias("u"), ((F.col("id") + 1) % n).alias("v"))
    plan = spread.runs(spark, 1, 6).select("run", F.lit(0.5).alias("beta"))
    ties = ring.union(ring.select("v", "u")).crossJoin(plan)
    opened = {(r.run, r.u, r.v) for r in ties.where(spread.uniform("run", "u", "v") < 0.5).collect()}
    sizes = dict.fromkeys(range(n), 0)
    for run in range(6):
        for v in range(n):
            seen, todo = {v}, [v]
            while todo:
                x = todo.pop()
                near = [y for y in ((x + 1) % n, (x - 1) % n) if (run, x, y) in opened and y not in seen]
                seen.update(near)
                todo += near
            sizes[v] += len(seen)
    nodes = spark.range(n + 1).withColumnRenamed("id", "node")  # the last has no ties
    want = {v: s / 6 for v, s in sizes.items()} | {n: 1.0}
    found = lambda: {r.node: r.score for r in spread.single_node_sizes(ring, nodes, plan).collect()}
    assert found() == want and "ring" not in names and names.count("pairs") <= 6
    monkeypatch.setattr(spread, "PAIRS", 1)
    assert found() == want and "ring" in names


def test_counts_equal_the_rows_they_stand_for(spark):
    """Infected nodes counted as bits, by set, run and settings, are as many as the rows of the spread, for more cases than a word holds."""
    edges = spark.range(1, 40).selectExpr("id AS u", "id % 5 AS v").where("u <> v")
    seeds = spark.createDataFrame([(s, x) for s, nodes in {"a": [0, 5], "b": [39], "c": [10, 20, 30]}.items() for x in nodes], "set_id string, node long")
    plan = spread.runs(spark, 2, 20).selectExpr("run", "explode(array(0.2D, 0.45D)) AS beta")
    for settings, rows in ((plan, spread.infections), (plan.selectExpr("run", "beta", "0.5D AS gamma"), spread.infections_with_recovery)):
        want, got = spread.final_sizes(rows(edges, seeds, settings)), spread.infected_counts(edges, seeds, settings)
        assert want.columns == got.columns and got.count() == 240
        assert want.exceptAll(got).isEmpty()
