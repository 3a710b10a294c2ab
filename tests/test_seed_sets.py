"""Seed sets of many rankings at once: distances, similarities, ties and leading nodes against plain versions."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marram.operators import collection, controls, methods, paths, statistics
from marram.plans import study
from marram.plans.many import QUERIES


def distances(near, start):
    d, todo = {start: 0}, [start]
    for x in todo:
        for y in near[x]:
            if y not in d:
                d[y] = d[x] + 1
                todo.append(y)
    return d


@pytest.fixture(scope="module")
def tied():
    """A sparse graph in several pieces."""
    rng = random.Random(5)
    ties = sorted({tuple(sorted(rng.sample(range(700), 2))) for _ in range(800)})
    near = defaultdict(set)
    for u, v in ties:
        near[u].add(v), near[v].add(u)
    sets = {f"s{i}": rng.sample(sorted(near), size) for i, size in enumerate((1, 2, 9, 60))}
    sets["all"] = sorted(near)  # more than one block of 512 sources
    return ties, near, sets


def test_dispersions_and_similarities_of_all_sets(spark, tied):
    ties, near, sets = tied
    edges = spark.createDataFrame(ties, "u long, v long")
    rows = [(s, x) for s, own in sets.items() for x in own] + [("s2", sets["s2"][0]), (None, 1), ("s2", None)]
    table = spark.createDataFrame(rows, "set_id string, node long")
    got = {r.set_id: (r.k, r.mean_distance) for r in paths.set_dispersions(edges, table).collect()}
    alike = {r.set_id: (r.k, r.mean_jaccard) for r in paths.set_similarities(edges, table).collect()}
    assert set(got) == set(alike) == set(sets)
    far = {x: distances(near, x) for x in near}
    for s, own in sets.items():
        pairs = list(itertools.combinations(own, 2))
        want = sum(far[a].get(b, len(near)) for a, b in pairs) / len(pairs) if pairs else 0.0
        assert got[s] == (len(own), pytest.approx(want))
        same = sum(len(near[a] & near[b]) / len(near[a] | near[b]) for a, b in pairs) / len(pairs) if pairs else None
        assert alike[s] == (len(own), pytest.approx(same) if pairs else None)
    sizes = spark.createDataFrame([(s, 5000) for s in sets], "set_id string, n long")
    own = {r.set_id: r.mean_distance for r in paths.set_dispersions(edges, table, sizes).collect()}
    pairs = list(itertools.combinations(sets["s2"], 2))
    assert own["s2"] == pytest.approx(sum(far[a].get(b, 5000) for a, b in pairs) / len(pairs))


def test_controls_are_measured_over_all_their_pairs(spark, tied):
    """Candidates of 150 nodes have 11,175 pairs; two of them differ in a single node."""
    ties, near, _ = tied
    own = sorted(near)[:151]
    sets = {1: own[:150], 2: own[1:], 300: own[:1]}
    table = spark.createDataFrame([(c, x) for c, nodes in sets.items() for x in nodes], "candidate long, node long")
    got = {r.candidate: r.mean_distance for r in controls.mean_distances(spark.createDataFrame(ties, "u long, v long"), table).collect()}
    far = {x: distances(near, x) for x in own}
    for c, nodes in sets.items():
        pairs = list(itertools.combinations(nodes, 2))
        assert got[c] == (pytest.approx(sum(far[a].get(b, len(near)) for a, b in pairs) / len(pairs), abs=1e-12) if pairs else 0.0)


def test_searches_in_turns_give_the_same(spark):
    """With few rows at a time the blocks take their turns, and every sum stays."""
    from marram.operators import blocks

    up = spark.range(1, 5000).selectExpr("id AS u", "id % 40 AS v").where("u <> v").union(spark.range(1, 40).selectExpr("id AS u", "0L AS v"))
    arcs, sources = up.union(up.select("v", "u")), spark.range(5000).selectExpr("id AS node", "id AS source")

    def summed(most):
        ends = [blocks.sums(state) for _, state, done in blocks.searches(arcs, sources, most) if done]
        rows = [r for end in ends for r in end.groupBy("label").agg(F.sum("reached").alias("n"), F.sum("total").alias("total"), F.max("farthest").alias("far")).collect()]
        whole = defaultdict(lambda: (0, 0, 0))
        for r in rows:
            n, total, far = whole[r.label]
            whole[r.label] = (n + r.n, total + r.total, max(far, r.far))
        return len(ends), dict(whole)

    (one, whole), (turns, parts) = summed(None), summed(1)
    assert one == 1 and turns == 3 and whole == parts and len(whole) == 5000


def test_no_sets_and_no_ties(spark):
    edges = spark.createDataFrame([(1, 2)], "u long, v long")
    nothing = spark.createDataFrame([], "set_id string, node long")
    assert paths.set_dispersions(edges, nothing).collect() == []
    assert paths.set_similarities(edges, nothing).collect() == []
    empty = spark.createDataFrame([], "u long, v long")
    one = spark.createDataFrame([("a", 7), ("a", 8)], "set_id string, node long")
    assert [tuple(r) for r in paths.set_dispersions(empty, one).collect()] == [("a", 2, 0.0)]  # a graph of no nodes
    assert tuple(paths.mean_jaccard(edges, nothing.select("node")).first()) == (0, None)


def test_leading_nodes_frequencies_and_monotonicity(spark):
    pairs = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), ("a", 2, 3), ("a", 3, 4), ("b", 1, 2)], "graph string, u long, v long")
    own = collection.collect_networks(pairs)
    scores, failed = collection.score_all(own, ["degree"])
    assert not failed
    rows = {(r.graph, r.place): (r.node, r.degree, r.inside) for r in study.leading_nodes(own, scores, 3).collect()}
    assert rows == {("a", 1): (3, 3, 2), ("a", 2): (1, 2, 2), ("a", 3): (2, 2, 2), ("b", 1): (1, 1, 1), ("b", 2): (2, 1, 1), ("b", 3): (None, None, None)}
    groups = {(r.graph, r.rank): r.n for r in collection.frequencies(collection.rank_all(scores)).collect()}
    assert groups == {("a", 1): 1, ("a", 2): 2, ("a", 4): 1, ("b", 1): 2}
    told = {r.graph: (r.n_nodes, r.n_distinct, r.n_tied, r.monotonicity) for r in statistics.monotonicity(scores, 8, ["graph"]).collect()}
    assert told == {"a": (4, 3, 2, pytest.approx((1 - 2 / 12) ** 2)), "b": (2, 1, 2, 0.0)}
    alone = statistics.monotonicity(scores.where(F.col("graph") == "a"), 8).first()
    assert alone["n_distinct"] == 3 and alone["largest"] == 2


def test_search_over_several_ranges_and_blocks(spark):
    """A level brings a range what all its arcs carry in one part for each range of tails, not a row an arc; arcs may lead one way."""
    from marram.operators import blocks

    n, k = 2 * blocks.SPAN + 5, blocks.WIDE + 3
    arcs = spark.range(1, n).selectExpr("id AS u", "0L AS v").union(spark.range(3, n, 3).selectExpr("0L AS u", "id AS v"))
    sources = spark.range(k).selectExpr("id AS node", "id AS source")
    packed = blocks.packed_arcs(arcs).collect()
    assert sorted(r.j for r in packed) == [0, 1, 2]
    found = [(d, state) for d, state in blocks.levels(arcs, sources)]
    got = {}
    for r in blocks.sums(found[-1][1]).collect():
        a = got.get(r.label, (0, 0, 0))
        got[r.label] = (a[0] + r.reached, a[1] + r.total, max(a[2], r.farthest))
    want = {0: (k - 1, k - 1, 1)}
    for v in range(3, n, 3):  # from node 0 in one step, from the other sources in two
        others = k - 1 - (v < k)
        want[v] = (1 + others, 1 + 2 * others, 2 if others else 1)
    assert got == want and [d for d, _ in found] == [1, 2, 3]


def small_lines(spark, tmp_path):
    """A folder with a few lines, enough for networks."""
    rng = random.Random(31)
    rows = [(o, rng.randrange(12), f, s, 40.0) for o in range(40) for f, s in (("A", "F"), ("N", "O")) for _ in range(2)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_returnflag string, l_linestatus string, l_quantity double").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    return f"file://{tmp_path}"


def broken_method(monkeypatch, name):
    def fails(*_):
        raise ValueError("no scores")

    monkeypatch.setitem(methods.METHODS, name, fails)


def test_leading_nodes_without_a_method_are_no_result(spark, tmp_path, monkeypatch):
    folder = small_lines(spark, tmp_path)
    broken_method(monkeypatch, "core")
    with pytest.raises(RuntimeError, match="core"):
        QUERIES["networks_leading"](spark, folder).collect()


def test_ties_without_a_method_are_no_result(spark, tmp_path, monkeypatch):
    folder = small_lines(spark, tmp_path)
    broken_method(monkeypatch, "core")
    with pytest.raises(RuntimeError, match="core"):
        QUERIES["networks_ties"](spark, folder).collect()
