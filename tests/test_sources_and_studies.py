import itertools
import os

import pytest
from pyspark.sql import functions as F

from marram.operators import graph, methods, ranking
from marram.plans import study
from marram.sources import networks


def test_readers(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%MatrixMarket matrix coordinate\n% note\n3 3 3\n2 1 5.0\n3 1 1\n3 3 3\n")
    pairs, n = networks.read_matrix_market(spark, f"file://{tmp_path}/a.mtx")
    assert n == 3 and sorted(map(tuple, pairs.collect())) == [(1, 0), (2, 0), (2, 2)]
    (tmp_path / "b.edges").write_text("% c\n\n1 2\n 2\t3 9\n")
    assert sorted(map(tuple, networks.read_network(spark, f"file://{tmp_path}/b.edges").collect())) == [(1, 2), (2, 3)]
    assert set(networks.list_networks(spark, f"file://{tmp_path}")) == {"a", "b"}
    listed = networks.manifest(spark, f"file://{tmp_path}").collect()
    assert len(listed) == 2 and all(len(r.sha256) == 64 for r in listed)


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("g", "m", 1, 0.5), ("g", "m", 2, 0.25)], "graph_id string, method string, node long, score double")
    path = f"file://{tmp_path}/scores"
    networks.write_scores(df, path)
    networks.write_scores(df.withColumn("method", F.lit("old")), path)
    stored = networks.read_scores(spark, path, {"old": "new"})
    assert {(r.method, r["node"]) for r in stored.collect()} == {("m", 1), ("m", 2), ("new", 1), ("new", 2)}
    want = spark.createDataFrame([("g", "m", 2), ("g", "x", 2), ("g", "new", 3)], "graph_id string, method string, n long")
    assert {(r.method, r.have) for r in networks.missing_scores(stored, want).collect()} == {("x", 0), ("new", 2)}
    networks.write_table(df, f"file://{tmp_path}/t")
    assert networks.read_table(spark, f"file://{tmp_path}/t", "node long, score double").count() == 2
    with pytest.raises(ValueError):
        networks.read_table(spark, f"file://{tmp_path}/t", "other long")
    with pytest.raises(ValueError):
        networks.read_pairs(spark, path)
    assert networks.markdown(df.limit(1)).splitlines()[0] == "| graph_id | method | node | score |"


@pytest.mark.skipif("MARRAM_NETWORKS" not in os.environ, reason="folder of network files not given")
def test_network_files(spark):
    want = {"lesmis": (77, 254, 0.090456, 59, 10), "adjnoun": (112, 425, 0.078283, 303, 5), "jazz": (198, 2742, 0.026567, 746, 30), "USAir97": (332, 2126, 0.023061, 699, 22), "email": (1133, 5451, 0.056537, 3267, 12), "soc-hamsterster": (2000, 16097, 0.023378, 4876, 25)}
    found = networks.list_networks(spark, os.environ["MARRAM_NETWORKS"])
    for name, facts in want.items():
        net = methods.Network(graph.largest_component(graph.simple_edges(networks.read_network(spark, found[name]))))
        s = graph.summary(net.edges).first()
        sizes = net.cliques.agg(F.count("*"), F.max("size")).first()
        assert (s.n_nodes, s.n_edges, round(s.threshold, 6), sizes[0], sizes[1]) == facts, name


@pytest.fixture(scope="module")
def network(spark):
    pairs = [(a + 5 * k, b + 5 * k) for k in range(6) for a, b in itertools.combinations(range(5), 2)] + [(5 * k, 5 * k + 6) for k in range(5)] + [(0, 20), (3, 17)]
    return methods.Network(graph.simple_edges(spark.createDataFrame(pairs, "u long, v long")))


@pytest.fixture(scope="module")
def scores(network):
    return methods.score_all(network, ["degree", "clique_full", "core"])[0]


def test_seed_ratio_study(network, scores):
    observed = study.seed_ratio_study(network.edges, scores, [5, 10], blocks=6, repeats=2)
    assert observed.count() == 3 * 2 * 6
    tested = study.against_best(observed, "clique_full", ["percent_seeds"], ["degree", "core"]).collect()
    assert len(tested) == 2 and all(0 <= r.q <= 1 and r.q >= r.p and r.best in ("degree", "core") for r in tested)
    table = study.ablation_table(observed.withColumn("network", F.lit("n")), "clique_full")
    assert table.count() == 4
    overall, posthoc = study.cross_network(observed.select(F.col("block").alias("network"), "method", F.col("percent").alias("value")), "clique_full")
    assert overall.first()["n_blocks"] == 6 and posthoc.count() == 3


def test_curves_and_rates(network, scores):
    curves = study.temporal_study(network.edges, scores, 3, blocks=3, repeats=2, horizon=8)
    assert curves.count() == 3 * 8 and curves.where("t = 0").select("mean").distinct().first()[0] == pytest.approx(10.0)
    assert study.zoom_window(curves, 3).count() == 1
    assert study.rate_study(network.edges, scores, [0.1, 0.2], blocks=2, repeats=2).count() == 3 * 2 * 2
    assert study.recovery_study(network.edges, scores, [0.5, 1.0], blocks=2, repeats=2, times=1.0).count() == 3 * 2 * 2


def test_structure_studies(network, scores):
    ranks = study.rank_methods(scores)
    assert study.dispersion_study(network.edges, ranks, [10]).count() == 3
    ties = {r.method: r.monotonicity for r in study.tie_table(scores).collect()}
    assert ties["core"] <= ties["clique_full"]
    assert study.correlation_study(scores, [("degree", "clique_full")]).first()["n"] == 30
    assert study.boundary_study(network.edges, ranks, 20, draws=3, blocks=2, repeats=2).count() > 0
    scaled = study.scaled_axes(scores, ["method"], "score").agg(F.min("scaled"), F.max("scaled")).first()
    assert tuple(scaled) == (0.0, 1.0)


def test_control_study(spark, network):
    seeds = ranking.ranked(ranking.degree_centrality(network.edges)).where("rank <= 4").select("node")
    got = study.control_study(network.edges, seeds, batch=20, most=40, n=3, caliper=0.2, blocks=3, repeats=2)
    kinds = {r.kind for r in got.collect()}
    assert {"random", "dispersed"} <= kinds


def test_timing(spark):
    rows = study.timed("x", lambda: spark.range(5), 2) + study.timed("bad", lambda: 1 / 0)
    assert [r[3][:4] for r in rows] == ["", "", "Zero"]
    df = spark.createDataFrame([("m", 1, 1.0), ("m", 1, 3.0), ("m", 2, 4.0)], "method string, instance int, seconds double")
    a, b = (study.timing_summary(df, ["method"], per_instance=x).first() for x in (True, False))
    assert (a["n"], a["mean"], a["median"], b["n"]) == (2, 3.0, 3.0, 3)
