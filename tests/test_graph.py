"""Graphs with known answers, and random ones against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from marram.operators import cliques as cl
from marram.operators import community, controls, graph, methods, paths, ranking, spread, synthetic
from marram.sources import shared


def edges_of(spark, pairs):
    return graph.simple_edges(spark.createDataFrame(list(pairs), "u long, v long"))


def scores(df):
    return {r["node"]: r["score"] for r in df.collect()}


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(5)
    pairs = {(a, b) for a in range(40) for b in range(a) if rng.random() < 0.15}
    near = {v: set() for v in range(40)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    return edges_of(spark, pairs).cache(), {v: n for v, n in near.items() if n}


def brute_cliques(near):
    found = []

    def grow(r, p, x):
        if not p and not x:
            found.append(tuple(sorted(r)))
        for v in list(p):
            grow(r | {v}, p & near[v], x & near[v])
            p = p - {v}
            x = x | {v}

    grow(set(), set(near), set())
    return sorted(found)


def brute_constraint(near, found, overlap=True, external=True, phi=math.log1p, norm=max):
    of = {v: [c for c in found if v in c] for v in near}
    p = {}
    for c in found:
        ext = {v: max(0, len(near[v]) - (len(c) - 1)) for v in c}
        t = sum(ext.values())
        press = {v: ext[v] + (phi(t - ext[v]) if t > ext[v] else 0) for v in c}
        d = norm(press.values()) + 0.001
        for v in c:
            p[v, c] = (1 - press[v] / d) / len(of[v]) if external else 1 / len(of[v])
    out = {}
    for v in near:
        total = 0
        for a in of[v]:
            x = p[v, a]
            if overlap:
                x += sum(p[v, b] * (len(set(a) & set(b)) - 1) / (len(b) - 1) for b in of[v] if b != a)
            total += x * x
        out[v] = 1 - total
    return out


def test_preparation(spark):
    raw = [(1, 2), (2, 1), (2, 3), (3, 3), (None, 4), (7, 8), (1, 3), (1, 2)]
    e = edges_of(spark, raw)
    assert sorted(map(tuple, e.collect())) == [(1, 2), (1, 3), (2, 3), (7, 8)]
    assert sorted(map(tuple, graph.largest_component(e).collect())) == [(1, 2), (1, 3), (2, 3)]
    assert {tuple(r) for r in graph.component_sizes(e).collect()} == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (7, 7, 2), (8, 7, 2)}
    assert {tuple(r) for r in graph.relabel(e).select("node", "label").collect()} == {(1, 0), (2, 1), (3, 2), (7, 3), (8, 4)}
    s = graph.summary(e.where("u < 7")).first()
    assert (s.n_nodes, s.n_edges, s.clustering, s.transitivity, s.density, s.threshold) == (3, 3, 1.0, 1.0, 1.0, 1.0)
    empty = e.where("false")
    assert graph.largest_component(empty).count() == 0 and cl.maximal_cliques(empty).count() == 0 and ranking.degree_centrality(empty).count() == 0
    assert graph.summary(edges_of(spark, [(1, 2)])).first()["threshold"] is None
    report = graph.preparation_report(spark.createDataFrame(raw, "u long, v long"), graph.largest_component(e)).first()
    assert (report.node_loss, report.edge_loss) == (40.0, 25.0)


def test_equal_components_keep_the_smallest_node(spark):
    e = edges_of(spark, [(10, 11), (11, 12), (1, 2), (2, 5)])
    assert {tuple(r) for r in graph.largest_component(e).collect()} == {(1, 2), (2, 5)}


def test_long_path_components(spark):
    e = edges_of(spark, [(i, i + 1) for i in range(200)])
    assert {r.component for r in graph.component_sizes(e).collect()} == {0}


def test_cliques_and_constraint(spark, sample):
    e, near = sample
    found = brute_cliques(near)
    c = cl.maximal_cliques(e)
    assert sorted(tuple(r.members) for r in c.collect()) == found
    options = {"full": {}, "no": {"overlap": False}, "ne": {"external": False}, "c": {"overlap": False, "external": False}, "lin": {"phi": float}, "boxcox": {"phi": lambda x: 2 * (math.sqrt(1 + x) - 1)}, "sumnorm": {"norm": sum}}
    for name, o in options.items():
        got, want = scores(cl.clique_constraint(e, c, **cl.VARIANTS[name])), brute_constraint(near, found, **o)
        assert got == pytest.approx(want, abs=1e-9), name
    assert sum(r.n for r in cl.clique_sizes(c).collect()) == len(found)
    assert sum(r.n for r in cl.memberships(e, c).collect()) == len(near)


def test_complete_graph(spark):
    e = edges_of(spark, itertools.combinations(range(6), 2))
    c = cl.maximal_cliques(e)
    assert [tuple(r.members) for r in c.collect()] == [tuple(range(6))]
    assert scores(cl.clique_constraint(e, c)) == pytest.approx(dict.fromkeys(range(6), 0.0))
    assert set(scores(ranking.core_numbers(e)).values()) == {5.0}
    assert set(scores(paths.closeness(e)).values()) == {1.0}
    assert set(scores(paths.betweenness(e)).values()) == {0.0}


def test_star_and_path(spark):
    star = edges_of(spark, [(0, i) for i in range(1, 7)])
    assert scores(paths.betweenness(star))[0] == pytest.approx(1.0)
    assert scores(ranking.structural_holes(star))[0] == pytest.approx(1 - 1 / 6)
    assert scores(ranking.core_numbers(star)) == dict.fromkeys(range(7), 1.0)
    line = edges_of(spark, [(i, i + 1) for i in range(4)])
    assert scores(paths.betweenness(line)) == pytest.approx({0: 0, 1: 3 / 6, 2: 4 / 6, 3: 3 / 6, 4: 0})
    p = paths.path_statistics(line).first()
    assert (p.mean_distance, p.diameter, p.radius) == (2.0, 4, 2)


def test_betweenness_in_waves(spark, sample):
    e, near = sample
    whole = scores(paths.betweenness(e))
    for wave in (1 + len(near) // 3, len(near) - 1):
        got = {r.node: r.delta for r in paths.dependencies(e, wave).collect()}
        pairs = (len(near) - 1) * (len(near) - 2)
        assert {v: x / pairs for v, x in got.items()} == pytest.approx(whole, abs=1e-12)
    assert paths.dependencies(e.where("false")).count() == 0


def test_betweenness_writes_no_row_for_a_pair(spark, sample, monkeypatch):
    rows, write = {}, shared._write

    def counted(df, name):
        out = write(df, name)
        rows[name] = max(rows.get(name, 0), out[0].count())
        return out

    monkeypatch.setattr(shared, "_write", counted)
    paths.dependencies(sample[0]).count()
    assert rows["paths"] == 1  # a range of nodes and a block of sources


def test_cores_of_many_shapes(spark, sample):
    """Against peeling: a dense sample, and chains that hang on cliques, where a fall passes on node by node."""
    for e, near in (sample, chained(spark)):
        left, core = {v: set(n) for v, n in near.items()}, {}
        k = 0
        while left:
            v = min(left, key=lambda x: len(left[x]))
            k = max(k, len(left[v]))
            core[v] = k
            for w in left.pop(v):
                left[w].discard(v)
        assert scores(ranking.core_numbers(e)) == core


def chained(spark):
    pairs = list(itertools.combinations(range(6), 2)) + [(5 + i, 6 + i) for i in range(12)] + list(itertools.combinations(range(17, 21), 2)) + [(2, 19), (30, 31)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return edges_of(spark, pairs), near


def distances(near):
    out = {}
    for s in near:
        seen, ring, d = {s: 0}, [s], 0
        while ring:
            d += 1
            ring = [w for v in ring for w in near[v] if seen.setdefault(w, d) == d and w not in out.get("x", ())]
            ring = list(dict.fromkeys(w for w in ring if seen[w] == d))
        out[s] = seen
    return out


def test_distances(spark, sample):
    e, near = sample
    d = distances(near)
    got = {r.node: (r.reached, r.total, r.farthest) for r in paths.distance_sums(e).collect()}
    assert got == {v: (len(x) - 1, sum(x.values()), max(x.values())) for v, x in d.items()}
    seeds = spark.createDataFrame([(v,) for v in list(near)[:7]], "node long")
    own = [r["node"] for r in seeds.collect()]
    pairs = list(itertools.combinations(own, 2))
    assert paths.dispersion(e, seeds).first()["mean_distance"] == pytest.approx(sum(d[a].get(b, len(near)) for a, b in pairs) / len(pairs))
    both = seeds.select(F.col("node").alias("source")).crossJoin(seeds)
    assert {(r.source, r["node"]): r.d for r in paths.pair_distances(e, both).collect()} == {(a, b): d[a][b] for a in own for b in own if b in d[a]}
    j = [len(near[a] & near[b]) / len(near[a] | near[b]) for a, b in pairs]
    assert paths.mean_jaccard(e, seeds).first()["mean_jaccard"] == pytest.approx(sum(j) / len(j))
    asked = spark.createDataFrame(pairs, "i long, j long")
    assert {(r.i, r.j): r.jaccard for r in paths.jaccard(e, asked).collect()} == pytest.approx(dict(zip(pairs, j, strict=True)))
    ci = scores(ranking.collective_influence(e, 3))
    assert ci == {v: (len(near[v]) - 1) * sum(len(near[w]) - 1 for w, x in d[v].items() if x == 3) for v in near}


def test_vote_rank(spark, sample):
    square = edges_of(spark, [(0, 1), (1, 2), (2, 3), (0, 3)])
    assert ranking.vote_rank(square).orderBy('rank').collect()[0]["node"] == 0
    e, near = sample
    n, e2 = len(near), sum(map(len, near.values()))
    hits, picked = dict.fromkeys(near, 0), []
    for _ in near:
        able = {v: 0 if v in picked else max(0, e2 - hits[v] * n) for v in near}
        best = min((v for v in near if v not in picked), key=lambda v: (-sum(able[w] for w in near[v]), v))
        picked.append(best)
        for w in near[best]:
            hits[w] += 1
    assert [r["node"] for r in ranking.vote_rank(e).orderBy("rank").collect()] == picked


def test_ranking_and_seed_counts(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0 + 1e-12), (2, 2.0), (9, float("nan")), (8, None)], "node long, score double")
    assert [r["node"] for r in ranking.ranked(df).orderBy("rank").collect()] == [2, 1, 3]
    assert [ranking.seed_count(2000, 7), ranking.seed_count(5, 1), ranking.seed_count(5, 1, "ceil2"), ranking.seed_count(150, 1, "ceil1")] == [140, 1, 2, 2]


def test_spreading(spark, sample):
    e, near = sample
    seeds = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2)], "set_id string, node long")
    plan = spread.runs(spark, 2, 2).select("run", F.explode(F.array(F.lit(0.0), F.lit(0.3), F.lit(1.0))).alias("beta"))
    got = spread.infections(e, seeds, plan).collect()
    sizes = {}
    for r in got:
        sizes.setdefault((r.set_id, r.run, r.beta), set()).add(r["node"])
    d = distances(near)
    for (s, run, beta), nodes in sizes.items():
        start = {0, 1} if s == "a" else {2}
        assert start <= nodes
        if beta == 0.0:
            assert nodes == start
        if beta == 1.0:
            assert nodes == set().union(*(d[v] for v in start))
        assert nodes <= sizes[s, run, 1.0] and sizes[s, run, 0.0] <= nodes
    alone = spread.infections(e, seeds.where("set_id = 'b'"), plan)
    assert {tuple(r) for r in alone.collect()} == {tuple(r) for r in got if r.set_id == "b"}
    curve = {}
    for r in spread.curves(spread.infections(e, seeds, plan), 9).collect():
        curve.setdefault((r.set_id, r.run, r.beta), {})[r.t] = r.n_infected
    assert all(len(c) == 9 and all(c[t] <= c[t + 1] for t in range(8)) for c in curve.values())


def test_spreading_follows_the_literal_process(spark, sample):
    e, near = sample
    beta, gamma, n = 0.15, 0.5, 300
    rng = random.Random(1)

    def literal(gamma):
        infected, gone = {0}, set()
        while infected:
            new = {w for v in infected for w in near[v] if w not in infected and w not in gone and rng.random() < beta}
            out = {v for v in infected if rng.random() < gamma}
            infected, gone = (infected - out) | new, gone | out
        return len(gone)

    seeds = spark.createDataFrame([("s", 0)], "set_id string, node long")
    runs = spark.range(n).select(F.col("id").alias("run"), F.lit(beta).alias("beta"))
    for g, sizes in ((1.0, spread.final_sizes(spread.infections(e, seeds, runs))), (gamma, spread.final_sizes(spread.infections_with_recovery(e, seeds, runs.withColumn("gamma", F.lit(gamma)))))):
        got = [r.n_infected for r in sizes.collect()]
        want = [literal(g) for _ in range(2000)]
        mean = lambda x: sum(x) / len(x)
        var = lambda x: sum((y - mean(x)) ** 2 for y in x) / (len(x) - 1)
        assert abs(mean(got) - mean(want)) < 4 * math.sqrt(var(got) / len(got) + var(want) / len(want))


def test_controls(spark, sample):
    e, near = sample
    bins = controls.degree_bins(e)
    rows = sorted((r.k, r["node"], r.bin) for r in bins.collect())
    assert [b for _, _, b in rows] == [min(9, i * 10 // len(rows)) for i in range(len(rows))]
    of = {v: b for _, v, b in rows}
    seeds = spark.createDataFrame([(v,) for v in list(near)[:5]], "node long")
    sets = {}
    drawn = controls.matched_candidates(bins, seeds, spark.range(30).withColumnRenamed("id", "candidate"))
    for r in drawn.collect():
        sets.setdefault(r.candidate, []).append(r["node"])
    want = sorted(of[r["node"]] for r in seeds.collect())
    assert len(sets) == 30 and all(sorted(of[v] for v in s) == want for s in sets.values())
    assert {tuple(sorted(s)) for s in sets.values()} == {tuple(r.n) for r in controls.distinct_sets(drawn).groupBy("candidate").agg(F.array_sort(F.collect_list("node")).alias("n")).collect()}


def test_communities(spark):
    two = [(a + 10 * k, b + 10 * k) for k in range(3) for a, b in itertools.combinations(range(6), 2)] + [(0, 10), (10, 20)]
    e = edges_of(spark, two)
    part = community.louvain(e)
    groups = {}
    for r in part.collect():
        groups.setdefault(r.community, set()).add(r["node"])
    assert sorted(map(min, groups.values())) == [0, 10, 20]
    assert community.modularity(e, part) > 0.5


def test_generators(spark):
    e = synthetic.erdos_renyi(spark, 400, 6).collect()
    assert all(0 <= r.u < r.v < 400 for r in e) and len(set(map(tuple, e))) == len(e) and abs(len(e) - 1200) < 200
    assert synthetic.erdos_renyi(spark, 5, 4).count() == 10 and synthetic.erdos_renyi(spark, 5, 0).count() == 0
    b = synthetic.barabasi_albert(spark, 300, 6)
    s = graph.summary(b).first()
    assert s.n_nodes == 300 and s.max_degree > 20 and b.where("u < 0 or v >= 300").count() == 0
    w = synthetic.watts_strogatz(spark, 100, 6, 0.0)
    assert {r.k for r in graph.degrees(w).collect()} == {6}
    assert sorted(map(tuple, synthetic.watts_strogatz(spark, 100, 6).collect())) == sorted(map(tuple, synthetic.watts_strogatz(spark, 100, 6).collect()))


def test_all_methods_and_isolation(spark):
    e = edges_of(spark, itertools.combinations(range(4), 2))
    net = methods.Network(e)
    done, failed = methods.score_all(net, ["degree", "nonsense", "clique_full"])
    assert set(failed) == {"nonsense"} and {r.method for r in done.select("method").distinct().collect()} == {"degree", "clique_full"}
    with pytest.raises(ValueError):
        methods.score("nonsense", net)


def test_cliques_around_hubs(spark):
    """Two hubs share 20,000 neighbours, of which some are tied; a hub's row stays small."""
    n = 20_000
    ends = spark.range(2, n).select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("u"), F.col("id").alias("v"))
    more = spark.createDataFrame([(0, 1), (2, 3), (3, 4), (2, 4)], "u long, v long")
    found = cl.maximal_cliques(graph.simple_edges(ends.union(more)))
    sizes = {r["size"]: r["count"] for r in found.groupBy("size").count().collect()}
    assert sizes == {3: n - 5, 5: 1}


def test_preparation_finds_triangles_once_and_lists_no_wedges(spark, monkeypatch):
    """Both sides of the report come from one search for triangles, and a tie carries a list, not a row for each pair of neighbours."""
    calls, plain = [], graph.triangles
    monkeypatch.setattr(graph, "triangles", lambda edges: calls.append(1) or plain(edges))
    rows = [(1, 2), (2, 3), (1, 3), (3, 4), (10, 11), (11, 12), (10, 12), (5, 5)]
    pairs = spark.createDataFrame(rows, "u long, v long")
    edges = graph.simple_edges(pairs)
    report = graph.preparation_report(pairs, graph.largest_component(edges)).first()
    assert (report.raw_n, report.lcc_n, report.raw_e, report.lcc_e, report.lcc_c) == (7, 4, 7, 4, round((1 + 1 + 1 / 3) / 4, 4))
    assert len(calls) == 1
    hub = spark.range(1, 41).selectExpr("0L as u", "id as v").union(spark.range(1, 40).selectExpr("id as u", "id + 1 as v"))
    found = {frozenset(r) for r in plain(hub).collect()}
    assert found == {frozenset((0, i, i + 1)) for i in range(1, 40)} and plain(hub).count() == 39


def test_components_write_edges_once(spark, monkeypatch):
    """What a round writes after the edges themselves grows with the nodes; a long path and a dense component take few rounds."""
    from marram.operators import components
    from marram.sources import shared

    sizes = []

    class Counted(shared.Rounds):
        def write(self, df, name):
            out = super().write(df, name)
            sizes.append((name, out.count()))
            return out

    monkeypatch.setattr(components, "Rounds", Counted)
    dense = spark.range(200).selectExpr("id AS a").crossJoin(spark.range(200).selectExpr("id AS b")).where("a < b")
    path = spark.range(1000, 1300).selectExpr("id AS a", "id + 1 AS b")
    odd = spark.createDataFrame([(5000, 5000), (None, 1), (7001, 7000), (7000, 7001), (9003, 9002), (9001, 9003), (9002, 9004), (8999, 9004)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(dense.union(path).union(odd)).collect()}
    want = {**dict.fromkeys(range(200), 0), **dict.fromkeys(range(1000, 1301), 1000), 7000: 7000, 7001: 7000, **dict.fromkeys([8999, 9001, 9002, 9003, 9004], 8999)}
    assert got == want
    edges = dense.count() + path.count() + 6
    assert sizes[0] == ("links", edges) and max(n for _, n in sizes[1:]) <= len(want) and len(sizes) < 25
