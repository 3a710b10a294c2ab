"""Many networks at once against one network at a time, unique controls, generators, ties and the store."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marram.operators import cliques as cl
from marram.operators import collection, community, controls, graph, methods, paths, permute, ranking, spread, synthetic
from marram.plans import study
from marram.sources import networks as files
from marram.sources import store as stores


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def random_ties(rng, n, m):
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


@pytest.fixture(scope="module")
def three(spark):
    """Three networks of different shapes under the same node names, with loops, repeats and nodes without ties."""
    rng = random.Random(21)
    ties = {
        "a": random_ties(rng, 30, 60) + [(40, 41), (41, 42)],
        "b": [(i, i + 1) for i in range(25)] + [(0, 2), (1, 3)],
        "c": [p for k in range(3) for p in itertools.combinations(range(6 * k, 6 * k + 6), 2)] + [(5, 6), (11, 12), (50, 51)],
    }
    pairs = [(g, u, v) for g, own in ties.items() for u, v in own] + [("a", 41, 40), ("b", 7, 7), (None, 1, 2), ("b", None, 3)]
    pairs = spark.createDataFrame(pairs, "graph string, u long, v long")
    alone = spark.createDataFrame([("a", 99), ("b", 98), ("b", 97), ("d", 1)], "graph string, node long")
    return ties, collection.collect_networks(pairs, alone)


def kept_ties(own):
    """Ties of the largest component."""
    near = defaultdict(set)
    for u, v in own:
        near[u].add(v), near[v].add(u)
    left, best = set(near), set()
    while left:
        todo = [min(left)]
        found = set(todo)
        while todo:
            for y in near[todo.pop()] - found:
                found.add(y), todo.append(y)
        left -= found
        if len(found) > len(best):
            best = found
    return [(u, v) for u, v in own if u in best]


def test_ties_are_made_once(spark):
    """What gives the ties of networks may be a large join; nodes and edges come from one run of it."""
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    pairs = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("a", 2, 3), ("a", 5, 5)], "graph string, u long, v long").mapInArrow(counted, "graph string, u long, v long")
    own = collection.collect_networks(pairs)
    assert own.nodes.count() == 4 and own.edges.count() == 2 and runs.value == 4


def test_collections_keep_nodes_without_ties(three):
    ties, every = three
    got = {r.graph: (r.n, r.e) for r in every.sizes().collect()}
    assert got == {g: (len({x for e in own for x in e}) + more, len(own)) for (g, own), more in zip(ties.items(), (1, 2, 0), strict=True)} | {"d": (1, 0)}
    kept = collection.largest_components(every)
    assert {r.graph: r.e for r in kept.sizes().collect()} == {g: len(kept_ties(own)) for g, own in ties.items()} | {"d": 0}
    report = {r.graph: r for r in collection.preparation(every, kept).collect()}
    assert report["b"].node_loss == round(100 * 2 / 28, 2) and report["b"].retained == round(100 * 26 / 28, 2)
    assert report["d"].raw_n == 1 and report["d"].edge_loss is None


def test_all_methods_agree_with_one_network_at_a_time(spark, three):
    ties, every = three
    kept = collection.largest_components(every)
    names = ["degree", "closeness", "betweenness", "core", "vote_rank", "clique_full"]
    scores, failed = collection.score_all(kept, [*names, "nonsense"])
    assert set(failed) == {"nonsense"}
    got = defaultdict(dict)
    for r in kept.named(scores.drop("graph")).collect():
        got[r.graph, r.method][r.node] = r.score
    for g, own in list(ties.items())[::2]:
        one = methods.Network(spark.createDataFrame(kept_ties(own), "u long, v long"))
        for m in names:
            want = {r["node"]: r.score for r in methods.score(m, one).collect()}
            assert got[g, m] == pytest.approx(want), (g, m)
    ranks = collection.rank_all(scores).where("method = 'degree'")
    for g in ties:
        own = [r for r in ranks.where(F.col("graph") == g).orderBy("rank").collect()]
        assert [r.rank for r in own] == list(range(1, len(own) + 1))
        assert [(-r.score, r["node"]) for r in own] == sorted((-r.score, r["node"]) for r in own)
    figures = {r.graph: r for r in collection.figures(kept, distances=True).collect()}
    stats = {r.graph: r for r in collection.clique_figures(kept, cl.maximal_cliques(kept.edges.select("u", "v"))).collect()}
    for g, own in list(ties.items())[:1]:
        e = spark.createDataFrame(kept_ties(own), "u long, v long")
        want = graph.summary(e).first().asDict() | {k: v for k, v in paths.path_statistics(e).first().asDict().items() if k != "radius"}
        assert {k: v for k, v in figures[g].asDict().items() if k != "graph"} == pytest.approx(want)
        assert {k: v for k, v in stats[g].asDict().items() if k != "graph"} == pytest.approx(cl.clique_statistics(e, cl.maximal_cliques(e)).first().asDict())


def test_communities_of_many_networks(spark, three):
    ties, every = three
    kept = collection.largest_components(every)
    part = community.louvain(kept.edges, kept.nodes.select(F.col("id").alias("node"), "graph"))
    got = defaultdict(dict)
    for r in kept.named(part).collect():
        got[r.graph][r["node"]] = r.community
    assert sorted(map(len, [[x for x, c in got["c"].items() if c == k] for k in set(got["c"].values())])) == [6, 6, 6]
    for g, own in ties.items():
        assert set(got[g]) == {x for e in kept_ties(own) for x in e}


def plain_votes(ties):
    """Order of picks, and in how many steps the best votes were tied."""
    near = defaultdict(set)
    for u, v in ties:
        near[u].add(v), near[v].add(u)
    n, e2 = len(near), sum(map(len, near.values()))
    able, count, live, order, tied = dict.fromkeys(near, e2), dict.fromkeys(near, 0), set(near), [], 0
    while live:
        votes = {x: sum(able[y] for y in near[x]) for x in live}
        x = min(live, key=lambda z: (-votes[z], z))
        tied += sum(v == votes[x] for v in votes.values()) > 1
        order.append(x)
        live.discard(x)
        able[x] = 0
        for y in near[x] & live:
            count[y] += 1
            able[y] = max(0, e2 - count[y] * n)
    return order, tied


@pytest.mark.parametrize("block", [1 << 20, 24])
def test_vote_rank_in_blocks_and_its_ties(spark, monkeypatch, block):
    monkeypatch.setattr(ranking, "BLOCK_TIES", block)
    rng = random.Random(22)
    shapes = [[(i, i + 1) for i in range(40)], random_ties(rng, 40, 90), [(0, i) for i in range(1, 25)] + [(i, i + 1) for i in range(1, 24, 2)]]
    rows = [(u + 1000 * g, v + 1000 * g) for g, own in enumerate(shapes) for u, v in own]
    nodes = [(x + 1000 * g, g) for g, own in enumerate(shapes) for x in sorted({x for e in own for x in e})] + [(2999, 2)]
    e, of = spark.createDataFrame(rows, "u long, v long"), spark.createDataFrame(nodes, "node long, graph long")
    order = ranking.vote_rank(e, of)
    got = defaultdict(list)
    for r in order.orderBy("graph", "rank").collect():
        got[r.graph].append(r["node"])
    want = [plain_votes(own) for own in shapes]
    assert [[x - 1000 * g for x in got[g]] for g in (0, 1)] == [w[0] for w in want[:2]]
    assert got[2][-1] == 2999 and len(got[2]) == len(want[2][0]) + 1  # a node without ties comes last
    ties = {r.graph: (r.steps, r.tied) for r in ranking.vote_ties(e, order).collect()}
    assert [ties[g][1] for g in (0, 1)] == [w[1] for w in want[:2]] and [ties[g][0] for g in (0, 1)] == [len(w[0]) for w in want[:2]]


def test_blocks_that_settle_little_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_TIES", 8)
    calls, rounds, settle, write = [], [], ranking._block_picks, ranking.materialise
    monkeypatch.setattr(ranking, "_block_picks", lambda *a: calls.append(1) or settle(*a))
    monkeypatch.setattr(ranking, "materialise", lambda df, name="step": rounds.append(name) or write(df, name))
    ties = random_ties(random.Random(3), 60, 150)
    order = [r["node"] for r in ranking.vote_rank(spark.createDataFrame(ties, "u long, v long")).orderBy("rank").collect()]
    assert order == plain_votes(ties)[0]
    assert len(calls) < rounds.count("picked") - len(calls)  # fewer than rounds over the whole graph


def test_long_chains_take_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_TIES", 1 << 15)
    n, rounds = 20_000, []
    settle = ranking._block_picks
    monkeypatch.setattr(ranking, "_block_picks", lambda *a: rounds.append(1) or settle(*a))
    path = spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert ranking.vote_rank(path).where("rank = 1").first()["node"] == 1
    assert len(rounds) < 20  # 6,667 before blocks


def test_permutations(spark):
    for m in (1, 2, 3, 5, 16, 17, 100):
        rows = spark.range(m).select(F.lit(m).cast("long").alias("m"), "id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("key"))
        got = defaultdict(list)
        for r in rows.select("key", permute.permuted(F.col("id"), F.col("m"), F.col("key")).alias("x")).collect():
            got[r.key].append(r.x)
        assert all(sorted(x) == list(range(m)) for x in got.values())


def test_unique_controls(spark):
    rng = random.Random(23)
    e = spark.createDataFrame(random_ties(rng, 60, 150), "u long, v long")
    bins = controls.degree_bins(e)
    of = {r["node"]: r.bin for r in bins.collect()}
    assert sorted((r.bin, r.pos) for r in bins.collect()) == [(b, p) for b in range(10) for p in range(list(of.values()).count(b))]
    seeds = spark.createDataFrame([(x,) for x in sorted(of)[:4]], "node long")
    draws = controls.Draws(bins, seeds)
    sets, seen, following = controls.unique_candidates(draws, 30)
    got = defaultdict(set)
    for r in sets.collect():
        got[r.candidate].add(r["node"])
    want = sorted(of[x] for x in sorted(of)[:4])
    assert len(got) == 30 == len({frozenset(s) for s in got.values()})
    assert all(sorted(of[x] for x in s) == want for s in got.values())
    more, seen, _ = controls.unique_candidates(draws, 25, following, seen)
    for r in more.collect():
        got[r.candidate].add(r["node"])
    assert len(got) == 55 == len({frozenset(s) for s in got.values()}) and seen.count() == 55
    again = controls.Draws(bins, seeds).take(sets.select("candidate").distinct())
    assert rows_of(again) == rows_of(sets)


def test_controls_from_tiny_bins_are_all_found(spark):
    bins = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 0, 1), (3, 2, 1, 0), (4, 2, 1, 1)], "node long, k long, bin long, pos long")
    seeds = spark.createDataFrame([(1,), (3,)], "node long")
    draws = controls.Draws(bins, seeds)
    assert draws.sets == 4
    sets, _, _ = controls.unique_candidates(draws, 4)  # there are just so many
    assert len({tuple(r.n) for r in sets.groupBy("candidate").agg(F.array_sort(F.collect_list("node")).alias("n")).collect()}) == 4
    with pytest.raises(ValueError):
        controls.unique_candidates(draws, 5)
    # Without the seeds themselves a bin is short, and the nearest one gives the rest.
    pool = spark.createDataFrame([(2,), (4,)], "node long")
    got = controls.Draws(bins, spark.createDataFrame([(1,), (2,)], "node long"), pool).take(spark.range(3).withColumnRenamed("id", "candidate"))
    assert {tuple(r.n) for r in got.groupBy("candidate").agg(F.array_sort(F.collect_list("node")).alias("n")).collect()} == {(2, 4)}
    assert controls.quotas({0: 3, 5: 1}, {0: 1, 1: 1, 5: 9}) == {0: 1, 1: 1, 5: 2}
    with pytest.raises(ValueError):
        controls.quotas({0: 3}, {0: 1, 4: 1})


def test_searches_widen_until_enough_match(spark):
    rng = random.Random(24)
    e = spark.createDataFrame(random_ties(rng, 60, 110), "u long, v long")
    bins = controls.degree_bins(e)
    seeds = spark.createDataFrame([(x,) for x in (1, 2, 3)], "node long")
    draws = controls.Draws(bins, seeds)
    tried = []

    def measure(sets):
        tried.append(sets.select("candidate").distinct().count())
        return controls.mean_distances(e, sets)

    found = controls.search_controls(draws, measure, 3.0, batch=10, most=25, n=1000, caliper=10.0).collect()
    assert tried == [10, 10, 5] and len(found) == 25 and {r.status for r in found} == {"partial"}


def test_sampled_pairs_and_their_distances(spark):
    rng = random.Random(25)
    ties = random_ties(rng, 70, 120)
    e = spark.createDataFrame(ties, "u long, v long")
    near = defaultdict(set)
    for u, v in ties:
        near[u].add(v), near[v].add(u)
    dist = {}
    for s in near:
        d, ring = {s: 0}, [s]
        while ring:
            ring = [y for x in ring for y in near[x] if y not in d and not d.update({y: d[x] + 1})]
        dist[s] = d
    own = sorted(near)
    sets = spark.createDataFrame([(1, x) for x in own[:30]] + [(2, x) for x in own[10:14]] + [(3, own[0])], "set_id long, node long")
    picked = defaultdict(set)
    for r in paths.sampled_pairs(sets, 50).collect():
        assert r.source < r["node"]
        assert (r.source, r["node"]) not in picked[r.set_id]
        picked[r.set_id].add((r.source, r["node"]))
    assert len(picked[1]) == 50 and picked[2] == set(itertools.combinations(own[10:14], 2)) and 3 not in picked
    got = {r.set_id: (r.k, r.pairs, r.mean_distance) for r in paths.sampled_dispersion(e, sets, 50).collect()}
    for s, pairs in picked.items():
        assert got[s][1] == len(pairs)
        assert got[s][2] == pytest.approx(sum(dist[a].get(b, len(near)) for a, b in pairs) / len(pairs))
    assert got[3] == (1, 0, 0.0)
    pairs = spark.createDataFrame([(a, b) for a in own[:40] for b in own[20:60]], "source long, node long")
    assert {(r.source, r["node"]): r.d for r in paths.pair_distances(e, pairs).collect()} == {(a, b): dist[a][b] for a in own[:40] for b in own[20:60] if b in dist[a]}


def test_generators_keep_the_number_of_ties(spark):
    for n, degree, p in ((200, 6, 0.3), (200, 5, 1.0), (40, 12, 1.0)):
        e = synthetic.watts_strogatz(spark, n, degree, p, seed=3).collect()
        assert len(e) == len(set(map(tuple, e))) == n * (degree + degree % 2) // 2 and all(0 <= r.u < r.v < n for r in e)
    with pytest.raises(ValueError):
        synthetic.watts_strogatz(spark, 10, 6, 0.5)
    for n, degree in ((300, 6), (50, 2), (8, 12), (5, 8)):
        m = min(max(1, round(degree / 2)), n - 1)
        e = synthetic.barabasi_albert(spark, n, degree, seed=4).collect()
        assert len(e) == len(set(map(tuple, e))) == m * (n - m) and all(0 <= r.u < r.v < n for r in e)
        assert {x for r in e for x in r} == set(range(n))


def test_boundary_strategies(spark):
    """A hub and many equal leaves: by what they infect alone, the leaves of the dense part go first."""
    ties = [(0, i) for i in range(1, 9)] + list(itertools.combinations(range(20, 26), 2)) + [(0, 20)] + [(30, 31), (30, 20)]
    e = spark.createDataFrame([tuple(sorted(t)) for t in ties], "u long, v long")
    nodes = sorted({x for t in ties for x in t})
    scores = spark.createDataFrame([("m", x, 2.0 if x == 0 else 1.0) for x in nodes], "method string, node long, score double")
    got = {r.strategy: r for r in study.boundary_study(e, study.rank_methods(scores), 20, draws=4, blocks=4, repeats=10, alone=60).collect()}
    assert set(got) == {"id", "random", "sir_gt"} and (got["id"].draws, got["random"].draws, got["sir_gt"].draws) == (1, 4, 1)
    assert got["id"].cv == 0 == got["sir_gt"].cv
    alone = spread.single_node_sizes(e, spark.createDataFrame([(x, "m") for x in nodes], "node long, method string"), study.method_runs(spark, ["m"], 4, 10, 60, 0.3)[1])
    best = {r["node"]: r.score for r in alone.collect()}
    assert best[20] > best[31]


def test_store_makes_only_what_is_missing(spark, tmp_path):
    store = stores.Store(spark, f"file://{tmp_path}/store")
    e = spark.createDataFrame(random_ties(random.Random(26), 30, 60), "u long, v long")
    turned = e.select(F.col("v").alias("u"), F.col("u").alias("v")).orderBy(F.rand(1)).repartition(3)
    assert stores.edge_digest(e) == stores.edge_digest(turned) != stores.edge_digest(e.where("u > 1"))
    first, told = stores.stored_scores(store, e, ["degree", "clique_full", "nonsense"])
    assert told["degree"] == told["clique_full"] == "made" and told["nonsense"].startswith("ValueError")
    again, told = stores.stored_scores(store, turned, ["degree", "clique_full", "core"])
    assert told == {"degree": "kept", "clique_full": "kept", "core": "made"}
    assert rows_of(again.where("method <> 'core'")) == rows_of(first)
    assert store.has("cliques", stores.edge_digest(e))

    made = []

    def make(setting):
        made.append(setting["p"])
        if setting["p"] == 3 and len(made) < 4:
            raise RuntimeError("killed")
        return spark.range(setting["p"]).withColumnRenamed("id", "x")

    settings = [{"p": p, "graph": "g"} for p in (1, 2, 3, 4)]
    with pytest.raises(RuntimeError):
        stores.run_settings(store, "study", settings, make)
    assert made == [1, 2, 3] and [s["p"] for s in stores.pending(store, "study", settings)] == [3, 4]
    unfinished = spark._jvm.org.apache.hadoop.fs.Path(store.path("study", stores.setting_key(settings[1])) + "/_SUCCESS")
    unfinished.getFileSystem(spark._jsc.hadoopConfiguration()).delete(unfinished, False)  # as if its writer had been killed
    rows = stores.run_settings(store, "study", settings, make)
    assert made == [1, 2, 3, 2, 3, 4] and rows.count() == 10
    assert stores.run_settings(store, "study", [dict(reversed(list(s.items()))) for s in settings], make).count() == 10 and len(made) == 6


def test_network_files_with_headers_and_formats(spark, tmp_path):
    (tmp_path / "one.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% more\n6 6 3\n2 1\n3 2\n3 1\n")
    (tmp_path / "two.edges").write_text("% c\n5 6\n6 7\n")
    every = stores.load_networks(spark, {n: f"file://{tmp_path}/{f}" for n, f in (("one", "one.mtx"), ("two", "two.edges"))})
    assert {r.graph: (r.n, r.e) for r in every.sizes().collect()} == {"one": (6, 3), "two": (3, 2)}
    report = {r.graph: r for r in collection.preparation(every, collection.largest_components(every)).collect()}
    assert (report["one"].node_loss, report["one"].edge_loss, report["two"].node_loss) == (50.0, 0.0, 0.0)
    df = spark.createDataFrame([("x", 1.23456, None)], "a string, b double, c double")
    files.write_table(df.coalesce(1), f"file://{tmp_path}/out", float_format="%.2f")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").first().asDict() == {"a": "x", "b": "1.23", "c": None}
    place, got = stores.first_readable(spark, [f"file://{tmp_path}/none", f"file://{tmp_path}/out"], lambda p: spark.read.option("header", True).csv(p))
    assert place.endswith("/out") and got.count() == 1
    with pytest.raises(ValueError):
        stores.first_readable(spark, [f"file://{tmp_path}/none"], spark.read.parquet)


def test_louvain_writes_no_state_twice(spark, monkeypatch):
    """A round of moves writes its wishes and its state; the best state is kept, not copied, and is still there when it is read."""
    import pyspark.sql.functions as F
    from marram.operators import community

    names, plain = [], community.materialise
    monkeypatch.setattr(community, "materialise", lambda df, name="step": (names.append(name), plain(df, name))[1])
    ring = [(5 * c + i, 5 * c + j) for c in range(4) for i in range(5) for j in range(i)] + [(5 * c, 5 * c + 9) for c in range(3)]
    edges = spark.createDataFrame([(min(e), max(e)) for e in ring], "u long, v long")
    part = community.louvain(edges)
    assert part.agg(F.count("*")).first()[0] == 20 and community.modularity(edges, part) > 0.6
    assert "best" not in names
