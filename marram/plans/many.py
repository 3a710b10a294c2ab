"""Queries over many networks at once.

A network is a return flag and line status: the parts in its lines, tied where they share an order in them. Networks are
made from all lines, and a part that shares no order is a node without ties. Unless a query says otherwise it runs on each
network's largest component. Nodes are numbered over all networks, in SQL as in Spark, as hashed draws use these numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.operators import cliques as cl
from marram.operators import collection, graph, ranking, statistics
from marram.plans import graphs, runtime, study
from marram.plans.registry import CLIQUES, CORNERS, FIGURES, LOSSES, ORACLES, PREPARED, QUERIES, RIM, SH, constraint_terms, core_sql, distances_sql, labels_sql, query, r6, wilcoxon_sql  # noqa: F401  the entry takes both registries from here
from marram.sources.shared import materialise


def all_networks(spark: SparkSession, sf_dir: str) -> collection.Collection:
    return collection.collect_networks(graphs.co_shipped_parts(spark, sf_dir), graphs.shipped_parts(spark, sf_dir))


def networks(spark: SparkSession, sf_dir: str) -> collection.Collection:
    return collection.largest_components(all_networks(spark, sf_dir))


#: ids, e0 and adj0 of all networks; then their largest components: own(id, graph, node), e(u, v), adj, n, and figures of each: net(graph, nn, t).
RAW = """WITH RECURSIVE p0 AS MATERIALIZED (SELECT DISTINCT a.l_returnflag || a.l_linestatus AS graph, least(a.l_partkey, b.l_partkey) AS a, greatest(a.l_partkey, b.l_partkey) AS b
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus WHERE a.l_partkey < b.l_partkey),
ids AS MATERIALIZED (SELECT graph, node, row_number() OVER (ORDER BY graph, node) - 1 AS id FROM (SELECT DISTINCT l_returnflag || l_linestatus AS graph, l_partkey AS node FROM lineitem)),
e0 AS MATERIALIZED (SELECT x.id AS u, y.id AS v FROM p0 JOIN ids x ON x.graph = p0.graph AND x.node = p0.a JOIN ids y ON y.graph = p0.graph AND y.node = p0.b),
adj0 AS MATERIALIZED (SELECT u, v FROM e0 UNION ALL SELECT v, u FROM e0)"""
N = f"""{RAW}, {labels_sql('SELECT id FROM ids', 'adj0')},
big AS (SELECT graph, c FROM (SELECT graph, c, row_number() OVER (PARTITION BY graph ORDER BY count(*) DESC, c) AS i FROM l12 JOIN ids USING (id) GROUP BY graph, c) WHERE i = 1),
own AS MATERIALIZED (SELECT ids.id, ids.graph, ids.node FROM l12 JOIN big USING (c) JOIN ids ON ids.id = l12.id),
e AS MATERIALIZED (SELECT e0.u, e0.v FROM e0 JOIN own ON own.id = e0.u), {graphs.COMMON.strip()},
net AS MATERIALIZED (SELECT graph, count(*) AS nn, avg(k) / (avg(k * k) - avg(k)) AS t FROM n JOIN own ON own.id = n.node GROUP BY graph)"""

_LOCAL0 = """k0 AS MATERIALIZED (SELECT ids.graph, ids.id AS node, count(a.u) AS k FROM ids LEFT JOIN adj0 a ON a.u = ids.id GROUP BY ALL),
    t0 AS (SELECT a.u AS node, count(*) // 2 AS t FROM adj0 a JOIN adj0 b ON b.u = a.u AND b.v <> a.v JOIN adj0 c ON c.u = a.v AND c.v = b.v GROUP BY a.u),
    loc0 AS MATERIALIZED (SELECT graph, k, coalesce(t, 0) AS triangles, CASE WHEN k > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END AS clustering FROM k0 LEFT JOIN t0 USING (node))"""


@query(
    "networks_preparation",
    f"""{N}, {CORNERS}, {_LOCAL0}, a AS (SELECT graph, {FIGURES} FROM loc0 GROUP BY graph), b AS (SELECT graph, {FIGURES} FROM loc JOIN own ON own.id = loc.node GROUP BY graph),
    x AS (SELECT a.graph, {PREPARED} FROM a JOIN b USING (graph))
    SELECT *, {LOSSES}, round(100.0::DOUBLE * lcc_n / raw_n, 2) AS retained FROM x""",
)
def networks_preparation(spark, sf_dir):
    """What each network loses by its reduction to the largest component, nodes without ties included."""
    raw = all_networks(spark, sf_dir)
    return collection.preparation(raw, collection.largest_components(raw))


DIST = distances_sql(40)


@query(
    "networks_table",
    f"""{N}, {CORNERS}, {DIST}, a AS (SELECT graph, {FIGURES} FROM loc JOIN own ON own.id = loc.node GROUP BY graph), d AS (SELECT graph, avg(d) AS mean_distance, max(d)::BIGINT AS diameter FROM dist JOIN own ON own.id = dist.s GROUP BY graph)
    SELECT graph, n_nodes, n_edges, max_degree, round(m, 6) AS mean_degree, round(m2, 6) AS second_moment, round(m / (m2 - m), 6) AS threshold, round(2.0::DOUBLE * n_edges / (n_nodes * (n_nodes - 1)), 6) AS density, round(c, 6) AS clustering, round(3.0::DOUBLE * n_triangles / w, 6) AS transitivity, n_triangles, round(mean_distance, 6) AS mean_distance, diameter FROM a JOIN d USING (graph)""",
)
def networks_table(spark, sf_dir):
    """The basic figures of all networks, with mean distance and diameter."""
    table = collection.figures(networks(spark, sf_dir), distances=True)
    return table.select(*[r6(c).alias(c) if t == "double" else c for c, t in table.dtypes])


@query(
    "networks_cliques",
    f"""{N}, {CLIQUES}, p AS (SELECT own.graph, own.id, count(inc.clique) AS m FROM own LEFT JOIN inc ON inc.node = own.id GROUP BY ALL), g AS (SELECT own.graph, cq.size FROM cq JOIN own ON own.id = cq.members[1]),
    a AS (SELECT graph, count(*)::BIGINT AS n_cliques, max(size)::INT AS max_size, round(avg(size), 4) AS mean_size, quantile_cont(size::DOUBLE, 0.5) AS median_size, count(*) FILTER (size = 2)::BIGINT AS n_pairs, count(*) FILTER (size > 2)::BIGINT AS n_larger FROM g GROUP BY graph),
    b AS (SELECT graph, round(avg(m), 4) AS mean_memberships, quantile_cont(m::DOUBLE, 0.5) AS median_memberships, max(m)::BIGINT AS max_memberships, round(100.0::DOUBLE * count(*) FILTER (m >= 1) / count(*), 4) AS in_one, round(100.0::DOUBLE * count(*) FILTER (m >= 2) / count(*), 4) AS in_two FROM p GROUP BY graph)
    SELECT * FROM a JOIN b USING (graph)""",
)
def networks_cliques(spark, sf_dir):
    """Clique counts and memberships of all networks, from one search for cliques."""
    own = networks(spark, sf_dir)
    table = collection.clique_figures(own, cl.maximal_cliques(own.edges.select("u", "v")))
    return table.select(*[F.round(c, 4).alias(c) if c in ("mean_size", "mean_memberships", "in_one", "in_two") else c for c in table.columns])


#: The methods that SQL can repeat, and their scores ms(graph, method, node, score).
METHODS = ["degree", "core", "structural_holes", "improved_structural_holes", "collective_influence", "neighbourhood_constraint", "clique_participation", "clique_spread", "clique_full"]
SCORES = f"""{CORNERS}, {SH}, {RIM}, {CLIQUES}, {core_sql(30)}, {constraint_terms()},
    tot AS (SELECT a.u, sum(x.k + y.k) AS total FROM adj a JOIN n x ON x.node = a.u JOIN n y ON y.node = a.v GROUP BY a.u),
    ip AS MATERIALIZED (SELECT a.u, a.v, (x.k + y.k)::DOUBLE / tot.total AS p FROM adj a JOIN n x ON x.node = a.u JOIN n y ON y.node = a.v JOIN tot ON tot.u = a.u),
    ivia AS (SELECT t.i, t.j, sum(a.p * b.p) AS x FROM tri t JOIN ip a ON a.u = t.i AND a.v = t.q JOIN ip b ON b.u = t.q AND b.v = t.j GROUP BY ALL),
    mass AS MATERIALIZED (SELECT l.node, l.k * exp(l.clustering) AS mass, exp(sh.score - 1) / 2 AS w FROM loc l JOIN sh USING (node)),
    hood AS (SELECT node, node AS other FROM n UNION SELECT u, v FROM adj UNION SELECT a.u, b.v FROM adj a JOIN adj b ON b.u = a.v),
    big3 AS MATERIALIZED (SELECT * FROM inc WHERE size >= 3),
    ms0 AS (SELECT 'degree' AS method, n.node, n.k::DOUBLE / (net.nn - 1) AS score FROM n JOIN own ON own.id = n.node JOIN net USING (graph)
        UNION ALL SELECT 'core', node, c::DOUBLE FROM c30
        UNION ALL SELECT 'structural_holes', node, score FROM sh
        UNION ALL SELECT 'improved_structural_holes', ip.u, 1 - sum((ip.p + coalesce(v.x, 0)) ** 2) FROM ip LEFT JOIN ivia v ON v.i = ip.u AND v.j = ip.v GROUP BY ip.u
        UNION ALL SELECT 'collective_influence', n.node, ((n.k - 1) * coalesce(s.x, 0))::DOUBLE FROM n LEFT JOIN (SELECT rim.node, sum(n.k - 1) AS x FROM rim JOIN n ON n.node = rim.other GROUP BY rim.node) s USING (node)
        UNION ALL SELECT 'neighbourhood_constraint', m.node, m.w * m.w * m.mass * s.total FROM mass m JOIN (SELECT hood.node, sum(m.mass) AS total FROM hood JOIN mass m ON m.node = hood.other GROUP BY hood.node) s USING (node)
        UNION ALL SELECT 'clique_participation', n.node, count(inc.clique)::DOUBLE FROM n LEFT JOIN inc USING (node) GROUP BY n.node
        UNION ALL SELECT 'clique_spread', n.node, coalesce(s.score, 0)::DOUBLE FROM n LEFT JOIN (SELECT a.node, count(DISTINCT a.clique) * count(DISTINCT o.node) AS score FROM big3 a JOIN big3 o USING (clique) GROUP BY a.node) s USING (node)
        UNION ALL SELECT 'clique_full', node, score FROM cterm),
    ms AS MATERIALIZED (SELECT own.graph, method, ms0.node, score FROM ms0 JOIN own ON own.id = ms0.node),
    rk AS MATERIALIZED (SELECT graph, method, node, score, row_number() OVER (PARTITION BY graph, method ORDER BY round(score, 8) DESC, node) AS rank FROM ms)"""


def scores_of(own: collection.Collection, wanted: list[str]) -> DataFrame:
    """(graph, method, node, score) of all methods asked for; raises RuntimeError if one failed, as what the others have would pass for the result."""
    scores, failed = collection.score_all(own, wanted)
    if failed:
        raise RuntimeError(f"methods failed: {failed}")
    return scores


def ranks(own: collection.Collection, wanted: list[str] = METHODS) -> DataFrame:
    return materialise(collection.rank_all(scores_of(own, wanted)), "ranks")


@query("networks_ranks", f"{N}, {SCORES} SELECT rk.graph, method, own.node, round(score, 9) + 0.0 AS score, rank FROM rk JOIN own ON own.id = rk.node")
def networks_ranks(spark, sf_dir):
    """Every node of every network by nine methods: a job a method for all networks."""
    own = networks(spark, sf_dir)
    return own.named(ranks(own).drop("graph")).select("graph", "method", "node", (F.round("score", 9) + F.lit(0.0)).alias("score"), "rank")


#: The return flags and line statuses that there are.
GRAPHS = [flag + status for flag in "ANR" for status in "FO"]

#: The methods whose seeds are compared; the others are not scored for it.
SPREADERS = ["degree", "core", "collective_influence", "clique_full"]
PERCENTS, BLOCKS, REPEATS = [1, 2, 3], 4, 4
SPREAD = f"""{N}, {SCORES},
    seeds AS MATERIALIZED (SELECT rk.graph, rk.method, q.q AS percent_seeds, rk.node FROM rk JOIN net USING (graph), (SELECT unnest({PERCENTS}) AS q) q WHERE rk.method IN ('degree', 'core', 'collective_influence', 'clique_full') AND rk.rank <= greatest(1, net.nn * q.q // 100)),
    plan AS MATERIALIZED (SELECT graph, 2.5 * t AS beta, b.b * 1000 + r.r AS run FROM net, (SELECT unnest(range({BLOCKS})) AS b) b, (SELECT unnest(range({REPEATS})) AS r) r),
    inf(graph, method, percent_seeds, beta, run, node) AS (SELECT s.graph, s.method, s.percent_seeds, plan.beta, plan.run, s.node FROM seeds s JOIN plan USING (graph)
        UNION SELECT p.graph, p.method, p.percent_seeds, p.beta, p.run, a.v FROM inf p JOIN adj a ON a.u = p.node AND ('0x' || substr(md5(concat_ws('|', p.run, a.u, a.v)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < p.beta),
    ob AS MATERIALIZED (SELECT graph, method, percent_seeds, (run // 1000)::BIGINT AS block, 100.0::DOUBLE * avg(c) / any_value(nn) AS percent FROM (SELECT graph, method, percent_seeds, run, count(*) AS c FROM inf GROUP BY ALL) JOIN net USING (graph) GROUP BY ALL)"""


def spread_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = networks(spark, sf_dir)
    return study.networks_seed_ratio_study(own, ranks(own, SPREADERS), PERCENTS, blocks=BLOCKS, repeats=REPEATS)


@query("networks_spread", f"{SPREAD} SELECT graph, method, percent_seeds, block, round(percent, 6) AS percent FROM ob")
def networks_spread(spark, sf_dir):
    """Shares infected from the first nodes of four rankings in each network, at each network's own rate."""
    return spread_observed(spark, sf_dir).withColumn("percent", r6("percent"))


@query(
    "networks_comparison",
    f"""{SPREAD}, me AS MATERIALIZED (SELECT graph, method, round(avg(percent), 9) AS value FROM ob GROUP BY ALL),
    z AS (SELECT *, rank() OVER (PARTITION BY graph ORDER BY value DESC) + (count(*) OVER (PARTITION BY graph, value) - 1) / 2.0::DOUBLE AS r, max(value) OVER (PARTITION BY graph) AS top FROM me),
    pl AS (SELECT method, avg(r) AS mean_rank, count(*) FILTER (abs(value - top) <= 1e-9 * abs(top) AND r = 1)::BIGINT AS wins FROM z GROUP BY method),
    pr AS (SELECT o.method, t.value AS a, o.value AS b FROM me o JOIN me t ON t.graph = o.graph AND t.method = 'clique_full' WHERE o.method <> 'clique_full'), {wilcoxon_sql("method")},
    q0 AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, method) AS raw, row_number() OVER (ORDER BY p, method) AS rn FROM wt),
    q1 AS (SELECT *, least(1, min(raw) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM q0)
    SELECT pl.method, round(mean_rank, 6) AS mean_rank, wins, q1.n, round(r_rb, 6) AS r_rb, round(p, 6) AS p, round(q, 6) AS q FROM pl LEFT JOIN q1 ON q1.method = pl.method""",
)
def networks_comparison(spark, sf_dir):
    """Mean ranks, wins and tests of the clique score against the others over all networks, on what their seeds infect."""
    observed = spread_observed(spark, sf_dir).groupBy(F.col("graph").alias("network"), "method").agg(F.round(F.avg("percent"), 9).alias("value"))
    places = study.cross_network(observed, "clique_full")[1]
    return places.select("method", r6("mean_rank").alias("mean_rank"), "wins", "n", *[r6(c).alias(c) for c in ("r_rb", "p", "q")])


@query("vote_ties")
def vote_ties(spark, sf_dir):
    """In how many steps of each network's vote ranking the best votes were tied. SQL would need a step for each pick, so tests compare a plain version."""
    own = networks(spark, sf_dir)
    order = materialise(ranking.vote_rank(own.edges, own.nodes.select(F.col("id").alias("node"), "graph")), "votes")
    return ranking.vote_ties(own.edges, order)


@query(
    "networks_ties",
    f"""{N}, {SCORES}, f AS (SELECT graph, method, round(score, 8) AS s, count(*) AS n FROM ms WHERE method IN ('degree', 'core', 'clique_participation') GROUP BY ALL)
    SELECT graph, method, count(*)::BIGINT AS n_groups, max(n)::BIGINT AS largest, round(avg(n), 6) AS mean_size, count(*) FILTER (n > 1)::BIGINT AS n_tied_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_tied FROM f GROUP BY ALL""",
)
def networks_ties(spark, sf_dir):
    """Groups of equal scores of three methods in each network."""
    own = networks(spark, sf_dir)
    scores = scores_of(own, ["degree", "core", "clique_participation"])
    groups = scores.groupBy("graph", "method", F.round("score", 8).alias("s")).agg(F.count("*").alias("n"))
    return statistics.frequency_summary(groups, ["graph", "method"]).withColumn("mean_size", r6("mean_size"))


@query(
    "networks_correlations",
    f"""{N}, {CORNERS}, {CLIQUES}, v0 AS (SELECT own.graph, n.k::DOUBLE AS x, count(inc.clique)::DOUBLE - 1 AS y FROM n JOIN own ON own.id = n.node LEFT JOIN inc ON inc.node = n.node GROUP BY own.graph, n.node, n.k),
    v AS MATERIALIZED (SELECT * FROM v0 UNION ALL SELECT 'ALL', x, y FROM v0),
    r AS (SELECT graph, rank() OVER (PARTITION BY graph ORDER BY x) + (count(*) OVER (PARTITION BY graph, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY graph ORDER BY y) + (count(*) OVER (PARTITION BY graph, y) - 1) / 2.0::DOUBLE AS ry FROM v),
    a AS (SELECT graph, count(*)::BIGINT AS n, corr(x, y) AS p, count(*) FILTER (x > 0 AND y > 0)::BIGINT AS n_log, corr(log10(x), log10(CASE WHEN y > 0 THEN y END)) FILTER (x > 0 AND y > 0) AS l FROM v GROUP BY graph)
    SELECT a.graph, n, round(p, 6) AS pearson, round(s, 6) AS spearman, n_log, round(l, 6) AS log_log FROM a JOIN (SELECT graph, corr(rx, ry) AS s FROM r GROUP BY graph) USING (graph)""",
)
def networks_correlations(spark, sf_dir):
    """Degree against further cliques (beyond the first) of each node: straight, by ranks and on logarithms, in each network and in all."""
    own = networks(spark, sf_dir)
    k = graph.degrees(own.edges)
    found = cl.incidence(cl.maximal_cliques(own.edges.select("u", "v"))).groupBy("node").agg(F.count("*").alias("n"))
    rows = own.nodes.select("graph", F.col("id").alias("node")).join(k, "node").join(found, "node", "left").select("graph", "k", (F.coalesce("n", F.lit(0)) - 1).alias("y"))
    table = statistics.correlation_table(rows, "graph", "k", "y")
    return table.select("graph", "n", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"), "n_log", r6("log_log").alias("log_log"))


SHARES = [2, 4, 6, 8, 10]


@query(
    "networks_dispersion",
    f"""{N}, {SCORES}, {DIST},
    s AS MATERIALIZED (SELECT rk.graph, rk.method, q.q AS percent, rk.node, net.nn FROM rk JOIN net USING (graph), (SELECT unnest({SHARES}) AS q) q WHERE rk.rank <= least(net.nn, greatest(2, ceil(net.nn * q.q / 100.0)))),
    pz AS MATERIALIZED (SELECT a.graph, a.method, a.percent, a.node AS i, b.node AS j, a.nn FROM s a JOIN s b ON a.graph = b.graph AND a.method = b.method AND a.percent = b.percent AND a.node < b.node),
    pd AS MATERIALIZED (SELECT DISTINCT i, j FROM pz),
    m AS (SELECT i, j, count(*) AS x FROM pd JOIN adj a ON a.u = pd.i JOIN adj b ON b.u = pd.j AND b.v = a.v GROUP BY ALL),
    kk AS (SELECT graph, method, percent, count(*)::BIGINT AS k FROM s GROUP BY ALL),
    di AS MATERIALIZED (SELECT pz.graph, pz.method, pz.percent, avg(coalesce(dist.d, pz.nn)) AS far, avg(coalesce(m.x, 0)::DOUBLE / (na.k + nb.k - coalesce(m.x, 0))) AS near
        FROM pz JOIN n na ON na.node = pz.i JOIN n nb ON nb.node = pz.j LEFT JOIN dist ON dist.s = pz.i AND dist.v = pz.j LEFT JOIN m ON m.i = pz.i AND m.j = pz.j GROUP BY ALL),
    al AS (SELECT kk.*, coalesce(far, 0) AS far, near FROM kk LEFT JOIN di USING (graph, method, percent)),
    av AS (SELECT graph, method, avg(far) AS average FROM al GROUP BY ALL),
    sc AS (SELECT *, max(average) OVER w - min(average) OVER w AS span, average - min(average) OVER w AS above FROM av WINDOW w AS (PARTITION BY graph))
    SELECT graph, method, percent::INT AS percent, k, round(far, 6) AS mean_distance, round(near, 6) AS mean_jaccard, round(average, 6) AS average, round(CASE WHEN span > 1e-12 THEN above / span ELSE 0.5 END, 6) AS scaled FROM al JOIN sc USING (graph, method)""",
)
def networks_dispersion(spark, sf_dir):
    """How far apart and how alike the first nodes of nine rankings are, in five shares of each network's nodes: one search for all of them."""
    own = networks(spark, sf_dir)
    table = study.networks_dispersion_study(own, ranks(own), SHARES)
    return table.select(*[r6(c).alias(c) if t == "double" else c for c, t in table.dtypes])


@query("networks_frequencies", f"{N}, {SCORES} SELECT graph, method, min(rank)::BIGINT AS rank, count(*)::BIGINT AS n FROM rk GROUP BY graph, method, round(score, 8)")
def networks_frequencies(spark, sf_dir):
    """How many nodes share each rank of nine rankings in each network."""
    return collection.frequencies(ranks(networks(spark, sf_dir)))


@query(
    "networks_monotonicity",
    f"""{N}, {SCORES}, f AS (SELECT graph, method, count(*) AS n FROM ms GROUP BY graph, method, round(score, 8)),
    m AS (SELECT graph, method, CASE WHEN sum(n) > 1 THEN (1 - sum(n * (n - 1))::DOUBLE / (sum(n) * (sum(n) - 1))) ** 2 ELSE 1 END AS m FROM f GROUP BY ALL)
    SELECT method, {", ".join(f"round(max(m) FILTER (graph = '{x}'), 6) AS {x}" for x in GRAPHS)}, round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m), 0), 6) AS std FROM m GROUP BY method""",
)
def networks_monotonicity(spark, sf_dir):
    """How finely nine methods tell nodes apart: a row a method, a column a network, mean and standard deviation over the networks."""
    own = networks(spark, sf_dir)
    told = materialise(statistics.monotonicity(ranks(own), 8, ["graph", "method"]), "monotonicity")
    spans = told.groupBy("method").agg(F.avg("monotonicity").alias("mean"), F.coalesce(F.stddev_samp("monotonicity"), F.lit(0.0)).alias("std"))
    wide = statistics.pivoted(told, ["method"], "graph", "monotonicity", GRAPHS).join(spans, "method")
    return wide.select("method", *[r6(c).alias(c) for c in (*GRAPHS, "mean", "std")])


LEADING, EXACT = 50, ["degree", "core", "collective_influence", "clique_participation"]


@query(
    "networks_leading",
    f"""{N}, {SCORES}, f AS MATERIALIZED (SELECT * FROM (SELECT graph, method, node, score, row_number() OVER (PARTITION BY graph, method ORDER BY score DESC, node) AS place FROM ms WHERE method IN ({", ".join(f"'{m}'" for m in EXACT)})) WHERE place <= {LEADING}),
    i AS (SELECT a.graph, a.method, a.node, count(*) AS inside FROM f a JOIN adj ON adj.u = a.node JOIN f b ON b.graph = a.graph AND b.method = a.method AND b.node = adj.v GROUP BY ALL),
    r AS (SELECT f.graph, f.method, f.place, own.node, f.score, n.k AS degree, coalesce(i.inside, 0) AS inside FROM f JOIN own ON own.id = f.node JOIN n ON n.node = f.node LEFT JOIN i ON i.graph = f.graph AND i.method = f.method AND i.node = f.node)
    SELECT g.graph, g.method, p.p::BIGINT AS place, r.node, round(r.score, 9) AS score, r.degree::BIGINT AS degree, r.inside::BIGINT AS inside FROM (SELECT DISTINCT graph, method FROM f) g CROSS JOIN (SELECT unnest(range(1, {LEADING + 1})) AS p) p LEFT JOIN r ON r.graph = g.graph AND r.method = g.method AND r.place = p.p""",
)
def networks_leading(spark, sf_dir):
    """The first 50 nodes of four rankings in each network, with their ties and those to each other; a top-k report."""
    own = networks(spark, sf_dir)
    return study.leading_nodes(own, scores_of(own, EXACT), LEADING).withColumn("score", F.round("score", 9) + F.lit(0.0))


# --- run time ---


@query("stage_runtime")
def stage_runtime(spark, sf_dir):
    """Seconds of preparation, cliques and scores on two graphs of all lines, one of each line status (parts that share an order in lines of one flag and status), and what each stage made.

    Times differ from run to run, so there is no SQL; edges, cliques and scored nodes don't.
    """
    pairs = materialise(graphs.co_shipped_parts(spark, sf_dir).select(F.right("graph", F.lit(1)).alias("status"), "u", "v"), "pairs")
    runs = [runtime.stage_times(spark, s, lambda s=s: pairs.where(F.col("status") == s).select("u", "v")) for s in ("F", "O")]
    times = runs[0].union(runs[1])
    spent = runtime.wide(runtime.summary(times, ["graph"]), ["graph"], runtime.STAGES)
    made = statistics.pivoted(times, ["graph"], "name", "rows", list(runtime.STAGES)).toDF("graph", "n_edges", "n_cliques", "n_scores")
    failed = times.groupBy("graph").agg(F.count_if(F.col("error") != "").alias("failed"))
    return spent.toDF("graph", *[f"{s}_seconds" for s in runtime.STAGES]).join(made, "graph").join(failed, "graph")
