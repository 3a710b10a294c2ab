"""The engine's queries over the driver tables, and their SQL.

Unless a query says otherwise its graph is G: parts that share an order in lines of quantity 40 or more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marram.operators import cliques as cl
from marram.operators import community, controls, graph, paths, ranking, spread, statistics, synthetic
from marram.operators.permute import permuted_sql
from marram.plans import graphs, study
from marram.plans.graphs import parts_sql, users_sql
from marram.sources.shared import materialise, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(graphs.co_ordered_parts(spark, sf_dir), "graph")


def r6(c: str | Column) -> Column:
    """Rounded for comparison; no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def scored(df: DataFrame) -> DataFrame:
    return df.select("node", r6("score").alias("score"))


G = parts_sql()

# --- graph preparation and whole-graph metrics ---


@query("degree_rank", f"{G} SELECT node, k, row_number() OVER (ORDER BY k DESC, node) AS rank FROM n")
def degree_rank(spark, sf_dir):
    k = graph.degrees(g(spark, sf_dir))
    return ranking.ranked(k.withColumn("score", F.col("k").cast("double"))).select("node", F.col("score").cast("long").alias("k"), "rank")


CORNERS = """
tri AS MATERIALIZED (SELECT a.u AS i, a.v AS j, b.v AS q FROM adj a JOIN adj b ON a.u = b.u AND a.v <> b.v JOIN adj c ON c.u = a.v AND c.v = b.v),
loc AS MATERIALIZED (SELECT n.node, n.k, coalesce(t.t, 0)::BIGINT AS triangles, CASE WHEN n.k > 1 THEN 2.0::DOUBLE * coalesce(t.t, 0) / (n.k * (n.k - 1)) ELSE 0.0::DOUBLE END AS clustering
        FROM n LEFT JOIN (SELECT i, count(*) // 2 AS t FROM tri GROUP BY i) t ON t.i = n.node)"""


@query("clustering", f"{G},{CORNERS} SELECT node, k, triangles, round(clustering, 6) AS clustering FROM loc")
def clustering(spark, sf_dir):
    return graph.clustering(g(spark, sf_dir)).select("node", "k", "triangles", r6("clustering").alias("clustering"))


@query(
    "graph_stats",
    f"""{G},{CORNERS}, a AS (SELECT count(*)::BIGINT AS n_nodes, (sum(k) // 2)::BIGINT AS n_edges, max(k) AS max_degree, avg(k) AS m, avg(k * k) AS m2, avg(clustering) AS c, (sum(triangles) // 3)::BIGINT AS n_triangles, sum(k * (k - 1) / 2)::DOUBLE AS w FROM loc)
    SELECT n_nodes, n_edges, max_degree, round(m, 6) AS mean_degree, round(m2, 6) AS second_moment, round(m / (m2 - m), 6) AS threshold, round(2.0::DOUBLE * n_edges / (n_nodes * (n_nodes - 1)), 6) AS density, round(c, 6) AS clustering, round(3.0::DOUBLE * n_triangles / w, 6) AS transitivity, n_triangles FROM a""",
)
def graph_stats(spark, sf_dir):
    doubles = ("mean_degree", "second_moment", "threshold", "density", "clustering", "transitivity")
    return graph.summary(g(spark, sf_dir)).select(*[r6(c).alias(c) if c in doubles else c for c in ("n_nodes", "n_edges", "max_degree", "mean_degree", "second_moment", "threshold", "density", "clustering", "transitivity", "n_triangles")])


def labels_sql(nodes: str, adj: str, rounds: int = 12) -> str:
    """l{rounds}(id, c): components of the nodes (id) by least labels: the least of a node and its neighbours, then the label's own label."""
    steps = [f"l0 AS MATERIALIZED (SELECT id, id AS c FROM ({nodes}))"]
    for t in range(rounds):
        steps.append(f"h{t} AS MATERIALIZED (SELECT l.id, least(l.c, coalesce(min(x.c), l.c)) AS c FROM l{t} l LEFT JOIN {adj} a ON a.u = l.id LEFT JOIN l{t} x ON x.id = a.v GROUP BY l.id, l.c)")
        steps.append(f"l{t + 1} AS MATERIALIZED (SELECT h.id, least(h.c, j.c) AS c FROM h{t} h JOIN h{t} j ON j.id = h.c)")
    return ", ".join(steps)


#: The graph of all lines: parts that share an order.
ALL = parts_sql(0)
COMPONENTS = f"{labels_sql('SELECT node AS id FROM n', 'adj')}, comp AS MATERIALIZED (SELECT id AS node, c AS component FROM l12)"


def all_parts(spark, sf_dir):
    return materialise(graphs.co_ordered_parts(spark, sf_dir, 0), "graph")


@query("components", f"{ALL},{COMPONENTS} SELECT node, component, count(*) OVER (PARTITION BY component)::BIGINT AS size FROM comp")
def components(spark, sf_dir):
    """On the parts of all lines."""
    return graph.component_sizes(all_parts(spark, sf_dir))


LARGEST = """
big AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1),
kept AS MATERIALIZED (SELECT node FROM comp JOIN big USING (component)),
lab AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS label FROM kept)"""


@query("largest_component", f"{ALL},{COMPONENTS},{LARGEST} SELECT a.label AS u, b.label AS v FROM e JOIN lab a ON a.node = e.u JOIN lab b ON b.node = e.v")
def largest_component(spark, sf_dir):
    edges = materialise(graph.largest_component(all_parts(spark, sf_dir)), "component")
    labels = materialise(graph.relabel(edges), "labels")
    a, b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in ("u", "v"))
    return edges.join(a, "u").join(b, "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))


FIGURES = "count(*)::BIGINT AS n_nodes, (sum(k) // 2)::BIGINT AS n_edges, max(k)::BIGINT AS max_degree, avg(k) AS m, avg(k * k) AS m2, avg(clustering) AS c, (sum(triangles) // 3)::BIGINT AS n_triangles, sum(k * (k - 1) / 2)::DOUBLE AS w"
#: From figures a of what was and b of what is kept, joined as x: what was lost.
PREPARED = "a.n_nodes AS raw_n, a.n_edges AS raw_e, a.max_degree AS raw_kmax, round(a.c, 4) AS raw_c, round(a.m / (a.m2 - a.m), 5) AS raw_beta, b.n_nodes AS lcc_n, b.n_edges AS lcc_e, b.max_degree AS lcc_kmax, round(b.c, 4) AS lcc_c, round(b.m / (b.m2 - b.m), 5) AS lcc_beta"
LOSSES = "round(100.0::DOUBLE * (raw_n - lcc_n) / raw_n, 2) AS node_loss, round(100.0::DOUBLE * (raw_e - lcc_e) / raw_e, 2) AS edge_loss, round(abs(raw_c - lcc_c), 4) AS delta_c, round(abs(raw_beta - lcc_beta), 5) AS delta_beta"


@query("preparation", f"{ALL},{CORNERS},{COMPONENTS},{LARGEST}, a AS (SELECT {FIGURES} FROM loc), b AS (SELECT {FIGURES} FROM loc JOIN kept USING (node)), x AS (SELECT {PREPARED} FROM a, b) SELECT *, {LOSSES} FROM x")
def preparation(spark, sf_dir):
    """What the reduction to the largest component loses, on the parts of all lines."""
    edges = all_parts(spark, sf_dir)
    return graph.preparation_report(edges, materialise(graph.largest_component(edges), "component"))


# --- scores from local structure ---


@query("degree_centrality", f"{G} SELECT node, round(k::DOUBLE / ((SELECT count(*) FROM n) - 1), 6) AS score FROM n")
def degree_centrality(spark, sf_dir):
    return scored(ranking.degree_centrality(g(spark, sf_dir)))


SH = """
via AS (SELECT t.i, t.j, sum((1.0::DOUBLE / ni.k) * (1.0::DOUBLE / nq.k)) AS x FROM tri t JOIN n ni ON ni.node = t.i JOIN n nq ON nq.node = t.q GROUP BY ALL),
sh AS MATERIALIZED (SELECT a.u AS node, 1 - sum((1.0::DOUBLE / n.k + coalesce(via.x, 0)) ** 2) AS score FROM adj a JOIN n ON n.node = a.u LEFT JOIN via ON via.i = a.u AND via.j = a.v GROUP BY a.u)"""


@query("structural_holes", f"{G},{CORNERS},{SH} SELECT node, round(score, 6) AS score FROM sh")
def structural_holes(spark, sf_dir):
    return scored(ranking.structural_holes(g(spark, sf_dir)))


@query(
    "improved_structural_holes",
    f"""{G},{CORNERS}, tot AS (SELECT a.u, sum(x.k + y.k) AS total FROM adj a JOIN n x ON x.node = a.u JOIN n y ON y.node = a.v GROUP BY a.u),
    p AS MATERIALIZED (SELECT a.u, a.v, (x.k + y.k)::DOUBLE / tot.total AS p FROM adj a JOIN n x ON x.node = a.u JOIN n y ON y.node = a.v JOIN tot ON tot.u = a.u),
    via AS (SELECT t.i, t.j, sum(a.p * b.p) AS x FROM tri t JOIN p a ON a.u = t.i AND a.v = t.q JOIN p b ON b.u = t.q AND b.v = t.j GROUP BY ALL)
    SELECT p.u AS node, round(1 - sum((p.p + coalesce(via.x, 0)) ** 2), 6) AS score FROM p LEFT JOIN via ON via.i = p.u AND via.j = p.v GROUP BY p.u""",
)
def improved_structural_holes(spark, sf_dir):
    return scored(ranking.improved_structural_holes(g(spark, sf_dir)))


RIM = "rim AS (SELECT DISTINCT a.u AS node, b.v AS other FROM adj a JOIN adj b ON b.u = a.v WHERE b.v <> a.u AND NOT EXISTS (SELECT 1 FROM adj c WHERE c.u = a.u AND c.v = b.v))"


@query("collective_influence", f"{G},{RIM}, s AS (SELECT rim.node, sum(n.k - 1) AS x FROM rim JOIN n ON n.node = rim.other GROUP BY rim.node) SELECT n.node, ((n.k - 1) * coalesce(x, 0))::DOUBLE AS score FROM n LEFT JOIN s USING (node)")
def collective_influence(spark, sf_dir):
    return scored(ranking.collective_influence(g(spark, sf_dir)))


@query(
    "neighbourhood_constraint",
    f"""{G},{CORNERS},{SH}, m AS MATERIALIZED (SELECT l.node, l.k * exp(l.clustering) AS mass, exp(sh.score - 1) / 2 AS w FROM loc l JOIN sh USING (node)),
    hood AS (SELECT node, node AS other FROM n UNION SELECT u, v FROM adj UNION SELECT a.u, b.v FROM adj a JOIN adj b ON b.u = a.v),
    s AS (SELECT hood.node, sum(m.mass) AS total FROM hood JOIN m ON m.node = hood.other GROUP BY hood.node)
    SELECT m.node, round(m.w * m.w * m.mass * s.total, 6) AS score FROM m JOIN s USING (node)""",
)
def neighbourhood_constraint(spark, sf_dir):
    return scored(ranking.neighbourhood_constraint(g(spark, sf_dir)))


def core_sql(rounds: int) -> str:
    steps = ["c0 AS MATERIALIZED (SELECT node, k AS c FROM n)"]
    for t in range(rounds):
        steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT o.node, least(o.c, h.h) AS c FROM c{t} o JOIN (
            SELECT u, max(least(rn, c)) AS h FROM (SELECT a.u, x.c, row_number() OVER (PARTITION BY a.u ORDER BY x.c DESC) AS rn FROM adj a JOIN c{t} x ON x.node = a.v) GROUP BY u) h ON h.u = o.node)""")
    return ", ".join(steps)


@query("core_numbers", f"{G}, {core_sql(30)} SELECT node, c::DOUBLE AS score FROM c30")
def core_numbers(spark, sf_dir):
    return ranking.core_numbers(g(spark, sf_dir))


@query(
    "community_bridges",
    f"""{G}, p AS MATERIALIZED (SELECT n.node, p_brand AS c FROM n JOIN part ON p_partkey = n.node), s AS (SELECT c, count(*) AS size FROM p GROUP BY c)
    SELECT a.u AS node, (max(s.size) * count(*) FILTER (x.c = y.c) + count(*) FILTER (x.c <> y.c) * count(DISTINCT CASE WHEN x.c <> y.c THEN y.c END))::DOUBLE AS score
    FROM adj a JOIN p x ON x.node = a.u JOIN p y ON y.node = a.v JOIN s ON s.c = x.c GROUP BY a.u""",
)
def community_bridges(spark, sf_dir):
    """The partition is the parts' brand."""
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))
    return ranking.community_bridges(g(spark, sf_dir), brands)


@query("vote_rank")
def vote_rank(spark, sf_dir):
    """Every node; SQL would need a step for each, so tests compare a plain version."""
    return ranking.vote_rank(g(spark, sf_dir))


@query("communities")
def communities(spark, sf_dir):
    """Louvain communities; see the operator for its order of moves."""
    return community.louvain(g(spark, sf_dir))


# --- cliques ---

CLIQUES = """
nb AS MATERIALIZED (SELECT u, list(v) AS l FROM adj GROUP BY u),
grow(members, common) AS (SELECT [u], l FROM nb UNION ALL
    SELECT list_append(x.members, x.x), list_intersect(x.common, nb.l) FROM (SELECT members, common, unnest(common) AS x FROM grow) x JOIN nb ON nb.u = x.x WHERE x.x > x.members[-1]),
cq AS MATERIALIZED (SELECT row_number() OVER (ORDER BY members) AS clique, members, len(members)::INT AS size FROM grow WHERE len(common) = 0),
inc AS MATERIALIZED (SELECT clique, size, unnest(members) AS node FROM cq)"""


def g_cliques(spark, sf_dir):
    edges = g(spark, sf_dir)
    return edges, cl.maximal_cliques(edges)


@query("maximal_cliques", f"{G},{CLIQUES} SELECT array_to_string(members, '-') AS members, size FROM cq")
def maximal_cliques(spark, sf_dir):
    return g_cliques(spark, sf_dir)[1].select(F.array_join(F.transform("members", lambda m: m.cast("string")), "-").alias("members"), "size")


@query("clique_sizes", f"{G},{CLIQUES} SELECT size, count(*)::BIGINT AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM cq), 4) AS percent FROM cq GROUP BY size")
def clique_sizes(spark, sf_dir):
    return cl.clique_sizes(g_cliques(spark, sf_dir)[1]).withColumn("percent", F.round("percent", 4))


@query("clique_memberships", f"{G},{CLIQUES}, p AS (SELECT n.node, count(inc.clique)::BIGINT AS memberships FROM n LEFT JOIN inc USING (node) GROUP BY n.node) SELECT memberships, count(*)::BIGINT AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM p), 4) AS percent FROM p GROUP BY memberships")
def clique_memberships(spark, sf_dir):
    return cl.memberships(*g_cliques(spark, sf_dir)).withColumn("percent", F.round("percent", 4))


@query(
    "clique_statistics",
    f"""{G},{CLIQUES}, p AS (SELECT n.node, count(inc.clique) AS m FROM n LEFT JOIN inc USING (node) GROUP BY n.node)
    SELECT (SELECT count(*) FROM cq)::BIGINT AS n_cliques, (SELECT max(size) FROM cq) AS max_size, round((SELECT avg(size) FROM cq), 4) AS mean_size, (SELECT quantile_cont(size::DOUBLE, 0.5) FROM cq) AS median_size,
           (SELECT count(*) FILTER (size = 2) FROM cq)::BIGINT AS n_pairs, (SELECT count(*) FILTER (size > 2) FROM cq)::BIGINT AS n_larger,
           round(avg(m), 4) AS mean_memberships, quantile_cont(m::DOUBLE, 0.5) AS median_memberships, max(m)::BIGINT AS max_memberships, round(100.0::DOUBLE * count(*) FILTER (m >= 1) / count(*), 4) AS in_one, round(100.0::DOUBLE * count(*) FILTER (m >= 2) / count(*), 4) AS in_two FROM p""",
)
def clique_statistics(spark, sf_dir):
    df = cl.clique_statistics(*g_cliques(spark, sf_dir))
    return df.select(*[F.round(c, 4).alias(c) if c in ("mean_size", "mean_memberships", "in_one", "in_two") else c for c in df.columns])


@query("clique_participation", f"{G},{CLIQUES} SELECT n.node, count(inc.clique)::DOUBLE AS score FROM n LEFT JOIN inc USING (node) GROUP BY n.node")
def clique_participation(spark, sf_dir):
    return scored(cl.clique_participation(*g_cliques(spark, sf_dir)))


@query("clique_spread", f"{G},{CLIQUES}, b AS MATERIALIZED (SELECT * FROM inc WHERE size >= 3) SELECT n.node, coalesce(s.score, 0)::DOUBLE AS score FROM n LEFT JOIN (SELECT a.node, count(DISTINCT a.clique) * count(DISTINCT o.node) AS score FROM b a JOIN b o USING (clique) GROUP BY a.node) s USING (node)")
def clique_spread(spark, sf_dir):
    return scored(cl.clique_spread(*g_cliques(spark, sf_dir)))


@query("score_e", f"{G},{CLIQUES} SELECT inc.node, sum(greatest(0, n.k - (inc.size - 1)))::DOUBLE AS score FROM inc JOIN n USING (node) GROUP BY inc.node")
def score_e(spark, sf_dir):
    return scored(cl.external_degree_sum(*g_cliques(spark, sf_dir)))


def constraint_terms(*, overlap: bool = True, external: bool = True, transform: str = "log", norm: str = "max") -> str:
    """cterm(node, score), in the literal form over pairs of cliques."""
    phi = {"log": "ln(1 + x)", "linear": "x", "boxcox": "2 * (sqrt(1.0 + x) - 1)"}[transform]
    p = f"(1 - press / ({norm}(press) OVER (PARTITION BY clique) + {cl.XI})) / l" if external else "1.0::DOUBLE / l"
    indirect = "coalesce((SELECT sum(b.p * greatest(0, sh.n - 1) / (b.size - 1)) FROM cp b JOIN cshared sh ON sh.a = a.clique AND sh.b = b.clique WHERE b.node = a.node AND b.clique <> a.clique), 0)" if overlap else "0"
    shared = "cshared AS MATERIALIZED (SELECT a.clique AS a, b.clique AS b, count(*) AS n FROM inc a JOIN inc b ON a.node = b.node AND a.clique <> b.clique GROUP BY ALL)," if overlap else ""
    return f"""{shared}
    cx AS (SELECT inc.*, n.k, greatest(0, n.k - (inc.size - 1)) AS ext, count(*) OVER (PARTITION BY inc.node) AS l FROM inc JOIN n USING (node)),
    cy AS (SELECT *, sum(ext) OVER (PARTITION BY clique) - ext AS x FROM cx),
    cz AS (SELECT *, ext + CASE WHEN x <= 0 THEN 0.0::DOUBLE ELSE {phi} END AS press FROM cy),
    cp AS MATERIALIZED (SELECT node, clique, size, {p} AS p FROM cz),
    ct AS (SELECT a.node, a.p + {indirect} AS term FROM cp a),
    cterm AS (SELECT node, 1 - sum(term * term) AS score FROM ct GROUP BY node)"""


def constraint_sql(**options) -> str:
    return f"{G},{CLIQUES}, {constraint_terms(**options)} SELECT node, round(score, 6) + 0.0 AS score FROM cterm"


def _variant(name: str, options: dict) -> None:
    @query(f"score_{name}", constraint_sql(**options))
    def score(spark, sf_dir):
        return scored(cl.clique_constraint(*g_cliques(spark, sf_dir), **options))


for _name, _options in cl.VARIANTS.items():
    _variant(_name, _options)

# --- distances ---


def distances_sql(levels: int) -> str:
    steps = ["d0 AS MATERIALIZED (SELECT node AS s, node AS v, 0 AS d FROM n)", "d1 AS MATERIALIZED (SELECT u AS s, v, 1 AS d FROM adj)"]
    for d in range(2, levels + 1):
        steps.append(f"d{d} AS MATERIALIZED (SELECT DISTINCT p.s, a.v, {d} AS d FROM d{d - 1} p JOIN adj a ON a.u = p.v ANTI JOIN d{d - 1} x ON x.s = p.s AND x.v = a.v ANTI JOIN d{d - 2} y ON y.s = p.s AND y.v = a.v)")
    return ", ".join(steps) + ", dist AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM d{d}" for d in range(1, levels + 1)) + ")"


DIST = distances_sql(16)


@query("closeness", f"{G}, {DIST} SELECT s AS node, round(count(*)::DOUBLE / sum(d) * count(*) / ((SELECT count(*) FROM n) - 1), 6) AS score FROM dist GROUP BY s")
def closeness(spark, sf_dir):
    return scored(paths.closeness(g(spark, sf_dir)))


@query("path_statistics", f"{G}, {DIST} SELECT round(avg(d), 6) AS mean_distance, max(d)::BIGINT AS diameter, (SELECT min(m) FROM (SELECT max(d) AS m FROM dist GROUP BY s))::BIGINT AS radius FROM dist")
def path_statistics(spark, sf_dir):
    return paths.path_statistics(g(spark, sf_dir)).withColumn("mean_distance", r6("mean_distance"))


@query(
    "betweenness",
    f"""{users_sql()}, {distances_sql(8)}, dd AS MATERIALIZED (SELECT s, v, d FROM dist),
    p1 AS MATERIALIZED (SELECT s, v, d, 1.0::DOUBLE AS c FROM dd WHERE d = 1),
    {", ".join(f"p{d} AS MATERIALIZED (SELECT x.s, x.v, x.d, sum(p.c) AS c FROM dd x JOIN adj a ON a.v = x.v JOIN p{d - 1} p ON p.s = x.s AND p.v = a.u WHERE x.d = {d} GROUP BY ALL)" for d in range(2, 9))},
    sig AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM p{d}" for d in range(1, 9))}),
    b AS (SELECT x.v AS node, sum(x.c * y.c / z.c) AS b FROM sig x JOIN sig y ON y.s = x.v AND y.v <> x.s JOIN sig z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d GROUP BY x.v)
    SELECT n.node, round(coalesce(b.b, 0) / (((SELECT count(*) FROM n) - 1) * ((SELECT count(*) FROM n) - 2)), 6) AS score FROM n LEFT JOIN b USING (node)""",
)
def betweenness(spark, sf_dir):
    """On the graph of users in step."""
    return scored(paths.betweenness(materialise(graphs.users_in_step(spark, sf_dir), "graph")))


# --- seeds ---

TOP = "r AS MATERIALIZED (SELECT node, k, row_number() OVER (ORDER BY k DESC, node) AS rank FROM n), c AS (SELECT count(*) AS nn FROM n)"


def degree_ranking(edges: DataFrame) -> DataFrame:
    return materialise(ranking.ranked(graph.degrees(edges).select("node", F.col("k").cast("double").alias("score"))), "ranking")


def degree_seeds(edges: DataFrame, percent: int, rule: str = "floor1") -> DataFrame:
    r = degree_ranking(edges)
    return materialise(r.where(F.col("rank") <= ranking.seed_count(r.count(), percent, rule)).select("node"), "seeds")


@query("top_percent", f"{G}, {TOP} SELECT p.p AS percent, r.node, r.rank FROM r, c, (SELECT unnest(range(1, 11))::INT AS p) p WHERE r.rank <= greatest(1, c.nn * p.p // 100)")
def top_percent(spark, sf_dir):
    r = degree_ranking(g(spark, sf_dir))
    n = r.count()
    counts = spark.createDataFrame([(p, ranking.seed_count(n, p)) for p in range(1, 11)], "percent int, seeds long")
    return r.join(F.broadcast(counts), F.col("rank") <= F.col("seeds")).select("percent", "node", "rank")  # ten rows are broadcast


@query("boundary_ties", f"{G}, {TOP}, s AS (SELECT k, count(*) AS size, min(rank) - 1 AS before FROM r GROUP BY k) SELECT p.p AS percent, s.k::DOUBLE AS score, s.size::BIGINT AS size, (greatest(1, ceil(c.nn * p.p / 100.0))::BIGINT - s.before)::BIGINT AS needed FROM s, c, (SELECT unnest(range(1, 11))::INT AS p) p WHERE s.before < greatest(1, ceil(c.nn * p.p / 100.0)) AND greatest(1, ceil(c.nn * p.p / 100.0)) < s.before + s.size")
def boundary_ties(spark, sf_dir):
    """Percentages whose cut falls inside a group of equal degrees: its score, size and the nodes still needed from it."""
    r = degree_ranking(g(spark, sf_dir))
    n = r.count()
    groups = r.groupBy(F.round("score", 6).alias("score")).agg(F.count("*").alias("size"), (F.min("rank") - 1).alias("before"))
    counts = spark.createDataFrame([(p, ranking.seed_count(n, p, "ceil1")) for p in range(1, 11)], "percent int, seeds long")
    cut = (F.col("before") < F.col("seeds")) & (F.col("seeds") < F.col("before") + F.col("size"))
    return groups.join(F.broadcast(counts), cut).select("percent", "score", "size", (F.col("seeds") - F.col("before")).alias("needed"))


@query("dispersion", f"{G}, {TOP}, {DIST}, s AS (SELECT node FROM r, c WHERE rank <= least(c.nn, greatest(2, ceil(c.nn * 2 / 100.0)))) SELECT (SELECT count(*) FROM s)::BIGINT AS k, round(avg(coalesce(dist.d, (SELECT nn FROM c))), 6) AS mean_distance FROM s a JOIN s b ON a.node < b.node LEFT JOIN dist ON dist.s = a.node AND dist.v = b.node")
def dispersion(spark, sf_dir):
    edges = g(spark, sf_dir)
    return paths.dispersion(edges, degree_seeds(edges, 2, "ceil2")).withColumn("mean_distance", r6("mean_distance"))


PAIRS = 40


@query("sampled_dispersion", f"""{G}, {TOP}, {DIST}, s AS MATERIALIZED (SELECT t.t::BIGINT AS set_id, node, row_number() OVER (PARTITION BY t.t ORDER BY node) - 1 AS at, count(*) OVER (PARTITION BY t.t) AS k FROM r, c, (VALUES (1), (2), (3)) t(t) WHERE rank <= t.t * 4),
    q AS MATERIALIZED (SELECT set_id, m, i FROM (SELECT set_id, m, unnest(range(least(m, {PAIRS})))::BIGINT AS i FROM (SELECT DISTINCT set_id, k * (k - 1) // 2 AS m FROM s))),
    p AS MATERIALIZED (SELECT set_id, x FROM ({permuted_sql(f"SELECT * FROM q WHERE m > {PAIRS}", "set_id", "0, 'pairs', set_id")}) UNION ALL SELECT set_id, i FROM q WHERE m <= {PAIRS}),
    j AS (SELECT p.set_id, p.x, max(g.g) AS j FROM p, (SELECT unnest(range(1, 100)) AS g) g WHERE g.g * (g.g - 1) // 2 <= p.x GROUP BY ALL)
    SELECT j.set_id, any_value(a.k)::BIGINT AS k, count(*)::BIGINT AS pairs, round(avg(coalesce(dist.d, (SELECT nn FROM c))), 6) AS mean_distance FROM j JOIN s a ON a.set_id = j.set_id AND a.at = j.x - j.j * (j.j - 1) // 2 JOIN s b ON b.set_id = j.set_id AND b.at = j.j
    LEFT JOIN dist ON dist.s = a.node AND dist.v = b.node GROUP BY j.set_id""")
def sampled_dispersion(spark, sf_dir):
    """Mean distances of three seed sets at once, over all pairs of the small ones and a sample of pairs of the large one."""
    edges = g(spark, sf_dir)
    sets = degree_ranking(edges).select(F.explode(F.array(*[F.lit(t).cast("long") for t in (1, 2, 3)])).alias("set_id"), "node", "rank").where(F.col("rank") <= F.col("set_id") * 4)
    return paths.sampled_dispersion(edges, sets, PAIRS).withColumn("mean_distance", r6("mean_distance"))


@query("similarity", f"{G}, {TOP}, s AS (SELECT node, k FROM r, c WHERE rank <= greatest(1, c.nn * 5 // 100)), m AS (SELECT a.u AS i, b.u AS j, count(*) AS x FROM adj a JOIN adj b ON a.v = b.v AND a.u < b.u GROUP BY ALL) SELECT (SELECT count(*) FROM s)::BIGINT AS k, round(avg(coalesce(m.x, 0)::DOUBLE / (a.k + b.k - coalesce(m.x, 0))), 6) AS mean_jaccard FROM s a JOIN s b ON a.node < b.node LEFT JOIN m ON m.i = a.node AND m.j = b.node")
def similarity(spark, sf_dir):
    edges = g(spark, sf_dir)
    return paths.mean_jaccard(edges, degree_seeds(edges, 5)).withColumn("mean_jaccard", r6("mean_jaccard"))


@query("monotonicity", f"{G}, s AS (SELECT k, count(*) AS c FROM n GROUP BY k), t AS (SELECT sum(c) AS nn FROM s) SELECT max(nn)::BIGINT AS n_nodes, count(*)::BIGINT AS n_distinct, count(*) FILTER (c > 1)::BIGINT AS n_groups, sum(c) FILTER (c > 1)::BIGINT AS n_tied, max(c)::BIGINT AS largest, round((1 - sum(c * (c - 1))::DOUBLE / max(nn * (nn - 1))) ** 2, 6) AS monotonicity FROM s, t")
def monotonicity(spark, sf_dir):
    scores = graph.degrees(g(spark, sf_dir)).select("node", F.col("k").cast("double").alias("score"))
    return statistics.monotonicity(scores).withColumn("monotonicity", r6("monotonicity"))


@query("rank_frequencies", f"{G}, s AS (SELECT k, count(*) AS c FROM n GROUP BY k) SELECT (1 + coalesce(sum(c) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rank, c::BIGINT AS n FROM s")
def rank_frequencies(spark, sf_dir):
    return statistics.rank_frequencies(graph.degrees(g(spark, sf_dir)).select("node", F.col("k").cast("double").alias("score")))


@query(
    "set_differences",
    f"""{G},{CORNERS}, a AS (SELECT node, row_number() OVER (ORDER BY k DESC, node) AS r1, row_number() OVER (ORDER BY round(clustering, 8) DESC, node) AS r2 FROM loc)
    SELECT k.k::INT AS k, (count(*) FILTER ((r1 <= k.k) <> (r2 <= k.k)) // 2)::BIGINT AS n_changed FROM a, (VALUES (5), (10), (50)) k(k) GROUP BY k.k""",
)
def set_differences(spark, sf_dir):
    """Rankings by degree and by clustering."""
    loc = materialise(graph.clustering(g(spark, sf_dir)), "clustering")
    one = ranking.ranked(loc.select("node", F.col("k").cast("double").alias("score")))
    return ranking.set_differences(one, ranking.ranked(loc.select("node", F.col("clustering").alias("score"))), [5, 10, 50])


# --- spreading ---

BLOCKS, REPEATS, BETA = 4, 5, 0.2
METHODS = {"degree": "k DESC, node", "low_degree": "k, node"}


def spread_sql(betas: list[float], levels: int = 40) -> str:
    values = ", ".join(f"({b}::DOUBLE)" for b in betas)
    coin = "('0x' || substr(md5(concat_ws('|', p.run, a.u, a.v)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    seeds = " UNION ALL ".join(f"SELECT '{m}' AS set_id, node FROM (SELECT node, row_number() OVER (ORDER BY {o}) AS rank FROM n) WHERE rank <= (SELECT greatest(1, count(*) * 2 // 100) FROM n)" for m, o in METHODS.items())
    steps = [f"f0 AS MATERIALIZED (SELECT s.set_id, (b.b * 1000 + r.r)::BIGINT AS run, w.beta, s.node, 0 AS step FROM ({seeds}) s, (SELECT unnest(range({BLOCKS})) AS b) b, (SELECT unnest(range({REPEATS})) AS r) r, (VALUES {values}) w(beta))"]
    for t in range(1, levels + 1):
        seen = " ".join(f"ANTI JOIN f{x} x{x} ON x{x}.set_id = p.set_id AND x{x}.run = p.run AND x{x}.beta = p.beta AND x{x}.node = a.v" for x in range(t))
        steps.append(f"f{t} AS MATERIALIZED (SELECT DISTINCT p.set_id, p.run, p.beta, a.v AS node, {t} AS step FROM f{t - 1} p JOIN adj a ON a.u = p.node AND {coin} < p.beta {seen})")
    return f"{G}, " + ", ".join(steps) + ", inf AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM f{t}" for t in range(levels + 1)) + ")"


def spread_reach_sql(betas: list[float]) -> str:
    """Who is reached, without steps: a recursive union."""
    values = ", ".join(f"({b}::DOUBLE)" for b in betas)
    coin = "('0x' || substr(md5(concat_ws('|', p.run, a.u, a.v)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    seeds = " UNION ALL ".join(f"SELECT '{m}' AS set_id, node FROM (SELECT node, row_number() OVER (ORDER BY {o}) AS rank FROM n) WHERE rank <= (SELECT greatest(1, count(*) * 2 // 100) FROM n)" for m, o in METHODS.items())
    return f"""{G}, inf(set_id, run, beta, node) AS (SELECT s.set_id, (b.b * 1000 + r.r)::BIGINT, w.beta, s.node FROM ({seeds}) s, (SELECT unnest(range({BLOCKS})) AS b) b, (SELECT unnest(range({REPEATS})) AS r) r, (VALUES {values}) w(beta)
        UNION SELECT p.set_id, p.run, p.beta, a.v FROM inf p JOIN adj a ON a.u = p.node AND {coin} < p.beta)"""


def seed_sets(edges: DataFrame, percent: int = 2) -> DataFrame:
    """The best and the worst nodes by degree."""
    k = materialise(graph.degrees(edges), "degrees")
    n = ranking.seed_count(k.count(), percent)
    pick = lambda name, *order: k.orderBy(*order).limit(n).select(F.lit(name).alias("set_id"), "node")
    return pick("degree", F.desc("k"), "node").union(pick("low_degree", "k", "node"))


def settings(spark: SparkSession, betas: list[float]) -> DataFrame:
    return spread.runs(spark, BLOCKS, REPEATS).select("run", F.explode(F.array(*[F.lit(b) for b in betas])).alias("beta"))


def infected_counts(spark: SparkSession, sf_dir: str, betas: list[float]) -> tuple[DataFrame, DataFrame]:
    edges = g(spark, sf_dir)
    return edges, spread.infected_counts(edges, seed_sets(edges), settings(spark, betas))


@query("sir_final", f"{spread_reach_sql([BETA])} SELECT set_id, run, beta, count(*)::BIGINT AS n_infected FROM inf GROUP BY ALL")
def sir_final(spark, sf_dir):
    return infected_counts(spark, sf_dir, [BETA])[1]


@query("sir_curves", f"{spread_sql([BETA], 24)} SELECT i.set_id, i.run, i.beta, t.t::INT AS t, count(*)::BIGINT AS n_infected FROM inf i JOIN (SELECT unnest(range(25)) AS t) t ON i.step <= t.t GROUP BY ALL")
def sir_curves(spark, sf_dir):
    edges = g(spark, sf_dir)
    return spread.curves(spread.infections(edges, seed_sets(edges), settings(spark, [BETA]), 24), 25)


SWEEP = [0.1, 0.15, 0.2]


@query("sir_sweep", f"{spread_reach_sql(SWEEP)}, f AS (SELECT set_id, run, beta, count(*) AS c FROM inf GROUP BY ALL) SELECT set_id, beta, (run // 1000)::BIGINT AS block, round(100.0::DOUBLE * avg(c) / (SELECT count(*) FROM n), 6) AS percent FROM f GROUP BY ALL")
def sir_sweep(spark, sf_dir):
    edges, sizes = infected_counts(spark, sf_dir, SWEEP)
    n = graph.degrees(edges).agg(F.count("*").alias("n"))
    return spread.block_means(sizes, n).withColumn("percent", r6("percent"))


@query("single_node_sizes", f"""{G}, inf(seed, run, node) AS (SELECT n.node, r.r::BIGINT, n.node FROM n, (SELECT unnest(range(5)) AS r) r
    UNION SELECT p.seed, p.run, a.v FROM inf p JOIN adj a ON a.u = p.node AND ('0x' || substr(md5(concat_ws('|', p.run, a.u, a.v)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.15)
    SELECT seed AS node, round(count(*)::DOUBLE / 5, 6) AS score FROM inf GROUP BY seed""")
def single_node_sizes(spark, sf_dir):
    """Every node, each on its own."""
    edges = g(spark, sf_dir)
    return scored(spread.single_node_sizes(edges, graph.degrees(edges).select("node"), spread.runs(spark, 1, 5).select("run", F.lit(0.15).alias("beta"))))


def geometric_sql(p: str, coin: str) -> str:
    """Attempts up to the first success."""
    return f"CASE WHEN {p} >= 1 THEN 1.0::DOUBLE ELSE 1 + floor(ln(1 - {coin}) / ln(1 - {p})) END"


def coin_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def recovery_reach_sql(keys: str, start: str) -> str:
    """inf(keys..., gamma, beta, run, node) from its rows at the start: an arc opens if its attempts come no later than the recovery of its start."""
    p = ", ".join("p." + k for k in keys.split(", "))
    opens = f"{geometric_sql('p.beta', coin_sql('p.run', 'a.u', 'a.v'))} <= {geometric_sql('p.gamma', coin_sql('p.run', 'a.u', chr(39) + 'stay' + chr(39)))}"
    return f"inf({keys}, gamma, beta, run, node) AS ({start} UNION SELECT {p}, p.gamma, p.beta, p.run, a.v FROM inf p JOIN adj a ON a.u = p.node AND {opens})"


_SPREAD_SEEDS = " UNION ALL ".join(f"SELECT '{m}' AS set_id, node FROM (SELECT node, row_number() OVER (ORDER BY {o}) AS rank FROM n) WHERE rank <= (SELECT greatest(1, count(*) * 2 // 100) FROM n)" for m, o in METHODS.items())


@query("sir_recovery", f"""{G}, {recovery_reach_sql("set_id", f"SELECT s.set_id, w.gamma, 0.2 * w.gamma / (1 - 0.2 * (1 - w.gamma)), (b.b * 1000 + r.r)::BIGINT, s.node FROM ({_SPREAD_SEEDS}) s, (SELECT unnest(range({BLOCKS})) AS b) b, (SELECT unnest(range({REPEATS})) AS r) r, (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) w(gamma)")}
    SELECT set_id, run, gamma, round(beta, 9) AS beta, count(*)::BIGINT AS n_infected FROM inf GROUP BY ALL""")
def sir_recovery(spark, sf_dir):
    """Final sizes at three recovery rates with the transmissibility held at 0.2."""
    edges = g(spark, sf_dir)
    rates = settings(spark, [0.2]).select("run", F.explode(F.array(F.lit(0.5), F.lit(0.75), F.lit(1.0))).alias("gamma"))
    rates = rates.select("run", "gamma", spread.transmission(F.lit(0.2), F.col("gamma")).alias("beta"))
    return spread.infected_counts(edges, seed_sets(edges), rates).withColumn("beta", F.round("beta", 9))


# --- statistics, over events by user and type, and orders by customer ---

PAIRED = """WITH w AS (SELECT user_id % 40 AS grp, user_id, avg(value) FILTER (event_type = t1) AS a, avg(value) FILTER (event_type = t2) AS b
    FROM events, (SELECT min(event_type) AS t1, max(event_type) AS t2 FROM events) GROUP BY ALL),
    p AS MATERIALIZED (SELECT grp, user_id, round(a, 9) AS a, round(b, 9) AS b FROM w WHERE a IS NOT NULL AND b IS NOT NULL)"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's mean value in the first and the last event type, in forty groups of users."""
    e = table(spark, sf_dir, "events")
    kinds = e.agg(F.min("event_type").alias("t1"), F.max("event_type").alias("t2"))
    mean = lambda t: F.avg(F.when(F.col("event_type") == F.col(t), F.col("value")))
    w = e.crossJoin(F.broadcast(kinds)).groupBy((F.col("user_id") % 40).alias("grp"), "user_id").agg(mean("t1").alias("a"), mean("t2").alias("b"))  # one row is broadcast
    return materialise(w.where("a is not null and b is not null").select("grp", "user_id", F.round("a", 9).alias("a"), F.round("b", 9).alias("b")), "paired")


#: The 97.5 % point of Student's t for the degrees of freedom in dof(df): bisection on the distribution's finite sum.
T_POINTS = """
bis(df, lo, hi, i) AS (SELECT df, 0.0::DOUBLE, 100.0::DOUBLE, 0 FROM dof UNION ALL
    SELECT df, CASE WHEN c < 0.975 THEN mid ELSE lo END, CASE WHEN c < 0.975 THEN hi ELSE mid END, i + 1 FROM (
        SELECT df, lo, hi, i, mid, CASE WHEN df % 2 = 1 THEN 0.5 + (th + sin(th) * coalesce(list_sum([cos(th) ** (2 * k - 1) * sqrt(pi()) / 2 * exp(lgamma(k) - lgamma(k + 0.5)) for k in range(1, (df + 1) // 2)]), 0)) / pi()
            ELSE 0.5 + sin(th) / 2 * list_sum([cos(th) ** (2 * k) * exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) for k in range(0, df // 2)]) END AS c
        FROM (SELECT *, atan(mid / sqrt(df)) AS th FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis WHERE i < 60)))),
tq AS (SELECT df, (lo + hi) / 2 AS t FROM bis WHERE i = 60)"""


@query("intervals", f"""{PAIRED.replace("WITH w", "WITH RECURSIVE w")}, q AS MATERIALIZED (SELECT grp, count(*)::BIGINT AS n, avg(a) AS mean, stddev_samp(a) AS sd FROM p GROUP BY grp), dof AS (SELECT DISTINCT n - 1 AS df FROM q WHERE n > 1), {T_POINTS}
    SELECT grp, n, round(mean, 6) AS mean, round(CASE WHEN n = 1 THEN 0 ELSE sd END, 6) AS std, round(CASE WHEN n = 1 THEN 0 ELSE tq.t * sd / sqrt(n) END, 6) AS half_width FROM q LEFT JOIN tq ON tq.df = q.n - 1""")
def intervals(spark, sf_dir):
    return statistics.intervals(paired(spark, sf_dir), ["grp"], "a").select("grp", "n", *[r6(c).alias(c) for c in ("mean", "std", "half_width")])


@query("normal_intervals", f"{PAIRED} SELECT grp, round(CASE WHEN count(*) > 1 THEN 1.96::DOUBLE * stddev_samp(a) / sqrt(count(*)) ELSE 0 END, 6) AS half_width, round(CASE WHEN avg(a) > 0 THEN 100 * stddev_pop(a) / avg(a) ELSE 0 END, 6) AS cv FROM p GROUP BY grp")
def normal_intervals(spark, sf_dir):
    p = paired(spark, sf_dir)
    half = statistics.intervals(p, ["grp"], "a", normal=True).select("grp", r6("half_width").alias("half_width"))
    return half.join(statistics.variation(p, ["grp"], "a"), "grp").select("grp", "half_width", r6("cv").alias("cv"))


RANKS = """, d AS (SELECT grp, round(a - b, 12) AS d FROM p), z AS (SELECT grp, d, rank() OVER (PARTITION BY grp ORDER BY abs(d)) + (count(*) OVER (PARTITION BY grp, abs(d)) - 1) / 2.0::DOUBLE AS r FROM d WHERE d <> 0),
    s AS MATERIALIZED (SELECT grp, count(z.d)::BIGINT AS n, coalesce(sum(r) FILTER (d > 0), 0) AS wp, coalesce(sum(r) FILTER (d < 0), 0) AS wm FROM (SELECT DISTINCT grp FROM p) LEFT JOIN z USING (grp) GROUP BY grp)"""


@query("signed_ranks", f"{PAIRED}{RANKS} SELECT grp, n, wp AS w_plus, wm AS w_minus, round(CASE WHEN wp + wm > 0 THEN (wp - wm) / (wp + wm) ELSE 0 END, 6) AS r_rb FROM s")
def signed_ranks(spark, sf_dir):
    return statistics.signed_ranks(paired(spark, sf_dir), ["grp"], "a", "b").select("grp", "n", "w_plus", "w_minus", r6("r_rb").alias("r_rb"))


def wilcoxon_sql(by: str) -> str:
    """From pr(by..., a, b): wt(by..., n, wp, wm, r_rb, p). Exact by the distribution of the doubled rank sum up to 20 differences, else the normal approximation, its tail by Simpson's rule."""
    same = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in by.split(", "))
    return f"""
wd AS MATERIALIZED (SELECT {by}, round(a - b, 12) AS d FROM pr WHERE a - b IS NOT NULL),
wr AS MATERIALIZED (SELECT {by}, d, rank() OVER (PARTITION BY {by} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {by}, abs(d)) - 1) / 2.0::DOUBLE AS r, row_number() OVER (PARTITION BY {by} ORDER BY abs(d), d) AS i FROM wd WHERE d <> 0),
wn AS MATERIALIZED (SELECT {by}, count(*)::BIGINT AS n, coalesce(sum(r) FILTER (d > 0), 0) AS wp, coalesce(sum(r) FILTER (d < 0), 0) AS wm FROM wr GROUP BY {by}),
wt0 AS (SELECT {by}, sum(t * t * t - t) AS tied FROM (SELECT {by}, count(*) AS t FROM wr GROUP BY {by}, abs(d)) GROUP BY {by}),
ways({by}, i, s, c) AS (SELECT {by}, 0::BIGINT, 0::BIGINT, 1::DOUBLE FROM wn WHERE n <= 20 UNION ALL
    SELECT {by}, i + 1, s, sum(c) FROM (SELECT {", ".join("w." + c for c in by.split(", "))}, w.i, w.s + x.pick * (2 * wr.r)::BIGINT AS s, w.c FROM ways w JOIN wr ON {same("wr", "w")} AND wr.i = w.i + 1, (VALUES (0), (1)) x(pick)) GROUP BY {by}, i, s),
wx AS (SELECT {", ".join("n." + c for c in by.split(", "))}, least(1, 2 * sum(w.c) / 2 ** max(n.n)) AS p FROM wn n JOIN ways w ON {same("w", "n")} AND w.i = n.n WHERE w.s <= (2 * least(n.wp, n.wm))::BIGINT GROUP BY {", ".join("n." + c for c in by.split(", "))}),
wz AS (SELECT {", ".join("n." + c for c in by.split(", "))}, (n.n * (n.n + 1) / 4.0 - least(n.wp, n.wm)) / sqrt(n.n * (n.n + 1) * (2 * n.n + 1) / 24.0 - t.tied / 48.0) AS z FROM wn n JOIN wt0 t ON {same("t", "n")} WHERE n.n > 20),
wy AS (SELECT {by}, 1 - 2 * list_sum([(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(0 - (z * k / 2000.0) ** 2 / 2) for k in range(0, 2001)]) * z / 2000 / 3 / sqrt(2 * pi()) AS p FROM wz),
wt AS MATERIALIZED (SELECT {", ".join("g." + c for c in by.split(", "))}, coalesce(n.n, 0)::BIGINT AS n, coalesce(n.wp, 0)::DOUBLE AS wp, coalesce(n.wm, 0)::DOUBLE AS wm, CASE WHEN n.wp + n.wm > 0 THEN (n.wp - n.wm) / (n.wp + n.wm) ELSE 0 END AS r_rb, CASE WHEN n.n IS NULL THEN 1 ELSE greatest(1e-20, least(1, coalesce(x.p, y.p))) END AS p
    FROM (SELECT DISTINCT {by} FROM wd) g LEFT JOIN wn n ON {same("n", "g")} LEFT JOIN wx x ON {same("x", "g")} LEFT JOIN wy y ON {same("y", "g")})"""


@query("wilcoxon", f"""{PAIRED.replace("WITH w", "WITH RECURSIVE w")}, pr AS (SELECT grp, a, b FROM p), {wilcoxon_sql("grp")} SELECT grp, n, wp AS w_plus, wm AS w_minus, round(r_rb, 6) AS r_rb, round(p, 6) AS p FROM wt""")
def wilcoxon(spark, sf_dir):
    return statistics.wilcoxon(paired(spark, sf_dir), ["grp"], "a", "b").withColumn("r_rb", r6("r_rb")).withColumn("p", r6("p"))


@query("wilcoxon_normal", f"""{PAIRED.replace("WITH w", "WITH RECURSIVE w")}, pr AS (SELECT grp % 2 AS grp, a, b FROM p), {wilcoxon_sql("grp")} SELECT grp, n, wp AS w_plus, wm AS w_minus, round(r_rb, 6) AS r_rb, round(p, 6) AS p FROM wt""")
def wilcoxon_normal(spark, sf_dir):
    """Two large groups, so that the normal approximation is used."""
    rows = paired(spark, sf_dir).withColumn("grp", F.col("grp") % 2)
    return statistics.wilcoxon(rows, ["grp"], "a", "b").withColumn("r_rb", r6("r_rb")).withColumn("p", r6("p"))


@query("improvements", f"{PAIRED} SELECT grp, count(*)::BIGINT AS n, round(avg(a - b), 6) AS gain, round(CASE WHEN avg(b) > 0 THEN 100 * avg(a - b) / avg(b) END, 6) AS improvement, round(avg(a - b) / nullif(CASE WHEN count(*) > 1 THEN stddev_samp(a - b) END, 0), 6) AS d_z, round(100 * avg(CASE WHEN a > b THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate FROM p GROUP BY grp")
def improvements(spark, sf_dir):
    df = statistics.improvements(paired(spark, sf_dir), ["grp"], "a", "b")
    return df.select("grp", "n", *[r6(c).alias(c) for c in ("gain", "improvement", "d_z", "win_rate")])


CORRECTED = """WITH t AS (SELECT event_type AS fam, user_id, round((avg(value) - floor(avg(value))) * 0.2, 6) AS p FROM events GROUP BY ALL)"""


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A p-value for each event type and user, from the fraction of the user's mean value.

    A fraction turns from 0 to 1 with the last bit of a sum, so values are added in the order of events, as a scan of the table does, and not as partitions meet.
    """
    own = Window.partitionBy("fam", "user_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("fam"), "user_id", "event_id", "value")
    e = e.withColumn("upto", F.sum("value").over(own.orderBy("event_id", "value").rowsBetween(Window.unboundedPreceding, 0)))
    m = F.max_by("upto", F.struct("event_id", "value")) / F.count("value")
    return materialise(e.groupBy("fam", "user_id").agg(F.round((m - F.floor(m)) * 0.2, 6).alias("p")), "tests")


@query(
    "benjamini_hochberg",
    f"""{CORRECTED}, r AS (SELECT *, p * count(*) OVER (PARTITION BY fam) / row_number() OVER (PARTITION BY fam ORDER BY p, user_id) AS raw, row_number() OVER (PARTITION BY fam ORDER BY p, user_id) AS rn FROM t)
    SELECT fam, user_id, p, round(least(1.0::DOUBLE, min(raw) OVER (PARTITION BY fam ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r""",
)
def benjamini_hochberg(spark, sf_dir):
    return statistics.benjamini_hochberg(tests(spark, sf_dir), ["fam"], "p", ["user_id"]).withColumn("q", r6("q"))


@query(
    "holm",
    f"""{CORRECTED}, r AS (SELECT *, p * (count(*) OVER (PARTITION BY fam) - row_number() OVER (PARTITION BY fam ORDER BY p, user_id) + 1) AS raw, row_number() OVER (PARTITION BY fam ORDER BY p, user_id) AS rn FROM t)
    SELECT fam, user_id, p, round(least(1.0::DOUBLE, max(raw) OVER (PARTITION BY fam ORDER BY rn ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM r""",
)
def holm(spark, sf_dir):
    return statistics.holm(tests(spark, sf_dir), ["fam"], "p", ["user_id"]).withColumn("p_holm", r6("p_holm"))


@query(
    "friedman",
    """WITH v AS (SELECT n_regionkey AS b, c_mktsegment AS t, round(avg(c_acctbal), 2) AS x FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
    r AS (SELECT *, rank() OVER (PARTITION BY b ORDER BY x) + (count(*) OVER (PARTITION BY b, x) - 1) / 2.0::DOUBLE AS r FROM v),
    ti AS (SELECT sum(c * c * c - c) AS tied FROM (SELECT count(*) AS c FROM v GROUP BY b, x)),
    s AS (SELECT sum(r) AS r, count(*) AS n FROM r GROUP BY t), a AS (SELECT sum(r * r) AS ss, count(*) AS k, max(n) AS n FROM s),
    x AS (SELECT n, k, (12.0::DOUBLE / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - tied / (n * (k * k * k - k))) AS chi2 FROM a, ti)
    SELECT n::BIGINT AS n_blocks, k::BIGINT AS n_treatments, round(chi2, 6) AS chi2, round(chi2 / (n * (k - 1)), 6) AS kendall_w, round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) AS p FROM x""",
)
def friedman(spark, sf_dir):
    """Market segments over regions, by mean account balance; five segments, so the tail has a closed form."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    v = c.groupBy(F.col("n_regionkey").alias("b"), F.col("c_mktsegment").alias("t")).agg(F.round(F.avg("c_acctbal"), 2).alias("x"))
    return statistics.friedman(materialise(v, "blocks"), "b", "t", "x").select("n_blocks", "n_treatments", r6("chi2").alias("chi2"), r6("kendall_w").alias("kendall_w"), r6("p").alias("p"))


@query(
    "kendall",
    f"""{G},{CORNERS}, s AS MATERIALIZED (SELECT k AS x, round(clustering, 9) AS y FROM loc),
    q AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM s a, s b), t AS (SELECT count(*) AS n FROM s),
    tx AS (SELECT sum(c * (c - 1) / 2) AS t FROM (SELECT count(*) AS c FROM s GROUP BY x)), ty AS (SELECT sum(c * (c - 1) / 2) AS t FROM (SELECT count(*) AS c FROM s GROUP BY y))
    SELECT n::BIGINT AS n, round(q.s / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 6) AS tau_b FROM q, t, tx, ty""",
)
def kendall(spark, sf_dir):
    """Degree against local clustering."""
    loc = graph.clustering(g(spark, sf_dir)).select(F.col("k").cast("double").alias("x"), F.round("clustering", 9).alias("y"))
    return statistics.kendall(loc, "x", "y").withColumn("tau_b", r6("tau_b"))


@query(
    "correlations",
    """WITH o AS (SELECT c_nationkey AS grp, o_totalprice AS x, c_acctbal AS y FROM orders JOIN customer ON c_custkey = o_custkey),
    r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY x) + (count(*) OVER (PARTITION BY grp, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0::DOUBLE AS ry FROM o)
    SELECT a.grp, a.n, round(a.r, 6) AS pearson, round(b.r, 6) AS spearman FROM (SELECT grp, count(*)::BIGINT AS n, corr(x, y) AS r FROM o GROUP BY grp) a JOIN (SELECT grp, corr(rx, ry) AS r FROM r GROUP BY grp) b USING (grp)""",
)
def correlations(spark, sf_dir):
    """Order totals against the customer's balance, by nation."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("grp"), F.col("o_totalprice").alias("x"), F.col("c_acctbal").alias("y"))
    a = statistics.pearson(o, ["grp"], "x", "y").select("grp", "n", r6("r").alias("pearson"))
    return a.join(statistics.spearman(o, ["grp"], "x", "y").select("grp", r6("r").alias("spearman")), "grp")


@query("balance_pivot", """SELECT n_regionkey AS region, count(*) FILTER (c_mktsegment = 'BUILDING')::BIGINT AS n_building, round(avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 4) AS building, round(avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY'), 4) AS machinery FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def balance_pivot(spark, sf_dir):
    """Mean balances of two market segments side by side, by region."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    means = c.groupBy(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.avg("c_acctbal").alias("mean"), F.count("*").alias("n"))
    wide = statistics.pivoted(means, ["region"], "segment", "mean", ["BUILDING", "MACHINERY"])
    counts = statistics.pivoted(means, ["region"], "segment", "n", ["BUILDING"]).select("region", F.coalesce("BUILDING", F.lit(0)).alias("n_building"))
    return wide.join(counts, "region").select("region", "n_building", F.round("BUILDING", 4).alias("building"), F.round("MACHINERY", 4).alias("machinery"))


# --- controls ---

BINS = "bins AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY k, node) - 1 AS pos FROM (SELECT node, k, least(9, ((row_number() OVER (ORDER BY k, node) - 1) * 10) // (SELECT count(*) FROM n))::BIGINT AS bin FROM n))"


@query("degree_bins", f"{G}, {BINS} SELECT node, k, bin FROM bins")
def degree_bins(spark, sf_dir):
    return controls.degree_bins(g(spark, sf_dir)).drop("pos")


CANDIDATES = 20
#: The first sets that differ, of three times as many draws.
DRAWN = f"""{TOP}, {BINS}, s AS (SELECT node FROM r, c WHERE rank <= least(c.nn, greatest(2, ceil(c.nn * 1 / 100.0)))), need AS (SELECT bin, count(*) AS need FROM bins JOIN s USING (node) GROUP BY bin),
    held AS (SELECT bin, count(*) AS m FROM bins GROUP BY bin),
    dq AS MATERIALIZED (SELECT candidate, bin, m, unnest(range(need))::BIGINT AS i FROM need JOIN held USING (bin), (SELECT unnest(range({3 * CANDIDATES}))::BIGINT AS candidate)),
    dr AS MATERIALIZED ({permuted_sql("SELECT * FROM dq", "candidate, bin", "0, candidate, bin")}),
    ds AS MATERIALIZED (SELECT candidate, node FROM dr JOIN bins ON bins.bin = dr.bin AND bins.pos = dr.x),
    du AS (SELECT min(candidate) AS candidate FROM (SELECT candidate, list(node ORDER BY node) AS l FROM ds GROUP BY candidate) GROUP BY l),
    drawn AS MATERIALIZED (SELECT candidate, node FROM ds JOIN (SELECT candidate FROM du ORDER BY candidate LIMIT {CANDIDATES}) USING (candidate))"""


def candidate_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = g(spark, sf_dir)
    draws = controls.Draws(materialise(controls.degree_bins(edges), "bins"), degree_seeds(edges, 1, "ceil2"))
    return edges, controls.unique_candidates(draws, CANDIDATES)[0]


@query("matched_candidates", f"{G}, {DRAWN} SELECT candidate, node FROM drawn")
def matched_candidates(spark, sf_dir):
    """Different sets with the degree profile of the first nodes."""
    return candidate_sets(spark, sf_dir)[1]


def measured(edges: DataFrame, sets: DataFrame) -> DataFrame:
    return materialise(controls.mean_distances(edges, sets), "measured")


SPREADS = f"{G}, {DRAWN}, {DIST}, m AS MATERIALIZED (SELECT a.candidate, avg(coalesce(dist.d, (SELECT nn FROM c))) AS mean_distance FROM drawn a JOIN drawn b ON a.candidate = b.candidate AND a.node < b.node LEFT JOIN dist ON dist.s = a.node AND dist.v = b.node GROUP BY a.candidate)"


@query("dispersed_control", f"{SPREADS} SELECT candidate, round(mean_distance, 6) AS mean_distance FROM m ORDER BY m.mean_distance DESC, candidate LIMIT 1")
def dispersed_control(spark, sf_dir):
    return controls.most_dispersed(measured(*candidate_sets(spark, sf_dir))).withColumn("mean_distance", r6("mean_distance"))


@query("doubly_matched", f"""{SPREADS}, near AS (SELECT candidate, mean_distance, abs(mean_distance - 4.0) / 4.0 AS error FROM m WHERE abs(mean_distance - 4.0) / 4.0 <= 0.05)
    SELECT candidate, round(mean_distance, 6) AS mean_distance, round(error, 6) AS error, (SELECT CASE WHEN count(*) >= 10 THEN 'full' WHEN count(*) > 0 THEN 'partial' ELSE 'unmatched' END FROM near) AS status
    FROM near ORDER BY ('0x' || substr(md5(concat_ws('|', 0, 'pick', candidate)), 1, 8))::BIGINT, candidate LIMIT 10""")
def doubly_matched(spark, sf_dir):
    df = controls.doubly_matched(measured(*candidate_sets(spark, sf_dir)), 4.0)
    return df.withColumn("mean_distance", r6("mean_distance")).withColumn("error", r6("error"))


@query("random_controls", f"{G}, {DRAWN} SELECT candidate FROM (SELECT DISTINCT candidate FROM drawn) ORDER BY ('0x' || substr(md5(concat_ws('|', 0, 'pick', candidate)), 1, 8))::BIGINT, candidate LIMIT 10")
def random_controls(spark, sf_dir):
    return controls.random_controls(candidate_sets(spark, sf_dir)[1], 10)


# --- studies ---

STUDY = {"percents": [2, 4], "blocks": 2, "repeats": 3}


def study_scores(edges: DataFrame) -> DataFrame:
    """Two methods: degree and local clustering."""
    loc = materialise(graph.clustering(edges), "clustering")
    return loc.select(F.lit("clustering").alias("method"), "node", F.col("clustering").alias("score")).union(loc.select(F.lit("degree"), "node", F.col("k").cast("double")))


RANKED = f"""{CORNERS}, ms AS (SELECT 'clustering' AS method, node, clustering AS score FROM loc UNION ALL SELECT 'degree', node, k::DOUBLE FROM loc),
    rk AS MATERIALIZED (SELECT method, node, score, row_number() OVER (PARTITION BY method ORDER BY round(score, 8) DESC, node) AS rank FROM ms),
    lambda_c AS (SELECT avg(k) / (avg(k * k) - avg(k)) AS t, count(*) AS nn FROM n)"""


def reached_sql(seeds: str, keys: str, plan: str) -> str:
    """inf(keys..., beta, run, node, step) for seeds(keys..., node) and plan(beta, run)."""
    p = ", ".join("p." + k for k in keys.split(", "))
    return f"""seeds AS MATERIALIZED ({seeds}), plan AS MATERIALIZED ({plan}),
    inf({keys}, beta, run, node) AS (SELECT {", ".join("s." + k for k in keys.split(", "))}, plan.beta, plan.run, s.node FROM seeds s, plan
        UNION SELECT {p}, p.beta, p.run, a.v FROM inf p JOIN adj a ON a.u = p.node AND ('0x' || substr(md5(concat_ws('|', p.run, a.u, a.v)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < p.beta)"""


RUNS = "(SELECT unnest(range(2)) AS b) b, (SELECT unnest(range(3)) AS r) r"
SEEDS = "SELECT rk.method, q.q AS percent_seeds, rk.node FROM rk, lambda_c c, (VALUES {percents}) q(q) WHERE rk.rank <= greatest(1, c.nn * q.q // 100)"
BLOCK_MEANS = "SELECT {keys}, (run // 1000)::BIGINT AS block, round(100.0::DOUBLE * avg(c) / (SELECT nn FROM lambda_c), 6) AS percent FROM (SELECT {keys}, beta, run, count(*) AS c FROM inf GROUP BY ALL) GROUP BY ALL"


@query("method_ranks", f"{G}, {RANKED} SELECT method, node, round(score, 6) AS score, rank FROM rk")
def method_ranks(spark, sf_dir):
    return study.rank_methods(study_scores(g(spark, sf_dir))).select("method", "node", r6("score").alias("score"), "rank")


@query("tie_table", f"{G}, {RANKED}, s AS (SELECT method, round(score, 8) AS x, count(*) AS c FROM ms GROUP BY ALL), t AS (SELECT sum(c) AS nn FROM s WHERE method = 'degree') SELECT method, max(nn)::BIGINT AS n_nodes, count(*)::BIGINT AS n_distinct, count(*) FILTER (c > 1)::BIGINT AS n_groups, coalesce(sum(c) FILTER (c > 1), 0)::BIGINT AS n_tied, max(c)::BIGINT AS largest, round((1 - sum(c * (c - 1))::DOUBLE / max(nn * (nn - 1))) ** 2, 6) AS monotonicity FROM s, t GROUP BY method")
def tie_table(spark, sf_dir):
    return study.tie_table(study_scores(g(spark, sf_dir))).withColumn("monotonicity", r6("monotonicity"))


@query("seed_ratio_study", f"{G}, {RANKED}, {reached_sql(SEEDS.format(percents='(2), (4)'), 'method, percent_seeds', f'SELECT 2.5 * c.t AS beta, b.b * 1000 + r.r AS run FROM lambda_c c, {RUNS}')} {BLOCK_MEANS.format(keys='method, percent_seeds')}")
def seed_ratio_study(spark, sf_dir):
    """Shares infected from the first nodes of each ranking, by share of seeds."""
    edges = g(spark, sf_dir)
    return study.seed_ratio_study(edges, study_scores(edges), STUDY["percents"], blocks=STUDY["blocks"], repeats=STUDY["repeats"]).withColumn("percent", r6("percent"))


@query("rate_study", f"{G}, {RANKED}, {reached_sql(SEEDS.format(percents='(5)'), 'method', f'SELECT w.beta, b.b * 1000 + r.r AS run FROM {RUNS}, (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) w(beta)')} {BLOCK_MEANS.format(keys='method, beta')}")
def rate_study(spark, sf_dir):
    """The same over fixed infection rates."""
    edges = g(spark, sf_dir)
    return study.rate_study(edges, study_scores(edges), [0.1, 0.2], blocks=STUDY["blocks"], repeats=STUDY["repeats"]).withColumn("percent", r6("percent"))


@query("recovery_study", f"""{G}, {RANKED}, rt AS (SELECT w.gamma, 2.5 * t * w.gamma / (1 - 2.5 * t * (1 - w.gamma)) AS beta, nn FROM lambda_c, (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) w(gamma) WHERE 2.5 * t < 1),
    {recovery_reach_sql("method", f"SELECT rk.method, rt.gamma, rt.beta, b.b * 1000 + r.r, rk.node FROM rk, rt, {RUNS} WHERE rk.rank <= greatest(1, rt.nn * 5 // 100) AND rt.beta > 0 AND rt.beta <= 1")}
    SELECT method, gamma, (run // 1000)::BIGINT AS block, round(100.0::DOUBLE * avg(c) / (SELECT nn FROM lambda_c), 6) AS percent FROM (SELECT method, gamma, run, count(*) AS c FROM inf GROUP BY ALL) GROUP BY ALL""")
def recovery_study(spark, sf_dir):
    """Shares infected over recovery rates, the transmissibility held."""
    edges = g(spark, sf_dir)
    return study.recovery_study(edges, study_scores(edges), [0.5, 1.0], blocks=STUDY["blocks"], repeats=STUDY["repeats"]).withColumn("percent", r6("percent"))


@query("dispersion_study", f"""{G}, {RANKED}, {DIST}, s AS MATERIALIZED (SELECT rk.method, q.q AS percent, rk.node FROM rk, lambda_c c, (VALUES (2), (4)) q(q) WHERE rk.rank <= least(c.nn, greatest(2, ceil(c.nn * q.q / 100.0)))),
    m AS (SELECT a.u AS i, b.u AS j, count(*) AS x FROM adj a JOIN adj b ON a.v = b.v AND a.u < b.u GROUP BY ALL)
    SELECT a.method, a.percent::INT AS percent, (SELECT count(*) FROM s z WHERE z.method = a.method AND z.percent = a.percent)::BIGINT AS k, round(avg(coalesce(dist.d, (SELECT nn FROM lambda_c))), 6) AS mean_distance, round(avg(coalesce(m.x, 0)::DOUBLE / (na.k + nb.k - coalesce(m.x, 0))), 6) AS mean_jaccard
    FROM s a JOIN s b ON a.method = b.method AND a.percent = b.percent AND a.node < b.node JOIN n na ON na.node = a.node JOIN n nb ON nb.node = b.node LEFT JOIN dist ON dist.s = a.node AND dist.v = b.node LEFT JOIN m ON m.i = a.node AND m.j = b.node GROUP BY a.method, a.percent""")
def dispersion_study(spark, sf_dir):
    """Mean distance and similarity of the first nodes of each ranking."""
    edges = g(spark, sf_dir)
    df = study.dispersion_study(edges, study.rank_methods(study_scores(edges)), STUDY["percents"])
    return df.withColumn("mean_distance", r6("mean_distance")).withColumn("mean_jaccard", r6("mean_jaccard"))


BOUNDARY = {"draws": 3, "blocks": 2, "repeats": 3, "alone": 4}


@query("boundary_study", f"""{G}, {RANKED}, kk AS (SELECT greatest(1, ceil(nn * 5 / 100.0))::BIGINT AS k, least(1.0, 2.5 * t) AS beta, nn FROM lambda_c),
    rs AS MATERIALIZED (SELECT *, round(score, 6) AS s FROM rk), gr AS MATERIALIZED (SELECT method, s, count(*) AS size, min(rank) - 1 AS before FROM rs GROUP BY ALL),
    cut AS MATERIALIZED (SELECT gr.* FROM gr, kk WHERE before < k AND before + size > k),
    tied AS MATERIALIZED (SELECT rs.method, rs.node, cut.before FROM rs JOIN cut ON cut.method = rs.method AND cut.s = rs.s),
    m0 AS (SELECT method, 1000000 * (row_number() OVER (ORDER BY method) - 1) AS first FROM (SELECT DISTINCT method FROM rk)),
    al(method, seed, run, node) AS (SELECT tied.method, tied.node, m0.first + 900000 + r.r, tied.node FROM tied JOIN m0 USING (method), (SELECT unnest(range({BOUNDARY["alone"]})) AS r) r
        UNION SELECT p.method, p.seed, p.run, a.v FROM al p, kk, adj a WHERE a.u = p.node AND {coin_sql("p.run", "a.u", "a.v")} < kk.beta),
    st AS MATERIALIZED (SELECT method, seed AS node, count(*)::DOUBLE / {BOUNDARY["alone"]} AS score FROM al GROUP BY ALL),
    od AS (SELECT method, node, before, d.d AS draw, CASE WHEN d.d = 0 THEN 0.0::DOUBLE WHEN d.d < 0 THEN -score ELSE {coin_sql("d.d", "node")} END AS key FROM tied JOIN st USING (method, node), (SELECT unnest(range(-1, {BOUNDARY["draws"] + 1})) AS d) d),
    tk AS (SELECT method, draw, node FROM (SELECT *, row_number() OVER (PARTITION BY method, draw ORDER BY key, node) AS i FROM od), kk WHERE before + i <= k),
    sets AS MATERIALIZED (SELECT * FROM tk UNION ALL SELECT rs.method, d.d, rs.node FROM rs JOIN gr ON gr.method = rs.method AND gr.s = rs.s JOIN cut ON cut.method = rs.method, kk, (SELECT unnest(range(-1, {BOUNDARY["draws"] + 1})) AS d) d WHERE gr.before + gr.size <= k),
    inf(method, draw, run, node) AS (SELECT s.method, s.draw, m0.first + b.b * 1000 + r.r, s.node FROM sets s JOIN m0 USING (method), (SELECT unnest(range({BOUNDARY["blocks"]})) AS b) b, (SELECT unnest(range({BOUNDARY["repeats"]})) AS r) r
        UNION SELECT p.method, p.draw, p.run, a.v FROM inf p, kk, adj a WHERE a.u = p.node AND {coin_sql("p.run", "a.u", "a.v")} < kk.beta),
    bm AS (SELECT method, draw, run // 1000 AS block, 100.0::DOUBLE * avg(c) / (SELECT nn FROM kk) AS percent FROM (SELECT method, draw, run, count(*) AS c FROM inf GROUP BY ALL) GROUP BY ALL),
    dm AS (SELECT method, draw, avg(percent) AS mean FROM bm GROUP BY ALL)
    SELECT method, CASE WHEN draw = 0 THEN 'id' WHEN draw < 0 THEN 'sir_gt' ELSE 'random' END AS strategy, count(*)::BIGINT AS draws, round(avg(mean), 6) AS mean, round(100 * stddev_pop(mean) / avg(mean), 6) + 0.0 AS cv FROM dm GROUP BY ALL""")
def boundary_study(spark, sf_dir):
    """What the order among equal scores at the cut does to spreading: by id, by chance, and by what nodes infect alone."""
    edges = g(spark, sf_dir)
    df = study.boundary_study(edges, study.rank_methods(study_scores(edges)), 5, **BOUNDARY)
    return df.withColumn("mean", r6("mean")).withColumn("cv", r6("cv"))


@query("temporal_study", f"""{G}, {RANKED}, f0 AS MATERIALIZED (SELECT rk.method, b.b * 1000 + r.r AS run, 2.5 * c.t AS beta, rk.node, 0 AS step FROM rk, lambda_c c, {RUNS} WHERE rk.rank <= 10),
    {", ".join(f"f{t} AS MATERIALIZED (SELECT DISTINCT p.method, p.run, p.beta, a.v AS node, {t} AS step FROM f{t - 1} p JOIN adj a ON a.u = p.node AND {coin_sql('p.run', 'a.u', 'a.v')} < p.beta " + " ".join(f"ANTI JOIN f{x} x{x} ON x{x}.method = p.method AND x{x}.run = p.run AND x{x}.node = a.v" for x in range(t)) + ")" for t in range(1, 12))},
    inf AS (SELECT method, run, step FROM ({" UNION ALL ".join(f"SELECT * FROM f{t}" for t in range(12))})),
    cu AS (SELECT method, run, t.t, count(*) AS c FROM inf JOIN (SELECT unnest(range(12))::INT AS t) t ON inf.step <= t.t GROUP BY ALL),
    bl AS (SELECT method, t, run // 1000 AS block, 100.0::DOUBLE * avg(c) / (SELECT nn FROM lambda_c) AS percent FROM cu GROUP BY ALL),
    q AS MATERIALIZED (SELECT method, t, count(*)::BIGINT AS n, avg(percent) AS mean, stddev_samp(percent) AS sd FROM bl GROUP BY ALL), dof AS (SELECT DISTINCT n - 1 AS df FROM q WHERE n > 1), {T_POINTS}
    SELECT q.method, q.t, q.n, round(q.mean, 6) AS mean, round(q.sd, 6) AS std, round(tq.t * q.sd / sqrt(q.n), 6) AS half_width FROM q JOIN tq ON tq.df = q.n - 1""")
def temporal_study(spark, sf_dir):
    """How the share infected from the first ten nodes of each ranking grows step by step, with its interval over blocks."""
    edges = g(spark, sf_dir)
    df = study.temporal_study(edges, study_scores(edges), blocks=STUDY["blocks"], repeats=STUDY["repeats"], horizon=12)
    return df.select("method", "t", "n", *[r6(c).alias(c) for c in ("mean", "std", "half_width")])


@query("control_study")
def control_study(spark, sf_dir):
    """The strongest nodes by degree against their matched controls."""
    edges = g(spark, sf_dir)
    return study.control_study(edges, degree_seeds(edges, 1, "ceil2"), batch=20, most=60, blocks=3, repeats=2)


OBSERVED = """WITH RECURSIVE ob AS MATERIALIZED (SELECT n_regionkey AS region, n_nationkey AS nation, c_mktsegment AS method, round(avg(c_acctbal), 9) AS value FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"""


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean balances of market segments by nation: nations stand for networks, segments for methods."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return materialise(c.groupBy(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.col("c_mktsegment").alias("method")).agg(F.round(F.avg("c_acctbal"), 9).alias("value")), "balances")


@query("cross_network", f"""{OBSERVED}, z AS (SELECT *, rank() OVER (PARTITION BY nation ORDER BY value DESC) + (count(*) OVER (PARTITION BY nation, value) - 1) / 2.0::DOUBLE AS r, max(value) OVER (PARTITION BY nation) AS top FROM ob),
    pl AS (SELECT method, avg(r) AS mean_rank, count(*) FILTER (abs(value - top) <= 1e-9 * abs(top) AND r = 1)::BIGINT AS wins FROM z GROUP BY method),
    pr AS (SELECT o.method, t.value AS a, o.value AS b FROM ob o JOIN ob t ON t.nation = o.nation AND t.method = 'BUILDING' WHERE o.method <> 'BUILDING'), {wilcoxon_sql("method")},
    q0 AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, method) AS raw, row_number() OVER (ORDER BY p, method) AS rn FROM wt),
    q1 AS (SELECT *, least(1, min(raw) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM q0)
    SELECT pl.method, round(mean_rank, 6) AS mean_rank, wins, q1.n, round(r_rb, 6) AS r_rb, round(p, 6) AS p, round(q, 6) AS q FROM pl LEFT JOIN q1 ON q1.method = pl.method""")
def cross_network(spark, sf_dir):
    """Mean ranks, wins and tests against one method over all networks."""
    places = study.cross_network(balances(spark, sf_dir).withColumnRenamed("nation", "network"), "BUILDING")[1]
    return places.select("method", r6("mean_rank").alias("mean_rank"), "wins", "n", *[r6(c).alias(c) for c in ("r_rb", "p", "q")])


@query("against_best", f"""{OBSERVED}, me AS (SELECT region, method, avg(value) AS mean FROM ob WHERE method <> 'BUILDING' GROUP BY ALL), be AS (SELECT region, method AS best FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY mean DESC, method) AS k FROM me) WHERE k = 1),
    pr AS MATERIALIZED (SELECT t.region, be.best, t.value AS a, o.value AS b FROM ob t JOIN be ON be.region = t.region JOIN ob o ON o.nation = t.nation AND o.method = be.best WHERE t.method = 'BUILDING'), {wilcoxon_sql("region, best")},
    im AS (SELECT region, best, avg(a - b) AS gain, avg(CASE WHEN a > b THEN 100.0::DOUBLE ELSE 0 END) AS win_rate FROM pr GROUP BY ALL),
    q0 AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, region, best) AS raw, row_number() OVER (ORDER BY p, region, best) AS rn FROM wt),
    q1 AS (SELECT *, least(1, min(raw) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM q0)
    SELECT q1.region, q1.best, n, round(gain, 6) AS gain, round(win_rate, 6) AS win_rate, round(r_rb, 6) AS r_rb, round(p, 6) AS p, round(q, 6) AS q FROM q1 JOIN im ON im.region = q1.region AND im.best = q1.best""")
def against_best(spark, sf_dir):
    """One method against the strongest other one in each setting."""
    observed = balances(spark, sf_dir).select("region", "method", F.col("nation").alias("block"), F.col("value").alias("percent"))
    df = study.against_best(observed, "BUILDING", ["region"], ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    return df.select("region", "best", "n", *[r6(c).alias(c) for c in ("gain", "win_rate", "r_rb", "p", "q")])


@query("ablation_table", f"""{OBSERVED}, pr AS MATERIALIZED (SELECT o.region AS percent_seeds, o.method, o.nation, t.value AS a, o.value AS b FROM ob o JOIN ob t ON t.nation = o.nation AND t.method = 'BUILDING' WHERE o.method <> 'BUILDING'), {wilcoxon_sql("method, percent_seeds")},
    im AS (SELECT method, percent_seeds, avg(x) AS mean, median(x) AS median, stddev_samp(x) AS std, count(DISTINCT nation)::BIGINT AS networks, count(*) FILTER (a > b)::BIGINT AS wins FROM (SELECT *, CASE WHEN b > 0 THEN 100 * (a - b) / b END AS x FROM pr) GROUP BY ALL),
    q0 AS (SELECT *, p * count(*) OVER (PARTITION BY percent_seeds) / row_number() OVER (PARTITION BY percent_seeds ORDER BY p, method) AS raw, row_number() OVER (PARTITION BY percent_seeds ORDER BY p, method) AS rn FROM wt),
    q1 AS (SELECT *, least(1, min(raw) OVER (PARTITION BY percent_seeds ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM q0)
    SELECT im.method, im.percent_seeds, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, networks, wins, round(p, 6) AS p, round(q, 6) AS q FROM im JOIN q1 ON q1.method = im.method AND q1.percent_seeds = im.percent_seeds""")
def ablation_table(spark, sf_dir):
    """Gains of one method over each other, by setting (regions stand for shares of seeds)."""
    observed = balances(spark, sf_dir).select(F.col("nation").alias("network"), "method", F.col("region").alias("percent_seeds"), F.col("value").alias("percent"))
    df = study.ablation_table(observed, "BUILDING")
    return df.select("method", "percent_seeds", *[r6(c).alias(c) for c in ("mean", "median", "std")], "networks", "wins", *[r6(c).alias(c) for c in ("p", "q")])


# --- random graphs ---


@query("random_graphs")
def random_graphs(spark, sf_dir):
    """Figures of a graph of each kind with as many nodes as there are parts."""
    n = table(spark, sf_dir, "part").count()
    made = {"er": synthetic.erdos_renyi(spark, n, 6), "ba": synthetic.barabasi_albert(spark, n, 6), "ws": synthetic.watts_strogatz(spark, n, 6)}
    rows = [graph.summary(materialise(e, "random")).select(F.lit(k).alias("kind"), "*") for k, e in made.items()]
    return rows[0].union(rows[1]).union(rows[2])
