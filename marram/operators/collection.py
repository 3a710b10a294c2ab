"""Many networks at once, as one disjoint union.

Each node of each network gets a number, in the order of (network, node), and the union of all networks over these
numbers is a plain graph. What a node's score takes from its component alone (ties, triangles, cliques, cores,
distances, percolation) is computed on the union as it is; what refers to the whole network takes that network's
own figures, joined by node. So there is one job a round for all networks, never a loop over them, and nodes
without ties are part of their network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.operators import cliques as cl
from marram.operators import community, graph, methods, paths, ranking
from marram.operators.components import connected_components
from marram.operators.order import before, place_within
from marram.sources.shared import materialise


@dataclass
class Collection:
    """nodes (id, graph, node), of networks, and edges (u, v, graph) between ids, u < v."""

    nodes: DataFrame
    edges: DataFrame

    def sizes(self) -> DataFrame:
        """(graph, n, e): nodes and edges of each network."""
        e = self.edges.groupBy("graph").agg(F.count("*").alias("e"))
        return self.nodes.groupBy("graph").agg(F.count("*").alias("n")).join(e, "graph", "left").select("graph", "n", F.coalesce("e", F.lit(0)).cast("long").alias("e"))

    def named(self, rows: DataFrame) -> DataFrame:
        """Rows keyed by node (an id) with graph and the node's own name."""
        own = self.nodes.select(F.col("id").alias("__id"), "graph", F.col("node").alias("__name"))
        kept = [c for c in rows.columns if c != "node"]
        return rows.join(own, rows["node"] == own["__id"]).select("graph", F.col("__name").alias("node"), *kept)

    def local(self) -> DataFrame:
        """(graph, node, k, triangles, clustering) of every node by id, those without ties too."""
        found = graph.clustering(self.edges)
        own = self.nodes.select("graph", F.col("id").alias("node"))
        return own.join(found, "node", "left").select("graph", "node", *[F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("k", "long"), ("triangles", "long"), ("clustering", "double"))])


def collect_networks(pairs: DataFrame, nodes: DataFrame | None = None) -> Collection:
    """The networks of (graph, u, v), simple and undirected, and of further nodes (graph, node), which may have no ties.

    Loops and repeated ties in either direction are dropped, rows with a null network or end too; the ends of a loop stay as nodes.
    """
    known = pairs.where("graph is not null and u is not null and v is not null").select("graph", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    # Ties are often the outcome of a large join, which is made once: of ties and loops each pair of ends is written, and both tables come from there.
    simple = materialise(known.select("graph", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "ties")
    ends = simple.select("graph", F.explode(F.array("a", "b")).alias("node"))
    if nodes is not None:
        ends = ends.union(nodes.where("graph is not null and node is not null").select("graph", F.col("node").cast("long").alias("node")))
    numbered = materialise(before(ends.distinct(), ["graph", "node"], "id").select("id", "graph", "node"), "nodes")
    a = numbered.select("graph", F.col("node").alias("a"), F.col("id").alias("u"))
    b = numbered.select("graph", F.col("node").alias("b"), F.col("id").alias("v"))
    edges = simple.where("a <> b").join(a, ["graph", "a"]).join(b, ["graph", "b"]).select("u", "v", "graph")
    return Collection(numbered, materialise(edges, "graph"))


def largest_components(networks: Collection) -> Collection:
    """Each network's largest component; of equally large ones, that with the smallest node. A network without ties keeps its smallest node."""
    found = connected_components(networks.edges, "u", "v")
    member = networks.nodes.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "graph", "node", F.coalesce("component", "id").alias("component"))
    member = materialise(member, "members")
    sizes = member.groupBy("graph", "component").agg(F.count("*").alias("size"))
    best = sizes.groupBy("graph").agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("component"))
    kept = member.join(best, ["graph", "component"], "left_semi").select("id", "graph", "node")
    nodes = materialise(kept, "nodes")
    return Collection(nodes, materialise(networks.edges.join(nodes.select(F.col("id").alias("u")), "u", "left_semi").select("u", "v", "graph"), "graph"))


def figures(networks: Collection, *, distances: bool = False) -> DataFrame:
    """One row a network: the figures of graph.summary, and with `distances` mean distance and diameter over pairs in reach."""
    table = graph.summarised(networks.local(), ["graph"])
    if not distances:
        return table
    far = networks.nodes.select("graph", F.col("id").alias("node")).join(paths.distance_sums(networks.edges), "node")
    spans = far.groupBy("graph").agg((F.sum("total") / F.sum("reached")).alias("mean_distance"), F.max("farthest").alias("diameter"))
    return table.join(spans, "graph", "left")


def preparation(networks: Collection, kept: Collection) -> DataFrame:
    """One row a network: what the reduction to the largest component (kept, from largest_components) loses, with the share of nodes that stay; deltas are differences of rounded values.

    Ties and triangles of a node lie within its component, so those of all nodes are made once and serve both sides.
    """
    local = materialise(networks.local(), "local")

    def of(rows: DataFrame, p: str) -> DataFrame:
        return graph.summarised(rows, ["graph"]).select("graph", *graph.prepared_figures(p))

    own = local.join(kept.nodes.select(F.col("id").alias("node")), "node", "left_semi")
    return of(local, "raw").join(of(own, "lcc"), "graph").select("graph", *graph.losses(), F.round(100.0 * F.col("lcc_n") / F.col("raw_n"), 2).alias("retained"))


def clique_figures(networks: Collection, cliques: DataFrame) -> DataFrame:
    """One row a network: clique counts and sizes, and memberships over all its nodes."""
    own = networks.nodes.select("graph", F.col("id").alias("node"))
    of = cliques.select("clique", "size", F.element_at("members", 1).alias("node")).join(own, "node")
    per = own.join(cl.incidence(cliques).groupBy("node").agg(F.count("*").alias("n")), "node", "left").select("graph", F.coalesce("n", F.lit(0)).alias("score"))
    return cl.clique_figures(of, ["graph"]).join(cl.membership_figures(per, ["graph"]), "graph")


def _per_network(networks: Collection, scores: DataFrame) -> DataFrame:
    """(node, value, n, e) of scores (node, value): with the sizes of the node's network."""
    own = networks.nodes.select(F.col("id").alias("node"), "graph").join(networks.sizes(), "graph")
    return scores.join(own, "node")


def _degree(networks: Collection, g: methods.Network) -> DataFrame:
    rows = _per_network(networks, graph.degrees(networks.edges))
    return rows.select("node", (F.col("k") / (F.col("n") - 1)).alias("score"))


def _closeness(networks: Collection, g: methods.Network) -> DataFrame:
    rows = _per_network(networks, paths.distance_sums(networks.edges))
    r = F.col("reached")
    return rows.select("node", F.when(F.col("total") > 0, r / F.col("total") * r / (F.col("n") - 1)).otherwise(0.0).alias("score"))


def _betweenness(networks: Collection, g: methods.Network) -> DataFrame:
    rows = _per_network(networks, paths.dependencies(networks.edges))
    pairs = (F.col("n") - 1) * (F.col("n") - 2)
    return rows.select("node", F.when(pairs > 0, F.col("delta") / pairs).otherwise(0.0).alias("score"))


def _vote_rank(networks: Collection, g: methods.Network) -> DataFrame:
    return ranking.vote_rank(networks.edges, networks.nodes.select(F.col("id").alias("node"), "graph")).select("node", "score")


def _community_bridges(networks: Collection, g: methods.Network) -> DataFrame:
    partition = community.louvain(networks.edges, networks.nodes.select(F.col("id").alias("node"), "graph"))
    return ranking.community_bridges(networks.edges, materialise(partition, "partition"))


#: Methods that refer to the whole network; all others are those of a single one.
WHOLE: dict[str, Callable[[Collection, methods.Network], DataFrame]] = {
    "degree": _degree,
    "closeness": _closeness,
    "betweenness": _betweenness,
    "vote_rank": _vote_rank,
    "community_bridges": _community_bridges,
}


def score_all(networks: Collection, wanted: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """(graph, method, node, score) of all methods in all networks, nodes by id, and the error of each method that failed.

    Nodes without ties have no score. What several methods share (cliques) is made once, for all networks.
    """
    shared, done, failed = methods.Network(networks.edges.select("u", "v")), None, {}
    for m in wanted:
        try:
            scores = WHOLE[m](networks, shared) if m in WHOLE else methods.score(m, shared)
            own = networks.nodes.select(F.col("id").alias("node"), "graph")
            rows = materialise(scores.join(own, "node").select("graph", F.lit(m).alias("method"), "node", F.col("score").cast("double").alias("score")), "scores")
        except Exception as error:  # noqa: BLE001  isolated on purpose, and reported
            failed[m] = f"{type(error).__name__}: {error}"
            continue
        done = rows if done is None else done.union(rows)
    if done is None:
        done = networks.nodes.where("false").select("graph", F.lit("").alias("method"), F.col("id").alias("node"), F.lit(0.0).alias("score"))
    return done, failed


def rank_all(scores: DataFrame, digits: int | None = 8) -> DataFrame:
    """(graph, method, node, score, rank) by score (rounded, unless digits is None) descending, then node, in each network and method; null and NaN scores are left out."""
    value = F.round("score", digits) if digits is not None else F.col("score")
    rows = scores.where(F.col("score").isNotNull() & ~F.isnan("score")).withColumn("key", -value)
    return place_within(rows, ["graph", "method"], ["key", "node"], "place").select("graph", "method", "node", "score", (F.col("place") + 1).alias("rank"))


def frequencies(ranks: DataFrame, digits: int = 8) -> DataFrame:
    """(graph, method, rank, n): of each group of equal scores (rounded), its rank (1, 1 + n1, ...) and its number of nodes, from rankings (rank_all) by scores rounded likewise."""
    groups = ranks.groupBy("graph", "method", F.round("score", digits).alias("s")).agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    return groups.select("graph", "method", "rank", "n")


def seed_sets(networks: Collection, ranks: DataFrame, percents: list[int], rule: str = "floor1") -> DataFrame:
    """(graph, method, percent, set_id, node): the first nodes of each ranking, as many as the percentage of the own network's nodes asks for."""
    percent = F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")
    counts = networks.sizes().select("graph", "n", percent)
    counts = counts.select("graph", "percent", ranking.seeds_of(F.col("n"), F.col("percent"), rule).alias("seeds"))
    sets = ranks.join(counts, "graph").where("rank <= seeds")
    return sets.select("graph", "method", "percent", F.to_json(F.struct("graph", "method", "percent")).alias("set_id"), "node")
