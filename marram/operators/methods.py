"""All ranking methods behind one name each."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.operators import cliques as cl
from marram.operators import community, paths, ranking
from marram.operators.graph import degrees
from marram.sources.shared import materialise


class Network:
    """A graph with what several methods share, each made once and kept as a table."""

    def __init__(self, edges: DataFrame, partition: DataFrame | None = None):
        self.edges = materialise(edges, "graph")
        self._cliques: DataFrame | None = None
        self._partition = partition

    @property
    def cliques(self) -> DataFrame:
        if self._cliques is None:
            self._cliques = cl.maximal_cliques(self.edges)
        return self._cliques

    @property
    def partition(self) -> DataFrame:
        if self._partition is None:
            self._partition = materialise(community.louvain(self.edges), "partition")
        return self._partition

    @property
    def size(self) -> int:
        return degrees(self.edges).count()


def _vote_rank(g: Network) -> DataFrame:
    return ranking.vote_rank(g.edges).select("node", "score")


METHODS: dict[str, Callable[[Network], DataFrame]] = {
    "degree": lambda g: ranking.degree_centrality(g.edges),
    "betweenness": lambda g: paths.betweenness(g.edges),
    "closeness": lambda g: paths.closeness(g.edges),
    "core": lambda g: ranking.core_numbers(g.edges),
    "structural_holes": lambda g: ranking.structural_holes(g.edges),
    "improved_structural_holes": lambda g: ranking.improved_structural_holes(g.edges),
    "collective_influence": lambda g: ranking.collective_influence(g.edges),
    "neighbourhood_constraint": lambda g: ranking.neighbourhood_constraint(g.edges),
    "clique_spread": lambda g: cl.clique_spread(g.edges, g.cliques),
    "clique_participation": lambda g: cl.clique_participation(g.edges, g.cliques),
    "community_bridges": lambda g: ranking.community_bridges(g.edges, g.partition),
    "vote_rank": _vote_rank,
    "clique_external": lambda g: cl.external_degree_sum(g.edges, g.cliques),
    **{f"clique_{name}": lambda g, o=options: cl.clique_constraint(g.edges, g.cliques, **o) for name, options in cl.VARIANTS.items()},
}


def score(method: str, network: Network) -> DataFrame:
    """(node, score); raises ValueError for an unknown method."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    return METHODS[method](network)


def score_all(network: Network, methods: Iterable[str], graph_id: str = "g") -> tuple[DataFrame, dict[str, str]]:
    """(graph_id, method, node, score) of all methods, and the error of each method that failed; a failure leaves the others alone."""
    done, failed = None, {}
    for m in methods:
        try:
            rows = materialise(score(m, network).select(F.lit(graph_id).alias("graph_id"), F.lit(m).alias("method"), "node", F.col("score").cast("double").alias("score")), "scores")
        except Exception as error:  # noqa: BLE001  isolated on purpose, and reported
            failed[m] = f"{type(error).__name__}: {error}"
            continue
        done = rows if done is None else done.union(rows)
    if done is None:
        done = network.edges.sparkSession.createDataFrame([], "graph_id string, method string, node long, score double")
    return done, failed
