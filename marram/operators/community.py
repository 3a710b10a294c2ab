"""Louvain communities by rounds of simultaneous moves and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.sources.shared import Rounds, materialise


def modularity(edges: DataFrame, partition: DataFrame) -> float:
    """Modularity of a partition (node, community) of a graph (u, v)."""
    a, b = (partition.select(F.col("node").alias(c), F.col("community").alias(f"c{c}")) for c in ("u", "v"))
    ties = edges.join(a, "u").join(b, "v")
    m = edges.count()
    if not m:
        return 0.0
    inner = ties.where("cu = cv").count()
    volume = ties.select(F.explode(F.array("cu", "cv")).alias("c")).groupBy("c").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inner / m - volume / (4 * m * m)


#: Rounds without a gain in modularity after which a level ends (moves are made at once, so a round may also lose).
PATIENCE = 4


def _quality(ties: DataFrame, state: DataFrame) -> float:
    """Modularity, summed over networks, in one job."""
    u = state.select(F.col("node").alias("u"), F.col("community").alias("cu"), "two_m")
    v = state.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    inside = ties.join(u, "u").join(v, "v").where("cu = cv").agg(F.sum(F.col("w") / F.col("two_m")).alias("part"))
    share = state.groupBy("community").agg(F.sum(F.col("k") / F.col("two_m")).alias("t")).agg((-F.sum(F.col("t") * F.col("t"))).alias("part"))
    return inside.union(share).agg(F.coalesce(F.sum("part"), F.lit(0.0))).first()[0]


def _wishes(ties: DataFrame, state: DataFrame) -> DataFrame:
    """(node, community, to, rise) of the nodes that gain by a move: the community they gain most by, and how much more than by staying."""
    totals = state.groupBy("community").agg(F.sum("k").alias("total"))
    near = ties.where("u <> v").join(state.select(F.col("node").alias("v"), "community"), "v").groupBy("u", "community").agg(F.sum("w").alias("inside"))
    own = state.join(totals, "community").select(F.col("node").alias("u"), F.col("community").alias("mine"), "k", "two_m", F.col("total").alias("own_total"))
    tried = near.join(totals, "community").join(own, "u")
    rest = F.when(F.col("community") == F.col("mine"), F.col("total") - F.col("k")).otherwise(F.col("total"))
    tried = tried.withColumn("gain", F.col("inside") - F.col("k") * rest / F.col("two_m"))
    here = F.max(F.when(F.col("community") == F.col("mine"), F.col("gain")))
    alone = F.max(-F.col("k") * (F.col("own_total") - F.col("k")) / F.col("two_m"))
    best = tried.groupBy("u", "mine").agg(F.max_by(F.struct("community", "gain"), F.struct("gain", -F.col("community"))).alias("best"), F.coalesce(here, alone).alias("stay"))
    return best.select(F.col("u").alias("node"), F.col("mine").alias("community"), F.col("best.community").alias("to"), (F.col("best.gain") - F.col("stay")).alias("rise")).where("`to` <> community and rise > 1e-9")


def _moved(state: DataFrame, moves: DataFrame) -> DataFrame:
    return state.join(moves.select("node", "to"), "node", "left").select("node", F.coalesce("to", "community").alias("community"), "k", "two_m")


def _settle(ties: DataFrame, scale: DataFrame) -> DataFrame:
    """Moves nodes of weighted networks (u, v, w both ways; loops count twice) until none gains by a move, or modularity has not risen for PATIENCE rounds. Returns the best (node, community) met.

    scale: (node, two_m), the summed weight of the node's network.
    """
    rounds, moves = Rounds(PATIENCE + 2), Rounds(3)  # the best state is read until PATIENCE later ones are written
    volume = ties.groupBy("u").agg(F.sum("w").alias("k"))
    first = volume.join(scale, F.col("u") == F.col("node")).select("node", F.col("node").alias("community"), "k", "two_m")
    state = materialise(first, "state")
    best, reached, waited, still, turn = state, _quality(ties, state), 0, 0, -1
    while waited < PATIENCE and still < 2:
        turn += 1
        # Half of the nodes may move in a round, chosen by hash, so that neighbours don't swap for ever.
        wish = moves.write(_wishes(ties, state).where(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0), "wishes")
        still = 0 if wish.head(1) else still + 1  # both halves had their turn
        if still:
            continue
        state = rounds.write(_moved(state, wish), "state")
        now = _quality(ties, state)
        if now > reached + 1e-12:
            best, reached, waited = state, now, 0
        else:
            waited += 1
    return best.select("node", "community")


def louvain(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, community): modularity is raised by moves within levels; communities become nodes of the next, until a level merges nothing. A community's name is its smallest node.

    nodes: (node, graph) if edges are the disjoint union of several networks; each then has a modularity of its own, and all
    settle in the same rounds. Moves are decided for all nodes of a round at once and made by a hashed half of them, so the result is
    reproducible but differs from that of a sequential sweep. Nodes without ties have no community.
    """
    both = edges.select("u", "v").union(edges.select("v", "u")).select(F.col("u"), F.col("v"), F.lit(1.0).alias("w"))
    ties = materialise(both, "ties")
    volume = ties.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"))
    volume = volume.withColumn("graph", F.lit(0)) if nodes is None else volume.join(nodes.select("node", "graph"), "node")
    total = volume.groupBy("graph").agg(F.sum("k").alias("two_m"))
    scale = materialise(volume.join(total, "graph").select("node", "two_m"), "scale")  # a community is named by one of its nodes
    of = materialise(ties.select(F.col("u").alias("node"), F.col("u").alias("community")).distinct(), "communities")
    while not ties.isEmpty():
        step = _settle(ties, scale)
        merged = materialise(step.select(F.col("node").alias("from"), F.col("community").alias("to")), "step")
        if merged.where("`from` <> `to`").isEmpty():
            break
        of = materialise(of.join(merged, F.col("community") == F.col("from")).select("node", F.col("to").alias("community")), "communities")
        a, b = merged.select(F.col("from").alias("u"), F.col("to").alias("a")), merged.select(F.col("from").alias("v"), F.col("to").alias("b"))
        ties = materialise(ties.join(a, "u").join(b, "v").groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("w").alias("w")), "ties")
    names = of.groupBy("community").agg(F.min("node").alias("name"))
    return of.join(names, "community").select("node", F.col("name").alias("community"))
