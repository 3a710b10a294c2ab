"""Maximal cliques and the scores built on them.

Cliques are found among the later neighbours of nodes, in the order of degrees: no node has more than sqrt(2 E) of
them, and each clique is found once, at its first node. Whether an earlier neighbour extends a clique depends only on
which later neighbours it is tied to; a node gets the distinct sets of these, not the neighbours, so a hub's
neighbourhood is never gathered, and no task needs the whole graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.operators.graph import degrees, oriented, triangles
from marram.sources.shared import materialise

XI = 0.001


def _maximal(later: int, near: list[int], guards: list[int]) -> Iterator[int]:
    """Maximal cliques among the candidates (bit sets) that no set of the guards holds whole, with pivoting."""
    stack = [(0, later, 0, guards)]
    while stack:
        chosen, p, x, guards = stack.pop()
        if not p:
            if not x and not guards:
                yield chosen
            continue
        rest, best, pivot = p | x, -1, 0
        while rest:
            i = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            if (n := (p & near[i]).bit_count()) > best:
                best, pivot = n, near[i]
        for g in guards:
            if (n := (p & g).bit_count()) > best:
                best, pivot = n, g
        todo = p & ~pivot
        while todo:
            i = (todo & -todo).bit_length() - 1
            bit = 1 << i
            todo ^= bit
            stack.append((chosen | bit, p & near[i], x & near[i], [g for g in guards if g & bit]))
            p ^= bit
            x |= bit


def maximal_cliques(edges: DataFrame) -> DataFrame:
    """clique (a number), members array<bigint> (sorted) and size of every maximal clique of two nodes or more."""
    later = oriented(edges).groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("later"))
    corners = materialise(triangles(edges).select("a", "b", "c"), "triangles")
    ties = corners.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("xs"), F.collect_list("c").alias("ys"))
    tied = corners.groupBy(F.col("b").alias("node"), "a").agg(F.sort_array(F.collect_list("c")).alias("set"))
    guards = tied.select("node", "set").distinct().groupBy("node").agg(F.collect_list("set").alias("guards"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = []
            for node, names, xs, ys, sets in zip(*(rows.column(i).to_pylist() for i in range(5)), strict=True):
                place = {v: i for i, v in enumerate(names)}
                near = [0] * len(names)
                for x, y in zip(xs or [], ys or [], strict=True):
                    i, j = place[x], place[y]
                    near[i] |= 1 << j
                    near[j] |= 1 << i
                held = [sum(1 << place[v] for v in own) for own in sets or []]
                for chosen in _maximal((1 << len(names)) - 1, near, held):
                    found.append(sorted([node, *(names[i] for i in range(chosen.bit_length()) if chosen >> i & 1)]))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], names=["members"])

    around = later.join(ties, "node", "left").join(guards, "node", "left").select("node", "later", "xs", "ys", "guards")
    found = around.mapInArrow(run, "members array<bigint>")
    return materialise(found.select(F.monotonically_increasing_id().alias("clique"), "members", F.size("members").alias("size")), "cliques")


def incidence(cliques: DataFrame) -> DataFrame:
    return cliques.select("clique", "size", F.explode("members").alias("node"))


def clique_sizes(cliques: DataFrame) -> DataFrame:
    """size, number of cliques and their share in percent."""
    n = cliques.groupBy("size").agg(F.count("*").alias("n"))
    return n.select("size", "n", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("percent"))  # one row per size


def memberships(edges: DataFrame, cliques: DataFrame) -> DataFrame:
    """memberships, number of nodes with so many cliques, and their share in percent."""
    per = clique_participation(edges, cliques).groupBy(F.col("score").cast("long").alias("memberships")).agg(F.count("*").alias("n"))
    return per.select("memberships", "n", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("percent"))


def clique_statistics(edges: DataFrame, cliques: DataFrame) -> DataFrame:
    """One row: clique counts and sizes, and memberships over all nodes."""
    return clique_figures(cliques, []).crossJoin(membership_figures(clique_participation(edges, cliques), []))  # one row each


def clique_figures(cliques: DataFrame, by: list[str]) -> DataFrame:
    """Counts and sizes of cliques (by..., size) in groups."""
    size = F.col("size")
    return cliques.groupBy(*by).agg(F.count("*").alias("n_cliques"), F.max("size").alias("max_size"), F.avg("size").alias("mean_size"), F.percentile("size", 0.5).alias("median_size"), F.count_if(size == 2).alias("n_pairs"), F.count_if(size > 2).alias("n_larger"))


def membership_figures(memberships: DataFrame, by: list[str]) -> DataFrame:
    """In how many cliques nodes are: figures of (by..., score) in groups."""
    return memberships.groupBy(*by).agg(F.avg("score").alias("mean_memberships"), F.percentile("score", 0.5).alias("median_memberships"), F.max("score").cast("long").alias("max_memberships"), (100.0 * F.count_if(F.col("score") >= 1) / F.count("*")).alias("in_one"), (100.0 * F.count_if(F.col("score") >= 2) / F.count("*")).alias("in_two"))


def clique_participation(edges: DataFrame, cliques: DataFrame) -> DataFrame:
    """Number of maximal cliques that hold the node."""
    n = incidence(cliques).groupBy("node").agg(F.count("*").alias("n"))
    return degrees(edges).join(n, "node", "left").select("node", F.coalesce("n", F.lit(0)).cast("double").alias("score"))


def clique_spread(edges: DataFrame, cliques: DataFrame, least: int = 3) -> DataFrame:
    """Number of the node's cliques of this size or more, times the distinct members of them; zero without any."""
    own = incidence(cliques.where(F.col("size") >= least))
    n = own.groupBy("node").agg(F.count("*").alias("n"))
    members = own.select("clique", "node").join(own.select("clique", F.col("node").alias("other")), "clique").select("node", "other").distinct().groupBy("node").agg(F.count("*").alias("m"))
    return degrees(edges).join(n, "node", "left").join(members, "node", "left").select("node", F.coalesce(F.col("n") * F.col("m"), F.lit(0)).cast("double").alias("score"))


def _transformed(x: Column, kind: str) -> Column:
    shape = {"log": F.log1p(x), "linear": x.cast("double"), "boxcox": 2.0 * (F.sqrt(1.0 + x) - 1.0)}[kind]
    return F.when(x <= 0, F.lit(0.0)).otherwise(shape)


def clique_constraint(edges: DataFrame, cliques: DataFrame, *, overlap: bool = True, external: bool = True, transform: str = "log", norm: str = "max") -> DataFrame:
    """One minus the constraint that a node's cliques put on it.

    A member's pressure in a clique is its external degree plus the transformed external degree of the
    others; its share p is (1 - pressure / norm) / number of its cliques, or without `external` one over
    that number. Overlaps of cliques need no join of clique pairs: with W(v, u) = the sum of
    p(v, b) / (size(b) - 1) over the cliques b that hold both, the share and overlap terms of clique a add up
    to the sum of W(v, u) over its other members u. Nodes without a clique score 0.
    """
    k = degrees(edges)
    own = incidence(cliques).join(k, "node")
    within = Window.partitionBy("clique")  # a clique's members
    external_degree = F.greatest(F.lit(0), F.col("k") - (F.col("size") - 1))
    own = own.withColumn("ext", external_degree)
    pressure = F.col("ext") + F.when(F.col("size") > 1, _transformed(F.sum("ext").over(within) - F.col("ext"), transform)).otherwise(0.0)
    own = own.withColumn("pressure", pressure)
    largest = (F.max("pressure") if norm == "max" else F.sum("pressure")).over(within) + XI
    n = own.groupBy("node").agg(F.count("*").alias("n_cliques"))
    own = own.withColumn("largest", largest).join(n, "node")
    p = (1 - F.col("pressure") / F.col("largest")) / F.col("n_cliques") if external else 1.0 / F.col("n_cliques")
    shares = materialise(own.select("node", "clique", "size", p.alias("p")), "shares")
    if overlap:
        pairs = materialise(shares.join(shares.select("clique", F.col("node").alias("other")), "clique").where("node <> other"), "pairs")
        w = pairs.groupBy("node", "other").agg(F.sum(F.col("p") / (F.col("size") - 1)).alias("w"))
        terms = pairs.join(w, ["node", "other"]).groupBy("node", "clique").agg(F.sum("w").alias("term"))
    else:
        terms = shares.select("node", F.col("p").alias("term"))
    score = terms.groupBy("node").agg((1 - F.sum(F.col("term") * F.col("term"))).alias("score"))
    return k.join(score, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def external_degree_sum(edges: DataFrame, cliques: DataFrame) -> DataFrame:
    """Sum over a node's cliques of its neighbours outside them."""
    own = incidence(cliques).join(degrees(edges), "node")
    ext = F.greatest(F.lit(0), F.col("k") - (F.col("size") - 1))
    return own.groupBy("node").agg(F.sum(ext).cast("double").alias("score"))


#: Names of the clique-constraint scores and how they differ from the full one.
VARIANTS = {
    "full": {},
    "no": {"overlap": False},
    "ne": {"external": False},
    "c": {"overlap": False, "external": False},
    "lin": {"transform": "linear"},
    "boxcox": {"transform": "boxcox"},
    "sumnorm": {"norm": "sum"},
}
