"""Connected components by contraction to smallest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.sources.shared import Rounds


def _roots(parents: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, parent) with the end of each chain of parents as parent; chains halve in a step."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jumped = rounds.write(parents.join(up, "parent").select("node", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")), "roots")
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, component) for every node that has an edge; component is the smallest node reachable.

    Null ends and loops are ignored (a node with loops only has no row). In a round every node goes to the smallest of itself and its
    neighbours, chains of such moves are followed to their ends, and the ends are the nodes of the next round, with the edges
    that are left between them. At most half of the nodes are ends, the smallest node of a component always is one, and a
    component that has become one node is done. Minima and repeated edges are combined before they are shuffled, and no node gathers what belongs to it.
    """
    ends = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), F.col(a).isNull().alias("n1"), F.col(b).isNull().alias("n2"))
    kept, links, chains = Rounds(2), Rounds(2), Rounds(None)
    left = links.write(ends.where("not n1 and not n2 and hi <> lo").select("hi", "lo"), "links")
    moves = []
    while not left.isEmpty():
        # Both ends count, so that each node has a row; a lower end's neighbours above it don't matter to it.
        least = left.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("to")), F.struct(F.col("lo").alias("node"), F.col("lo").alias("to")))).alias("x"))
        parents = chains.write(least.groupBy("x.node").agg(F.min("x.to").alias("parent")).select("node", "parent"), "parents")
        moves.append(chains.write(_roots(parents, kept), "moves"))
        hi, lo = (moves[-1].select(F.col("node").alias(c), F.col("parent").alias(f"to_{c}")) for c in ("hi", "lo"))
        both = left.join(hi, "hi").join(lo, "lo").where("to_hi <> to_lo")
        left = links.write(both.select(F.greatest("to_hi", "to_lo").alias("hi"), F.least("to_hi", "to_lo").alias("lo")).distinct(), "links")
    if not moves:
        return left.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    out = moves.pop()
    while moves:  # a node that wasn't in the later round is the smallest of a finished component
        later = out.select(F.col("node").alias("parent"), F.col("parent").alias("component"))
        out = chains.write(moves.pop().join(later, "parent", "left").select("node", F.coalesce("component", "parent").alias("parent")), "resolved")
    return out.select("node", F.col("parent").alias("component"))
