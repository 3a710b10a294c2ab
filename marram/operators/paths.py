"""Distances by breadth-first search from many sources at once.

Bits say which sources have reached a node; distances are never listed pair by pair. Searches from all sources go by ranges of
nodes and blocks of sources (blocks.py); those for listed pairs keep eight long integers for one node and one block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.operators import blocks, flows
from marram.operators.graph import adjacency, degrees, relabel
from marram.operators.order import before, place_within
from marram.operators.permute import permuted
from marram.sources.shared import Rounds, materialise

WORDS = 8
_BITS = [f"b{i}" for i in range(WORDS)]


def _own_bits(label: Column) -> list[Column]:
    """The bits of a source among the 64 * WORDS of its block."""
    word = F.floor(label % (64 * WORDS) / 64)
    return [F.when(word == i, F.expr("shiftleft(1L, cast(label % 64 as int))")).otherwise(F.lit(0).cast("long")).alias(b) for i, b in enumerate(_BITS)]


def _labelled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, label) in the order of ids, and the arcs (u, v) between labels, both ways."""
    labels = materialise(relabel(edges).select("node", "label"), "labels")
    end = lambda c, to: labels.select(F.col("node").alias(c), F.col("label").alias(to))
    ties = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).join(end("a", "u"), "a").join(end("b", "v"), "b").select("u", "v")
    return labels, adjacency(ties)


def distance_sums(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """node, reached (sources other than itself that reach it), total (sum of their distances) and farthest, for every node.

    sources: (node); all nodes if it is None. Graphs are undirected, so over all sources these are the node's own sums.
    """
    labels, arcs = _labelled(edges)
    if sources is None:
        numbered = labels.select(F.col("label").alias("node"), F.col("label").alias("source"))
    else:
        own = relabel(sources.select(F.col("node").alias("u"), F.col("node").alias("v"))).select("node", F.col("label").alias("source"))
        numbered = own.join(labels, "node").select(F.col("label").alias("node"), "source")
    added = [F.sum("reached").alias("reached"), F.sum("total").alias("total"), F.max("farthest").alias("farthest")]
    turns = [materialise(blocks.sums(state).groupBy("label").agg(*added), "sums") for _, state, done in blocks.searches(arcs, numbered) if done]
    got = turns[0] if len(turns) == 1 else reduce(DataFrame.union, turns).groupBy("label").agg(*added)
    return labels.join(got, "label", "left").select("node", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("reached", "total", "farthest")])


def set_dispersions(edges: DataFrame, sets: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(set_id, k, mean_distance): the exact mean distance over unordered pairs of each seed set (set_id, node), from one search for all sets.

    A pair out of reach counts as the number of nodes of the graph, or as n of sizes (set_id, n). 0 for fewer than two seeds; repeated rows
    count once. No pair is listed: a set is a mask over the sources of a block, and what a seed was reached by at a level is counted in it.
    """
    members = materialise(sets.where("set_id is not null and node is not null").select("set_id", "node").distinct(), "sets")
    labels = materialise(before(members.select("node").distinct(), ["node"], "label"), "labels")
    numbers = materialise(before(members.select("set_id").distinct(), ["set_id"], "set"), "numbers")
    own = members.join(numbers, "set_id").select("set", "node")
    known, arcs = _labelled(edges)

    def packed(places: DataFrame, span: int, name: str) -> DataFrame:
        label = F.col("label")
        return materialise(blocks.packed_members(own.join(places, "node").select(F.floor(label / span).alias("key"), "set", (label % span).alias("at"))), name)

    at, of = packed(known, blocks.SPAN, "places"), packed(labels, blocks.WIDE, "masks")
    numbered = labels.select("node", F.col("label").alias("source")).join(known, "node").select(F.col("label").alias("node"), "source")
    levels = [materialise(blocks.met_in_sets(state, at, of).select("set", "n", F.lit(d).alias("d")), "sums") for d, state, done in blocks.searches(arcs, numbered) if not done]
    k = members.groupBy("set_id").agg(F.count("*").alias("k"))
    if sizes is None:
        k = k.crossJoin(F.broadcast(degrees(edges).agg(F.count("*").alias("far"))))  # one row
    else:
        k = k.join(sizes.select("set_id", F.col("n").alias("far")), "set_id")
    pairs, zero = F.col("k") * (F.col("k") - 1), F.lit(0).cast("long")
    if levels:
        sums = reduce(DataFrame.union, levels).join(numbers, "set").groupBy("set_id").agg(F.sum("n").alias("reached"), F.sum(F.col("n") * F.col("d")).alias("total"))
        k = k.join(sums, "set_id", "left").withColumn("reached", F.coalesce("reached", zero)).withColumn("total", F.coalesce("total", zero))
    else:
        k = k.withColumn("reached", zero).withColumn("total", zero)
    value = F.when(F.col("k") > 1, (F.col("total") + (pairs - F.col("reached")) * F.col("far")) / pairs).otherwise(0.0)
    return k.select("set_id", "k", value.alias("mean_distance"))


def closeness(edges: DataFrame) -> DataFrame:
    """Reached nodes over their summed distance, scaled by the share of nodes reached."""
    n = degrees(edges).agg(F.count("*").alias("n"))
    r = F.col("reached")
    value = F.when(F.col("total") > 0, r / F.col("total") * r / (F.col("n") - 1)).otherwise(0.0)
    return distance_sums(edges).crossJoin(F.broadcast(n)).select("node", value.alias("score"))  # n is one row


def path_statistics(edges: DataFrame) -> DataFrame:
    """One row: mean distance over reachable pairs, diameter, radius."""
    return distance_sums(edges).agg((F.sum("total") / F.sum("reached")).alias("mean_distance"), F.max("farthest").alias("diameter"), F.min("farthest").alias("radius"))


def dispersion(edges: DataFrame, seeds: DataFrame, unreachable: int | None = None) -> DataFrame:
    """One row: k and the mean distance over unordered pairs of seeds (node); pairs out of reach count as `unreachable` (the number of nodes if None); 0 for fewer than two."""
    n = degrees(edges).agg(F.count("*").alias("n"))
    far = F.lit(unreachable) if unreachable is not None else F.col("n")
    k = F.col("k")
    among = distance_sums(edges, seeds).join(seeds.select("node").distinct(), "node").agg(F.count("*").alias("k"), F.sum("reached").alias("reached"), F.sum("total").alias("total")).crossJoin(n)
    value = F.when(k > 1, (F.col("total") + (k * (k - 1) - F.col("reached")) * far) / (k * (k - 1))).otherwise(0.0)
    return among.select("k", value.alias("mean_distance"))


def pair_distances(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, node, d) of the pairs (source, node) that reach each other, by a search from their sources alone.

    As in distance_sums a row carries a block of sources as bits; a level looks up which of the pairs not yet found have the bit of
    their source set, and the search ends with the last pair that is found, or that can't be.
    """
    adj = materialise(adjacency(edges), "adjacency")
    wanted = materialise(pairs.select("source", "node").distinct(), "pairs")
    labels = materialise(before(wanted.select("source").distinct(), ["source"], "label"), "labels")
    label, span = F.col("label"), 64 * WORDS
    own = [F.when(F.floor(label % span / 64) == i, F.expr("shiftleft(1L, cast(label % 64 as int))")).otherwise(F.lit(0).cast("long")).alias(b) for i, b in enumerate(_BITS)]
    todo = wanted.join(labels, "source").select("source", "node", F.floor(label / span).alias("block"), F.floor(label % span / 64).cast("int").alias("word"), (label % 64).cast("int").alias("bit"))
    found, rings, states, open_ = [materialise(wanted.where("source = node").withColumn("d", F.lit(0)), "found")], Rounds(3), Rounds(3), Rounds(3)
    todo = open_.write(todo.where("source <> node"), "todo")
    ring = rings.write(labels.select(F.col("source").alias("node"), F.floor(label / span).alias("block"), *own), "ring")
    seen, d = ring, 0
    while not todo.isEmpty() and not ring.isEmpty():
        d += 1
        told = [F.bit_or(b).alias(b) for b in _BITS]
        reached = ring.join(adj, ring["node"] == adj["u"]).groupBy(F.col("v").alias("node"), "block").agg(*told)
        old = seen.select("node", "block", *[F.col(b).alias(f"s{b}") for b in _BITS])
        fresh = [F.col(b).bitwiseAND(F.bitwise_not(F.coalesce(f"s{b}", F.lit(0).cast("long")))).alias(b) for b in _BITS]
        ring = rings.write(reached.join(old, ["node", "block"], "left").select("node", "block", *fresh).where(" or ".join(f"{b} <> 0" for b in _BITS)), "ring")
        seen = states.write(seen.union(ring).groupBy("node", "block").agg(*told), "seen")
        here = F.expr(f"shiftright(element_at(array({', '.join(_BITS)}), word + 1), bit) & 1 = 1")
        hit = materialise(todo.join(ring, ["node", "block"]).where(here).select("source", "node", F.lit(d).alias("d")), "found")
        found.append(hit)
        todo = open_.write(todo.join(hit, ["source", "node"], "left_anti"), "todo")
    return reduce(DataFrame.union, found)


def sampled_pairs(sets: DataFrame, most: int = 6000, seed: int = 0) -> DataFrame:
    """(set_id, source, node), source < node: all unordered pairs of each set (set_id, node) if there are no more than `most`, else that many different ones.

    Pairs are numbered, and a permutation keyed by the set gives the numbers to take, so no pair is listed that isn't taken.
    """
    placed = materialise(place_within(sets.select("set_id", "node").distinct(), ["set_id"], ["node"], "at"), "places")
    total = F.shiftright(F.col("k") * (F.col("k") - 1), 1)
    counts = placed.groupBy("set_id").agg(F.count("*").alias("k")).select("set_id", total.alias("total")).where("total > 0")
    numbers = counts.select("set_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(most), F.col("total")) - 1)).alias("q"))
    p = F.when(F.col("total") > most, permuted(F.col("q"), F.col("total"), F.lit(seed), F.lit("pairs"), F.col("set_id"))).otherwise(F.col("q"))
    # Pair p stands for places i < j: j is the largest whole number with j (j - 1) / 2 <= p.
    rough = F.floor((1 + F.sqrt(1 + 8 * F.col("p").cast("double"))) / 2).cast("long")
    before_ = lambda j: F.shiftright(j * (j - 1), 1)
    exact = F.when(before_(rough) > F.col("p"), rough - 1).when(before_(rough + 1) <= F.col("p"), rough + 1).otherwise(rough)
    picked = numbers.select("set_id", p.alias("p")).select("set_id", "p", exact.alias("j")).select("set_id", (F.col("p") - before_(F.col("j"))).alias("i"), "j")
    a, b = placed.select("set_id", F.col("at").alias("i"), F.col("node").alias("source")), placed.select("set_id", F.col("at").alias("j"), "node")
    return picked.join(a, ["set_id", "i"]).join(b, ["set_id", "j"]).select("set_id", "source", "node")


def sampled_dispersion(edges: DataFrame, sets: DataFrame, most: int = 6000, seed: int = 0) -> DataFrame:
    """(set_id, k, pairs, mean_distance) of seed sets (set_id, node): over all unordered pairs of a set, or `most` different ones of them if there are more.

    One search serves all sets, from the sources of their pairs. Pairs out of reach count as the number of nodes; 0 for fewer than two seeds.
    """
    n = degrees(edges).agg(F.count("*").alias("n"))
    pairs = materialise(sampled_pairs(sets, most, seed), "pairs")
    far = pairs.join(pair_distances(edges, pairs), ["source", "node"], "left").crossJoin(F.broadcast(n))  # n is one row
    means = far.groupBy("set_id").agg(F.count("*").alias("pairs"), F.avg(F.coalesce("d", "n")).alias("mean_distance"))
    k = sets.select("set_id", "node").distinct().groupBy("set_id").agg(F.count("*").alias("k"))
    return k.join(means, "set_id", "left").select("set_id", "k", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"), F.coalesce("mean_distance", F.lit(0.0)).alias("mean_distance"))


def betweenness(edges: DataFrame) -> DataFrame:
    """Exact shortest-path betweenness over unordered pairs, normalised by the number of pairs without the node."""
    sums = dependencies(edges)
    n = sums.agg(F.count("*").alias("n"))
    pairs = (F.col("n") - 1) * (F.col("n") - 2)
    return sums.crossJoin(F.broadcast(n)).select("node", F.when(pairs > 0, F.col("delta") / pairs).otherwise(0.0).alias("score"))  # n is one row


#: Pairs (source, node) that a wave of sources may hold in its state, at 20 bytes a pair.
WAVE_ROWS = 1 << 28


def dependencies(edges: DataFrame, wave: int | None = None) -> DataFrame:
    """(node, delta): of every node, the shares of shortest paths through it, summed over ordered pairs of other nodes.

    Sources take their turn in waves, so that the state is bounded, not one for all pairs of nodes: `wave` sources at a time, or as
    many as WAVE_ROWS allows. A wave goes by ranges of nodes and blocks of sources (flows.py) and leaves a row a node; its tables are deleted then. The
    work itself is that of exact betweenness, nodes times edges, whatever the waves.
    """
    labels, arcs = _labelled(edges)
    n = labels.count()
    if not n:
        return labels.select("node", F.lit(0.0).alias("delta"))
    wave = max(1, wave if wave is not None else WAVE_ROWS // n)
    groups = flows.groups_of(n, min(n, wave))
    dealt, totals, sums = flows.dealt_arcs(arcs, groups), Rounds(2), None
    for first in range(0, n, wave):
        own = flows.dependencies(dealt, groups, n, first, min(n, first + wave))
        sums = own if sums is None else totals.write(sums.union(own).groupBy("label").agg(F.sum("delta").alias("delta")), "sums")
    return labels.join(sums, "label", "left").select("node", F.coalesce("delta", F.lit(0.0)).alias("delta"))


def jaccard(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, jaccard) of open neighbourhoods for the pairs asked for; 0 where both are empty."""
    adj, k = adjacency(edges), degrees(edges)
    first = pairs.join(adj.select(F.col("u").alias("i"), F.col("v").alias("x")), "i")
    common = first.join(adj.select(F.col("u").alias("j"), F.col("v").alias("x")), ["j", "x"]).groupBy("i", "j").agg(F.count("*").alias("common"))
    size = lambda c: k.select(F.col("node").alias(c), F.col("k").alias(f"k{c}"))
    c = F.coalesce("common", F.lit(0))
    union = F.coalesce("ki", F.lit(0)) + F.coalesce("kj", F.lit(0)) - c
    return pairs.join(common, ["i", "j"], "left").join(size("i"), "i", "left").join(size("j"), "j", "left").select("i", "j", F.when(union > 0, c / union).otherwise(0.0).alias("jaccard"))


def mean_jaccard(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row: k and the mean Jaccard similarity over unordered pairs of seeds; null for fewer than two."""
    own = set_similarities(edges, seeds.select(F.lit(0).alias("set_id"), "node")).select("k", "mean_jaccard")
    return own.groupBy().agg(F.coalesce(F.max("k"), F.lit(0)).cast("long").alias("k"), F.max("mean_jaccard").alias("mean_jaccard"))  # one set


def set_similarities(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_id, k, mean_jaccard): the mean Jaccard similarity of neighbourhoods over unordered pairs of each seed set (set_id, node); null for fewer than two seeds, repeated rows count once.

    Only pairs with a common neighbour are joined; the others are counted as 0.
    """
    adj, k = adjacency(edges), degrees(edges)
    own = sets.where("set_id is not null and node is not null").select("set_id", "node").distinct()
    near = materialise(own.join(adj, own["node"] == adj["u"]).select("set_id", "node", F.col("v").alias("x")), "near")
    common = near.withColumnRenamed("node", "i").join(near.withColumnRenamed("node", "j"), ["set_id", "x"]).where("i < j").groupBy("set_id", "i", "j").agg(F.count("*").alias("common"))
    size = lambda c: k.select(F.col("node").alias(c), F.col("k").alias(f"k{c}"))
    value = F.col("common") / (F.col("ki") + F.col("kj") - F.col("common"))
    total = common.join(size("i"), "i").join(size("j"), "j").groupBy("set_id").agg(F.sum(value).alias("total"))
    n = F.col("k")
    counts = own.groupBy("set_id").agg(F.count("*").alias("k"))
    return counts.join(total, "set_id", "left").select("set_id", "k", F.when(n > 1, F.coalesce("total", F.lit(0.0)) / (n * (n - 1) / 2)).alias("mean_jaccard"))
