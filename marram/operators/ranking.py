"""Node scores from local structure. Each takes edges and returns (node, score)."""

from __future__ import annotations

from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.operators.graph import adjacency, clustering, degrees, triangles
from marram.operators.order import before, place_within
from marram.sources.shared import Rounds, materialise


def degree_centrality(edges: DataFrame) -> DataFrame:
    k = degrees(edges)
    n = k.agg(F.count("*").alias("n"))
    return k.crossJoin(F.broadcast(n)).select("node", (F.col("k") / (F.col("n") - 1)).alias("score"))  # n is one row


def _corners(edges: DataFrame) -> DataFrame:
    """(i, j, q): q is a common neighbour of the adjacent i and j."""
    perms = [("a", "b", "c"), ("a", "c", "b"), ("b", "a", "c"), ("b", "c", "a"), ("c", "a", "b"), ("c", "b", "a")]
    return triangles(edges).select(F.explode(F.array(*[F.struct(F.col(x).alias("i"), F.col(y).alias("j"), F.col(z).alias("q")) for x, y, z in perms])).alias("t")).select("t.*")


def _redundancy(edges: DataFrame, shares: DataFrame) -> DataFrame:
    """One minus Burt's constraint for shares (u, v, p) of u's ties."""
    first = shares.select(F.col("u").alias("i"), F.col("v").alias("q"), F.col("p").alias("p_iq"))
    second = shares.select(F.col("u").alias("q"), F.col("v").alias("j"), F.col("p").alias("p_qj"))
    indirect = _corners(edges).join(first, ["i", "q"]).join(second, ["q", "j"]).groupBy("i", "j").agg(F.sum(F.col("p_iq") * F.col("p_qj")).alias("via"))
    tie = F.col("p") + F.coalesce("via", F.lit(0.0))
    joined = shares.join(indirect, (F.col("u") == F.col("i")) & (F.col("v") == F.col("j")), "left")
    return joined.groupBy(F.col("u").alias("node")).agg((1 - F.sum(tie * tie)).alias("score"))


def structural_holes(edges: DataFrame) -> DataFrame:
    """One minus the constraint with equal shares 1/k."""
    k = degrees(edges).withColumnRenamed("node", "u")
    return _redundancy(edges, adjacency(edges).join(k, "u").select("u", "v", (1.0 / F.col("k")).alias("p")))


def improved_structural_holes(edges: DataFrame) -> DataFrame:
    """As above, shares in proportion to k_i + k_j."""
    k = degrees(edges)
    both = adjacency(edges).join(k.select(F.col("node").alias("u"), F.col("k").alias("ku")), "u").join(k.select(F.col("node").alias("v"), F.col("k").alias("kv")), "v")
    total = both.groupBy("u").agg(F.sum(F.col("ku") + F.col("kv")).alias("total"))
    return _redundancy(edges, both.join(total, "u").select("u", "v", ((F.col("ku") + F.col("kv")) / F.col("total")).alias("p")))


def ball(edges: DataFrame, radius: int) -> DataFrame:
    """(node, other, d) for all pairs at distance 1..radius, by joins with the adjacency and anti-joins with what is nearer."""
    adj = adjacency(edges)
    seen = adj.select(F.col("u").alias("node"), F.col("v").alias("other"), F.lit(1).alias("d"))
    ring = seen
    for d in range(2, radius + 1):
        further = ring.join(adj.withColumnRenamed("u", "other"), "other").select("node", F.col("v").alias("other")).where("node <> other").distinct()
        ring = further.join(seen, ["node", "other"], "left_anti").withColumn("d", F.lit(d))
        if radius > 2:
            ring = materialise(ring, "ring")
        seen = seen.union(ring)
    return seen


def collective_influence(edges: DataFrame, radius: int = 2) -> DataFrame:
    """(k - 1) times the sum of k_j - 1 over the nodes at exactly this distance."""
    k = degrees(edges)
    rim = ball(edges, radius).where(F.col("d") == radius).join(k.select(F.col("node").alias("other"), (F.col("k") - 1).alias("less")), "other")
    total = rim.groupBy("node").agg(F.sum("less").alias("total"))
    return k.join(total, "node", "left").select("node", ((F.col("k") - 1) * F.coalesce("total", F.lit(0).cast("long"))).cast("double").alias("score"))


def neighbourhood_constraint(edges: DataFrame) -> DataFrame:
    """Masses k e^c weighted by e^-constraint / 2, summed over the closed ball of radius two."""
    local = clustering(edges).select("node", (F.col("k") * F.exp("clustering")).alias("mass"))
    node = materialise(local.join(structural_holes(edges), "node").select("node", "mass", (F.exp(F.col("score") - 1) / 2).alias("weight")), "mass")
    near = ball(edges, 2).select("node", "other").union(node.select("node", F.col("node").alias("other")))
    sums = near.join(node.select(F.col("node").alias("other"), F.col("mass").alias("their")), "other").groupBy("node").agg(F.sum("their").alias("total"))
    return node.join(sums, "node").select("node", (F.col("weight") * F.col("weight") * F.col("mass") * F.col("total")).alias("score"))


def core_numbers(edges: DataFrame) -> DataFrame:
    """Core number as the fixpoint of neighbours' h-indices, from degrees downward.

    The h-index comes from counts per value, summed from above, so a hub's neighbours are counted, not listed.
    """
    adj = materialise(adjacency(edges), "adjacency")
    rounds = Rounds(2)
    core = rounds.write(degrees(edges).select("node", F.col("k").alias("c")), "core")
    last = None
    while True:
        their = adj.join(core.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v").groupBy("u", "cv").agg(F.count("*").alias("n"))
        above = F.sum("n").over(Window.partitionBy("u").orderBy(F.desc("cv")))
        h = their.withColumn("m", F.least(above, F.col("cv"))).groupBy("u").agg(F.max("m").alias("h"))
        core = rounds.write(core.join(h, core["node"] == h["u"]).select("node", F.least("c", "h").alias("c")), "core")
        now = core.agg(F.sum("c")).first()[0]
        if now == last:
            return core.select("node", F.col("c").cast("double").alias("score"))
        last = now


def community_bridges(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Own community's size times neighbours inside, plus neighbours outside times the distinct communities among them.

    partition: (node, community); its communities are counted over the nodes of the graph.
    """
    k = degrees(edges).select("node").join(partition, "node")
    sizes = k.groupBy("community").agg(F.count("*").alias("size"))
    of = k.join(sizes, "community")
    ties = adjacency(edges).join(of.select(F.col("node").alias("u"), F.col("community").alias("cu"), "size"), "u").join(k.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v")
    inside = F.col("cu") == F.col("cv")
    return ties.groupBy(F.col("u").alias("node"), "size").agg(F.count_if(inside).alias("inner"), F.count_if(~inside).alias("outer"), F.count_distinct(F.when(~inside, F.col("cv"))).alias("foreign")).select("node", (F.col("size") * F.col("inner") + F.col("outer") * F.col("foreign")).cast("double").alias("score"))


#: Ties (both ways) of a block of nodes that a task may settle on its own in vote_rank.
BLOCK_TIES = 1 << 20


def _settled_in_block(ids: list[int], size: int, e2: int, counts: list[int], votes: list[int], inner: list[bool], heads: list[int], tails: list[int]) -> list[tuple[int, int]]:
    """(place, votes) of the nodes of one block, of one network, that can be picked without knowing what other blocks pick.

    inner: all nodes within two ties are in the block. Nodes come up by votes; an inner one that waits for nobody is picked, any other makes the
    nodes within two ties wait for it. Votes of outer nodes are what they had at the start, which is never too few.
    """
    n = len(ids)
    near: list[list[int]] = [[] for _ in range(n)]
    for i, j in zip(heads, tails, strict=True):
        near[i].append(j)
    able = lambda c: max(0, e2 - c * size)
    todo = [(-votes[i], ids[i], i) for i in range(n)]
    heapify(todo)
    open_, waits, picks = [True] * n, [False] * n, []
    while todo:
        v, _, i = heappop(todo)
        if not open_[i]:
            continue
        if -v != votes[i]:
            heappush(todo, (-votes[i], ids[i], i))
            continue
        open_[i] = False
        if waits[i] or not inner[i]:
            for j in near[i]:
                waits[j] = True
                for k in near[j]:
                    waits[k] = True
            continue
        picks.append((i, votes[i]))
        mine, counts[i] = able(counts[i]), e2 + 1  # its ability is gone
        for j in near[i]:
            votes[j] -= mine
            lost = able(counts[j])
            counts[j] += 1
            if lost := lost - able(counts[j]):
                for k in near[j]:
                    votes[k] -= lost
    return picks


def _block_picks(state: DataFrame, adj: DataFrame, voted: DataFrame) -> DataFrame:
    """(node, votes) of what blocks of consecutive nodes can pick on their own; a block has BLOCK_TIES ties at most, nodes of more belong to none."""
    ties = state.join(adj.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("k")), "node", "left").select("node", "graph", F.coalesce("k", F.lit(0)).cast("long").alias("k"))
    held = before(ties.where(F.col("k") <= BLOCK_TIES // 2), ["graph", "node"], "at", F.col("k") + 1)
    of = materialise(held.select("node", "graph", F.floor(F.col("at") / (BLOCK_TIES // 2)).alias("block"), "k"), "blocks")
    u = of.select(F.col("node").alias("u"), F.col("block").alias("bu"), F.col("graph").alias("gu"))
    v = of.select(F.col("node").alias("v"), F.col("block").alias("bv"))
    arcs = materialise(adj.join(u, "u", "left").join(v, "v", "left").where("bu is not null"), "arcs")  # from nodes of blocks
    outer = lambda out: out.select(F.col("u").alias("node")).distinct()
    first = materialise(outer(arcs.where("not (bu <=> bv)")), "outer")  # a neighbour is elsewhere
    second = outer(arcs.join(first.withColumnRenamed("node", "v"), "v", "left_semi"))
    far = first.union(second).distinct().withColumn("far", F.lit(True))
    nodes = of.join(voted.select("node", "c", "n", "e2", F.col("own.votes").alias("votes")), "node").join(far, "node", "left")
    rows = nodes.select("graph", "block", "node", F.lit(None).cast("long").alias("to"), "c", "n", "e2", "votes", F.coalesce("far", F.lit(False)).alias("far"))
    none = [F.lit(None).cast("long").alias(c) for c in ("c", "n", "e2", "votes")]
    inside = arcs.where("bu = bv").select(F.col("gu").alias("graph"), F.col("bu").alias("block"), F.col("u").alias("node"), F.col("v").alias("to"), *none, F.lit(False).alias("far"))

    def settle(table: pa.Table) -> pa.Table:
        is_node = pc.is_null(table.column("to"))
        own, ties = table.filter(is_node).sort_by("node"), table.filter(pc.invert(is_node))
        ids = own.column("node").to_numpy()
        heads, tails = (np.searchsorted(ids, ties.column(c).to_numpy()).tolist() for c in ("node", "to"))
        lists = [own.column(c).to_pylist() for c in ("c", "votes")]
        inner = [not x for x in own.column("far").to_pylist()]
        picks = _settled_in_block(ids.tolist(), own.column("n")[0].as_py(), own.column("e2")[0].as_py(), *lists, inner, heads, tails)
        return pa.table({"node": pa.array([int(ids[i]) for i, _ in picks], pa.int64()), "votes": pa.array([v for _, v in picks], pa.int64())})

    return rows.union(inside).groupBy("graph", "block").applyInArrow(settle, "node long, votes long")


#: Blocks cost about as much as so many rounds over the whole graph; if they settle less, they are left out for some rounds, up to so many.
WORTH, MOST_PAUSE = 2, 16


def vote_rank(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, graph, rank, votes, score = N - rank + 1) of every node by VoteRank; ties to the smaller id.

    nodes: (node, graph) if edges are the disjoint union of several networks, which are then ranked each by its own N and 2 E, all in the
    same rounds; one network (graph 0) if None. Nodes without ties come last.

    A node's ability is max(0, 1 - c / <k>) after c of its neighbours were picked, 0 once it is picked. Times 2 E
    that is the integer max(0, 2 E - c N), so ties are exact. Votes only fall, and a pick changes them up to two ties
    away; so a node with more votes than all that near is picked before them, with the votes it has, and the order of picks is that of
    their votes. A round takes all such nodes twice: first blocks of consecutive ids settle what depends on nodes of the block alone,
    in a task each, however long the chains of nodes that wait for each other (a network of fewer than BLOCK_TIES / 2 ties is done
    then); what is left is compared over the whole graph. Where blocks settle little, as with ties between all of them, some rounds go without. So rounds grow with how often a chain changes its block, not with its length.
    """
    own = degrees(edges).select("node", F.lit(0).cast("long").alias("graph")) if nodes is None else nodes.select("node", "graph")
    k = own.join(degrees(edges), "node", "left").select("node", "graph", F.coalesce("k", F.lit(0)).cast("long").alias("k"))
    sizes = k.groupBy("graph").agg(F.count("*").alias("n"), F.sum("k").alias("e2"))
    live, states, picks = Rounds(3), Rounds(3), []
    adj = live.write(adjacency(edges), "adjacency")
    state = states.write(k.join(sizes, "graph").select("node", "graph", "n", "e2", F.lit(0).cast("long").alias("c")), "abilities")
    ability = F.greatest(F.lit(0).cast("long"), F.col("e2") - F.col("c") * F.col("n"))
    sized = state.select("node", "graph", "n")

    def take(picked: DataFrame) -> None:
        """Removes the picked nodes and lowers what their neighbours can give."""
        nonlocal state, adj
        picks.append(picked)
        gone = picked.select(F.col("node").alias("v"))
        hit = adj.join(gone, "v").groupBy("u").agg(F.count("*").alias("hits"))
        left = state.join(picked, "node", "left_anti")
        state = states.write(left.join(hit, F.col("node") == F.col("u"), "left").select("node", "graph", "n", "e2", (F.col("c") + F.coalesce("hits", F.lit(0))).alias("c")), "abilities")
        adj = live.write(adj.join(gone, "v", "left_anti").join(gone.withColumnRenamed("v", "u"), "u", "left_anti").select("u", "v"), "adjacency")

    def votes() -> DataFrame:
        able = state.select(F.col("node").alias("v"), ability.alias("ability"))
        given = adj.join(able, "v").groupBy("u").agg(F.sum("ability").alias("votes"))
        mine = F.struct(F.coalesce("votes", F.lit(0)).alias("votes"), (-F.col("node")).alias("id")).alias("own")
        return materialise(state.join(given, F.col("node") == F.col("u"), "left").select("node", "graph", "n", "e2", "c", mine), "votes")

    sized = materialise(sized, "sized")
    left, by_blocks, pause, wait = sized.count(), 0, 1, 0

    def settled() -> int:
        nonlocal left
        was, left = left, state.count()
        return was - left

    while left:
        if blocks_now := wait == 0:
            take(materialise(_block_picks(state, adj, votes()), "picked"))
            by_blocks = settled()
            if not left:
                break
        voted = votes()
        best = voted.select(F.col("node").alias("u"), F.col("own").alias("best"))
        for _ in range(2):  # the best of the neighbourhood, and of its neighbourhoods
            around = adj.join(best.withColumnRenamed("u", "v"), "v").select("u", "best").union(best)
            best = around.groupBy("u").agg(F.max("best").alias("best"))
        take(materialise(voted.join(best, F.col("node") == F.col("u")).where("own = best").select("node", F.col("own.votes").alias("votes")), "picked"))
        by_round = settled()
        if not blocks_now:
            wait -= 1
        elif by_blocks >= WORTH * by_round:
            pause = 1
        else:
            wait, pause = pause, min(2 * pause, MOST_PAUSE)
    if not picks:
        return sized.select("node", "graph", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("votes"), F.lit(0.0).alias("score"))
    every = reduce(DataFrame.union, picks).join(sized, "node").withColumn("less", -F.col("votes"))
    order = place_within(every, ["graph"], ["less", "node"], "before")
    return order.select("node", "graph", (F.col("before") + 1).cast("int").alias("rank"), "votes", (F.col("n") - F.col("before")).cast("double").alias("score"))


def vote_ties(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(graph, steps, tied): in how many steps of VoteRank (its order, from vote_rank) another node had as many votes as the one picked.

    Picks of equal votes follow each other, so all but the last of them were tied with the next. The last was tied if its own pick took
    votes from a node that had as many; votes are replayed from the order: a neighbour's ability falls with each pick beside it, to nothing
    when it is picked itself, so each node passes on a number of events that grows with the mean degree, not with its own.
    """
    adj = adjacency(edges)
    sizes = order.join(degrees(edges), "node", "left").groupBy("graph").agg(F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("e2"))
    placed = materialise(order.select("node", "graph", "rank", "votes").join(sizes, "graph"), "order")
    last = placed.groupBy("graph", "votes").agg(F.max("rank").alias("rank"))
    rank_of = placed.select(F.col("node").alias("v"), F.col("rank").alias("rv"))
    beside = adj.join(rank_of, "v").join(placed.select(F.col("node").alias("u"), "n", "e2", "rank"), "u").where("rv < rank")
    nth = F.row_number().over(Window.partitionBy("u").orderBy("rv"))
    ability = lambda c: F.greatest(F.lit(0).cast("long"), F.col("e2") - c * F.col("n"))
    beside = beside.withColumn("nth", nth).withColumn("lost", ability(F.col("nth") - 1) - ability(F.col("nth"))).where("lost > 0")
    used = beside.groupBy("u").agg(F.sum("lost").alias("used"))
    falls = beside.select(F.col("u").alias("z"), F.col("rv").alias("at"), "lost")
    ends = placed.join(used, placed["node"] == used["u"], "left").select(F.col("node").alias("z"), F.col("rank").alias("at"), (F.col("e2") - F.coalesce("used", F.lit(0))).alias("lost"))
    events = materialise(falls.union(ends.where("lost > 0")), "events")
    heard = adj.select(F.col("u").alias("node"), F.col("v").alias("z")).join(events, "z").groupBy("node", "at").agg(F.sum("lost").alias("lost"))
    start = placed.join(degrees(edges), "node").select("node", "graph", "rank", (F.col("k") * F.col("e2")).alias("full"))
    until = Window.partitionBy("node").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    told = heard.withColumn("fallen", F.coalesce(F.sum("lost").over(until), F.lit(0))).join(start, "node").where("at < rank")
    near = told.select("graph", F.col("at").alias("rank"), (F.col("full") - F.col("fallen")).alias("votes")).join(last, ["graph", "rank", "votes"], "left_semi").select("graph", "rank").distinct()
    alone = last.join(near, ["graph", "rank"], "left_anti").groupBy("graph").agg(F.count("*").alias("alone"))
    return sizes.join(alone, "graph", "left").select("graph", F.col("n").alias("steps"), (F.col("n") - F.coalesce("alone", F.lit(0))).alias("tied"))


def ranked(scores: DataFrame, digits: int | None = 8) -> DataFrame:
    """node, score and rank by score (rounded, unless digits is None) descending, then node; null and NaN scores are left out."""
    value = F.round("score", digits) if digits is not None else F.col("score")
    rows = scores.where(F.col("score").isNotNull() & ~F.isnan("score")).withColumn("key", -value)
    return before(rows, ["key", "node"], "before").select("node", "score", (F.col("before") + 1).alias("rank"))


def seed_count(n: int, percent: int, rule: str = "floor1") -> int:
    """Seeds for a percentage of n nodes: floor and at least 1, ceiling and at least 2, or ceiling and at least 1."""
    if rule == "floor1":
        return max(1, n * percent // 100)
    up = -(-n * percent // 100)
    return min(n, max(2 if rule == "ceil2" else 1, up))


def seeds_of(n: Column, percent: Column, rule: str = "floor1") -> Column:
    """The same for columns."""
    if rule == "floor1":
        return F.greatest(F.lit(1).cast("long"), F.floor(n * percent / 100))
    return F.least(n, F.greatest(F.lit(2 if rule == "ceil2" else 1).cast("long"), F.ceil(n * percent / 100)))


def ratio_window(n: int, length: int = 10) -> list[int]:
    """Ten whole percentages in a row, from the first that gives two seeds; raises ValueError if they pass 100."""
    if n < 2:
        raise ValueError("a graph of fewer than two nodes has no pairs of seeds")
    first = next(p for p in range(1, 101) if n * p // 100 >= 2)
    if first + length - 1 > 100:
        raise ValueError(f"{length} percentages from {first} pass 100")
    return list(range(first, first + length))


def set_differences(one: DataFrame, two: DataFrame, sizes: list[int]) -> DataFrame:
    """(k, n_changed) for the first k nodes of two rankings (node, rank): half their symmetric difference."""
    both = one.select("node", F.col("rank").alias("r1")).join(two.select("node", F.col("rank").alias("r2")), "node", "full")
    k = F.explode(F.array(*[F.lit(s) for s in sizes])).alias("k")
    first, second = F.coalesce(F.col("r1") <= F.col("k"), F.lit(False)), F.coalesce(F.col("r2") <= F.col("k"), F.lit(False))
    return both.select("r1", "r2", k).groupBy("k").agg(F.floor(F.count_if(first != second) / 2).alias("n_changed"))
