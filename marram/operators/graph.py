"""Undirected simple graphs as DataFrames: edges (u, v) with u < v; adjacency (u, v) both ways; degrees (node, k)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.operators.components import connected_components
from marram.operators.order import before
from marram.sources.shared import materialise


def simple_edges(pairs: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Symmetrises, drops loops and null ends, and collapses parallel edges."""
    ends = pairs.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    return ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def adjacency(edges: DataFrame, *carry: str) -> DataFrame:
    return edges.select("u", "v", *carry).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *carry))


def degrees(edges: DataFrame) -> DataFrame:
    """Both ends of each edge in one pass, so that counts combine before the shuffle."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("k"))


def component_sizes(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) and the component's size."""
    member = connected_components(edges, "u", "v")
    return member.join(member.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "component", "size")


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the largest component; of equally large ones, that with the smallest node."""
    member = connected_components(edges, "u", "v")
    sizes = member.groupBy("component").agg(F.count("*").alias("size"))
    best = sizes.agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("component"))
    kept = member.join(F.broadcast(best), "component").select(F.col("node").alias("u"))  # one row is broadcast
    return edges.join(kept, "u", "left_semi")


def relabel(edges: DataFrame) -> DataFrame:
    """node and its number from 0 in the order of ids."""
    return before(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), ["node"], "label")


def oriented(edges: DataFrame) -> DataFrame:
    """Edges (a, b) from the end of lower degree to the other (ties by id), with the degree kb of b: no node has more than sqrt(2 E) out-edges."""
    k = degrees(edges)
    both = edges.join(k.select(F.col("node").alias("u"), F.col("k").alias("ku")), "u").join(k.select(F.col("node").alias("v"), F.col("k").alias("kv")), "v")
    up = F.struct("ku", "u") < F.struct("kv", "v")
    return both.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b"), F.greatest("ku", "kv").alias("kb"))


def triangles(edges: DataFrame) -> DataFrame:
    """Each triangle once as (a, b, c) in the order of degrees and ids, found at its tie of the two lower corners.

    What goes along with a tie is the list of its lower end's out-edges, of sqrt(2 E) numbers at most; no pair of neighbours is a row.
    """
    up = oriented(edges).select("a", "b")
    out = materialise(up.groupBy("a").agg(F.collect_list("b").alias("out")), "out")
    near = out.select("a", "out", F.explode("out").alias("b"))
    their = out.select(F.col("a").alias("b"), F.col("out").alias("further"))
    return near.join(their, "b").select("a", "b", F.explode(F.array_intersect("out", "further")).alias("c"))


def clustering(edges: DataFrame) -> DataFrame:
    """node, k, triangles and the local clustering coefficient (zero below degree two)."""
    at = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    t = F.coalesce("triangles", F.lit(0).cast("long"))
    local = F.when(F.col("k") > 1, 2.0 * t / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    return degrees(edges).join(at, "node", "left").select("node", "k", t.alias("triangles"), local.alias("clustering"))


def threshold(k: Column, k2: Column) -> Column:
    """Epidemic threshold of mean degree and mean squared degree; null where it is undefined."""
    return F.when(k2 - k > 0, k / (k2 - k))


def summary(edges: DataFrame) -> DataFrame:
    """One row: sizes, degrees, threshold, density, clustering and transitivity."""
    return summarised(clustering(edges), [])


def summarised(local: DataFrame, by: list[str]) -> DataFrame:
    """The same in groups of nodes, from their (by..., k, triangles, clustering); a group is a whole graph."""
    n, k = F.col("n_nodes"), F.col("mean_degree")
    row = local.groupBy(*by).agg(
        F.count("*").alias("n_nodes"),
        (F.sum("k") / 2).cast("long").alias("n_edges"),
        F.max("k").alias("max_degree"),
        F.avg("k").alias("mean_degree"),
        F.avg(F.col("k") * F.col("k")).alias("second_moment"),
        F.avg("clustering").alias("clustering"),
        (F.sum("triangles") / 3).cast("long").alias("n_triangles"),
        F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("wedges"),
    )
    density = F.when(n > 1, 2.0 * F.col("n_edges") / (n * (n - 1))).otherwise(0.0)
    transitivity = F.when(F.col("wedges") > 0, 3.0 * F.col("n_triangles") / F.col("wedges")).otherwise(0.0)
    return row.select(*by, "n_nodes", "n_edges", "max_degree", "mean_degree", "second_moment", threshold(k, F.col("second_moment")).alias("threshold"), density.alias("density"), "clustering", transitivity.alias("transitivity"), "n_triangles")


def preparation_report(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """What the reduction to the largest component (edges, from largest_component of the pairs) loses; deltas are differences of rounded values.

    Ties and triangles of a node lie within its component, so those of all nodes are made once and serve both sides.
    """
    local = materialise(clustering(materialise(simple_edges(pairs), "edges")), "local")
    own = local.join(degrees(edges).select("node"), "node", "left_semi")
    both = summarised(local, []).select(*prepared_figures("raw")).crossJoin(summarised(own, []).select(*prepared_figures("lcc")))  # one row each
    return both.select(*losses())


_PREPARED = ("n", "e", "kmax", "c", "beta")


def prepared_figures(p: str) -> list[Column]:
    """The figures of a summary that a preparation report compares, under a prefix."""
    columns = ("n_nodes", "n_edges", "max_degree"), (("clustering", 4), ("threshold", 5))
    values = [*map(F.col, columns[0]), *[F.round(c, digits) for c, digits in columns[1]]]
    return [v.alias(f"{p}_{name}") for v, name in zip(values, _PREPARED, strict=True)]


def losses() -> list[Column]:
    """Both sets of figures and what was lost between them, in percent (null of nothing) or as a difference."""
    loss = lambda c: F.round(100.0 * (F.col(f"raw_{c}") - F.col(f"lcc_{c}")) / F.nullif(F.col(f"raw_{c}"), F.lit(0)), 2)
    own = [F.col(f"{p}_{c}") for p in ("raw", "lcc") for c in _PREPARED]
    return [*own, loss("n").alias("node_loss"), loss("e").alias("edge_loss"), F.round(F.abs(F.col("raw_c") - F.col("lcc_c")), 4).alias("delta_c"), F.round(F.abs(F.col("raw_beta") - F.col("lcc_beta")), 5).alias("delta_beta")]
