"""Random graphs as DataFrames, reproducible from hashes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.operators.spread import uniform
from marram.sources.shared import materialise


def erdos_renyi(spark: SparkSession, n: int, mean_degree: float, seed: int = 0) -> DataFrame:
    """Each pair u < v with probability mean_degree / (n - 1): a node skips geometrically from one partner to the next, so only edges are made."""
    p = min(1.0, max(0.0, mean_degree / (n - 1))) if n > 1 else 0.0
    nodes = spark.range(n).withColumnRenamed("id", "u")
    if p == 0.0:
        return nodes.where("false").select("u", F.col("u").alias("v"))
    if p == 1.0:
        return nodes.where(F.col("u") < n - 1).select("u", F.explode(F.sequence(F.col("u") + 1, F.lit(n - 1))).alias("v"))
    # Gaps are drawn for twice the expected partners and more (six deviations); a row that they don't fill is an error.
    most = int(2 * n * p + 12 * (n * p) ** 0.5 + 40)
    gap = 1 + F.floor(F.log(1 - uniform(F.lit(seed), "u", "i")) / math.log1p(-p))
    gaps = nodes.select("u", F.posexplode(F.sequence(F.lit(1), F.lit(most))).alias("i", "j")).select("u", "i", gap.alias("gap"))
    walked = gaps.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("i", "gap"))).alias("gaps"))
    at = F.aggregate("gaps", F.struct(F.col("u").alias("at"), F.array().cast("array<bigint>").alias("out")), lambda s, g: F.struct((s["at"] + g["gap"]).alias("at"), F.when(s["at"] + g["gap"] < n, F.concat(s["out"], F.array(s["at"] + g["gap"]))).otherwise(s["out"]).alias("out")))
    out = F.when(at["at"] < n, F.raise_error(F.lit("too few gaps for a row; choose another seed"))).otherwise(at["out"])
    return walked.select("u", F.explode(out.cast("array<bigint>")).alias("v"))


def _without_conflicts(drawn: DataFrame, redraw: Callable[[DataFrame], DataFrame], fixed: DataFrame | None = None) -> DataFrame:
    """(u, v), u < v, of ties (id, attempt, a, b) in which no two join the same nodes and none is a loop.

    In each round the ties that are loops, or meet a settled tie or one of smaller id, lose, and only these are drawn again (redraw gets them
    with the next attempt), so their number falls from round to round and none is dropped. fixed: ties (u, v) that are settled from the start.
    """
    ends = lambda df: df.select("id", "attempt", "a", "b", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    settled = fixed
    while True:
        tried = materialise(ends(drawn), "drawn")
        best = tried.where("u <> v").groupBy("u", "v").agg(F.min("id").alias("id"))
        if settled is not None:
            best = best.join(settled, ["u", "v"], "left_anti")
        best = materialise(best, "settled")
        settled = best.select("u", "v") if settled is None else settled.union(best.select("u", "v"))
        lost = tried.join(best.select("id"), "id", "left_anti").select("id", F.col("attempt") + 1, "a").toDF("id", "attempt", "a")
        if lost.isEmpty():
            return settled
        drawn = redraw(lost)


def watts_strogatz(spark: SparkSession, n: int, degree: int, rewire: float = 0.3, seed: int = 0) -> DataFrame:
    """A ring in which each node ties to degree / 2 on either side (an odd degree counts as the next even one); each tie's far end moves with probability rewire.

    There are exactly n * degree / 2 ties: an end that falls on the node itself or on a node it is tied to already is drawn again. Raises ValueError if nodes would be tied to half of all
    others or more, where that might not end.
    """
    degree = max(2, degree + degree % 2)
    if degree >= n / 2 and rewire > 0 or degree >= n:
        raise ValueError("too many ties a node")
    ties = spark.range(n).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(degree // 2))).alias("j"))
    rows = ties.select((F.col("a") * (degree // 2) + F.col("j") - 1).alias("id"), "a", ((F.col("a") + F.col("j")) % n).alias("near"), (uniform(F.lit(seed), F.lit("move"), "a", "j") < rewire).alias("moves"))
    stay = materialise(rows.where("not moves").select(F.least("a", "near").alias("u"), F.greatest("a", "near").alias("v")), "ring")
    to = F.floor(uniform(F.lit(seed), F.lit("to"), "id", "attempt") * n).cast("long")
    draw = lambda df: df.select("id", "attempt", "a", to.alias("b"))
    return _without_conflicts(draw(rows.where("moves").select("id", F.lit(0).alias("attempt"), "a")), draw, stay)


def barabasi_albert(spark: SparkSession, n: int, mean_degree: float, seed: int = 0, rounds: int = 64) -> DataFrame:
    """Preferential attachment: after a star of m + 1 nodes each node ties to m different earlier nodes, each an end of an earlier tie drawn uniformly; exactly m * (n - m) ties.

    An end is either the new node of its tie or a copy of an earlier end; following the copies by hashes alone resolves each tie on its own
    (copy model), so nodes need not come one after the other. Targets that a node draws twice are drawn again; copies refer to first draws, which
    shifts the chances only by those few. A chain has a length of one half to the power of its steps; one longer than `rounds` is an error.
    """
    m = min(max(1, round(mean_degree / 2)), max(1, n - 1))
    star = spark.range(1, min(n, m + 1)).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    if n <= m + 1:
        return star
    # Tie t has the ends 2 t (the new node; the centre of the star) and 2 t + 1 (its target; the other node of the star).
    new = lambda t: F.when(t < m, F.lit(0).cast("long")).otherwise(m + 1 + F.floor((t - m) / m)).cast("long")
    earlier = lambda t: 2 * (m + F.floor((t - m) / m).cast("long") * m)  # noqa: E731  ends before those of the tie's new node
    tie = lambda e: F.floor(e / 2).cast("long")
    copies = lambda e: (e % 2 == 1) & (e >= 2 * m)
    draw = lambda e, attempt: F.floor(uniform(F.lit(seed), e, attempt) * earlier(tie(e))).cast("long")

    def drawn(rows: DataFrame) -> DataFrame:
        """The targets of ties (id, attempt): a first draw of their own, then first draws until an end that is no copy."""
        start = draw(2 * F.col("id") + 1, F.col("attempt"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda e, _: F.when(copies(e), draw(e, F.lit(0))).otherwise(e))
        at = rows.select("id", "attempt", end.alias("e"))
        node = F.when(copies(F.col("e")), F.raise_error(F.lit("a chain of copies is longer than rounds")).cast("long")).when(F.col("e") % 2 == 0, new(tie(F.col("e")))).otherwise(tie(F.col("e")) + 1)
        return at.select("id", "attempt", new(F.col("id")).alias("a"), node.alias("b"))

    ties = spark.range(m, m * (n - m)).select("id", F.lit(0).alias("attempt"))
    return _without_conflicts(drawn(ties), drawn, materialise(star, "star"))


GENERATORS = {"er": erdos_renyi, "ba": barabasi_albert, "ws": watts_strogatz}
