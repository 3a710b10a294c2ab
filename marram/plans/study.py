"""Studies of rankings: spreading from their seeds, dispersion, ties, controls and run time.

Scores come as (method, node, score). Every study returns tables; sizes of plans (methods, percentages,
blocks) are parameters, and everything that grows with the graph stays in Spark.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marram.operators import collection, controls, graph, paths, ranking, spread, statistics
from marram.operators.order import place_within
from marram.sources.shared import materialise


def rank_methods(scores: DataFrame, digits: int | None = 8) -> DataFrame:
    """(method, node, score, rank) for each method of the table, all in one pass; null and NaN scores are left out."""
    return materialise(collection.rank_all(scores.withColumn("graph", F.lit(0)), digits).select("method", "node", "score", "rank"), "ranks")


def _set_id(*parts: str) -> Column:
    """One text for a seed set, whatever characters the names of its parts hold."""
    return F.to_json(F.struct(*parts))


def _of_set(part: str) -> Column:
    return F.get_json_object("set_id", f"$.{part}")


def seed_sets(ranks: DataFrame, n: int, percents: list[int], rule: str = "floor1") -> DataFrame:
    """(method, percent, set_id, node): the first nodes of each ranking."""
    counts = ranks.sparkSession.createDataFrame([(p, ranking.seed_count(n, p, rule)) for p in percents], "percent int, seeds long")
    return ranks.join(F.broadcast(counts), F.col("rank") <= F.col("seeds")).select("method", "percent", _set_id("method", "percent").alias("set_id"), "node")


def spreading_rate(edges: DataFrame, times: float = 2.5, cap: bool = False) -> float:
    """A multiple of the epidemic threshold."""
    rate = times * (graph.summary(edges).first()["threshold"] or 0.0)
    return min(1.0, rate) if cap else rate


def block_observations(edges: DataFrame, seeds: DataFrame, betas: list[float], blocks: int, repeats: int) -> DataFrame:
    """(set_id, beta, block, percent): shares of infected nodes in percent, averaged over the repeats of a block."""
    plan = spread.runs(edges.sparkSession, blocks, repeats).select("run", F.explode(F.array(*[F.lit(float(b)) for b in betas])).alias("beta"))
    n = graph.degrees(edges).agg(F.count("*").alias("n"))
    return materialise(spread.block_means(spread.infected_counts(edges, seeds, plan), n), "blocks")


def against_best(observed: DataFrame, target: str, by: list[str], order: list[str]) -> DataFrame:
    """Target against the strongest other method in each setting: means, gain, test, effect, and q over the family of all settings.

    observed: by..., method, block, percent. Of equally strong methods the first in `order` is taken.
    """
    place = F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(order) for x in (m, i)]), F.col("method"))
    means = observed.groupBy(*by, "method").agg(F.avg("percent").alias("mean"))
    best = means.where(F.col("method") != target).groupBy(*by).agg(F.max_by("method", F.struct("mean", -F.coalesce(place, F.lit(len(order))))).alias("best"))
    own = observed.where(F.col("method") == target).select(*by, "block", F.col("percent").alias("a"))
    their = observed.join(best, by).where("method = best").select(*by, "block", "best", F.col("percent").alias("b"))
    pairs = materialise(own.join(their, [*by, "block"]), "pairs")
    keys = [*by, "best"]
    tested = statistics.wilcoxon(pairs, keys, "a", "b").join(statistics.improvements(pairs, keys, "a", "b").drop("n"), keys)
    return statistics.benjamini_hochberg(tested, [], "p", keys)


def seed_ratio_study(edges: DataFrame, scores: DataFrame, percents: list[int], *, blocks: int = 50, repeats: int = 20, times: float = 2.5) -> DataFrame:
    """(method, percent, block, spread) for the first nodes of each ranking."""
    seeds = materialise(seed_sets(rank_methods(scores), graph.degrees(edges).count(), percents), "seeds")
    observed = block_observations(edges, seeds, [spreading_rate(edges, times)], blocks, repeats)
    return observed.select(_of_set("method").alias("method"), _of_set("percent").cast("int").alias("percent_seeds"), "block", "percent")


def networks_seed_ratio_study(networks: collection.Collection, ranks: DataFrame, percents: list[int], *, blocks: int = 50, repeats: int = 20, times: float = 2.5) -> DataFrame:
    """(graph, method, percent_seeds, block, percent) for the first nodes of each ranking in each network, at a multiple of the network's own threshold.

    One simulation serves all networks, methods and shares; networks without a threshold have no rows.
    """
    seeds = materialise(collection.seed_sets(networks, ranks, percents), "seeds")
    rates = collection.figures(networks).select("graph", (times * F.col("threshold")).alias("beta")).where("beta is not null")
    plan = materialise(rates.crossJoin(spread.runs(rates.sparkSession, blocks, repeats).select("run")), "rates")  # a row a network and run
    observed = spread.block_means(spread.infected_counts(networks.edges, seeds, plan), networks.sizes())
    return materialise(observed.select("graph", _of_set("method").alias("method"), _of_set("percent").cast("int").alias("percent_seeds"), "block", "percent"), "blocks")


def temporal_study(edges: DataFrame, scores: DataFrame, k: int = 10, *, blocks: int = 50, repeats: int = 20, times: float = 2.5, horizon: int = 50) -> DataFrame:
    """(method, t, mean share of infected nodes in percent, half width of its interval over blocks)."""
    seeds = rank_methods(scores).where(F.col("rank") <= k).select(F.col("method").alias("set_id"), "node")
    plan = spread.runs(edges.sparkSession, blocks, repeats).select("run", F.lit(spreading_rate(edges, times)).alias("beta"))
    n = graph.degrees(edges).count()
    curves = spread.curves(spread.infections(edges, seeds, plan, horizon - 1), horizon)
    by_block = curves.groupBy(F.col("set_id").alias("method"), "t", F.floor(F.col("run") / 1000).alias("block")).agg((100.0 * F.avg("n_infected") / n).alias("percent"))
    return statistics.intervals(by_block, ["method", "t"], "percent")


def zoom_window(curves: DataFrame, width: int) -> DataFrame:
    """The stretch of steps in which methods differ least: the window with the smallest summed standard deviation across methods. One row (t, spread)."""
    at = curves.groupBy("t").agg(F.stddev_pop("mean").alias("sd"))
    w = Window.orderBy("t").rowsBetween(0, width - 1)  # one row per step of the horizon
    return at.withColumn("spread", F.sum("sd").over(w)).withColumn("n", F.count("*").over(w)).where(F.col("n") == width).orderBy("spread", "t").limit(1).select("t", "spread")


def rate_study(edges: DataFrame, scores: DataFrame, betas: list[float], percent: int = 5, *, blocks: int = 50, repeats: int = 20) -> DataFrame:
    """(method, beta, block, percent) over fixed infection rates."""
    seeds = seed_sets(rank_methods(scores), graph.degrees(edges).count(), [percent])
    return block_observations(edges, seeds, betas, blocks, repeats).select(_of_set("method").alias("method"), "beta", "block", "percent")


def recovery_study(edges: DataFrame, scores: DataFrame, gammas: list[float], percent: int = 5, *, blocks: int = 50, repeats: int = 20, times: float = 2.5) -> DataFrame:
    """(method, gamma, block, percent) with the transmissibility held at a multiple of the threshold; rates out of range are left out."""
    t = spreading_rate(edges, times)
    seeds = seed_sets(rank_methods(scores), graph.degrees(edges).count(), [percent])
    plan = spread.runs(edges.sparkSession, blocks, repeats).select("run", F.explode(F.array(*[F.lit(g) for g in gammas])).alias("gamma"))
    plan = plan.withColumn("beta", spread.transmission(F.lit(t), F.col("gamma"))).where("beta is not null")
    n = graph.degrees(edges).count()
    sizes = spread.infected_counts(edges, seeds, plan)
    return sizes.groupBy(_of_set("method").alias("method"), "gamma", F.floor(F.col("run") / 1000).alias("block")).agg((100.0 * F.avg("n_infected") / n).alias("percent"))


def cross_network(observed: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """From (network, method, value): the overall comparison with Kendall's W, and per method mean rank, strict wins and the test against the target with q."""
    means = materialise(observed.groupBy("network", "method").agg(F.avg("value").alias("value")), "means")
    ranked = means.withColumn("rank", statistics.average_ranks(means, ["network"], -F.col("value")))
    top = F.max("value").over(Window.partitionBy("network"))
    first = (F.abs(F.col("value") - top) <= 1e-9 * F.abs(top)) & (F.col("rank") == 1)
    places = ranked.withColumn("first", first).groupBy("method").agg(F.avg("rank").alias("mean_rank"), F.count_if("first").alias("wins"))
    own = means.where(F.col("method") == target).select("network", F.col("value").alias("a"))
    pairs = means.where(F.col("method") != target).join(own, "network").select("method", "a", F.col("value").alias("b"))
    tested = statistics.benjamini_hochberg(statistics.wilcoxon(pairs, ["method"], "a", "b"), [], "p", ["method"])
    return statistics.friedman(means, "network", "method", "value"), places.join(tested, "method", "left")


def tie_table(scores: DataFrame) -> DataFrame:
    """Monotonicity, tie groups and tied nodes of each method."""
    return statistics.monotonicity(scores, by=["method"])


def dispersion_study(edges: DataFrame, ranks: DataFrame, percents: list[int]) -> DataFrame:
    """(method, percent, k, mean_distance, mean_jaccard) of the first nodes of each ranking, from one search for all of them."""
    sets = materialise(seed_sets(ranks, graph.degrees(edges).count(), percents, "ceil2"), "seeds")
    far, near = paths.set_dispersions(edges, sets), paths.set_similarities(edges, sets).drop("k")
    return far.join(near, "set_id").select(_of_set("method").alias("method"), _of_set("percent").cast("int").alias("percent"), "k", "mean_distance", "mean_jaccard")


def networks_dispersion_study(networks: collection.Collection, ranks: DataFrame, percents: list[int]) -> DataFrame:
    """(graph, method, percent, k, mean_distance, mean_jaccard, average, scaled) of the first nodes of each ranking (graph, method, node, rank) in each network.

    One search serves all networks, methods and shares. average is the mean distance over the shares, scaled puts it between the least and the
    largest of the network's methods. A pair out of reach counts as its network's number of nodes.
    """
    sets = materialise(collection.seed_sets(networks, ranks, percents, "ceil2"), "seeds")
    named = sets.select("set_id", "graph", "method", "percent").distinct()
    sizes = named.join(networks.sizes(), "graph").select("set_id", "n")
    far, near = paths.set_dispersions(networks.edges, sets, sizes), paths.set_similarities(networks.edges, sets).drop("k")
    rows = materialise(named.join(far, "set_id").join(near, "set_id").drop("set_id"), "dispersion")
    averages = scaled_axes(rows.groupBy("graph", "method").agg(F.avg("mean_distance").alias("average")), ["graph"], "average")
    return rows.join(averages, ["graph", "method"]).select("graph", "method", "percent", "k", "mean_distance", "mean_jaccard", "average", "scaled")


def leading_nodes(networks: collection.Collection, scores: DataFrame, k: int = 50) -> DataFrame:
    """(graph, method, place, node, score, degree, inside): the first k nodes by unrounded score of each method in each network, by name, with their ties and those to each other.

    Places beyond the ranking are rows of nulls, so every method has k of them. Of equal scores the smaller node comes first.
    """
    first = materialise(collection.rank_all(scores, None).where(F.col("rank") <= k), "leading")
    ends = first.select("graph", "method", "node")
    ties = networks.edges.select("u", "v").union(networks.edges.select("v", "u"))
    near = ends.join(ties, ends["node"] == ties["u"]).select("graph", "method", "node", "v")
    inside = near.join(ends.withColumnRenamed("node", "v"), ["graph", "method", "v"]).groupBy("graph", "method", "node").agg(F.count("*").alias("inside"))
    rows = first.join(graph.degrees(networks.edges), "node").join(inside, ["graph", "method", "node"], "left")
    named = networks.named(rows.drop("graph")).select("graph", "method", F.col("rank").alias("place"), "node", "score", F.col("k").alias("degree"), F.coalesce("inside", F.lit(0)).cast("long").alias("inside"))
    places = scores.select("graph", "method").distinct().select("graph", "method", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("place"))
    return places.join(named, ["graph", "method", "place"], "left").select("graph", "method", "place", "node", "score", "degree", "inside")


def scaled_axes(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds value scaled to [0, 1] within each group; 0.5 where the range is nil."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("scaled", F.when(high - low > 1e-12, (F.col(value) - low) / (high - low)).otherwise(0.5))


def method_runs(spark: SparkSession, methods: list[str], blocks: int, repeats: int, alone: int, beta: float) -> tuple[DataFrame, DataFrame]:
    """Runs (method, run, beta) that no two methods share: those of sets, in blocks, and those of single nodes (from 900,000 on). A method has a million."""
    if blocks > 900 or alone > 100_000:
        raise ValueError("a method has 900 blocks and 100,000 runs of single nodes at most")
    own = spark.createDataFrame([(m, 1_000_000 * i) for i, m in enumerate(sorted(methods))], "method string, first long")
    of = lambda runs: own.crossJoin(runs).select("method", (F.col("first") + F.col("run")).alias("run"), F.lit(beta).alias("beta"))  # noqa: E731  a plan
    single = spark.range(900_000, 900_000 + alone).withColumnRenamed("id", "run")
    return of(spread.runs(spark, blocks, repeats).select("run")), of(single)


def boundary_study(edges: DataFrame, ranks: DataFrame, percent: int, *, draws: int = 10, blocks: int = 10, repeats: int = 10, alone: int = 20, times: float = 2.5, digits: int = 6) -> DataFrame:
    """(method, strategy, draws, mean, cv) where the cut falls inside equal scores: the group's places go by id, by hashed draws, or by what each node infects alone.

    Only the group at the cut is simulated node by node. Runs depend on the method, not on the strategy, so strategies meet the same runs.
    """
    n = graph.degrees(edges).count()
    k = ranking.seed_count(n, percent, "ceil1")
    s = materialise(ranks.withColumn("s", F.round("score", digits)), "rounded")
    groups = s.groupBy("method", "s").agg(F.count("*").alias("size"), (F.min("rank") - 1).alias("before"))
    cut = materialise(groups.where((F.col("before") < k) & (F.col("before") + F.col("size") > k)), "cut")
    sure = s.join(groups, ["method", "s"]).where(F.col("before") + F.col("size") <= k).select("method", "node")
    tied = materialise(s.join(cut, ["method", "s"]).select("method", "node", "before"), "tied")
    methods = [r[0] for r in s.select("method").distinct().collect()]  # a plan
    plan, single = method_runs(edges.sparkSession, methods, blocks, repeats, alone, spreading_rate(edges, times, cap=True))
    strength = spread.single_node_sizes(edges, tied, single)
    # Draw 0 goes by id, draws from 1 on by hash, draw -1 by what nodes infect alone.
    ordered = tied.join(strength, ["method", "node"]).select("*", F.explode(F.sequence(F.lit(-1), F.lit(draws))).alias("draw"))
    key = F.when(F.col("draw") == 0, F.lit(0.0)).when(F.col("draw") < 0, -F.col("score")).otherwise(spread.uniform("draw", "node"))
    placed = place_within(ordered.withColumn("key", key), ["method", "draw"], ["key", "node"], "place")
    taken = placed.where(F.col("before") + F.col("place") < k).select("method", "draw", "node")
    every = cut.select("method", F.explode(F.sequence(F.lit(-1), F.lit(draws))).alias("draw"))
    sets = taken.union(sure.join(every, "method").select("method", "draw", "node"))
    sets = sets.select(_set_id("method", "draw").alias("set_id"), "method", "node")
    size = graph.degrees(edges).agg(F.count("*").alias("n"))
    observed = materialise(spread.block_means(spread.infected_counts(edges, sets, plan), size), "blocks")
    means = observed.groupBy("method", _of_set("draw").cast("int").alias("draw")).agg(F.avg("percent").alias("mean"))
    strategy = F.when(F.col("draw") == 0, "id").when(F.col("draw") < 0, "sir_gt").otherwise("random")
    return means.groupBy("method", strategy.alias("strategy")).agg(F.count("*").alias("draws"), F.avg("mean").alias("mean"), F.when(F.avg("mean") > 0, 100.0 * F.stddev_pop("mean") / F.avg("mean")).otherwise(0.0).alias("cv"))


def control_study(edges: DataFrame, seeds: DataFrame, *, batch: int = 1000, most: int = 10_000, n: int = 10, caliper: float = 0.05, blocks: int = 50, repeats: int = 20, times: float = 2.5) -> DataFrame:
    """The seeds against degree-matched random, most dispersed and doubly matched controls: kind, dispersion, mean gain, p, effect and q."""
    bins = materialise(controls.degree_bins(edges), "bins")
    draws = controls.Draws(bins, seeds)
    sets, seen, following = controls.unique_candidates(draws, min(batch, draws.sets))

    def measure(candidates: DataFrame) -> DataFrame:
        return controls.mean_distances(edges, candidates)

    measured = materialise(measure(sets), "measured")
    target = paths.dispersion(edges, seeds).first()["mean_distance"]
    chosen = {
        "random": controls.random_controls(sets, n).join(measured, "candidate"),
        "dispersed": controls.most_dispersed(measured),
        "doubly_matched": controls.search_controls(draws, measure, target, batch=batch, most=most, n=n, caliper=caliper, first=measured, seen=seen, start=following).select("candidate", "mean_distance"),
    }
    picked = None
    for kind, df in chosen.items():
        row = df.select(F.lit(kind).alias("kind"), "candidate", "mean_distance")
        picked = row if picked is None else picked.union(row)
    picked = materialise(picked, "picked")
    # Candidates beyond the first batch are drawn again by their number.
    numbers = picked.select("candidate").distinct()
    nodes = materialise(draws.take(numbers), "controls")
    every = nodes.select(F.concat(F.lit("c@"), F.col("candidate").cast("string")).alias("set_id"), "node").union(seeds.select(F.lit("target").alias("set_id"), "node"))
    observed = block_observations(edges, every, [spreading_rate(edges, times, cap=True)], blocks, repeats)
    own = observed.where("set_id = 'target'").select("block", F.col("percent").alias("a"))
    of = picked.join(observed.withColumn("candidate", F.get(F.split("set_id", "@"), F.lit(1)).try_cast("long")), "candidate")
    control = of.groupBy("kind", "block").agg(F.avg("percent").alias("b"))
    pairs = materialise(control.join(own, "block"), "pairs")
    tested = statistics.wilcoxon(pairs, ["kind"], "a", "b").join(statistics.improvements(pairs, ["kind"], "a", "b").drop("n"), "kind")
    spreads = picked.groupBy("kind").agg(F.count("*").alias("controls"), F.avg("mean_distance").alias("mean_distance"))
    return statistics.benjamini_hochberg(tested.join(spreads, "kind"), [], "p", ["kind"])


def correlation_study(scores: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(first, second, n, tau_b, strength) for pairs of methods."""
    out = None
    for a, b in pairs:
        x = scores.where(F.col("method") == a).select("node", F.col("score").alias("x"))
        y = scores.where(F.col("method") == b).select("node", F.col("score").alias("y"))
        row = statistics.kendall(x.join(y, "node"), "x", "y").select(F.lit(a).alias("first"), F.lit(b).alias("second"), "n", "tau_b", statistics.strength(F.col("tau_b")).alias("strength"))
        out = row if out is None else out.union(row)
    return out


def ablation_table(observed: DataFrame, full: str) -> DataFrame:
    """From (network, method, percent_seeds, percent): improvement of the full method over each variant by share of seeds: mean, median, std, wins, p, effect and q per share."""
    means = materialise(observed.groupBy("network", "method", "percent_seeds").agg(F.avg("percent").alias("value")), "means")
    own = means.where(F.col("method") == full).select("network", "percent_seeds", F.col("value").alias("a"))
    pairs = materialise(means.where(F.col("method") != full).withColumnRenamed("value", "b").join(own, ["network", "percent_seeds"]), "pairs")
    keys = ["method", "percent_seeds"]
    gain = F.when(F.col("b") > 0, 100.0 * (F.col("a") - F.col("b")) / F.col("b"))
    table = pairs.groupBy(*keys).agg(F.avg(gain).alias("mean"), F.percentile(gain, 0.5).alias("median"), F.stddev_samp(gain).alias("std"), F.count_distinct("network").alias("networks"), F.count_if(F.col("a") > F.col("b")).alias("wins"))
    return statistics.benjamini_hochberg(table.join(statistics.wilcoxon(pairs, keys, "a", "b"), keys), ["percent_seeds"], "p", ["method"])


def timed(name: str, make: Callable[[], DataFrame], repeats: int = 1) -> list[tuple[str, int, float, str]]:
    """(name, repeat, seconds, error) of forcing a result; an error is reported, not raised."""
    rows = []
    for i in range(repeats):
        start, error = time.perf_counter(), ""
        try:
            make().write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001  reported
            error = f"{type(e).__name__}: {e}"
        rows.append((name, i, time.perf_counter() - start, error))
    return rows


def timing_summary(timings: DataFrame, by: list[str], *, per_instance: bool = True) -> DataFrame:
    """From (by..., instance, seconds): instances, mean, std, half width and median; repeats are averaged per instance first, or pooled."""
    rows = timings.groupBy(*by, "instance").agg(F.avg("seconds").alias("seconds")) if per_instance else timings
    medians = rows.groupBy(*by).agg(F.percentile("seconds", 0.5).alias("median"), F.count_distinct("instance").alias("instances"))
    return statistics.intervals(rows, by, "seconds").join(medians, by)
