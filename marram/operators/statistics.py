"""Statistics over tables of observations: intervals, paired tests, corrections, correlations. Groups are column lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.functions.special import chi2_tail, normal_tail, signed_rank_p, t_quantile
from marram.operators.order import before
from marram.sources.shared import materialise


def intervals(df: DataFrame, by: list[str], value: str, *, normal: bool = False) -> DataFrame:
    """n, mean, std (sample) and the half width of the 95 % interval by group; 0 for one value, null without any."""
    x = F.when(~F.isnan(value), F.col(value))
    got = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    quantile = F.lit(1.96) if normal else t_quantile(F.col("n") - 1)
    half = F.when(F.col("n") > 1, quantile * F.col("std") / F.sqrt("n")).when(F.col("n") == 1, 0.0)
    return got.select(*by, "n", "mean", F.when(F.col("n") == 1, 0.0).otherwise(F.col("std")).alias("std"), half.alias("half_width"))


def variation(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Population coefficient of variation in percent; 0 where the mean is not positive."""
    got = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return got.select(*by, F.when(F.col("mean") > 0, 100.0 * F.col("std") / F.col("mean")).otherwise(0.0).alias("cv"))


def average_ranks(df: DataFrame, by: list[str], order: Column) -> Column:
    """Rank within the group, ties sharing their mean rank."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(Window.partitionBy(*by, order)) - 1) / 2


def signed_ranks(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Paired comparison by group: n (non-zero), w_plus, w_minus, rank-biserial correlation, and the tie term of the variance."""
    d = df.select(*by, (F.col(a) - F.col(b)).alias("d")).where("d is not null and not isnan(d)")
    # Differences are rounded so that equal ones tie whatever their last bits.
    d = d.withColumn("d", F.round("d", 12))
    ranked = d.where("d <> 0").withColumn("r", average_ranks(d, by, F.abs("d")))
    ties = ranked.groupBy(*by, F.abs("d").alias("m")).agg(F.count("*").alias("t"))
    tied = ties.groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tied"))
    w = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"))
    groups = d.select(*by).distinct()
    got = groups.join(w, by, "left").join(tied, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    got = got.select(*by, F.coalesce("n", F.lit(0)).alias("n"), zero("w_plus"), zero("w_minus"), F.coalesce("tied", F.lit(0)).alias("tied"))
    total = F.col("w_plus") + F.col("w_minus")
    return got.withColumn("r_rb", F.when(total > 0, (F.col("w_plus") - F.col("w_minus")) / total).otherwise(0.0))


def wilcoxon(df: DataFrame, by: list[str], a: str, b: str, *, exact_up_to: int = 20) -> DataFrame:
    """Two-sided signed-rank test by group, as signed_ranks with p: exact up to so many non-zero differences, else the normal approximation with tie correction; 1 if all differences are zero, 1e-20 at least."""
    got = signed_ranks(df, by, a, b)
    n, w = F.col("n"), F.least("w_plus", "w_minus")
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48
    approximate = 2 * normal_tail((mean - w) / F.sqrt(F.when(var > 0, var)))
    # The exact distribution depends on the ranks, so they go along as doubled integers; there are exact_up_to at most.
    d = df.select(*by, F.round(F.col(a) - F.col(b), 12).alias("d")).where("d is not null and not isnan(d) and d <> 0")
    sizes = got.where(n <= exact_up_to).select(*by)
    few = d.join(sizes, by, "left_semi").withColumn("r2", (2 * average_ranks(d, by, F.abs("d"))).cast("int")).groupBy(*by).agg(F.sort_array(F.collect_list("r2")).alias("ranks"))
    exact = signed_rank_p(F.col("ranks"), (2 * w).cast("int"))
    got = got.join(few, by, "left")
    p = F.when(n == 0, 1.0).when(n <= exact_up_to, exact).otherwise(approximate)
    return got.select(*by, "n", "w_plus", "w_minus", "r_rb", F.greatest(F.lit(1e-20), F.least(F.lit(1.0), p)).alias("p"))


def benjamini_hochberg(df: DataFrame, family: list[str], p: str = "p", order: list[str] | None = None) -> DataFrame:
    """Adds q within each family; null p stays null. order breaks ties of p (they get equal q in any order)."""
    known = F.col(p).isNotNull() & ~F.isnan(p)
    whole = Window.partitionBy(*family, known)
    up = whole.orderBy(F.col(p), *(order or []))
    m, rank = F.count("*").over(whole), F.row_number().over(up)
    stepped = df.withColumn("__raw", F.when(known, F.col(p) * m / rank)).withColumn("__rank", rank)
    back = Window.partitionBy(*family, known).orderBy("__rank").rowsBetween(0, Window.unboundedFollowing)
    return stepped.withColumn("q", F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min("__raw").over(back))))).drop("__raw", "__rank")


def holm(df: DataFrame, family: list[str], p: str = "p", order: list[str] | None = None) -> DataFrame:
    """Adds the step-down adjusted p within each family; null p stays null."""
    known = F.col(p).isNotNull() & ~F.isnan(p)
    whole = Window.partitionBy(*family, known)
    up = whole.orderBy(F.col(p), *(order or []))
    stepped = df.withColumn("__rank", F.row_number().over(up)).withColumn("__raw", F.when(known, F.col(p) * (F.count("*").over(whole) - F.col("__rank") + 1)))
    upto = whole.orderBy("__rank").rowsBetween(Window.unboundedPreceding, 0)
    return stepped.withColumn("p_holm", F.when(known, F.least(F.lit(1.0), F.max("__raw").over(upto)))).drop("__raw", "__rank")


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """One row: blocks, treatments, chi-square with tie correction, p, and Kendall's W."""
    ranked = df.withColumn("r", average_ranks(df, [block], F.col(value)))
    ties = df.groupBy(block, value).agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tied"))
    sums = ranked.groupBy(treatment).agg(F.sum("r").alias("r"), F.count("*").alias("n")).agg(F.sum(F.col("r") * F.col("r")).alias("ss"), F.count("*").alias("k"), F.max("n").alias("n"))
    n, k = F.col("n"), F.col("k")
    correction = 1 - F.col("tied") / (n * (k * k * k - k))
    chi2 = (12.0 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)) / F.when(correction > 0, correction)
    got = sums.crossJoin(ties).select("n", "k", chi2.alias("chi2"))  # one row each
    return got.select(F.col("n").alias("n_blocks"), F.col("k").alias("n_treatments"), "chi2", chi2_tail(F.col("chi2"), F.col("k") - 1).alias("p"), (F.col("chi2") / (F.col("n") * (F.col("k") - 1))).alias("kendall_w"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, tau_b with ties; null if a column is constant or n < 2.

    Values are numbered in order. Two numbers part at one highest bit; rows are counted by the higher bits
    of both numbers and their sides of the parting bits, for each pair of bits, so that concordant and
    discordant pairs are products of counts and no two rows are ever paired.
    """
    cells = df.where(f"{x} is not null and {y} is not null and not isnan({x}) and not isnan({y})").groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c"))
    cells = materialise(cells, "cells")
    choose = lambda c: F.col(c) * (F.col(c) - 1) / 2
    ties = lambda c, name: cells.groupBy(c).agg(F.sum("c").alias("m")).agg(F.sum(choose("m")).alias(name), F.count("*").alias(f"n{name}"))
    row = cells.agg(F.sum("c").alias("n")).crossJoin(ties("x", "tx")).crossJoin(ties("y", "ty"))  # one row each
    row = materialise(row, "ties")
    kinds = row.first()
    bits = [max(0, (k or 0) - 1).bit_length() for k in (kinds["ntx"], kinds["nty"])]
    place = lambda c: before(cells.select(c).distinct(), [c], f"{c}i")
    grid = cells.join(place("x"), "x").join(place("y"), "y").select("xi", "yi", "c")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if min(bits) == 0:
        return row.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.lit(None).cast("double").alias("tau_b"))
    parted = grid.select("xi", "yi", "c", every(bits[0]).alias("bx")).select("*", every(bits[1]).alias("by"))
    one = F.expr("shiftright(xi, bx) & 1") == F.lit(1)
    two = F.expr("shiftright(yi, by) & 1") == F.lit(1)
    at = lambda a, b: F.sum(F.when((one == a) & (two == b), F.col("c")).otherwise(0)).cast("double")
    square = parted.groupBy("bx", "by", F.expr("shiftright(xi, bx + 1)").alias("px"), F.expr("shiftright(yi, by + 1)").alias("py")).agg(at(False, False).alias("c00"), at(True, True).alias("c11"), at(False, True).alias("c01"), at(True, False).alias("c10"))
    score = square.agg(F.sum(F.col("c00") * F.col("c11") - F.col("c01") * F.col("c10")).alias("s"))
    pairs = choose("n")
    den = (pairs - F.col("tx")) * (pairs - F.col("ty"))
    return row.crossJoin(score).select(F.col("n").cast("long").alias("n"), F.when(den > 0, F.col("s") / F.sqrt(den)).alias("tau_b"))


def pearson(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """n and r by group; null for fewer than three rows or a constant column."""
    got = df.where(f"{x} is not null and {y} is not null").groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("cxy"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    return got.select(*by, "n", F.when((F.col("n") > 2) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("cxy") / (F.col("sx") * F.col("sy"))).alias("r"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """n and r of the ranks by group, as pearson's. Equal pairs are counted first and ranks come from the counts of values, in ranges of their order, so no group is gathered in one task."""
    rows = df.where(f"{x} is not null and {y} is not null").select(F.struct(*by).alias("__by"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    pairs = materialise(rows.groupBy("__by", "__x", "__y").agg(F.count("*").alias("__n")), "pairs")
    totals = pairs.groupBy("__by").agg(F.sum("__n").alias("n"))

    def ranks(c: str) -> DataFrame:
        values = pairs.groupBy("__by", c).agg(F.sum("__n").alias("__m"))
        placed = materialise(before(values, ["__by", c], "__at", F.col("__m")), "placed")
        starts = placed.groupBy("__by").agg(F.min("__at").alias("__start")).join(totals, "__by")
        # Ranks less their mean.
        rank = F.col("__at") - F.col("__start") + (F.col("__m") + 1) / 2 - (F.col("n") + 1) / 2
        return placed.join(starts, "__by").select("__by", c, rank.alias(f"{c}r"))

    both = pairs.join(ranks("__x"), ["__by", "__x"]).join(ranks("__y"), ["__by", "__y"])
    total = lambda a, b: F.sum(F.col("__n") * F.col(a) * F.col(b))
    got = both.groupBy("__by").agg(F.sum("__n").alias("n"), total("__xr", "__yr").alias("cxy"), total("__xr", "__xr").alias("sx"), total("__yr", "__yr").alias("sy"))
    return got.select("__by.*", "n", F.when((F.col("n") > 2) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("cxy") / F.sqrt(F.col("sx") * F.col("sy"))).alias("r"))


def improvements(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """By group: mean gain, improvement in percent of b's mean, paired effect size d_z and win rate in percent."""
    d = F.col(a) - F.col(b)
    got = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("gain"), F.avg(b).alias("base"), F.stddev_samp(d).alias("sd"), F.avg(F.when(d > 0, 1.0).otherwise(0.0)).alias("wins"))
    return got.select(*by, "n", "gain", F.when(F.col("base") > 0, 100.0 * F.col("gain") / F.col("base")).alias("improvement"), F.when(F.col("sd") > 0, F.col("gain") / F.col("sd")).alias("d_z"), (100.0 * F.col("wins")).alias("win_rate"))


def monotonicity(scores: DataFrame, digits: int = 10, by: list[str] | None = None) -> DataFrame:
    """One row, or one for each group of by: distinct scores, tie groups, tied nodes, largest group, and monotonicity (1 - sum n (n - 1) / (N (N - 1))) squared."""
    by = by or []
    groups = scores.where("score is not null and not isnan(score)").groupBy(*by, F.round("score", digits).alias("s")).agg(F.count("*").alias("n"))
    c = F.col("n")
    got = groups.groupBy(*by).agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_distinct"), F.count_if(c > 1).alias("n_groups"), F.sum(F.when(c > 1, c).otherwise(0)).alias("n_tied"), F.max("n").alias("largest"), F.sum(c * (c - 1)).alias("same"))
    n = F.col("n_nodes")
    m = F.when(n > 1, F.pow(1 - F.col("same") / (n * (n - 1)), F.lit(2.0))).when(n == 1, 1.0)
    return got.select(*by, "n_nodes", "n_distinct", "n_groups", "n_tied", "largest", m.alias("monotonicity"))


def rank_frequencies(scores: DataFrame, digits: int = 8) -> DataFrame:
    """rank (1, 1 + n1, ...) and number of nodes of each group of equal scores."""
    groups = scores.where("score is not null and not isnan(score)").groupBy((-F.round("score", digits)).alias("key")).agg(F.count("*").alias("n"))
    return before(groups, ["key"], "before", F.col("n")).select((1 + F.col("before")).alias("rank"), "n")


def strength(tau: Column) -> Column:
    """A word for the size of a correlation."""
    t = F.abs(tau)
    return F.when(t < 0.1, "negligible").when(t < 0.3, "weak").when(t < 0.5, "moderate").when(t < 0.7, "strong").otherwise("very strong")


def correlation_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """By group: count, mean, median, extremes, mean size and the number of at least moderate values; nulls and NaN are left out."""
    x = F.col(value)
    return (
        df.where(x.isNotNull() & ~F.isnan(value))
        .groupBy(*by)
        .agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(F.abs(x)).alias("mean_size"), F.count_if(F.abs(x) >= 0.5).alias("n_moderate"))
    )


def group_summary(df: DataFrame, by: list[str], value: str, significant: Column) -> DataFrame:
    """By group: count, mean and median of a value, and how many rows are significant."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.count_if(significant).alias("n_significant"))


def pivoted(df: DataFrame, rows: list[str], column: str, value: str, order: list[str], mean: bool = False) -> DataFrame:
    """A wide table with one column per listed value of a column, in that order, and optionally the mean across them."""
    wide = df.groupBy(*rows).pivot(column, order).agg(F.first(value))
    if not mean:
        return wide
    filled = [F.when(F.col(f"`{c}`").isNotNull(), 1).otherwise(0) for c in order]
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in order[1:]), F.coalesce(F.col(f"`{order[0]}`"), F.lit(0.0)))
    n = sum(filled[1:], filled[0])
    return wide.withColumn("mean", F.when(n > 0, total / n))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Every floating column rounded."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def plus_minus(mean: Column, half_width: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f ± %.{digits}f", mean, half_width)


def p_text(p: Column) -> Column:
    """Small values in scientific form, others with three digits."""
    return F.when(p < 0.001, F.format_string("%.2e", p)).otherwise(F.format_string("%.3f", p))


def star(q: Column, level: float = 0.05) -> Column:
    return F.when(q < level, "*").otherwise("")


def correlation_table(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, n, pearson, spearman, n_log, log_log) of each group and of all rows together (ALL), by falling size of the rank correlation.

    log_log is Pearson's on log10, over the rows where both are positive. Null for fewer than three rows or a constant column. Rows count
    once for their group and once for ALL, so that both come from one pass; nulls take no part.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.explode(F.array(F.col(by).cast("string"), F.lit("ALL"))).alias("__of"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    positive = (F.col("x") > 0) & (F.col("y") > 0)
    logs = rows.select("__of", F.when(positive, F.log10("x")).alias("lx"), F.when(positive, F.log10("y")).alias("ly"))
    straight = pearson(rows, ["__of"], "x", "y").select("__of", "n", F.col("r").alias("pearson"))
    table = straight.join(spearman(rows, ["__of"], "x", "y").select("__of", F.col("r").alias("spearman")), "__of")
    table = table.join(pearson(logs, ["__of"], "lx", "ly").select("__of", F.col("n").alias("n_log"), F.col("r").alias("log_log")), "__of", "left")
    out = table.select(F.col("__of").alias(by), "n", "pearson", "spearman", F.coalesce("n_log", F.lit(0)).cast("long").alias("n_log"), "log_log")
    return out.orderBy(F.abs("spearman").desc_nulls_last(), by)


def frequency_summary(groups: DataFrame, by: list[str]) -> DataFrame:
    """From the sizes n of groups of equal scores: groups, largest and mean size, tied groups (of two or more) and tied nodes."""
    n = F.col("n")
    return groups.groupBy(*by).agg(F.count("*").alias("n_groups"), F.max(n).alias("largest"), F.avg(n).alias("mean_size"), F.count_if(n > 1).alias("n_tied_groups"), F.sum(F.when(n > 1, n).otherwise(0)).cast("long").alias("n_tied"))


def large_gains(df: DataFrame, by: list[str], a: str, b: str, least: float = 5.0) -> DataFrame:
    """Rows in which a is more than so many percent above b, with the gain, the largest first; rows without a positive b have no gain."""
    gain = F.when(F.col(b) > 0, 100.0 * (F.col(a) - F.col(b)) / F.col(b))
    return df.withColumn("gain", gain).where(F.col("gain") > least).orderBy(F.desc("gain"), *by)
