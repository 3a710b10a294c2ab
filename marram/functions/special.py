"""Tails and quantiles that Spark lacks, as column expressions or Arrow UDFs over result tables."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_tail(z: Column) -> Column:
    """P(Z > z)."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        import math

        return pd.Series([None if pd.isna(x) else math.erfc(x / math.sqrt(2)) / 2 for x in z], dtype="float64")

    return tail(z.cast("double"))


def chi2_tail(x: Column, df: Column) -> Column:
    """P(X > x) with df degrees of freedom: the upper regularised gamma function at (df / 2, x / 2)."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        import math

        def upper(a: float, z: float) -> float:
            if z <= 0:
                return 1.0
            scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
            if z < a + 1:  # the series of the lower function
                term = total = 1 / a
                n = a
                while abs(term) > abs(total) * 1e-16:
                    n += 1
                    term *= z / n
                    total += term
                return 1 - total * scale
            b, c = z + 1 - a, 1e300  # the continued fraction of the upper one
            d = h = 1 / b
            for i in range(1, 10_000):
                an = -i * (i - a)
                b += 2
                d = 1 / (an * d + b)
                c = b + an / c
                h *= d * c
                if abs(d * c - 1) < 1e-16:
                    break
            return scale * h

        return pd.Series([None if pd.isna(a) or pd.isna(b) else upper(b / 2, a / 2) for a, b in zip(x, df, strict=True)])

    return tail(x.cast("double"), df.cast("double"))


@lru_cache(maxsize=1024)
def t_quantile_value(df: int) -> float:
    """The 97.5 % point of Student's t, by bisection on the distribution's finite sum."""
    import math

    def cdf(t: float) -> float:
        theta = math.atan(t / math.sqrt(df))
        if df % 2:
            total, term = theta, math.sin(theta) * math.cos(theta)
            for k in range(3, df + 1, 2):
                total += term
                term *= math.cos(theta) ** 2 * (k - 1) / k
            return 0.5 + total / math.pi
        total = term = 1.0
        for k in range(2, df, 2):
            term *= math.cos(theta) ** 2 * (k - 1) / k
            total += term
        return 0.5 + math.sin(theta) * total / 2

    lo, hi = 0.0, 100.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < 0.975 else (lo, mid)
    return (lo + hi) / 2


def t_quantile(df: Column) -> Column:
    """The 97.5 % point of Student's t; beyond 200 degrees of freedom by Cornish and Fisher's expansion."""
    z = 1.959963984540054
    n = df.cast("double")
    g1, g2, g3 = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    far = z + g1 / n + g2 / (n * n) + g3 / (n * n * n)
    near = F.element_at(F.array(*[F.lit(t_quantile_value(k)) for k in range(1, 201)]), df.cast("int"))
    return F.when((df >= 1) & (df <= 200), near).when(df > 200, far)


def signed_rank_p(ranks: Column, w2: Column) -> Column:
    """Two-sided exact p of a signed-rank statistic (doubled, the smaller one) given the doubled ranks: subset sums over integers."""

    @F.pandas_udf("double")
    def p(ranks: pd.Series, w2: pd.Series) -> pd.Series:
        def one(r, w) -> float | None:
            if r is None or pd.isna(w):
                return None
            ways = [1] + [0] * int(sum(r))
            for x in r:
                for s in range(len(ways) - 1, int(x) - 1, -1):
                    ways[s] += ways[s - int(x)]
            return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2 ** len(r))

        return pd.Series([one(r, w) for r, w in zip(ranks, w2, strict=True)], dtype="float64")

    return p(ranks, w2)
