import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from marram.functions.special import t_quantile_value
from marram.operators import statistics as st


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("c", None)], "g string, x double")
    got = {r.g: r for r in st.intervals(df, ["g"], "x").collect()}
    assert got["a"].half_width == pytest.approx(4.302652729911275 * got["a"]["std"] / math.sqrt(3))
    assert (got["b"]["std"], got["b"].half_width, got["c"]["mean"], got["c"].half_width) == (0.0, 0.0, None, None)
    assert t_quantile_value(49) == pytest.approx(2.009575234489209)
    assert t_quantile_value(1) == pytest.approx(12.706204736432095, rel=1e-6)


def brute_p(d):
    d = [x for x in d if x]
    r = [sum(abs(y) < abs(x) for y in d) + (sum(abs(y) == abs(x) for y in d) + 1) / 2 for x in d]
    w = min(sum(a for a, x in zip(r, d) if x > 0), sum(a for a, x in zip(r, d) if x < 0))
    ways = [sum(a for a, s in zip(r, signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    return min(1.0, 2 * sum(x <= w + 1e-12 for x in ways) / len(ways))


def test_wilcoxon(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(8):
        d = [rng.randint(-4, 6) for _ in range(g + 2)]
        rows += [(g, float(x + 1), 1.0) for x in d]
        want[g] = brute_p(d)
    rows += [(100, 1.0, 1.0), (100, 2.0, 2.0)]
    rows += [(200, float(i), 0.0) for i in range(1, 31)]
    got = {r.g: r for r in st.wilcoxon(spark.createDataFrame(rows, "g int, a double, b double"), ["g"], "a", "b").collect()}
    assert {g: got[g].p for g in want} == pytest.approx(want)
    assert (got[100].p, got[100].n, got[100].r_rb) == (1.0, 0, 0.0)
    z = (465 / 2) / math.sqrt(30 * 31 * 61 / 24)
    assert got[200].p == pytest.approx(math.erfc(z / math.sqrt(2))) and got[200].r_rb == 1.0


def test_corrections(spark):
    p = [0.01, 0.04, 0.03, None, 0.2, 0.5]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "f string, i int, p double")
    q = {r.i: r.q for r in st.benjamini_hochberg(df, ["f"], "p", ["i"]).collect()}
    assert q == {0: pytest.approx(0.05), 1: pytest.approx(0.2 / 3), 2: pytest.approx(0.2 / 3), 3: None, 4: pytest.approx(0.25), 5: pytest.approx(0.5)}
    h = {r.i: r.p_holm for r in st.holm(df, ["f"], "p", ["i"]).collect()}
    assert h == {0: pytest.approx(0.05), 1: pytest.approx(0.12), 2: pytest.approx(0.12), 3: None, 4: pytest.approx(0.4), 5: pytest.approx(0.5)}


def test_friedman(spark):
    rows = [(b, t, float(t + b)) for b in range(4) for t in range(3)]
    r = st.friedman(spark.createDataFrame(rows, "b int, t int, x double"), "b", "t", "x").first()
    assert (r.chi2, r.kendall_w) == (pytest.approx(8.0), pytest.approx(1.0)) and r.p == pytest.approx(math.exp(-4))


def test_kendall(spark):
    rng = random.Random(3)
    for n in (2, 3, 50):
        rows = [(float(rng.randint(0, 9)), float(rng.randint(0, 20))) for _ in range(n)] + [(None, 1.0)]
        sign = lambda x: (x > 0) - (x < 0)
        both = [(a, b) for a, b in itertools.combinations(rows[:n], 2)]
        s = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for a, b in both)
        nx, ny = sum(a[0] != b[0] for a, b in both), sum(a[1] != b[1] for a, b in both)
        r = st.kendall(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
        assert r.n == n and r.tau_b == (pytest.approx(s / math.sqrt(nx * ny)) if nx * ny else None)
    flat = st.kendall(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double"), "x", "y").first()
    assert flat.tau_b is None


def test_correlations_and_gains(spark):
    df = spark.createDataFrame([("g", float(i), float(i * i)) for i in range(6)] + [("h", 1.0, 1.0), ("h", 1.0, 2.0), ("h", 1.0, 3.0)], "g string, x double, y double")
    assert {r.g: r.r for r in st.spearman(df, ["g"], "x", "y").collect()} == {"g": pytest.approx(1.0), "h": None}
    r = {r.g: r for r in st.improvements(df, ["g"], "y", "x").collect()}["g"]
    assert (r.gain, r.win_rate) == (pytest.approx(40 / 6), pytest.approx(100 * 4 / 6)) and r.improvement == pytest.approx(100 * 40 / 15)


def test_ties(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, 1.0, 2.0, 3.0, 3.0, 3.0])], "node long, score double")
    r = st.monotonicity(df).first()
    assert (r.n_distinct, r.n_groups, r.n_tied, r.largest) == (3, 2, 5, 3) and r.monotonicity == pytest.approx((1 - 8 / 30) ** 2)
    assert sorted(map(tuple, st.rank_frequencies(df).collect())) == [(1, 3), (4, 1), (5, 2)]
    assert st.monotonicity(df.limit(1)).first()["monotonicity"] == 1.0
    words = [r[0] for r in spark.createDataFrame([(0.05,), (-0.2,), (0.4,), (0.6,), (-0.9,)], "t double").select(st.strength(F.col("t"))).collect()]
    assert words == ["negligible", "weak", "moderate", "strong", "very strong"]


def test_corrected_tests_add_values_in_the_order_of_events(spark, tmp_path):
    """A mean beside a whole number has a fraction of 0 or nearly 1 with the order of its sum; the files of the table must not choose."""
    import math
    from functools import reduce

    from marram.plans.registry import QUERIES

    rng, rows = random.Random(5), []
    user = 0
    while user < 12:  # sums that are whole in one order of addition and not in another
        values = [round(rng.uniform(1, 200), 2) for _ in range(3)]
        values.append(round(4 * math.ceil(sum(values) / 4) - sum(values), 2))
        forward, backward = (reduce(lambda a, b: a + b, v) / 4 for v in (values, values[::-1]))
        if math.floor(forward) != math.floor(backward):
            rows += [(4 * user + i, user, "view", v) for i, v in enumerate(values)]
            user += 1
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    want = {u: round((m - math.floor(m)) * 0.2, 6) for u in range(12) for m in [reduce(lambda a, b: a + b, [v for _, x, _, v in rows if x == u]) / 4]}
    for at, path in ((F.col("event_id"), "up"), (-F.col("event_id"), "down")):
        df.coalesce(1).sortWithinPartitions(at).write.parquet(f"file://{tmp_path}/{path}/events.parquet")
        for name in ("benjamini_hochberg", "holm"):
            assert {r.user_id: r.p for r in QUERIES[name](spark, f"file://{tmp_path}/{path}").collect()} == want


def test_rank_correlation_gathers_no_group(spark):
    rows = [("g" if i % 3 else None, float(i * i % 17), float(i * 7 % 11)) for i in range(200)] + [("g", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")

    def plain(values):
        return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]

    got = st.spearman(df, ["g"], "x", "y")
    for r in got.collect():
        own = [(x, y) for g, x, y in rows if g == r.g and x is not None]
        a, b = plain([x for x, _ in own]), plain([y for _, y in own])
        m = (len(own) + 1) / 2
        dot = lambda p, q: sum((s - m) * (t - m) for s, t in zip(p, q, strict=True))
        assert r.n == len(own) and r.r == pytest.approx(dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString().replace("windowspec", "")
