"""URL filter: long rule lists against brute force, by the constant index and by the join."""

import random
import re

from pyspark.sql import functions as F

from marram.llm import urls


def brute(url, sites, patterns):
    at = (url or "").find("://")
    host, path = re.match("([^/?#]*)([^?#]*)", url[at + 3 :]).groups() if at >= 0 else ("", "")
    host = host.translate(str.maketrans(urls.UPPER, urls.LOWER))
    fits = [(-len(s.rule), s.rule, s.verdict) for s in sites if (host == s.host or host.endswith("." + s.host)) and path.startswith(s.path)]
    hits = [(p.name, p.verdict) for p in patterns if url is not None and re.search(p.pattern, url)]
    best, hit = min(fits, default=None), min(hits, default=None)
    return host, path, best and best[1], best[2] if best else hit[1] if hit else "allow", hit and hit[0]


def test_thousands_of_rules_both_ways(spark):
    rng = random.Random(11)
    names, tops, parts = [f"n{i}" for i in range(400)], ["com", "org", "co.uk", "é.net"], ["a", "b", "en", "es", "x-y", "", "ü"]
    sites = [urls.SiteRule(f"{rng.choice(['', 'w.'])}{rng.choice(names)}.{rng.choice(tops)}/{'/'.join(rng.choice(parts) for _ in range(rng.randrange(3)))}", rng.choice(["allow", "block"])) for _ in range(3000)]
    sites += [urls.SiteRule("com/", "allow"), urls.SiteRule("é/", "block"), urls.SiteRule("é/ü", "allow")]  # the last two have no token
    patterns = (*urls.PATTERNS, *[urls.PatternRule(f"p{i}", f"[?&]k{i}=[0-9]+", (f"k{i}",), "block") for i in range(500)], urls.PatternRule("dots", "[.]{3}", ()), urls.PatternRule('quo"te\\d', '[?#]q"\\d', ("q",)))

    def url():
        host = f"{rng.choice(['', 'w.', 'V.w.'])}{rng.choice(names).upper()}.{rng.choice(tops)}"
        return f"{rng.choice(['http', 'https'])}://{host}/{'/'.join(rng.choice(parts) for _ in range(rng.randrange(4)))}{rng.choice(['', '?', '#'])}{rng.choice(['', f'&k{rng.randrange(600)}={rng.randrange(9)}', '...', '&utm_source=1', 'q' + chr(34) + '7'])}"

    rows = [(i, url()) for i in range(1500)] + [(9000, None), (9001, ""), (None, "http://é/ü"), (9002, "x.é/ü"), (9003, "://n1.com/" + "a/" * 20000), (9003, "://n1.com/" + "a/" * 20000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as URL", "2 as token", "'x' as candidates").repartition(3)
    want = sorted(((i, *brute(u, sites, patterns)) for i, u in rows), key=str)
    assert {w[4] for w in want} == {"allow", "block"} and sum(w[3] is not None for w in want) > 500 and sum(w[5] is not None for w in want) > 50
    for most in (urls.INDEXED_TOKENS, 0):
        assert sorted((tuple(r) for r in urls.judge(pages, sites, patterns, indexed_tokens=most).collect()), key=str) == want, most


def test_empty_lists_and_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    for most in (urls.INDEXED_TOKENS, 0):
        assert [tuple(r) for r in urls.judge(pages, [], (), "block", most).collect()] == [(1, "a.org", "/", None, "block", None)]
        assert urls.judge(pages.where(F.lit(False)), [urls.SiteRule("org/", "block")], indexed_tokens=most).count() == 0


def test_a_url_is_judged_where_it_is_read(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string").write.parquet(str(tmp_path / "pages"))
    plan = urls.judge(spark.read.parquet(str(tmp_path / "pages")), [urls.SiteRule("org/", "block")])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan
