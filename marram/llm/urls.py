"""URL filter: rules are indexed by their rarest literal token; only candidate rules run.

DataFrame functions only. The index is a constant of the plan, an array of buckets by the token's CRC, so a URL looks its tokens
up where it is read: nothing is joined, shuffled or regrouped.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.sources.shared import pick

#: So many tokens of rules go into the plan as a constant; longer lists are joined by a shuffle. The results are the same.
INDEXED_TOKENS = 50_000
_ENTRY = "token string, rule string, rule_host string, rule_path string, pattern string, rule_verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class SiteRule:
    """Fits a host and its subdomains where the path starts with the rule's path; the longest rule wins."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every URL the rule fits must hold: the last of the path only where it is closed."""
        closed = self.path.rpartition("/")[0]
        return [t for t in re.split("[^a-z0-9]+", f"{self.host}/{closed}".lower()) if t]


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the whole URL, with literal tokens that every match must hold."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str = "block"


#: Used where no site rule fits: pages that repeat others under tracking or session parameters, and log-in forms.
PATTERNS = (
    PatternRule("tracking", "[?&]utm_source=", ("utm", "source")),
    PatternRule("session", "[?&]sessionid=", ("sessionid",)),
    PatternRule("login", "/login(?:[.]php)?(?:[/?#]|$)", ("login",)),
    PatternRule("adult", "(?:[/.-])xxx(?:[/.-])", ("xxx",)),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first :// up to / ? # or the end, and the path up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    part = lambda k: F.coalesce(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def judge(pages: DataFrame, sites: list[SiteRule], patterns: tuple[PatternRule, ...] = PATTERNS, default: str = "allow", indexed_tokens: int = INDEXED_TOKENS) -> DataFrame:
    """Returns page_id, host, path, rule and verdict for every row.

    rule is the longest site rule that fits (of equally long ones the smallest), else null. verdict
    is the rule's, else block if a pattern matches, else the default. A null url, or one without ://,
    has an empty host and path; a null one gets the default verdict. Null ids are kept, repeated rows
    give repeated results, an empty table gives an empty result, very long URLs are judged whole, other columns are
    ignored, whatever their names, and an empty rule list leaves the default. Rules without a token are tried on every URL.
    """
    listed = {(s.rule, s.host, s.path, None, s.verdict): s.tokens or [""] for s in sites} | {(p.name, None, None, p.pattern, p.verdict): p.tokens or ("",) for p in patterns}
    urls = pick(pages, page_id="long", url="string")
    host, path = host_and_path(F.col("url"))
    urls = urls.withColumn("host", host).withColumn("path", path)
    tokens = F.array_distinct(F.split(F.translate(F.coalesce("url", F.lit("")), UPPER, LOWER), "[^a-z0-9]+"))
    if any("" in of for of in listed.values()):  # rules without a literal token are candidates for every URL
        tokens = F.array_union(tokens, F.array(F.lit("")))
    small = sum(map(len, listed.values())) <= indexed_tokens
    judged = (_looked_up if small else _joined)(urls, tokens, listed)
    verdict = F.coalesce("best.rule_verdict", "matched.rule_verdict", F.lit(default))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), F.col("matched.rule").alias("pattern"))


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | host.endswith(F.concat(F.lit("."), rule_host))) & path.startswith(rule_path)


def _looked_up(urls: DataFrame, tokens: Column, listed: dict) -> DataFrame:
    """page_id, host, path, best and matched: one narrow pass counts the rules' tokens in the table, one judges each URL where it is read."""
    used = urls.sparkSession.createDataFrame([(t,) for t in sorted({t for of in listed.values() for t in of})], "token string")
    seen = urls.select(F.explode(tokens).alias("token")).join(F.broadcast(used), "token").groupBy("token").agg(F.count("*").alias("uses"))
    uses = {r.token: r.uses for r in seen.collect()}  # a row a token of the rules at most
    buckets: list[list[dict]] = [[] for _ in range(max(1, len(listed)))]
    names = [field.split()[0] for field in _ENTRY.split(", ")]
    for rule, of in listed.items():
        token = min(of, key=lambda t: (uses.get(t, 0), t))
        buckets[zlib.crc32(token.encode()) % len(buckets)].append(dict(zip(names, (token, *rule), strict=True)))
    index = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<{_ENTRY.replace(' string', ': string')}>>>")  # folded to a constant

    near = F.transform(tokens, lambda t: F.filter(F.get(index, (F.crc32(t) % len(buckets)).cast("int")), lambda e: e["token"] == t))
    found = urls.withColumn("candidates", F.flatten(near))
    site = F.filter("candidates", lambda e: e["pattern"].isNull() & _fits(F.col("host"), F.col("path"), e["rule_host"], e["rule_path"]))
    best = F.array_min(F.transform(site, lambda e: F.struct((-F.length(e["rule"])).alias("order"), e["rule"].alias("rule"), e["rule_verdict"].alias("rule_verdict"))))
    hit = F.filter("candidates", lambda e: e["pattern"].isNotNull() & F.rlike(F.col("url"), e["pattern"]))
    matched = F.array_min(F.transform(hit, lambda e: F.struct(e["rule"].alias("rule"), e["rule_verdict"].alias("rule_verdict"))))
    return found.select("page_id", "host", "path", best.alias("best"), matched.alias("matched"))


def _joined(urls: DataFrame, tokens: Column, listed: dict) -> DataFrame:
    """The same for rule lists of any length, by a join on tokens and a grouping of each URL's candidates."""
    rows = [(t, *rule) for rule, of in listed.items() for t in of]
    tokens_of_rules = urls.sparkSession.createDataFrame(rows, _ENTRY)
    by_token = urls.withColumn("row", F.monotonically_increasing_id()).withColumn("token", F.explode(tokens))
    seen = by_token.select("token").join(tokens_of_rules.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("uses"))
    rarest = tokens_of_rules.join(seen, "token", "left")
    index = rarest.groupBy("rule", "rule_host", "rule_path", "pattern", "rule_verdict").agg(F.min_by("token", F.struct(F.coalesce("uses", F.lit(0)), "token")).alias("token"))

    # Where a token is in most URLs, adaptive execution splits that token's URLs.
    tried = by_token.join(index, "token", "left")
    site = F.col("pattern").isNull() & _fits(F.col("host"), F.col("path"), F.col("rule_host"), F.col("rule_path"))
    hit = F.expr("pattern is not null and url rlike pattern")
    best = F.when(site, F.struct((-F.length("rule")).alias("order"), "rule", "rule_verdict"))
    return tried.groupBy("row", "page_id", "host", "path").agg(F.min(best).alias("best"), F.min(F.when(hit, F.struct("rule", "rule_verdict"))).alias("matched"))
