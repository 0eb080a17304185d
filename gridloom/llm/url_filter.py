"""Operator 2: URL filters [native].

Each rule is a regular expression with the literal tokens that any match must contain. A rule is filed under its
rarest token, by counts over all urls; a url's own tokens fetch the rules filed under them, and only those run
their expressions. Of the fitting path rules the longest wins (ties: the first by name); without one, the verdict
is block if a pattern rule fits, else allow.

Up to ``INLINE_RULES`` rules travel inside the plan as one literal map, so nothing is shuffled. Beyond it distinct
urls are joined to the rules on tokens, and the decisions are joined back to the rows.

Null urls and urls without ``://`` have empty host and path; they fit no path rule. Rows are kept as they are,
repeated ones too, and so are other columns unless they have a name of the result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INLINE_RULES = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The path rules of the contract and this filter's own patterns on hosts.
PATH_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
HOST_WORDS = ["adult", "betting", "casino", "escort", "gambling", "lottery", "pills", "porn", "sex", "viagra", "xxx"]


@dataclass(frozen=True)
class UrlRule:
    """Decides on ``host + path``. ``path_rule``: named in the result and chosen by length; else a pattern rule."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    path_rule: bool


def path_rule(verdict: str, name: str) -> UrlRule:
    """``host/prefix``: fits the host and all its subdomains if the path starts with the rest."""
    host, _, rest = name.partition("/")
    host, path = host.translate(str.maketrans(UPPER, LOWER)), f"/{rest}"
    # The last word of a prefix may go on in the url, unless something ends it.
    words = [f"h:{x}" for x in re.findall("[a-z0-9]+", host)] + [f"p:{m[0]}" for m in re.finditer("[A-Za-z0-9]+", path) if m.end() < len(path)]
    return UrlRule(name, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(words), True)


def host_word_rule(word: str) -> UrlRule:
    """Blocks hosts in which this word stands alone between dots and hyphens."""
    return UrlRule(word, "block", rf"^(?:[^/]*[.-])?{re.escape(word)}(?:[.-][^/]*)?(?:/|$)", (f"h:{word}",), False)


RULES = [*(path_rule(v, n) for v, n in PATH_RULES), *(host_word_rule(w) for w in HOST_WORDS)]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    cut = lambda c, kind: F.transform(F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(cut(host, "h:"), cut(path, "p:")))


def token_counts(parts: DataFrame, rules: list[UrlRule]) -> dict[str, int]:
    """In how many urls each token of a rule stands; only rules' tokens are counted."""
    wanted = sorted({t for r in rules for t in r.tokens})
    found = parts.select(F.explode(F.array_intersect(tokens_of(F.col("host"), F.col("path")), F.array(*map(F.lit, wanted)))).alias("token"))
    return {r.token: r.n for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}


def filed(rules: list[UrlRule], counts: dict[str, int]) -> list[tuple[str, UrlRule]]:
    """Each rule with the token under which it is filed: its rarest, first by name among equals."""
    return [(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), r) for r in rules]


def _entry(r: UrlRule) -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in (("rank", len(r.name)), ("name", r.name), ("verdict", r.verdict), ("pattern", r.pattern), ("path_rule", r.path_rule))))


def decisions(parts: DataFrame, rules: list[UrlRule], counts: dict[str, int]) -> DataFrame:
    """parts (host, path, others) with ``fit``: the fitting rules among those that the url's tokens fetch."""
    by: dict[str, list[UrlRule]] = {}
    for token, r in filed(rules, counts):
        by.setdefault(token, []).append(r)
    tokens = tokens_of(F.col("host"), F.col("path"))
    index = F.create_map(*(x for t, rs in sorted(by.items()) for x in (F.lit(t), F.array(*map(_entry, rs)))))
    keys = F.array(*map(F.lit, sorted(by)))
    fetched = F.flatten(F.transform(F.array_intersect(tokens, keys), lambda t: F.element_at(index, t)))
    target = F.concat("host", "path")
    return parts.withColumn("fit", F.filter(fetched, lambda r: F.regexp_like(target, r["pattern"])))


def decide(fit: Column, host: Column, path: Column) -> list[Column]:
    own = F.filter(fit, lambda r: r["path_rule"])
    # Longest first, then by name.
    best = F.element_at(F.array_sort(own, lambda a, b: F.when(a["rank"] > b["rank"], -1).when(a["rank"] < b["rank"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)), 1)
    pattern = F.array_min(F.transform(F.filter(fit, lambda r: ~r["path_rule"]), lambda r: r["name"]))
    best_or_none = F.when(F.size(own) > 0, best)
    return [
        host.alias("host"),
        path.alias("path"),
        best_or_none["name"].alias("rule"),
        F.coalesce(best_or_none["verdict"], F.when(pattern.isNotNull(), "block").otherwise("allow")).alias("verdict"),
        pattern.alias("pattern_rule"),
    ]


RESULT = ("host", "path", "rule", "verdict", "pattern_rule")


def url_filter(df: DataFrame, url: str = "url", rules: list[UrlRule] | None = None) -> DataFrame:
    """All columns of df (but those named as the result's) with host, path, rule, verdict, pattern_rule."""
    rules = RULES if rules is None else rules
    if not rules:
        raise ValueError("no rules")
    kept = [c for c in df.columns if c not in RESULT]
    parts = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{url}`").alias("url"))
    parts = parts.select("row", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    counts = token_counts(parts, rules)
    if len(rules) <= INLINE_RULES:
        judged = decisions(parts, rules, counts).select("row", *decide(F.col("fit"), F.col("host"), F.col("path")))
        return judged.select("row.*", *RESULT)
    urls = parts.select("host", "path").distinct()
    spark = df.sparkSession
    entries = [(t, len(r.name), r.name, r.verdict, r.pattern, r.path_rule) for t, r in filed(rules, counts)]
    table = spark.createDataFrame(entries, "token string, rank int, name string, verdict string, pattern string, path_rule boolean")
    fetched = urls.withColumn("token", F.explode(tokens_of(F.col("host"), F.col("path")))).join(table, "token")
    fits = fetched.filter(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    # Partial aggregates keep one rule of each kind for a url: longest, then first by name.
    best = F.min(F.when(F.col("path_rule"), F.struct((-F.col("rank")).alias("rank"), "name", "verdict"))).alias("best")
    pattern = F.min(F.when(~F.col("path_rule"), F.col("name"))).alias("pattern_rule")
    found = fits.groupBy("host", "path").agg(best, pattern)
    verdict = F.coalesce("best.verdict", F.when(F.col("pattern_rule").isNotNull(), "block").otherwise("allow"))
    return parts.join(found, ["host", "path"], "left").select("row.*", "host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"), "pattern_rule")
