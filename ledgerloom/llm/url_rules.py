"""URL filtering by fixed rules and, where none fits, by mined association rules.

All steps are DataFrame functions.  Host and path are cut from the url; the longest fixed rule
that fits gives the verdict.  The urls that a rule judged are the labelled set: each becomes a
transaction of URL tokens plus its verdict, Spark's FP-growth mines the frequent combinations,
and the association rules with a verdict as consequent are kept if their confidence and support
reach the thresholds and no rule with one token less is as confident.  The other urls meet the
rules through an inverted index (token -> rule): a rule matches when all its tokens were hit.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and
has no tokens: it gets ``default``.  A path is compared as it stands, so a url without any path
does not start with ``/``.  With no labelled url there are no mined rules.  Equal urls get equal
verdicts; repeated rows stay; null page_id stays null.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VERDICT = "verdict="


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    scheme = F.substring_index(url, "://", 1)
    return F.substring(url, F.length(scheme) + 4, F.length(url))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: UrlRule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def fixed_verdict(rules: list[UrlRule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    one = lambda r: F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
    return F.coalesce(*[F.when(fits(r, host, path), one(r)) for r in ordered],
                      F.lit(None).cast("struct<rule:string,verdict:string>"))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, domain endings, path segments and query keys (runs of
    digits written ``#``), and the scheme."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    ends = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("end:"), F.array_join(
        F.slice(labels, i, n), ".")))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    segments = F.transform(segments, lambda s: F.concat(F.lit("path:"), F.regexp_replace(s, r"\d+", "#")))
    pairs = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    keys = F.transform(F.filter(pairs, lambda p: p != ""), lambda p: F.concat(F.lit("query:"), F.substring_index(p, "=", 1)))
    scheme = F.array(F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1)))
    labels = F.transform(labels, lambda x: F.concat(F.lit("label:"), x))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(labels, ends, segments, keys, scheme)))


def mine_rules(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8,
               too_common: float = 0.95) -> DataFrame:
    """labelled(tokens, verdict) -> rules(tokens, verdict, confidence, support).

    Tokens in more than ``too_common`` of the transactions tell nothing and are left out: they
    would only double the number of combinations."""
    n = labelled.count()
    if n == 0:
        return labelled.sparkSession.createDataFrame(
            [], "tokens array<string>, verdict string, confidence double, support double")
    counts = labelled.select(F.explode("tokens").alias("t")).groupBy("t").count()
    useful = counts.where((F.col("count") >= min_support * n) & (F.col("count") <= too_common * n))
    # at most (tokens of a url) / min_support tokens can be that frequent: a bounded array
    useful = useful.agg(F.collect_set("t").alias("useful"))
    items = labelled.crossJoin(F.broadcast(useful)).select(F.concat(
        F.array_intersect("tokens", "useful"), F.array(F.concat(F.lit(_VERDICT), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    r = model.associationRules.where(F.col("consequent")[0].startswith(_VERDICT)).select(
        F.array_sort("antecedent").alias("tokens"),
        F.substring(F.col("consequent")[0], len(_VERDICT) + 1, 1000).alias("verdict"), "confidence", "support")
    shorter = r.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("part_confidence"))
    parts = r.where(F.size("tokens") > 1).select(
        "*", F.explode("tokens").alias("gone")).withColumn("part", F.array_except("tokens", F.array("gone")))
    beaten = parts.join(shorter, ["part", "verdict"]).where("part_confidence >= confidence").select("tokens", "verdict")
    return r.join(beaten.distinct(), ["tokens", "verdict"], "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(url, tokens), distinct urls -> (url, verdict) of the best rule whose tokens all occur:
    by confidence, then support, then more tokens, then names."""
    index = rules.select(F.explode("tokens").alias("t"), F.size("tokens").alias("n"), "verdict", "confidence",
                         "support", F.array_join("tokens", " ").alias("name"))
    hits = urls.select("url", F.explode("tokens").alias("t")).join(index, "t")
    full = hits.groupBy("url", "name", "verdict", "n", "confidence", "support").agg(F.count(F.lit(1)).alias("hit"))
    return full.where("hit = n").groupBy("url").agg(F.max_by(
        "verdict", F.struct("confidence", "support", "n", "verdict", "name")).alias("mined"))


def judge_urls(pages: DataFrame, rules: list[UrlRule], default: str = "allow", min_support: float = 0.01,
               min_confidence: float = 0.8) -> DataFrame:
    """page_id, url, host, path, rule, verdict for every row."""
    p = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.withColumn("fixed", fixed_verdict(rules, F.col("host"), F.col("path")))
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")
    labelled = p.where("fixed is not null").select(tokens, F.col("fixed.verdict").alias("verdict"))
    open_urls = p.where("fixed is null and host != ''").select("url", tokens).distinct()
    mined = match_rules(open_urls, mine_rules(labelled, min_support, min_confidence))
    return p.join(mined, "url", "left").select(
        "page_id", "url", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", "mined", F.lit(default)).alias("verdict"))
