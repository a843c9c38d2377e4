"""URL filters: rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.exact import UPPER
from attesta.llm.hot import join_groups
from attesta.llm.scratch import stored

#: statistics of up to so many suffixes are broadcast
SMALL_ROWS = 200_000

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ["length", "host_length", "path_length", "labels", "depth", "digit_share", "letter_share", "dashes",
            "parameters", "entropy", "fragment", "suffix_share", "suffix_block", "host_block"]


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, UPPER.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(rules: list[tuple[str, str]], host_: Column, path_: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule is a host and a path in
    one string; it fits that host and its subdomains where the path starts with its path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host_ == own) | host_.endswith(f".{own}")) & path_.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _suffix(host_: Column, labels: int) -> Column:
    return F.substring_index(host_, ".", -labels)


def lexical(url: Column, host_: Column, path_: Column) -> dict[str, Column]:
    """Features that need nothing but the URL; null counts as empty."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    query = F.coalesce(F.regexp_extract(u, r"(?s)\?([^#]*)", 1), F.lit(""))
    chars = F.split(u, "")
    share = F.transform(F.array_distinct(chars), lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n)
    entropy = -F.aggregate(share, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log2(p)).otherwise(0.0))

    def count(text: Column, pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    return {"length": F.length(u).cast("double"), "host_length": F.length(host_).cast("double"),
            "path_length": F.length(path_).cast("double"), "labels": count(host_, r"\.") + 1, "depth": count(path_, r"/[^/]"),
            "digit_share": count(u, "[0-9]") / n, "letter_share": count(u, "[A-Za-z]") / n, "dashes": count(u, "[-_]"),
            "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "entropy": entropy,
            "fragment": count(u, "#")}


class UrlModel:
    """Trees and the suffix statistics that feed them; without trees, one probability."""

    def __init__(self, trees: PipelineModel | None, suffixes: DataFrame, hosts: DataFrame, prior: float):
        self.trees, self.suffixes, self.hosts, self.prior = trees, suffixes, hosts, prior

    def features(self, urls: DataFrame) -> DataFrame:
        """``urls`` (with __url, __host, __path) and the feature columns."""
        own = lexical(F.col("__url"), F.col("__host"), F.col("__path"))
        met = urls.withColumns({**own, "__s1": _suffix(F.col("__host"), 1), "__s2": _suffix(F.col("__host"), 2)})
        for key, facts in (("__s1", self.suffixes), ("__s2", self.hosts)):
            met = _met(met, key, facts).drop("__pages")
        return met.fillna({"suffix_share": 0.0, "suffix_block": self.prior, "host_block": self.prior})


def _met(rows: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """Left join with a stored table of statistics: broadcast when it proves small, else
    shuffled, with frequent keys spread."""
    if facts.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return rows.join(F.broadcast(facts), key, "left")
    return join_groups(rows, key, facts, "__pages", F.floor(F.rand(7) * (1 << 20)))


def _statistics(rows: DataFrame, total: int, prior: float, share: str | None, rate: str) -> DataFrame:
    """Pages, share of all pages, and smoothed rate of block among the labelled, per suffix."""
    own = [] if share is None else [(F.col("pages") / total).alias(share)]
    return rows.select(rows.columns[0], F.col("pages").alias("__pages"), *own,
                       ((F.col("bad") + 5 * prior) / (F.col("known") + 5)).alias(rate))


def fit(labelled: DataFrame, max_urls: int = 20_000, trees: int = 10, depth: int = 4,
        url_col: str = "url", label_col: str = "label") -> UrlModel:
    """Boosted trees from at most about ``max_urls`` distinct labelled URLs (label 1: block,
    by the majority of a URL's rows), picked by a hash of the URL. Suffix statistics are
    those of all rows: shares of the last label of the hosts among all of them, and rates of
    block among the labelled ones per last label and last two labels, however rare. Trees
    learn nothing from rows without label; with labels of one kind, or none, the model is
    that kind's probability (allow)."""
    rows = labelled.select(
        F.col(url_col).alias("__url"), host(F.col(url_col)).alias("__host"), path(F.col(url_col)).alias("__path"),
        F.col(label_col).cast("double").alias("label"))
    per_host = stored(rows.groupBy(_suffix(F.col("__host"), 2).alias("__s2")).agg(
        F.count(F.lit(1)).alias("pages"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("bad")),
        "host-counts")
    names = ("pages", "known", "bad")
    seen = per_host.agg(*(F.sum(c).alias(c) for c in names)).first()
    total, known, bad = seen["pages"] or 0, seen["known"] or 0, seen["bad"] or 0.0
    prior = bad / known if known else 0.0
    per_suffix = per_host.groupBy(_suffix(F.col("__s2"), 1).alias("__s1")).agg(*(F.sum(c).alias(c) for c in names))
    suffixes = stored(_statistics(per_suffix, total, prior, "suffix_share", "suffix_block"), "suffixes")
    hosts = stored(_statistics(per_host, total, prior, None, "host_block"), "hosts")
    model = UrlModel(None, suffixes, hosts, prior)
    if not 0 < bad < known:
        return model
    ruled = rows.where(F.col("label").isNotNull())
    n = ruled.agg(F.approx_count_distinct("__url", 0.02).alias("n")).first()["n"]
    part = 1 << 20 if n <= max_urls else (1 << 20) * max_urls // n
    sample = stored(ruled.where(F.pmod(F.xxhash64("__url"), F.lit(1 << 20)) < part).groupBy("__url", "__host", "__path")
                    .agg((F.avg("label") >= 0.5).cast("double").alias("label")), "url-sample")
    if len(sample.select("label").distinct().collect()) == 2:
        boosted = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, seed=7)
        known = stored(model.features(sample).select("label", *FEATURES).repartition(4), "url-features")
        model.trees = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), boosted]).fit(known)
    return model


def judge(urls: DataFrame, model: UrlModel, rules: list[tuple[str, str]], threshold: float = 0.5,
          url_col: str = "url") -> DataFrame:
    """All rows and columns of ``urls`` with host, path, rule, block_score and verdict.

    The longest rule that fits decides; else the trees do: ``block`` at ``threshold`` or
    more. Null URLs and those without ``://`` have empty host and path and are judged by
    their other features. All other columns of ``urls``, whatever their names, come back as they
    are; those named like the results are replaced.
    """
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "block_score", "verdict")]
    row = urls.select(F.struct(*kept).alias("__row"), F.col(url_col).alias("__url"),
                      host(F.col(url_col)).alias("__host"), path(F.col(url_col)).alias("__path"))
    if model.trees is None:
        scored = row.withColumn("__score", F.lit(float(model.prior)))
    else:
        scored = model.trees.transform(model.features(row)).withColumn("__score", vector_to_array("probability")[1])
    rule, verdict = rule_of(rules, F.col("__host"), F.col("__path"))
    own = F.when(F.col("__score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(*(F.col("__row")[c].alias(c) for c in kept), F.col("__host").alias("host"),
                         F.col("__path").alias("path"), rule.alias("rule"), F.col("__score").alias("block_score"),
                         F.coalesce(verdict, own).alias("verdict"))
