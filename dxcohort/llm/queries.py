"""The registered ``opN_*`` queries: thin uses of the operators with production
parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The URL rules (host, path, verdict) and the listed spam sites.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Words of the longest n-gram that scores.
LM_ORDER = 3
SPAM_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_scores
    return lm_scores(table(spark, sf_dir, "documents"), LM_ORDER)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import digests, substring_dedup
    return digests(substring_dedup(table(spark, sf_dir, "documents")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan
    return license_scan(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_classes
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores, train
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated_spans
    return contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import assign, digests, pieces
    return assign(digests(pieces(table(spark, sf_dir, "documents"))))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: the URLs of pages on spam sites, and the five rules."""
    from .url_filter import filter_urls, host_of
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    site = r"(^|\.)(" + "|".join(SPAM_SITES) + r")\."
    listed = pages.where(host_of(F.col("url")).rlike(site))
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(pages, rules, listed)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import digests, periodic_runs, with_repetitions
    return digests(periodic_runs(with_repetitions(table(spark, sf_dir, "documents"))))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digests, pii_spans, train
    docs = table(spark, sf_dir, "documents")
    return digests(pii_spans(docs, train(docs)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import digests, fill_in_middle
    return digests(fill_in_middle(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}
