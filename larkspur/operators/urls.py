"""URL jobs: counts, audits, candidate gates and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import url as U
from larkspur.functions.numbers import js_round
from larkspur.functions.staging import pin, spread_rows
from larkspur.functions.text import contains_any
from larkspur.functions.url_type import candidate_rank, classify_url, is_product_candidate, split_url


def domain_counts(urls: DataFrame) -> DataFrame:
    return urls.groupBy(U.canonical_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("urls"))


def dedupe_urls(urls: DataFrame, order: str) -> DataFrame:
    """First url per scheme+host+path; the aggregate collapses copies map-side."""
    return urls.groupBy(U.url_key(F.col("url")).alias("url_key")).agg(
        F.min_by("url", order).alias("url"), F.count("*").alias("copies"))


def with_url_type(urls: DataFrame) -> DataFrame:
    """Add confidence and hint; the rows are dealt over all cores before they are scored."""
    typed = pin(split_url(spread_rows(urls)), _type=classify_url(F.col("url")))
    return typed.select(*urls.columns, "_type.confidence", "_type.hint")


def product_candidates(urls: DataFrame) -> DataFrame:
    typed = with_url_type(urls)
    return typed.where(is_product_candidate(F.col("url"), F.col("confidence"), F.col("hint")))


def category_filter(urls: DataFrame, patterns: list[str]) -> DataFrame:
    """Keep urls that contain any pattern; no pattern keeps all."""
    terms = [p.strip().lower() for p in patterns if p.strip()]
    return urls.where(contains_any(F.lower("url"), terms)) if terms else urls


def allowlisted(c: Column, domains: Column, prefixes: Column) -> Column:
    """https, allowed host, allowed path prefix; robots and sitemap paths pass on an allowed host.

    A null policy (both arrays null) allows everything.
    """
    p = F.lower(U.path_or_root(c))
    host_ok = (F.coalesce(F.size(domains), F.lit(0)) <= 0) | F.exists(domains, lambda d: F.lower(d) == U.host(c))
    free = (p == "/robots.txt") | F.contains(p, F.lit("sitemap"))
    path_ok = (F.coalesce(F.size(prefixes), F.lit(0)) <= 0) | free | F.exists(
        prefixes, lambda x: F.startswith(U.path_or_root(c), x))
    return (domains.isNull() & prefixes.isNull()) | ((U.scheme(c) == "https") & host_ok & path_ok)


def allowlisted_urls(urls: DataFrame, policies: DataFrame) -> DataFrame:
    """Urls that their source's policy allows; sources without a policy allow all."""
    return urls.join(policies, "source_id", "left").where(
        allowlisted(F.col("url"), F.col("domains"), F.col("path_prefixes"))).select(urls["*"])


def audit_urls(urls: DataFrame) -> DataFrame:
    """Valid, invalid, unique and duplicate counts of a url list.

    Copies are counted per normal form first, so the final merge sees one
    partial row per task instead of every distinct url.
    """
    per_url = urls.groupBy(U.audit_normal_form(F.col("url")).alias("u")).agg(F.count("*").alias("n"))
    return per_url.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("u").isNotNull(), F.col("n"))), F.lit(0)).alias("valid"),
        F.coalesce(F.sum(F.when(F.col("u").isNull(), F.col("n"))), F.lit(0)).alias("invalid"),
        F.count("u").alias("unique_urls"),
    ).withColumn("duplicates", F.col("valid") - F.col("unique_urls"))


def rank_candidates(urls: DataFrame, n: int, from_crawl: Column | None = None) -> DataFrame:
    """Best n distinct pages per host; ties by url.

    Duplicates collapse on the page key before the window. The rank limit is
    applied below the shuffle, so a dominant host sends at most n rows per task.
    """
    typed = with_url_type(urls)
    scored = pin(typed, rank_score=js_round(candidate_rank(
        F.col("url"), F.col("confidence"), F.col("hint"),
        from_crawl if from_crawl is not None else F.lit(False)), 4), host=U.host(F.col("url")), url_key=U.url_key(F.col("url")))
    best = scored.groupBy("host", "url_key").agg(
        F.max_by(F.struct("url", "confidence", "hint", "rank_score"),
                 F.struct(F.col("rank_score"), F.col("url"))).alias("b"))
    w = Window.partitionBy("host").orderBy(F.desc("b.rank_score"), "url_key")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(
        "host", "b.url", "b.confidence", "b.hint", "b.rank_score", "rank")
