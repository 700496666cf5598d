"""Quality of pages, from their text alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import PAGE_LIMITS, SANE


def page_scores(pages: DataFrame, key: str) -> DataFrame:
    """key, page, characters, noise_ratio, vowelless_ratio, short_token_ratio, relative_length, reasons, failed.

    A page's length counts against the median of its document.  Empty pages have
    ratios 0 and fail for want of text; null texts count as empty.
    """
    body = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(body, F.lit("[A-Za-z]{2,}"), F.lit(0))
    toks = F.filter(F.split(body, r"\s+"), lambda x: x != "")
    bare = F.length(F.regexp_replace(body, r"\s+", ""))

    def ratio(part, whole):
        return F.when(whole > 0, F.round(part / whole, 4)).otherwise(F.lit(0.0))

    x = pages.select(
        key, "page", bare.alias("characters"),
        F.when(F.length(body) > 0, F.round(1 - F.regexp_count(body, F.lit(SANE)) / F.length(body), 4)).otherwise(0.0).alias("noise_ratio"),
        ratio(F.size(F.filter(words, lambda w: ~F.rlike(w, F.lit("[aeiouAEIOU]")))), F.size(words)).alias("vowelless_ratio"),
        ratio(F.size(F.filter(toks, lambda w: F.length(w) <= 2)), F.size(toks)).alias("short_token_ratio"),
    )
    med = x.groupBy(key).agg(F.percentile("characters", F.lit(0.5)).alias("median"))
    x = x.join(med, key).withColumn("relative_length", F.when(F.col("median") > 0, F.round(F.col("characters") / F.col("median"), 4)).otherwise(1.0))
    checks = [
        (F.col("characters") < PAGE_LIMITS["characters"], "little text"), (F.col("noise_ratio") > PAGE_LIMITS["noise"], "noise"), (F.col("vowelless_ratio") > PAGE_LIMITS["vowelless"], "no vowels"),
        (F.col("short_token_ratio") > PAGE_LIMITS["short"], "short tokens"), ((F.col("median") > 0) & (F.col("relative_length") < PAGE_LIMITS["relative"]), "short page"),
    ]
    reasons = F.filter(F.array(*[F.when(c, F.lit(r)) for c, r in checks]), lambda r: r.isNotNull())
    return x.withColumn("reasons", reasons).withColumn("failed", F.size("reasons") > 0).drop("median")


def review_queue(scores: DataFrame, other: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """key, page, kind, why: failed pages and other disagreements (key, page, kind, why), but for what is decided."""
    own = scores.where("failed").select(key, "page", F.lit("quality").alias("kind"), F.concat_ws("; ", "reasons").alias("why"))
    return own.unionByName(other.select(key, "page", "kind", "why")).distinct().join(done.select(key, "page", "kind").distinct(), [key, "page", "kind"], "left_anti")


def queue_summary(queue: DataFrame, key: str) -> DataFrame:
    return queue.agg(F.count("*").alias("items"), F.sum((F.col("kind") == "quality").cast("long")).alias("quality_items"), F.countDistinct(key).alias("documents"))
