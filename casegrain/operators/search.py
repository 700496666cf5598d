"""Full-text search over titles: an inverted index and BM25."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(col):
    """Lower-case runs of letters and digits; marks on letters are dropped."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.regexp_replace(F.normalize(col, F.lit("NFD")) if hasattr(F, "normalize") else col, r"\p{M}+", "")), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf, length: one row for each term of each document; null and empty texts have none."""
    x = docs.where(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("t"))
    return x.select(key, F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def _same(word: str):
    return lambda v: F.when(v == word, 1)


def bm25(docs: DataFrame, key: str, text: str, query: str, limit: int | None = 50) -> DataFrame:
    """key, score of the documents that hold all words of the query, best first.

    One pass over the texts counts the query's words in each; no index is built for a
    question.  Lengths and counts are of all documents; a word that most documents hold
    counts 1e-6.  A query without words finds nothing.
    """
    words = list(dict.fromkeys(w for w in _fold(query).split() if w))
    if not words:
        return docs.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    t = docs.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    x = t.select(key, F.size("t").alias("length"), *[F.size(F.array_compact(F.transform("t", _same(w)))).alias(f"tf{k}") for k, w in enumerate(words)])
    stats = x.agg(F.count("*").alias("n"), F.sum("length").alias("total"), *[F.sum((F.col(f"tf{k}") > 0).cast("long")).alias(f"df{k}") for k in range(len(words))]).withColumn("_all", F.lit(0))
    every = F.lit(True)
    for k in range(len(words)):
        every = every & (F.col(f"tf{k}") > 0)
    j = x.where(every).withColumn("_all", F.lit(0)).join(stats, "_all")
    avg = F.col("total") / F.col("n")

    def part(k: int):
        rare = (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)
        idf, tf = F.when(rare > 1, F.log(rare)).otherwise(1e-6), F.col(f"tf{k}")
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / avg))

    g = j.select(key, F.round(sum((part(k) for k in range(len(words))), F.lit(0.0)), 6).alias("score"))
    return g if limit is None else g.orderBy(F.desc("score"), key).limit(max(1, min(limit, 50)))


def _fold(s: str) -> str:
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()
    return " ".join("".join(c if c.isalnum() else " " for c in s).split())


def shard_order(hits: DataFrame, shard: str, limit: int) -> DataFrame:
    """The first hits, shard after shard, each shard's best first."""
    return hits.orderBy(shard, F.desc("score"), "result_id").limit(limit)


def best_of_repeats(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first by the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def new_only(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """What is found and not known yet; repeats within the batch count once, the best of them."""
    return best_of_repeats(found.join(known.select(key).distinct(), key, "left_anti"), [key], [F.desc("score"), F.col("result_id")])


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old and new by key: the latest row, at the place (first_order) where the key stood first."""
    u = old.unionByName(new)
    first = u.groupBy(key).agg(F.min(order).alias("first_order"))
    return best_of_repeats(u, [key], [F.desc(order)]).join(first, key)
