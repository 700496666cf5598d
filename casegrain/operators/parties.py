"""Party names: keys, captions, and matches between a query's names and cases' parties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import ENTITY_SUFFIX


def party_key(c: Column) -> Column:
    """Lower-case words without the legal form behind them; null counts as empty."""
    words = F.concat_ws(" ", F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), words), ENTITY_SUFFIX, ""))


def caption_parties(c: Column) -> Column:
    """The two sides of a caption, [] if it has not two."""
    parts = F.split(c, r"(?i)\s+(?:v\.?|vs\.?|versus)\s+", 2)
    return F.when(F.size(parts) == 2, F.transform(parts, lambda x: F.regexp_replace(x, r"^[ ,_-]+|[ ,_-]+$", ""))).otherwise(F.array().cast("array<string>"))


def key_matches(queries: DataFrame, parties: DataFrame) -> DataFrame:
    """query_key, party_key, confidence: 'exact' on the key, 'possible' where 80 % of the smaller name's words are shared.

    queries, parties: name.  Distinct names are joined on their words, and the rarest
    words of a name come first: to share 80 % of the smaller side, two names must share
    one of its rarer words, so a word that stands in a third of all names joins nothing.
    """
    q = queries.select(party_key(F.col("name")).alias("k")).where("k <> ''").distinct()
    p = parties.select(party_key(F.col("name")).alias("k")).where("k <> ''").distinct()
    exact = q.select(F.col("k").alias("query_key"), F.col("k").alias("party_key")).join(p.select(F.col("k").alias("party_key")), "party_key", "left_semi").withColumn("confidence", F.lit("exact"))
    both = q.unionByName(p).distinct().select("k", F.explode(F.array_distinct(F.split("k", " "))).alias("w"))
    df = both.groupBy("w").agg(F.count("*").alias("df"))

    def rare(names: DataFrame) -> DataFrame:
        # Of a name of n words at least one of its n - ceil(0.8 n) + 1 rarest is shared with any match that is not shorter.
        x = names.select("k", F.array_distinct(F.split("k", " ")).alias("ws")).where(F.size("ws") >= 2)
        y = x.select("k", "ws", F.explode("ws").alias("w")).join(df, "w").groupBy("k", "ws").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("r"))
        return y.select("k", "ws", F.transform("r", lambda s: s["w"]).alias("r"), (F.size("ws") - F.ceil(F.size("ws") * 0.8) + 1).alias("keep"))

    a, b = rare(q), rare(p)
    prefix = lambda t: t.select("k", "ws", F.explode(F.slice("r", 1, F.col("keep").cast("int"))).alias("w"))
    every = lambda t: t.select("k", "ws", F.explode("r").alias("w"))
    short_q = prefix(a).alias("a").join(every(b).alias("b"), "w").where("size(a.ws) <= size(b.ws)")
    short_p = every(a).alias("a").join(prefix(b).alias("b"), "w").where("size(a.ws) > size(b.ws)")
    cols = [F.col("a.k").alias("query_key"), F.col("b.k").alias("party_key"), F.col("a.ws").alias("x"), F.col("b.ws").alias("y")]
    cand = short_q.select(*cols).unionByName(short_p.select(*cols)).where("query_key <> party_key").dropDuplicates(["query_key", "party_key"])
    ok = cand.where(F.size(F.array_intersect("x", "y")) / F.least(F.size("x"), F.size("y")) >= 0.8)
    return exact.select("query_key", "party_key", "confidence").unionByName(ok.select("query_key", "party_key", F.lit("possible").alias("confidence")))


def matches(queries: DataFrame, parties: DataFrame) -> DataFrame:
    """asked_by, query_key, party_key, case_id, confidence: a query's names against the parties of all cases but its own.

    queries: case_id, name; parties: case_id, name.  Names that say nothing have no
    row; a query without a case excludes none.
    """
    q = queries.select(F.col("case_id").alias("asked_by"), party_key(F.col("name")).alias("query_key")).where("query_key <> ''").distinct()
    p = parties.select("case_id", party_key(F.col("name")).alias("party_key")).where("party_key <> ''").distinct()
    names = lambda x, c: x.select(F.col(c).alias("name")).distinct()
    m = key_matches(names(q, "query_key"), names(p, "party_key"))
    return q.join(m, "query_key").join(p, "party_key").where("asked_by is null or case_id is null or asked_by <> case_id").select("asked_by", "query_key", "party_key", "case_id", "confidence")
