"""Evidence status: an ordinal that counts and scores never raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import STATUS

#: Marks of a claim by status: opening, closing (the longest is read first).
MARKS = {3: (r"\[\[\[", r"\]\]\]"), 2: (r"\{\[", r"\]\}"), 1: (r"\[\[", r"\]\]"), 0: (r"\[\{", r"\}\]")}
CLAIM = "|".join(f"{MARKS[k][0]}.*?{MARKS[k][1]}" for k in (3, 2, 1, 0))


def rank_of(col: Column) -> Column:
    """Rank of a status by its name in any case or its mark; unknown names and null are unverified, the lowest."""
    u = F.regexp_replace(F.upper(F.trim(col)), " ", "")
    out = F.lit(0)
    for k, (s, mark) in enumerate(zip(STATUS, ("[{}]", "[[]]", "{[]}", "[[[]]]"))):
        out = F.when(u.isin(s, mark), k).otherwise(out)
    return out


def name_of(col: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATUS]), col + 1)


def floor(df: DataFrame, by: list[str], status: str) -> DataFrame:
    """by, status: the weakest status of each group."""
    return df.groupBy(*by).agg(name_of(F.min(rank_of(F.col(status)))).alias("status"))


def stir(df: DataFrame, by: list[str], value: str, weight: str, status: str, source: str) -> DataFrame:
    """Weighted mean of values and of statuses: value, p0 to p3, mass, status (ties resolve downward), sources.

    Rows of null or negative weight are left out; a group without weight has no row.
    """
    x = df.where(F.col(weight) >= 0).withColumn("_w", F.col(weight).cast("double")).withColumn("_r", rank_of(F.col(status)))
    g = x.groupBy(*by).agg(
        F.sum(F.col(value) * F.col("_w")).alias("s"), F.sum("_w").alias("w"), F.count("*").alias("mass"),
        *[F.sum(F.when(F.col("_r") == k, F.col("_w")).otherwise(0.0)).alias(f"p{k}") for k in range(4)], F.countDistinct(source).alias("sources"),
    ).where("w > 0")
    top = F.greatest("p0", "p1", "p2", "p3")
    best = F.when(F.col("p0") == top, 0).when(F.col("p1") == top, 1).when(F.col("p2") == top, 2).otherwise(3)
    return g.select(*by, F.round(F.col("s") / F.col("w"), 6).alias("value"), *[F.round(F.col(f"p{k}") / F.col("w"), 6).alias(f"p{k}") for k in range(4)], "mass", name_of(best).alias("status"), "sources")


def claims(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, status, claim, claim_key of the marked claims in texts; the longest mark is read first."""
    x = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"({CLAIM})"), F.lit(1))).alias("pos", "mark"))
    rank = F.when(F.startswith("mark", F.lit("[[[")), 3).when(F.startswith("mark", F.lit("{[")), 2).when(F.startswith("mark", F.lit("[[")), 1).otherwise(0)
    inner = F.regexp_replace("mark", r"^(\[\[\[|\{\[|\[\[|\[\{)|(\]\]\]|\]\}|\]\]|\}\])$", "")
    return x.select(key, "pos", name_of(rank).alias("status"), inner.alias("claim"), claim_key(inner).alias("claim_key"))


def claim_key(c: Column) -> Column:
    return F.concat_ws(" ", F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def tensions(cl: DataFrame) -> DataFrame:
    """claim_key, statuses, places: claims that stand with more than one status."""
    g = cl.where("claim_key <> ''").groupBy("claim_key").agg(F.array_sort(F.collect_set("status")).alias("statuses"), F.count("*").alias("places"))
    return g.where(F.size("statuses") > 1)


def demote(cl: DataFrame, allowed: DataFrame) -> DataFrame:
    """The claims; a validated one that is not among the allowed keys becomes speculative."""
    ok = allowed.select("claim_key").distinct().withColumn("ok", F.lit(True))
    j = cl.join(ok, "claim_key", "left")
    return j.withColumn("status", F.when((F.col("status") == "VALIDATED") & F.col("ok").isNull(), "SPECULATIVE").otherwise(F.col("status"))).drop("ok")


def enforced(texts: DataFrame, key: str, text: str, allowed: DataFrame) -> DataFrame:
    """key, text: each line trimmed; validated marks that are not allowed become speculative, and bare lines are marked so.

    Lines that end with a colon, headings, list items with a mark and lines that begin
    with one stay.  Null texts have no row.
    """
    lines_ = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("n", "line")).withColumn("line", F.trim("line"))
    marks = lines_.select(key, "n", F.explode(F.regexp_extract_all("line", F.lit(r"\[\[\[(.*?)\]\]\]"), F.lit(1))).alias("inner")).distinct()
    bad = marks.withColumn("claim_key", claim_key(F.col("inner"))).join(allowed.select("claim_key").distinct(), "claim_key", "left_anti").groupBy(key, "n").agg(F.array_sort(F.collect_list("inner")).alias("bad"))
    x = lines_.join(bad, [key, "n"], "left")
    line = F.aggregate(F.coalesce("bad", F.array().cast("array<string>")), F.col("line"), lambda a, i: F.replace(a, F.concat(F.lit("[[["), i, F.lit("]]]")), F.concat(F.lit("[["), i, F.lit("]]"))))
    x = x.withColumn("line", line)
    stays = (F.col("line") == "") | F.endswith("line", F.lit(":")) | F.rlike("line", F.lit(r"^(#|- \[\{|- \[\[|- \{\[|\[\{|\[\[|\{\[)"))
    x = x.withColumn("line", F.when(stays, F.col("line")).otherwise(F.concat(F.lit("[["), "line", F.lit("]]"))))
    whole = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]))
    return x.groupBy(key).agg(F.trim(whole).alias(text))


def count_by_status(cl: DataFrame) -> DataFrame:
    """status, claims: every status, also those that no claim has."""
    dim = cl.sparkSession.createDataFrame([(s, k) for k, s in enumerate(STATUS)], "status string, rank int")
    return dim.join(F.broadcast(cl.groupBy("status").agg(F.count("*").alias("claims"))), "status", "left").select("status", F.coalesce("claims", F.lit(0)).alias("claims"))
