"""Observations of documents, the points they add up to, relations and recurrences.

A hit is (doc, seq, kind, value, weight).  Points follow from hits in closed form:
no count or pressure ever changes an evidence status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P

#: Documents of fewer points, and stale ones, are read a second time.
LEAST_POINTS, STALE_YEARS = 12, 15
#: What a point and a joint point must weigh to carry into each other.
LEAST_POINT, LEAST_JOINT = 0.65, 0.75


def first_hits(docs: DataFrame, key: str, text: str = "text", fields: dict[str, str] | None = None) -> DataFrame:
    """doc, seq, kind, value, weight of one reading of each document: metadata, patterns, repeated words.

    fields: metadata field (patterns.METADATA) to the column that has it; null, empty
    and '0' are no value.  The order is that of the extractors, then of places in the
    text.  Null texts have no hit.
    """
    t = F.col(text)
    parts = []
    for n, (field, kind, weight) in enumerate(P.METADATA):
        if field in (fields or {}):
            v = F.trim(F.col(fields[field]).cast("string"))
            parts.append(F.filter(F.array(_hit(-1, F.lit(n), kind, v, weight)), lambda h: h["value"].isNotNull() & ~h["value"].isin("", "0", "None")))
    for n, (kind, pattern, group, weight) in enumerate(P.EXTRACTORS):
        parts.append(_each(_all(t, pattern, group), n, kind, weight))
    head = F.substring(t, 1, 2500)
    for side, kind in enumerate(("PARTY_A", "PARTY_B")):
        parts.append(_each(_all(head, P.PARTIES, side + 1), 7, kind, 1.25, 2, side))
    amounts = F.zip_with(_all(t, P.AMOUNT, 1), _all(t, P.AMOUNT, 2), lambda a, b: F.concat(F.lit("$"), F.replace(F.when(a != "", a).otherwise(b), F.lit(","), F.lit(""))))
    parts.append(F.transform(amounts, lambda v, i: _hit(9, i, "AMOUNT", v, 1.30)))
    parts.append(F.transform(_all(t, P.MEASURE, 0), lambda v, i: _hit(10, i, "MEASURE", F.trim(v), 1.15)))
    found = docs.where(t.isNotNull()).select(F.col(key).alias("doc"), F.inline(F.concat(*parts)))
    words = token_counts(docs, key, text).select("doc", F.inline(F.transform(F.sequence(F.lit(1), F.col("hits").cast("int")), lambda i: _hit(11, F.col("rank") * 16 + i, "TOKEN", F.col("value"), P.WEIGHTS["TOKEN"]))))
    return found.unionByName(words).select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("ext", "idx")).alias("seq"), "kind", "value", "weight")


def _hit(ext: int, idx: Column, kind: str, value: Column, weight: float) -> Column:
    return F.struct(F.lit(ext).alias("ext"), idx.cast("int").alias("idx"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(weight).alias("weight"))


def _each(found: Column, ext: int, kind: str, weight: float, step: int = 1, shift: int = 0) -> Column:
    """The hits of an array of matches, blanks around them and marks behind them cut off."""
    return F.transform(found, lambda v, i: _hit(ext, i * step + shift, kind, F.rtrim(F.trim(v, F.lit(" \t\r\n")), F.lit(".,;:")), weight))


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(P.java(pattern)), F.lit(group))


def token_counts(docs: DataFrame, key: str, text: str = "text", most: int = 128, least: int = 2, cap: int = 16) -> DataFrame:
    """doc, value, n, hits, rank: the most frequent words of each document; ties go to the word that comes first."""
    words = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(P.WORD), F.lit(0))).alias("pos", "word"))
    w = words.select("doc", "pos", F.lower("word").alias("value")).where((F.length("value") > 3) & ~F.col("value").isin(P.STOP))
    g = w.groupBy("doc", "value").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    r = g.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "first")))
    return r.where(f"rank <= {most} and n >= {least}").select("doc", "value", "n", F.least("n", F.lit(cap)).alias("hits"), "rank")


def read_again(hits: DataFrame, years: DataFrame | None = None, as_of_year: int | None = None) -> DataFrame:
    """doc of the documents that are read a second time: stale ones, and those of few points.

    Only documents of few floats are asked for their relations and recurrences, and
    only those still below the limit for the points that carry.  So few points stand
    in no list that is cut off, and which of them carry does not depend on the order.
    years: doc, year (text).
    """
    floats = float_points(hits)
    small = floats.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") < LEAST_POINTS)
    h = hits.join(small.select("doc"), "doc", "left_semi")
    f = floats.join(small.select("doc"), "doc", "left_semi").select("doc", "kind", "pressure", norm(F.col("value")).alias("needle")).where((F.col("pressure") >= LEAST_POINT) & (F.length("needle") >= 3))
    joint = relation_points(h).select("doc", "value", "pressure", F.lit("mix").alias("layer")).unionByName(recurrence_points(h).select("doc", "value", "pressure", F.lit("stir").alias("layer")))
    carried = f.join(joint.where(F.col("pressure") >= LEAST_JOINT).select("doc", "layer", F.col("value").alias("whole")), "doc").where("contains(whole, needle) and not (layer = 'stir' and whole = concat(kind, '=', needle))").select("doc", "layer", "kind", "needle", "whole").distinct()
    every = small.unionByName(joint.groupBy("doc").agg(F.count("*").alias("n"))).unionByName(carried.groupBy("doc").agg(F.count("*").alias("n")))
    again = every.groupBy("doc").agg(F.sum("n").alias("n")).where(F.col("n") < LEAST_POINTS).select("doc")
    if years is not None and as_of_year:
        y = F.trim("year").try_cast("int")
        again = again.unionByName(years.where((y > 0) & (F.lit(as_of_year) - y > STALE_YEARS)).select("doc")).distinct()
    return again


def twice(hits: DataFrame, again: DataFrame) -> DataFrame:
    """The hits, those of the documents to be read again a second time behind the first."""
    more = hits.join(again, "doc", "left_semi")
    last = more.groupBy("doc").agg((F.max("seq") - F.min("seq") + 1).alias("last"))
    return hits.unionByName(more.join(last, "doc").select("doc", (F.col("seq") + F.col("last")).alias("seq"), "kind", "value", "weight"))


def with_counts(hits: DataFrame) -> DataFrame:
    """The hits with n, the running count of their point, p, its pressure then, and nx, where the point is hit next."""
    w = Window.partitionBy("doc", "kind", "value").orderBy("seq")
    return hits.withColumn("n", F.row_number().over(w)).withColumn("p", F.col("weight") * F.log1p("n")).withColumn("nx", F.lead("seq").over(w))


def norm(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def float_points(hits: DataFrame) -> DataFrame:
    """doc, kind, value, hits, pressure, first_seq: pressure is the last hit's weight times ln(1 + hits)."""
    g = hits.groupBy("doc", "kind", "value").agg(F.count("*").alias("hits"), F.max_by("weight", "seq").alias("w"), F.min("seq").alias("first_seq"))
    return g.select("doc", "kind", "value", "hits", F.round(F.col("w") * F.log1p("hits"), 8).alias("pressure"), "first_seq")


def recurrence_points(hits: DataFrame) -> DataFrame:
    """doc, value, hits, pressure: points of a value from its second hit; spellings that differ in case are one."""
    x = with_counts(hits).where(F.col("kind").isin(P.RECURRING) & (F.col("n") >= 2)).withColumn("kv", F.concat_ws("=", "kind", norm(F.col("value"))))
    x = x.withColumn("w", F.least(F.lit(1.75), 0.5 + F.col("p") / 2))
    g = x.groupBy("doc", "kv").agg(F.count("*").alias("hits"), F.max_by("w", "seq").alias("w"))
    return g.select("doc", F.col("kv").alias("value"), "hits", F.round(F.col("w") * F.log1p("hits"), 8).alias("pressure"))


def relation_points(hits: DataFrame) -> DataFrame:
    """doc, value, hits, pressure: each hit meets every related point in the state that it has then (an as-of self join)."""
    related = sorted({k for p in P.RELATED for k in p})
    x = with_counts(hits.where(F.col("kind").isin(related))).withColumn("kv", F.concat_ws("=", "kind", norm(F.col("value")))).withColumn("first", F.min("seq").over(Window.partitionBy("doc", "kind", "value")))
    a, b = x.alias("a"), x.alias("b")
    kinds = F.concat_ws("|", "a.kind", "b.kind").isin([f"{p}|{q}" for p, q in P.RELATED] + [f"{q}|{p}" for p, q in P.RELATED])
    on = (F.col("a.doc") == F.col("b.doc")) & (F.col("b.seq") < F.col("a.seq")) & (F.col("b.nx").isNull() | (F.col("b.nx") > F.col("a.seq"))) & kinds
    # Every related kind weighs more than LEAST_POINT from its first hit on.
    j = a.join(b, on).select(F.col("a.doc").alias("doc"), F.col("a.seq").alias("seq"), F.col("b.first").alias("f"), F.concat_ws("|", F.array_sort(F.array("a.kv", "b.kv"))).alias("value"), F.least(F.lit(1.75), (F.col("a.p") + F.col("b.p")) / 2).alias("w"))
    g = j.groupBy("doc", "value").agg(F.count("*").alias("hits"), F.max_by("w", F.struct("seq", "f")).alias("w"))
    return g.select("doc", "value", "hits", F.round(F.col("w") * F.log1p("hits"), 8).alias("pressure"))


def top_points(points: DataFrame, by: list[str], n: int, ties: list[str]) -> DataFrame:
    """The n points of most pressure, then hits, of each group, with their rank.

    A group may be hot: it is first cut down by parts, so no task sees more of it than
    a part's points or the parts' best ones.
    """
    order = [F.desc("pressure"), F.desc("hits"), *ties]
    few = points
    if by[0] != "doc":
        few = points.withColumn("_part", F.pmod(F.xxhash64(*ties), F.lit(64)))
        few = few.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(F.col("rank") <= n).drop("_part", "rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def case_rollup(records: DataFrame, docs: DataFrame) -> DataFrame:
    """case_id, documents, points of each layer and pressure of a case's documents (records of carry.document_records or their sums)."""
    j = records.join(docs.select("doc", "case_id").distinct(), "doc")
    s = lambda c: F.sum(c).cast("bigint").alias(c)
    return j.groupBy("case_id").agg(F.count("*").alias("documents"), s("float_points"), s("mix_points"), s("stir_points"), F.round(F.sum("total_pressure"), 4).alias("total_pressure"))


def pressure_share(points: DataFrame, docs: DataFrame) -> DataFrame:
    """case_id, doc, pressure, share: a document's part of its case's pressure."""
    d = points.groupBy("doc").agg(F.sum("pressure").alias("p")).join(docs.select("doc", "case_id").distinct(), "doc")
    total = d.groupBy("case_id").agg(F.sum("p").alias("total"))
    return d.join(total, "case_id").select("case_id", "doc", F.round("p", 4).alias("pressure"), F.round(F.col("p") / F.col("total"), 5).alias("share"))
