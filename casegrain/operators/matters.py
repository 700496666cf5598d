"""Documents of a case grouped into matters: captions define them, numbers attach the rest by precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P


def party_words(c: Column) -> Column:
    """Sorted distinct words of a party's name, of three letters or more, without forms and filler."""
    clean = F.regexp_replace(F.regexp_replace(c, P.CAPTION_NOISE, " "), "[^A-Za-z ]+", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(clean), r"\s+"), lambda w: F.length(w) > 2)))


def read_signals(docs: DataFrame, key: str, case: str = "case_id", name: str | None = None, text: str = "text") -> DataFrame:
    """case_id, doc, plaintiff, defendant, docket, claim, filed, draft, caption_key from each text's first 3000 characters.

    What is not there is ''.  A draft's mark may stand in the file's name too.
    Documents without a case make up one case of their own, ''.
    """
    head = F.substring(F.coalesce(F.col(text), F.lit("")), 1, 3000)
    got = lambda c, p, g: F.trim(F.regexp_extract(c, P.java(p), g))
    named = got(F.coalesce(F.col(name), F.lit("")), P.DRAFT, 0) if name else F.lit("")
    x = docs.select(
        F.coalesce(F.col(case).cast("string"), F.lit("")).alias("case_id"), F.col(key).alias("doc"), got(head, P.CAPTION, 1).alias("plaintiff"), got(head, P.CAPTION, 2).alias("defendant"),
        got(head, P.CASE_NUMBER, 1).alias("docket"), F.upper(got(head, P.CLAIM_NUMBER, 1)).alias("claim"), got(head, P.FILED, 0).alias("filed"), F.coalesce(F.nullif(named, F.lit("")), got(head, P.DRAFT, 0)).alias("draft"),
    )
    k = F.when((F.col("plaintiff") != "") & (F.col("defendant") != ""), F.concat_ws("|", F.concat_ws(" ", party_words(F.col("plaintiff"))), F.concat_ws(" ", party_words(F.col("defendant"))))).otherwise("")
    return x.withColumn("caption_key", k)


def matters(signals: DataFrame) -> DataFrame:
    """case_id, caption_key, first_doc, plaintiff, defendant, label, documents, dockets, claims, marked: one row for each caption of a case.

    A matter is named by its first document and has that one's parties; marked counts
    the documents with a court's mark.
    """
    s = signals.where("caption_key <> ''")
    first = lambda c: F.min_by(c, "doc").alias(c)
    g = s.groupBy("case_id", "caption_key").agg(
        F.min("doc").alias("first_doc"), first("plaintiff"), first("defendant"), F.count("*").alias("documents"), F.sum((F.col("filed") != "").cast("long")).alias("marked"),
        F.array_sort(F.collect_set(F.when(F.col("docket") != "", F.col("docket")))).alias("dockets"), F.array_sort(F.collect_set(F.when(F.col("claim") != "", F.col("claim")))).alias("claims"),
    )
    return g.withColumn("label", label(F.col("plaintiff"), F.col("defendant")))


def _index(signals: DataFrame, ms: DataFrame, what: str) -> DataFrame:
    """Each number of a case with the matters that use it: how many, and the first."""
    s = signals.where(f"caption_key <> '' and {what} <> ''").select("case_id", "caption_key", what).distinct().join(ms.select("case_id", "caption_key", "first_doc"), ["case_id", "caption_key"])
    return s.groupBy("case_id", what).agg(F.count("*").alias("owners"), F.min("first_doc").alias("matter"))


def assign(signals: DataFrame) -> DataFrame:
    """case_id, doc, matter (its first document), how: by caption, else an unambiguous docket, else an unambiguous claim, else the claim's first owner, else none."""
    ms = matters(signals)
    m = ms.select("case_id", "caption_key", F.col("first_doc").alias("m1"))
    d = _index(signals, ms, "docket").where("owners = 1").select("case_id", "docket", F.col("matter").alias("m2"))
    c = _index(signals, ms, "claim").select("case_id", "claim", "owners", F.col("matter").alias("m3"))
    x = signals.join(m, ["case_id", "caption_key"], "left").join(d, ["case_id", "docket"], "left").join(c, ["case_id", "claim"], "left")
    how = F.when(F.col("m1").isNotNull(), "caption").when(F.col("m2").isNotNull(), "docket").when(F.col("owners") == 1, "claim").when(F.col("owners") > 1, "first owner of claim").otherwise("none")
    return x.select("case_id", "doc", F.coalesce("m1", "m2", "m3").alias("matter"), how.alias("how"))


def states(signals: DataFrame, assigned: DataFrame) -> DataFrame:
    """case_id, matter, state, documents: filed once a docket or a court's mark on any of its documents shows it, else building.

    A draft's mark overrides neither.
    """
    ms = matters(signals).select("case_id", F.col("first_doc").alias("matter"), F.size("dockets").alias("numbers"))
    marked = signals.select("case_id", "doc", "filed").join(assigned.where("matter is not null").select("case_id", "doc", "matter"), ["case_id", "doc"]).groupBy("case_id", "matter").agg(F.count("*").alias("documents"), F.sum((F.col("filed") != "").cast("long")).alias("marked"))
    return ms.join(marked, ["case_id", "matter"]).select("case_id", "matter", F.when((F.col("numbers") > 0) | (F.col("marked") > 0), "filed").otherwise("building").alias("state"), "documents")


def links(signals: DataFrame) -> DataFrame:
    """case_id, why ('claim' or 'party'), value, matter, members: the matters of a case that share a claim number or a party's word.

    A row for each matter that is linked, with how many are by that value: any two of
    its matters are linked, and no pairs are made of them.
    """
    ms = matters(signals)
    names = F.array_union(party_words(F.col("plaintiff")), party_words(F.col("defendant")))
    one = lambda why, values: ms.select("case_id", F.lit(why).alias("why"), F.explode(values).alias("value"), F.col("first_doc").alias("matter"))
    x = one("claim", F.col("claims")).unionByName(one("party", names)).distinct()
    n = x.groupBy("case_id", "why", "value").agg(F.count("*").alias("members")).where("members > 1")
    return x.join(n, ["case_id", "why", "value"])


def label(plaintiff: Column, defendant: Column) -> Column:
    """'Surname v. First Three Words' of a caption."""
    drop = ["the", "and", "of", "inc", "llc", "pllc", "corp", "corporation", "company", "co", "ltd", "lp", "llp"]

    def words(c: Column) -> Column:
        first = F.element_at(F.split(F.trim(c), r"\s+and\s+|\s*,\s*", 2), 1)
        return F.filter(F.split(first, r"[\s,.]+"), lambda w: (w != "") & ~F.lower(w).isin(drop))

    left = F.initcap(F.coalesce(F.try_element_at(words(plaintiff), F.lit(-1)), F.lit("")))
    right = F.initcap(F.concat_ws(" ", F.slice(words(defendant), 1, 3)))
    return F.when((left != "") & (right != ""), F.concat(left, F.lit(" v. "), right)).otherwise(F.coalesce(F.nullif(left, F.lit("")), F.nullif(right, F.lit("")), F.lit("Unassigned")))


def numbered(ms: DataFrame, width: int = 12) -> DataFrame:
    """matters with matter_no, their number within the case by first document, and matter_id.

    Numbers are counted in ranges of 2^width ids and shifted by what the ranges before
    hold, so no task sees a whole case.  first_doc is a number and unique.
    """
    x = ms.withColumn("_range", F.shiftright("first_doc", width))
    before = x.groupBy("case_id", "_range").agg(F.count("*").alias("n"))
    w = Window.partitionBy("case_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("case_id", "_range", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    no = F.row_number().over(Window.partitionBy("case_id", "_range").orderBy("first_doc")) + F.col("before")
    x = x.join(before, ["case_id", "_range"]).withColumn("matter_no", no.cast("int")).drop("_range", "before")
    return x.withColumn("matter_id", F.format_string("MATTER-%02d", "matter_no"))
