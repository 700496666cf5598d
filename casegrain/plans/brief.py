"""A case at a glance: documents by rank, findings, what is still needed, strongest relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Plain words for a channel's proof, and for what a document is.
PLAIN_CHANNEL = {1: "proof of what it cost you", 2: "proof they owed you something", 3: "proof of when it happened"}
PLAIN_ROLES = {
    "operative_pleading": "Your main court filing that starts the case", "responsive_pleading": "The other side's written answer", "order": "Something the judge decided", "instrument": "The contract or policy the dispute is about",
    "motion": "A request asking the judge to do something", "deposition": "Sworn testimony or a signed statement", "expert": "A report or estimate from a professional", "discovery": "Requests for information between the parties",
    "correspondence": "Letters and emails", "exhibit": "Supporting attachment", "unclassified": "Not yet sorted",
}


def _named(values: dict, c, other: str):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), F.lit(other))


def brief(docs: DataFrame, findings: DataFrame, supports: DataFrame, relations: DataFrame, most: int = 40) -> DataFrame:
    """case_id, documents, findings, relations: nested, each list in a fixed order and of bounded length.

    docs: case_id, source, rank, role; findings: as posture.resolve has them; supports:
    as posture.supports has them; relations: case_id, value, pressure, rank.  Of a case
    the first documents are named; they are found by parts, so that no task sees all.
    A finding says in plain words what is still needed, and where it is only asserted.
    """
    d = docs.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(64)))
    for by in (["case_id", "part"], ["case_id"]):
        d = d.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("rank", "source"))).where(F.col("r") <= most)
    d = d.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("r", "rank", "source", "role", _named(PLAIN_ROLES, F.col("role"), "Not yet sorted").alias("plain")))).alias("documents"))
    said = supports.select("case_id", "theory", F.when(F.col("channel") == "A", 1).when(F.col("channel") == "B", 2).otherwise(3).alias("predicted"), "asserted_at")
    need = F.when(F.col("resolved"), "").otherwise(_named(PLAIN_CHANNEL, F.col("predicted"), "supporting proof"))
    f = findings.join(said, ["case_id", "theory", "predicted"], "left")
    f = f.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("theory", "supported", "folded", "resolved", "asserted_only", need.alias("need"), F.coalesce("asserted_at", F.lit("")).alias("asserted_at")))).alias("findings"))
    r = relations.where("rank <= 8").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "pressure"))).alias("relations"))
    return d.join(f, "case_id", "left").join(r, "case_id", "left")


def as_text(b: DataFrame) -> DataFrame:
    """case_id, documents, findings, needs, relations: a brief's lists as text, parted by '; '."""
    text = lambda c, f: F.coalesce(F.concat_ws("; ", F.transform(c, f)), F.lit(""))
    state = lambda x: F.when(x["resolved"], " resolved").when(x["asserted_only"], " asserted only").otherwise(" open")
    return b.select(
        "case_id", text("documents", lambda x: F.concat(x["rank"].cast("string"), F.lit(" "), x["role"], F.lit(" "), x["source"].cast("string"))).alias("documents"),
        text("findings", lambda x: F.concat(x["theory"], F.lit(" "), x["supported"].cast("string"), F.lit(" "), x["folded"], state(x))).alias("findings"),
        text(F.filter("findings", lambda x: ~x["resolved"]), lambda x: F.concat(x["theory"], F.lit(" "), x["need"])).alias("needs"), text("relations", lambda x: x["value"]).alias("relations"),
    )
