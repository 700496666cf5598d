"""Transition maps: documents as edges between channels, their layers, points and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import CHANNELS
from .points import top_points
from .status import name_of, rank_of


def channel_of(kind: Column) -> Column:
    """Channel code of an observation's kind: 1 matter, 2 relation, 3 chronology, 0 none; exact names before parts of names."""
    k = F.upper(F.trim(F.coalesce(kind, F.lit(""))))
    has = lambda words: F.rlike(k, F.lit("|".join(words)))
    return (
        F.when(k.isin(CHANNELS["A"]) | has(["MONEY", "AMOUNT", "MEASURE", "DAMAGE"]), 1).when(k.isin(CHANNELS["B"]) | has(["PARTY", "COURT", "CITE", "STATUTE", "AUTHORITY"]), 2)
        .when(k.isin(CHANNELS["C"]) | has(["DATE", "YEAR", "DOCKET", "TIME", "EVENT"]), 3).otherwise(0)
    )


def anchors(spark) -> DataFrame:
    """node, channel, anchor: the four fixed nodes that documents lead between."""
    return spark.createDataFrame([(f"anchor:{n}", c, k) for n, c, k in (("ZERO", 0, 0), ("A", 1, 66), ("B", 2, 90), ("C", 3, 120))], "node string, channel int, anchor int")


def document_edges(top: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, p1, p2, p3, left, right, residue: a document leads from the strongest channel of its top floats to the second (0 if there is none).

    top: doc, kind, pressure of its 20 strongest floats; equal channels go by their anchor.
    """
    x = top.withColumn("ch", channel_of(F.col("kind")))
    g = x.groupBy(doc).agg(*[F.round(F.sum(F.when(F.col("ch") == c, F.col("pressure")).otherwise(0.0)), 4).alias(f"p{c}") for c in (1, 2, 3)])
    order = F.array_sort(F.filter(F.array(*[F.struct((-F.col(f"p{c}")).alias("m"), F.lit(c).alias("c")) for c in (1, 2, 3)]), lambda s: s["m"] < 0))
    pick = lambda n: F.coalesce(F.try_element_at(order, F.lit(n))["c"], F.lit(0))
    g = g.withColumn("left", pick(1)).withColumn("right", pick(2))
    return g.withColumn("residue", F.col("left").bitwiseXOR(F.col("right")))


def authority_edges(authorities: DataFrame, key: str) -> DataFrame:
    """key, left, right, residue, pressure, status: attached authorities lead from relation to the baseline with the status they were stored with."""
    return authorities.select(key, F.lit(2).alias("left"), F.lit(0).alias("right"), F.lit(2).alias("residue"), F.round(F.coalesce("total_pressure", F.lit(0.0)), 8).alias("pressure"), name_of(rank_of(F.col("bracket"))).alias("status"))


def layers(edges: DataFrame, layer_pressures: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, layer, channel, pressure: the three layers of each document, also those without points.

    layer_pressures: doc, layer, pressure of each layer's 20 strongest points.
    """
    s = edges.select(doc, F.inline(F.array(*[F.struct(F.lit(n).alias("pos"), F.lit(l).alias("layer"), F.col(c).alias("channel")) for n, (l, c) in enumerate((("FLOAT", "left"), ("MIX", "right"), ("STIR", "residue")))])))
    return s.join(layer_pressures, [doc, "layer"], "left").select(doc, "pos", "layer", "channel", F.coalesce("pressure", F.lit(0.0)).alias("pressure"))


def point_nodes(points: DataFrame, most: int = 16) -> DataFrame:
    """doc, layer, rank, kind, value, channel, pressure, parts: the first points of each layer of a document, with their components.

    points: doc, layer, kind, value, hits, pressure, place (order of their first hit).
    """
    t = top_points(points.withColumn("_p", F.lit(0)), ["doc", "layer"], most, ["place"]).drop("_p")
    parts = F.when(F.col("layer") == "FLOAT", F.array().cast("array<struct<kind:string,value:string>>")).otherwise(relation_parts(F.col("value")))
    return t.select("doc", "layer", "rank", "kind", "value", channel_of(F.col("kind")).alias("channel"), "pressure", parts.alias("parts"))


def inner_views(nodes: DataFrame) -> DataFrame:
    """doc, layer, rank, part, kind, value, channel, pressure, residue: what stands inside the points of two components or more, in order.

    pressure: the point's, shared among its components; residue: of a component with the next, null at the last.
    """
    n = F.size("parts")
    x = nodes.where(n > 1).select("doc", "layer", "rank", F.col("pressure").alias("whole"), n.alias("n"), F.posexplode("parts").alias("part", "p"))
    x = x.select("doc", "layer", "rank", "part", "p.kind", "p.value", channel_of(F.col("p.kind")).alias("channel"), F.round(F.col("whole") / F.col("n"), 8).alias("pressure"))
    return x.withColumn("residue", F.col("channel").bitwiseXOR(F.lead("channel").over(Window.partitionBy("doc", "layer", "rank").orderBy("part"))))


def sequence_edges(nodes: DataFrame, by: list[str], pos: str) -> DataFrame:
    """by, pos, residue, pressure: edges between consecutive nodes with their mean pressure."""
    w = Window.partitionBy(*by).orderBy(pos)
    x = nodes.withColumn("c2", F.lead("channel").over(w)).withColumn("q2", F.lead("pressure").over(w)).where("c2 is not null")
    return x.select(*by, pos, F.col("channel").bitwiseXOR(F.col("c2")).alias("residue"), F.round((F.col("pressure") + F.col("q2")) / 2, 3).alias("pressure"))


# The two ways in which a relation's text names its components.
BRACKETED = r"[FMS]\[([A-Z_]+)[:=]([^\[\]]{1,160})\]"
_PLAIN = r"^([A-Z_]+)[:=](.+)$"


def relation_parts(c: Column, most: int = 10) -> Column:
    """Components (kind, value) of a relation's text, the first ones, each once.

    F[KIND:value] and the like if there are any, else what stands between <-> and |,
    as KIND=value or, without a kind, as RELATION.
    """
    clean = lambda x: F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, 120)
    part = lambda k, v: F.struct(k.alias("kind"), clean(v).alias("value"))
    got = lambda g: F.regexp_extract_all(c, F.lit(BRACKETED), F.lit(g))
    marked = F.zip_with(got(1), got(2), part)
    pieces = F.filter(F.split(c, r"<->|\|"), lambda x: F.trim(x) != "")
    plain = F.transform(pieces, lambda x: F.when(F.rlike(x, F.lit(_PLAIN)), part(F.regexp_extract(x, _PLAIN, 1), F.regexp_extract(x, _PLAIN, 2))).otherwise(part(F.lit("RELATION"), x)))
    return F.slice(F.array_distinct(F.when(F.size(marked) > 0, marked).otherwise(plain)), 1, most)


def endpoint_groups(edges: DataFrame, text: str | None = None) -> DataFrame:
    """left, right, documents, pressure: edges by their directed ends, of the documents that match a text if one is given."""
    x = edges if text is None else edges.where(F.contains(F.lower(F.col("doc").cast("string")), F.lit(text.lower())))
    return x.groupBy("left", "right").agg(F.count("*").alias("documents"), F.round(F.sum("pressure"), 2).alias("pressure"))


def projections(edges: DataFrame, by: str) -> DataFrame:
    """by, role, channel, pressure, document, status: the six readings of a case's map; ties go by document.

    edges: by, doc, p1, p2, p3, residue, pressure, status.  The Clerk counts documents,
    the Advocate names the strongest, the Opposition the least represented channel with
    the weakest document, the Precedent Judge holds the statuses, the Forecaster names
    the strongest one's residue, the Recorder signs.
    """
    g = edges.groupBy(by).agg(
        F.count("*").alias("documents"), F.max(F.struct("pressure", "doc", "residue", "status")).alias("hi"), F.min(F.struct("pressure", "doc")).alias("lo"), F.sum("pressure").alias("total"),
        *[F.round(F.sum(f"p{c}"), 4).alias(f"t{c}") for c in (1, 2, 3)], name_of(F.min(rank_of(F.col("status")))).alias("floor"),
    )
    absent = F.array_sort(F.array(*[F.struct(F.col(f"t{c}").alias("t"), F.lit(c).alias("c")) for c in (1, 2, 3)]))[0]["c"]
    none = F.lit(None).cast(dict(edges.dtypes)["doc"])
    rows = [
        ("Clerk", F.lit(0), F.lit(0.0), none, F.col("floor")), ("Advocate", F.col("hi.residue"), F.col("hi.pressure"), F.col("hi.doc"), F.col("hi.status")), ("Opposition", absent, F.col("lo.pressure"), F.col("lo.doc"), F.col("floor")),
        ("Precedent Judge", F.lit(2), F.col("total"), none, F.col("floor")), ("Forecaster", F.col("hi.residue"), F.col("hi.pressure"), F.col("hi.doc"), F.col("hi.status")), ("Recorder", F.lit(0), F.lit(0.0), none, F.col("floor")),
    ]
    made = F.array(*[F.struct(F.lit(r).alias("role"), c.cast("int").alias("channel"), F.round(p, 4).alias("pressure"), d.alias("document"), s.alias("status")) for r, c, p, d, s in rows])
    return g.select(by, "documents", F.inline(made))


def map_signature(records: DataFrame, by: str) -> DataFrame:
    """by, documents, input_signature of a map's inputs: by, doc, status, pattern_signature, counts and pressure of each document.

    Documents' digests are added up, so the signature does not depend on their order and
    no task gathers a case.  A map that was kept under an equal signature is still valid.
    """
    one = F.sha2(F.to_json(F.struct("doc", "status", "pattern_signature", "float_points", "mix_points", "stir_points", "total_pressure")), 256)
    x = records.select(by, *[F.conv(F.substring(one, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)").alias(f"s{k}") for k in range(4)])
    g = x.groupBy(by).agg(F.count("*").alias("documents"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(4)])
    return g.select(by, "documents", F.sha2(F.concat_ws("|", "documents", *[F.col(f"s{k}").cast("string") for k in range(4)]), 256).alias("input_signature"))


def changed(now: DataFrame, kept: DataFrame, by: str) -> DataFrame:
    """by of the maps that must be made again: new ones and those whose inputs changed (both: by, input_signature)."""
    return now.join(kept.select(by, F.col("input_signature").alias("old")), by, "left").where("old is null or old <> input_signature").select(by)


def breadcrumbs(spark, nodes: DataFrame, depth: int = 5) -> DataFrame:
    """id, path: each node's way to its root (nodes: id, parent); a cycle ends at the depth."""
    out = nodes.select("id", F.col("parent").alias("up"), F.col("id").cast("string").alias("path"))
    step = nodes.select(F.col("id").alias("at"), F.col("parent").alias("next"))
    for _ in range(depth - 1):
        j = out.join(step, out.up == step["at"], "left")
        out = j.select("id", F.col("next").alias("up"), F.when(F.col("at").isNotNull(), F.concat_ws(" > ", F.col("at").cast("string"), "path")).otherwise(F.col("path")).alias("path"))
    return out.select("id", "path")
