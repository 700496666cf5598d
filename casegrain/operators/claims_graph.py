"""Nested claim graphs as rows: each claim with the last status of its history that was not contradicted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import version
from .status import name_of, rank_of

GRAPH = (
    "nodes array<struct<id:string,kind:string,statement:string,bracket:string,channel:string,sourceEvidenceIds:array<string>,provenanceRoots:array<string>,history:array<struct<action:string,fromBracket:string,toBracket:string>>>>, "
    "propositions array<struct<id:string,kind:string,statement:string,bracket:string,channel:string,sourceEvidenceIds:array<string>,provenanceRoots:array<string>,history:array<struct<action:string,fromBracket:string,toBracket:string>>>>, "
    "edges array<struct<id:string,fromNodeId:string,toNodeId:string,kind:string,bracket:string>>"
)


def parse(df: DataFrame, key: str, raw: str) -> DataFrame:
    """key, nodes, edges of JSON texts; text that is no JSON has no nodes."""
    g = F.from_json(F.col(raw), "struct<" + ", ".join(x.replace(" ", ":", 1) for x in GRAPH.split(", ")) + ">")
    return df.select(key, g.alias("g")).select(key, F.coalesce("g.nodes", "g.propositions").alias("nodes"), F.col("g.edges").alias("edges"))


def project(graphs: DataFrame, key: str) -> DataFrame:
    """key, node, statement, status, evidence: history newest last; a contradicted claim keeps what it had before."""
    x = graphs.select(key, F.explode("nodes").alias("n"))
    past = F.filter(F.reverse(F.coalesce("n.history", F.array())), lambda h: ~F.coalesce(F.lower(h["action"]), F.lit("")).contains("contradict"))
    status = F.coalesce(F.try_element_at(past, F.lit(1))["toBracket"], F.col("n.bracket"), F.lit("UNVERIFIED"))
    return x.select(key, F.col("n.id").alias("node"), F.trim("n.statement").alias("statement"), status.alias("status"), F.size(F.coalesce("n.sourceEvidenceIds", F.array())).alias("evidence"))


def edges(graphs: DataFrame, key: str) -> DataFrame:
    """key, edge, from_node, to_node, kind, status of the graphs' edges; unknown statuses count as unverified."""
    return graphs.select(key, F.explode("edges").alias("e")).select(key, F.col("e.id").alias("edge"), F.col("e.fromNodeId").alias("from_node"), F.col("e.toNodeId").alias("to_node"), F.col("e.kind").alias("kind"), name_of(rank_of(F.col("e.bracket"))).alias("status"))


def handoff(claims: DataFrame, graphs: DataFrame, key: str, least: str = "1.3.2") -> DataFrame:
    """key, state of each claim with the graph that is handed over for it: 'missing', 'not ready', 'revision', 'hash' or 'ok'.

    claims: key, revision, sha; graphs: key, ready, writer (a version), revision, sha.  A
    graph is ready if it says so and its writer is not older than least; an empty
    revision or hash agrees with nothing.
    """
    g = graphs.select(key, "ready", version(F.coalesce("writer", F.lit(""))).alias("writer"), F.col("revision").alias("g_revision"), F.lower("sha").alias("g_sha"), F.lit(True).alias("there"))
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    state = (
        F.when(F.col("there").isNull(), "missing").when(~F.coalesce("ready", F.lit(False)) | (F.col("writer") < version(F.lit(least))), "not ready")
        .when((some("revision") == "") | (some("revision") != some("g_revision")), "revision").when((some("sha") == "") | (F.lower(some("sha")) != some("g_sha")), "hash").otherwise("ok")
    )
    return claims.join(g, key, "left").select(key, state.alias("state"))
