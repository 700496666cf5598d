"""Roles of documents by file name and opening text; the more authoritative of the two holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import NAME_ROLES, ROLES, TEXT_ROLES, java

_RANK = {r: k for r, k, _ in ROLES}


def _first(c: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit(99)
    for pattern, role in reversed(rules):
        out = F.when(F.rlike(c, F.lit(java("(?i)" + pattern))), _RANK[role]).otherwise(out)
    return out


def role_rank(name: Column, text: Column) -> Column:
    """Rank of a document's role, 99 if nothing tells; null name and text tell nothing."""
    spaced = F.regexp_replace(F.coalesce(name, F.lit("")), r"[_.\-]+", " ")
    return F.least(_first(spaced, NAME_ROLES), _first(F.substring(F.coalesce(text, F.lit("")), 1, 4000), TEXT_ROLES))


def with_role(docs: DataFrame, name: str, text: str) -> DataFrame:
    """docs with rank and role; the small role table is a map in the plan."""
    m = F.create_map(*[x for r, k, _ in ROLES for x in (F.lit(k), F.lit(r))])
    return docs.withColumn("rank", role_rank(F.col(name), F.col(text))).withColumn("role", F.element_at(m, F.col("rank")))
