"""Results as files: a corpus by case, a manifest, and a brief for people."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_corpus(lines: DataFrame, path: str) -> None:
    """Lines as Parquet, one folder for each case."""
    lines.write.mode("overwrite").partitionBy("case_id").parquet(path)


def manifest(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, size, sha of every text."""
    return docs.where(F.col(text).isNotNull()).select(key, F.length(text).alias("size"), F.sha2(F.col(text).cast("binary"), 256).alias("sha"))


def as_jsonl(df: DataFrame) -> DataFrame:
    """One column value: each row as JSON in the order of its fields."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def brief_markdown(row: dict) -> str:
    """A case's brief (a row of plans.brief) as text for people."""
    out = [f"# {row['case_id']}", ""]
    out += [f"- {d}" for d in row.get("documents", [])] + [""]
    for f in row.get("findings", []):
        out.append(f"* {f['theory']}: {f['supported']} of 3 elements supported" + ("" if f["resolved"] else f", open: {f['open']}"))
    return "\n".join(out) + "\n"


def canonical_json(value) -> str:
    """JSON with sorted keys and no blanks, for signatures."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
