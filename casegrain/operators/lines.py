"""Documents as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import NOISE_PREFIXES


def records(docs: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep, line, text, noise: the lines that are not blank, numbered from 1; noise marks bookkeeping lines of the reader.

    Null and empty texts have no line.  Lines end with \\n only.
    """
    x = docs.select(key, *keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "text"))
    noise = F.lit(False)
    for p in NOISE_PREFIXES:
        noise = noise | F.startswith(F.ltrim("text"), F.lit(p))
    return x.where(F.trim("text") != "").select(key, *keep, (F.col("pos") + 1).alias("line"), "text", noise.alias("noise"))


def explode_lines(docs: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep, line, text: the records without bookkeeping lines."""
    return records(docs, key, text, keep).where("not noise").drop("noise")


def consecutive(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """by, value, next: each row with the one after it; the last has none and is left out."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("next", F.lead(value).over(w)).where("next is not null")


def page_texts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, page, text: texts cut at the reader's page markers; what stands before the first is page 1 only if it is all there is."""
    x = docs.where(f"{text} is not null").select(key, F.posexplode(F.split(F.col(text), r"<<<PAGE [0-9]+>>>\n?", -1)).alias("pos", "text"), F.size(F.split(F.col(text), r"<<<PAGE [0-9]+>>>\n?", -1)).alias("n"))
    return x.where("(n = 1 or pos > 0)").select(key, F.greatest("pos", F.lit(1)).alias("page"), "text")
