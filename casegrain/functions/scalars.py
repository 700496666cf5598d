"""Scalar functions on columns: dates, numbers, names, versions, markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_of(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def safe_number(c: Column) -> Column:
    """A number written with thousands commas and a currency sign; null if it is none."""
    return F.regexp_replace(F.trim(c), r"[$,\s]", "").try_cast("double")


def stale(year: Column, as_of_year: int, years: int = 15) -> Column:
    """Whether a year (as text) is more than so many years back from a given one; what is no year is not stale."""
    y = F.trim(year).try_cast("int")
    return F.coalesce((y > 0) & (F.lit(as_of_year) - y > years), F.lit(False))


def iso_date(c: Column) -> Column:
    """A date of the exact form YYYY-MM-DD, else null."""
    return F.when(F.rlike(c, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.try_to_date(c, "yyyy-MM-dd"))


def first_sentence(c: Column, most: int = 180) -> Column:
    """The text, its blanks made single, up to its first full stop, question or exclamation mark before a blank or the end; all of it if there is none."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    mark = F.regexp_extract(flat, r"(?d)^(.*?[.!?])(?:\s|$)", 1)
    return F.rtrim(F.left(F.when(mark != "", mark).otherwise(flat), F.lit(most)))


def shortened(c: Column, most: int) -> Column:
    """A text with single blanks, cut to at most so many characters with dots behind."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(max(1, most - 3))), F.lit("...")))


def safe_name(c: Column, most: int = 80) -> Column:
    """A name for a file: letters, digits and _-. only, 'item' if nothing is left."""
    t = F.left(F.regexp_replace(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""), F.lit(most))
    return F.when(t == "", "item").otherwise(t)


def version(c: Column) -> Column:
    """A dotted version as an array of numbers, which compares part by part; parts that are no number are 0."""
    return F.transform(F.split(c, r"\."), lambda x: F.coalesce(F.regexp_extract(x, "^[0-9]+", 0).try_cast("int"), F.lit(0)))


def source_markers(c: Column) -> Column:
    """Markers of sources in a text: [ABC:..] with a scheme of three capitals, and [name:line]."""
    return F.regexp_extract_all(c, F.lit(r"(\[[A-Z]{3}:[^\]]+\]|\[[A-Za-z0-9_. -]+:[0-9]+\])"), F.lit(1))


def ordered_union(*arrays: Column) -> Column:
    """Elements of arrays in order, each where it comes first; null arrays count as empty."""
    return F.array_distinct(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))


def json_answer(c: Column, schema: str) -> Column:
    """A JSON answer as a struct; text that is none gives null, which counts as a disagreement."""
    return F.from_json(c, schema)


def escaped(c: Column) -> Column:
    """A text for use in markup: &, < and > as entities."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(c: Column) -> Column:
    """The inverse of escaped; &amp; comes last, so that an entity that the text itself holds stays one."""
    return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def stable_id(*parts: Column) -> Column:
    """An id of 16 hexadecimal digits that follows from its parts; null counts as empty."""
    return F.left(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(16))
