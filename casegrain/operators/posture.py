"""Which elements of the theories that a case pleads its lines support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P

CODE = {"ZERO": 0, "A": 1, "B": 2, "C": 3}
NAME = {v: k for k, v in CODE.items()}
#: Anchors of the channels.
ANCHOR = {"ZERO": 0, "A": 66, "B": 90, "C": 120}
#: Stands for a match in a clause; no text holds it.
_SPOT = "\u0001"
_ENDS = r"[.;:\n]"
_CUT = rf"(?i)({P.DENIAL})(?:\s+that)?(?:[^.;:\n]{{0,{P.DENIAL_REACH}}}?{P.DENIAL}(?:\s+that)?)*[^.;:\n]{{0,{P.DENIAL_REACH}}}{_SPOT}?"
#: Pairs of groups over which a first-few list is built in two steps.
_PARTS = 64


def _is(c: Column, pattern: str) -> Column:
    """Whether a pattern stands in a text; letters of all scripts make words."""
    return F.rlike(c, F.lit("(?U)" + P.java(pattern)))


def _asserts(clause: Column) -> Column:
    """Whether a clause negates nothing; 'not only' is no negation."""
    return ~_is(F.regexp_replace(clause, r"(?i)\bnot\s+only\b", ""), P.NEGATION)


def _undenied(clause: Column) -> Column:
    """The clause without what a denial before it reaches; what is left of a cut word begins none."""
    return F.regexp_replace(clause, P.java(_CUT), "$1 _")


def affirmed_text(c: Column) -> Column:
    """What a text affirms: its clauses that negate nothing, without what is denied, parted by '; '.

    A clause ends at . ; : and line ends.  A pattern that holds none of these stands in
    an affirmed place of the text if it stands in this.
    """
    return F.concat_ws("; ", F.transform(F.filter(F.split(c, _ENDS), lambda x: (x != "") & _asserts(x)), _undenied))


def affirmed(c: Column, pattern: str) -> Column:
    """Whether a pattern (without clause ends in it) stands in a clause that neither negates nor denies it."""
    return _is(c, "(?i)" + pattern) & _is(affirmed_text(c), "(?i)" + pattern)


def affirmed_match(c: Column, match: Column) -> Column:
    """Whether a literal part of a text stands somewhere affirmed; marks inside it end no clause."""
    spots = F.split(F.replace(c, match, F.lit(_SPOT)), _ENDS)
    return F.exists(spots, lambda x: F.contains(x, F.lit(_SPOT)) & _asserts(x) & F.contains(_undenied(x), F.lit(_SPOT)))


def amount_kind(c: Column) -> Column:
    """An amount counts as beyond the benefit only where its own line says so."""
    return F.when(_is(c, P.EXTRA_AMOUNT), "MONEY_EXTRA").otherwise("MONEY_BENEFIT")


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(P.java(pattern)), F.lit(group))


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def matter(c: Column) -> Column:
    """Array of (kind, value, amount): affirmed sums of money, in figures or in words, and measures of a line, in this order.

    Sums and measures of nothing are left out; money in words has no amount.
    """
    one = lambda kind, value, amount: F.struct(kind.alias("kind"), value.alias("value"), amount.alias("amount"))
    figures = F.arrays_zip(_all(c, P.MONEY, 0).alias("m"), _all(c, P.MONEY, 1).alias("a"), _all(c, P.MONEY, 2).alias("b"), _all(c, P.MONEY, 3).alias("d"))
    money = F.transform(figures, lambda x: F.struct(x["m"].alias("m"), _number(F.coalesce(F.nullif(x["a"], F.lit("")), F.nullif(x["b"], F.lit("")), x["d"])).alias("n")))
    words = F.arrays_zip(_all(c, P.WRITTEN_MONEY, 0).alias("m"), _all(c, P.WRITTEN_MONEY, 1).alias("w"))
    extent = F.transform(F.arrays_zip(_all(c, P.EXTENT, 0).alias("m"), _all(c, P.EXTENT, 1).alias("a")), lambda x: F.struct(x["m"].alias("m"), _number(x["a"]).alias("n")))
    kind = amount_kind(c)
    return F.concat(
        F.transform(F.filter(money, lambda x: (x["n"] > 0) & affirmed_match(c, x["m"])), lambda x: one(kind, F.trim(x["m"]), x["n"])),
        F.transform(F.filter(words, lambda x: affirmed_match(c, x["m"])), lambda x: one(kind, F.initcap(F.trim(x["w"])), F.lit(None).cast("double"))),
        F.transform(F.filter(extent, lambda x: (x["n"] > 0) & affirmed_match(c, x["m"])), lambda x: one(F.lit("MEASURE"), F.trim(x["m"]), x["n"])),
    )


def _maybe_matter(c: Column) -> Column:
    """Matter only where a line holds a figure or DOLLARS at all."""
    return F.when(_is(c, r"[0-9]|DOLLARS"), matter(c)).otherwise(F.array().cast("array<struct<kind:string,value:string,amount:double>>"))


def amounts(lines: DataFrame, key: str) -> DataFrame:
    """key, line, pos, kind, value, amount of the matter in lines."""
    return lines.select(key, "line", F.posexplode(_maybe_matter(F.col("text"))).alias("pos", "m")).select(key, "line", "pos", "m.kind", "m.value", "m.amount")


def adverse_pattern(lines: DataFrame, by: str, source: str, least: int = 3) -> DataFrame:
    """by, events, sufficient, since, until: adverse events of a group, several of one date (else of one source) counted once.

    Dates are those of the first and the last event that has one, in order of the
    record.  lines: by, source, line, text, of papers that are no pleadings.
    """
    day = F.regexp_extract("text", P.java(P.DAY), 0)
    place = F.struct(F.col(source), F.col("line"))
    x = lines.where(_is(F.col("text"), P.ADVERSE)).select(by, day.alias("day"), F.when(day != "", day).otherwise(F.col(source).cast("string")).alias("event"), place.alias("place"))
    e = x.groupBy(by, "event").agg(F.min("place").alias("place"), F.max("day").alias("day"))
    dated = F.col("day") != ""
    return e.groupBy(by).agg(
        F.count("*").alias("events"), (F.count("*") >= least).alias("sufficient"), F.min_by("day", F.when(dated, F.col("place"))).alias("since"), F.max_by("day", F.when(dated, F.col("place"))).alias("until")
    )


def pleaded(lines: DataFrame, by: str) -> DataFrame:
    """by, theory: the theories that the operative pleading asserts (lines: by, role, text)."""
    t = F.col("text")
    hits = []
    for theory, pattern in P.PLEADED:
        if ".{" in pattern:  # it may run over clause ends: the clauses that it touches count as one
            around = _all(t, rf"(?i)[^.;:\n]*{pattern}[^.;:\n]*", 0)
            spot = lambda x, pattern=pattern: F.regexp_replace(x, P.java("(?i)" + pattern), _SPOT)
            ok = F.exists(around, lambda x: _asserts(x) & F.contains(_undenied(spot(x)), F.lit(_SPOT)))
        else:
            ok = affirmed(t, pattern)
        hits.append(F.when(_is(t, "(?i)" + pattern) & ok, F.lit(theory)))
    return lines.where(F.col("role").isin(P.DEFINING)).select(by, F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("theory")).distinct()


def supports(lines: DataFrame, by: str) -> DataFrame:
    """by, theory, element, channel, support, cites, asserted, asserted_at for each element of the theories pleaded.

    lines: by, source, line, role, text.  A pleading asserts, only other papers support.
    The first four places of support and the first three of assertion are named, in
    order of source and line.  The fifteen elements are literals of the plan: each line
    is held against them in one pass, and negation is tested once for each clause.
    """
    theories = pleaded(lines, by)
    x = lines.where("text is not null").select(by, "source", "line", "text", F.col("role").isin(P.ASSERTING).alias("pleading"), F.transform(_maybe_matter(F.col("text")), lambda m: m["kind"]).alias("kinds"), affirmed_text(F.col("text")).alias("said"))
    hits = []
    for theory, element, channel, pattern, kinds in P.THEORIES:
        there = _is(F.col("said"), "(?i)" + pattern)
        if channel == "A":
            some = F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in kinds])) if kinds else F.size("kinds") > 0
            there = some & (F.col("pleading") | there)
        hits.append(F.when(there, F.struct(F.lit(theory).alias("theory"), F.lit(element).alias("element"), F.lit(channel).alias("channel"))))
    found = x.select(by, "source", "line", "pleading", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select(by, "source", "line", "pleading", "h.*").join(theories, [by, "theory"], "left_semi")
    few = found.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(_PARTS)))
    group = [by, "theory", "element", "channel", "pleading"]
    for part in ([*group, "part"], group):
        w = Window.partitionBy(*part).orderBy("source", "line")
        few = few.withColumn("r", F.row_number().over(w)).where("r <= if(pleading, 3, 4)")
    cite = F.struct("r", F.concat_ws(":", F.col("source").cast("string"), F.col("line").cast("string")).alias("c"))
    named = lambda p: F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.when(F.col("pleading") == p, cite))), lambda s: s["c"]))
    places = few.groupBy(*group[:-1]).agg(named(False).alias("cites"), named(True).alias("asserted_at"))
    n = found.groupBy(*group[:-1]).agg(F.sum((~F.col("pleading")).cast("long")).alias("support"), F.sum(F.col("pleading").cast("long")).alias("asserted"))
    return n.join(places, group[:-1]).select(by, "theory", "element", "channel", "support", "cites", "asserted", "asserted_at")


def resolve(theories: DataFrame, sup: DataFrame, patterns: DataFrame, by: str) -> DataFrame:
    """by, theory, supported, folded, predicted, resolved, asserted_only, noted: a row for each theory pleaded.

    Two supported channels predict the third (their XOR); the theory resolves if that is
    supported too.  asserted_only: the predicted element stands in pleadings only.
    noted: a pattern of adverse events stands in for conduct that nothing supports;
    it satisfies nothing.
    """
    g = sup.groupBy(by, "theory").agg(
        *[F.max(((F.col("channel") == c) & (F.col("support") > 0)).cast("int")).alias(c) for c in "ABC"], *[F.max(((F.col("channel") == c) & (F.col("asserted") > 0)).cast("int")).alias(f"s{c}") for c in "ABC"]
    )
    x = theories.join(g, [by, "theory"], "left").fillna(0, [*"ABC", "sA", "sB", "sC"]).join(patterns.select(by, "sufficient"), by, "left").fillna(False, ["sufficient"])
    n = F.col("A") + F.col("B") + F.col("C")
    left = F.when(F.col("A") == 1, 1).when(F.col("B") == 1, 2).otherwise(3)
    right = F.when((F.col("A") == 1) & (F.col("B") == 1), 2).otherwise(3)
    x = x.withColumn("supported", n).withColumn("predicted", F.when(n >= 2, compose(left, right)).otherwise(0))
    only = lambda c, k: (F.col("predicted") == k) & (F.col(c) == 0) & (F.col("s" + c) == 1)
    folded = F.concat_ws("+", *[F.when(F.col(c) == 1, c) for c in "ABC"])
    return x.select(
        by, "theory", "supported", F.when(n >= 2, F.substring(folded, 1, 3)).otherwise(folded).alias("folded"), "predicted", (n == 3).alias("resolved"),
        (only("A", 1) | only("B", 2) | only("C", 3)).alias("asserted_only"), (F.col("sufficient") & (F.col("C") == 0)).alias("noted"),
    )


def compose(a: Column, b: Column) -> Column:
    """Residue of two channel codes."""
    return a.bitwiseXOR(b)
