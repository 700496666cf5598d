"""Hash chains, evidence integrity, rules over texts and merges by origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import PACK_ALIASES, RULES, java


def link_hash(*parts: Column) -> Column:
    """SHA-256 over parts in order, null as empty, parted by a unit separator."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA-256 as hex, of binary columns; keys of up to 64 bytes."""
    padded = F.rpad(key, 64, F.unhex(F.lit("00")))
    xor = lambda pad: F.unhex(F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.lpad(F.lower(F.hex(F.conv(F.hex(F.substring(padded, i, 1)), 16, 10).cast("int").bitwiseXOR(F.lit(pad)).cast("long"))), 2, "0"))))
    inner = F.unhex(F.sha2(F.concat(xor(0x36), message), 256))
    return F.sha2(F.concat(xor(0x5C), inner), 256)


def chain_breaks(log: DataFrame, by: list[str], seq: str, stamp: str, prev: str) -> DataFrame:
    """by, seq, why: entries whose number doesn't follow, or whose stored previous stamp is not the stamp before."""
    w = Window.partitionBy(*by).orderBy(seq)
    x = log.withColumn("_s", F.lag(seq).over(w)).withColumn("_h", F.lag(stamp).over(w))
    why = F.when(F.col("_s").isNotNull() & (F.col(seq) != F.col("_s") + 1), "gap").when(F.col("_h").isNotNull() & ~F.col(prev).eqNullSafe(F.col("_h")), "broken link")
    return x.withColumn("why", why).where("why is not null").select(*by, seq, "why")


def integrity(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, state: 'missing', 'size', 'hash' or 'ok' of what is expected (key, size, sha) against what is found."""
    j = expected.select(key, F.col("size").alias("s1"), F.col("sha").alias("h1")).join(found.select(key, F.col("size").alias("s2"), F.col("sha").alias("h2")), key, "left")
    state = F.when(F.col("s2").isNull(), "missing").when(F.col("s1") != F.col("s2"), "size").when(F.col("h1") != F.col("h2"), "hash").otherwise("ok")
    return j.select(key, state.alias("state"))


def pack_of(name: Column) -> Column:
    """Identifier of a rule pack by any of its names."""
    m = F.create_map(*[F.lit(x) for kv in PACK_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(F.trim(name))), F.upper(F.trim(name)))


def rule_findings(docs: DataFrame, key: str, pack: str, text: str = "text", kind: str | None = None, metadata: str | None = None, rules: list[tuple] | None = None) -> DataFrame:
    """key, pack, code, severity, authority: rules of a pack that a paper breaks; the rules are literals of the plan, so one pass does without a join.

    kind: column of the paper's kind (null: 'filing'), which some rules ask for;
    metadata: map column, whose missing and empty fields break what is required.  A null
    text breaks every rule of what is required and none of what is forbidden.
    rules: (type, code, severity, pattern or field, kinds, authority), by default the pack's own.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    k = F.lower(F.trim(F.coalesce(F.col(kind), F.lit("filing")))) if kind else F.lit("filing")
    hits = []
    for what, code, severity, pattern, kinds, authority in rules or RULES[pack]:
        if what == "metadata_required":
            broken = F.coalesce(F.try_element_at(F.col(metadata), F.lit(pattern)), F.lit("")) == "" if metadata else F.lit(True)
        else:
            there = F.rlike(t, F.lit(java("(?im)" + pattern)))
            broken = ~there if what == "required_pattern" else there
        if "*" not in kinds:
            broken = broken & k.isin(kinds)
        hits.append(F.when(broken, F.struct(F.lit(pack).alias("pack"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(authority).alias("authority"))))
    return docs.select(key, F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select(key, "h.*")


def preflight(docs: DataFrame, key: str, findings: DataFrame, pack: str) -> DataFrame:
    """key, pack, errors, warnings, passed for every paper; each has a warning to check the court's current local rules."""
    n = lambda s: F.sum((F.col("severity") == s).cast("long"))
    g = findings.groupBy(key).agg(n("error").alias("errors"), n("warning").alias("warnings"))
    x = docs.select(key).join(g, key, "left").fillna(0, ["errors", "warnings"])
    return x.select(key, F.lit(pack).alias("pack"), "errors", (F.col("warnings") + 1).alias("warnings"), (F.col("errors") == 0).alias("passed"))


def chain_state(log: DataFrame, by: list[str], seq: str, stamp: str, breaks: DataFrame, anchors: DataFrame) -> DataFrame:
    """by, events, head, state: a chain against the head that was kept outside (by, anchor_seq, anchor_stamp).

    'mismatch' if the chain is broken or has not the kept stamp at the kept number,
    'current' if that is its last entry, else 'extended'.  Without a kept head (number 0)
    an empty chain would be current, any other is extended.
    """
    g = log.groupBy(*by).agg(F.count("*").alias("events"), F.max_by(stamp, seq).alias("head"), F.max(seq).alias("last"))
    bad = breaks.select(*by).distinct().withColumn("bad", F.lit(True))
    kept = anchors.join(log.select(*by, F.col(seq).alias("anchor_seq"), F.col(stamp).alias("there")), [*by, "anchor_seq"], "left")
    x = g.join(kept, by, "left").join(bad, by, "left")
    at = F.coalesce("anchor_seq", F.lit(0))
    state = F.when(F.coalesce("bad", F.lit(False)), "mismatch").when(at == 0, "extended").when(F.coalesce(F.col("there") != F.col("anchor_stamp"), F.lit(True)), "mismatch").when(at == F.col("last"), "current").otherwise("extended")
    return x.select(*by, "events", "head", state.alias("state"))


def replace_origin(all_rows: DataFrame, new: DataFrame, origin: str, value: str) -> DataFrame:
    """All rows but those of an origin, and the new ones for it."""
    return all_rows.where(F.coalesce(F.col(origin), F.lit("")) != value).unionByName(new)


def manifest_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows that only one of two manifests has, with side 'a' or 'b'; repeats count."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
