"""All queries of the core, by name, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import spread, staged, table
from ..operators import carry, graph, ledger, lines, matters, parties, points, posture, quality, retrieve, roles, search, status
from . import expected as X

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}

QUESTION = "When did the insurer deny the claim and who measured the missing shingles on the roof?"
SEARCH_TEXT = "roof inspection"
TITLE_QUERY = "hardware supply"


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _u(pattern: str) -> str:
    """A pattern between word boundaries for a yes or no, with letters of all scripts in words."""
    return pattern.replace(r"\w", r"[\pL\pN_]").replace(r"(?i)\b", r"(?i)(?:^|[^\pL\pN_])", 1).replace(r"\b", r"(?:$|[^\pL\pN_])") if pattern.startswith("(?i)") else _u("(?i)" + pattern)


# -- documents as lines --------------------------------------------------------
def _case_sql(expr: str, rules: list, plain: tuple = ()) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({expr}, {_lit('(?i)' + p if k in plain else _u(p))}) THEN {k}" for k, p in rules) + " ELSE 99 END"


_ROLES = ", ".join(_lit(r) for r in X.ROLES[1:])
_ROLE = f"""ranked AS (SELECT file_id, case_id, original, ingested_at, least({_case_sql("regexp_replace(coalesce(original, ''), '[_.-]+', ' ', 'g')", X.BY_NAME)}, {_case_sql("coalesce(text, '')[1:4000]", X.BY_TEXT, (6, 9))}) AS rank
  FROM ingested_files f LEFT JOIN (SELECT file_id, text FROM extraction_results) e USING (file_id)),
roles AS (SELECT *, CASE WHEN rank = 99 THEN 'unclassified' ELSE [{_ROLES}][rank] END AS role FROM ranked)"""
_LINES = """records AS (
  SELECT extraction_id, file_id, case_id, CAST(i AS INTEGER) AS line, l AS text, starts_with(ltrim(l, ' '), '<<<SOURCE ') OR starts_with(ltrim(l, ' '), '<<<EXTRACTION ') AS noise
  FROM (SELECT extraction_id, file_id, case_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM extraction_results WHERE text IS NOT NULL)
  WHERE trim(l, ' ') <> ''),
lines AS (SELECT * FROM records WHERE NOT noise)"""


def _papers(spark: SparkSession, d: str) -> DataFrame:
    """The extracted texts with their file's name, rank and role."""
    files = table(spark, d, "ingested_files").select("file_id", "original")
    texts = spread(table(spark, d, "extraction_results").select("extraction_id", "file_id", "case_id", "text"))
    return roles.with_role(texts.join(files, "file_id", "left"), "original", "text")


def _records(spark: SparkSession, d: str) -> DataFrame:
    x = lines.records(_papers(spark, d), "extraction_id", keep=("case_id", "original", "rank", "role"))
    return x.withColumn("source", F.col("extraction_id").cast("string"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.explode_lines(spread(table(spark, d, "extraction_results").select("extraction_id", "text")), "extraction_id")


@_query(f"WITH {_LINES} SELECT extraction_id, line, text FROM lines")
def lines_explode(spark, d):
    return _lines(spark, d)


@_query(f"WITH {_ROLE} SELECT file_id, rank, role FROM roles")
def doc_roles(spark, d):
    f = table(spark, d, "ingested_files").select("file_id", "original").join(table(spark, d, "extraction_results").select("file_id", "text"), "file_id", "left")
    return roles.with_role(f, "original", "text").select("file_id", "rank", "role")


# -- questions -----------------------------------------------------------------
_TERMS = retrieve.question_terms(QUESTION)
_UNIQ = list(dict.fromkeys(_TERMS))
_TIMES = "terms(term, times) AS (VALUES " + ", ".join(f"({_lit(t)}, {_TERMS.count(t)})" for t in _UNIQ) + ")"
_DF = "CAST(sum(CASE WHEN contains(lower(text), term) THEN times ELSE 0 END) AS BIGINT)"


@_query(f"WITH {_LINES}, {_TIMES} SELECT term, {_DF} AS df, count(*) AS n, round(ln(1 + count(*) / (1 + {_DF})), 8) AS idf FROM records, terms GROUP BY term")
def term_idf(spark, d):
    return retrieve.idf_rows(lines.records(table(spark, d, "extraction_results"), "extraction_id"), _TERMS)


_SCORED = f"""w AS (SELECT coalesce(case_id, '') AS cid, term, times * round(ln(1 + count(*) / (1 + {_DF})), 8) AS idf FROM records, terms GROUP BY case_id, term, times),
bonus AS (SELECT e.extraction_id, sum(CASE WHEN contains(lower(coalesce(original, '')), term) THEN idf ELSE 0 END) AS b FROM extraction_results e LEFT JOIN ingested_files f USING (file_id) JOIN w ON w.cid = coalesce(e.case_id, '') GROUP BY e.extraction_id),
scored AS (SELECT r.extraction_id, r.case_id, r.line, round(sum(CASE WHEN contains(lower(r.text), term) THEN idf ELSE 0 END) + max(b), 8) AS score FROM records r JOIN w ON w.cid = coalesce(r.case_id, '') JOIN bonus USING (extraction_id) WHERE NOT noise GROUP BY r.extraction_id, r.case_id, r.line)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """The records of all cases, scored for the question; each case counts its own lines."""
    x = _records(spark, d).withColumn("_case", F.coalesce("case_id", F.lit("")))
    return retrieve.score_lines(x, _TERMS, "_case", "original").drop("_case")


@_query(f"WITH {_LINES}, {_TIMES}, {_SCORED} SELECT extraction_id, line, round(score, 6) AS score FROM scored WHERE score > 0")
def question_lines(spark, d):
    """Every line that says something of the question, by itself or by its file's name."""
    return _scored(spark, d).where("score > 0").select("extraction_id", "line", F.round("score", 6).alias("score"))


@_query(
    f"""WITH {_LINES}, {_TIMES}, {_SCORED}, best AS (SELECT *, row_number() OVER (PARTITION BY extraction_id ORDER BY score DESC, line) AS r FROM scored WHERE score > 0)
SELECT extraction_id, round(sum(score), 6) AS score, count(*) AS lines FROM best WHERE r <= 5 GROUP BY 1 ORDER BY score DESC, extraction_id LIMIT 20"""
)
def question_top_docs(spark, d):
    return retrieve.top_documents(_scored(spark, d), "extraction_id")


@_query(
    f"""WITH {_LINES}, s AS (SELECT *, CAST({' + '.join(f"(length(lower(text)) - length(replace(lower(text), {_lit(w)}, ''))) / {len(w)}" for w in SEARCH_TEXT.split())} AS INTEGER) AS score FROM lines)
SELECT extraction_id, line, text, score FROM s WHERE score > 0 ORDER BY score DESC, extraction_id, line LIMIT 50"""
)
def case_search(spark, d):
    return retrieve.search(_lines(spark, d), SEARCH_TEXT, "extraction_id", 50)


@_query()
def context_budget(spark, d):
    """Lines of each case that answer the question within 24,000 characters (a greedy fold, checked by tests)."""
    return retrieve.context(_scored(spark, d).select("case_id", "source", "rank", "line", "text", "noise", "score"))


_TOKENS = f"""tok AS (SELECT extraction_id AS doc, unnest(regexp_extract_all(text, {_lit(X.WORD)})) AS w, generate_subscripts(regexp_extract_all(text, {_lit(X.WORD)}), 1) AS pos FROM extraction_results WHERE text IS NOT NULL),
wg AS (SELECT doc, lower(w) AS value, count(*) AS n, min(pos) AS first FROM tok WHERE length(w) > 3 AND lower(w) NOT IN ({', '.join(map(_lit, X.STOP))}) GROUP BY 1, 2),
tops AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, first) AS r FROM wg)"""


@_query(f"WITH {_TOKENS} SELECT doc, value, n, CAST(least(n, 16) AS BIGINT) AS hits FROM tops WHERE r <= 128 AND n >= 2")
def token_top128(spark, d):
    return points.token_counts(table(spark, d, "extraction_results"), "extraction_id").select("doc", "value", "n", F.col("hits").cast("bigint").alias("hits"))


# -- observations and points ---------------------------------------------------
def _ex(kind: str, pattern: str, group: int, ext: int, weight: float, text: str = "text", idx: str = "i") -> str:
    got = f"regexp_extract_all({text}, {_lit(pattern)}, {group})"
    return f"SELECT doc, {ext} AS ext, {idx} AS idx, '{kind}' AS kind, rtrim(trim(v, chr(32) || chr(9) || chr(10) || chr(13)), '.,;:') AS value, {weight} AS weight FROM (SELECT extraction_id AS doc, unnest({got}) AS v, generate_subscripts({got}, 1) AS i FROM extraction_results WHERE text IS NOT NULL)"


_SUM = ", ".join(f"unnest(regexp_extract_all(text, {_lit(X.AMOUNT)}, {g})) AS g{g}" for g in (1, 2))


def _points_sql(hits: str, p: str) -> str:
    """Points of hits in closed form: {p}f, {p}m and {p}s."""
    pairs = ", ".join(f"'{a}|{b}', '{b}|{a}'" for a, b in (x.split() for x in X.PAIRS))
    return f"""{p}h AS (SELECT *, concat(kind, '=', lower(trim(regexp_replace(value, '\\s+', ' ', 'g'), ' '))) AS kv, row_number() OVER w AS n, lead(seq) OVER w AS nx, min(seq) OVER (PARTITION BY doc, kind, value) AS first FROM {hits} WINDOW w AS (PARTITION BY doc, kind, value ORDER BY seq)),
{p}p AS (SELECT *, weight * ln(1 + n) AS p FROM {p}h),
{p}f AS (SELECT doc, kind, value, count(*) AS hits, round(max_by(weight, seq) * ln(1 + count(*)), 8) AS pressure, min(seq) AS first_seq FROM {p}p GROUP BY ALL),
{p}s AS (SELECT doc, kv AS value, count(*) AS hits, round(max_by(least(1.75, 0.5 + p / 2), seq) * ln(1 + count(*)), 8) AS pressure FROM {p}p WHERE n >= 2 AND kind IN ({', '.join(map(_lit, X.RECURRING))}) GROUP BY doc, kv),
{p}rel AS (SELECT a.doc, a.seq, b.first AS f, least(a.kv, b.kv) || '|' || greatest(a.kv, b.kv) AS value, least(1.75, (a.p + b.p) / 2) AS w FROM {p}p a JOIN {p}p b ON a.doc = b.doc AND b.seq < a.seq AND (b.nx IS NULL OR b.nx > a.seq) AND a.kind || '|' || b.kind IN ({pairs})),
{p}m AS (SELECT doc, value, count(*) AS hits, round(max_by(w, (seq, f)) * ln(1 + count(*)), 8) AS pressure FROM {p}rel GROUP BY doc, value)"""


_FIRST = "raw AS (" + " UNION ALL ".join(
    ["SELECT extraction_id AS doc, -1 AS ext, 7 AS idx, 'SOURCE' AS kind, trim(original, ' ') AS value, 1.3 AS weight FROM extraction_results JOIN ingested_files USING (file_id) WHERE text IS NOT NULL AND trim(original, ' ') NOT IN ('', '0', 'None')"]
    + [_ex(k, p, g, n, w) for n, (k, p, g, w) in enumerate(X.EXTRACTORS)]
    + [_ex("PARTY_A", X.PARTY, 1, 7, 1.25, "text[1:2500]", "2 * i"), _ex("PARTY_B", X.PARTY, 2, 7, 1.25, "text[1:2500]", "2 * i + 1")]
    + [f"SELECT doc, 9, i, 'AMOUNT', '$' || replace(CASE WHEN g1 <> '' THEN g1 ELSE g2 END, ',', ''), 1.3 FROM (SELECT extraction_id AS doc, {_SUM}, generate_subscripts(regexp_extract_all(text, {_lit(X.AMOUNT)}), 1) AS i FROM extraction_results WHERE text IS NOT NULL)"]
    + [_ex("MEASURE", X.MEASURE, 0, 10, 1.15), "SELECT doc, 11, r * 16 + i, 'TOKEN', value, 0.55 FROM (SELECT doc, r, value, unnest(range(1, CAST(least(n, 16) AS INTEGER) + 1)) AS i FROM tops WHERE r <= 128 AND n >= 2)"]
) + "), once AS (SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY ext, idx) AS INTEGER) AS seq, kind, value, CAST(weight AS DOUBLE) AS weight FROM raw)"
_AGAIN = r"""cnt AS (SELECT doc, sum(n) AS n FROM (SELECT doc, count(*) AS n FROM o_f GROUP BY doc UNION ALL SELECT doc, count(*) FROM o_m GROUP BY doc UNION ALL SELECT doc, count(*) FROM o_s GROUP BY doc) GROUP BY doc HAVING sum(n) < 12),
need AS (SELECT doc, kind, lower(trim(regexp_replace(value, '\s+', ' ', 'g'), ' ')) AS needle FROM o_f JOIN cnt USING (doc) WHERE pressure >= 0.65),
car AS (SELECT DISTINCT * FROM (SELECT doc, 'm' AS layer, kind, needle, value FROM need JOIN o_m USING (doc) WHERE pressure >= 0.75 AND contains(value, needle) AND length(needle) >= 3 UNION ALL SELECT doc, 's', kind, needle, value FROM need JOIN o_s USING (doc) WHERE pressure >= 0.75 AND contains(value, needle) AND length(needle) >= 3 AND value <> kind || '=' || needle)),
again AS (SELECT doc FROM cnt LEFT JOIN (SELECT doc, count(*) AS k FROM car GROUP BY doc) USING (doc) WHERE n + coalesce(k, 0) < 12),
hits AS (SELECT * FROM once UNION ALL SELECT doc, seq + max(seq) OVER (PARTITION BY doc), kind, value, weight FROM once SEMI JOIN again USING (doc))"""
_HITS = f"{_TOKENS}, {_FIRST}, {_points_sql('once', 'o_')}, {_AGAIN}"
_ALL_POINTS = _HITS + ", " + _points_sql("hits", "z_") + ", floats AS (SELECT * FROM z_f), stirs AS (SELECT * FROM z_s), mixes AS (SELECT * FROM z_m)"


def _first_hits(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "ingested_files").select("file_id", "original")
    texts = spread(table(spark, d, "extraction_results").select("extraction_id", "file_id", "text"))
    return staged(points.first_hits(texts.join(files, "file_id", "left"), "extraction_id", fields={"source": "original"}))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    once = _first_hits(spark, d)
    return points.twice(once, points.read_again(once))


@_query(f"WITH {_HITS} SELECT doc, CAST(seq AS INTEGER) AS seq, kind, value, weight FROM hits")
def observe_hits(spark, d):
    return _hits(spark, d)


@_query(f"WITH {_ALL_POINTS} SELECT doc, kind, value, hits, pressure FROM floats")
def float_points(spark, d):
    return points.float_points(_hits(spark, d)).drop("first_seq")


@_query(f"WITH {_ALL_POINTS} SELECT * FROM stirs")
def recurrence_points(spark, d):
    return points.recurrence_points(_hits(spark, d))


@_query(f"WITH {_ALL_POINTS} SELECT * FROM mixes")
def relation_points(spark, d):
    return points.relation_points(_hits(spark, d))


_TOP = "SELECT doc, kind, value, pressure, CAST(row_number() OVER (PARTITION BY doc ORDER BY pressure DESC, hits DESC, first_seq) AS INTEGER) AS rank FROM floats QUALIFY rank <= 20"


@_query(f"WITH {_ALL_POINTS} {_TOP}")
def top_points(spark, d):
    return points.top_points(points.float_points(_hits(spark, d)), ["doc"], 20, ["first_seq"]).select("doc", "kind", "value", "pressure", "rank")


@_query()
def pattern_clarity(spark, d):
    """The record of each document: points of each layer, pressure, clarity, readings, signature (a replay of all hits, checked by tests)."""
    return carry.document_records(_first_hits(spark, d))


_DOCS = "docs AS (SELECT DISTINCT extraction_id AS doc, case_id FROM extraction_results)"


_COUNTS = """rec AS (SELECT doc, CAST(sum(nf) AS BIGINT) AS float_points, CAST(sum(nm) AS BIGINT) AS mix_points, CAST(sum(ns) AS BIGINT) AS stir_points, sum(q) AS total_pressure FROM (SELECT doc, count(*) AS nf, 0 AS nm, 0 AS ns, sum(pressure) AS q FROM floats GROUP BY doc UNION ALL SELECT doc, 0, count(*), 0, sum(pressure) FROM mixes GROUP BY doc UNION ALL SELECT doc, 0, 0, count(*), sum(pressure) FROM stirs GROUP BY doc) GROUP BY doc)"""


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Points of each document in closed form, without those that carry."""
    h = staged(_hits(spark, d))
    one = lambda x, k: x.groupBy("doc").agg(*[(F.count("*") if k == n else F.lit(0).cast("bigint")).alias(f"{n}_points") for n in ("float", "mix", "stir")], F.sum("pressure").alias("total_pressure"))
    every = one(points.float_points(h), "float").unionByName(one(points.relation_points(h), "mix")).unionByName(one(points.recurrence_points(h), "stir"))
    return every.groupBy("doc").agg(*[F.sum(c).alias(c) for c in ("float_points", "mix_points", "stir_points", "total_pressure")])


@_query(f"WITH {_ALL_POINTS}, {_DOCS}, {_COUNTS} SELECT case_id, count(*) AS documents, CAST(sum(float_points) AS BIGINT) AS float_points, CAST(sum(mix_points) AS BIGINT) AS mix_points, CAST(sum(stir_points) AS BIGINT) AS stir_points, round(sum(total_pressure), 4) AS total_pressure FROM rec JOIN docs USING (doc) GROUP BY case_id")
def case_rollup(spark, d):
    """Points of a case without those that carry, which case_dashboard has."""
    return points.case_rollup(_counts(spark, d), table(spark, d, "extraction_results").withColumnRenamed("extraction_id", "doc"))


@_query()
def case_dashboard(spark, d):
    """Points of a case, all of them (from the documents' records, checked by tests)."""
    return points.case_rollup(carry.document_records(_first_hits(spark, d)), table(spark, d, "extraction_results").withColumnRenamed("extraction_id", "doc"))


@_query(f"WITH {_ALL_POINTS}, {_DOCS}, d AS (SELECT case_id, doc, sum(pressure) AS p FROM floats JOIN docs USING (doc) GROUP BY ALL) SELECT case_id, doc, round(p, 4) AS pressure, round(p / sum(p) OVER (PARTITION BY case_id), 5) AS share FROM d WHERE case_id IS NOT NULL")
def pressure_share(spark, d):
    return points.pressure_share(points.float_points(_hits(spark, d)), table(spark, d, "extraction_results").withColumnRenamed("extraction_id", "doc"))


@_query(f"WITH {_ALL_POINTS}, {_DOCS} SELECT case_id, doc, value, pressure, CAST(row_number() OVER (PARTITION BY case_id ORDER BY pressure DESC, hits DESC, doc, value) AS INTEGER) AS rank FROM mixes JOIN docs USING (doc) QUALIFY rank <= 8")
def top_relations(spark, d):
    m = points.relation_points(_hits(spark, d)).join(table(spark, d, "extraction_results").select(F.col("extraction_id").alias("doc"), "case_id").distinct(), "doc")
    return points.top_points(m, ["case_id"], 8, ["doc", "value"]).select("case_id", "doc", "value", "pressure", "rank")


# -- amounts, measures, elements -----------------------------------------------
def _spots(literal: str) -> str:
    """Whether a literal part of a line stands in an affirmed clause of it."""
    return (
        f"len(list_filter(string_split_regex(replace(text, {literal}, chr(1)), '[.;:\\n]'), lambda c: contains(c, chr(1)) AND NOT regexp_matches(regexp_replace(c, '(?i)\\bnot\\s+only\\b', '', 'g'), {_lit(_u(X.NEGATED))}) AND contains(regexp_replace(c, {_lit(X.DENIED)}, '\\1 _', 'g'), chr(1)))) > 0"
    )


_KIND = f"CASE WHEN regexp_matches(text, {_lit(_u(X.EXTRA))}) THEN 'MONEY_EXTRA' ELSE 'MONEY_BENEFIT' END"
_gx = lambda p, g: f"regexp_extract_all(text, {_lit(p)}, {g})"
_MATTER = f"""figures AS (SELECT *, TRY_CAST(replace(CASE WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE d END, ',', '') AS DOUBLE) AS amount FROM (SELECT *, unnest({_gx(X.MONEY, 0)}) AS m, unnest({_gx(X.MONEY, 1)}) AS a, unnest({_gx(X.MONEY, 2)}) AS b, unnest({_gx(X.MONEY, 3)}) AS d, generate_subscripts({_gx(X.MONEY, 0)}, 1) AS i FROM lines)),
words AS (SELECT *, unnest({_gx(X.WRITTEN, 0)}) AS m, unnest({_gx(X.WRITTEN, 1)}) AS a, generate_subscripts({_gx(X.WRITTEN, 0)}, 1) AS i FROM lines),
extents AS (SELECT *, TRY_CAST(replace(a, ',', '') AS DOUBLE) AS amount FROM (SELECT *, unnest({_gx(X.EXTENT, 0)}) AS m, unnest({_gx(X.EXTENT, 1)}) AS a, generate_subscripts({_gx(X.EXTENT, 0)}, 1) AS i FROM lines)),
matter0 AS (SELECT extraction_id, line, 0 AS part, i, {_KIND} AS kind, trim(m, ' ') AS value, amount FROM figures WHERE amount > 0 AND {_spots('m')}
  UNION ALL SELECT extraction_id, line, 1, i, {_KIND}, array_to_string(list_transform(string_split(lower(trim(a, ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' '), NULL FROM words WHERE {_spots('m')}
  UNION ALL SELECT extraction_id, line, 2, i, 'MEASURE', trim(m, ' '), amount FROM extents WHERE amount > 0 AND {_spots('m')}),
matter AS (SELECT extraction_id, line, CAST(row_number() OVER (PARTITION BY extraction_id, line ORDER BY part, i) - 1 AS INTEGER) AS pos, kind, value, amount FROM matter0)"""


@_query(f"WITH {_LINES}, {_MATTER} SELECT extraction_id, line, pos, kind, value, amount FROM matter")
def observe_amounts(spark, d):
    """Affirmed sums of money, in figures and in words, and measures of every line."""
    return posture.amounts(_lines(spark, d), "extraction_id")


@_query(f"SELECT kind, count(*) AS rows, round(sum(amount), 2) AS amount, count(DISTINCT extraction_id) AS documents FROM (SELECT DISTINCT observation_id, extraction_id, upper(trim(kind, ' ')) AS kind, amount FROM observations) GROUP BY kind")
def observation_rollup(spark, d):
    """Observations by kind, rows delivered twice once."""
    x = table(spark, d, "observations").select("observation_id", "extraction_id", F.upper(F.trim("kind")).alias("kind"), "amount").distinct()
    return x.groupBy("kind").agg(F.count("*").alias("rows"), F.round(F.sum("amount"), 2).alias("amount"), F.countDistinct("extraction_id").alias("documents"))


_SAID = f"""array_to_string(list_transform(list_filter(string_split_regex(text, '[.;:\\n]'), lambda c: c <> '' AND NOT regexp_matches(regexp_replace(c, '(?i)\\bnot\\s+only\\b', '', 'g'), {_lit(_u(X.NEGATED))})), lambda c: regexp_replace(c, {_lit(X.DENIED)}, '\\1 _', 'g')), '; ')"""
_REFUSED = r"\b(refused|declined|denied|breached|unfair)\b"


@_query(f"WITH {_LINES}, s AS (SELECT *, {_SAID} AS said FROM lines) SELECT extraction_id, line FROM s WHERE regexp_matches(said, {_lit(_u(_REFUSED))})")
def affirmed_pattern(spark, d):
    return _lines(spark, d).where(posture.affirmed(F.col("text"), _REFUSED)).select("extraction_id", "line")


_FAR = f"regexp_extract_all(text, {_lit('(?i)[^.;:\n]*' + X.PLEADS_FAR[1] + '[^.;:\n]*')})"
_FAR_OK = f"len(list_filter({_FAR}, lambda c: NOT regexp_matches(regexp_replace(c, '(?i)\\bnot\\s+only\\b', '', 'g'), {_lit(_u(X.NEGATED))}) AND contains(regexp_replace(regexp_replace(c, {_lit('(?i)' + X.PLEADS_FAR[1])}, chr(1), 'g'), {_lit(X.DENIED)}, '\\1 _', 'g'), chr(1)))) > 0"
# The tables' pleadings assert no theory by name, so each gets a line 0 that does.
PLEAS = [
    "Count I: breach of the policy. Count II: bad faith.", "Count I: negligence; the breach. It concerns the contract.", "Defendant denies fraud. Plaintiff claims legal malpractice.",
    "Not only fraud but unfair claims; no negligence.", "Count I: breach of contract; the carrier denies that the duty was owed.",
]
_SIDES = f"""all_lines AS (SELECT case_id, extraction_id, file_id, line, text FROM lines UNION ALL SELECT case_id, extraction_id, file_id, 0, [{', '.join(map(_lit, PLEAS))}][extraction_id % 5 + 1] FROM extraction_results SEMI JOIN (SELECT file_id FROM roles WHERE role = 'operative_pleading') USING (file_id) WHERE text IS NOT NULL),
papers AS (SELECT l.case_id, l.extraction_id AS source, l.line, l.text, l.extraction_id, role, role IN ('operative_pleading', 'responsive_pleading', 'motion') AS pleading, {_SAID} AS said FROM all_lines l LEFT JOIN roles r USING (file_id)),
pleads AS (""" + " UNION ".join([f"SELECT case_id, '{t}' AS theory FROM papers WHERE role = 'operative_pleading' AND regexp_matches(said, {_lit(_u(p))})" for t, p in X.PLEADS] + [f"SELECT case_id, '{X.PLEADS_FAR[0]}' FROM papers WHERE role = 'operative_pleading' AND {_FAR_OK}"]) + "),\nkinds AS (SELECT extraction_id, line, list(DISTINCT kind) AS kinds FROM matter GROUP BY ALL),\nsup0 AS (" + " UNION ALL ".join(
    f"SELECT case_id, source, line, pleading, '{t}' AS theory, '{e}' AS element, '{c}' AS channel FROM papers p LEFT JOIN kinds USING (extraction_id, line) WHERE "
    + (f"regexp_matches(said, {_lit(_u(p))})" if c != "A" else ("kinds IS NOT NULL" if not k else f"list_has_any(kinds, [{', '.join(map(_lit, k.split(',')))}])") + f" AND (pleading OR regexp_matches(said, {_lit(_u(p))}))")
    for t, e, c, k, p in X.ELEMENTS
) + """),
sup AS (SELECT *, row_number() OVER (PARTITION BY case_id, theory, element, pleading ORDER BY CAST(source AS VARCHAR), line) AS r FROM sup0 SEMI JOIN pleads ON sup0.case_id IS NOT DISTINCT FROM pleads.case_id AND sup0.theory = pleads.theory),
sp AS (SELECT case_id, theory, element, channel, count(*) FILTER (WHERE NOT pleading) AS support, coalesce(string_agg(source || ':' || line, ', ' ORDER BY r) FILTER (WHERE NOT pleading AND r <= 4), '') AS cites,
  count(*) FILTER (WHERE pleading) AS asserted, coalesce(string_agg(source || ':' || line, ', ' ORDER BY r) FILTER (WHERE pleading AND r <= 3), '') AS asserted_at FROM sup GROUP BY ALL),
adv0 AS (SELECT case_id, source, line, regexp_extract(text, '(?i)\\b' || """ + _lit(X.MONTH) + """ || '\\.?\\s+\\d{1,2},\\s+\\d{4}\\b') AS day FROM papers WHERE NOT pleading AND regexp_matches(text, """ + _lit(_u(X.ADVERSE)) + """)),
adv AS (SELECT case_id, CASE WHEN day <> '' THEN day ELSE CAST(source AS VARCHAR) END AS event, max(day) AS day, min((CAST(source AS VARCHAR), line)) AS place FROM adv0 GROUP BY 1, 2),
pat AS (SELECT case_id, count(*) AS events, count(*) >= 3 AS sufficient, min_by(day, place) FILTER (WHERE day <> '') AS since, max_by(day, place) FILTER (WHERE day <> '') AS until FROM adv GROUP BY case_id)"""
_POSTURE = f"{_ROLE}, {_LINES}, {_MATTER}, {_SIDES}"


def _papers_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the papers of cases, each operative pleading with its planted plea."""
    cols = ["case_id", "source", "line", "role", "text"]
    x = _records(spark, d).where("not noise").select(*cols)
    plea = F.element_at(F.array(*[F.lit(p) for p in PLEAS]), (F.col("extraction_id") % 5 + 1).cast("int"))
    first = _papers(spark, d).where("role = 'operative_pleading' and text is not null").select("case_id", F.col("extraction_id").cast("string").alias("source"), F.lit(0).alias("line"), "role", plea.alias("text"))
    return x.unionByName(first).where("case_id is not null")


_IN_CASE = "case_id IS NOT NULL"


@_query(f"WITH {_POSTURE} SELECT DISTINCT case_id, theory FROM pleads WHERE {_IN_CASE}")
def pleaded_theories(spark, d):
    return posture.pleaded(_papers_lines(spark, d), "case_id")


@_query(f"WITH {_POSTURE} SELECT * FROM sp WHERE {_IN_CASE}")
def element_support(spark, d):
    return posture.supports(_papers_lines(spark, d), "case_id")


@_query(f"WITH {_POSTURE} SELECT case_id, events, sufficient, since, until FROM pat WHERE {_IN_CASE}")
def adverse_pattern(spark, d):
    """Adverse events that papers other than pleadings tell of."""
    return posture.adverse_pattern(_papers_lines(spark, d).where(~F.col("role").isin(posture.P.ASSERTING)), "case_id", "source")


_FINDINGS = """g AS (SELECT case_id, theory, max(CASE WHEN channel = 'A' AND support > 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN channel = 'B' AND support > 0 THEN 1 ELSE 0 END) AS b, max(CASE WHEN channel = 'C' AND support > 0 THEN 1 ELSE 0 END) AS c,
  max(CASE WHEN channel = 'A' AND asserted > 0 THEN 1 ELSE 0 END) AS sa, max(CASE WHEN channel = 'B' AND asserted > 0 THEN 1 ELSE 0 END) AS sb, max(CASE WHEN channel = 'C' AND asserted > 0 THEN 1 ELSE 0 END) AS sc FROM sp GROUP BY ALL),
fin AS (SELECT t.case_id, t.theory, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS supported, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(sa, 0) AS sa, coalesce(sb, 0) AS sb, coalesce(sc, 0) AS sc, coalesce(sufficient, false) AS enough
  FROM (SELECT DISTINCT case_id, theory FROM pleads WHERE case_id IS NOT NULL) t LEFT JOIN g USING (case_id, theory) LEFT JOIN pat USING (case_id)),
findings AS (SELECT case_id, theory, supported, CASE WHEN a = 1 AND b = 1 THEN 'A+B' WHEN a = 1 AND c = 1 THEN 'A+C' WHEN b = 1 AND c = 1 THEN 'B+C' WHEN a = 1 THEN 'A' WHEN b = 1 THEN 'B' WHEN c = 1 THEN 'C' ELSE '' END AS folded,
  CASE WHEN a = 1 AND b = 1 THEN 3 WHEN a = 1 AND c = 1 THEN 2 WHEN b = 1 AND c = 1 THEN 1 ELSE 0 END AS predicted, supported = 3 AS resolved,
  CASE WHEN a = 1 AND b = 1 THEN c = 0 AND sc = 1 WHEN a = 1 AND c = 1 THEN b = 0 AND sb = 1 WHEN b = 1 AND c = 1 THEN a = 0 AND sa = 1 ELSE false END AS asserted_only, enough AND c = 0 AS noted FROM fin)"""


def _findings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = staged(_papers_lines(spark, d))
    sup = posture.supports(x, "case_id")
    return posture.resolve(posture.pleaded(x, "case_id"), sup, posture.adverse_pattern(x.where(~F.col("role").isin(posture.P.ASSERTING)), "case_id", "source"), "case_id"), sup


@_query(f"WITH {_POSTURE}, {_FINDINGS} SELECT * FROM findings")
def posture_findings(spark, d):
    return _findings(spark, d)[0]


# -- matters -----------------------------------------------------------------
def _words_sql(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace({c}, {_lit(X.FILLER)}, ' ', 'g'), '[^A-Za-z ]+', ' ', 'g')), '\\s+'), lambda w: length(w) > 2)))"


_got = lambda c, p, g: f"trim(regexp_extract({c}, {_lit(p)}, {g}), ' ')"
_DROP = "['the', 'and', 'of', 'inc', 'llc', 'pllc', 'corp', 'corporation', 'company', 'co', 'ltd', 'lp', 'llp']"
_name = lambda c: f"list_filter(string_split_regex(string_split_regex(trim({c}, ' '), '\\s+and\\s+|\\s*,\\s*')[1], '[\\s,.]+'), lambda w: w <> '' AND NOT list_contains({_DROP}, lower(w)))"
_title = lambda l: f"array_to_string(list_transform(string_split(lower({l}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_SIG = f"""s0 AS (SELECT coalesce(case_id, '') AS case_id, extraction_id AS doc, {_got('h', X.CAPTION, 1)} AS plaintiff, {_got('h', X.CAPTION, 2)} AS defendant, {_got('h', X.CASE_NO, 1)} AS docket, upper({_got('h', X.CLAIM_NO, 1)}) AS claim,
    {_got('h', X.FILED, 0)} AS filed, CASE WHEN {_got("coalesce(original, '')", X.DRAFT, 0)} <> '' THEN {_got("coalesce(original, '')", X.DRAFT, 0)} ELSE {_got('h', X.DRAFT, 0)} END AS draft
  FROM (SELECT e.case_id, extraction_id, original, coalesce(text, '')[1:3000] AS h FROM extraction_results e LEFT JOIN ingested_files f USING (file_id))),
sig AS (SELECT *, CASE WHEN plaintiff <> '' AND defendant <> '' THEN array_to_string({_words_sql('plaintiff')}, ' ') || '|' || array_to_string({_words_sql('defendant')}, ' ') ELSE '' END AS caption_key FROM s0),
mt AS (SELECT case_id, caption_key, min(doc) AS first_doc, min_by(plaintiff, doc) AS plaintiff, min_by(defendant, doc) AS defendant, count(*) AS documents, list_sort(coalesce(list(DISTINCT docket) FILTER (WHERE docket <> ''), [])) AS dockets, list_sort(coalesce(list(DISTINCT claim) FILTER (WHERE claim <> ''), [])) AS claims FROM sig WHERE caption_key <> '' GROUP BY case_id, caption_key),
own_docket AS (SELECT case_id, docket, count(*) AS owners, min(first_doc) AS matter FROM (SELECT DISTINCT case_id, caption_key, docket FROM sig WHERE caption_key <> '' AND docket <> '') JOIN mt USING (case_id, caption_key) GROUP BY ALL),
own_claim AS (SELECT case_id, claim, count(*) AS owners, min(first_doc) AS matter FROM (SELECT DISTINCT case_id, caption_key, claim FROM sig WHERE caption_key <> '' AND claim <> '') JOIN mt USING (case_id, caption_key) GROUP BY ALL),
asg AS (SELECT s.case_id, s.doc, s.filed, coalesce(m.first_doc, d.matter, c.matter) AS matter, CASE WHEN m.first_doc IS NOT NULL THEN 'caption' WHEN d.matter IS NOT NULL THEN 'docket' WHEN c.owners = 1 THEN 'claim' WHEN c.owners > 1 THEN 'first owner of claim' ELSE 'none' END AS how
  FROM sig s LEFT JOIN mt m ON s.case_id = m.case_id AND s.caption_key = m.caption_key LEFT JOIN own_docket d ON s.case_id = d.case_id AND s.docket = d.docket AND d.owners = 1 LEFT JOIN own_claim c ON s.case_id = c.case_id AND s.claim = c.claim)"""


def _signals(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "ingested_files").select("file_id", "original")
    return matters.read_signals(table(spark, d, "extraction_results").select("extraction_id", "file_id", "case_id", "text").join(files, "file_id", "left"), "extraction_id", "case_id", "original")


@_query(f"WITH {_SIG} SELECT * FROM sig")
def matter_signals(spark, d):
    return _signals(spark, d)


@_query(
    f"""WITH {_SIG}, n AS (SELECT *, {_title(f"coalesce({_name('plaintiff')}[-1], '')")} AS l, {_title(f"array_to_string({_name('defendant')}[1:3], ' ')")} AS r FROM mt)
SELECT case_id, caption_key, first_doc, CASE WHEN l <> '' AND r <> '' THEN l || ' v. ' || r WHEN l <> '' THEN l WHEN r <> '' THEN r ELSE 'Unassigned' END AS label, documents, array_to_string(dockets, ', ') AS dockets, array_to_string(claims, ', ') AS claims FROM n"""
)
def matter_list(spark, d):
    m = matters.matters(_signals(spark, d))
    return m.select("case_id", "caption_key", "first_doc", "label", "documents", F.concat_ws(", ", "dockets").alias("dockets"), F.concat_ws(", ", "claims").alias("claims"))


@_query(f"WITH {_SIG} SELECT case_id, doc, matter, how FROM asg")
def matter_assignment(spark, d):
    return matters.assign(_signals(spark, d))


@_query(f"WITH {_SIG}, n AS (SELECT case_id, matter, count(*) AS documents, count(*) FILTER (WHERE filed <> '') AS marked FROM asg WHERE matter IS NOT NULL GROUP BY ALL) SELECT case_id, matter, CASE WHEN len(dockets) > 0 OR marked > 0 THEN 'filed' ELSE 'building' END AS state, n.documents FROM n JOIN (SELECT case_id AS c, first_doc, dockets FROM mt) ON case_id = c AND matter = first_doc")
def matter_states(spark, d):
    """Which matters a court has taken in, and which are still being built."""
    g = _signals(spark, d)
    return matters.states(g, matters.assign(g))


@_query(
    f"""WITH {_SIG}, one AS (SELECT DISTINCT * FROM (SELECT case_id, 'claim' AS why, unnest(claims) AS value, first_doc AS matter FROM mt UNION ALL SELECT case_id, 'party', unnest({_words_sql("plaintiff || ' ' || defendant")}), first_doc FROM mt)),
n AS (SELECT case_id, why, value, count(*) AS members FROM one GROUP BY ALL HAVING count(*) > 1) SELECT case_id, why, value, matter, members FROM one JOIN n USING (case_id, why, value)"""
)
def matter_links(spark, d):
    return matters.links(_signals(spark, d))


@_query(f"WITH {_SIG} SELECT case_id, caption_key, CAST(dense_rank() OVER (PARTITION BY case_id ORDER BY first_doc) AS INTEGER) AS matter_no FROM mt")
def matter_numbers(spark, d):
    return matters.numbered(matters.matters(_signals(spark, d))).select("case_id", "caption_key", "matter_no")


@_query(
    f"""WITH {_ROLE}, {_SIG}, r AS (SELECT e.extraction_id AS doc, rank, role FROM extraction_results e JOIN roles USING (file_id))
SELECT a.case_id, matter, count(*) AS documents, CAST(sum(CASE WHEN rank <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS controlling, CAST(sum(CASE WHEN role = 'operative_pleading' THEN 1 ELSE 0 END) AS BIGINT) AS defining, CAST(sum(CASE WHEN role IN ('operative_pleading', 'responsive_pleading', 'motion') THEN 1 ELSE 0 END) AS BIGINT) AS assertions
FROM asg a JOIN r USING (doc) WHERE matter IS NOT NULL GROUP BY ALL"""
)
def matter_scope(spark, d):
    """Documents of each matter: all, those that control, those that define its claims, and parties' assertions."""
    j = matters.assign(_signals(spark, d)).where("matter is not null").join(_papers(spark, d).select(F.col("extraction_id").alias("doc"), "rank", "role"), "doc")
    n = lambda c: F.sum(c.cast("bigint"))
    return j.groupBy("case_id", "matter").agg(F.count("*").alias("documents"), n(F.col("rank") <= 3).alias("controlling"), n(F.col("role").isin(posture.P.DEFINING)).alias("defining"), n(F.col("role").isin(posture.P.ASSERTING)).alias("assertions"))


@_query(f"WITH {_LINES}, {_ROLE}, {_SIG}, {_ALL_POINTS}, {_COUNTS} SELECT r.extraction_id, r.line, r.text, coalesce(rank, 99) AS rank, coalesce(role, 'unclassified') AS role, a.matter, coalesce(float_points, 0) AS float_points, 'UNVERIFIED' AS status FROM records r LEFT JOIN roles USING (file_id) LEFT JOIN asg a ON a.doc = r.extraction_id LEFT JOIN rec ON rec.doc = r.extraction_id")
def corpus_lines(spark, d):
    """The corpus: every line with its document's role, matter, points and status."""
    m = matters.assign(_signals(spark, d)).select(F.col("doc").alias("extraction_id"), "matter")
    n = points.float_points(_hits(spark, d)).groupBy(F.col("doc").alias("extraction_id")).agg(F.count("*").alias("float_points"))
    x = _records(spark, d).join(m, "extraction_id", "left").join(n, "extraction_id", "left")
    return x.select("extraction_id", "line", "text", "rank", "role", "matter", F.coalesce("float_points", F.lit(0)).alias("float_points"), F.lit("UNVERIFIED").alias("status"))


# -- search ------------------------------------------------------------------
_TOK = "list_filter(string_split(regexp_replace(lower(regexp_replace(title, '\\p{M}+', '', 'g')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
_BM = f"""t AS (SELECT result_id, {_TOK} AS t FROM search_results WHERE title IS NOT NULL),
ix AS (SELECT term, result_id, len, count(*) AS tf FROM (SELECT result_id, len(t) AS len, unnest(t) AS term FROM t) GROUP BY ALL),
st AS (SELECT (SELECT sum(len) FROM (SELECT DISTINCT result_id, len FROM ix)) AS total, (SELECT count(*) FROM search_results) AS n),
q(term) AS (VALUES {', '.join(f"({_lit(w)})" for w in TITLE_QUERY.split())}),
idf AS (SELECT term, CASE WHEN (n - df + 0.5) / (df + 0.5) > 1 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT term, count(*) AS df FROM ix SEMI JOIN q USING (term) GROUP BY term), st),
sc AS (SELECT result_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / (total / n)))), 6) AS score, count(*) AS matched FROM ix JOIN idf USING (term), st GROUP BY result_id)"""


def _index(spark: SparkSession, d: str) -> DataFrame:
    return search.inverted_index(table(spark, d, "search_results"), "result_id", "title")


@_query(f"WITH {_BM} SELECT term, result_id, CAST(len AS INTEGER) AS length, tf FROM ix")
def title_index(spark, d):
    return _index(spark, d)


@_query(f"WITH {_BM} SELECT result_id, score FROM sc WHERE matched = {len(TITLE_QUERY.split())} ORDER BY score DESC, result_id LIMIT 50")
def bm25_search(spark, d):
    return search.bm25(table(spark, d, "search_results"), "result_id", "title", TITLE_QUERY)


@_query(f"WITH {_BM} SELECT result_id, shard, round(sc.score, 6) AS score FROM sc JOIN search_results s USING (result_id) WHERE matched = {len(TITLE_QUERY.split())} ORDER BY shard, sc.score DESC, result_id LIMIT 30")
def shard_order_search(spark, d):
    docs = table(spark, d, "search_results")
    return search.shard_order(search.bm25(docs, "result_id", "title", TITLE_QUERY, None).join(docs.select("result_id", "shard"), "result_id"), "shard", 30).select("result_id", "shard", "score")


@_query("""WITH known AS (SELECT DISTINCT source_id FROM search_results WHERE shard = 'shard-01.db'), f AS (SELECT * FROM search_results WHERE source_id NOT IN (SELECT source_id FROM known WHERE source_id IS NOT NULL) AND source_id IS NOT NULL)
SELECT source_id, result_id, score FROM f QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC NULLS LAST, result_id) = 1""")
def new_authorities(spark, d):
    a = table(spark, d, "search_results").where("source_id is not null")
    return search.new_only(a, a.where("shard = 'shard-01.db'"), "source_id").select("source_id", "result_id", "score")


@_query("""SELECT source_id, result_id, min_id AS first_order FROM (SELECT source_id, result_id, min(result_id) OVER (PARTITION BY source_id) AS min_id, row_number() OVER (PARTITION BY source_id ORDER BY result_id DESC) AS r FROM search_results WHERE source_id IS NOT NULL) WHERE r = 1""")
def authority_upsert(spark, d):
    a = table(spark, d, "search_results").where("source_id is not null").select("source_id", "result_id")
    return search.upsert(a.where("result_id % 2 = 1"), a.where("result_id % 2 = 0"), "source_id", "result_id").select("source_id", "result_id", "first_order")


# -- quality -----------------------------------------------------------------
_PAGES = """pg AS (SELECT extraction_id, string_split_regex(text, '<<<PAGE [0-9]+>>>\\n?') AS l FROM extraction_results WHERE text IS NOT NULL),
pages AS (SELECT extraction_id, CAST(greatest(i - 1, 1) AS INTEGER) AS page, p AS text FROM (SELECT extraction_id, len(l) AS n, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM pg) WHERE n = 1 OR i > 1)"""
_SC = f"""c AS (SELECT extraction_id, page, CAST(length(regexp_replace(text, '\\s+', '', 'g')) AS INTEGER) AS characters, length(text) AS n, len(regexp_extract_all(text, {_lit(X.SANE)})) AS sane, regexp_extract_all(text, '[A-Za-z]{{2,}}') AS words, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS toks FROM pages),
m AS (SELECT extraction_id, quantile_cont(characters, 0.5) AS median FROM c GROUP BY 1),
q AS (SELECT extraction_id, page, characters, CASE WHEN n > 0 THEN round(1 - sane / n, 4) ELSE 0 END AS noise_ratio, CASE WHEN len(words) > 0 THEN round(len(list_filter(words, lambda w: NOT regexp_matches(w, '[aeiouAEIOU]'))) / len(words), 4) ELSE 0 END AS vowelless_ratio,
  CASE WHEN len(toks) > 0 THEN round(len(list_filter(toks, lambda w: length(w) <= 2)) / len(toks), 4) ELSE 0 END AS short_token_ratio, CASE WHEN median > 0 THEN round(characters / median, 4) ELSE 1 END AS relative_length, median FROM c JOIN m USING (extraction_id)),
fin AS (SELECT *, list_filter([CASE WHEN characters < 40 THEN 'little text' END, CASE WHEN noise_ratio > 0.08 THEN 'noise' END, CASE WHEN vowelless_ratio > 0.28 THEN 'no vowels' END, CASE WHEN short_token_ratio > 0.45 THEN 'short tokens' END, CASE WHEN median > 0 AND relative_length < 0.18 THEN 'short page' END], lambda r: r IS NOT NULL) AS reasons FROM q)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return quality.page_scores(lines.page_texts(spread(table(spark, d, "extraction_results").select("extraction_id", "text")), "extraction_id"), "extraction_id")


@_query(f"WITH {_PAGES}, {_SC} SELECT extraction_id, page, characters, noise_ratio, vowelless_ratio, short_token_ratio, relative_length, array_to_string(reasons, '; ') AS reasons, len(reasons) > 0 AS failed FROM fin")
def page_scores(spark, d):
    return _scores(spark, d).withColumn("reasons", F.concat_ws("; ", "reasons"))


_QUEUE = """disagree AS (SELECT extraction_id, page, 'fidelity' AS kind, 'stored verdict differs' AS why FROM fin JOIN page_quality p USING (extraction_id, page) WHERE p.failed <> (len(fin.reasons) > 0)),
done AS (SELECT DISTINCT extraction_id, page, 'quality' AS kind FROM page_quality WHERE failed),
queue AS (SELECT * FROM (SELECT extraction_id, page, 'quality' AS kind, array_to_string(reasons, '; ') AS why FROM fin WHERE len(reasons) > 0 UNION SELECT * FROM disagree) ANTI JOIN done USING (extraction_id, page, kind))"""


def _queue(spark: SparkSession, d: str) -> DataFrame:
    s, pq = _scores(spark, d), table(spark, d, "page_quality")
    other = s.join(pq.select("extraction_id", "page", F.col("failed").alias("stored")), ["extraction_id", "page"]).where("stored <> failed").select("extraction_id", "page", F.lit("fidelity").alias("kind"), F.lit("stored verdict differs").alias("why"))
    return quality.review_queue(s, other, pq.where("failed").select("extraction_id", "page", F.lit("quality").alias("kind")), "extraction_id")


@_query(f"WITH {_PAGES}, {_SC}, {_QUEUE} SELECT * FROM queue")
def review_queue(spark, d):
    return _queue(spark, d)


@_query(f"WITH {_PAGES}, {_SC}, {_QUEUE} SELECT count(*) AS items, CAST(coalesce(sum(CASE WHEN kind = 'quality' THEN 1 ELSE 0 END), 0) AS BIGINT) AS quality_items, count(DISTINCT extraction_id) AS documents FROM queue")
def review_summary(spark, d):
    return quality.queue_summary(_queue(spark, d), "extraction_id").withColumn("quality_items", F.coalesce("quality_items", F.lit(0)))


# -- status ------------------------------------------------------------------
_RANKS = "CASE upper(trim(bracket, ' ')) WHEN 'SPECULATIVE' THEN 1 WHEN 'EXPLAINED' THEN 2 WHEN 'VALIDATED' THEN 3 ELSE 0 END"
_NAMES = "['UNVERIFIED', 'SPECULATIVE', 'EXPLAINED', 'VALIDATED']"


@_query(f"SELECT jurisdiction, {_NAMES}[min({_RANKS}) + 1] AS status FROM search_results GROUP BY jurisdiction")
def status_floor(spark, d):
    return status.floor(table(spark, d, "search_results"), ["jurisdiction"], "bracket")


@_query(
    f"""WITH g AS (SELECT shard, sum(score * w) AS s, sum(w) AS w, count(*) AS mass, {', '.join(f'sum(CASE WHEN r = {k} THEN w ELSE 0 END) AS p{k}' for k in range(4))}, count(DISTINCT source_id) AS sources
  FROM (SELECT shard, score, CAST(float_points AS DOUBLE) AS w, source_id, {_RANKS} AS r FROM search_results WHERE float_points >= 0) GROUP BY shard)
SELECT shard, round(s / w, 6) AS value, round(p0 / w, 6) AS p0, round(p1 / w, 6) AS p1, round(p2 / w, 6) AS p2, round(p3 / w, 6) AS p3, mass, {_NAMES}[CASE greatest(p0, p1, p2, p3) WHEN p0 THEN 1 WHEN p1 THEN 2 WHEN p2 THEN 3 ELSE 4 END] AS status, sources FROM g WHERE w > 0"""
)
def status_stir(spark, d):
    return status.stir(table(spark, d, "search_results"), ["shard"], "score", "float_points", "bracket", "source_id")


_mark = lambda c: f"CASE {_RANKS} WHEN 3 THEN '[[[' || {c} || ']]]' WHEN 2 THEN '{{{{[' || {c} || ']}}}}' WHEN 1 THEN '[[' || {c} || ']]' ELSE '[{{{{' || {c} || '}}}}]' END".replace("{{", "{").replace("}}", "}")
_CLAIMS = f"""notes AS (SELECT result_id, 'Held in ' || {_mark('citation')} || ' of ' || {_mark("coalesce(jurisdiction, 'n.d.')")} || ' and [[' || coalesce(year, 'n.d.') || ' term]].' AS note FROM search_results),
cm AS (SELECT result_id, unnest(l) AS mark, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT result_id, regexp_extract_all(note, '(\\[\\[\\[.*?\\]\\]\\]|\\{{\\[.*?\\]\\}}|\\[\\[.*?\\]\\]|\\[\\{{.*?\\}}\\])', 1) AS l FROM notes WHERE note IS NOT NULL)),
cl AS (SELECT result_id, CAST(pos AS INTEGER) AS pos, CASE WHEN starts_with(mark, '[[[') THEN 'VALIDATED' WHEN starts_with(mark, '{{[') THEN 'EXPLAINED' WHEN starts_with(mark, '[[') THEN 'SPECULATIVE' ELSE 'UNVERIFIED' END AS status,
  array_to_string(regexp_extract_all(lower(regexp_replace(mark, '^(\\[\\[\\[|\\{{\\[|\\[\\[|\\[\\{{)|(\\]\\]\\]|\\]\\}}|\\]\\]|\\}}\\])$', '', 'g')), '[a-z0-9]+'), ' ') AS claim_key FROM cm)"""


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes that mark a citation and its jurisdiction with the status of the row, so that one jurisdiction stands with several."""
    r = status.rank_of(F.col("bracket"))
    around = lambda c: F.when(r == 3, F.concat(F.lit("[[["), c, F.lit("]]]"))).when(r == 2, F.concat(F.lit("{["), c, F.lit("]}"))).when(r == 1, F.concat(F.lit("[["), c, F.lit("]]"))).otherwise(F.concat(F.lit("[{"), c, F.lit("}]")))
    note = F.concat(F.lit("Held in "), around(F.col("citation")), F.lit(" of "), around(F.coalesce("jurisdiction", F.lit("n.d."))), F.lit(" and [["), F.coalesce("year", F.lit("n.d.")), F.lit(" term]]."))
    return table(spark, d, "search_results").withColumn("note", note)


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return status.claims(_notes(spark, d), "result_id", "note")


@_query(f"WITH {_CLAIMS} SELECT result_id, pos, status, claim_key FROM cl")
def claim_spans(spark, d):
    return _claims(spark, d).drop("claim")


@_query(f"WITH {_CLAIMS}, dim(status) AS (VALUES ('UNVERIFIED'), ('SPECULATIVE'), ('EXPLAINED'), ('VALIDATED')) SELECT d.status, count(c.status) AS claims FROM dim d LEFT JOIN cl c ON c.status = d.status GROUP BY d.status")
def claim_counts(spark, d):
    return status.count_by_status(_claims(spark, d))


@_query(f"WITH {_CLAIMS} SELECT claim_key, string_agg(DISTINCT status, ', ' ORDER BY status) AS statuses, count(*) AS places FROM cl WHERE claim_key <> '' GROUP BY claim_key HAVING count(DISTINCT status) > 1")
def claim_tension(spark, d):
    return status.tensions(_claims(spark, d)).withColumn("statuses", F.concat_ws(", ", "statuses"))


@_query(f"WITH {_CLAIMS}, ok AS (SELECT DISTINCT claim_key FROM cl WHERE status = 'VALIDATED' AND result_id % 2 = 0) SELECT result_id, pos, claim_key, CASE WHEN status = 'VALIDATED' AND claim_key NOT IN (SELECT claim_key FROM ok) THEN 'SPECULATIVE' ELSE status END AS status FROM cl")
def claim_demotion(spark, d):
    c = _claims(spark, d)
    return status.demote(c, c.where("status = 'VALIDATED' and result_id % 2 = 0")).select("result_id", "pos", "claim_key", "status")


@_query(
    f"""WITH {_CLAIMS}, ok AS (SELECT DISTINCT claim_key FROM cl WHERE status = 'VALIDATED' AND result_id % 2 = 0), l AS (SELECT result_id, unnest(regexp_extract_all(note, '\\[\\[\\[(.*?)\\]\\]\\]', 1)) AS i FROM notes WHERE note IS NOT NULL),
bad AS (SELECT DISTINCT result_id, i FROM l WHERE array_to_string(regexp_extract_all(lower(i), '[a-z0-9]+'), ' ') NOT IN (SELECT claim_key FROM ok)), b AS (SELECT result_id, list_sort(list(i)) AS bad FROM bad GROUP BY result_id)
SELECT result_id, '[[' || list_reduce(list_prepend(trim(note, ' '), coalesce(bad, [])), lambda a, i: replace(a, '[[[' || i || ']]]', '[[' || i || ']]')) || ']]' AS note FROM notes LEFT JOIN b USING (result_id) WHERE note IS NOT NULL"""
)
def enforced_notes(spark, d):
    """The notes with validated marks that no stored record allows made speculative, and bare lines marked so."""
    c = _claims(spark, d)
    return status.enforced(_notes(spark, d), "result_id", "note", c.where("status = 'VALIDATED' and result_id % 2 = 0"))


# -- parties -----------------------------------------------------------------
_KEY = "trim(regexp_replace(' ' || array_to_string(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), ' '), '" + X.FORMS + "', ''), ' ')"


@_query(f"SELECT DISTINCT name, {_KEY.format(c='name')} AS party_key FROM (SELECT matched_name AS name FROM conflict_hits UNION SELECT queried_name FROM conflict_hits) WHERE name IS NOT NULL")
def party_keys(spark, d):
    h = table(spark, d, "conflict_hits")
    n = h.select(F.col("matched_name").alias("name")).unionByName(h.select(F.col("queried_name").alias("name"))).where("name is not null").distinct()
    return n.select("name", parties.party_key(F.col("name")).alias("party_key"))


@_query(
    """SELECT case_id, CASE WHEN len(p) > 1 THEN regexp_replace(p[1], '^[ ,_-]+|[ ,_-]+$', '', 'g') || ' / ' || regexp_replace(name[length(regexp_extract(name, '(?is)^.*?\\s+(?:v\\.?|vs\\.?|versus)\\s+')) + 1:], '^[ ,_-]+|[ ,_-]+$', '', 'g') ELSE '' END AS sides
FROM (SELECT case_id, name, string_split_regex(name, '(?i)\\s+(?:v\\.?|vs\\.?|versus)\\s+') AS p FROM cases WHERE name IS NOT NULL)"""
)
def caption_sides(spark, d):
    return table(spark, d, "cases").where("name is not null").select("case_id", F.concat_ws(" / ", parties.caption_parties(F.col("name"))).alias("sides"))


@_query(
    f"""WITH q AS (SELECT DISTINCT case_id AS asked_by, {_KEY.format(c='queried_name')} AS k FROM conflict_hits WHERE hit_id % 20 = 0), p AS (SELECT DISTINCT case_id, {_KEY.format(c='n')} AS k FROM (SELECT case_id, unnest(conflict_parties) AS n FROM cases)),
x AS (SELECT q.asked_by, q.k AS query_key, p.k AS party_key, p.case_id, list_distinct(string_split(q.k, ' ')) AS a, list_distinct(string_split(p.k, ' ')) AS b FROM q JOIN p ON q.k <> '' AND p.k <> '' AND (asked_by IS NULL OR case_id IS NULL OR asked_by <> case_id))
SELECT asked_by, query_key, party_key, case_id, CASE WHEN query_key = party_key THEN 'exact' ELSE 'possible' END AS confidence FROM x WHERE query_key = party_key OR (len(a) >= 2 AND len(b) >= 2 AND len(list_intersect(a, b)) / least(len(a), len(b)) >= 0.8)"""
)
def party_conflicts(spark, d):
    """Names asked for (every row whose id is divisible by 20) against the parties of all other cases."""
    q = table(spark, d, "conflict_hits").where("hit_id % 20 = 0").select("case_id", F.col("queried_name").alias("name"))
    return parties.matches(q, table(spark, d, "cases").select("case_id", F.explode("conflict_parties").alias("name")))


@_query(
    f"""WITH q AS (SELECT DISTINCT {_KEY.format(c='queried_name')} AS k FROM conflict_hits), p AS (SELECT DISTINCT {_KEY.format(c='n')} AS k FROM (SELECT unnest(conflict_parties) AS n FROM cases)),
x AS (SELECT q.k AS query_key, p.k AS party_key, list_distinct(string_split(q.k, ' ')) AS a, list_distinct(string_split(p.k, ' ')) AS b FROM q, p WHERE q.k <> '' AND p.k <> '')
SELECT query_key, party_key, CASE WHEN query_key = party_key THEN 'exact' ELSE 'possible' END AS confidence FROM x WHERE query_key = party_key OR (len(a) >= 2 AND len(b) >= 2 AND len(list_intersect(a, b)) / least(len(a), len(b)) >= 0.8)"""
)
def party_name_matches(spark, d):
    """Distinct names asked for with the distinct parties' names that they match."""
    return parties.key_matches(table(spark, d, "conflict_hits").select(F.col("queried_name").alias("name")), table(spark, d, "cases").select(F.explode("conflict_parties").alias("name")))


# -- ledger ------------------------------------------------------------------
def _rule_sql(pack: str, code: str, severity: str, what: str, pattern: str, kind: str, authority: str) -> str:
    test = f"coalesce(meta['{pattern}'], '') = ''" if what == "metadata" else f"{'NOT ' if what == 'required' else ''}regexp_matches(text, {_lit('(?im)' + pattern)})"
    return f"SELECT extraction_id, '{pack}' AS pack, '{code}' AS code, '{severity}' AS severity, {_lit(authority)} AS authority FROM t WHERE {test}" + (f" AND kind IN ({', '.join(map(_lit, kind.split(',')))})" if kind else "")


_RULES = "t AS (SELECT extraction_id, coalesce(text, '') AS text, lower(trim(coalesce(document_type, 'filing'), ' ')) AS kind, MAP {'county': source_folder} AS meta FROM extraction_results LEFT JOIN ingested_files USING (file_id)), broken AS (" + " UNION ALL ".join(_rule_sql(*r) for r in X.RULES) + ")"


def _rules(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    f = table(spark, d, "ingested_files").select("file_id", "document_type", F.create_map(F.lit("county"), "source_folder").alias("meta"))
    x = table(spark, d, "extraction_results").select("extraction_id", "file_id", "text").join(f, "file_id", "left")
    return x, {p: ledger.rule_findings(x, "extraction_id", p, kind="document_type", metadata="meta") for p in ledger.RULES}


@_query(f"WITH {_RULES} SELECT * FROM broken")
def rule_findings(spark, d):
    """Rules of both packs that papers break (a file's folder stands in for the county)."""
    a, b = _rules(spark, d)[1].values()
    return a.unionByName(b)


@_query(
    f"""WITH {_RULES}, p(pack) AS (VALUES ('US-FEDERAL-CIVIL'), ('GA-SUPERIOR-CIVIL'))
SELECT t.extraction_id, p.pack, count(severity) FILTER (WHERE severity = 'error') AS errors, count(severity) FILTER (WHERE severity = 'warning') + 1 AS warnings, count(severity) FILTER (WHERE severity = 'error') = 0 AS passed
FROM t CROSS JOIN p LEFT JOIN broken b ON b.extraction_id = t.extraction_id AND b.pack = p.pack GROUP BY ALL"""
)
def filing_preflight(spark, d):
    x, found = _rules(spark, d)
    a, b = (ledger.preflight(x, "extraction_id", f, p) for p, f in found.items())
    return a.unionByName(b)


_STAMP = "sha256(concat_ws(chr(31), CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), coalesce(event_type, '')))"


_LOG = f"""log AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 97 = 0 THEN 1000000 ELSE 0 END AS seq, {_STAMP} AS stamp FROM events),
l2 AS (SELECT *, CASE WHEN event_id % 101 = 0 THEN 'x' ELSE lag(stamp) OVER (PARTITION BY user_id ORDER BY seq) END AS prev FROM log),
x AS (SELECT *, lag(seq) OVER w AS ls, lag(stamp) OVER w AS lh FROM l2 WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
broken AS (SELECT user_id, CAST(seq AS BIGINT) AS seq, CASE WHEN ls IS NOT NULL AND seq <> ls + 1 THEN 'gap' ELSE 'broken link' END AS why FROM x WHERE (ls IS NOT NULL AND seq <> ls + 1) OR (lh IS NOT NULL AND prev IS DISTINCT FROM lh))"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    """A log made of the events, one chain for each user, with planted breaks."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    e = table(spark, d, "events")
    log = e.select("user_id", "event_id", (F.row_number().over(w.orderBy("event_id")).cast("bigint") + F.when(F.col("event_id") % 97 == 0, 1000000).otherwise(0)).alias("seq"), ledger.link_hash(F.col("event_id"), F.col("user_id"), F.col("event_type")).alias("stamp"))
    return log.withColumn("prev", F.when(F.col("event_id") % 101 == 0, "x").otherwise(F.lag("stamp").over(w.orderBy("seq"))))


@_query(f"WITH {_LOG} SELECT * FROM broken")
def chain_breaks(spark, d):
    return ledger.chain_breaks(_log(spark, d), ["user_id"], "seq", "stamp", "prev")


@_query(
    f"""WITH {_LOG}, kept AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN max(seq) WHEN 1 THEN 2 ELSE 0 END AS kept_seq FROM log GROUP BY user_id), st AS (SELECT k.user_id, k.kept_seq, CASE WHEN k.user_id % 7 = 0 THEN 'x' ELSE l.stamp END AS anchor, l.stamp AS there FROM kept k LEFT JOIN log l ON l.user_id = k.user_id AND l.seq = k.kept_seq)
SELECT l.user_id, count(*) AS events, max_by(stamp, seq) AS head, CASE WHEN bool_or(b.user_id IS NOT NULL) THEN 'mismatch' WHEN any_value(kept_seq) = 0 THEN 'extended' WHEN coalesce(any_value(there) <> any_value(anchor), true) THEN 'mismatch' WHEN any_value(kept_seq) = max(seq) THEN 'current' ELSE 'extended' END AS state
FROM log l JOIN st ON st.user_id = l.user_id LEFT JOIN (SELECT DISTINCT user_id FROM broken) b ON b.user_id = l.user_id GROUP BY l.user_id"""
)
def chain_anchors(spark, d):
    """Chains against heads that were kept outside: the last entry, the second, or none; some of them false."""
    log = staged(_log(spark, d))
    kept = log.groupBy("user_id").agg(F.max("seq").alias("last")).select("user_id", F.when(F.col("user_id") % 3 == 0, F.col("last")).when(F.col("user_id") % 3 == 1, 2).otherwise(0).alias("anchor_seq"))
    at = kept.join(log.select("user_id", F.col("seq").alias("anchor_seq"), "stamp"), ["user_id", "anchor_seq"], "left").select("user_id", "anchor_seq", F.when(F.col("user_id") % 7 == 0, "x").otherwise(F.col("stamp")).alias("anchor_stamp"))
    return ledger.chain_state(log, ["user_id"], "seq", "stamp", ledger.chain_breaks(log, ["user_id"], "seq", "stamp", "prev"), at)


_FILED = "f AS (SELECT f.file_id, normalized_text, length(text) AS size, sha256(text) AS sha FROM ingested_files f LEFT JOIN extraction_results USING (file_id))"


@_query(f"""WITH {_FILED}, e AS (SELECT file_id, CASE WHEN file_id % 50 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN file_id % 70 = 0 THEN 'x' ELSE sha END AS sha FROM f WHERE sha IS NOT NULL), g AS (SELECT file_id, size, sha FROM f WHERE sha IS NOT NULL AND file_id % 30 <> 0)
SELECT e.file_id, CASE WHEN g.size IS NULL THEN 'missing' WHEN e.size <> g.size THEN 'size' WHEN e.sha <> g.sha THEN 'hash' ELSE 'ok' END AS state FROM e LEFT JOIN g USING (file_id)""")
def evidence_integrity(spark, d):
    """Files against a manifest with planted differences."""
    x = table(spark, d, "ingested_files").select("file_id").join(table(spark, d, "extraction_results").select("file_id", "text"), "file_id").where("text is not null").select("file_id", F.length("text").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    want = x.withColumn("size", F.when(F.col("file_id") % 50 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("sha", F.when(F.col("file_id") % 70 == 0, "x").otherwise(F.col("sha")))
    return ledger.integrity(want, x.where("file_id % 30 <> 0"), "file_id")


@_query("SELECT file_id, document_type, side FROM (SELECT file_id, document_type, 'a' AS side FROM ingested_files WHERE document_type <> upper(trim(document_type, ' ')) UNION ALL SELECT file_id, upper(trim(document_type, ' ')), 'b' FROM ingested_files WHERE document_type <> upper(trim(document_type, ' ')))")
def manifest_diff(spark, d):
    f = table(spark, d, "ingested_files").select("file_id", "document_type")
    return ledger.manifest_diff(f, f.withColumn("document_type", F.upper(F.trim("document_type"))))


# -- maps --------------------------------------------------------------------
_CH = """CASE WHEN kind IN ('AMOUNT', 'MONEY', 'MONEY_BENEFIT', 'MONEY_EXTRA', 'MEASURE', 'INJURY', 'DAMAGE', 'PROPERTY', 'QUANTITY') OR regexp_matches(kind, 'MONEY|AMOUNT|MEASURE|DAMAGE') THEN 1
WHEN kind IN ('PARTY_A', 'PARTY_B', 'PERSON', 'JUDGE', 'COURT', 'COURT_LEVEL', 'STATE', 'JURISDICTION', 'CITATION', 'STATUTE', 'REPORTER', 'SOURCE', 'DUTY', 'AUTHORITY') OR regexp_matches(kind, 'PARTY|COURT|CITE|STATUTE|AUTHORITY') THEN 2
WHEN kind IN ('DATE', 'YEAR', 'DOCKET', 'DEADLINE', 'ACT', 'PROCEDURE', 'EVENT', 'CHRONOLOGY') OR regexp_matches(kind, 'DATE|YEAR|DOCKET|TIME|EVENT') THEN 3 ELSE 0 END"""
_EDGES = f"""t20 AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pressure DESC, hits DESC, first_seq) AS r FROM floats QUALIFY r <= 20),
pc AS (SELECT doc, {', '.join(f'round(sum(CASE WHEN {_CH} = {c} THEN pressure ELSE 0 END), 4) AS p{c}' for c in (1, 2, 3))}, round(sum(pressure), 4) AS pressure FROM t20 GROUP BY doc),
od AS (SELECT *, list_sort(list_filter([{{m: -p1, c: 1}}, {{m: -p2, c: 2}}, {{m: -p3, c: 3}}], lambda s: s.m < 0)) AS o FROM pc),
edges AS (SELECT doc, p1, p2, p3, pressure, coalesce(o[1].c, 0) AS "left", coalesce(o[2].c, 0) AS "right", xor(coalesce(o[1].c, 0), coalesce(o[2].c, 0)) AS residue FROM od)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the documents with the pressure of their top floats."""
    t = staged(points.top_points(points.float_points(_hits(spark, d)), ["doc"], 20, ["first_seq"]))
    return graph.document_edges(t).join(t.groupBy("doc").agg(F.round(F.sum("pressure"), 4).alias("pressure")), "doc")


@_query('SELECT * FROM (VALUES (\'anchor:ZERO\', 0, 0), (\'anchor:A\', 1, 66), (\'anchor:B\', 2, 90), (\'anchor:C\', 3, 120)) t(node, channel, anchor)')
def map_anchors(spark, d):
    return graph.anchors(spark)


@_query(f'WITH {_ALL_POINTS}, {_EDGES} SELECT doc, p1, p2, p3, pressure, "left", "right", residue FROM edges')
def doc_edges(spark, d):
    return _edges(spark, d)


@_query(f"SELECT result_id, 2 AS \"left\", 0 AS \"right\", 2 AS residue, round(coalesce(total_pressure, 0), 8) AS pressure, {_NAMES}[{_RANKS} + 1] AS status FROM search_results")
def authority_edges(spark, d):
    return graph.authority_edges(table(spark, d, "search_results"), "result_id")


def _points(spark: SparkSession, d: str) -> DataFrame:
    return carry.all_points(_first_hits(spark, d))


def _layers(spark: SparkSession, d: str) -> DataFrame:
    p = staged(_points(spark, d))
    top = points.top_points(p, ["doc", "layer"], 20, ["place"])
    e = graph.document_edges(top.where("layer = 'FLOAT'"))
    return graph.layers(e, top.groupBy("doc", "layer").agg(F.round(F.sum("pressure"), 4).alias("pressure")))


@_query()
def layer_nodes(spark, d):
    """The three layers of each document, all points counted (checked by tests)."""
    return _layers(spark, d)


@_query()
def layer_edges(spark, d):
    return graph.sequence_edges(_layers(spark, d), ["doc"], "pos")


@_query()
def inner_views(spark, d):
    """What stands inside the relations and recurrences of the maps (checked by tests)."""
    return graph.inner_views(graph.point_nodes(_points(spark, d)))


@_query(f"""WITH {_ALL_POINTS}, t AS ({_TOP}), n AS (SELECT doc, rank, {_CH} AS channel, pressure FROM t WHERE rank <= 16), x AS (SELECT *, lead(channel) OVER w AS c2, lead(pressure) OVER w AS q2 FROM n WINDOW w AS (PARTITION BY doc ORDER BY rank))
SELECT doc, rank, xor(channel, c2) AS residue, round((pressure + q2) / 2, 3) AS pressure FROM x WHERE c2 IS NOT NULL""")
def point_edges(spark, d):
    t = points.top_points(points.float_points(_hits(spark, d)), ["doc"], 16, ["first_seq"])
    return graph.sequence_edges(t.select("doc", "rank", graph.channel_of(F.col("kind")).alias("channel"), "pressure"), ["doc"], "rank")


@_query(f'WITH {_ALL_POINTS}, {_EDGES} SELECT "left", "right", count(*) AS documents, round(sum(pressure), 2) AS pressure FROM edges GROUP BY ALL')
def endpoint_groups(spark, d):
    return graph.endpoint_groups(_edges(spark, d))


@_query(
    f"""WITH {_ALL_POINTS}, {_EDGES}, {_DOCS}, g AS (SELECT case_id, count(*) AS documents, max((pressure, doc, residue)) AS hi, min((pressure, doc)) AS lo, sum(pressure) AS total, round(sum(p1), 4) AS t1, round(sum(p2), 4) AS t2, round(sum(p3), 4) AS t3 FROM edges JOIN docs USING (doc) GROUP BY case_id),
r AS (SELECT *, CASE WHEN t1 <= t2 AND t1 <= t3 THEN 1 WHEN t2 <= t3 THEN 2 ELSE 3 END AS absent FROM g)
SELECT case_id, documents, role, channel, round(pressure, 4) AS pressure, document, 'UNVERIFIED' AS status FROM (
SELECT case_id, documents, 'Clerk' AS role, 0 AS channel, 0.0::DOUBLE AS pressure, NULL::BIGINT AS document FROM r UNION ALL SELECT case_id, documents, 'Advocate', hi[3], hi[1], hi[2] FROM r UNION ALL SELECT case_id, documents, 'Opposition', absent, lo[1], lo[2] FROM r
UNION ALL SELECT case_id, documents, 'Precedent Judge', 2, total, NULL FROM r UNION ALL SELECT case_id, documents, 'Forecaster', hi[3], hi[1], hi[2] FROM r UNION ALL SELECT case_id, documents, 'Recorder', 0, 0, NULL FROM r)"""
)
def map_projections(spark, d):
    docs = table(spark, d, "extraction_results").select(F.col("extraction_id").alias("doc"), "case_id").distinct()
    return graph.projections(_edges(spark, d).join(docs, "doc").withColumn("status", F.lit("UNVERIFIED")), "case_id")


@_query()
def map_signatures(spark, d):
    """The input signature of each case's map (checked by tests)."""
    docs = table(spark, d, "extraction_results").select(F.col("extraction_id").alias("doc"), "case_id").distinct()
    return graph.map_signature(carry.document_records(_first_hits(spark, d)).join(docs, "doc").withColumn("status", F.lit("UNVERIFIED")), "case_id")


@_query(f"""WITH {_ALL_POINTS} SELECT DISTINCT doc, value, regexp_extract(p, '^([A-Z_]+)=', 1) AS kind, trim(regexp_replace(p, '^[A-Z_]+=', ''), ' ')[1:120] AS part FROM (SELECT doc, value, unnest(string_split(value, '|')) AS p FROM mixes WHERE len(string_split(value, '|')) = 2)""")
def relation_parts(spark, d):
    """Components of the relations whose sides hold no further mark."""
    m = points.relation_points(_hits(spark, d)).where(F.size(F.split("value", r"\|")) == 2)
    return m.select("doc", "value", F.explode(graph.relation_parts(F.col("value"))).alias("p")).select("doc", "value", "p.kind", F.col("p.value").alias("part"))


@_query("""WITH RECURSIVE n AS (SELECT nation.n_nationkey + 100 AS id, nation.n_regionkey AS parent FROM nation UNION ALL SELECT r_regionkey, NULL FROM region), w AS (SELECT id, parent AS up, CAST(id AS VARCHAR) AS path, 1 AS d FROM n UNION ALL SELECT w.id, n.parent, n.id || ' > ' || w.path, d + 1 FROM w JOIN n ON w.up = n.id WHERE d < 5)
SELECT id, path FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY d DESC) = 1""")
def breadcrumbs(spark, d):
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("id"), F.col("n_regionkey").alias("parent"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("parent"))
    return graph.breadcrumbs(spark, n.unionByName(r))


# -- nested and sequential results (checked by tests) ---------------------------
@_query()
def cross_carry(spark, d):
    """Points carried into relations and recurrences."""
    return carry.cross_carry(_first_hits(spark, d))


@_query(
    """SELECT case_id, CAST(hit_id AS VARCHAR) AS node, trim(coalesce(matched_name, ''), ' ') AS statement, CASE WHEN hit_id % 5 = 0 THEN 'SPECULATIVE' ELSE 'EXPLAINED' END AS status, CAST(hit_id % 3 AS INTEGER) AS evidence FROM conflict_hits"""
)
def claims_graph(spark, d):
    """Claim graphs made of the hits of each case, read back from JSON; every fifth has a contradicted last step."""
    from ..operators import claims_graph as cg

    h = table(spark, d, "conflict_hits")
    past = F.when(F.col("hit_id") % 5 == 0, F.array(F.struct(F.lit("pin").alias("action"), F.lit("UNVERIFIED").alias("fromBracket"), F.lit("SPECULATIVE").alias("toBracket")), F.struct(F.lit("contradicted").alias("action"), F.lit("SPECULATIVE").alias("fromBracket"), F.lit("UNVERIFIED").alias("toBracket"))))
    node = F.struct(F.col("hit_id").cast("string").alias("id"), F.lit("claim").alias("kind"), F.coalesce("matched_name", F.lit("")).alias("statement"), F.lit("EXPLAINED").alias("bracket"), F.lit("B").alias("channel"), F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("hit_id") % 3).cast("int")).alias("sourceEvidenceIds"), past.alias("history"))
    # A graph for each hit: a case's hits are not gathered in one row.
    raw = h.select("case_id", F.to_json(F.struct(F.array(node).alias("nodes"))).alias("raw"))
    return cg.project(cg.parse(raw, "case_id", "raw"), "case_id")


@_query(
    """SELECT hit_id, CASE WHEN hit_id % 11 = 0 THEN 'missing' WHEN hit_id % 7 = 0 OR hit_id % 5 = 0 THEN 'not ready' WHEN hit_id % 3 = 0 OR coalesce(case_id, '') = '' THEN 'revision' WHEN hit_id % 2 = 0 THEN 'hash' ELSE 'ok' END AS state FROM conflict_hits"""
)
def claims_handoff(spark, d):
    """Claims against graphs made of them with planted differences."""
    from ..operators import claims_graph as cg

    sha = F.sha2(F.concat_ws("|", "queried_name", "matched_name").cast("binary"), 256)
    k = F.col("hit_id")
    c = table(spark, d, "conflict_hits").select("hit_id", F.col("case_id").alias("revision"), sha.alias("sha"))
    g = c.where(k % 11 != 0).select("hit_id", (k % 7 != 0).alias("ready"), F.when(k % 5 == 0, "1.3.1").otherwise("1.10.0").alias("writer"), F.when(k % 3 == 0, "other").otherwise(F.col("revision")).alias("revision"), F.when(k % 2 == 0, "x").otherwise(F.upper("sha")).alias("sha"))
    return cg.handoff(c, g, "hit_id")


@_query(
    """SELECT case_id, 'e' || hit_id AS edge, CAST(hit_id AS VARCHAR) AS from_node, CAST(hit_id + 1 AS VARCHAR) AS to_node, 'supports' AS kind, CASE WHEN hit_id % 4 = 0 THEN 'VALIDATED' ELSE 'UNVERIFIED' END AS status FROM conflict_hits"""
)
def claims_edges(spark, d):
    """Edges of claim graphs made of the hits, read back from JSON."""
    from ..operators import claims_graph as cg

    k = F.col("hit_id")
    edge = F.struct(F.concat(F.lit("e"), k.cast("string")).alias("id"), k.cast("string").alias("fromNodeId"), (k + 1).cast("string").alias("toNodeId"), F.lit("supports").alias("kind"), F.when(k % 4 == 0, "[[[]]]").otherwise("unheard of").alias("bracket"))
    raw = table(spark, d, "conflict_hits").select("case_id", F.to_json(F.struct(F.array(edge).alias("edges"))).alias("raw"))
    return cg.edges(cg.parse(raw, "case_id", "raw"), "case_id")


@_query(
    f"""WITH {_POSTURE}, {_FINDINGS}, {_ALL_POINTS}, {_DOCS}, d AS (SELECT case_id, file_id, rank, role, row_number() OVER (PARTITION BY case_id ORDER BY rank, file_id) AS r FROM roles WHERE case_id IS NOT NULL),
tops_ AS (SELECT case_id, doc, value, row_number() OVER (PARTITION BY case_id ORDER BY pressure DESC, hits DESC, doc, value) AS r FROM mixes JOIN docs USING (doc) QUALIFY r <= 8)
SELECT c.case_id, c.documents, coalesce(f.findings, '') AS findings, coalesce(f.needs, '') AS needs, coalesce(t.relations, '') AS relations
FROM (SELECT case_id, string_agg(rank || ' ' || role || ' ' || file_id, '; ' ORDER BY r) FILTER (WHERE r <= 40) AS documents FROM d GROUP BY case_id) c
LEFT JOIN (SELECT case_id, string_agg(theory || ' ' || supported || ' ' || folded || CASE WHEN resolved THEN ' resolved' WHEN asserted_only THEN ' asserted only' ELSE ' open' END, '; ' ORDER BY theory) AS findings, coalesce(string_agg(theory || CASE predicted WHEN 1 THEN ' proof of what it cost you' WHEN 2 THEN ' proof they owed you something' WHEN 3 THEN ' proof of when it happened' ELSE ' supporting proof' END, '; ' ORDER BY theory) FILTER (WHERE NOT resolved), '') AS needs FROM findings GROUP BY case_id) f USING (case_id)
LEFT JOIN (SELECT case_id, string_agg(value, '; ' ORDER BY r) AS relations FROM tops_ GROUP BY case_id) t USING (case_id)"""
)
def case_brief(spark, d):
    """Each case at a glance: documents by rank, findings, what is still needed, strongest relations."""
    from . import brief

    r = doc_roles(spark, d).join(table(spark, d, "ingested_files").select("file_id", "case_id"), "file_id").where("case_id is not null")
    found, sup = _findings(spark, d)
    b = brief.brief(r.select("case_id", F.col("file_id").alias("source"), "rank", "role"), found, sup, top_relations(spark, d))
    return brief.as_text(b)


@_query("""SELECT row_number() OVER (PARTITION BY case_id ORDER BY created_at, file_id) AS arrival, file_id, case_id FROM (SELECT file_id, case_id, ingested_at AS created_at FROM ingested_files) WHERE case_id IS NOT NULL""")
def arrival_order(spark, d):
    from pyspark.sql import Window

    f = table(spark, d, "ingested_files").where("case_id is not null")
    return f.select(F.row_number().over(Window.partitionBy("case_id").orderBy("ingested_at", "file_id")).cast("bigint").alias("arrival"), "file_id", "case_id")


@_query("SELECT extraction_id, text FROM extraction_results WHERE text IS NOT NULL")
def html_text(spark, d):
    """Markup made of every text, its own <, > and & as entities, and taken off again: the text as it was."""
    from ..functions import scalars as s

    x = table(spark, d, "extraction_results").where("text is not null")
    marked = F.concat(F.lit("<p>"), F.replace(s.escaped(F.col("text")), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))
    return x.select("extraction_id", s.unescaped(F.regexp_replace(F.regexp_replace(marked, "<br>", "\n"), "<[^>]+>", "")).alias("text"))


# -- scalars and selections -----------------------------------------------------
_FLAT = "trim(regexp_replace(title, '\\s+', ' ', 'g'), ' ')"


@_query(
    f"""SELECT result_id, coalesce(nullif(citation, ''), nullif(source_id, ''), 'none') AS label, coalesce(TRY_CAST(trim(year, ' ') AS INTEGER) > 0 AND 2026 - TRY_CAST(trim(year, ' ') AS INTEGER) > 15, false) AS stale,
rtrim((CASE WHEN regexp_matches({_FLAT}, '^.*?[.!?](\\s|$)') THEN regexp_extract({_FLAT}, '^(.*?[.!?])(?:\\s|$)', 1) ELSE {_FLAT} END)[1:180], ' ') AS first_sentence, CASE WHEN length({_FLAT}) <= 40 THEN {_FLAT} ELSE {_FLAT}[1:37] || '...' END AS short, CASE WHEN t = '' THEN 'item' ELSE t END AS file_name,
CASE WHEN regexp_matches(trim(year, ' '), '^[0-9]{{4}}$') THEN TRY_CAST(trim(year, ' ') || '-01-31' AS DATE)::VARCHAR END AS day, hex_key AS id
FROM (SELECT *, regexp_replace(regexp_replace(trim(title, ' '), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g')[1:80] AS t, left(sha256(concat_ws(chr(31), 'authority', coalesce(source_id, ''), coalesce(title, ''))), 16) AS hex_key FROM search_results) WHERE title IS NOT NULL"""
)
def scalar_functions(spark, d):
    from ..functions import scalars as s

    t = table(spark, d, "search_results").where("title is not null")
    return t.select(
        "result_id", F.coalesce(s.first_of(F.col("citation"), F.col("source_id")), F.lit("none")).alias("label"), s.stale(F.col("year"), 2026).alias("stale"), s.first_sentence(F.col("title")).alias("first_sentence"),
        s.shortened(F.col("title"), 40).alias("short"), s.safe_name(F.col("title")).alias("file_name"), s.iso_date(F.concat(F.trim("year"), F.lit("-01-31"))).cast("string").alias("day"), s.stable_id(F.lit("authority"), F.col("source_id"), F.col("title")).alias("id"),
    )


@_query("SELECT p_brand, max((p_retailprice, p_partkey))[2] AS p_partkey FROM part WHERE p_size <= 25 AND p_retailprice <= 1500 GROUP BY p_brand")
def fitting_best(spark, d):
    from ..operators import selection

    return selection.best(selection.fitting(table(spark, d, "part"), {"p_size": 25, "p_retailprice": 1500}), ["p_brand"], ["p_retailprice", "p_partkey"], ["p_partkey"])


@_query(f"""WITH {_BM}, known AS (SELECT source_id FROM search_results WHERE shard = 'shard-01.db' AND source_id IS NOT NULL), f AS (SELECT s.source_id, s.result_id, round(sc.score, 6) AS score FROM sc JOIN search_results s USING (result_id) WHERE matched = {len(TITLE_QUERY.split())} AND s.source_id IS NOT NULL AND s.source_id NOT IN (SELECT source_id FROM known))
SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, result_id) = 1""")
def research_for_question(spark, d):
    """What a question's search finds and is not attached yet."""
    docs = table(spark, d, "search_results")
    hit = search.bm25(docs, "result_id", "title", TITLE_QUERY, None).join(docs.select("result_id", "source_id", "shard").where("source_id is not null"), "result_id")
    return search.new_only(hit, docs.where("shard = 'shard-01.db' and source_id is not null"), "source_id").select("source_id", "result_id", "score")


@_query("SELECT extraction_id, page, noise_ratio AS stored, CASE WHEN noise_ratio > 1 THEN noise_ratio / 100 ELSE noise_ratio END AS noise_ratio, row_number() OVER (PARTITION BY extraction_id ORDER BY page) AS nth FROM page_quality")
def stored_quality(spark, d):
    """Stored noise ratios, those written as a percentage as a ratio."""
    from pyspark.sql import Window

    n = F.col("noise_ratio")
    return table(spark, d, "page_quality").select("extraction_id", "page", n.alias("stored"), F.when(n > 1, n / 100).otherwise(n).alias("noise_ratio"), F.row_number().over(Window.partitionBy("extraction_id").orderBy("page")).cast("bigint").alias("nth"))
