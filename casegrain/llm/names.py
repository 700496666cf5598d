"""Variant spellings of names: attribution through a noisy channel.

Every distinct spelling is read into a form (given name, initials, surname and
generation of a person; core words, line of business, place and number of a firm).
Forms are ranked as candidates for the canonical form by how much they say and by
how often they occur.  For a variant v and a candidate c that is ranked higher,

    log P(c | v) ~ log prior(c) + log P(slips) + log P(short forms) + log P(parts left out)

and each variant is attached to its likeliest candidate, if that is likelier than
being a party of its own.  Attachments form trees; the root is the party.

Candidates are found without comparing all pairs: distinct core words (a surname, a
firm's own name) are joined on their deletion neighbourhoods, and forms on a core
word near by and the given name's initial or the line of business.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..io import spread, staged

# Short forms of given names (public knowledge).
SHORT_FORMS = """Al:Albert Bert:Albert Bertie:Albert Tony:Anton Gus:Augusta Gussie:Augusta Bea:Beatrice Trixie:Beatrice Ben:Benjamin
Benny:Benjamin Benji:Benjamin Charlie:Charlotte Lottie:Charlotte Chris:Christopher Kit:Christopher Topher:Christopher Clem:Clement
Deb:Deborah Debbie:Deborah Debby:Deborah Dot:Dorothy Dottie:Dorothy Dolly:Dorothy Ed:Edward Eddie:Edward Ned:Edward Ted:Edward Teddy:Edward
Ellie:Eleanor Nell:Eleanor Nora:Eleanor Liz:Elizabeth Lizzie:Elizabeth Beth:Elizabeth Betsy:Elizabeth Betty:Elizabeth Eliza:Elizabeth
Flo:Florence Flossie:Florence Florrie:Florence Fred:Frederick Freddie:Frederick Freddy:Frederick Gerry:Gerald Jerry:Gerald Greg:Gregory
Gwen:Gwendolyn Hettie:Henrietta Etta:Henrietta Hattie:Henrietta Howie:Howard Bella:Isabella Izzy:Isabella Belle:Isabella Jon:Jonathan
Jonny:Jonathan Johnny:Jonathan Jo:Josephine Josie:Josephine Kate:Katherine Kathy:Katherine Katie:Katherine Kay:Katherine Kitty:Katherine
Ken:Kenneth Kenny:Kenneth Leo:Leonard Len:Leonard Lenny:Leonard Lucy:Lucinda Cindy:Lucinda Maggie:Margaret Peggy:Margaret Meg:Margaret
Marge:Margaret Greta:Margaret Daisy:Margaret Matt:Matthew Matty:Matthew Mike:Michael Mick:Michael Mickey:Michael Nat:Nathaniel Nate:Nathaniel
Nicky:Nicolette Nicki:Nicolette Ollie:Oliver Noll:Oliver Phelia:Ophelia Pete:Peter Pippa:Philippa Pip:Philippa Quent:Quentin Quin:Quentin
Ray:Raymond Becky:Rebecca Becca:Rebecca Beck:Rebecca Dick:Richard Rick:Richard Rich:Richard Richie:Richard Ricky:Richard Bob:Robert Rob:Robert Robbie:Robert
Bobby:Robert Sam:Samuel Sammy:Samuel Steph:Stephanie Steffie:Stephanie Stevie:Stephanie Tabby:Tabitha Theo:Theodore Tim:Timothy Timmy:Timothy
Ursie:Ursula Vicky:Victoria Vickie:Victoria Tori:Victoria Vic:Victoria Vin:Vincent Vince:Vincent Vinny:Vincent Walt:Walter Wally:Walter Bill:William Will:William Billy:William
Willie:William Liam:William Win:Winifred Winnie:Winifred Freda:Winifred Evie:Yvonne Vonnie:Yvonne Zach:Zachary Zack:Zachary Zak:Zachary Zee:Zelda
Ivan:Ivan""".split()
# Words of lines of business and legal forms, with their short forms.
BUSINESS = """adjusting:adjusting,adj,adjstg agency:agency,agcy association:association,assn,ass'n,assoc auto:auto bank:bank,bk body:body
casualty:casualty,cas center:center,ctr,centre community:community,comm,cmty construction:construction,constr,const consultants:consultants,cons,consult
engineering:engineering,engg,engrg,eng environmental:environmental,env,envtl group:group,grp hardware:hardware,hdwe,hdw homeowners:homeowners,homeowner's,homeowners'
hospital:hospital,hosp insurance:insurance,ins,insur logistics:logistics,log,logist management:management,mgmt,mgt,mngmt manufacturing:manufacturing,mfg,manuf,mfrg
medical:medical,med mutual:mutual,mut property:property,prop,ppty realty:realty,rlty restoration:restoration,restor,rest roofing:roofing,roof,rfg savings:savings,sav,svgs
services:services,svcs,serv,srvcs supply:supply,sup,splt title:title,ttl transport:transport,transp,trans,trnsp partners:partners brothers:brothers,bros""".split()
LEGAL = {"co", "company", "corp", "corporation", "inc", "incorporated", "llc", "llp", "ltd", "limited", "lp", "pc", "plc", "gmbh", "sa"}
TITLES = {"mr", "mrs", "ms", "miss", "dr", "hon", "honorable", "prof", "sir", "mister", "judge", "the", "rev", "esq", "esquire"}
GENERATIONS = {"jr": 2, "junior": 2, "sr": 1, "senior": 1, "ii": 2, "iii": 3, "iv": 4}
PLACEHOLDERS = {"", "unknown", "n a", "na", "none", "null", "nil", "tbd", "tba", "x", "xxx", "not known", "not available", "unbekannt", "anonymous", "party", "to be determined", "see file", "various", "no name", "not given", "not stated", "name", "test", "same", "client", "nobody", "not applicable"}

GIVEN = {s.lower(): f.lower() for s, f in (x.split(":") for x in SHORT_FORMS)}
GIVEN |= {f: f for f in list(GIVEN.values())}
#: Short forms that belong to several given names.
AMBIGUOUS = {"al": ("albert",), "nat": ("nathaniel",), "chris": ("christopher",), "charlie": ("charlotte",), "ted": ("edward", "theodore"), "teddy": ("edward", "theodore"), "tony": ("anton",), "win": ("winifred",), "fred": ("frederick", "winifred"), "freddie": ("frederick", "winifred"), "vic": ("victoria", "vincent"), "kit": ("christopher", "katherine"), "bert": ("albert", "robert"), "bertie": ("albert",), "nell": ("eleanor",), "nora": ("eleanor",), "leo": ("leonard",), "sam": ("samuel",), "jo": ("josephine",), "jon": ("jonathan",)}
_BUSINESS = {v: k for k, vs in (x.split(":") for x in BUSINESS) for v in vs.split(",")}
_TOKEN = re.compile(r"[a-z0-9]+(?:'[a-z]+)?'?")


def osa(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two words, most + 1 if more."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    two, one = None, list(range(m + 1))
    for i in range(1, n + 1):
        row = [i] + [0] * m
        for j in range(1, m + 1):
            c = a[i - 1] != b[j - 1]
            x = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + c)
            if c and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                x = min(x, two[j - 2] + 1)
            row[j] = x
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[m], most + 1)


def _fold(s: str) -> str:
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return s.replace("’", "'").replace("ß", "ss").lower()


def _unmix(w: str) -> str:
    """Digits that stand for letters inside a word."""
    if any(c.isdigit() for c in w) and sum(c.isalpha() for c in w) >= 3:
        return w.translate(str.maketrans("0153@", "oisea"))
    return w


@lru_cache(maxsize=65536)
def _business(w: str) -> str | None:
    """The line of business a word stands for; slips of the pen in long words are allowed."""
    w = _unmix(w)
    if w in _BUSINESS:
        return _BUSINESS[w]
    if len(w) >= 5:
        for full in set(_BUSINESS.values()):
            if len(full) >= 5 and osa(w, full, 1 if len(full) < 8 else 2) <= (1 if len(full) < 8 else 2):
                return full
    return None


@lru_cache(maxsize=65536)
def _given(w: str) -> tuple[str, int] | None:
    """The given name a word stands for, and the slips in it."""
    w = _unmix(w)
    if w in GIVEN:
        return GIVEN[w], 0
    if len(w) >= 4:
        for most in (1, 2):
            if most == 2 and len(w) < 7:
                break
            for g, full in GIVEN.items():
                if len(g) >= 4 and abs(len(g) - len(w)) <= most and (most == 1 or len(g) >= 7) and osa(w, g, most) <= most:
                    return full, most
    return None


_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6}


def _core(words: list[str]) -> str:
    s = "".join(_unmix(w) for w in words).replace("'", "")
    s = re.sub(r"^mac(?=[a-z]{5})", "mc", s)
    return s.replace("ph", "f")


def read_name(raw: str) -> dict | None:
    """The form of a spelling, None for a placeholder.

    kind 'p': given, middle (initials), core (surname), generation.
    kind 'o': core, line (sorted business words), place, number.
    """
    s = _fold(raw)
    camel = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", "".join(c for c in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(c)).replace("’", "'"))
    if " " not in raw.strip():
        s = camel.lower()
        s = re.sub(r"\b(ma?c) (?=[a-z])", r"\1", s)
    s = re.sub(r"\([^)]*\)", " ", s)
    s = re.sub(r",?\s*\b(et al\b\.?|individually|et ux\b\.?|et vir\b\.?|d/?b/?a\b.*|a/k/a\b.*|and others|deceased|as (?:trustee|executor|agent|guardian).*|on behalf of.*)", " ", s)
    s = re.sub(r"\b([a-z])\.([a-z])\.(?:([a-z])\.)?(?![a-z])", lambda m: "".join(x for x in m.groups() if x) if "".join(x for x in m.groups() if x) in LEGAL else " ".join(x for x in m.groups() if x), s)
    s = re.sub(r"ass'n", "assn", s).replace("&", " and ")
    comma = [p for p in re.split(r",", s)]
    words = [w for w in _TOKEN.findall(re.sub(r"[-_/.]", " ", s.replace("'s", "s"))) if w]
    if " ".join(words) in PLACEHOLDERS or not any(c.isalpha() for c in s) or not words:
        return None
    words = [w for w in words if w not in TITLES or len(words) == 1]
    if not words:
        return None
    lines = {b for w in words if w not in LEGAL and (b := _business(w))}
    if "hoa" in words:
        lines |= {"homeowners", "association"}
    legal = any(w in LEGAL for w in words)
    number = [w for w in words if w.isdigit()]
    if lines or legal or number:
        place, out, k = "", [], 0
        num: list[str] = [str(int(x)) for x in number]
        while k < len(words):
            w = words[k]
            if w in ("of", "in") and k + 1 < len(words):
                rest = [x for x in words[k + 1 :] if x not in LEGAL]
                place = _core([x for x in rest if not x.isdigit() and not _business(x) and x not in _ROMAN])
                break
            if w in LEGAL or w in ("hoa", "and", "no", "nr", "number", "num") or w.isdigit():
                pass
            elif k and w in _ROMAN and w not in ("i", "v"):
                num.append(str(_ROMAN[w]))
            elif _business(w) is None:
                out.append(w)
            k += 1
        core = _core(out)
        if not core:
            return None
        return {"kind": "o", "core": core, "given": "", "middle": "", "gen": 0, "line": " ".join(sorted(lines)), "place": place, "number": " ".join(sorted(num))}
    gen = 0
    body = []
    for k, w in enumerate(words):
        if w in GENERATIONS and len(words) > 2 and k:
            gen = GENERATIONS[w]
        else:
            body.append(w)
    if not body:
        return None
    longs = [w for w in body if len(w) > 1]
    head = [w for w in _TOKEN.findall(re.sub(r"[-_/.]", " ", comma[0])) if w not in TITLES] if len(comma) > 1 else []
    if len(longs) == 0:
        return None
    if head and len([w for w in head if len(w) > 1]) == 1 and len(body) > len(head) and len(head) == 1:
        sur, rest = head, body[len(head) :]
    elif len(longs) == 1:
        sur, rest = longs, [w for w in body if len(w) == 1]
    else:
        first, last = body[0], body[-1]
        g0 = _given(first) if len(first) > 1 else (first, 0)
        g1 = _given(last) if len(last) > 1 else None
        if len(last) == 1 or (g1 and not g0) or (g1 and g0 and len(first) > 1 and g1[1] < g0[1]):
            at = next((k for k, w in enumerate(body) if len(w) > 1), 0)
            sur, rest = [body[at]], body[:at] + body[at + 1 :]
            if len(first) == 1 and at:
                sur, rest = [longs[-1]], [w for w in body if w != longs[-1]]
        else:
            sur, rest = [last], body[:-1]
            if len(rest) > 1 and len(rest[-1]) > 1 and rest[-1] in ("mc", "mac", "de", "van", "von", "la"):
                sur, rest = rest[-1:] + sur, rest[:-1]
    given, middle = "", ""
    if rest:
        g = rest[0]
        full = _given(g) if len(g) > 1 else None
        given = full[0] if full else g
        middle = "".join(w[0] for w in rest[1:])
        if len(g) > 1 and g in AMBIGUOUS and len(AMBIGUOUS[g]) > 1:
            given = "|".join(AMBIGUOUS[g])
    return {"kind": "p", "core": _core(sur), "given": given, "middle": middle, "gen": gen, "line": "", "place": "", "number": ""}


def _given_fits(a: str, b: str) -> float | None:
    """log likelihood that given names a and b are one; None if they differ."""
    if a == b:
        return 0.0
    if not a or not b:
        return math.log(0.02)
    for x in a.split("|"):
        for y in b.split("|"):
            if x == y:
                return math.log(0.6)
            if len(x) == 1 or len(y) == 1:
                if x[0] == y[0]:
                    return math.log(0.15)
            elif x not in GIVEN and y not in GIVEN and osa(x, y, 1) <= 1 and min(len(x), len(y)) >= 4:
                return math.log(0.02)
    return None


def log_likelihood(v: dict, c: dict) -> float | None:
    """log P(v | c): the slips, short forms and omissions that make c into v; None if they can't be one party."""
    if v["kind"] != c["kind"]:
        return None
    most = most_edits(len(v["core"]), len(c["core"]))
    d = osa(v["core"], c["core"], most)
    if d > most:
        return None
    score = d * math.log(0.03) + (1.0 if d else 0)
    if v["kind"] == "o":
        if v["number"] != c["number"] or (v["place"] and c["place"] and osa(v["place"], c["place"], 1) > 1):
            return None
        if bool(v["place"]) != bool(c["place"]):
            return None
        a, b = set(v["line"].split()), set(c["line"].split())
        if a != b:
            if not a or not b or not (a <= b or b <= a):
                return None
            score += math.log(0.05) * len(a ^ b)
        return score
    if v["gen"] != c["gen"]:
        if v["gen"] and c["gen"]:
            return None
        score += math.log(0.05)
    g = _given_fits(v["given"], c["given"])
    if g is None:
        return None
    score += g
    if v["middle"] != c["middle"]:
        if v["middle"] and c["middle"] and v["middle"][0] != c["middle"][0]:
            return None
        score += math.log(0.2)
    return score


def _said(kind: str, given: str, middle: str, gen: int, line: str) -> int:
    """How much a form says: a form is never attached to one that says less."""
    if kind == "o":
        return 4 * len(line.split())
    return 8 * (len(given) > 1 and "|" not in given) + 4 * (len(given) > 0) + 2 * bool(middle) + bool(gen)


FORM = "kind string, core string, given string, middle string, gen int, line string, place string, number string"
_FIELDS = [x.split()[0] for x in FORM.split(", ")]


def forms(names: DataFrame) -> DataFrame:
    """name, n and the fields of its form for the distinct names; placeholders are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, k, f) for n, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (f := read_name(n))]
            cols = [[r[0] for r in rows], [r[1] for r in rows], *([r[2][x] for r in rows] for x in _FIELDS)]
            types = [pa.string(), pa.int64(), *(pa.int32() if x == "gen" else pa.string() for x in _FIELDS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["name", "n", *_FIELDS])

    return names.mapInArrow(run, f"name string, n bigint, {FORM}")


def most_edits(a: int, b: int) -> int:
    """Edits that two core words of these lengths may differ in."""
    m = min(a, b)
    return 1 if m < 6 else 2 if m < 10 else 3


#: Longer words are cut into parts instead, as what is left of them after deletions grows with the cube of their length.
LONG = 20


def _keys(w: str) -> set[str]:
    """Keys of a word such that words within the allowed edits share one.

    What is left after as many characters fall out as the word's length allows edits;
    of a long word, parts: of four parts of a word at least one is untouched by three
    edits, and stands in the other word at most three places away.
    """
    n = len(w)
    if n > LONG - 3:
        out = set()
        for length in range(n - 3, n + 4):
            cuts = [length * k // 4 for k in range(5)]
            for k in range(4):
                size = cuts[k + 1] - cuts[k]
                out |= {f"{length} {k} {w[at : at + size]}" for at in range(max(0, cuts[k] - 3), min(n - size, cuts[k] + 3) + 1)}
        if n > LONG:
            return out
    else:
        out = set()
    level = {w}
    for _ in range(most_edits(n, n)):
        out |= level
        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
    return out | level


def near_words(words: DataFrame) -> DataFrame:
    """a, b: ordered pairs of distinct core words within the allowed edits, each word with itself too."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, k) for w in b.column(0).to_pylist() for k in _keys(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["core", "key"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [osa(x, y, m) <= m for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in (most_edits(len(x), len(y)),)]
            yield b.filter(pa.array(keep))

    keys = spread(words).mapInArrow(explode, "core string, key string").withColumn("h", F.xxhash64("key")).select("core", "h")
    pairs = keys.alias("x").join(keys.alias("y").hint("merge"), "h").select(F.col("x.core").alias("a"), F.col("y.core").alias("b")).where("a <> b").distinct()
    near = pairs.mapInArrow(verify, "a string, b string")
    return near.unionByName(words.select(F.col("core").alias("a"), F.col("core").alias("b")))


#: Log prior of a form being a party of its own; attachments below it are refused.
OWN_PARTY = math.log(1e-6)


def _attach(candidates: DataFrame) -> DataFrame:
    """v, c, score of the candidates that fit."""
    names = [f"{s}{x}" for s in ("v_", "c_") for x in _FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = {x: b.column(x).to_pylist() for x in ("v", "c", "c_w", *names)}
            got = []
            for k in range(b.num_rows):
                s = log_likelihood({x: d["v_" + x][k] for x in _FIELDS}, {x: d["c_" + x][k] for x in _FIELDS})
                if s is not None and s > OWN_PARTY:
                    got.append((d["v"][k], d["c"][k], s + math.log(d["c_w"][k])))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())], names=["v", "c", "score"])

    return candidates.select("v", "c", "c_w", *names).mapInArrow(run, "v bigint, c bigint, score double")


def parties(hits: DataFrame, columns: tuple[str, ...] = ("queried_name", "matched_name")) -> DataFrame:
    """name, party: the party (an opaque id) of every distinct spelling in the columns.

    Null, empty and placeholder names have no row.  Spellings are kept exactly as
    they stand; repeated rows only raise their frequency.
    """
    every = None
    for c in columns:
        one = hits.select(F.col(c).alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n"))
        every = one if every is None else every.unionByName(one)
    names = every.groupBy("name").agg(F.sum("n").alias("n"))
    read = staged(forms(spread(names)))
    form = read.groupBy(*_FIELDS).agg(F.sum("n").alias("n"), F.count("*").alias("spellings")).withColumn("id", F.xxhash64(*_FIELDS))
    said = F.when(F.col("kind") == "o", 4 * F.when(F.col("line") == "", 0).otherwise(F.size(F.split("line", " ")))).otherwise(
        8 * ((F.length("given") > 1) & ~F.col("given").contains("|")).cast("int") + 4 * (F.length("given") > 0).cast("int") + 2 * (F.length("middle") > 0).cast("int") + (F.col("gen") > 0).cast("int")
    )
    form = staged(form.withColumn("said", said).withColumn("w", F.col("spellings") + F.log1p("n")).withColumn(
        # A given name's initial, or for firms nothing: what a pair has in common besides the core word.
        "part", F.when(F.col("kind") == "o", F.lit("o")).otherwise(F.concat(F.lit("p"), F.substring("given", 1, 1)))
    ))
    words = form.select("core").distinct()
    near = staged(near_words(words))
    v = form.select(*(F.col(x).alias("v_" + x) for x in _FIELDS), F.col("id").alias("v"), F.col("said").alias("v_said"), F.col("w").alias("v_w"), F.col("part").alias("v_part"))
    c = form.select(*(F.col(x).alias("c_" + x) for x in _FIELDS), F.col("id").alias("c"), F.col("said").alias("c_said"), F.col("w").alias("c_w"), F.col("part").alias("c_part"))
    # A short form of several given names is found by each of their initials.
    parts = F.when(F.col("v_given").contains("|"), F.transform(F.split("v_given", r"\|"), lambda g: F.concat(F.lit("p"), F.substring(g, 1, 1)))).otherwise(F.array("v_part"))
    v = v.withColumn("join_part", F.explode(F.array_distinct(parts)))
    ranked = "v <> c and (c_said > v_said or (c_said = v_said and (c_w > v_w or (c_w = v_w and c > v))))"
    cand = v.join(near.withColumnRenamed("a", "v_core"), "v_core").join(c, (F.col("b") == F.col("c_core")) & (F.col("join_part") == F.col("c_part"))).where(ranked).drop("b", "join_part")
    best = _attach(cand).groupBy("v").agg(F.max_by("c", F.struct("score", "c")).alias("up"))
    tree = staged(form.select("id").join(best, form.id == best.v, "left").select("id", F.coalesce("up", "id").alias("up")))
    # Pointer jumping: a step halves the depth, which is at most the number of ranks on a path.
    while True:
        up = tree.select(F.col("id").alias("mid"), F.col("up").alias("top"))
        nxt = staged(tree.join(up, tree.up == up.mid, "left").select("id", "up", F.coalesce("top", "up").alias("top")))
        if nxt.where("up <> top").limit(1).count() == 0:
            break
        tree = nxt.select("id", F.col("top").alias("up"))
    return read.withColumn("id", F.xxhash64(*_FIELDS)).join(tree, "id").select("name", F.col("up").alias("party"))


def variant_pairs(hits: DataFrame, columns: tuple[str, ...] = ("queried_name", "matched_name")) -> DataFrame:
    """name_a, name_b: all pairs of different spellings of one party, the smaller first."""
    p = staged(parties(hits, columns))
    a, b = p.select(F.col("name").alias("name_a"), "party"), p.select(F.col("name").alias("name_b"), "party")
    return a.join(b, "party").where("name_a < name_b").select("name_a", "name_b")
