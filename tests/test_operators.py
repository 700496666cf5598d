"""Operators on small cases: nulls, empty and long texts, ties, repeats, clashing columns, and brute force."""

import hashlib
import hmac
import itertools
import random

import pytest
from pyspark.sql import functions as F

from casegrain.operators import carry, graph, ledger, lines, matters, parties, points, posture, quality, retrieve, roles, search, status
from casegrain.sources import readers, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_lines_of_null_empty_and_long_texts(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "a\n\n  \n<<<SOURCE x>>>\nb"), (4, "x" * 100_000)], "id int, text string")
    got = rows(lines.explode_lines(d, "id"))
    assert [(r[0], r[1], len(r[2])) for r in got] == [(3, 1, 1), (3, 5, 1), (4, 1, 100_000)]
    assert lines.explode_lines(d.where("false"), "id").count() == 0


def test_pages(spark):
    d = spark.createDataFrame([(1, "<<<PAGE 1>>>\na\n<<<PAGE 2>>>\nb"), (2, "whole"), (3, None)], "id int, text string")
    assert rows(lines.page_texts(d, "id")) == [(1, 1, "a\n"), (1, 2, "b"), (2, 1, "whole")]


def _layer(points_, layer, kind):
    return {(p[1], p[2]) if layer == "FLOAT" else p[2]: (p[3], p[4]) for p in points_ if p[0] == layer and (layer == "FLOAT" or p[1] == kind)}


def _same(got, want):
    assert got.keys() == want.keys()
    for key, (n, p) in want.items():
        assert got[key][0] == n and abs(got[key][1] - p) < 1e-6


def test_closed_forms_equal_the_sequence(spark):
    r = random.Random(3)
    kinds = [("STATE", 1.3), ("DATE", 1.25), ("COURT", 1.25), ("PARTY_A", 1.25), ("PARTY_B", 1.25), ("AMOUNT", 1.3), ("TOKEN", 0.55)]
    data = []
    for doc in range(40):
        for seq in range(r.choice([0, 1, 2, 3, 5, 9, 30])):
            k, w = r.choice(kinds)
            data.append((doc, seq, k, r.choice(["Xa", "xa", "yb b", "zcc c"]), w))
    h = spark.createDataFrame(data, "doc bigint, seq int, kind string, value string, weight double")
    again = {x["doc"] for x in points.read_again(h).collect()}
    z = points.twice(h, points.read_again(h))
    got = {"FLOAT": {}, "STIR": {}, "MIX": {}}
    for x in points.float_points(z).collect():
        got["FLOAT"].setdefault(x["doc"], {})[(x["kind"], x["value"])] = (x["hits"], x["pressure"])
    for layer, df in (("STIR", points.recurrence_points(z)), ("MIX", points.relation_points(z))):
        for x in df.collect():
            got[layer].setdefault(x["doc"], {})[x["value"]] = (x["hits"], x["pressure"])
    for doc in {x[0] for x in data}:
        reading, n = carry.process([(x[2], x[3], x[4]) for x in sorted(data) if x[0] == doc])
        assert (n == 2) == (doc in again)
        for layer, kind in (("FLOAT", None), ("STIR", "RECURRENCE"), ("MIX", "REL")):
            _same(got[layer].get(doc, {}), _layer(reading.points(), layer, kind))
    assert again and len(again) < 40


def test_closed_forms_equal_the_sequence_on_texts(spark):
    from casegrain.plans import catalog

    d = "/root/testdata/sf0.01"
    h = catalog._first_hits(spark, d).where("doc % 3 = 0")
    z = points.twice(h, points.read_again(h))
    got = {}
    for x in points.float_points(z).collect():
        got.setdefault(x["doc"], {})[(x["kind"], x["value"])] = (x["hits"], x["pressure"])
    rel = {}
    for x in points.relation_points(z).collect():
        rel.setdefault(x["doc"], {})[x["value"]] = (x["hits"], x["pressure"])
    by = {}
    for x in h.collect():
        by.setdefault(x["doc"], []).append((x["seq"], x["kind"], x["value"], x["weight"]))
    records = {x["doc"]: x for x in carry.document_records(h).collect()}
    assert len(by) > 150
    for doc, hits in by.items():
        reading, n = carry.process([x[1:] for x in sorted(hits)])
        _same(got[doc], _layer(reading.points(), "FLOAT", None))
        _same(rel.get(doc, {}), _layer(reading.points(), "MIX", "REL"))
        assert records[doc]["pass"] == n and records[doc]["float_points"] == len(got[doc]) and 0 <= records[doc]["clarity"] <= 1


def _plain_carry(hits):
    """Joint points by the rules, stated plainly: all lists are sorted again at every hit."""
    import math

    floats, rel, rec, joint = {}, {}, {}, {}

    def hit(store, key, w):
        n = store.get(key, (0, 0))[0] + 1
        store[key] = (n, w * math.log1p(n))

    best = lambda store, least: sorted((k for k in store if store[k][1] >= least), key=lambda k: -store[k][1])[:24]
    norm = lambda v: " ".join(v.lower().split())
    pairs = {frozenset(p) for p in points.P.RELATED}
    for kind, value, w in hits:
        hit(floats, (kind, value), w)
        p = floats[kind, value][1]
        if kind in points.P.RECURRING and floats[kind, value][0] >= 2:
            hit(rec, f"{kind}={norm(value)}", min(1.75, 0.5 + p / 2))
        for (k, v), (_, q) in list(floats.items()):
            if (k, v) != (kind, value) and frozenset((k, kind)) in pairs and min(p, q) >= 0.65:
                hit(rel, "|".join(f"{a}={b}" for a, b in sorted([(kind, norm(value)), (k, norm(v))])), min(1.75, (p + q) / 2))
        for f in best(floats, 0.65):
            for store, mark in ((rel, "M"), (rec, "S")):
                for t in best(store, 0.75):
                    if len(norm(f[1])) >= 3 and norm(f[1]) in t and not (mark == "S" and t == f"{f[0]}={norm(f[1])}"):
                        hit(joint, f"F[{f[0]}:{norm(f[1])}]<->{mark}[{t}]", min(2.0, (floats[f][1] + store[t][1]) / 2))
    return joint


def test_carry_equals_the_rules_stated_plainly():
    r = random.Random(8)
    for _ in range(30):
        kinds = [("STATE", 1.3), ("DATE", 1.25), ("COURT", 1.25), ("PARTY_A", 1.25), ("PARTY_B", 1.25), ("AMOUNT", 1.3), ("TOKEN", 0.55)]
        hits = [(*(lambda k: (k[0], r.choice(["georgia", "Georgia", "court of georgia", "may 3", "geo", "acme", "acme inc"]) + r.choice(["", f" {r.randint(1, 9)}"]), k[1]))(r.choice(kinds)),) for _ in range(r.randint(1, 120))]
        reading = carry.Reading()
        reading.read(hits)
        got = {p[2]: (p[3], p[4]) for p in reading.points() if p[1] in ("FLOAT_MIX", "FLOAT_STIR")}
        _same(got, _plain_carry(hits))


def test_carry_is_bounded_and_no_tautology():
    reading = carry.Reading()
    reading.read([("STATE", "Georgia", 1.3), ("COURT", "Supreme Court of Georgia", 1.25)] * 3)
    values = [p[2] for p in reading.points() if p[1] in ("FLOAT_MIX", "FLOAT_STIR")]
    assert values and max(map(len, values)) < 300 and len(values) < 100
    assert not any(v.startswith("F[STATE:georgia]<->S[STATE=georgia]") for v in values)


def test_hits_are_found_whatever_stands_before_them(spark):
    t = "cited § 9-11-56 and 42 U.S.C. § 1983.\nAcme Corp. v. Brown Inc.\nOn March 3, 2019 the United States District Court awarded $1,200.50 for 30 days, a sum of 5,000. See 123 F. Supp. 2d 456; 12 S.W.3d 34; 5 N.E.2d 6."
    d = spark.createDataFrame([(1, t, "2003", "0"), (2, None, "x", None), (3, "", None, None)], "id int, text string, y string, c string")
    got = {(r["doc"], r["kind"], r["value"]) for r in points.first_hits(d, "id", fields={"year": "y", "court": "c"}).collect()}
    want = [("STATUTE", "§ 9-11-56"), ("STATUTE", "42 U.S.C. § 1983"), ("DATE", "March 3, 2019"), ("COURT", "United States District Court"), ("AMOUNT", "$1200.50"), ("AMOUNT", "$5000"), ("MEASURE", "30 days"), ("CITATION", "123 F. Supp. 2d 456"), ("CITATION", "12 S.W.3d 34"), ("CITATION", "5 N.E.2d 6"), ("YEAR", "2003"), ("PARTY_A", "Acme Corp"), ("PARTY_B", "Brown Inc")]
    assert {(1, *w) for w in want} <= got and not any(g[0] != 1 or g[2] == "0" for g in got)
    years = spark.createDataFrame([(1, "2003"), (2, "2020"), (3, "soon")], "doc bigint, year string")
    h = points.first_hits(d, "id", fields={"year": "y"})
    assert [r["doc"] for r in points.read_again(h, years, 2026).collect()] == [1]


def test_terms_and_scores(spark):
    assert retrieve.question_terms("What is the roof, the roof and non-payment?") == ["roof", "roof", "non-payment"]
    assert retrieve.research_terms("roof Roof wall", ["Bad faith"]) == ["roof", "wall", "faith"]
    d = spark.createDataFrame([(1, 1, "roof roof"), (1, 2, "wall"), (2, 1, None)], "id int, line int, text string")
    assert rows(retrieve.search(d, "roof", "id")) == [(1, 1, "roof roof", 2)]


CTX = "case_id string, source string, rank int, line int, text string, noise boolean, score double"


def test_context_takes_short_lines_past_a_long_one(spark):
    d = spark.createDataFrame([("c", "a", 9, 1, "x" * 5000, False, 0.0), ("c", "a", 9, 2, "<<<SOURCE a>>>", True, 0.0), ("c", "a", 9, 3, "short", False, 0.0), (None, "a", 9, 1, "y", False, 1.0)], CTX)
    assert [(r["line"], r["text"]) for r in retrieve.context(d, 500).collect()] == [(3, "short")]


def test_context_reaches_the_end_of_a_long_document(spark):
    body = [("c", "long", 9, k, f"filler line number {k} of a long document", False, 0.0) for k in range(1, 3000)] + [("c", "long", 9, 3000, "the roof at last", False, 5.0)]
    first = [("c", "complaint", 1, k, f"count {k}", False, 0.0) for k in range(1, 400)]
    d = spark.createDataFrame(body + first, CTX)
    got = retrieve.context(d, 3000).collect()
    assert ("long", 3000) in {(r["source"], r["line"]) for r in got} and ("complaint", 1) in {(r["source"], r["line"]) for r in got}
    assert sum(r["chars"] + 8 for r in got) <= 3000
    assert {(r["source"], r["line"]) for r in got} == {(r["source"], r["line"]) for r in retrieve.context(d.orderBy(F.rand(1)), 3000).collect()}


def test_file_names_count_and_so_do_bookkeeping_lines(spark):
    d = spark.createDataFrame([("c", "1", "Mold Assessment.pdf", 1, "visible growth"), ("c", "1", "Mold Assessment.pdf", 2, "<<<SOURCE mold>>>"), ("c", "2", "letter.txt", 1, "the roof"), ("d", "3", "x", 1, "mold")], "case_id string, source string, name string, line int, text string")
    d = d.withColumn("noise", F.startswith("text", F.lit("<<<SOURCE ")))
    got = {(r["source"], r["line"]): r["score"] for r in retrieve.score_lines(d, ["mold"], "case_id", "name").collect()}
    import math

    assert abs(got["1", 1] - math.log(1 + 3 / 2)) < 1e-6 and got["1", 2] == 0 and got["2", 1] == 0 and abs(got["3", 1] - math.log(1.5)) < 1e-6
    only = retrieve.score_lines(d.withColumn("matter", F.col("source")), ["mold"], "case_id", "name", matter="2").collect()
    assert [r["source"] for r in only] == ["2"]


def test_bm25_against_a_plain_computation(spark):
    titles = ["roof supply", "Roof roof bank", "Café supply", None, "", "bank", "bank of roofs", "supply"]
    d = spark.createDataFrame(list(enumerate(titles)), "result_id int, title string")
    got = dict(search.bm25(d, "result_id", "title", "roof").select("result_id", "score").collect())
    import math

    docs = [(t or "").lower().split() for t in titles]
    n, df = len(docs), sum("roof" in t for t in docs)
    avg = sum(map(len, docs)) / n
    idf = math.log((n - df + 0.5) / (df + 0.5))
    for k, t in enumerate(docs):
        f = t.count("roof")
        if f:
            assert abs(got[k] - idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / avg))) < 1e-5
    assert set(got) == {0, 1}


def test_party_matches_equal_all_pairs(spark):
    r = random.Random(1)
    words = "acme brown delta smith trust north roof bank".split()
    names = [" ".join(r.sample(words, r.randint(1, 5))) + r.choice(["", " LLC", " Inc."]) for _ in range(120)] + [None, "", "LLC"]
    q = spark.createDataFrame([(n,) for n in names[:60]] + [(None,)], "name string")
    p = spark.createDataFrame([("c", n) for n in names[60:]], "case_id string, name string")

    def key(n):
        import re

        w = re.findall("[a-z0-9]+", (n or "").lower())
        while w and w[-1] in {"llc", "inc"}:
            w.pop()
        return " ".join(w)

    want = set()
    for a, b in itertools.product({key(n) for n in names[:60]}, {key(n) for n in names[60:]}):
        x, y = set(a.split()), set(b.split())
        if a and b and a == b:
            want.add((a, b, "exact"))
        elif len(x) >= 2 and len(y) >= 2 and len(x & y) / min(len(x), len(y)) >= 0.8:
            want.add((a, b, "possible"))
    assert {tuple(t) for t in parties.key_matches(q, p).collect()} == want


def test_conflicts_leave_the_own_case_out(spark):
    q = spark.createDataFrame([("a", "Acme Brown LLC"), (None, "acme brown"), ("b", None)], "case_id string, name string")
    p = spark.createDataFrame([("a", "ACME Brown"), ("b", "Acme Brown, Inc."), ("c", "acme brown delta"), ("d", "")], "case_id string, name string")
    assert set(rows(parties.matches(q, p))) == {("a", "acme brown", "acme brown", "b", "exact"), ("a", "acme brown", "acme brown delta", "c", "possible"), (None, "acme brown", "acme brown", "a", "exact"), (None, "acme brown", "acme brown", "b", "exact"), (None, "acme brown", "acme brown delta", "c", "possible")}


def test_suffixes_and_captions(spark):
    d = spark.createDataFrame([("Acme Incorporated",), ("ACME, LLC",), ("Smith v. Acme LLC",), (None,)], "n string")
    assert [x[0] for x in d.select(parties.party_key(F.col("n"))).collect()] == ["acme", "acme", "smith v acme", ""]
    assert d.select(parties.caption_parties(F.col("n"))).collect()[2][0] == ["Smith", "Acme LLC"]


@pytest.mark.parametrize("name,role", [("Complaint_Stamm_v_Kin.txt", "operative_pleading"), ("2024-03_Answer.pdf", "responsive_pleading"), ("signed.order.pdf", "order"), ("policy_11.docx", "instrument"), ("Depo_transcript_1.pdf", "deposition"), ("scan_01.pdf", "unclassified"), (None, "unclassified")])
def test_roles(spark, name, role):
    d = spark.createDataFrame([(name, "")], "n string, t string")
    assert roles.with_role(d, "n", "t").first()["role"] == role


def test_text_beats_a_useless_name(spark):
    d = spark.createDataFrame([("Exhibit C.pdf", "COMPLAINT FOR DAMAGES")], "n string, t string")
    assert roles.with_role(d, "n", "t").first()["role"] == "operative_pleading"


def _brute_affirmed(text, pattern):
    import re

    for m in re.finditer(pattern, text, re.I):
        a = max([text.rfind(c, 0, m.start()) + 1 for c in ".;:\n"])
        ends = [k for c in ".;:\n" if (k := text.find(c, m.end())) >= 0]
        clause, before = text[a : min(ends) if ends else len(text)], text[a : m.start()]
        if not re.search(posture.P.NEGATION, re.sub(r"\bnot\s+only\b", "", clause, flags=re.I)) and not re.search(r"\b(?:den(?:y|ies|ied)|disput(?:e|es|ed))\b(?:\s+that)?[^.;:\n]{0,32}$", before, re.I):
            return True
    return False


def test_affirmed_equals_matches_in_their_clauses(spark):
    r = random.Random(5)
    bits = ["the carrier", "denies that", "the policy was breached", "not", "never", "refused", "; ", ". ", ": ", "denied", "disputes", "and", "a very long stretch of other words here", "failed to pay", "without", "only"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randint(1, 9))) for _ in range(400)]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for p in (r"\b(fail\w*|refus\w*|den\w*|breach\w*)\b", r"\b(policy|carrier)\b"):
        got = {x[0]: x[1] for x in d.select("id", posture.affirmed(F.col("t"), p)).collect()}
        assert got == {k: _brute_affirmed(t, p) for k, t in enumerate(texts)}


def test_negation_is_scoped_to_its_clause(spark):
    d = spark.createDataFrame([("The carrier refused.",), ("No carrier refused the claim.",), ("Nobody came; it refused to pay $24,300.00 on time",), ("It not only refused but left",), ("She denies that it refused.",), (None,)], "t string")
    assert [x[0] for x in d.select(posture.affirmed(F.col("t"), "refused")).collect()] == [True, False, True, True, False, False]


def test_amounts_in_figures_and_words(spark):
    t = ["paid $1,200.50 and 5,000 dollars", "attorney's fees of $300.00", "the carrier never paid $99.00", "a sum of 700", "$0.00", "FIVE THOUSAND DOLLARS for 12 days", "2,000 spores per cubic meter", None]
    got = rows(posture.amounts(spark.createDataFrame([(k, 1, x) for k, x in enumerate(t)], "id int, line int, text string"), "id"))
    assert [(r[0], r[3], r[4], r[5]) for r in got] == [
        (0, "MONEY_BENEFIT", "$1,200.50", 1200.5), (0, "MONEY_BENEFIT", "5,000 dollars", 5000.0), (1, "MONEY_EXTRA", "$300.00", 300.0), (3, "MONEY_BENEFIT", "sum of 700", 700.0),
        (5, "MONEY_BENEFIT", "Five Thousand", None), (5, "MEASURE", "12 days", 12.0), (6, "MEASURE", "2,000 spores per cubic meter", 2000.0),
    ]


def _case(spark, *papers):
    rows_ = [("c", f"{k}", n, role, line) for k, (role, text) in enumerate(papers) for n, line in enumerate(text.split("\n"), 1)]
    x = spark.createDataFrame(rows_, "case_id string, source string, line int, role string, text string")
    sup = posture.supports(x, "case_id")
    adverse = posture.adverse_pattern(x.where(~F.col("role").isin(posture.P.ASSERTING)), "case_id", "source")
    return {r["theory"]: r for r in posture.resolve(posture.pleaded(x, "case_id"), sup, adverse, "case_id").collect()}, sup


def test_a_pleading_asserts_and_cannot_support(spark):
    plea = ("operative_pleading", "Count I: breach of the policy.\nThe policy was breached on May 3, 2020.\nThe damage cost $5,000.00.")
    got, sup = _case(spark, plea)
    assert got["breach_of_contract"]["supported"] == 0 and all(r["support"] == 0 and r["asserted"] > 0 for r in sup.collect())
    got, _ = _case(spark, plea, ("instrument", "This policy covers the house"), ("expert", "repair estimate $9,000.00"))
    f = got["breach_of_contract"]
    assert (f["supported"], f["folded"], f["predicted"], f["resolved"], f["asserted_only"]) == (2, "A+B", 3, False, True)
    got, _ = _case(spark, plea, ("instrument", "This policy covers the house"), ("expert", "repair estimate $9,000.00"), ("correspondence", "the carrier refused the claim"))
    assert got["breach_of_contract"]["resolved"]


def test_theories_come_from_what_is_pleaded(spark):
    got, _ = _case(spark, ("operative_pleading", "Count I: bad faith. It is no negligence. Defendant denies fraud."), ("responsive_pleading", "legal malpractice"), ("correspondence", "negligence"))
    assert set(got) == {"bad_faith"}
    assert _case(spark, ("responsive_pleading", "bad faith"))[0] == {}
    got, _ = _case(spark, ("operative_pleading", "the breach. It concerns the contract"))
    assert set(got) == {"breach_of_contract"}


def test_benefit_is_no_harm_of_bad_faith(spark):
    plea = ("operative_pleading", "Count I: bad faith")
    got, _ = _case(spark, plea, ("correspondence", "the adjuster knowingly delayed"), ("expert", "repair estimate $9,000.00 and interest"))
    assert got["bad_faith"]["supported"] == 2 and not got["bad_faith"]["resolved"] and got["bad_faith"]["predicted"] == 1
    days = "\n".join(f"denied on May {k}, 2020" for k in range(1, 5)) + "\ndenied on May 1, 2020"
    got, _ = _case(spark, plea, ("correspondence", days))
    assert got["bad_faith"]["noted"] and not got["bad_faith"]["resolved"]


def test_channels_close(spark):
    for a, b in itertools.product(range(4), repeat=2):
        assert a ^ b ^ b == a


def test_matters_by_precedence(spark):
    a = "IN COURT\nElizabeth Stamm v. Kin Insurance Corp.\nClaim No. CLM-123456\nCase No. 1:20-cv-77"
    b = "Elizabeth Stamm v. Your Attorney PLLC\nClaim No. CLM-123456"
    d = spark.createDataFrame([("c", 1, a, "x"), ("c", 2, b, "draft.txt"), ("c", 3, "denial of claim no. CLM-123456", ""), ("c", 4, "Case No. 1:20-cv-77", None), ("c", 5, "hello", ""), (None, 6, None, None), ("d", 7, "claim no. CLM-123456", "")], "case_id string, id bigint, text string, name string")
    s = matters.read_signals(d, "id", "case_id", "name")
    m = matters.assign(s)
    assert {r["doc"]: (r["matter"], r["how"]) for r in m.collect()} == {1: (1, "caption"), 2: (2, "caption"), 3: (1, "first owner of claim"), 4: (1, "docket"), 5: (None, "none"), 6: (None, "none"), 7: (None, "none")}
    links = {(r["why"], r["value"], r["matter"]) for r in matters.links(s).collect()}
    assert {("claim", "CLM-123456", 1), ("claim", "CLM-123456", 2), ("party", "stamm", 1), ("party", "stamm", 2)} <= links
    assert {r["matter"]: r["state"] for r in matters.states(s, m).collect()} == {1: "filed", 2: "building"}
    assert [(r["matter_id"], r["label"]) for r in matters.numbered(matters.matters(s)).orderBy("first_doc").collect()] == [("MATTER-01", "Stamm v. Kin Insurance"), ("MATTER-02", "Stamm v. Your Attorney")]


def test_matter_numbers_over_ranges(spark):
    m = spark.createDataFrame([("c", k * 7) for k in range(2000)] + [("d", 5)], "case_id string, first_doc bigint")
    got = matters.numbered(m, 6).where("case_id = 'c'").orderBy("first_doc").collect()
    assert [r["matter_no"] for r in got] == list(range(1, 2001)) and got[-1]["matter_id"] == "MATTER-2000"


def test_status_algebra(spark):
    d = spark.createDataFrame([("g", 10.0, 1, "VALIDATED", "a"), ("g", 20.0, 3, None, "b")], "g string, v double, w int, s string, src string")
    r = status.stir(d, ["g"], "v", "w", "s", "src").first()
    assert (r["value"], r["status"], r["mass"]) == (17.5, "UNVERIFIED", 2)
    assert status.floor(d, ["g"], "s").first()["status"] == "UNVERIFIED"
    tie = spark.createDataFrame([("g", 1.0, 1, "VALIDATED", "a"), ("g", 1.0, 1, "EXPLAINED", "b")], "g string, v double, w int, s string, src string")
    assert status.stir(tie, ["g"], "v", "w", "s", "src").first()["status"] == "EXPLAINED"


def test_pressure_never_promotes(spark):
    once = spark.createDataFrame([("g", "SPECULATIVE")], "g string, s string")
    many = once
    for _ in range(4):
        many = many.unionByName(many)
    assert status.floor(once, ["g"], "s").collect() == status.floor(many, ["g"], "s").collect()


def test_claims_of_all_marks(spark):
    d = spark.createDataFrame([(1, "x [[[A b]]] {[c]} [[d]] [{e}] [src.txt:4]"), (2, None)], "id int, t string")
    assert [(r["status"], r["claim"]) for r in status.claims(d, "id", "t").orderBy("pos").collect()] == [("VALIDATED", "A b"), ("EXPLAINED", "c"), ("SPECULATIVE", "d"), ("UNVERIFIED", "e")]


def test_page_scores_of_empty_pages(spark):
    d = spark.createDataFrame([(1, 1, None), (1, 2, ""), (1, 3, "word " * 40)], "id int, page int, text string")
    got = {r["page"]: r for r in quality.page_scores(d, "id").collect()}
    assert got[1]["failed"] and got[2]["noise_ratio"] == 0 and not got[3]["failed"]


def test_hmac_equals_the_library(spark):
    d = spark.createDataFrame([(bytearray(b"key"), bytearray(b"message")), (bytearray(b"k" * 64), bytearray(b""))], "k binary, m binary")
    for r in d.withColumn("h", ledger.hmac_sha256(F.col("k"), F.col("m"))).collect():
        assert r["h"] == hmac.new(bytes(r["k"]), bytes(r["m"]), hashlib.sha256).hexdigest()


def test_chain_finds_gaps_and_edits(spark):
    d = spark.createDataFrame([("a", 1, "h1", None), ("a", 2, "h2", "h1"), ("a", 4, "h4", "h2"), ("a", 5, "h5", "xx")], "k string, s int, stamp string, prev string")
    assert rows(ledger.chain_breaks(d, ["k"], "s", "stamp", "prev")) == [("a", 4, "gap"), ("a", 5, "broken link")]


def test_replace_and_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "id int, origin string")
    b = spark.createDataFrame([(9, "y")], "id int, origin string")
    assert rows(ledger.replace_origin(a, b, "origin", "y")) == [(1, "x"), (9, "y")]
    assert rows(ledger.manifest_diff(a, a)) == [] and len(rows(ledger.manifest_diff(a, a.distinct()))) == 1


def test_breadcrumbs_end_in_a_cycle(spark):
    n = spark.createDataFrame([(1, None), (2, 1), (3, 2), (7, 8), (8, 7)], "id int, parent int")
    got = dict(graph.breadcrumbs(spark, n).collect())
    assert got[3] == "1 > 2 > 3" and got[7].count(">") == 4


def _zip(files):
    import io
    import zipfile

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return b.getvalue()


def test_readers_keep_every_file(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    files = {
        "a.txt": b"plain \xff", "b.html": b"<p>One &amp; two</p><script>x</script>", "c.csv": b'a,"b, c"\n1,2\n', "d.rtf": rb"{\rtf1 {\fonttbl x} Hello\par W\'e9}",
        "e.docx": _zip({"word/document.xml": f'<w:document xmlns:w="{w}"><w:p><w:t>First</w:t></w:p><w:p><w:t>Second</w:t></w:p></w:document>'}),
        "f.xlsx": _zip({"xl/workbook.xml": '<workbook><sheet name="S"/></workbook>', "xl/worksheets/sheet1.xml": "<worksheet><row><c><v>1</v></c><c><v>2</v></c></row></worksheet>"}),
        "g.pptx": _zip({"ppt/slides/slide1.xml": "<s><p><t>Slide</t></p></s>"}), "h.odt": _zip({"content.xml": "<d><p>Odd</p></d>"}),
        "i.eml": b"From: a@x\nTo: b@x\nSubject: Hi\nContent-Type: text/plain\n\nBody\n", "j.docx": b"broken", "k.exe": b"MZ", "l.png": b"PNG",
    }
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    got = {r["path"].rsplit("/", 1)[-1]: r for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert set(got) == set(files)
    text = {n: r["text"] for n, r in got.items()}
    assert text["b.html"] == "One & two" and text["c.csv"] == "a | b, c\n1 | 2" and text["d.rtf"] == "Hello\nWé" and text["e.docx"] == "First\nSecond"
    assert text["f.xlsx"] == "<<<SHEET S>>>\n1 | 2" and text["g.pptx"] == "<<<SLIDE 1>>>\nSlide" and text["h.odt"] == "Odd" and text["i.eml"].endswith("Body")
    assert got["j.docx"]["error"] and got["k.exe"]["error"] and got["l.png"]["error"] and text["j.docx"] is None
    assert readers.read_bytes("x.png", b"", lambda b, k: "seen")[0] == "seen"


def test_jsonl_and_shards(spark, tmp_path):
    import sqlite3

    (tmp_path / "x.jsonl").write_text('{"source": "a", "line": 1, "text": "t"}\nbad\n{"source": "b"}\n')
    assert rows(readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "source string, line int, text string", ("source", "line", "text"))) == [("a", 1, "t")]
    c = sqlite3.connect(tmp_path / "s.db")
    c.execute("create table docs (id text, case_name text, text text)")
    c.execute("insert into docs values ('1', 'A v. B', '')")
    c.commit()
    c.close()
    assert rows(readers.read_shards(spark, str(tmp_path))) == [("s.db", "1", "A v. B", None, None, None, None)]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("c1", 1, "a"), ("c2", 2, "b")], "case_id string, line int, text string")
    sinks.write_corpus(d, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("case_id = 'c2'").count() == 1
    assert sinks.canonical_json({"b": 1, "a": [1, "é"]}) == '{"a":[1,"é"],"b":1}'


def test_stream_of_arrivals(spark, tmp_path):
    from casegrain.streaming import increments as inc

    src = str(tmp_path / "in")
    spark.sql("select * from values (1, 'A', timestamp'2024-01-01 01:00:00'), (1, 'A', timestamp'2024-01-01 01:00:00'), (2, 'B', timestamp'2024-01-01 02:00:00') as t(id, kind, at)").write.parquet(src)
    s = inc.arriving(spark, src, "id int, kind string, at timestamp")
    q = inc.windowed_counts(s, "at", "id", "kind").writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {(r["kind"], r["rows"]) for r in spark.table("counts").collect()} == {("A", 1), ("B", 1)}
    b = spark.createDataFrame([("A", 2)], "kind string, n int")
    at = str(tmp_path / "t")
    for batch in (0, 1, 1, 2, 2):  # a batch that is replayed counts once
        inc.upsert_counts(b, batch, at, ["kind"], "n")
    assert rows(inc.totals(spark, at)) == [("A", 6)]


def test_scalars(spark):
    from casegrain.functions import scalars as s

    d = spark.createDataFrame([("1.10", "$1,200.50", "2024-02-30", "see [ABC:12] and [est.txt:4] [x]", '{"a": 1}'), ("1.9", "n/a", "2024-02-29", None, "bad")], "v string, m string, d string, t string, j string")
    r = d.select(s.version(F.col("v")).alias("v"), s.safe_number(F.col("m")).alias("m"), s.iso_date(F.col("d")).cast("string").alias("d"), s.source_markers(F.col("t")).alias("t"), s.json_answer(F.col("j"), "a int").alias("j"), s.shortened(F.col("m"), 5).alias("s"), s.ordered_union(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))).alias("u")).collect()
    assert r[0]["v"] > r[1]["v"] and (r[0]["m"], r[1]["m"]) == (1200.5, None) and (r[0]["d"], r[1]["d"]) == (None, "2024-02-29")
    assert r[0]["t"] == ["[ABC:12]", "[est.txt:4]"] and r[0]["j"]["a"] == 1 and r[1]["j"]["a"] is None and r[0]["s"] == "$1..." and r[0]["u"] == ["b", "a", "c"]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "id bigint, text string, name string, case_id string")
    h = points.first_hits(d, "id")
    assert h.count() == 0 and carry.document_records(h).count() == 0 and points.read_again(h).count() == 0 and matters.assign(matters.read_signals(d, "id")).count() == 0
    assert parties.matches(d.select("case_id", "name"), d.select("case_id", "name")).count() == 0
    assert ledger.rule_findings(d, "id", "US-FEDERAL-CIVIL").count() == 0
    x = d.selectExpr("case_id", "name source", "0 line", "name role", "text")
    assert posture.supports(x, "case_id").count() == 0 and search.bm25(d, "id", "text", "a").count() == 0
    assert retrieve.context(d.selectExpr("case_id", "name source", "1 rank", "0 line", "text", "false noise", "0D score")).count() == 0


def test_rules_of_packs(spark):
    d = spark.createDataFrame([(1, "United States District Court\nA v. B\nCase No. 1\n/s/ X, SSN 123-45-6789", "complaint", {"county": "Fulton"}), (2, None, None, None)], "id int, text string, kind string, meta map<string,string>")
    fed = rows(ledger.rule_findings(d, "id", "US-FEDERAL-CIVIL").select("id", "code"))
    assert fed == [(1, "FRCP-5.2-SSN"), (2, "FRCP-10-COURT"), (2, "FRCP-10-FILE-NUMBER"), (2, "FRCP-10-TITLE"), (2, "FRCP-11-SIGNATURE")]
    f = ledger.rule_findings(d, "id", "GA-SUPERIOR-CIVIL", kind="kind", metadata="meta")
    assert {(1, "GA-CASE-FILING-FORM"), (2, "GA-COUNTY-LOCAL-RULES")} <= set(rows(f.select("id", "code"))) and (1, "GA-COUNTY-LOCAL-RULES") not in rows(f.select("id", "code")) and (2, "GA-CASE-FILING-FORM") not in rows(f.select("id", "code"))
    assert {(r["id"], r["passed"]) for r in ledger.preflight(d, "id", f, "GA-SUPERIOR-CIVIL").collect()} == {(1, False), (2, False)}
    assert spark.range(1).select(ledger.pack_of(F.lit(" Georgia ")), ledger.pack_of(F.lit("x-1"))).first()[:] == ("GA-SUPERIOR-CIVIL", "X-1")


def test_marks_that_no_record_allows_are_taken_back(spark):
    d = spark.createDataFrame([(1, "# Head\nbare line\n[[[Held A]]] and [[[Held B]]]\nNote:\n\n- {[x]}"), (2, None)], "id int, t string")
    ok = spark.createDataFrame([("held a",)], "claim_key string")
    assert rows(status.enforced(d, "id", "t", ok)) == [(1, "# Head\n[[bare line]]\n[[[Held A]]] and [[Held B]]\nNote:\n\n- {[x]}")]
    c = status.claims(d, "id", "t")
    assert sorted(r["status"] for r in status.demote(c, ok).collect()) == ["EXPLAINED", "SPECULATIVE", "VALIDATED"]
    assert spark.range(1).select(status.rank_of(F.lit("[[[ ]]]"))).first()[0] == 3


def test_maps(spark):
    t = spark.createDataFrame([(1, "AMOUNT", 2.0), (1, "DATE", 1.0), (2, "TOKEN", 9.0), (3, "STATE", 1.0), (3, "DATE", 1.0)], "doc bigint, kind string, pressure double")
    e = {r["doc"]: (r["left"], r["right"], r["residue"]) for r in graph.document_edges(t).collect()}
    assert e == {1: (1, 3, 2), 2: (0, 0, 0), 3: (2, 3, 1)}
    p = spark.createDataFrame([(1, "MIX", "REL", "COURT=x|DATE=y", 1, 2.0, 0), (1, "STIR", "FLOAT_MIX", "F[STATE:ga]<->M[COURT=supreme|STATE=ga]", 1, 1.0, 1), (1, "FLOAT", "STATE", "a|b", 1, 1.0, 2)], "doc bigint, layer string, kind string, value string, hits bigint, pressure double, place int")
    n = graph.point_nodes(p)
    parts = {r["layer"]: [(x["kind"], x["value"]) for x in r["parts"]] for r in n.collect()}
    assert parts == {"MIX": [("COURT", "x"), ("DATE", "y")], "STIR": [("STATE", "ga"), ("COURT", "supreme|STATE=ga")], "FLOAT": []}
    inner = [(r["layer"], r["part"], r["channel"], r["residue"]) for r in graph.inner_views(n).orderBy("layer", "part").collect()]
    assert inner == [("MIX", 0, 2, 1), ("MIX", 1, 3, None), ("STIR", 0, 2, 0), ("STIR", 1, 2, None)]
    r = spark.createDataFrame([("c", 1, "UNVERIFIED", "s1", 1, 1, 1, 1.0), ("c", 2, "UNVERIFIED", "s2", 1, 1, 1, 2.0)], "case_id string, doc bigint, status string, pattern_signature string, float_points int, mix_points int, stir_points int, total_pressure double")
    a, b = graph.map_signature(r, "case_id"), graph.map_signature(r.orderBy(F.desc("doc")), "case_id")
    assert a.collect() == b.collect() and graph.changed(a, b, "case_id").count() == 0
    assert graph.changed(graph.map_signature(r.where("doc = 1"), "case_id"), b, "case_id").count() == 1


def test_a_kept_head_tells_what_was_changed(spark):
    log = spark.createDataFrame([("a", 1, "h1", None), ("a", 2, "h2", "h1"), ("b", 1, "k1", None), ("b", 2, "k2", "zz"), ("d", 1, "m1", None)], "k string, s int, stamp string, prev string")
    kept = spark.createDataFrame([("a", 1, "h1"), ("b", 2, "k2"), ("d", 1, "other")], "k string, anchor_seq int, anchor_stamp string")
    got = ledger.chain_state(log, ["k"], "s", "stamp", ledger.chain_breaks(log, ["k"], "s", "stamp", "prev"), kept)
    assert {r["k"]: r["state"] for r in got.collect()} == {"a": "extended", "b": "mismatch", "d": "mismatch"}


def test_rule_packs_are_read_from_files(spark, tmp_path):
    import json

    (tmp_path / "a.json").write_text(json.dumps({"schema_version": 1, "id": "X-1", "label": "X", "rules": [{"type": "forbidden_pattern", "code": "NO", "severity": "error", "pattern": "secret"}, {"type": "metadata_required", "code": "M", "field": "county", "applies_to": ["Complaint"]}]}, indent=1))
    (tmp_path / "b.json").write_text("not json")
    rules = readers.load_rules(readers.read_documents(spark, str(tmp_path / "*.json"), readers.PACK))
    assert rules == {"X-1": [("forbidden_pattern", "NO", "error", "secret", ["*"], ""), ("metadata_required", "M", "warning", "county", ["complaint"], "")]}
    d = spark.createDataFrame([(1, "a Secret", "complaint"), (2, "open", "order")], "id int, text string, kind string")
    assert rows(ledger.rule_findings(d, "id", "X-1", kind="kind", rules=rules["X-1"]).select("id", "code")) == [(1, "M"), (1, "NO")]


def test_claim_graphs_and_their_handoff(spark):
    from casegrain.operators import claims_graph as cg

    c = spark.createDataFrame([(1, "r", "AB"), (2, "r", "ab"), (3, None, "x"), (4, "r", None), (5, "r", "q")], "k int, revision string, sha string")
    g = spark.createDataFrame([(1, True, "1.3.2", "r", "ab"), (2, True, "1.3.1", "r", "ab"), (3, True, "2.0", None, "x"), (4, True, "2.0", "r", None)], "k int, ready boolean, writer string, revision string, sha string")
    assert {r["k"]: r["state"] for r in cg.handoff(c, g, "k").collect()} == {1: "ok", 2: "not ready", 3: "revision", 4: "hash", 5: "missing"}
    raw = spark.createDataFrame([("c", '{"edges": [{"id": "e", "fromNodeId": "a", "toNodeId": "b", "bracket": "{[]}"}]}'), ("d", "bad")], "k string, raw string")
    assert rows(cg.edges(cg.parse(raw, "k", "raw"), "k")) == [("c", "e", "a", "b", None, "EXPLAINED")]
