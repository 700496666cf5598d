"""Labelled spans for the personal-information tagger, and its training.

    python -m casegrain.llm.pii_train DATA_DIR OUT.npz [MINUTES [START.npz]]

No labelled table exists, so the labels come from distant supervision: patterns
that are sure of their context mark spans in clean texts; the marked texts are
then varied (given names, case, scanning noise) with their spans carried along,
so that the tagger learns contexts and shapes rather than the patterns.  The
sample is bounded by SAMPLE_TEXTS.  The patterns are used for training only.
"""

from __future__ import annotations

import re
import sys
import time

import numpy as np

from . import crf_tagger as M

SAMPLE_TEXTS = 9000  # bound of the labelled sample
TRAIN_WINDOW, BATCH, HIDDEN = 168, 128, 48

# Given names and short forms met in case files.
GIVEN = """Albert Anton Augusta Beatrice Benjamin Charlotte Christopher Clement Deborah Dorothy Edward Eleanor
Elizabeth Florence Frederick Gerald Gregory Gwendolyn Henrietta Howard Isabella Ivan Jonathan Josephine Katherine
Kenneth Leonard Lucinda Margaret Matthew Michael Nathaniel Nicolette Oliver Ophelia Peter Philippa Quentin Raymond
Rebecca Richard Robert Samuel Stephanie Tabitha Theodore Timothy Ursula Victoria Vincent Walter William Winifred
Yvonne Zachary Zelda Al Bertie Tony Gus Bea Ben Charlie Lottie Chris Kit Clem Deb Debbie Dot Ed Eddie Ned Ellie Nell Liz Beth
Betty Flo Fred Freddie Gerry Greg Gwen Hettie Howie Bella Jon Josie Kate Kathy Ken Leo Len Lucy Maggie Peggy Meg Matt Mike Nat
Nate Nicky Ollie Pete Pippa Ray Becky Dick Rick Bob Rob Robbie Sam Steph Tabby Ted Theo Tim Ursie Vicky Vic Vince
Walt Wally Bill Will Billy Winnie Zach Zack""".split()
# Words that make a name before them that of a firm.
BUSINESS = """Adjusting Auto Casualty Community Construction Engineering Environmental Hardware Homeowners Insurance Logistics
Manufacturing Medical Mutual Property Realty Restoration Roofing Savings Title Transport Bank Hospital Center Group
Española Logistik Software""".split()
TOWNS = r"(?:[A-Z][a-z]+(?: [A-Z][a-z]+)?)"

S = r"(?:[ \t]+|[ \t]*\r?\n[ \t]*)"  # white space, at most one line break: wrapped lines break spans anywhere
_EMAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}(?<![.-])|[\w.+-]+\s*(?:\[at\]|\(at\)|\s+at\s+)\s*[\w-]+(?:(?:\s*(?:\[dot\]|\(dot\)|\s+dot\s+)\s*|\.)[\w-]+)*\s*(?:\[dot\]|\(dot\)|\s+dot\s+|\.)\s*(?:com|net|org|test|example|invalid)\b")
_PHONE = re.compile(
    r"(?<![\w-])(?:\+49\s+\(0\)\d{2}\s+\d{5}-\d{3}|\+44\s+20\s+\d{4}\s+\d{4}|01(?:\s+\d\d){4}|\+1\d{10}"
    r"|(?:\+?1[\s-]+)?(?:\(\d{3}\)\s*|\d{3}(?:\s*[-./]\s*|\s+))\d{3}(?:\s*[-.]\s*|\s+)\d{4}|(?<=at\s)\d{10}|(?<=is\s)\d{10}|(?<=Call\s)\d{10}|(?<=Phone\s)\d{10}|(?<=Direct\s)\d{10}|(?<=Tel\.\s)\d{10}|(?<=,\s)\d{10})"
    r"(?:\s*(?:ext\.?|x)\s*\d+)?(?![\w-])"
)
_ID = re.compile(
    r"(?:SSN:?|Social\s+Security\s+No\.|social\s+security\s+number|soc\.\s+sec\.\s+\#|DL\s+\#|licen[sc]e(?:\s+no\.)?|[Pp]assport(?:\s+no\.|\s+number:?)?|national\s+identity\s+number)\s+"
    r"(\d{3}[- ]\d{2}[- ]\d{4}|\d{9}|[A-Z]\d{3}-\d{3}-\d{4}|[A-Z]\d{8}|\d\d\s\d{6}\s[A-Z]\s\d{3})(?![\w])"
)
_STREET = r"(?:Street|St\.|Road|Rd\.|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.|Court|Ct\.|Place|Pl\.|Way|Boulevard|Blvd\.|Terrace)"
_ADDRESS = re.compile(
    rf"\b\d{{1,4}}{S}(?:[A-Z][\w'’-]+{S}){{1,3}}{_STREET}(?:,{S}(?:(?:Suite|Apt|Unit){S}|\#\s*)\d+[A-Z]?)?(?:,{S}{TOWNS}(?:,{S}[A-Z]{{2}}{S}\d{{5}})?)?(?!\w)"
    rf"|\b\d{{1,4}}{S}rue{S}(?:du|des|de la|de)?\s*[A-ZÉ][\w-]+(?:{S}[A-ZÉ][\w-]+)?,{S}\d{{5}}{S}{TOWNS}(?!\w)"
    rf"|\b(?:(?:Am|An der|Im){S}[A-Z]\w+|[A-Z]\w+(?:allee|kamp|gasse|weg|stra(?:ß|ss)e)|Obere{S}\w+){S}\d{{1,4}},{S}\d{{5}}{S}{TOWNS}(?!\w)"
)
_ADDRESS_LINE = re.compile(r"^[> ]*((?:\d{1,4} .*|(?:Am|Obere|Linden|Raben).*)\d{5}.*|\d{1,4} (?:[A-Z][\w'’-]+ ){1,3}" + _STREET + r".*)$", re.M)
_G = r"(?:" + "|".join(sorted(GIVEN, key=len, reverse=True)) + r")"
_SUR = r"[A-Z][a-z]{3,}(?:-\s?[A-Z][a-z]{3,})?|[A-Z]{4,}(?:-[A-Z]{4,})?"
_INI = r"(?:[A-Z]\.\s*)"
_NAME = re.compile(
    rf"(?P<full>\b{_G}{S}(?:{_INI}+)?(?:{_SUR})\b)"
    rf"|(?P<ini>\b{_INI}{{1,3}}(?:{_SUR})\b(?!\s*&))"
    rf"|(?P<rev>\b(?:{_SUR}),{S}{_G}\b(?:{S}[A-Z]\.)?)"
    rf"|(?P<titled>(?<=Mr\.\s)(?:{_SUR})|(?<=Mrs\.\s)(?:{_SUR})|(?<=Ms\.\s)(?:{_SUR})|(?<=Dr\.\s)(?:{_SUR})|(?<=Herr\s)(?:{_SUR})|(?<=Frau\s)(?:{_SUR})|(?<=M\.\s)(?:{_SUR})|(?<=Mme\s)(?:{_SUR})|(?<=Me\s)(?:{_SUR})|(?<=Sr\.\s)(?:{_SUR})|(?<=Sra\.\s)(?:{_SUR})|(?<=Ing\.\s)(?:{_SUR})|(?<=\sD\.\s)(?:{_SUR})|(?<=MM\.\s)(?:{_SUR}))"
    rf"|(?P<given>(?<=Hi ){_G}|(?<=Hello ){_G}|(?<=Dear ){_G}|(?<=morning ){_G}|(?<=Hallo ){_G}|(?<=Liebe ){_G}|(?<=Lieber ){_G}|(?<=Bonjour ){_G}|(?<=Hola ){_G}|(?<=Estimado ){_G}|(?<=Estimada ){_G})(?=[,:\n])"
    rf"|(?P<alone>(?:^|(?<=\n))(?:> ?)*{_G},?(?=[ \t]*(?:\n|$)))",
)
_AFTER_FIRM = re.compile(rf"\s+(?:{'|'.join(BUSINESS)})\b|\s*&")


def sure_surnames(texts: list[str]) -> set[str]:
    """Surnames that stand after a given name or a title somewhere."""
    got: set[str] = set()
    for t in texts:
        for m in _NAME.finditer(t):
            if m.lastgroup in ("full", "titled") and not _AFTER_FIRM.match(t, m.end()):
                got.update(re.split(r"-\s?", re.split(r"\s", m[0])[-1].lower()))
    return {x for x in got if x.capitalize() not in GIVEN}


def weak_spans(text: str, surnames: set[str]) -> list[tuple[int, int, str]]:
    """Spans that patterns are sure of, by priority; none overlap."""
    got: list[tuple[int, int, str]] = []
    taken = np.zeros(len(text) + 1, bool)

    def add(a: int, b: int, kind: str) -> None:
        if a < b and not taken[a:b].any():
            taken[a:b] = True
            got.append((a, b, kind))

    for m in _EMAIL.finditer(text):
        add(m.start(), m.end(), "email")
    for m in _ID.finditer(text):
        add(m.start(1), m.end(1), "id_number")
    for m in _ADDRESS.finditer(text):
        add(m.start(), m.end(), "address")
    for m in _PHONE.finditer(text):
        add(m.start(), m.end(), "phone")
    for m in re.finditer(r"(?m)^[> ]*(\d{10})$", text):
        add(m.start(1), m.end(1), "phone")
    for m in re.finditer(rf"(?:MM\.)\s({_SUR})\s(?:et|y|und)\s({_SUR})", text):
        add(m.start(1), m.end(1), "name")
        add(m.start(2), m.end(2), "name")
    at = 0
    while m := _NAME.search(text, at):
        a, b = m.span()
        at = max(b, a + 1)
        last = re.split(r"-\s?", (m[0].split(",")[0] if m.lastgroup == "rev" else re.split(r"\s|\.", m[0])[-1]).lower())
        if m.lastgroup in ("ini", "rev", "full") and not set(last) & surnames:
            if m.lastgroup == "rev":  # a closing word before a name, not a surname: the name may stand by itself
                at = a + m[0].index(",") + 1
            continue
        if m.lastgroup == "alone":
            s = m[0].lstrip("> ").rstrip(",")
            a += m[0].index(s)
            b = a + len(s)
        elif m.lastgroup != "rev" and _AFTER_FIRM.match(text, b):
            continue
        elif m.lastgroup == "rev" and _AFTER_FIRM.match(text[: m.start() + re.match(_SUR, m[0]).end()], 0):
            continue
        add(a, b, "name")
    return sorted(got)


# How scanning misreads characters, used to vary clean texts.
MISREAD = {"l": "1I", "i": "1l", "o": "0", "O": "0", "s": "5", "S": "5", "e": "c", "a": "@", "t": "f", "m": ["rn"], "d": ["cl"], "u": ["ii"], "w": ["vv"], "I": "l1", "B": "8"}
STRAY = ["~", "|", "·", "^", "`", "¦", "_~", "~.", "^¦~|~", "·~·", "«"]


def vary(text: str, spans: list[tuple[int, int, str]], r: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with scanning noise, other case of names and wrapped lines; its spans move along."""
    noise = r.random() < 0.35
    rate, stray = (r.uniform(0.002, 0.03), r.uniform(0, 0.06)) if noise else (0, 0)
    wrap = r.random() < 0.25
    lower, upper = r.random() < 0.06, r.random() < 0.10
    out: list[str] = []
    n = 0
    begin = {a: k for k, (a, b, _) in enumerate(spans)}
    last = {b - 1: k for k, (a, b, _) in enumerate(spans)}
    inside = np.full(len(text) + 1, -1)
    for k, (a, b, kind) in enumerate(spans):
        inside[a:b] = k
    new: list[list[int]] = [[0, 0] for _ in spans]
    draws = r.random(len(text)) if noise or wrap else None
    picks = r.integers(0, 1 << 30, len(text)) if noise or wrap else None
    cased: dict[int, int] = {}
    for i, c in enumerate(text):
        k = begin.get(i)
        if k is not None:
            new[k][0] = n
            if spans[k][2] == "name" and (lower or upper) and r.random() < 0.3:
                cased[k] = 1 if lower else 2
        k = int(inside[i])
        s = c
        if k >= 0 and k in cased:
            s = c.lower() if cased[k] == 1 else c.upper()
        if noise and draws[i] < rate and c in MISREAD:
            s = MISREAD[c][picks[i] % len(MISREAD[c])]
        elif noise and c == " " and draws[i] < stray:
            s = " " + STRAY[picks[i] % len(STRAY)] + " "
        elif wrap and c == " " and draws[i] < 0.1:
            s = "\n"
        elif wrap and c.islower() and draws[i] < 0.006 and text[i - 1 : i].islower() and text[i + 1 : i + 2].islower():
            s = c + "-\n"
        out.append(s)
        n += len(s)
        k = last.get(i)
        if k is not None:
            new[k][1] = n
    return "".join(out), [(a, b, kind) for (a, b), (_, _, kind) in zip(new, spans)]


def tags_of(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(n, np.uint8)
    for a, b, kind in spans:
        k = M.KINDS.index(kind)
        y[a:b] = 1 + M.N + k
        y[a] = 1 + k
    return y


def _batches(rows: list[tuple[str, list[tuple[int, int, str]]]], seed: int):
    """Endless batches of windows over varied texts, at random offsets."""
    r = np.random.default_rng(seed)
    pool: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        while len(pool) < BATCH:
            for k in r.integers(0, len(rows), 160):
                s, sp = vary(*rows[k], r)
                x, y = M.encode(s), tags_of(len(s), sp)
                off = int(r.integers(0, TRAIN_WINDOW))
                for a in range(-off, len(x), TRAIN_WINDOW):
                    b = a + TRAIN_WINDOW
                    xs, ys = x[max(a, 0) : b], y[max(a, 0) : b]
                    if len(xs) < 12:
                        continue
                    X = np.zeros(TRAIN_WINDOW, np.uint8)
                    Y = np.zeros(TRAIN_WINDOW, np.uint8)
                    X[: len(xs)], Y[: len(ys)] = xs, ys
                    if ys.any() or r.random() < 0.5:
                        pool.append((X, Y))
            r.shuffle(pool)
        batch, pool = pool[:BATCH], pool[BATCH:]
        yield np.stack([b[0] for b in batch]), np.stack([b[1] for b in batch])


def _worker(pipe, rows: list, seed: int) -> None:
    """Gradients of one batch for each set of weights that comes through the pipe, until None comes."""
    feed = _batches(rows, seed)
    while (p := pipe.recv()) is not None:
        pipe.send(M.loss_and_grads(p, *next(feed)))


def main(data: str, out: str, minutes: float, start: str | None = None, workers: int = 3) -> None:
    import multiprocessing as mp

    import pyarrow.parquet as pq

    r = np.random.default_rng(11)
    t = pq.read_table(f"{data}/extraction_results.parquet", columns=["text", "method"]).to_pylist()
    clean = [x["text"] for x in t if x["text"] and "tesseract" not in (x["method"] or "")]
    obs = pq.read_table(f"{data}/observations.parquet", columns=["text"]).to_pylist()
    texts = clean[:SAMPLE_TEXTS] + sorted({x["text"] for x in obs if x["text"]})[: SAMPLE_TEXTS // 2]
    r.shuffle(texts)
    held = texts[:250]
    texts = texts[250:]
    surnames = sure_surnames(texts)
    print(len(surnames), "surnames", flush=True)
    rows = [(s, weak_spans(s, surnames)) for s in texts]
    p = M.load(start) if start else M.init(HIDDEN)
    pipes = []
    for k in range(workers):
        mine, theirs = mp.Pipe()
        mp.Process(target=_worker, args=(theirs, rows, 100 + k), daemon=True).start()
        pipes.append(mine)
    opt, began, step = M.Adam(p), time.time(), 0
    total = minutes * 60
    while (spent := time.time() - began) < total:
        for c in pipes:
            c.send(p)
        got = [c.recv() for c in pipes]
        lr = (0.003 if start else 0.006) * min(1, (step + 1) / 50) * (0.5 * (1 + np.cos(np.pi * min(1, spent / total))) * 0.97 + 0.03)
        opt.step(p, {k: sum(g[k] for _, g in got) / workers for k in p}, lr)
        step += 1
        if step % 100 == 0:
            print(step, f"{spent:.0f}s loss {sum(x for x, _ in got) / workers:.4f}", flush=True)
        if step % 500 == 0:
            M.save(p, out)
            evaluate(p, held, surnames)
    for c in pipes:
        c.send(None)
    M.save(p, out)
    evaluate(p, held, surnames)


def evaluate(p: dict, held: list[str], surnames: set[str]) -> None:
    """Precision and recall against the patterns' spans on held-out texts."""
    got = M.decode(p, held)
    hit = n = m = 0
    for s, found in zip(held, got):
        want, have = set(weak_spans(s, surnames)), set(found)
        hit, n, m = hit + len(want & have), n + len(want), m + len(have)
    print(f"held out: precision {hit / max(1, m):.4f} recall {hit / max(1, n):.4f} of {n}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], float(sys.argv[3]) if len(sys.argv) > 3 else 20, *sys.argv[4:5])
