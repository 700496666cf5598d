"""Sentence boundaries by semi-Markov dynamic programming.

Blank lines, list items, headings and transcript lines split a text into blocks.
In a block, every place that could end a sentence is a candidate.  A sentence is a
span between two candidates, scored as a whole:

* its closing words: how often they end paragraphs, of all the times that they stand
  before a possible start;
* its opening words: how often they open paragraphs, of all the times that they
  follow a possible end;
* whether quotations and brackets are balanced in it;
* its length.

The best sequence of spans is found by dynamic programming.  Abbreviations, ordinals
and scripts without periods need no lists: the statistics of paragraph ends and
starts are counted over all texts, in hashed tables of a fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..io import spread

SLOTS = 1 << 18
#: A paragraph of the corpus has about so many sentences: a word that always opens sentences opens a paragraph in this share.
SHARE = 0.25
#: Characters that a sentence may have before its length counts against it, and what each more costs.
USUAL, LONGER = 400, 0.002
BOUNDARY, STRONG, LOWER = 1.5, 2.0, -6.0

OPEN, CLOSE = "“«„「『‹([（【《", "”»」』›)]）】》"
_MARKS = re.compile("[\"" + re.escape(OPEN + CLOSE) + "]")
_CLOSERS = "”»」』›)\\]）】》\"'’“"
_CJK = "぀-ヿ㐀-鿿豈-﫿"
_CANDIDATE = re.compile(
    rf"(?P<space>(?:[.!?؟।॥…。！？;;][{_CLOSERS}]*(?:[   ]?[»][,.]?)?(?=\s))"  # a mark, then white space
    rf"|(?:[.!?…][   ]?»(?=\s)))"
    rf"|(?P<glued>(?<=[a-zà-ÿ0-9)][a-zà-ÿ0-9)])[.!?][”\"]?(?=[“\"]?[A-ZÀ-Þ][a-zà-ÿ]+ ))"  # a forgotten space
    rf"|(?P<none>[。！？…!?]+[{_CLOSERS[:-1]}]*(?=[{_CJK}「『“《]))"  # scripts that put none behind it
    rf"|(?P<thai>(?<=[\u0e00-\u0e7f0-9%)])(?=[ ]+[\u0e00-\u0e7f]))"  # scripts without marks
)
_BLANK = re.compile(r"\r?\n[^\S\n]*(?:\r?\n[^\S\n]*)+|[  ]|\f+")
_ITEM = re.compile(r"^[^\S\n]*(?:[-•*·–‣▪◦]|\(?\d{1,3}[.)]|\(?[a-z][.)]|\(?[ivx]{1,4}[.)])\s+\S")
_QA = re.compile(r"^[^\S\n]*(?:Q|A)[.:]\s")
_HEAD = re.compile(r"^[^\S\n]*(?:[IVX]{1,5}\.\s|Section\s\d|ARTICLE\s|§\s?\d|[一二三四五六七八九十]+、|第\d+)")


def _slot(kind: str, word: str) -> int:
    return zlib.crc32((kind + re.sub(r"\d", "0", word)).encode()) % SLOTS


def _open_word(text: str, p: int, end: int) -> str:
    """The opening word at p: a token; of scripts without spaces some characters."""
    while p < end and text[p] in "\"'“«„「『([（¿¡‚‘’":
        p += 1
    c = text[p : p + 1]
    if "฀" <= c <= "๿":
        return text[p : min(p + 6, end)].split()[0]
    if c and (0x3040 <= ord(c) <= 0x30FF or 0x3400 <= ord(c) <= 0x9FFF or 0xF900 <= ord(c) <= 0xFAFF):
        return text[p : min(p + 2, end)]
    m = re.compile(r"[^\s,;:!?\"”»)]{1,24}").match(text, p, end)
    return m[0] if m else c


def _close_word(text: str, start: int, p: int) -> str:
    """The closing word before p, with its mark and without closing quotes."""
    while p > start and text[p - 1] in _CLOSERS.replace("\\", "") + " \u00a0\u202f":
        p -= 1
    q = p
    while q > start and p - q < 24 and not text[q - 1].isspace() and text[q - 1] not in "(\"“«„「":
        q -= 1
    return text[q:p]


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of the blocks of a text; whole: the block is one unit."""
    paras, at = [], 0
    for m in _BLANK.finditer(text):
        paras.append((at, m.start()))
        at = m.end()
    paras.append((at, len(text)))
    transcript = len(re.findall(r"(?m)^[^\S\n]*Q[.:]\s", text)) >= 1 and len(re.findall(r"(?m)^[^\S\n]*A[.:]\s", text)) >= 1
    out: list[tuple[int, int, bool]] = []
    for a, b in paras:
        if not text[a:b].strip():
            continue
        lines = [(a + m.start(), a + m.end()) for m in re.finditer(r"[^\n]+", text[a:b])]
        items = [bool(_ITEM.match(text[s:e])) for s, e in lines]
        if transcript and any(_QA.match(text[s:e]) for s, e in lines):
            groups: list[list[int]] = []
            whole = []
            for s, e in lines:
                qa = bool(_QA.match(text[s:e]))
                if qa or not groups:
                    groups.append([s, e])
                    whole.append(qa)
                else:
                    groups[-1][1] = e
            out += [(s, e, w) for (s, e), w in zip(groups, whole)]
            continue
        lead = next((k for k, (s, e) in enumerate(lines) if items[k]), None)
        if lead is not None and sum(items) >= 1 and len(lines) > 1 and (sum(items) >= 2 or text[lines[lead - 1][0] : lines[lead - 1][1]].rstrip().endswith((":", "：")) and lead > 0):
            if lead:
                out.append((lines[0][0], lines[lead - 1][1], False))
            cur = None
            for k in range(lead, len(lines)):
                if items[k] or cur is None:
                    cur = [lines[k][0], lines[k][1]]
                    out.append((cur[0], cur[1], True))
                else:
                    out[-1] = (out[-1][0], lines[k][1], True)
            continue
        if len(lines) == 1 and items[0] and re.match(r"^[^\S\n]*(?:[-•*·–‣▪◦]|\(\d{1,3}\)|\(?[a-z]\))\s", text[a:b]):
            out.append((a, b, True))
            continue
        s, e = lines[0]
        first = text[s:e].strip()
        if len(lines) > 1 and len(first) <= 60 and first[-1:] not in ".!?,;:。" and (first.isupper() and len(first) > 4 or _HEAD.match(first)) and not text[lines[1][0] : lines[1][1]].lstrip()[:1].islower():
            out.append((s, e, True))
            a = lines[1][0]
        out.append((a, b, False))
    return out


def candidates(text: str, a: int, b: int) -> list[tuple[int, str]]:
    """(position, kind) of the places inside a block that could end a sentence."""
    out = []
    lead = re.compile(r"\s*(?:\(?\d{1,3}[.)]|[IVX]{1,5}\.|[A-Z]\.(?=\s[A-Z][a-z]+$))(?=\s)").match(text, a, b)
    for m in _CANDIDATE.finditer(text, a, b):
        p = m.end()
        if lead and p <= lead.end() or not text[p:b].strip():
            continue
        mark = text[m.start()] if m.lastgroup != "thai" else ""
        if mark in (";", "\u037e"):
            if not ("Ͱ" <= text[m.start() - 1 : m.start()] <= "Ͽ" or "ἀ" <= text[m.start() - 1 : m.start()] <= "῿"):
                continue
        kind = "thai" if m.lastgroup == "thai" else "dot" if mark in "." and text[m.start() - 1 : m.start()] != "." else "dots" if mark in ".…" else "strong"
        if m.lastgroup == "none" and kind != "dots" and m.end() - m.start() == 1:
            kind = "strong"
        elif m.lastgroup == "none":
            kind = "cjkclose" if kind != "dots" else "dots"
        elif kind == "strong" and m.end() - m.start() > 1 and re.search(rf"[{_CLOSERS}»]", text[m.start() + 1 : p]):
            kind = "close"
        out.append((p, kind))
    return out


def quoted(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """(opening, closing) places of the outermost quotations and brackets that open and close in a block, in order.

    What opens and never closes, as in a quotation that runs on in the next paragraph,
    holds nothing.
    """
    german = "„" in text[a:b]
    stack: list[int] = []
    straight = -1
    pairs: list[tuple[int, int]] = []
    for m in _MARKS.finditer(text, a, b):
        c, p = m[0], m.start()
        if c == '"':
            if straight >= 0:
                pairs.append((straight, p))
                straight = -1
            else:
                straight = p
        elif c in CLOSE or c == "“" and german:
            if stack:
                pairs.append((stack.pop(), p))
        else:
            stack.append(p)
    out: list[tuple[int, int]] = []
    for s, e in sorted(pairs):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


class Scores:
    """Log scores of closing and opening words from counts of all texts."""

    def __init__(self, edge: np.ndarray, total: np.ndarray):
        self.s = np.clip(np.log((edge + 0.3) / (SHARE * total + 0.3)), -4.0, 0.7).astype(np.float32)

    def close(self, w: str) -> float:
        return float(self.s[_slot("c", w)])

    def open(self, w: str) -> float:
        return float(self.s[_slot("o", w)])


def observe(texts: Iterator[str], edge: np.ndarray, total: np.ndarray) -> None:
    """Count, for the words at paragraph edges and at candidates."""
    for text in texts:
        for a, b, whole in blocks(text):
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if whole or b - a < 25:
                continue
            for k, w in (("o", _open_word(text, a, b)), ("c", _close_word(text, a, b))):
                edge[_slot(k, w)] += 1
                total[_slot(k, w)] += 1
            for p, kind in candidates(text, a, b):
                q = p
                while q < b and text[q].isspace():
                    q += 1
                w = _open_word(text, q, b)
                total[_slot("o", w)] += 1
                if not (w[:1].islower() or w[:1].isdigit()):
                    total[_slot("c", _close_word(text, a, p))] += 1


def split_block(text: str, a: int, b: int, s: Scores) -> list[int]:
    """Ends of the sentences of a block, the last one the block's end."""
    while b > a and text[b - 1].isspace():
        b -= 1
    cand = candidates(text, a, b)
    if not cand:
        return [b]
    # A span that ends inside a quotation that goes on is unbalanced, and so is the one behind it: neither is considered.
    inside, free, k = quoted(text, a, b), [], 0
    for c in cand:
        while k < len(inside) and inside[k][1] < c[0]:
            k += 1
        if k == len(inside) or c[0] <= inside[k][0]:
            free.append(c)
    points = [a] + [p for p, _ in free] + [b]
    kinds = ["start"] + [k for _, k in free] + ["end"]
    n = len(points)
    edge = [0.0] * n  # what a boundary at the point is worth
    for k in range(1, n - 1):
        p, kind = points[k], kinds[k]
        q = p
        while q < b and text[q].isspace():
            q += 1
        w = _open_word(text, q, b)
        o = s.open(w)
        x = BOUNDARY + o
        if kind == "thai":
            x += -1.0 if w[:1].isdigit() else 0.0
        elif kind in ("dot", "dots"):
            cw = _close_word(text, a, p)
            if kind == "dot":
                x += s.close(cw)
                if re.fullmatch(r"[A-ZÀ-Þ]\.", cw):
                    x -= 2.0
            else:
                x -= 0.5
        elif kind == "cjkclose":
            x += 0.3 + min(0.0, o) * 0.5
        elif kind == "close":
            x += 0.5
        else:
            x += STRONG
        if w[:1].islower():
            x += LOWER
        elif kind in ("dot", "dots") and (w[:1].isdigit() or text[q : q + 1] in "(§$€%"):
            x -= 1.0 if w[:1].isdigit() else 0.5
        if kind in ("dot", "dots", "strong", "close") and text[q : q + 1] in ",;:—–" or text[q : q + 1] == "-" and text[q + 1 : q + 2] == " ":
            x += LOWER
        edge[k] = x
    best = [-1e18] * n
    back = [0] * n
    best[0] = 0.0
    far, at, p = -1e18, 0, 0  # of the starts that a span longer than USUAL has, the best one: its length costs in proportion
    for j in range(1, n):
        while points[j] - points[p] > USUAL:
            if best[p] + LONGER * points[p] > far:
                far, at = best[p] + LONGER * points[p], p
            p += 1
        v, back[j] = far - LONGER * (points[j] - USUAL), at
        for i in range(p, j):
            w = best[i] - (2.0 if points[j] - points[i] < 4 else 0.0)
            if w > v:
                v, back[j] = w, i
        best[j] = v + edge[j]
    ends, j = [], n - 1
    while j:
        ends.append(points[j])
        j = back[j]
    return ends[::-1]


def sentence_ends(text: str | None, s: Scores) -> list[int]:
    """Character offsets at which the sentences end; none for null, empty and blank texts."""
    if not text or not text.strip():
        return []
    out = []
    for a, b, whole in blocks(text):
        while a < b and text[a].isspace():
            a += 1
        e = b
        while e > a and text[e - 1].isspace():
            e -= 1
        if a < e:
            out += [e] if whole else split_block(text, a, e, s)
    return out


def train(texts: DataFrame, text: str = "text") -> Scores:
    """Scores from all texts; at most 2 * SLOTS rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge, total = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        for b in batches:
            observe((t for t in b.column(0).to_pylist() if t), edge, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(edge[at]), pa.array(total[at])], names=["slot", "edge", "total"])

    got = spread(texts.select(text)).mapInArrow(run, "slot int, edge bigint, total bigint").groupBy("slot").agg(F.sum("edge").alias("edge"), F.sum("total").alias("total")).toArrow()
    edge, total = np.zeros(SLOTS), np.zeros(SLOTS)
    slot = got.column("slot").to_numpy()
    edge[slot], total[slot] = got.column("edge").to_numpy(), got.column("total").to_numpy()
    return Scores(edge, total)


def split_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, seq, sent_start, sent_end: every sentence of every text, in order; texts without words have none."""
    scores = train(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(scores.s)  # 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scores.__new__(Scores)
        s.s = shared.value
        for b in batches:
            keys, seq, starts, ends = [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = 0
                for n, e in enumerate(sentence_ends(t, s)):
                    while at < e and t[at].isspace():
                        at += 1
                    keys.append(k), seq.append(n), starts.append(at), ends.append(e)
                    at = e
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(seq, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[key, "seq", "sent_start", "sent_end"])

    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, seq int, sent_start bigint, sent_end bigint")
