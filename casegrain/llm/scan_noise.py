"""Repair of text read from scanned pages by averaged-perceptron editors.

Three perceptrons predict operations, each scored against keeping what stands there:

* the character editor: replace (one or two characters by what they were misread
  from), delete (stray marks) and insert (what a ligature swallowed);
* the line-join editor: join two lines and delete the hyphen between them, or keep it
  as a compound's own;
* the furniture editor: remove a line of the page frame, by its place on the page, its
  shape and its likeness to lines in the same place of other pages.

They are trained on texts of the corpus that show no noise, with noise added; the
sample is bounded by SAMPLE_TEXTS, SAMPLE_CHARS and SAMPLE_WORDS.  Their features use
exact counts of every word of all distinct texts of the corpus.  As long as it has at
most WORDS words, their counts are held in memory.  Beyond that only those of the most
frequent are, and the others are looked up by joins: words that edits can make of each
other share a key (edit_key), so each word is repaired once, beside all the words that it
could be, and the texts get the repairs of their words and the counts that they ask for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..io import spread, staged
from .email_bodies import is_email

#: The most frequent words whose counts are held in memory: what comes to the driver is bounded.
WORDS = 400_000
#: Characters of the texts that get the repairs of their words together where not all counts are in memory.
BLOCK_CHARS = 2_000_000
#: Texts that train the editors, the longest of them, and the words and compounds drawn from them.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_WORDS, SAMPLE_JOINS = 500, 20_000, 16_000, 8_000
#: Pages before and after a page whose outer lines are all compared with its own; those of other pages are if they repeat.
NEAR_PAGES = 6

# What scanning makes of characters (seen, meant).
CONFUSIONS = [
    ("1", "l"), ("1", "i"), ("1", "I"), ("0", "o"), ("0", "O"), ("5", "s"), ("5", "S"), ("c", "e"), ("f", "t"), ("@", "a"), ("rn", "m"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("l", "I"), ("I", "l"), ("l", "i"), ("l", "1"),
    ("8", "B"), ("6", "b"), ("9", "g"), ("h", "b"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("|", "l"), ("!", "l"), ("e", "c"), ("t", "f"), ("VV", "W"), ("O", "0"), ("S", "5"), ("€", "e"), ("q", "g"), ("tn", "m"), ("nn", "rm"), ("li", "h"), ("m", "rn"), ("d", "cl"), ("n", "ri"), ("€", "C"), ("¢", "c"), ("$", "S"), ("3", "B"),
]
_INVERSE: dict[str, list[str]] = {}
for _a, _b in CONFUSIONS:
    _INVERSE.setdefault(_a, []).append(_b)
#: Characters to what they share with all that they are misread as or from: both sides of each confusion come to the same.
_SHARED = str.maketrans({
    **dict.fromkeys("lirtf1|!ı", "l"), **dict.fromkeys("nhub863", "ll"), "m": "lll", "d": "cl", **dict.fromkeys("ce€¢", "c"), "w": "vv", "0": "o", **dict.fromkeys("5$", "s"), "@": "a", **dict.fromkeys("q9", "g"),
})
# Marks that dirt on a page leaves.
STRAY = ["~", "|", "·", "^", "`", "¦", "_~", "~.", "^¦~|~", "·~·", "«", "~~|^", "*", "°", "»", "¬", "'", "_", "\\", "¨", "´", "•"]
_STRAY = re.compile(r"(?<=\s)[~|·^`¦_«»*°¬\\¨´•'.,]{1,6}(?=\s|$)|(?<=^)[~|·^`¦_«°¬\\¨´]{1,6}(?=\s)", re.M)
_PAGE = re.compile(r"^[^\S\n]*<<<PAGE (\d+)>>>[^\S\n]*$", re.M)
_EDGE = "\"'“”‘’«»„()[]{}<>.,;:!?…*_~|`^¦·"
_HYPHEN = re.compile(r"(\S*?[^\W\d_]+)([-‐‑¬­–])[^\S\n]*\n\s*", re.U)


def edit_key(w: str) -> str:
    """What a word has in common with all that any number of edits, and another case, make of it."""
    return w.casefold().translate(_SHARED)


def words_of(text: str) -> Iterator[str]:
    for t in text.split():
        w = t.strip(_EDGE)
        if w and "@" not in w[1:-1].replace("@", "", 0) or w:
            yield w


_NONE = (0, 0)


class Unsettled(Exception):
    """A text needs counts that are not in memory."""


class Perceptron:
    """Averaged perceptron over sparse string features."""

    def __init__(self, w: dict[str, float] | None = None):
        self.w = w or {}
        self._sum: dict[str, float] = {}
        self._at: dict[str, int] = {}
        self.t = 0

    def score(self, features: list[str]) -> float:
        g = self.w.get
        return sum(g(f, 0.0) for f in features)

    def update(self, features: list[str], by: float) -> None:
        for f in features:
            old = self.w.get(f, 0.0)
            self._sum[f] = self._sum.get(f, 0.0) + (self.t - self._at.get(f, 0)) * old
            self._at[f] = self.t
            self.w[f] = old + by

    def average(self) -> None:
        self.w = {f: (self._sum.get(f, 0.0) + (self.t - self._at.get(f, 0)) * v) / max(1, self.t) for f, v in self.w.items()}


def _bucket(x: float) -> str:
    return str(int(np.clip(np.floor(np.log2(x + 1e-9)) if x > 0 else -1, -12, 12)))


class Editor:
    """The three perceptrons with the word counts they look at."""

    def __init__(self, counts: dict[str, tuple[int, int]], share: float, whole: bool = True):
        self.n = counts  # of all texts, and of those that show no noise
        self.share = share  # of the words that stand in the latter
        self.whole = whole  # no other word occurs
        self.looked_up: dict[str, int] = {}
        self.asked: set[str] = set()  # words whose counts are neither here nor there
        self.chars, self.joins, self.lines = Perceptron(), Perceptron(), Perceptron()
        self._known: dict[str, tuple[str, float] | None] = {}

    def count(self, w: str) -> int:
        if self.whole or w in self.n:
            return self.n.get(w, _NONE)[0]
        if w not in self.looked_up:
            self.asked.add(w)
        return self.looked_up.get(w, 0)

    def settle(self) -> None:
        if self.asked:
            raise Unsettled

    def established(self, w: str) -> bool:
        """Whether a word stands in texts without noise about as often as words do: it is one, however rare."""
        n, calm = self.n.get(w, _NONE)
        return calm >= 2 and calm >= 0.4 * self.share * n

    def _count_any(self, w: str) -> int:
        """Count of a word as it stands or in its usual case."""
        return max(self.count(w), self.count(w.lower()), self.count(w.capitalize()))

    # -- the character editor ------------------------------------------------
    def edits(self, w: str) -> list[tuple[int, str, str]]:
        """(position, seen, meant) of every operation that fits the word."""
        out = []
        for i in range(len(w)):
            for size in (1, 2):
                for meant in _INVERSE.get(w[i : i + size], ()) if i + size <= len(w) else ():
                    out.append((i, w[i : i + size], meant))
        return out

    def features(self, w: str, edit: tuple[int, str, str] | None) -> list[str]:
        here = self.count(w)
        if edit is None:
            return ["keep", "keep n" + _bucket(here), "keep any" + _bucket(self._count_any(w)), f"keep mixed{bool(re.search('[A-Za-zÀ-ÿ].*[0-9@]|[0-9@].*[a-zÀ-ÿ]{2}', w))}", f"keep len{min(len(w), 12)}"]
        i, seen, meant = edit
        v = w[:i] + meant + w[i + len(seen) :]
        there = self.count(v)
        upper = (w[:i] + w[i + len(seen) :]).isupper()
        e = f"{seen}>{meant}"
        left, right = w[i - 1 : i], w[i + len(seen) : i + len(seen) + 1]
        kind = lambda c: "-" if not c else "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "."
        return [
            "edit " + e, "ratio" + _bucket((there + 0.2) / (here + 0.2)), "there" + _bucket(there), f"ratio{_bucket((there + 0.2) / (here + 0.2))} {_bucket(there)}", f"e{e} {kind(left)}{kind(right)}", f"lr {left}{meant}{right}", f"up{upper} {kind(meant[:1])}",
            f"digit{seen.isdigit()} {kind(left)}{kind(right)}", f"zero{there == 0} {e}",
        ]

    def best(self, w: str) -> tuple[tuple[int, str, str] | None, float]:
        keep = self.chars.score(self.features(w, None))
        got, top = None, 0.0
        for e in self.edits(w):
            s = self.chars.score(self.features(w, e)) - keep
            if s > top:
                got, top = e, s
        return got, top

    def fix(self, w: str) -> tuple[str, float] | None:
        """The repaired word and how sure the repair is, None if it stays."""
        if w in self._known:
            return self._known[w]
        out = None
        if re.search(r"@.*\.", w):
            pass
        elif "-" in w[1:-1]:  # a compound or a double name: each part by itself
            parts = [(x, self.fix(x)) for x in w.split("-")]
            if any(f for _, f in parts):
                out = "-".join(f[0] if f else x for x, f in parts), max(f[1] for _, f in parts if f)
        elif self.whole and self._editable(w) and not self.established(w):  # else all that changes is among the known
            v, sure = w, 0.0
            for _ in range(4):
                e, s = self.best(v)
                if e is None:
                    break
                v = v[: e[0]] + e[2] + v[e[0] + len(e[1]) :]
                sure = max(sure, s)
            # The exact check behind the editor: the repaired word is a word, and clearly more usual.
            out = (v, sure) if v != w and self._count_any(v) >= 2 and self._count_any(v) > 3 * self._count_any(w) else None
        if len(self._known) < 400_000:
            self._known[w] = out
        return out

    @staticmethod
    def _editable(w: str) -> bool:
        """Words with letters; addresses, numbers with a unit and codes are none."""
        if len(w) < 3 or len(w) > 40 or sum(c.isalpha() for c in w) < 2:
            return False
        if "@" in w and (re.search(r"@.*\.", w) or "+" in w or w.endswith("@")) or "/" in w or "\\" in w or "." in w[:-1] or w.startswith(("#", "$", "€")) or "_" in w or "+" in w or re.fullmatch(r"[a-z]{3,}\d{2,}", w):
            return False
        if re.fullmatch(r"[A-Z]{1,4}[-#]?\d[\d.,-]*[A-Z]?\d*|\d+[-A-Za-z]{1,3}|\d[\d,.-]*[A-Z]+\d+|[\d-]+[A-Z]\d+|\d+(?:st|nd|rd|th|er|e|d)|[A-Z]?\d+[A-Z]?", w):
            return False
        if re.search(r"\d{3,}", w) or re.search(r"\d-\d|-\d", w):
            return False
        return True

    # -- the line-join editor ------------------------------------------------
    def join_features(self, left: str, mark: str, right: str) -> list[str]:
        joined, compound = self._count_any(left + right), max(self._count_any(left + "-" + right), 0)
        first, second = self._count_any(left), self._count_any(right)
        case = "low" if right[:1].islower() else "up" if right[:1].isupper() else "other"
        if left.isupper() and right.isupper() and len(left) > 1:
            case = "caps"
        return [f"mark{mark}", f"case {case}", f"mark{mark} {case}", "joined" + _bucket(joined), "compound" + _bucket(compound), f"jc{_bucket((joined + 0.3) / (compound + 0.3))} {case}", f"parts{_bucket(first)} {_bucket(second)}" if not joined else "parts-", f"both{min(first, second) > 5} {joined > 0} {case}", f"len{min(len(left), 5)} {case}"]

    def joins_here(self, left: str, mark: str, right: str) -> bool:
        """Whether a hyphen at a line's end splits a word (else it is the word's own)."""
        if not left or not right or not right[:1].isalpha():
            return False
        if self.joins.score(self.join_features(left, mark, right)) <= 0:
            return False
        # The exact check: a compound that the corpus writes in one line, and no such word, keeps its hyphen.
        joined, compound = self._count_any(left + right), self._count_any(left + "-" + right)
        return not (compound > 0 and compound >= 3 * joined)

    # -- the furniture editor ------------------------------------------------
    def line_features(self, s: str, top: int, bottom: int, like: float, pages: int) -> list[str]:
        place = f"t{min(top, 3)}" if top <= bottom else f"b{min(bottom, 3)}"
        number = page_number_in(s)
        shape = "whole" if number == s.strip() else "part" if number else "none"
        body = bool(re.match(r"[QA][.:]\s|\d{1,3}[.)]\s", s)) or bool(re.search(r"[.?!:;,…”\"»]$", s) and not re.search(r"(?:Inc|Co|Ltd|Corp)\.$", s))
        sim = "0" if like < 0.7 else "1" if like < 0.82 else "2" if like < 0.999 else "3"
        return [f"place {place}", f"shape {shape}", f"{place} {shape}", f"like {sim}", f"{place} like {sim}", f"body {body}", f"like {sim} body {body}", f"pages {min(pages, 3)}", f"like {sim} p{min(pages, 3)}", f"len {min(len(s) // 15, 5)}", f"{shape} len {min(len(s) // 15, 5)}", f"low {s[:1].islower()} {sim}"]

    def is_furniture(self, features: list[str]) -> bool:
        return self.lines.score(features) > 0


_N = r"(?:[0-9lIOoSi|B]{1,4}|[ivxl]{1,5})"
_NUMBER_LINE = re.compile(rf"^\W{{0,3}}(?:(?:p[a@]g[ec]|pg|p|seite|s)\.?\s*{_N}(?:\s*(?:of|0f|oi|/|von)\s*{_N})?|\[\s*{_N}\s*\]|[-–—]\s*{_N}\s*[-–—]|{_N})\W{{0,3}}$", re.I)
_NUMBER_PART = re.compile(r"^(\d{1,4})\s{2,}\S.*[^\d\s]$|^\D*\S\s{2,}(\d{1,4})$")


def page_number_in(line: str) -> str:
    """The page number that a line is or holds apart from its text, '' if none."""
    s = re.sub(r"\s[~|·^`¦_«»*°.]{1,6}$|^[~|·^`¦_«»*°]{1,6}\s", "", line.strip()).strip()
    m = _NUMBER_LINE.match(s)
    if m and re.search(r"\d|[lIivxO]", s) and len(s) <= 16 and not re.fullmatch(r"[Oo]|I|\d{4}", s):
        return line.strip()
    m = _NUMBER_PART.match(s)
    return (m[1] or m[2]) if m else ""


def pages_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the text of each page, without the reader's markers; a text without markers is one page."""
    cuts = [(m.start(), m.end()) for m in _PAGE.finditer(text)]
    if not cuts:
        return [(0, len(text))]
    out = [(0, cuts[0][0])] if text[: cuts[0][0]].strip() else []
    for k, (_, e) in enumerate(cuts):
        out.append((e, cuts[k + 1][0] if k + 1 < len(cuts) else len(text)))
    return out


def _plain(s: str) -> str:
    """A line for comparison: without digits, marks and the characters that are misread."""
    s = re.sub(r"\s\W{1,6}(?=\s|$)", " ", s.lower())
    for a, b in (("rn", "m"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("1", "l"), ("i", "l"), ("0", "o"), ("5", "s"), ("@", "a"), ("c", "e"), ("f", "t"), ("|", "l")):
        s = s.replace(a, b)
    return re.sub(r"[\W\d_]+", " ", s).strip()


def frame(text: str, depth: int = 2) -> list[tuple[int, int, int, int, float, int]]:
    """(start, end, from top, from bottom, likeness, pages) of the outer lines of the pages, depth of them at each edge."""
    pages = pages_of(text)
    edges: list[list[tuple[int, int, int, int]]] = []
    for a, b in pages:
        lines = [(a + m.start(), a + m.end()) for m in re.finditer(r"[^\n]*\S[^\n]*", text[a:b])]
        n = len(lines)
        edges.append([(s, e, k, n - 1 - k) for k, (s, e) in enumerate(lines) if k < depth or k >= n - depth])
    # Equal lines of any pages meet by their plain text.  A misread one is compared with the outer lines of near
    # pages, where a header stands too, and with every line that stands on several pages, of which there are few.
    plain = [[_plain(text[s:e]) for s, e, _, _ in es] for es in edges]
    tops: dict[str, set[int]] = {}
    for p, xs in enumerate(plain):
        for x in xs:
            if len(x) >= 4:
                tops.setdefault(x, set()).add(p)
    repeated = [x for x, ps in tops.items() if len(ps) > 1]
    out = []
    for p, es in enumerate(edges):
        near = {y for q in range(max(0, p - NEAR_PAGES), min(len(edges), p + NEAR_PAGES + 1)) if q != p for y in plain[q] if len(y) >= 4}.union(repeated)
        for (s, e, t, b), x in zip(es, plain[p]):
            like = 0.0
            if len(x) >= 4 and len(pages) > 1:
                if len(tops[x]) > 1:
                    like = 1.0
                else:
                    like = max((SequenceMatcher(None, x, y, autojunk=False).ratio() for y in near if y != x and abs(len(x) - len(y)) <= 0.3 * max(len(x), len(y))), default=0.0)
            out.append((s, e, t, b, like, len(pages)))
    return out


def furniture(text: str, ed: Editor) -> list[tuple[int, int, str, float]]:
    """(start, end, page number in it, likeness) of the lines of the page frame.

    Two lines at each edge of a page are looked at, and further ones for as long as all
    of an edge's are of the frame.
    """
    depth = 2
    while True:
        rows = frame(text, depth)
        found = [(s, e, page_number_in(text[s:e]), like) for s, e, t, b, like, n in rows if ed.is_furniture(ed.line_features(text[s:e].strip(), t, b, like, n))]
        found = [x for x in found if x[2] or x[3] >= 0.7]
        gone = {x[0] for x in found}
        edges: dict[tuple[int, str], bool] = {}  # by page and edge: whether all its lines are of the frame
        page = -1
        for s, _, t, b, _, _ in rows:
            page += t == 0
            if t + b + 1 > depth:
                for edge, at in (("top", t), ("foot", b)):
                    if at < depth:
                        edges[page, edge] = edges.get((page, edge), True) and s in gone
        if not any(edges.values()):
            return found
        depth *= 2


def analyse(text: str | None, ed: Editor, least: float = 0.0) -> tuple[set[str], list[tuple[int, int, str]]]:
    """The defects of a text, and the edits (start, end, replacement) that repair it, in order and apart."""
    found: set[str] = set()
    edits: list[tuple[int, int, str]] = []
    if not text or is_email(text):
        return found, edits
    gone: list[tuple[int, int]] = []
    for s, e, number, like in furniture(text, ed):
        if number:
            found.add("page_number")
        if number != text[s:e].strip() and like >= 0.7:
            found.add("running_header")
        gone.append((s, e))
        edits.append((s, e, ""))
    inside = lambda p: any(s <= p < e for s, e in gone)
    split: list[tuple[int, int]] = []
    # Hyphens at line ends; what follows may stand behind a page break and its furniture.
    for m in _HYPHEN.finditer(text):
        if inside(m.start(1)):
            continue
        left, mark, p = re.sub(r"^\W+", "", m[1]), m[2], m.end()
        moved = True
        while moved:
            moved = False
            k = _PAGE.match(text, p)
            if k:
                p, moved = k.end(), True
            for s, e in gone:
                if s <= p < e or (s >= p and not text[p:s].strip()):
                    p, moved = e, True
            while p < len(text) and text[p].isspace():
                p += 1
        r = re.compile(r"[^\W\d_]+").match(text, p)
        whole = re.split(r"[-‐]", left)[-1]
        if r and (ed.joins_here(whole, mark, r[0]) or (mark in "¬‐­" and r[0][:1].islower() and ed._count_any(whole + "-" + r[0]) == 0)):
            found.add("hyphenation")
            split.append((m.start(1), r.end()))
            if p == m.end():
                edits.append((m.end(1), m.end(), ""))
    ed.settle()
    joined = lambda p: any(s <= p < e for s, e in split)
    french = text.count("«") and text.count("«") == text.count("»")
    score = 0.0
    strays = 0
    for m in _STRAY.finditer(text):
        if joined(m.start()) and len(m[0]) < 2 or inside(m.start()):
            if not inside(m.start()):
                continue
        if m[0] == "«" and 0 < text.find("»", m.end()) < (text.find("«", m.end()) % (len(text) + 1)) or m[0] == "»" and text.rfind("«", 0, m.start()) > text.rfind("»", 0, m.start()):
            continue  # a quotation mark with its partner
        f = stray_features(m[0], text, m.start(), m.end(), french)
        if ed.chars.score(f) > 0:
            strays += 1
            edits.append((m.start(), m.end() + (text[m.end() : m.end() + 1] == " "), ""))
    for m in re.finditer(r"\S+", text):
        if joined(m.start()):
            continue
        t = m[0]
        w = t.strip(_EDGE)
        if not w:
            continue
        got = ed.fix(w)
        if got and got[1] > least:
            if t.islower() and re.compile(r"\s+(?:\[at\]|\(at\)|at\s+[\w-]+\s*(?:dot\b|\.)|dot\s)").match(text, m.end()):
                continue  # an e-mail address in words
            at = m.start() + t.index(w)
            score += got[1]
            if not inside(at):
                edits.append((at, at + len(w), got[0]))
    if strays or score > 0:
        found.add("misread")
    return found, sorted(edits)


def stray_features(mark: str, text: str, s: int, e: int, french: bool) -> list[str]:
    """Features of the operation that deletes a mark standing by itself."""
    a, b = text[s - 2 : s - 1], text[e + 1 : e + 2]
    kind = lambda c: "-" if not c else "0" if c.isdigit() else "a" if c.isalpha() else "."
    line = text[text.rfind("\n", 0, s) + 1 : s]
    return ["stray", f"stray {mark}", f"stray set {''.join(sorted(set(mark)))}", f"stray first {not line.strip()} {mark[:1]}", f"stray french {bool(french)} {mark[:1]}", f"stray {kind(a)}{kind(b)} {mark[:1]}", f"stray dots {set(mark) <= set('.,')}", f"stray len {len(mark)}"]


def repair(text: str | None, ed: Editor) -> tuple[str | None, list[str]]:
    """The text in continuous paragraphs without its defects, and their names, sorted.

    Null stays null, empty stays empty, e-mails and texts without defects are only
    joined into paragraphs.  Page markers go.
    """
    if not text or is_email(text):
        return text, []
    found, edits = analyse(text, ed)
    out, at = [], 0
    for s, e, new in edits:
        if s >= at:
            out += [text[at:s], new]
            at = e
    body = "".join(out) + text[at:]
    body = _PAGE.sub("", body.replace("\r\n", "\n"))
    paras: list[str] = []
    for p in re.split(r"\n[^\S\n]*\n\s*", body):
        p = re.sub(r"\s+", " ", p).strip()
        if not p:
            continue
        # A paragraph that a page break cut goes on with a small letter.
        if paras and paras[-1][-1:] not in ".!?:;…”\"»)" and p[:1].islower():
            last = paras[-1]
            m = re.search(r"([^\W\d_]+)[-‐¬­]$", last)
            r = re.match(r"[^\W\d_]+", p)
            paras[-1] = last[:-1] + p if m and r and ed.joins_here(m[1], last[-1], r[0]) else f"{last} {p}"
        else:
            paras.append(p)
    ed.settle()
    return "\n\n".join(paras), sorted(found)


# -- training -----------------------------------------------------------------
def quiet(text: str) -> bool:
    """No sign of scanning: such texts train the editors."""
    return len(text) > 200 and not is_email(text) and not re.search(r"[~¦^`¬‐]|\w-\s*\n\s*[a-z]|[a-z][01@5][a-z]", text)


def _corrupt(w: str, r: np.random.Generator) -> tuple[str, list[tuple[int, str, str]]]:
    """A word misread in one place, and the edit that undoes it."""
    places = [(i, a, b) for a, b in CONFUSIONS[:17] for i in range(len(w)) if w.startswith(b, i)]
    if not places:
        return w, []
    i, a, b = places[int(r.integers(len(places)))]
    return w[:i] + a + w[i + len(b) :], [(i, a, b)]


def train(counts: dict[str, tuple[int, int]], share: float, clean: list[str], seed: int = 5, rounds: int = 2) -> Editor:
    """The editors, trained on noise added to clean texts."""
    ed = Editor(counts, share)
    r = np.random.default_rng(seed)
    _train_words(ed, clean, r, rounds)
    _train_lines(ed, clean, r)
    return ed


class _Asking(Editor):
    """Trains nothing, but asks for the counts that training asks for; which they are doesn't depend on the counts."""

    def __init__(self):
        super().__init__({}, 0.0, False)

    def features(self, w: str, edit: tuple[int, str, str] | None) -> list[str]:
        self._count_any(w) if edit is None else self.count(w[: edit[0]] + edit[2] + w[edit[0] + len(edit[1]) :])
        return []


def asked_in_training(clean: list[str], seed: int = 5, rounds: int = 2) -> set[str]:
    ed = _Asking()
    _train_words(ed, clean, np.random.default_rng(seed), rounds)
    return ed.asked


def _train_words(ed: Editor, clean: list[str], r: np.random.Generator, rounds: int) -> None:
    """The character editor and the line-join editor."""
    words = [w for t in clean for x in t.split() if (w := x.strip(_EDGE)) and ed._editable(w)]
    r.shuffle(words)
    words = words[:SAMPLE_WORDS]
    p = ed.chars
    for _ in range(rounds):
        for w in words:
            p.t += 1
            seen, undo = _corrupt(w, r) if r.random() < 0.4 else (w, [])
            if not undo:
                seen = w
            options: list[tuple[int, str, str] | None] = [None, *ed.edits(seen)]
            feats = [ed.features(seen, o) for o in options]
            scores = [p.score(f) + (0.0 if o is None else 1.0) for f, o in zip(feats, options)] if not undo else [p.score(f) for f in feats]
            k = int(np.argmax(scores))
            gold = 0
            if undo:
                if seen != w and ed.count(seen) > 0.3 * ed.count(w):
                    continue  # the misread word is a word as well
                gold = options.index(undo[0]) if undo[0] in options else 0
            if k != gold and (undo or scores[k] > scores[0]):
                p.update(feats[gold], 1.0)
                p.update(feats[k], -1.0)
    for t in clean[:SAMPLE_TEXTS]:
        french = t.count("«") and t.count("«") == t.count("»")
        for m in list(_STRAY.finditer(t))[:20]:
            p.t += 1
            f = stray_features(m[0], t, m.start(), m.end(), french)
            if p.score(f) > -1:
                p.update(f, -1.0)
        spaces = [m.start() for m in re.finditer(r"(?<=\S) (?=\S)", t)]
        for _ in range(6):
            if not spaces:
                break
            p.t += 1
            s = spaces[int(r.integers(len(spaces)))]
            mark = STRAY[int(r.integers(12))]
            x = t[:s] + " " + mark + t[s:]
            f = stray_features(mark, x, s + 1, s + 1 + len(mark), french)
            if p.score(f) < 1:
                p.update(f, 1.0)
    p.average()
    q = ed.joins
    long = [w for w in words if w.isalpha() and len(w) > 4]
    compounds = [w for t in clean for w in re.findall(r"[^\W\d_]+-[^\W\d_]+", t)]
    for _ in range(rounds):
        for w in long[:SAMPLE_JOINS]:
            q.t += 1
            i = int(r.integers(2, len(w) - 1))
            f = ed.join_features(w[:i], "-‐¬"[int(r.choice(3, p=[0.7, 0.15, 0.15]))], w[i:])
            if q.score(f) < 1:
                q.update(f, 1.0)
        for w in (compounds[:SAMPLE_JOINS] * 3)[:SAMPLE_JOINS]:
            q.t += 1
            a, b = w.split("-", 1)
            f = ed.join_features(a, "-", b)
            if q.score(f) > -1:
                q.update(f, -1.0)
    q.average()


def _train_lines(ed: Editor, clean: list[str], r: np.random.Generator) -> None:
    """Pages cut from clean texts, with headers and numbers put at their edges."""
    styles = ["Page {n}", "Page {n} of {k}", "Pg. {n}", "[{n}]", "- {n} -", "{n}"]
    p = ed.lines
    for t in clean * 3:
        lines = [x for x in _PAGE.sub("", t).split("\n")]
        if len(lines) < 12:
            continue
        k = int(r.integers(1, 5))
        size = max(6, len(lines) // k)
        title = next((x.strip() for x in lines if 8 < len(x.strip()) < 60), "Report")
        header = re.sub(r"[.?!:;,]+$", "", title) + (" - CONFIDENTIAL" if r.random() < 0.3 else "")
        style = styles[int(r.integers(len(styles)))]
        with_head, with_number, foot, merged = r.random() < 0.5 and k > 1, r.random() < 0.6, r.random() < 0.5, r.random() < 0.2
        out, gold = [], set()
        for n in range(k):
            body = [x for x in lines[n * size : (n + 1) * size]]
            top, end = [], []
            number = style.format(n=n + 1 + int(r.integers(0, 2)) * 0, k=k)
            h = header
            if with_head and r.random() < 0.4:
                h = " ".join(_corrupt(w, r)[0] if r.random() < 0.3 else w for w in header.split())
            if with_head and merged and with_number:
                (end if foot else top).append(f"{h}   {n + 1}" if r.random() < 0.5 else f"{n + 1}   {h}")
            else:
                if with_head:
                    (end if foot and r.random() < 0.5 else top).append(h)
                if with_number:
                    (end if r.random() < 0.75 else top).append(number)
            out.append(f"<<<PAGE {n + 1}>>>")
            for x in top:
                gold.add((n, x))
                out.append(x)
            out += body
            for x in end:
                gold.add((n, x))
                out.append(x)
        text = "\n".join(out)
        starts = [m.start() for m in _PAGE.finditer(text)]
        for s, e, a, b, like, pages in frame(text):
            p.t += 1
            n = sum(1 for x in starts if x <= s) - 1
            y = 1.0 if (n, text[s:e]) in gold else -1.0
            f = ed.line_features(text[s:e].strip(), a, b, like, pages)
            if p.score(f) * y < 1:
                p.update(f, y)
    p.average()


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n, calm: counts of the words of a column named text, in all texts and in those without noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[dict[str, int], dict[str, int]] = ({}, {})
            for t in b.column(0).to_pylist():
                if t:
                    d = seen[quiet(t)]
                    for x in t.split():
                        d[x] = d.get(x, 0) + 1
            n: dict[str, list[int]] = {}
            for calm in (0, 1):
                for x, k in seen[calm].items():
                    w = x.strip(_EDGE)
                    if w:
                        for part in {w, *w.split("-")} if "-" in w else (w,):
                            c = n.setdefault(part, [0, 0])
                            c[0] += k
                            c[1] += k * calm
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([c[0] for c in n.values()], pa.int64()), pa.array([c[1] for c in n.values()], pa.int64())], names=["word", "n", "calm"])

    return staged(spread(texts).mapInArrow(run, "word string, n bigint, calm bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("calm").alias("calm")))


def frequent(words: DataFrame, most: int = WORDS) -> tuple[dict[str, tuple[int, int]], float, bool]:
    """Counts of the words that are so frequent that at most so many of them are, the share of those without noise, and whether these are all words."""
    # Words by how often they occur: the counts of counts are few, so the bound is found without sorting words.
    levels = words.groupBy(F.least("n", F.lit(1 << 20)).alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.sum("calm").alias("calm")).orderBy(F.desc("level")).collect()
    least, kept = 1, 0
    for r in levels:
        if kept + r["words"] > most:
            least = r["level"] + 1
            break
        kept += r["words"]
    counts = _as_counts(words.where(F.col("n") >= least))
    return counts, sum(r["calm"] for r in levels) / max(1, sum(r["n"] for r in levels)), least == 1


def _as_counts(words: DataFrame) -> dict[str, tuple[int, int]]:
    got = words.select("word", "n", "calm").toArrow()
    return dict(zip(got.column("word").to_pylist(), zip(got.column("n").to_pylist(), got.column("calm").to_pylist())))


def corpus_counts(texts: DataFrame, most: int = WORDS) -> tuple[dict[str, tuple[int, int]], float]:
    """Counts of the most frequent words of a column named text, and the share of those in texts without noise."""
    return frequent(word_counts(texts), most)[:2]


def _trained(texts: DataFrame, most: int) -> tuple[Editor, DataFrame]:
    """The editors, and word, n, calm of all words."""
    words = word_counts(texts)
    counts, share, whole = frequent(words, most)
    rows = texts.where(F.length("text").between(201, SAMPLE_CHARS)).orderBy(F.xxhash64("text"), "text").limit(6 * SAMPLE_TEXTS).collect()
    clean = [x for r in rows if quiet(x := r[0])][:SAMPLE_TEXTS]
    ours = counts
    if not whole:
        asked = texts.sparkSession.createDataFrame(pa.table({"word": pa.array(sorted(asked_in_training(clean) - counts.keys()), pa.string())}))
        ours = counts | _as_counts(words.join(F.broadcast(asked), "word"))
    ed = train(ours, share, clean)
    ed.n, ed.whole = counts, whole
    return ed, words


def _distinct(extractions: DataFrame) -> DataFrame:
    # Copies count once: a misread word is no word because many rows hold the same text.
    return staged(extractions.select("text").where("text is not null and text <> ''").distinct())


def trained(extractions: DataFrame) -> Editor:
    return _trained(_distinct(extractions), WORDS)[0]


def repairs(words: DataFrame, ed: Editor) -> DataFrame:
    """word, fixed, sure of the words that the character editor changes, each beside all words that it could be."""
    shared = words.sparkSession.sparkContext.broadcast((ed.share, ed.chars.w))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([edit_key(w) for w in b.column(0).to_pylist()], pa.string()), *b.columns], names=["key", "word", "n", "calm"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, weights = shared.value
        e = Editor({}, share)
        e.chars = Perceptron(weights)

        def fixed() -> Iterator[tuple[str, str, float]]:
            top = max((c[0] for c in e.n.values()), default=0)
            if len(e.n) > 1 and top >= 2:
                for w, c in e.n.items():
                    if top > 3 * c[0] and (f := e.fix(w)):  # what a word becomes is more than three times as usual
                        yield w, *f

        key = None
        for b in batches:
            rows = []
            for k, w, n, calm in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    rows += fixed()
                    key, e.n, e._known = k, {}, {}
                e.n[w] = n, calm
            yield made(rows)
        yield made(list(fixed()))

    def made(rows: list[tuple[str, str, float]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["word", "fixed", "sure"])

    # A compound's parts are words by themselves, and no edit makes a compound.
    rows = words.where("word not rlike '(?s)^.+-.+$'").select("word", "n", "calm").mapInArrow(keyed, "key string, word string, n bigint, calm bigint")
    return staged(rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "word string, fixed string, sure double"))


def _looked_up(texts: DataFrame, words: DataFrame, ed: Editor, what: str) -> DataFrame:
    """h (SHA-256 of a text), defects and with what "texts" the text repaired, of distinct texts, where not all counts are in memory."""
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = texts.select(F.pmod(F.xxhash64("text"), F.lit(size // BLOCK_CHARS + 1)).alias("block"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("h"), "text")
    shared = texts.sparkSession.sparkContext.broadcast((ed.n, ed.share, ed.chars.w, ed.joins.w, ed.lines.w))

    def uses(t: pa.Table) -> pa.Table:
        tokens = {x for s in t.column("text").to_pylist() if not is_email(s) for x in s.split()}
        ws = sorted({part for x in tokens if (w := x.strip(_EDGE)) for part in (w.split("-") if "-" in w[1:-1] else (w,))})
        return pa.table({"block": pa.array([t.column("block")[0].as_py()] * len(ws), pa.int64()), "word": pa.array(ws, pa.string())})

    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        n, share, c, j, w = shared.value
        e = Editor(n, share, False)
        e.chars, e.joins, e.lines = Perceptron(c), Perceptron(j), Perceptron(w)
        for word, fixed, sure, count in zip(*(known.column(x).to_pylist() for x in ("word", "fixed", "sure", "n"))):
            if fixed is None:
                e.looked_up[word] = count
            else:
                e._known[word] = fixed, sure
        defects, out, asked = [], [], []
        for s in t.column("text").to_pylist():
            e.asked = set()
            try:
                text, found_ = repair(s, e) if what == "texts" else (None, sorted(analyse(s, e)[0]))
                defects.append(found_)
                out.append(text)
                asked.append(None)
            except Unsettled:
                defects.append(None)
                out.append(s)
                asked.append(sorted(e.asked))
        strings = pa.list_(pa.string())
        return pa.table({"block": t.column("block"), "h": t.column("h"), "defects": pa.array(defects, strings), "text": pa.array(out, pa.string()), "asked": pa.array(asked, strings)})

    pairs = blocks.groupBy("block").applyInArrow(uses, "block bigint, word string")
    known = staged(pairs.join(repairs(words, ed), "word").select("block", "word", "fixed", "sure", F.lit(None).cast("bigint").alias("n")))
    done = None
    while True:  # each text gets further with the counts that it has asked for
        got = staged(blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, "block bigint, h binary, defects array<string>, text string, asked array<string>"))
        part = got.where("asked is null").select("h", "defects", "text")
        done = part if done is None else done.unionByName(part)
        blocks = got.where("asked is not null")
        if blocks.isEmpty():
            return done
        new = blocks.select("block", F.explode("asked").alias("word")).distinct().join(words.select("word", "n"), "word", "left")
        known = known.unionByName(staged(new.select("block", "word", F.lit(None).cast("string").alias("fixed"), F.lit(None).cast("double").alias("sure"), F.coalesce("n", F.lit(0)).alias("n"))))
        blocks = blocks.select("block", "h", "text")


def _run(extractions: DataFrame, what: str, most: int | None = None) -> DataFrame:
    texts_ = _distinct(extractions)
    ed, words = _trained(texts_, WORDS if most is None else most)
    if not ed.whole:
        got = _looked_up(texts_, words, ed, what)
        rows = extractions.select(F.col("extraction_id").cast("bigint").alias("extraction_id"), F.col("text").alias("was"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("h"))
        if what == "defects":
            return rows.select("extraction_id", "h").join(got, "h").select("extraction_id", F.explode("defects").alias("defect"))
        return rows.join(got, "h", "left").select("extraction_id", F.when(F.col("was") == "", "").otherwise(F.col("text")).alias("text"), F.coalesce("defects", F.array().cast("array<string>")).alias("defects"))
    shared = extractions.sparkSession.sparkContext.broadcast((ed.n, ed.share, ed.chars.w, ed.joins.w, ed.lines.w))  # at most WORDS counts and some thousand weights

    def load() -> Editor:
        n, share, c, j, w = shared.value
        e = Editor(n, share)
        e.chars, e.joins, e.lines = Perceptron(c), Perceptron(j), Perceptron(w)
        return e

    def defects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = load()
        for b in batches:
            rows = [(k, d) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for d in sorted(analyse(t, e)[0])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["extraction_id", "defect"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = load()
        for b in batches:
            got = [repair(t, e) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string()))], names=["extraction_id", "text", "defects"])

    rows = spread(extractions.select(F.col("extraction_id").cast("bigint").alias("extraction_id"), "text"))
    return rows.mapInArrow(defects, "extraction_id bigint, defect string") if what == "defects" else rows.mapInArrow(texts, "extraction_id bigint, text string, defects array<string>")


def found(extractions: DataFrame) -> DataFrame:
    """extraction_id, defect: each kind of defect of each text, once."""
    return _run(extractions, "defects").distinct()


def repaired(extractions: DataFrame) -> DataFrame:
    """extraction_id, text, defects: every text in continuous paragraphs."""
    return _run(extractions, "texts")
