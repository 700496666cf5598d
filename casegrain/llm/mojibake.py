"""Text decoded with the wrong encoding: found and restored with character n-gram models.

A smoothed character trigram model is trained on the clean records of the corpus.
Its counts are hashed into tables of a fixed size, so that neither the model nor
what is sent to the driver grows with the data.  For each field every candidate
encode-decode chain is applied, wherever it fits, and scored; chains between old
encodings are applied to the passages that they make likelier.  The likeliest is taken
if it beats the text as it stands by a margin.  The margin is validated: it is set
above what any chain gains on the clean records, all of them, each scored by the model
without its own counts.
Chains are repeated, since text may have been garbled twice.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..io import spread, staged

UNI, BI, TRI = 1 << 15, 1 << 17, 1 << 19
LEAST_MARGIN = 4.0
#: Ranges that figures are counted in at a time to find a quantile.
CELLS = 4096

# Encodings that text is wrongly read with, and those it was written in.
WRONG = ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859-2", "iso8859-15", "cp1254", "cp1253", "koi8-r", "cp866", "iso8859-7", "cp1257", "cp852"]
LEGACY = [
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("latin-1", "mac_roman"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("latin-1", "cp850"), ("latin-1", "cp437"),
    ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("cp1253", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("cp1252", "cp866"), ("latin-1", "cp866"), ("mac_roman", "cp1251"), ("cp850", "cp866"), ("cp437", "cp866"),
    ("cp1252", "cp1253"), ("latin-1", "iso8859-7"), ("latin-1", "cp1253"), ("cp1252", "iso8859-7"), ("cp1251", "cp1253"), ("cp1252", "cp1256"), ("latin-1", "cp1256"), ("latin-1", "iso8859-6"), ("cp1251", "cp1256"),
    ("cp1252", "gbk"), ("latin-1", "gbk"), ("cp1251", "gbk"), ("cp1252", "shift_jis"), ("latin-1", "shift_jis"), ("cp1252", "euc_jp"), ("latin-1", "euc_jp"), ("cp1252", "euc_kr"), ("latin-1", "euc_kr"), ("cp1252", "big5"), ("latin-1", "big5"), ("gbk", "shift_jis"), ("gbk", "utf-8"), ("shift_jis", "utf-8"), ("euc_kr", "utf-8"), ("big5", "utf-8"),
]
#: Encodings under which clean text holds no UTF-8; clean Russian or Greek holds it by chance under those of their own scripts.
SUSPECT = {"cp1252", "latin-1", "cp1251", "cp1250", "mac_roman", "cp437", "cp850", "iso8859-2"}
_MANY_BYTES = {"gbk", "shift_jis", "euc_jp", "euc_kr", "big5"}
_REST = re.compile(r"[\x00-\x7f]*[\xe0-\xef][\x80-\xbf][\x00-\x7f]*")
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_ENTITY = re.compile(r"&(?:#\d{2,5}|#x[0-9a-fA-F]{2,4}|[A-Za-z]{2,8});")
_HIGH = re.compile(r"[^\x00-\x7f]")


@lru_cache(maxsize=64)
def _bytes_of(enc: str) -> dict[int, int]:
    """Character to byte for a one-byte encoding; bytes without a character stand for the control of that number."""
    t: dict[int, int] = {}
    for b in range(128, 256):
        try:
            t[ord(bytes([b]).decode(enc))] = b
        except UnicodeDecodeError:
            t.setdefault(b, b)
    return t


@lru_cache(maxsize=64)
def _as_bytes(enc: str) -> dict[int, int]:
    """A translation to characters U+0080..U+00FF that stand for the bytes; what has no byte becomes U+FFFF."""

    class T(dict):
        def __missing__(self, c: int) -> int:
            return c if c < 128 else 0xFFFF

    return T(_bytes_of(enc))


_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_HIGH_RUN = re.compile(r"[^\x00-\x7f]+")
#: A word with characters beyond ASCII; a no-break space may be a byte of it.
_HIGH_WORD = re.compile(r"[^ \t\r\n\f\v\x80-\U0010ffff]*[^\x00-\x7f][^ \t\r\n\f\v]*")


@lru_cache(maxsize=200_000)
def _run_readings(run: str) -> tuple[tuple[str, str], ...]:
    """(wrong encoding, reading) for the encodings under which a run holds UTF-8; most runs of clean text have none."""
    got = []
    for w in WRONG:
        raw = run.translate(_as_bytes(w))
        out, at = [], 0
        for m in _UTF8.finditer(raw):
            try:
                c = m[0].encode("latin-1").decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [run[at : m.start()], c]
            at = m.end()
        if out:
            got.append((w, "".join(out) + run[at:]))
    return tuple(got)


def _utf8_readings(text: str) -> dict[str, str]:
    """Wrong encoding to the text with every part that is UTF-8 under it read as that.

    A UTF-8 character of more than one byte is a run of characters beyond ASCII under
    any of the encodings, so only such runs are looked at.
    """
    runs = {r: dict(x) for r in set(_RUN.findall(text)) if (x := _run_readings(r))}
    return {w: _RUN.sub(lambda m: runs.get(m[0], {}).get(w, m[0]), text) for w in dict.fromkeys(k for x in runs.values() for k in x)}


def _reread(text: str, wrong: str, right: str) -> str:
    """Runs that can be written in the wrong encoding, read in the right one; runs that can't be read stay."""
    out = []
    if wrong in _MANY_BYTES:
        for run in re.split(r"([\x00-\x7f]+)", text):
            try:
                out.append(run.encode(wrong).decode(right) if _HIGH.search(run) else run)
            except UnicodeError:
                out.append(run)
        return "".join(out)
    raw = text.translate(_as_bytes(wrong))
    at = 0
    for piece in re.split("(￿+)", raw):
        src = text[at : at + len(piece)]
        at += len(piece)
        if piece[:1] == "￿" or not _HIGH.search(piece):
            out.append(src)
            continue
        try:
            out.append(piece.encode("latin-1").decode(right))
        except UnicodeDecodeError:
            words, k = re.split(r"(\s+)", piece), 0
            for w in words:
                try:
                    out.append(w.encode("latin-1").decode(right) if _HIGH.search(w) else src[k : k + len(w)])
                except UnicodeDecodeError:
                    out.append(src[k : k + len(w)])
                k += len(w)
    return "".join(out)


@lru_cache(maxsize=64)
def _letters(wrong: str, right: str) -> dict[int, str]:
    """Character to character for two one-byte encodings."""
    got = {}
    for c, b in _bytes_of(wrong).items():
        try:
            got[c] = bytes([b]).decode(right)
        except UnicodeDecodeError:
            continue
    return {c: x for c, x in got.items() if ord(x) != c}


def _codes(text: str) -> np.ndarray:
    a = np.frombuffer(("  " + text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((a >= 48) & (a <= 57), 48, a)


def _slots(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table places of each character, of each pair and of each three."""
    return _uni(a), _bi(a[:-1], a[1:]), _tri(a[:-2], a[1:-1], a[2:])


def _own_slots(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table places of what a text counts: its characters and two blanks behind it, each with what stands before it."""
    x, y, z = _slots(_codes(text + "  "))
    return x[2:], y[1:], z


def _uni(a: np.ndarray) -> np.ndarray:
    return (a * 40503 + (a >> 7)) % UNI


def _bi(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 1000003 + b * 7919) % BI


def _tri(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a * 2654435761 + b * 40503 * 31 + c * 97003) % TRI


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, b, t = np.zeros(UNI, np.int64), np.zeros(BI, np.int64), np.zeros(TRI, np.int64)
    k = 0
    while k < len(texts):  # many texts at once, parted as a text's start is; what a text counts doesn't depend on its neighbours
        n, size = k, 0
        while n < len(texts) and size < 1_000_000:
            size += len(texts[n])
            n += 1
        x, y, z = _own_slots("  ".join(texts[k:n]))
        u += np.bincount(x, minlength=UNI)
        b += np.bincount(y, minlength=BI)
        t += np.bincount(z, minlength=TRI)
        k = n
    return u, b, t


class Model:
    """Interpolated trigram probabilities from hashed counts."""

    def __init__(self, u: np.ndarray, b: np.ndarray, t: np.ndarray):
        self.u, self.b, self.t = (x.astype(np.float32) for x in (u, b, t))
        self.n = float(u.sum()) + 1.0
        self.words: dict[str, dict] = {}  # readings of words already seen

    def log_probs(self, text: str) -> np.ndarray:
        """log P of each character given the two before it."""
        u, b, t = _slots(_codes(text))
        p1 = (self.u[u[2:]] + 0.02) / (self.n + 0.02 * UNI)
        p2 = (self.b[b[1:]] + 8 * p1) / (self.u[u[1:-1]] + 8)
        p3 = (self.t[t] + 4 * p2) / (self.b[b[:-1]] + 4)
        return np.log(np.minimum(p3, 1.0) + 1e-12)

    def high_log_probs(self, text: str) -> np.ndarray:
        """log P of the characters beyond ASCII only."""
        a = _codes(text)
        at = np.flatnonzero(a[2:] > 127) + 2
        x, y, z = a[at - 2], a[at - 1], a[at]
        u1, u2 = (self.u[_uni(c)] for c in (y, z))
        p1 = (u2 + 0.02) / (self.n + 0.02 * UNI)
        p2 = (self.b[_bi(y, z)] + 8 * p1) / (u1 + 8)
        p3 = (self.t[_tri(x, y, z)] + 4 * p2) / (self.b[_bi(x, y)] + 4)
        return np.log(np.minimum(p3, 1.0) + 1e-12)

    @contextmanager
    def without(self, text: str) -> Iterator[Model]:
        """The model as if a text that it was trained on had not been among its texts."""
        n, kept = self.n, []
        for table, at in zip((self.u, self.b, self.t), _own_slots(text)):
            kept.append((table, at, table[at]))
            np.subtract.at(table, at, np.float32(1))
        self.n -= len(text) + 2
        try:
            yield self
        finally:
            for table, at, x in kept:
                table[at] = x
            self.n = n

    def score(self, text: str) -> float:
        return float(self.log_probs(text).sum())


def looks_clean(text: str) -> bool:
    """No sign of a wrong decoding: such records train the model."""
    if "�" in text or re.search(r"[\x80-\x9f]", text) or (_ENTITY.search(text) and html.unescape(text) != text):
        return False
    return not any(w in SUSPECT for r in set(_RUN.findall(text)) for w, _ in _run_readings(r))


def candidates(text: str) -> dict[str, str]:
    """Name of each chain that ends in UTF-8 to what the text becomes by it, where it becomes another."""
    got: dict[str, str] = {}
    for w, s in _utf8_readings(text).items():
        got[f"{w}>utf-8"] = s
    for n, s in list(got.items()):  # garbled twice: a first step alone may look no better
        for w, t in _utf8_readings(s).items():
            got[f"{n},{w}>utf-8"] = t
    return got


def _legacy_readings(word: str) -> dict[str, str]:
    """Name of each chain between old encodings to what a word becomes by it, where it becomes another."""
    got: dict[str, str] = {}
    high = {c for c in map(ord, set(word)) if c > 127}
    runs = bool(_RUN.search(word))
    for w, r in LEGACY:
        if w in _MANY_BYTES or r in _MANY_BYTES or r == "utf-8":
            # Encodings of several bytes for a character: only where characters beyond ASCII stand together.
            if not runs or (w not in _MANY_BYTES and not high & _bytes_of(w).keys()):
                continue
            s = _reread(word, w, r)
        else:
            m = _letters(w, r)
            s = _HIGH_RUN.sub(lambda x: x[0].translate(m), word) if high & m.keys() else word
        if s != word and "�" not in s:
            got[f"{w}>{r}"] = s
    return got


@lru_cache(maxsize=20_000)
def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


def _scripts(word: str) -> set[str]:
    """Scripts of a word's letters, of those that no text mixes in a word."""
    return {x for x in map(_script, set(word)) if x in ("LATIN", "GREEK", "CYRILLIC", "ARABIC", "HEBREW")}


def _word_gains(word: str, model: Model) -> dict[str, tuple[str, float]]:
    """Chain to a word's reading and what it gains."""
    if word in model.words:
        return model.words[word]
    got = _legacy_readings(word)
    of: dict[str, float] = {}
    if got:
        texts = list(dict.fromkeys([word, *got.values()]))
        lp = model.log_probs("  ".join(texts) + "  ")  # each begins as a text does, and the blank behind it counts
        at = 0
        for s in texts:
            of[s] = float(lp[at : at + len(s) + 1].sum())
            at += len(s) + 2
    # No gain by itself, as it is read so by chance: the rest of a UTF-8 character that lost a byte, what mixes
    # scripts, and a word with letters that the wrong encoding doesn't have.
    rest, letters = bool(_REST.fullmatch(word)), {ord(c) for c in word if ord(c) > 127 and c.isalpha()}
    out = {}
    for n, s in got.items():
        w = n.split(">")[0]
        chance = rest or len(_scripts(s)) > 1 or (w not in _MANY_BYTES and not letters <= _bytes_of(w).keys())
        out[n] = s, min(of[s] - of[word], 0.0) if chance else of[s] - of[word]
    if len(model.words) >= 100_000:
        model.words.clear()
    model.words[word] = out
    return out


def _natural(text: str, model: Model, natural: float, before: str) -> bool:
    high = model.high_log_probs(before + text)[sum(c > "\x7f" for c in before) :]
    return not len(high) or float(high.mean()) >= natural


def passages(text: str, model: Model, margin: float, natural: float) -> dict[str, str]:
    """Chain between old encodings to the text with the passages read by it that gain more than the margin.

    A passage is a row of words with characters beyond ASCII.  It ends where the chain has
    lost more than the margin again, so that clean words around it stay.  What a chain
    makes of a passage must be natural by itself, not only less odd.
    """
    words = [(m.start(), m.end(), _word_gains(m[0], model)) for m in _HIGH_WORD.finditer(text)]
    got: dict[str, str] = {}
    for n in dict.fromkeys(n for _, _, x in words for n in x):
        out, at, k = [], 0, 0
        while k < len(words):
            first, total, best, last = k, 0.0, 0.0, -1
            while k < len(words):
                total += words[k][2][n][1] if n in words[k][2] else 0.0
                if total > best:
                    best, last = total, k
                k += 1
                if total <= 0 or total < best - margin:
                    break
            if best > margin:
                p = start = words[first][0]
                new = []
                for s, e, x in words[first : last + 1]:
                    new += [text[p:s], x[n][0] if n in x else text[s:e]]
                    p = e
                if _natural("".join(new), model, natural, text[max(0, start - 2) : start]):
                    out += [text[at:start], *new]
                    at = p
            k = max(last, first) + 1
        if out:
            got[n] = "".join(out) + text[at:]
    return got


def repair(text: str, model: Model, margin: float, natural: float) -> tuple[str, list[str], float]:
    """The likeliest reading, the chains that lead to it and what it gains."""
    steps: list[str] = []
    total = 0.0
    if "&" in text and _ENTITY.search(text):
        s = html.unescape(text)
        if _HIGH.search(s):
            t, st, g = repair(s, model, margin, natural)
            if st:
                return t, ["entities", *st], g
    while not text.isascii():  # each step gains more than the margin, so there is a last one
        got = candidates(text) | passages(text, model, margin, natural)
        if not got:
            break
        base = model.score(text)
        best = max((model.score(s), s, n) for n, s in got.items())
        if best[0] - base <= margin:
            break
        total += best[0] - base
        text = best[1]
        steps.append(best[2])
    return text, steps, total


#: What is left of UTF-8 after its bytes were lost: lead bytes read as letters where no letter fits.
_LOST = re.compile(r"�|[\x80-\x9f]|(?<![A-Za-zÀ-ÿ])Ã(?=[a-zà-ÿ])|(?<=[a-z])â(?=[A-Za-z]{2,}\b)(?<=\b[ldnscmjtqu]â)|â(?=[\s.,;:?!])(?<=[.?!]â)|(?<=\s)â(?=[A-Z])|(?<=[a-z])Ã(?=[a-z ])")


def judge(text: str | None, model: Model, margin: float, natural: float) -> tuple[str | None, bool, list[str]]:
    """Restored text, whether the text was garbled, and the chains; null, empty and ASCII texts are as they should be."""
    if not text or (text.isascii() and "&" not in text):
        return text, False, []
    new, steps, _ = repair(text, model, margin, natural)
    return new, bool(steps) or bool(_LOST.search(new)), steps


def _training(rows: DataFrame) -> DataFrame:
    """kind, slot, n: hashed counts of the clean records of a column named text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for b in batches:
            # Plain ASCII has nothing to restore; only records with other characters teach what is natural beside them.
            c = counts([t for t in b.column(0).to_pylist() if t and not t.isascii() and looks_clean(t)])
            sums = c if sums is None else tuple(x + y for x, y in zip(sums, c))
        for k, x in enumerate(sums or ()):
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(x[at])], names=["kind", "slot", "n"])

    return rows.mapInArrow(run, "kind int, slot int, n bigint").groupBy("kind", "slot").agg(F.sum("n").alias("n"))


def _tables(rows: DataFrame) -> list[np.ndarray]:
    """Hashed counts of the clean records of a column named text; at most UNI + BI + TRI rows come to the driver."""
    tables = [np.zeros(x, np.int64) for x in (UNI, BI, TRI)]
    got = _training(spread(rows)).toArrow()
    kind, slot, n = (got.column(x).to_numpy() for x in ("kind", "slot", "n"))
    for k in range(3):
        tables[k][slot[kind == k]] = n[kind == k]
    return tables


def _ranked(figures: DataFrame, name: str, share: float) -> float:
    """The quantile of a column of figures, rounded down to one of them; exact whatever their number.

    They are counted in ranges, then those of the range that holds it in finer ones.
    """
    low, high, n = figures.agg(F.min(name), F.max(name), F.count(name)).first()
    rank = int(share * (n - 1))
    while low < high:
        figures = figures.where(F.col(name).between(low, high))
        cell = F.least(F.floor((F.col(name) - low) / (high - low) * CELLS), F.lit(CELLS - 1))
        for r in figures.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).orderBy("cell").collect():
            if rank < r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
    return float(low)


def train(rows: DataFrame) -> tuple[Model, float, float]:
    """Model, margin and the mean log probability above which a text is natural, from all rows of a column named text.

    Every clean record validates the margin, whole, in the executors, by a model without
    its counts.
    """
    rows = staged(rows.where("text rlike '[^\\\\x00-\\\\x7f]'").distinct())  # copies teach once; plain ASCII teaches nothing
    tables = _tables(rows)
    shared = rows.sparkSession.sparkContext.broadcast([x.astype(np.int32) if x.max(initial=0) < 2**31 else x for x in tables])  # 2.8 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            means, gains = [], []
            for t in b.column(0).to_pylist():
                if not t.isascii() and looks_clean(t):
                    got = candidates(t)
                    with m.without(t):
                        means.append(float(m.high_log_probs(t).mean()))
                        base = m.score(t) if got else 0.0
                        gains.append(max((m.score(s) - base for s in got.values()), default=0.0))
            yield pa.RecordBatch.from_arrays([pa.array(means, pa.float64()), pa.array(gains, pa.float64())], names=["mean", "gain"])

    got = staged(spread(rows).mapInArrow(run, "mean double, gain double"))
    model = Model(*tables)
    if got.isEmpty():
        return model, LEAST_MARGIN, -1e9
    natural = _ranked(got, "mean", 0.05) - 0.5
    return model, max(LEAST_MARGIN, _ranked(got, "gain", 0.999) * 1.2), natural


def restore(tables: list[tuple[DataFrame, str, str, list[str]]]) -> DataFrame:
    """record_table, record_id, field, text, restored, garbled, chain for every field of every record.

    tables: (frame, name, id column, text columns).  Null fields come out null and
    not garbled.  One model is trained on all the tables' fields together.
    """
    rows = None
    for df, name, key, fields in tables:
        for f in fields:
            x = df.select(F.lit(name).alias("record_table"), F.col(key).cast("bigint").alias("record_id"), F.lit(f).alias("field"), F.col(f).cast("string").alias("text"))
            rows = x if rows is None else rows.unionByName(x)
    model, margin, natural = train(rows.select("text"))
    shared = rows.sparkSession.sparkContext.broadcast((model.u, model.b, model.t))  # 2.8 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            got = [judge(t, m, margin, natural) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got]), pa.array([",".join(g[2]) for g in got], pa.string())],
                names=[*b.schema.names, "restored", "garbled", "chain"],
            )

    return spread(rows).mapInArrow(run, "record_table string, record_id bigint, field string, text string, restored string, garbled boolean, chain string")


def found(tables: list[tuple[DataFrame, str, str, list[str]]]) -> DataFrame:
    """record_table, record_id, field of the garbled fields, each once."""
    return restore(tables).where("garbled").select("record_table", "record_id", "field").distinct()
