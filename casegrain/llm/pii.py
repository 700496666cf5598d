"""Personal information in free text: found by a character tagger, replaced by placeholders.

The tagger is a character BiLSTM with CRF transitions (crf_tagger), trained in numpy
from labelled spans (pii_train).  Its weights are shipped in models/.  Texts are
decoded whole, in overlapping windows that are reconciled by one Viterbi pass.

An exact check follows the tagger: spans are cut to the characters that their kind
can have and dropped if they can't be of it.  It adds no span by itself.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..io import staged
from . import crf_tagger as M
from .pii_train import GIVEN

WEIGHTS = os.path.join(os.path.dirname(__file__), "models", "pii_tagger.npz")
#: Texts decoded together in a task.
BATCH_CHARS = 1_000_000

_EMAIL = re.compile(r"^[\w.+-]+\s*(?:@|\[at\]|\(at\)|\bat\b)\s*[\w-]+(?:(?:\s*(?:\[dot\]|\(dot\)|\bdot\b)\s*|\.)[\w-]+)+$", re.I)
#: One address in a span that the tagger has run together with its neighbour.
_EMAILS = re.compile(r"[\w.+-]+(?:@|\s*\[at\]\s*|\s*\(at\)\s*|\s+at\s+)[\w-]+(?:(?:\s*\[dot\]\s*|\s*\(dot\)\s*|\s+dot\s+|\.)[\w-]+)+(?![\w@])|\w+\s+dot\s+[\w+-]+\s+at\s+[\w-]+(?:(?:\s+dot\s+|\.)[\w-]+)+", re.I)
_NO_NAME = re.compile(r"^(?:sincerely|respectfully|thanks|regards|best|counsel|plaintiff|defendant|subject|attachment|contact|documents|exhibit|section|page|cordialement|atentamente|dear|hello|notice|partner|associate|adjuster|paralegal|estimator|phone|direct)$", re.I)
_STREET_END = re.compile(r"\b(?:St|Rd|Ave|Ln|Dr|Ct|Pl|Blvd)$")
_TITLE = re.compile(r"^(?:Mr|Mrs|Ms|Dr|Hon|Herr|Frau|Mme|Me|MM|Sr|Sra|Prof|Ing|Dipl|The|Judge|Honorable|Miss)\b\.?\s+", re.U)
_WORD = re.compile(r"[^\W\d_]", re.U)
_GIVEN_BEFORE = re.compile(r"(?:^|(?<=[\s(“\"]))(?:(?:%s)(?:[ \t]+|[ \t]*\n[ \t]*)(?:[A-Z]\.\s+)?|(?:[B-Z]\.\s+)+)\Z" % "|".join(GIVEN))
_GIVENS = (*GIVEN, ".")
_GIVEN_BEHIND = re.compile(r",\s+(?:%s)(?=[.,;\n]|\s+and\b|$)" % "|".join(GIVEN))
_SPACES = re.compile(r"\s+")
_NUMBERS = re.compile(r"\d{3}|@")
_MARK_BEFORE = re.compile(r"[AQ]\.\s+")
_BLANK_LINE = re.compile(r"[ \t]*\n[ \t]*\r?\n\s*")
_INITIAL = re.compile(r"\b[A-Z]$")


@lru_cache(maxsize=1)
def tagger() -> M.Runner:
    return M.Runner(M.load(WEIGHTS))


def _checked(text: str, a: int, b: int, kind: str) -> tuple[int, int, str] | None:
    """The span cut to what its kind can be, None if it can't be of it."""
    while a < b and (text[a].isspace() or text[a] in "\"'“”‘’«»„<>[(,;:|*_=~`^¦·>" and not (kind == "phone" and text[a] == "(")):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in "\"'“”‘’«»„<>](,;:|*_=~`^¦·?!)") and not (text[b - 1] == ")" and "(" in text[a:b] and kind == "phone"):
        b -= 1
    s = text[a:b]
    if kind == "email":
        s = s.rstrip(".")
        b = a + len(s)
        if " " in s and (m := re.search(r"(?:[\w+-]+\s+dot\s+)+$", text[max(0, a - 60) : a])):
            a = max(0, a - 60) + m.start()
            s = text[a:b]
        return (a, b, kind) if len(s) > 5 and (_EMAIL.match(re.sub(r"\s+", " ", s)) or "@" in s and "." in s.split("@")[-1]) else None
    if kind == "phone":
        s = s.rstrip(".")
        b = a + len(s)
        if more := re.compile(r"(?:\s*ext\.?|\.)?\s*(?:(?<=ext)|(?<=ext\.)|(?<=ext\s)|(?<=ext\.\s))\s*\d{1,5}").match(text, b) if re.search(r"ext\.?$", s) or text[b : b + 6].lstrip().startswith("ext") else None:
            b = more.end()
            s = text[a:b]
        if re.search(r"(?:\s|^)ext\.?$", s):
            s = re.sub(r"\s*ext\.?$", "", s)
            b = a + len(s)
        if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}|\d\d\s\d{6}(?:\s[A-Z](?:\s\d{3})?)?|[A-Z]\d{3}-\d{3}-\d{4}|[A-Z]\d{8}", s):
            return _checked(text, a, b, "id_number")
        if re.fullmatch(r"(?:19|20)\d\d-\d\d-\d\d|\d{4}-\d{4}-\d\d|\d\d-\d{3}-\d{3}-\d\d|\d{1,2}[./]\d{1,2}[./]\d{4}.*", s):
            return None
        n = sum(c.isdigit() or c in "lIOo" for c in s)
        return (a, b, kind) if 8 <= n <= 18 and sum(c.isdigit() for c in s) >= 6 else None
    if kind == "id_number":
        s = s.rstrip(".")
        m = re.search(r"[A-Z]?\d.*$", s, re.S)
        if not m:
            return None
        a, b = a + m.start(), a + len(s)
        if (m := re.compile(r"\d{6}\s[A-Z]\s\d{3}$").match(text[a:b])) and re.fullmatch(r"\d\d\s", text[a - 3 : a]):
            a -= 3
        elif m := re.compile(r"\d\d\s\d{6}(?:\s[A-Z])?$").match(text[a:b]):
            if more := re.compile(r"\d\d\s\d{6}\s[A-Z]\s\d{3}\b").match(text, a):
                b = more.end()
        if re.fullmatch(r"\d{10}", text[a:b]):
            return a, b, "phone"
        n = sum(c.isdigit() or c in "lIOo" for c in text[a:b])
        return (a, b, kind) if 7 <= n <= 14 else None
    if kind == "address":
        if s.endswith(".") and not re.search(r"\b(?:St|Rd|Ave|Ln|Dr|Ct|Pl|Blvd)\.$", s):
            s = s.rstrip(".")
        b = a + len(s)
        if _STREET_END.search(s) and text[b : b + 1] == ".":
            b += 1
        return (a, b, kind) if len(s) >= 8 and any(c.isdigit() for c in s) else None
    while m := _TITLE.match(text[a:b]):
        a += m.end()
    # A transcript's mark for an answer is no initial.
    if (m := _MARK_BEFORE.match(text[a:b])) and not text[text.rfind("\n", 0, a) + 1 : a].strip(" >|") and ("\nQ. " in text or re.match(r"[A-Z][a-z]+\s+[A-Z]", text[a + m.end() : b])):
        a += m.end()
    if text[max(0, a - 24) : a].rstrip().endswith(_GIVENS) and (m := _GIVEN_BEFORE.search(text[max(0, a - 24) : a])):
        a = max(0, a - 24) + m.start()
    if (m := _GIVEN_BEHIND.match(text[b : b + 20])):
        if "," not in text[a:b] and " " not in text[a:b].strip():
            b += m.end()
    s = text[a:b]
    if s.endswith("."):
        s = s.rstrip(".")
        if not _INITIAL.search(s):
            b = a + len(s)
        else:
            b = a + len(s) + 1
    s = text[a:b]
    return (a, b, kind) if len(s) >= 2 and _WORD.search(s) and not _NUMBERS.search(s) and not _NO_NAME.match(s) else None


def _parted(text: str, a: int, b: int, kind: str) -> list[tuple[int, int, str]]:
    """A span that holds two addresses, parted."""
    s = text[a:b]
    if kind == "email" and len(re.findall(r"@|\bat\b", s)) > 1:
        got = [(a + m.start(), a + m.end(), kind) for m in _EMAILS.finditer(s)]
        return got or [(a, b, kind)]
    if kind == "name" and (cuts := "\n" in s and list(_BLANK_LINE.finditer(s))):
        edges = [0, *(x for m in cuts for x in m.span()), len(s)]
        return [(a + x, a + y, kind) for x, y in zip(edges[::2], edges[1::2])]
    if kind == "address" and (m := re.search(r"\s+to\s+(?=\d|[A-Z])", s)) and m.start() > 8 and len(s) - m.end() > 8:
        return [(a, a + m.start(), kind), (a + m.end(), b, kind)]
    return [(a, b, kind)]


def _merged(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Neighbours of one kind that only a slip of the tagger has parted are one span; words are whole."""
    out: list[tuple[int, int, str]] = []
    for a, b, k in spans:
        if k == "name":
            while a > 0 and text[a - 1].isalpha() and text[a].isalpha():
                a -= 1
            while b < len(text) and text[b].isalpha() and text[b - 1].isalpha():
                b += 1
        elif k in ("email", "phone", "id_number", "address"):
            while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
                a -= 1
            while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
                b += 1
        if out and a < out[-1][1]:
            if k == out[-1][2]:
                out[-1] = (out[-1][0], max(b, out[-1][1]), k)
            continue
        gap = text[out[-1][1] : a] if out else None
        if out and k == out[-1][2] and gap is not None and (gap in ("", ".", "-", "@") or (k == "address" and re.fullmatch(r"[,.]?\s+#?\s?", gap)) or (k == "phone" and re.fullmatch(r"[\s().-]{1,3}", gap))):
            out[-1] = (out[-1][0], b, k)
        else:
            out.append((a, b, k))
    return out


def spans_of(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Checked spans of each text, in order and apart."""
    out = []
    for text, found in zip(texts, M.decode(tagger(), texts)):
        spans = [x for y in _merged(text, found) for a, b, k in _parted(text, *y) if (x := _checked(text, a, b, k))]
        out.append(spans)
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in the spans' places."""
    out, at = [], 0
    for a, b, k in spans:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """From, to of the texts that are decoded together."""
    k = 0
    while k < len(texts):
        n, size = k, 0
        while n < len(texts) and (size < BATCH_CHARS or n == k):
            size += len(texts[n]) if n == k or texts[n] != texts[n - 1] else 0
            n += 1
        yield k, n
        k = n


def _decoded(rows: DataFrame) -> DataFrame:
    """h, spans and redacted of distinct texts (columns h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k, n in _slices(texts):
                got = spans_of(texts[k:n])
                flat = [(x, y, t, _SPACES.sub(" ", s[x:y])) for s, g in zip(texts[k:n], got) for x, y, t in g]
                parts = [pa.array([f[i] for f in flat], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
                ends = np.cumsum([0, *map(len, got)], dtype=np.int32)
                spans = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, names=["start", "end", "pii_type", "pii_text"]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[k:n], pa.binary()), spans, pa.array([redact(s, g) for s, g in zip(texts[k:n], got)], pa.string())], names=["h", "spans", "redacted"])

    return rows.mapInArrow(run, "h binary, spans array<struct<start:int,end:int,pii_type:string,pii_text:string>>, redacted string")


def _records(tables: list[tuple[DataFrame, str, str]]) -> tuple[DataFrame, int]:
    """record_table, record_id, text of every record with a text, and in how many partitions to decode them."""
    rows = None
    for df, name, key in tables:
        x = df.select(F.lit(name).alias("record_table"), F.col(key).cast("bigint").alias("record_id"), "text").where("text is not null and text <> ''")
        rows = x if rows is None else rows.unionByName(x)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows, max(4 * cores, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def tag(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """record_table, record_id, spans, redacted for every record with a text.

    tables: (frame with a column text, name, id column).  Each distinct text is
    decoded once.  Null and empty texts have no row.
    """
    rows, n = _records(tables)
    rows = rows.withColumn("h", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    # A text is shuffled once, to its copies; records are joined by its digest (SHA-256) and never carry it.
    decoded = staged(_decoded(rows.select("h", "text").repartition(n, "h").dropDuplicates(["h"])))
    return rows.select("record_table", "record_id", "h").distinct().join(decoded, "h").drop("h")


def found(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """record_table, record_id, pii_type, pii_text: each span as it stands in the text, once for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, its = None, []  # copies stand one behind the other, in the next batch too
        for b in batches:
            texts = b.column("text").to_pylist()
            for k, n in _slices(texts):
                new = [s for before, s in zip([last, *texts[k:n]], texts[k:n]) if s != before]
                each = iter([list(dict.fromkeys((t, _SPACES.sub(" ", s[x:y])) for x, y, t in g)) for s, g in zip(new, spans_of(new))])
                which, pairs = [], []
                for i in range(k, n):
                    if texts[i] != last:
                        last, its = texts[i], next(each)
                    which += [i] * len(its)
                    pairs += its
                of = b.select(["record_table", "record_id"]).take(pa.array(which, pa.int32()))
                yield pa.RecordBatch.from_arrays([*of.columns, pa.array([t for t, _ in pairs], pa.string()), pa.array([s for _, s in pairs], pa.string())], names=["record_table", "record_id", "pii_type", "pii_text"])

    # A text is shuffled once, to its copies, with the id of its record; nothing has to be joined.
    rows, n = _records(tables)
    got = rows.repartition(n, "text").sortWithinPartitions(F.xxhash64("text")).mapInArrow(run, "record_table string, record_id bigint, pii_type string, pii_text string")
    return staged(got).distinct()
