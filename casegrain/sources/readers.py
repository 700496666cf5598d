"""Files of many formats as rows of text.

    read_files(spark, "folder/*")  ->  path, text, method, pages, ocr_pages, error

Every file has a row: one that can't be read keeps an error and no text.  Formats
that the standard library can read are read here; PDF, Outlook and image files need
a library or a function that is given, and say so in the error if there is none.
Scanning splits by file, so a folder of any number of files is read in parallel;
one file must fit a task.  Files of no bytes have no row: the scan leaves them out.
"""

from __future__ import annotations

import csv
import email
import email.policy
import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, text string, method string, pages int, ocr_pages int, error string"
#: A page of fewer visible characters than this is one that only a scan reads.
SCAN_BELOW = 40


def _collapse(text: str) -> str:
    """Runs of blanks as one, at most one empty line between lines."""
    text = re.sub(r"[ \t\f\v\u00a0]+", " ", text.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n[ ]*(?:\n[ ]*)+", "\n\n", re.sub(r"[ ]*\n[ ]*", "\n", text)).strip()


def html_text(raw: str) -> str:
    """Visible text of a page: blocks end lines, scripts and styles go, entities are read."""
    raw = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", raw)
    raw = re.sub(r"(?i)<(?:br|/p|/div|/tr|/li|/h[1-6])\b[^>]*>", "\n", raw)
    return _collapse(html.unescape(re.sub(r"<[^>]+>", " ", raw)))


def table_text(raw: str, tab: bool) -> str:
    rows = csv.reader(io.StringIO(raw), delimiter="\t" if tab else ",")
    return "\n".join(" | ".join(c.strip() for c in r) for r in rows if any(c.strip() for c in r))


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _inner(e: ElementTree.Element) -> str:
    """Text under an element; tabs and breaks keep their place."""
    out = []
    for x in e.iter():
        t = _tag(x)
        if t in ("tab", "s"):
            out.append("\t" if t == "tab" else " ")
        elif t in ("br", "line-break"):
            out.append("\n")
        if x.text and t in ("t", "span", "p", "h", "a"):
            out.append(x.text)
        if x is not e and x.tail and t in ("span", "s", "tab", "line-break", "a"):
            out.append(x.tail)
    return "".join(out)


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n".join(p for e in _xml(z, "word/document.xml").iter() if _tag(e) == "p" and (p := _inner(e).strip()))


def odt_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n".join(p for e in _xml(z, "content.xml").iter() if _tag(e) in ("p", "h") and (p := _inner(e).strip()))


def pptx_text(data: bytes) -> tuple[str, int]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        parts = []
        for k, n in enumerate(names, 1):
            parts.append(f"<<<SLIDE {k}>>>")
            parts += [p for e in _xml(z, n).iter() if _tag(e) == "p" and (p := _inner(e).strip())]
        return "\n".join(parts), len(names)


def xlsx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        titles = [s.get("name", "") for s in _xml(z, "xl/workbook.xml").iter() if _tag(s) == "sheet"]
        names = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        out = []
        for k, n in enumerate(names):
            out.append(f"<<<SHEET {titles[k] if k < len(titles) else k + 1}>>>")
            for row in (e for e in _xml(z, n).iter() if _tag(e) == "row"):
                cells = []
                for c in row:
                    v = next((x.text for x in c if _tag(x) == "v"), None)
                    if c.get("t") == "s" and v is not None:
                        v = shared[int(v)]
                    elif c.get("t") == "inlineStr":
                        v = "".join(t.text or "" for t in c.iter() if _tag(t) == "t")
                    if v:
                        cells.append(v.strip())
                if cells:
                    out.append(" | ".join(cells))
        return "\n".join(out)


def rtf_text(raw: str) -> str:
    """Text of RTF: destinations without text go, \\par ends lines, \\'hh and \\u are read."""
    raw = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info|pict|generator)\b(?:[^{}]|\{[^{}]*\})*\}", "", raw)
    raw = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), raw)
    raw = re.sub(r"\\u(-?\d+)\s?\??", lambda m: chr(int(m[1]) % 65536), raw)
    raw = re.sub(r"\\(?:par|line)\b\s?", "\n", raw)
    raw = re.sub(r"\\tab\b\s?", "\t", raw)
    return _collapse(re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d*\s?|\\[^a-zA-Z]", "", raw)))


def eml_text(data: bytes) -> str:
    m = email.message_from_bytes(data, policy=email.policy.default)
    out = [f"{h}: {m.get(h, '')}" for h in ("From", "To", "Cc", "Date", "Subject")] + [""]
    files = []
    for part in m.walk():
        if part.get_filename():
            files.append(f"Attachment: {part.get_filename()}")
        elif part.get_content_type() == "text/plain":
            out.append(part.get_content())
        elif part.get_content_type() == "text/html" and not m.get_body(("plain",)):
            out.append(html_text(part.get_content()))
    head = out[:6]
    return "\n".join([*head, *files, *out[6:]]).strip()


def msg_text(data: bytes) -> str:
    """Headers, names of attachments and body of an Outlook message."""
    try:
        import extract_msg
    except ImportError:
        raise ValueError("no Outlook reader is installed") from None
    m = extract_msg.openMsg(data)
    try:
        head = [f"{n}: {v or ''}" for n, v in (("From", m.sender), ("To", m.to), ("Cc", m.cc), ("Date", m.date), ("Subject", m.subject))]
        names = [getattr(a, "longFilename", None) or getattr(a, "shortFilename", None) or "unnamed" for a in m.attachments]
        return "\n".join([*head, *(f"Attachment: {n}" for n in names), "", m.body or ""])
    finally:
        m.close()


def pdf_text(data: bytes, scan: Callable[[bytes, int], str] | None) -> tuple[str, int, int]:
    """Text by page with page markers, pages, and how many of them only a scan reads."""
    try:
        from pypdf import PdfReader
    except ImportError:
        raise ValueError("no PDF reader is installed") from None
    pages, scanned = [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages], 0
    for k, p in enumerate(pages):
        if len(re.sub(r"\s+", "", p)) < SCAN_BELOW and scan:
            pages[k] = scan(data, k) or p
            scanned += pages[k] is not p
    return "\n".join(f"<<<PAGE {k}>>>\n{p.strip()}\n" for k, p in enumerate(pages, 1)), len(pages), scanned


def read_bytes(name: str, data: bytes, scan: Callable[[bytes, int], str] | None = None) -> tuple[str | None, str | None, int, int, str | None]:
    """text, method, pages, ocr_pages, error of one file; it never raises."""
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    try:
        plain = lambda: data.decode("utf-8", "replace")
        if ext in ("txt", "md", "log", "json", "xml", "yaml", "yml"):
            return plain(), "text", 0, 0, None
        if ext in ("html", "htm"):
            return html_text(plain()), "html", 0, 0, None
        if ext in ("csv", "tsv"):
            return table_text(plain(), ext == "tsv"), ext, 0, 0, None
        if ext == "docx":
            return docx_text(data), "docx", 0, 0, None
        if ext == "odt":
            return odt_text(data), "odt", 0, 0, None
        if ext in ("xlsx", "xlsm"):
            return xlsx_text(data), "xlsx", 0, 0, None
        if ext == "pptx":
            text, n = pptx_text(data)
            return text, "pptx", n, 0, None
        if ext == "rtf":
            return rtf_text(data.decode("latin-1")), "rtf", 0, 0, None
        if ext == "eml":
            return eml_text(data), "eml", 0, 0, None
        if ext == "msg":
            return msg_text(data), "msg", 0, 0, None
        if ext == "pdf":
            text, n, s = pdf_text(data, scan)
            return text, "pdf-text+scan" if s else "pdf-text", n, s, None
        if ext in ("png", "jpg", "jpeg", "tif", "tiff", "bmp"):
            if scan is None:
                raise ValueError("images need a scan function")
            return scan(data, 0), "scan", 1, 1, None
        raise ValueError(f"no reader for .{ext}")
    except Exception as e:  # a bad file keeps its row
        return None, None, 0, 0, f"{type(e).__name__}: {e}"[:300]


def read_files(spark: SparkSession, path: str, scan: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """A row for each file of a folder or pattern."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [read_bytes(p, bytes(c), scan) for p, c in zip(f["path"], f["content"])]
            yield pd.DataFrame({"path": f["path"], **{n: [g[k] for g in got] for k, n in enumerate(("text", "method", "pages", "ocr_pages", "error"))}})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...]) -> DataFrame:
    """Rows of a JSON lines file; lines that are no JSON or lack a required field are left out."""
    raw = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    ok = F.col("_bad").isNull()
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return raw.where(ok).drop("_bad")


def read_shards(spark: SparkSession, path: str, table: str = "docs") -> DataFrame:
    """Rows of SQLite shards in a folder, with the shard's name; each file is read by one task, without a lock."""
    import sqlite3
    import tempfile

    names = ["source_id", "title", "excerpt", "jurisdiction", "year", "citation"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, c in zip(f["path"], f["content"]):
                with tempfile.NamedTemporaryFile(suffix=".db") as t:  # a task's own scratch, read at once
                    t.write(bytes(c))
                    t.flush()
                    con = sqlite3.connect(f"file:{t.name}?mode=ro&immutable=1", uri=True)
                    have = {r[1] for r in con.execute(f'PRAGMA table_info("{table}")')}
                    alias = {"source_id": ("source_id", "id", "uuid"), "title": ("title", "case_name"), "excerpt": ("excerpt", "text", "summary")}
                    cols = []
                    for n in names:
                        some = [x for x in alias.get(n, (n,)) if x in have]
                        cols.append("COALESCE(" + ", ".join(f"NULLIF(\"{x}\", '')" for x in some) + ", NULL)" if some else "NULL")
                    rows = con.execute(f'SELECT {", ".join(cols)} FROM "{table}"').fetchall()
                    con.close()
                d = pd.DataFrame(rows, columns=names).astype("string")
                d.insert(0, "shard", p.rsplit("/", 1)[-1])
                yield d.astype(object).where(d.notna(), None)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.db").load(path)
    return files.select("path", "content").mapInPandas(run, "shard string, " + ", ".join(f"{n} string" for n in names))


def read_documents(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One row for each JSON document (case metadata, point records, rule packs) of a pattern; documents that are no JSON are left out."""
    raw = spark.read.schema(schema + ", _bad string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(pattern)
    return raw.where("_bad is null").drop("_bad")


PACK = "schema_version int, id string, label string, source_url string, rules array<struct<type:string,code:string,severity:string,pattern:string,field:string,applies_to:array<string>,message:string,authority:string>>"


def rules_of(packs: DataFrame) -> DataFrame:
    """pack, type, code, severity, pattern (or field), applies_to, authority of rule packs, packs by label.

    A rule without kinds of paper applies to all.  Only packs of schema 1 count.
    """
    r = packs.where("schema_version = 1").select("label", F.col("id").alias("pack"), F.posexplode("rules").alias("n", "r")).orderBy("label", "n")
    kinds = F.coalesce(F.transform("r.applies_to", lambda k: F.lower(k)), F.array(F.lit("*")))
    return r.select("pack", "r.type", "r.code", F.coalesce("r.severity", F.lit("warning")).alias("severity"), F.coalesce("r.pattern", "r.field").alias("pattern"), kinds.alias("applies_to"), F.coalesce("r.authority", F.lit("")).alias("authority"))


def load_rules(packs: DataFrame) -> dict[str, list[tuple]]:
    """Rules by pack, as ledger.rule_findings takes them; packs are few and small files that people write."""
    out: dict[str, list[tuple]] = {}
    for r in rules_of(packs).collect():
        out.setdefault(r["pack"], []).append((r["type"], r["code"], r["severity"], r["pattern"], list(r["applies_to"]), r["authority"]))
    return out
