"""E-mails reduced to what their sender newly wrote.

1. A body is cut into units (sentences, or lines where lines stand for themselves).
   Structure proposes what a unit is: quotation marks at line starts, attribution
   lines, header blocks and separators open earlier messages; separators, contact
   data, jobs and firms make name blocks.  It also says where a sender has signed off.
2. Each unit of the sender's own text has a SimHash fingerprint of its character pairs.
   Near-matches are found through Hamming partition tables: the bits stand in ten
   orders, each cut into four parts, and texts that share a part meet.  Exact copies are
   grouped first, so that a text that a third of all mails share is one row of a table;
   all distinct texts of a key are verified, by the bits that differ and then by their
   edit distance.
3. A notice is what several senders put behind their sign-off, in this or a near form,
   whatever it says: no list of phrases is asked.  Names are left out of its
   fingerprint, as they differ from firm to firm.  A unit that was in an earlier mail by
   somebody else in the same exchange is inherited; contact data that the same sender
   ends several mails with, in this or a near form, is boilerplate of the sender.
"""

from __future__ import annotations

import calendar
import itertools
import re
from collections.abc import Iterator
from email.utils import parsedate_to_datetime

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..io import spread, staged

#: Bits of a fingerprint, and how many may differ before the texts are compared.
BITS, FAR = 64, 16
#: The bits in several orders, each cut into four parts: what differs in three bits shares a part in every
#: order, what differs in nine shares one in some order nine times of ten.
ORDERS, WIDTH = 10, 16


def _parts() -> list[list[int]]:
    """The bits of each table's key."""
    r = np.random.default_rng(64)
    bits = [np.arange(BITS), *(r.permutation(BITS) for _ in range(ORDERS - 1))]
    return [sorted(b[k : k + WIDTH].tolist()) for b in bits for k in range(0, BITS, WIDTH)]


TABLES = _parts()
MASKS = [sum(1 << b for b in t) for t in TABLES]
#: Shorter units say too little to be recognised by their likeness.
LEAST_CHARS = 40

HEADER = re.compile(r"^(?:From|To|Sent|Date|Cc|Bcc|Subject|Reply-To|Von|An|Gesendet|Betreff|Datum|De|À|Envoyé|Objet|Para|Enviado|Asunto|Fecha|Kopie)\s*:(?:\s|$)")
_HEADER_KEYS = "From|To|Sent|Date|Cc|Bcc|Subject|Von|An|Gesendet|Betreff|Datum|De|À|Envoyé|Objet|Para|Enviado|Asunto|Fecha"
_PAGE = re.compile(r"^\s*<<<PAGE \d+>>>\s*$")
_QUOTE = re.compile(r"^\s*[>|]")
_ATTRIBUTION = re.compile(r"(?i)(?:\bwrote\b|\bschrieb\b|\ba écrit\b|\bécrit\b|\bescribió\b|\bwrites\b|\bha scritto\b|escribi\S{1,4}|\bÃ©crit|a \S{1,6}crit)[^:\n]*:\s*$")
_ON = re.compile(r"^(?:On|Am|Le|El)\s.*\d")
_SEPARATOR = re.compile(r"(?i)^\s*[-_*=]{2,}\s*(?:original message|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|message d.origine|message transféré|mensaje original|mensaje reenviado|original|forwarded by)\b.*$|^\s*(?:begin forwarded message|anfang der weitergeleiteten nachricht|début du message transféré|inicio del mensaje reenviado)\s*:?\s*$")
_RULE = re.compile(r"^\s*(?:--|—|–|-{2,}|={3,}|_{3,}|\*{3,}|~{3,}|#{3,})\s*$")
# Lines that name a sending device or place.
_DEVICE = re.compile(r"(?i)^\W*(?:sent (?:from|via|with|by) |von (?:meinem|unterwegs)|envoyé (?:de|depuis)|envoy\S{1,9} depuis|enviado desde|gesendet (?:von|mit)|(?:typed|written|dictated) on |get outlook|vom handy|desde mi (?:móvil|m\S{1,6}vil))")
# Words of jobs, and words that firms end with.
_JOB = re.compile(r"(?i)\b(?:partner|associate|adjuster|paralegal|counsel|estimator|attorney|lawyer|solicitor|manager|director|engineer|inspector|secretary|assistant|consultant|rechtsanw\S+|sachbearbeiter\S*|gutachter\S*|schadenregulierer\S*|abogad[oa]|avocate?|perito|expert\S*|gestionnaire|juriste|tasador|of counsel|clerk|president|broker|examiner|sinistres|claims (?:dept|department|handler|counsel))\b")
_FIRM = re.compile(r"(?i)\b(?:inc|llc|llp|ltd|corp|corporation|company|co|group|bank|services|supply|hospital|center|agency|association|insurance|realty|roofing|construction|logistics|transport|manufacturing|restoration|management|consultants|body|gmbh|partners|law)\b\.?(?:,.*)?\s*$")
_PHONE = re.compile(r"(?i)^(?:(?:phone|tel|telefon|tél|direct|mobile|mobil|cell|fax|office|durchwahl|o|m|c|t|f|d|p)\s?[.:]*\s*:?\s*)?[+(]?\d[\d ()/.\-]{6,}\d(?:\s*(?:ext\.?|x)\s*\d+)?(?:\s*[|,·]\s*\S+)?$")
_WEB = re.compile(r"(?i)^(?:www\.|https?://)\S+$|^<?[\w.+-]+@[\w.-]+>?$|^(?:e-?mail|mail|web)\s*:\s*\S+$")
_STREET = re.compile(r"^\d{1,5} .{4,60}\d{5}$|^\d{1,5} [A-Z][\w' ]+ (?:Street|Road|Avenue|Ave|Lane|Ln|Drive|Dr\.|Court|Way|Blvd\.|Terrace|Pl\.)(?:,.*)?$|\b\d{5} [A-Z]\w+$")
_CLOSING = re.compile(r"(?i)^(?:(?:best|kind|warm)?\s*regards|best(?: wishes)?|sincerely(?: yours)?|thanks(?: again)?|thank you|cheers|respectfully|yours (?:truly|sincerely|faithfully)|mit freundlichen gr\S+|viele gr\S+|beste gr\S+|freundliche gr\S+|cordialement|bien (?:à vous|cordialement)|salutations|atentamente|un saludo|saludos(?: cordiales)?|gruß|sinc.res salutations)\s*[,.!]?$")
_NAME_LINE = re.compile(r"^[*_]?(?:[A-ZÀ-Þ][\w.'’À-ÿ-]*,?\s*){1,5}[*_]?$")


# Contact data by itself; Java and Python read it alike.
CONTACT = r"(?i)^(?:www\.|(?:tel|phone|direct|mobile)[.: ]|[+(]?\d[\d ()/.-]{7,}$|[\w.+-]+@[\w.-]+$)"
_CONTACT = re.compile(CONTACT)


def simhash(text: str) -> int:
    """64-bit SimHash of the text's character pairs, as a signed number."""
    s = f" {text} "
    grams = {s[i : i + 2] for i in range(len(s) - 1)}
    h = np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64)
    bits = ((h[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.int32)
    on = (2 * bits.sum(0) > len(grams)).astype(np.uint64)
    return int((on << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64))


def normal(text: str) -> str:
    return re.sub(r"\W+", " ", text.lower()).strip()


def skeleton(text: str) -> str:
    """The words of a text but for names and numbers: those in small letters; all words if that leaves fewer than five."""
    words = re.findall(r"\w+", text)
    small = [w for w in words if w.islower()]
    return " ".join(small) if len(small) >= 5 else normal(text)


def is_email(text: str | None) -> bool:
    """Whether a text opens with header lines, after a page marker if any."""
    if not text:
        return False
    lines = list(itertools.islice((m[0].strip() for m in re.finditer(r"[^\r\n]*\S[^\r\n]*", text) if not _PAGE.match(m[0])), 4))
    return len(lines) > 1 and bool(re.match(r"(?:From|To|Sent|Date|Von|An|De|À|Para|Gesendet|Subject)\s*:", lines[0])) and sum(bool(HEADER.match(x)) for x in lines) >= 2


def _opens_headers(lines: list[str], k: int) -> bool:
    """Whether a block of header lines begins at line k of a body."""
    strip = lambda x: re.sub(r"^[\s>|]*\*?", "", x)
    if not re.match(r"\*?(?:From|Von|De|Sent|Gesendet|Envoyé|Enviado)\s*:\*?\s", strip(lines[k])):
        return False
    near = [strip(x) for x in lines[k + 1 : k + 5] if x.strip()]
    return bool(near) and bool(re.match(rf"\*?(?:{_HEADER_KEYS})\s*:", near[0]))


def _signature_line(s: str) -> bool:
    s = s.strip().strip("*_ ")
    if "|" in s and len(s) < 180 and not s.endswith((".", "?", "!")) and (s.count("|") > 1 or _JOB.search(s) or _FIRM.search(s)) and (_JOB.search(s) or _FIRM.search(s.split("|")[-1]) or re.search(r"\d{3}\W*\d{4}|@", s)):
        return True
    if not s or len(s) > 110:
        return False
    if _PHONE.match(s) or _WEB.match(s) or _STREET.search(s):
        return True
    if len(s) <= 90 and not re.search(r"[.!?;]\s+[A-Z]", re.sub(r"\b(?:Co|Inc|Ltd|Corp|Dr|St|Mr|Ms)\.", "", s)):
        if "|" in s and (_JOB.search(s) or _FIRM.search(s) or re.search(r"\d{3}|@", s)):
            return True
        ends = s[-1] in "!?:;" or (s[-1] == "." and not re.search(r"(?:Inc|Co|Ltd|Corp|Dr|Esq)\.$", s))
        if not ends and len(s.split()) <= 8 and (_JOB.search(s) and len(s.split()) <= 5 or _FIRM.search(s)):
            return True
    return False


def segment(text: str) -> list[tuple[str, str]]:
    """(kind, line) of every line below the headers: 'quoted', 'signature', 'disclaimer', 'own' or 'head'."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    n = len(lines)
    kind = ["own"] * n
    k = 0
    seen = False
    while k < n:
        s = lines[k].strip()
        if _PAGE.match(lines[k]) or not s:
            kind[k] = "head"
            if not s and seen:
                k += 1
                break
        elif HEADER.match(s) or (seen and lines[k][:1] in " \t"):
            kind[k] = "head"
            seen = True
        elif s.startswith("Attachment:"):
            kind[k] = "head"
        else:
            break
        k += 1
    while k < n and (not lines[k].strip() or lines[k].startswith("Attachment:")):
        kind[k] = "head"
        k += 1
    start, rest = k, False
    while k < n:
        s = lines[k]
        t = s.strip()
        if _PAGE.match(s):
            kind[k] = "head"
        elif rest or _QUOTE.match(s):
            kind[k] = "quoted"
        elif _SEPARATOR.match(s) or _opens_headers(lines, k):
            rest = True
            kind[k] = "quoted"
            if k and _RULE.match(lines[k - 1]):
                kind[k - 1] = "quoted"
        elif t and len(t) < 200 and _ATTRIBUTION.search(t + ("" if t.endswith(":") else "")):
            after = [x for x in lines[k + 1 :] if x.strip()]
            marked = bool(after) and bool(_QUOTE.match(after[0]))
            if marked or _ON.match(t) or re.search(r"@|\d", t) or (k and _ON.match(lines[k - 1].strip())):
                kind[k] = "quoted"
                if k and kind[k - 1] == "own" and _ON.match(lines[k - 1].strip()) and len(lines[k - 1]) < 100:
                    kind[k - 1] = "quoted"
                rest = not marked and not any(_QUOTE.match(x) for x in after)
        k += 1
    own = [i for i in range(start, n) if kind[i] == "own"]
    # Paragraphs of the sender's lines; quoted lines between them end a paragraph too.
    paras: list[list[int]] = []
    last = -2
    for i in own:
        if not lines[i].strip():
            last = -2
            continue
        if i != last + 1 or not paras:
            paras.append([])
        paras[-1].append(i)
        last = i
    for j, para in enumerate(paras):
        marks = [bool(_signature_line(lines[i])) for i in para]
        rule = _RULE.match(lines[para[0]])
        if rule and len(para) > 1 and all(len(lines[i].strip()) < 110 for i in para) and (any(marks) or _NAME_LINE.match(lines[para[1]].strip())):
            for i in para:
                kind[i] = "signature"
            continue
        for x, i in enumerate(para):
            if _DEVICE.match(lines[i].strip()) and len(lines[i].strip()) < 90:
                kind[i] = "signature"
        if any(marks):
            x = marks.index(True)
            # The block: from a name line right before its first mark to its last mark, at the paragraph's end.
            lone = x
            if lone and _NAME_LINE.match(lines[para[lone - 1]].strip().strip("*_")) and not _CLOSING.match(lines[para[lone - 1]].strip()):
                lone -= 1
            if lone and _RULE.match(lines[para[lone - 1]]):
                lone -= 1
            # Sentences behind the last mark are none of the block's lines.
            end = len(marks) - marks[::-1].index(True)
            tail = para[lone:] if all(len(lines[i].strip()) < 50 for i in para[end:]) else para[lone:end]
            closing_before = any(_CLOSING.match(lines[i].strip()) for i in para[:x]) or (j and any(_CLOSING.match(lines[i].strip()) for i in paras[j - 1]))
            named = lone < x or closing_before
            strong = any(_PHONE.match(lines[i].strip().strip("*")) or _WEB.match(lines[i].strip()) or (lines[i].count("|") and re.search(r"\d{3}|@|\|.*\|", lines[i])) for i in tail)
            # A list of lines that happen to look alike is no name block without a name or contact data.
            if all(len(lines[i]) < 110 or "|" in lines[i] for i in tail) and (named or strong) and len(tail) <= 9 and sum(marks[lone : lone + len(tail)]) * 2 >= len(tail) - 1:
                for i in tail:
                    kind[i] = "signature"
    for i in own:
        s = lines[i].strip()
        if kind[i] == "own" and re.match(r"(?i)^\(sent from .{2,30}\)$", s):
            kind[i] = "signature"
        if kind[i] == "own" and _RULE.match(lines[i]) and i + 1 < n and kind[i + 1] in ("signature", "disclaimer"):
            kind[i] = kind[i + 1]
    return [(kind[i], lines[i]) for i in range(start, n)]


_SENTENCE = re.compile(r"(?<=[.!?])[”\"»)]*\s+(?=[A-ZÀ-Þ¿¡«“\"„(])")


def units(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, ends, place) of a mail's units in order.

    ends: 1 where a paragraph ends behind the unit.  place: 2 for own text behind the
    sender's sign-off (a closing word, a name block, a rule), 1 for own text in the last
    own paragraph, else 0.
    """
    out: list[tuple[str, str, int, int]] = []
    hold: list[str] = []
    signed = False

    def flush(ends: int) -> None:
        if hold:
            parts = [p for p in _SENTENCE.split(" ".join(hold)) if p.strip()]
            out.extend(("own", p.strip(), 0, 2 * signed) for p in parts)
            hold.clear()
        if ends and out:
            out[-1] = (*out[-1][:2], 1, out[-1][3])

    for kind, line in segment(text):
        s = line.strip()
        if kind == "own" and s:
            if _CLOSING.match(s) or _RULE.match(s):
                flush(0)
                out.append(("own", s, 0, 2 * signed))
                signed = True
            elif len(s) < 60 and (hold == [] or len(hold[-1]) < 40) and not re.search(r"[a-z,;]$", s):
                flush(0)
                out.append(("own", s, 0, 2 * signed))
            else:
                m = re.match(r"[-_*=~#]{2,}\s+(?=\w)", s) if not hold else None
                signed = signed or bool(m)  # a rule in the line itself
                hold.append(s[m.end() :] if m else s)
        else:
            flush(1)
            if kind == "signature":
                signed = True
            if s and kind != "head":
                out.append((kind, s, 0, 0))
    flush(1)
    last = len(out)
    own = [k for k, u in enumerate(out) if u[0] == "own"]
    if own:
        last = own[-1]
        while last > 0 and out[last - 1][0] == "own" and not out[last - 1][2]:
            last -= 1
    return [(k, t, e, p or int(k == "own" and n >= last)) for n, (k, t, e, p) in enumerate(out)]


def _address(line: str) -> str:
    m = re.search(r"[\w.+-]+@[\w.-]+", line)
    return m[0].lower() if m else normal(line)


def _head(text: str) -> tuple[str, str, str]:
    """Sender, subject without reply marks, and date of the headers."""
    got = {"from": "", "subject": "", "date": ""}
    k, seen = "", False
    for line in (m[0] for m in re.finditer(r"[^\n]*\n?", text)):
        if _PAGE.match(line) or not line.strip():
            if seen:
                break
            continue
        if line[:1] in " \t" and seen:  # a header goes on
            if k:
                got[k] += " " + line.strip()
            continue
        if not HEADER.match(line.strip()):
            break
        seen, k = True, ""
        m = re.match(r"(From|Von|De|Subject|Betreff|Objet|Asunto|Date|Sent|Gesendet|Datum|Fecha|Envoyé|Enviado)\s*:\s*(.*)", line.strip())
        if m:
            name = {"Von": "from", "De": "from", "From": "from", "Subject": "subject", "Betreff": "subject", "Objet": "subject", "Asunto": "subject"}.get(m[1], "date")
            if not got[name]:
                k, got[name] = name, m[2].strip()
    subject = re.sub(r"(?i)^(?:(?:re|fw|fwd|aw|wg|tr|rv)\s*:\s*)+", "", got["subject"])
    return _address(got["from"]), normal(subject), got["date"]


def _time(date: str) -> int | None:
    """Seconds since 1970 of a header's date, None if it is none; without a zone it counts as UTC."""
    try:
        d = parsedate_to_datetime(date)
    except (TypeError, ValueError, IndexError):
        return None
    return calendar.timegm(d.utctimetuple())


UNIT = "extraction_id bigint, seq int, kind string, text string, ends int, place int, norm string, fp bigint, bones string, bones_fp bigint, sender string, subject string, sent bigint"


def email_units(extractions: DataFrame) -> DataFrame:
    """The units of every e-mail.  Null, empty and other texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not is_email(text):
                    continue
                sender, subject, date = _head(text)
                sent = _time(date)
                for seq, (kind, s, ends, place) in enumerate(units(text)):
                    norm = normal(s)
                    long = kind == "own" and (len(norm) >= LEAST_CHARS or len(norm) >= 5 and bool(_CONTACT.match(s)))
                    bones = skeleton(s) if kind == "own" and place and len(norm) >= LEAST_CHARS else None
                    rows.append((key, seq, kind, s, ends, place, norm, simhash(norm) if long else None, bones, simhash(bones) if bones else None, sender, subject, sent))
            cols = list(zip(*rows)) or [[]] * 13
            types = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in UNIT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in UNIT.split(", ")])

    mails = extractions.select(F.col("extraction_id").cast("bigint").alias("extraction_id"), "text").where(F.col("text").rlike(r"^\s*(?:<<<PAGE \d+>>>\s*)?(?:From|To|Sent|Date|Von|An|De|À|Para|Gesendet|Subject)\s*:"))
    return spread(mails).mapInArrow(run, UNIT)


def _keys(fp, by: list[str]):
    """The table keys of a fingerprint column within a group."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*[F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed(m))), *by) for k, m in enumerate(MASKS)])


def _near(units_: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """by, norm, k_norm: each distinct text of units_ with every known one that shares a table key and is really near.

    Exact copies are one row on either side, so a text that many mails hold costs no more
    than any other.  The tables hold numbers only: keys, fingerprints and texts' ids (a
    hash; what it confuses is told apart when the texts join the candidates).  Hot keys
    are left to the join's handling of skew.
    """
    cols = [*by, "norm", "fp"]
    one = lambda x: x.select(cols).distinct().withColumn("uid", F.xxhash64(*by, "norm"))
    a, b = one(units_), one(known)
    keyed = lambda x: x.select("uid", "fp", F.explode(_keys(F.col("fp"), by)).alias("key"))
    k = keyed(b).select("key", F.col("uid").alias("k_uid"), F.col("fp").alias("k_fp"))
    cand = keyed(a).join(k, "key").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("k_fp"))) <= FAR).select("uid", "k_uid").distinct()
    text = b.select(*[F.col(c).alias("k_" + c) for c in by], F.col("uid").alias("k_uid"), F.col("norm").alias("k_norm"))
    pairs = cand.join(a.drop("fp"), "uid").join(text, "k_uid").drop("uid", "k_uid")
    for c in by:
        pairs = pairs.where(F.col(c) == F.col("k_" + c)).drop("k_" + c)
    # The edit distance is computed in the engine, cut off where it is too large anyway.
    most = F.greatest(F.lit(2), (F.length("norm") * 0.15).cast("int"))
    pairs = pairs.where(F.abs(F.length("norm") - F.length("k_norm")) <= most)
    return pairs.where((F.col("norm") == F.col("k_norm")) | (F.levenshtein(F.col("norm"), F.col("k_norm")) <= most)).select(*by, "norm", "k_norm")


def _first_two(known: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, seen, k_sender: the earliest place of each text, and the earliest by another sender than that one.

    Whoever asks for somebody else's earlier place finds it in these two if there is one.
    """
    first = known.groupBy(by).agg(F.min(F.struct(F.col(order).alias("seen"), F.col("sender").alias("k_sender"))).alias("k"))
    other = known.join(first, by).where("sender <> k.k_sender").groupBy(by).agg(F.min(F.struct(F.col(order).alias("seen"), F.col("sender").alias("k_sender"))).alias("k"))
    return first.unionByName(other).select(*by, "k.seen", "k.k_sender")


def judged(extractions: DataFrame) -> DataFrame:
    """The units with their final kind ('quoted', 'signature', 'disclaimer', 'own')."""
    u = staged(email_units(extractions))
    own = u.where(f"kind = 'own' and fp is not null and length(norm) >= {LEAST_CHARS}")
    # What mails by two senders or more have behind their sign-off, in this or a near form, is a notice; where
    # nobody has signed off, it is one at the mail's end.
    ends = u.where("bones is not null and sender <> ''").select("extraction_id", "seq", "place", "sender", F.col("bones").alias("norm"), F.col("bones_fp").alias("fp"))
    behind = ends.where("place = 2")
    alike = staged(_near(ends, behind, []))
    said = _first_two(behind.withColumn("place", F.col("extraction_id")), ["norm"], "place")
    by = alike.join(said.withColumnRenamed("norm", "k_norm"), "k_norm").groupBy("norm").agg(F.min("k_sender").alias("one"), F.max("k_sender").alias("two"))
    as_notice = ends.join(by, "norm").where("if(place = 2, one <> two, one <> two or one <> sender)").select("extraction_id", "seq").distinct().withColumn("notice", F.lit(True))
    # Sentences of the same exchange that somebody else wrote in an earlier mail.
    named = own.where("subject <> '' and sender <> ''")
    # By date, extraction_id for ties; where either mail has no date, by extraction_id.
    place = lambda c, sent: c.withColumn("place", F.struct(sent.alias("sent"), "extraction_id"))
    none = F.lit(0).cast("bigint")
    known = place(named.where("sent is not null"), F.col("sent")).withColumn("way", F.lit("dated")).unionByName(place(named.where("sent is null"), none).withColumn("way", F.lit("undated"))).unionByName(place(named, none).withColumn("way", F.lit("any")))
    places = _first_two(known, ["subject", "norm", "way"], "place").withColumnRenamed("norm", "k_norm")
    ways = F.when(F.col("sent").isNull(), F.array(F.lit("any"))).otherwise(F.array(F.lit("dated"), F.lit("undated")))
    asked = named.withColumn("way", F.explode(ways))
    asked = place(asked, F.when(F.col("way") == "dated", F.col("sent")).otherwise(none))
    pairs = _near(named, named, ["subject"])
    earlier = pairs.join(places, ["subject", "k_norm"])
    inherited = asked.join(earlier, ["subject", "norm", "way"]).where("k_sender <> sender and seen < place").select("extraction_id", "seq", "norm").distinct()
    # Two inherited sentences make a quotation; a single one does if no other exchange has it, else it may be chance.
    exchanges = named.groupBy("norm").agg(F.countDistinct("subject").alias("exchanges"))
    inherited = inherited.withColumn("times", F.count("*").over(Window.partitionBy("extraction_id"))).join(exchanges, "norm").where("times >= 2 or exchanges = 1")
    inherited = inherited.select("extraction_id", "seq").withColumn("inherited", F.lit(True))
    # Lines of contact data that a sender ends several mails of different text with, near-matches included.
    tail = u.where("kind = 'own' and fp is not null and sender <> '' and length(norm) between 5 and 80").where(F.col("text").rlike(CONTACT))
    mails = tail.select("sender", F.col("norm").alias("k_norm"), "extraction_id", "subject").distinct()
    boiler = _near(tail, tail, ["sender"]).join(mails, ["sender", "k_norm"]).groupBy("sender", "norm").agg(F.countDistinct("extraction_id", "subject").alias("mails"))
    boiler = boiler.where("mails >= 2").select("sender", "norm", F.lit(True).alias("boiler"))
    x = u.join(as_notice, ["extraction_id", "seq"], "left").join(inherited, ["extraction_id", "seq"], "left").join(boiler, ["sender", "norm"], "left")
    contact = F.col("text").rlike(CONTACT)
    kind = F.when(F.col("kind") != "own", F.col("kind")).when(F.col("notice"), "disclaimer").when(F.col("inherited"), "quoted").when(F.col("boiler") & contact, "signature").otherwise("own")
    return x.withColumn("kind", kind).select("extraction_id", "seq", "kind", "text", "ends")


def blocks(extractions: DataFrame) -> DataFrame:
    """extraction_id, block: each kind of block a mail has beside its sender's new text."""
    return judged(extractions).where("kind <> 'own'").select("extraction_id", F.col("kind").alias("block")).distinct()


def new_text(extractions: DataFrame) -> DataFrame:
    """extraction_id, new_text, removed: every e-mail's new text ('' if it has none) and the kinds removed, sorted."""
    j = judged(extractions)
    own = F.sort_array(F.collect_list(F.when(F.col("kind") == "own", F.struct("seq", "text", "ends"))))
    text = F.aggregate(own, F.lit(""), lambda a, x: F.concat(a, x["text"], F.when(x["ends"] == 1, "\n\n").otherwise(" ")))
    return j.groupBy("extraction_id").agg(F.trim(F.regexp_replace(text, r"\s+$", "")).alias("new_text"), F.array_sort(F.collect_set(F.when(F.col("kind") != "own", F.col("kind")))).alias("removed"))
