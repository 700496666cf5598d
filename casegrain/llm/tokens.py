"""Encoding of a corpus with a public byte-level tokenizer, by monoid tree reduction.

A text is cut into leaves, each leaf is encoded by itself, and neighbours are
joined pairwise up a tree.  The encoding of a string is a monoid under `join`:

    join(encode(a), encode(b)) == encode(a + b)

A join re-encodes only a window around the seam.  The window grows on both sides
until it ends at a character boundary that no pre-token can cross whatever stands
beside it; what lies outside is then provably unchanged:

* a pre-token is one optional blank and a run of letters, of digits or of other
  marks, a contraction (apostrophe, letters), or a run of white space.  None holds
  a non-blank followed by a blank, or a letter followed by a mark;
* the only look-ahead is that of white space for what follows it, and the
  characters before such a boundary are no white space.

Decoding concatenates the tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..io import spread

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's public pre-token pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a leaf; texts up to it are one leaf.
LEAF = 2048


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS):
    """The tokenizer, read once for each worker process."""
    import tiktoken

    with open(f"{folder}/{VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _seam(text: str, p: int) -> bool:
    """Whether no pre-token can hold both text[p - 1] and text[p]."""
    a, b = text[p - 1], text[p]
    if b in " \n":
        return not a.isspace()
    return a.isalpha() and unicodedata.category(b)[0] in "PS"


def _stable(text: str, cut: int, lo: int, hi: int, step: int) -> int:
    """The nearest such boundary left (step -1) or right (1) of a cut, else the end of the half."""
    width = 32
    p = cut + step
    while lo < p < hi:
        stop = max(lo, cut - width) if step < 0 else min(hi, cut + width)
        while p != stop:
            if _seam(text, p):
                return p
            p += step
        width *= 2
    return lo if step < 0 else hi


def join(enc, text: str, s: int, m: int, e: int, left: list[int], right: list[int]) -> list[int]:
    """The ids of text[s:e] from those of text[s:m] and of text[m:e]."""
    p = _stable(text, m, s, m, -1)
    q = _stable(text, m, m, e, 1)
    gone = len(enc.encode_ordinary(text[p:m]))
    skip = len(enc.encode_ordinary(text[m:q]))
    return left[: len(left) - gone] + enc.encode_ordinary(text[p:q]) + right[skip:]


def encode_text(enc, text: str | None, leaf: int = LEAF) -> list[int]:
    """Ids of a whole text of any length; none for null and for the empty text."""
    if not text:
        return []
    nodes = [(s, min(s + leaf, len(text))) for s in range(0, len(text), leaf)]
    level = [(s, e, enc.encode_ordinary(text[s:e])) for s, e in nodes]
    while len(level) > 1:
        up = []
        for k in range(0, len(level) - 1, 2):
            (s, m, a), (_, e, b) = level[k], level[k + 1]
            up.append((s, e, join(enc, text, s, m, e, a, b)))
        if len(level) % 2:
            up.append(level[-1])
        level = up
    return level[0][2]


def decode_ids(enc, ids: list[int], leaf: int = 512) -> str:
    """The text of ids: bytes are concatenated up the tree and decoded once."""
    parts = [enc.decode_bytes(ids[k : k + leaf]) for k in range(0, len(ids), leaf)]
    while len(parts) > 1:
        parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
    return parts[0].decode("utf-8") if parts else ""


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, leaf: int = LEAF) -> DataFrame:
    """key, ids: one row for each row of docs, in one pass without a shuffle.

    Null and empty texts have an empty list.  Strings of special tokens are
    ordinary text.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for b in batches:
            ids = [encode_text(enc, t, leaf) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """The columns of keep and tokens, the number of ids of the text."""
    rows = docs.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for b in batches:
            n = [len(encode_text(enc, t)) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    return spread(rows).mapInArrow(run, f"{schema}, tokens bigint")


def roundtrip(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """key, tokens, exact: whether decoding the tree's ids gives the text again (null counts as the empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for b in batches:
            got = [(encode_text(enc, t), t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(i) for i, _ in got], pa.int32()), pa.array([decode_ids(enc, i) == t for i, t in got])],
                names=[key, "tokens", "exact"],
            )

    return spread(docs.select(F.col(key), F.col(text))).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, tokens int, exact boolean")
