"""Points that carry into relations and recurrences, and the record of a document.

At each hit the strongest floats of a document are held against its strongest relations
and recurrences; a float whose value stands in one of them hits a joint point.  Which
ones are strongest changes from hit to hit, so this is a sequence by nature.  It runs
document by document on Arrow batches: a document's hits are few (its words are capped
in the hits) and come as one array.  Everything else follows in closed form (points).
"""

from __future__ import annotations

import hashlib
import math
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import RECURRING, RELATED
from .points import LEAST_JOINT, LEAST_POINT, LEAST_POINTS

_WITH: dict[str, set[str]] = {}
for _a, _b in RELATED:
    _WITH.setdefault(_a, set()).add(_b)
    _WITH.setdefault(_b, set()).add(_a)
_AGAIN = frozenset(RECURRING)
STRONGEST = 24


class _Layer:
    """Points of one store by number; the strongest ones stand in a sorted list that is kept up with each hit."""

    def __init__(self, least: float):
        self.least, self.at, self.keys, self.hits, self.pressure, self.order = least, {}, [], [], [], []

    def hit(self, key, weight: float) -> int:
        k = self.at.get(key)
        if k is None:
            k = self.at[key] = len(self.keys)
            self.keys.append(key)
            self.hits.append(0)
            self.pressure.append(0.0)
        elif self.pressure[k] >= self.least:
            self.order.remove((-self.pressure[k], k))
        self.hits[k] += 1
        self.pressure[k] = weight * math.log1p(self.hits[k])
        if self.pressure[k] >= self.least:
            insort(self.order, (-self.pressure[k], k))
        return k

    def strongest(self) -> list[int]:
        return [k for _, k in self.order[:STRONGEST]]


class Reading:
    """The state of a document while its hits (kind, value, weight) are read.

    floats: (kind, value); relations and recurrences: their text; float_mix and
    float_stir: the text of the float in the joint point.
    """

    def __init__(self) -> None:
        self.floats, self.relations, self.recurrences = _Layer(LEAST_POINT), _Layer(LEAST_JOINT), _Layer(LEAST_JOINT)
        self.float_mix, self.float_stir = _Layer(math.inf), _Layer(math.inf)
        self._texts: list[str] = []
        #: By layer and joint point: floats looked at so far, and those whose text stands in it.
        self._inside: tuple[list[list], list[list]] = ([], [])

    def read(self, hits: list[tuple[str, str, float]]) -> None:
        for kind, value, weight in hits:
            self._point(kind, value, weight)
            self._carry()

    def _point(self, kind: str, value: str, weight: float) -> None:
        k = self.floats.hit((kind, value), weight)
        if k == len(self._texts):
            self._texts.append(" ".join(value.lower().split()))
        own, p = self._texts[k], self.floats.pressure[k]
        if kind in _AGAIN and self.floats.hits[k] >= 2:
            self.recurrences.hit(f"{kind}={own}", min(1.75, 0.5 + p / 2))
        others = _WITH.get(kind)
        if not others or p < LEAST_POINT:
            return
        for j, (their, _) in enumerate(self.floats.keys):
            if j != k and their in others and self.floats.pressure[j] >= LEAST_POINT:
                sides = sorted(((kind, own), (their, self._texts[j])))
                self.relations.hit("|".join(f"{a}={b}" for a, b in sides), min(1.75, (p + self.floats.pressure[j]) / 2))

    def _carry(self) -> None:
        rank = None
        for layer, into, inside, mark in ((self.relations, self.float_mix, self._inside[0], "M"), (self.recurrences, self.float_stir, self._inside[1], "S")):
            joint = layer.strongest()
            if not joint:
                continue
            rank = rank or {f: n for n, f in enumerate(self.floats.strongest())}
            while len(inside) < len(layer.keys):
                inside.append([0, []])
            meet = []
            for n, j in enumerate(joint):
                seen = inside[j]
                text = layer.keys[j]
                for f in range(seen[0], len(self._texts)):
                    own = self._texts[f]
                    # A float is no relation to its own recurrence.
                    if len(own) >= 3 and own in text and not (mark == "S" and text == f"{self.floats.keys[f][0]}={own}"):
                        seen[1].append(f)
                seen[0] = len(self._texts)
                meet += [(rank[f], n, f, j) for f in seen[1] if f in rank]
            for _, _, f, j in sorted(meet):
                into.hit(f"F[{self.floats.keys[f][0]}:{self._texts[f]}]<->{mark}[{layer.keys[j]}]", min(2.0, (self.floats.pressure[f] + layer.pressure[j]) / 2))

    def points(self) -> list[tuple[str, str, str, int, float]]:
        """(layer, kind, value, hits, pressure) of every point: what joins a relation is a recurrence, and the other way round."""
        out = [("FLOAT", *key, n, p) for key, n, p in zip(self.floats.keys, self.floats.hits, self.floats.pressure)]
        for layer, kind, store in (("MIX", "REL", self.relations), ("MIX", "FLOAT_STIR", self.float_stir), ("STIR", "RECURRENCE", self.recurrences), ("STIR", "FLOAT_MIX", self.float_mix)):
            out += [(layer, kind, key, n, p) for key, n, p in zip(store.keys, store.hits, store.pressure)]
        return out


def process(hits: list[tuple[str, str, float]], stale: bool = False) -> tuple[Reading, int]:
    """The reading of a document, and how often it was read: twice if it is stale or has few points."""
    r = Reading()
    r.read(hits)
    if stale or len(r.points()) < LEAST_POINTS:
        r.read(hits)
        return r, 2
    return r, 1


def clarity(points: list[tuple[str, str, str, int, float]]) -> float:
    """0.45 coverage + 0.35 relation + 0.20 concentration in the twelve strongest points; never a status."""
    floats = sum(p[0] == "FLOAT" for p in points)
    weights = sorted((p[4] for p in points), reverse=True)
    total = sum(weights)
    cover = min(1.0, math.log1p(max(1, len(points))) / math.log(81.0))
    return 0.45 * cover + 0.35 * min(1.0, (len(points) - floats) / max(1.0, floats * 0.75)) + (0.20 * sum(weights[:12]) / total if total else 0.0)


def signature(points: list[tuple[str, str, str, int, float]]) -> str:
    """BLAKE2b (16 bytes) over all points in order of layer, kind and value."""
    d = hashlib.blake2b(digest_size=16)
    for layer in ("FLOAT", "MIX", "STIR"):
        for p in sorted(x[1:] for x in points if x[0] == layer):
            d.update(f"{layer[0]}\0{p[0]}\0{p[1]}\0{p[2]}\0{p[3]:.8f}\n".encode("utf-8", "replace"))
    return d.hexdigest()


def _by_document(hits: DataFrame, make, schema: str, stale: DataFrame | None) -> DataFrame:
    """make(doc, reading, pass) of each document's hits, which come as one array."""
    rows = hits.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "value", "weight"))).alias("h"))
    rows = rows.withColumn("stale", F.lit(False)) if stale is None else rows.join(stale.select("doc").distinct().withColumn("stale", F.lit(True)), "doc", "left").fillna(False, ["stale"])
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, h, old in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                out += make(doc, *process([(x["kind"], x["value"], x["weight"]) for x in h], old))
            cols = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return rows.select("doc", "h", "stale").mapInArrow(run, schema)


def all_points(hits: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """doc, layer, kind, value, hits, pressure, place: every point of every layer from the hits of one reading."""

    def make(doc, r, _):
        return [(doc, *p[:4], round(p[4], 8), k) for k, p in enumerate(r.points())]

    return _by_document(hits, make, "doc bigint, layer string, kind string, value string, hits bigint, pressure double, place int", stale)


def document_records(hits: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """doc, pass, float_points, mix_points, stir_points, total_pressure, clarity, pattern_signature from the hits of one reading."""

    def make(doc, r, n):
        p = r.points()
        count = [sum(x[0] == layer for x in p) for layer in ("FLOAT", "MIX", "STIR")]
        return [(doc, n, *count, round(sum(x[4] for x in p), 8), round(clarity(p), 8), signature(p))]

    return _by_document(hits, make, "doc bigint, pass int, float_points int, mix_points int, stir_points int, total_pressure double, clarity double, pattern_signature string", stale)


def cross_carry(hits: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """doc, layer ('float_mix' or 'float_stir'), value, hits, pressure of the joint points, from the hits of one reading."""
    return all_points(hits, stale).where("kind in ('FLOAT_MIX', 'FLOAT_STIR')").select("doc", F.lower("kind").alias("layer"), "value", "hits", "pressure")
