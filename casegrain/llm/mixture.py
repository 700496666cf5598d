"""Mixing sources to target shares of a size in tokens.

A document's place in its source's random order is a hash of its id.  The order is
cut into blocks of about block_tokens.

1. Each source gets a quota of tokens, its share of the mixture's size, at most
   max_repeats times what it has.  Full epochs take every block, the rest takes a
   prefix of the blocks, the last of them cut within.  The prefix's end is found by sums
   over ranges of blocks, at most RANGES of them at a time.
2. The vector of the sources' block counts is split among the output shards by a
   tree: each node draws, without replacement, the left half's blocks from a
   multivariate hypergeometric distribution; the right half gets the others.  So
   each shard gets a random composition and every block goes to one shard.
3. The blocks of a source stand in an order that a keyed permutation of their numbers
   gives; a block walks down the tree by its place in it.  Nodes draw from generators of
   their own, so any executor draws the same, and no table of blocks or shards exists.
   Within a shard, documents are shuffled by a hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..io import staged
from .tokens import token_counts

#: Sources that a mixture may have, and ranges of blocks whose sums come to the driver at a time.
MAX_SOURCES, RANGES = 1000, 4096
BLOCK_TOKENS, SHARD_TOKENS = 4096, 1 << 17


def left_of(n: np.ndarray, lo: int, hi: int, seed: int) -> np.ndarray:
    """Blocks of each source that the left half of the shards lo to hi gets, of n that the node has."""
    total = int(n.sum())
    if not total:
        return n
    draw = total * ((lo + hi) // 2 - lo) // (hi - lo)
    return np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(n, draw, method="marginals")


def split_counts(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) counts of blocks; the columns sum to counts exactly."""
    out = np.zeros((shards, len(counts)), np.int64)
    todo = [(0, shards, counts.astype(np.int64))]
    while todo:
        lo, hi, n = todo.pop()
        if hi - lo == 1:
            out[lo] = n
            continue
        left = left_of(n, lo, hi, seed)
        mid = (lo + hi) // 2
        todo += [(lo, mid, left), (mid, hi, n - left)]
    return out


class Tree:
    """The splitting tree; its nodes are drawn when they are asked for."""

    def __init__(self, counts: np.ndarray, shards: int, seed: int):
        self.counts, self.shards = counts.astype(np.int64), shards
        self.left = lru_cache(maxsize=1 << 16)(lambda lo, hi, n: left_of(np.array(n), lo, hi, seed))

    def shard_of(self, source: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The shard of each block, given its source and its place in the source's order."""
        out = np.zeros(len(place), np.int64)
        todo = [(0, self.shards, self.counts, np.arange(len(place)), place.astype(np.int64))]
        while todo:
            lo, hi, n, at, p = todo.pop()
            if not len(at):
                continue
            if hi - lo == 1:
                out[at] = lo
                continue
            left, mid = self.left(lo, hi, tuple(n.tolist())), (lo + hi) // 2
            right = p >= left[source[at]]
            todo += [(lo, mid, left, at[~right], p[~right]), (mid, hi, n - left, at[right], p[right] - left[source[at[right]]])]
        return out


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0 to n - 1 at x, element by element (a Feistel network that walks until it is back in range)."""
    x, n, key = x.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = ((np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.uint64) + np.uint64(1)) // np.uint64(2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        v, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        a, b = v >> h, v & m
        with np.errstate(over="ignore"):
            for r in range(4):
                z = (b + k + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                a, b = b, a ^ ((z ^ (z >> np.uint64(29))) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def planned_size(have: dict[str, int], targets: dict[str, tuple[float, int]]) -> float:
    """The largest size at which every source that has documents reaches its share."""
    return min((cap * have[s] / share for s, (share, cap) in targets.items() if share > 0 and have.get(s, 0) > 0 and cap > 0), default=0.0)


class Mixture:
    """A planned mixture; rows() and shares() are its two results.

    docs: doc_id, text, source.  Null or unlisted sources and documents without
    tokens take no part.  targets: source, target_share, max_repeats; null sources,
    null or not positive shares ask for nothing, a null max_repeats is 1.
    size: tokens of the mixture, by default the largest at which every source that
    has documents reaches its share.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, size: float | None = None, seed: int = 42, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS):
        self.spark, self.seed = docs.sparkSession, seed
        rows = targets.select("source", F.col("target_share").cast("double"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("cap")).where("source is not null").limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        self.targets = {r[0]: (max(0.0, r[1] or 0.0), max(0, r[2])) for r in rows}
        listed = F.broadcast(self.spark.createDataFrame([(s,) for s in self.targets], "source string"))
        sized = token_counts(docs.select("doc_id", "source", "text").join(listed, "source", "left_semi"), ["doc_id", "source"])
        self.sized = staged(sized.where("tokens > 0").withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52))))
        sums = {r["source"]: (r["n"], r["t"]) for r in self.sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
        self.have = {s: sums.get(s, (0, 0)) for s in self.targets}
        tokens = {s: t for s, (_, t) in self.have.items()}
        self.size = planned_size(tokens, self.targets) if size is None else float(size)
        self.blocks = {s: max(1, math.ceil(t / block_tokens)) for s, t in tokens.items()}
        self.shards = max(1, math.ceil(self.size / shard_tokens))
        self._plan(tokens)

    def _of(self, values: dict) -> Column:
        """The value of a row's source."""
        return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("source"))

    def _blocked(self) -> DataFrame:
        if not self.blocks:
            return self.sized.withColumn("block", F.lit(0).cast("bigint"))
        n = self._of(self.blocks).cast("bigint")
        return self.sized.withColumn("block", F.least(F.floor(F.col("u") / float(1 << 52) * n).cast("bigint"), n - 1))

    def _plan(self, tokens: dict[str, int]) -> None:
        self.full, self.cut, rest = {}, {}, {}
        for s, (share, cap) in self.targets.items():
            if not tokens[s] or not cap:
                continue
            quota = min(share * self.size, cap * tokens[s])
            self.full[s] = min(cap, int(quota // tokens[s]))
            if self.full[s] < cap and quota > self.full[s] * tokens[s]:
                rest[s] = quota - self.full[s] * tokens[s]
        # The block in which a source's rest ends: [from, to) and the tokens before it, narrowed range by range.
        where = {s: (0, self.blocks[s], 0) for s in rest}
        while open_ := {s: x for s, x in where.items() if x[1] - x[0] > 1}:
            lo, size = ({s: x[k] for s, x in open_.items()} for k in (0, 1))
            step = {s: -(-(size[s] - lo[s]) // RANGES) for s in open_}
            b = self._blocked().where(F.col("source").isin(list(open_))).where((F.col("block") >= self._of(lo)) & (F.col("block") < self._of(size)))
            sums: dict[str, dict[int, int]] = {s: {} for s in open_}
            for r in b.withColumn("part", F.floor((F.col("block") - self._of(lo)) / self._of(step)).cast("bigint")).groupBy("source", "part").agg(F.sum("tokens").alias("t")).collect():
                sums[r["source"]][r["part"]] = r["t"]
            for s, (a, e, before) in open_.items():
                k = 0
                while a + (k + 1) * step[s] < e and before + sums[s].get(k, 0) <= rest[s]:
                    before += sums[s].get(k, 0)
                    k += 1
                where[s] = (a + k * step[s], min(e, a + (k + 1) * step[s]), before)
        self.cut = {s: (a, rest[s] - before) for s, (a, _, before) in where.items()}
        self.names = sorted(self.targets)
        counts = [self.full.get(s, 0) * self.blocks[s] + (self.cut[s][0] + 1 if s in self.cut else 0) for s in self.names]
        self.tree = (np.array(counts, np.int64), self.shards, self.seed)

    def _drawn(self) -> DataFrame:
        """source, doc_id, tokens, copy, shard: every drawn document, unordered."""
        names, blocks, full, cut = self.names, self.blocks, self.full, self.cut
        tree, seed = self.tree, self.seed
        blocked = self._blocked().where(F.col("source").isin([s for s in names if full.get(s) or s in cut]))
        # Documents of the cut blocks, one block for each source, that its rest has room for.
        ends = self._of({s: c[0] for s, c in cut.items()}) if cut else F.lit(None).cast("bigint")
        w = Window.partitionBy("source").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = blocked.where(F.col("block") == ends).withColumn("upto", F.sum("tokens").over(w))
        over = inside.where(F.col("upto") - F.col("tokens") / 2 > self._of({s: float(c[1]) for s, c in cut.items()})).select("source", "doc_id", F.lit(True).alias("over")) if cut else None
        x = blocked.join(over, ["source", "doc_id"], "left") if cut else blocked.withColumn("over", F.lit(None).cast("boolean"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t, number = Tree(*tree), {s: k for k, s in enumerate(names)}
            total = t.counts
            for b in batches:
                source = np.array([number[s] for s in b.column(0).to_pylist()], np.int64)
                block, over_ = b.column(3).to_numpy(), np.array([bool(v) for v in b.column(4).to_pylist()], bool)
                per = np.array([blocks[s] for s in names], np.int64)[source]
                all_of = np.array([full.get(s, 0) for s in names], np.int64)[source]
                end = np.array([cut[s][0] if s in cut else -1 for s in names], np.int64)[source]
                times = all_of + ((block < end) | ((block == end) & ~over_))
                at = np.repeat(np.arange(len(block)), times)
                copy = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                s = source[at]
                place = permuted(copy * per[at] + block[at], total[s], s * 7919 + seed)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), b.column(2).take(pa.array(at)), pa.array(copy.astype(np.int32)), pa.array(t.shard_of(s, place))], names=["source", "doc_id", "tokens", "copy", "shard"])

        kind = dict(x.dtypes)
        return x.select("source", "doc_id", "tokens", "block", "over").mapInArrow(run, f"source string, doc_id {kind['doc_id']}, tokens {kind['tokens']}, copy int, shard bigint")

    def rows(self) -> DataFrame:
        """shard, position, doc_id, source, copy, tokens: the mixture in its order, copies counted from 0."""
        w = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(self.seed + 1), "doc_id", "copy"), "doc_id", "copy")
        return self._drawn().withColumn("position", F.row_number().over(w)).select("shard", "position", "doc_id", "source", "copy", "tokens")

    def shares(self) -> DataFrame:
        """One row for each target with the share really reached, 0 where a source has nothing."""
        got = self._drawn().groupBy("source").agg(F.sum("tokens").alias("got"), F.count("*").alias("copies"))
        t = self.spark.createDataFrame([(s, share, cap, self.have[s][0], self.have[s][1], share * self.size) for s, (share, cap) in self.targets.items()], "source string, target_share double, max_repeats int, documents bigint, available_tokens bigint, wanted double")
        total = F.sum("got").over(Window.partitionBy())
        x = t.join(F.broadcast(got), "source", "left").fillna(0, ["got", "copies"])
        return x.select(
            "source", "target_share", "max_repeats", "documents", "available_tokens", F.col("copies").cast("bigint").alias("drawn_documents"), F.col("got").cast("bigint").alias("drawn_tokens"),
            F.round(F.when(total > 0, F.col("got") / total).otherwise(0.0), 6).alias("actual_share"),
            (F.col("available_tokens") * F.col("max_repeats") >= F.floor("wanted")).alias("in_reach"),
        )
