"""SimHash near-duplicates: fingerprints of word shingles, linked by BK-trees over buckets of fingerprints.

Two 64-bit fingerprints that differ in at most two bits agree on two of four 16-bit blocks, so a distinct fingerprint
goes to six buckets, and one BK-tree per bucket (children keyed by the Hamming distance to the parent) finds its
links by following only the edges within the radius. A bucket of more than ``limit`` fingerprints is cut again: of
four 8-bit blocks of the other half two agree too. Such a tree holds at most 2^16 fingerprints, so no tree grows
with the data. Each tree reports a spanning forest of its links, never all pairs; copies of a text share one
fingerprint and are never compared. Components of the links carry the smallest document id.

Defined results: null and empty texts have fingerprint zero and link like any other. Rows without an id keep their
fingerprint and take the component of their fingerprint; it is null if no member has an id. Repeated rows stay. Texts
of any length are read whole. An empty table gives no rows; further columns, whatever their names, take no part.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import broadcast_if_small, join_split, settle
from .components import components

C = F.col
RADIUS = 2


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a UTF-8 text: bits set in over half of the XXH64 of its word shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return int(np.uint64(xxh64_intdigest(joined, seed)).view(np.int64))
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    stop = (start + size)[shingle - 1:]
    h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(start.tolist(), stop.tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row."""
    src = docs.select("doc_id", "text")

    def apply(batches):
        for b in batches:
            fp = [fingerprint(t, shingle, seed) for t in b.column(1).fill_null("").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return src.mapInArrow(apply, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


class BKTree:
    """Integers under Hamming distance; a node is [value, {distance: child}]."""

    def __init__(self):
        self.root = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ x).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = [x, {}]
                return
            node = child

    def within(self, x: int, radius: int) -> list[int]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            value, children = stack.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(value)
            for k in range(d - radius, d + radius + 1):
                if k in children:
                    stack.append(children[k])
        return found


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct values, found with a BK-tree."""
    mask, tree, head, out = (1 << 64) - 1, BKTree(), {}, []

    def top(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for v in values:
        u = v & mask
        head[u] = u
        for w in tree.within(u, radius):
            a, b = top(u), top(w)
            if a != b:
                head[a] = b
                out.append((v, w - (1 << 64) if w >> 63 else w))
        tree.add(u)
    return out


def _blocks(col, at: int, width: int, n: int) -> list:
    return [F.shiftrightunsigned(col, at + width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(n)]


def _pairs(blocks: list, width: int):
    """Array of (which two blocks, their values)."""
    return F.array(*(F.struct(F.lit(t).alias("t"), (F.shiftleft(blocks[i], width) + blocks[j]).alias("v"))
                     for t, (i, j) in enumerate(combinations(range(4), 2))))


def links(fps: DataFrame, limit: int = 2048) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that span the components of radius two."""
    keyed = fps.select("fp", F.explode(_pairs(_blocks(C("fp"), 0, 16, 4), 16)).alias("k")).select("fp", "k.t", "k.v")
    keyed = settle(keyed, "simhash-keys")
    hot = settle(keyed.groupBy("t", "v").count().filter(C("count") > limit).select("t", "v", F.lit(True).alias("hot")), "simhash-hot")
    marked = keyed.join(broadcast_if_small(hot), ["t", "v"], "left")
    plain = marked.filter(C("hot").isNull()).groupBy("t", "v").agg(F.collect_list("fp").alias("fps"))
    other = F.lit(None).cast("long")  # the 32 bits outside the two agreed blocks
    for t, (i, j) in enumerate(combinations(range(4), 2)):
        rest = [b for k, b in enumerate(_blocks(C("fp"), 0, 16, 4)) if k not in (i, j)]
        other = F.when(C("t") == t, F.shiftleft(rest[1], 16) + rest[0]).otherwise(other)
    cut = (marked.filter(C("hot")).withColumn("_rest", other)
           .select("fp", "t", "v", F.explode(_pairs(_blocks(C("_rest"), 0, 8, 4), 8)).alias("k"))
           .groupBy("t", "v", "k.t", "k.v").agg(F.collect_list("fp").alias("fps")))
    trees = plain.select("fps").unionByName(cut.select("fps")).filter(F.size("fps") > 1)

    def apply(batches):
        for b in batches:
            found = [e for x in b.column(0).to_pylist() for e in forest(sorted(x))]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())],
                                             names=["u", "v"])

    return trees.mapInArrow(apply, "u long, v long")


def cluster(docs: DataFrame, *, shingle: int = 3, seed: int = 42, limit: int = 2048) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    marks = settle(fingerprints(docs, shingle, seed), "simhash-fp")
    classes = settle(marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("count")), "simhash-classes")
    parts = settle(components(links(classes.select("fp"), limit)), "simhash-parts")
    linked = parts.join(classes, C("node") == C("fp")).select("fp", "root", "first")
    best = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    joined = linked.join(best, "root").select("fp", C("component_id").alias("_linked"))
    ids = classes.join(joined, "fp", "left").select(C("fp").alias("_fp"), F.coalesce("_linked", "first").alias("component_id"), "count")
    return join_split(marks, ids, "fp", "_fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
