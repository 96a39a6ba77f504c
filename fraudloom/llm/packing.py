"""Packing: length buckets whose bounds minimise padding, and token-budget batches inside each bucket.

A document of more than ``max_len`` tokens is laid out as pieces of ``max_len`` and a rest, so lengths lie in
1..max_len and the global histogram has at most ``max_len`` rows: all that reaches the driver. Dynamic programming over
it finds the bounds of ``buckets`` buckets with the least padding in total. Inside a bucket pieces are numbered
through hash shards of bounded size (a count per shard, a running sum over the counts, a number within the shard), so
no bucket is sorted in one task, and every ``budget // bound`` pieces make a batch.

Defined results: tokens are words (runs without ASCII white space) and one end, so null and empty texts are one piece
of one token. Rows without an id, and any number of rows with one id, are spread over the shards by their place. Repeated rows are packed each; the order among equal rows is free
but the rows are alike. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import settle

C = F.col


def n_tokens(text: str = "text"):
    """Words of a text and one end."""
    return F.coalesce(F.regexp_count(C(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


def bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds, ending at the longest length, of at most ``buckets`` buckets with the least padding.

    cost(i, j) = length_j * pieces(i..j) - tokens(i..j) obeys the quadrangle inequality, so best cuts move one way and
    each bucket more takes O(m log m) by divide and conquer. Ties go to the earliest cut.
    """
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    m = len(x)
    if not m:
        return []
    pieces, tokens = np.r_[0.0, np.cumsum(c)], np.r_[0.0, np.cumsum(c * x)]

    def cost(i, j):  # lengths i..j-1 in one bucket
        return x[j - 1] * (pieces[j] - pieces[i]) - (tokens[j] - tokens[i])

    best = np.r_[0.0, np.array([cost(0, j) for j in range(1, m + 1)])]
    cuts = []
    for b in range(1, min(buckets, m)):
        now, cut = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        stack = [(b + 1, m, b, m - 1)]
        while stack:
            lo, hi, a, z = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(mid - 1, z) + 1)
            total = best[i] + cost(i, mid)
            k = int(total.argmin())
            now[mid], cut[mid] = total[k], i[k]
            stack += [(lo, mid - 1, a, int(i[k])), (mid + 1, hi, int(i[k]), z)]
        now[: b + 1] = np.inf
        cuts.append(cut)
        best = now
    out, j = [], m
    for cut in reversed(cuts):
        out.append(int(x[j - 1]))
        j = int(cut[j])
    return [*reversed(out), ] if j == 0 else [int(x[j - 1]), *reversed(out)]


def pack(docs: DataFrame, *, max_len: int = 4096, buckets: int = 16, budget: int = 65_536, shard_rows: int = 50_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bucket, bound, batch, slot; batches count from 0 per bucket."""
    if budget < max_len:
        raise ValueError("the token budget of a batch must hold a piece of max_len")
    n = docs.select("doc_id", n_tokens().alias("_n"))
    last = F.floor((C("_n") - 1) / max_len).cast("int")
    pieces = settle(n.select("doc_id", "_n", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "doc_id", "piece", (C("piece").cast("long") * max_len).alias("start"), F.monotonically_increasing_id().alias("_row"),
        F.least(C("_n") - C("piece").cast("long") * max_len, F.lit(max_len).cast("long")).cast("int").alias("n_tokens")), "pack-pieces")
    histogram = pieces.groupBy("n_tokens").count().collect()  # at most max_len rows
    upper = bounds([r["n_tokens"] for r in histogram], [r["count"] for r in histogram], buckets)
    total = sum(r["count"] for r in histogram)
    shards = max(1, -(-total // shard_rows))
    bucket = sum(((C("n_tokens") > u).cast("int") for u in upper), F.lit(0)) if upper else F.lit(0)
    bound = F.element_at(F.array(*map(F.lit, upper or [1])), C("bucket") + 1)
    placed = (pieces.withColumn("bucket", bucket).withColumn("bound", bound)
              .withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "_row"), F.lit(shards)).cast("int")))
    before = F.sum("_c").over(Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("bucket", "_shard").agg(F.count(F.lit(1)).alias("_c")).select("bucket", "_shard", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("bucket", "_shard").orderBy("doc_id", "piece", "n_tokens", "_row")) - 1
    rows = F.floor(F.lit(budget) / C("bound")).cast("long")
    out = placed.withColumn("_i", number).join(offsets, ["bucket", "_shard"]).withColumn("_i", C("_i") + C("_before"))
    return out.select("doc_id", "piece", "start", "n_tokens", "bucket", "bound",
                      F.floor(C("_i") / rows).cast("long").alias("batch"), (C("_i") % rows).cast("int").alias("slot"))
