"""Running sums over a whole table without a one-task window.

Rows are cut into range buckets of about BUCKET_ROWS rows, whatever the session's
settings: first by quantiles of the order column into the square root of the
buckets needed, then each of these by its own quantiles. A window inside (group,
bucket) gives the sum within the bucket; what came before it is summed in two
levels, over the buckets of one upper range and over the upper ranges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

BUCKET_ROWS = 1 << 20


def cut_points(df: DataFrame, col: str, buckets: int) -> list[float]:
    """Distinct approximate quantiles of a numeric column (a bounded list)."""
    probs = [i / buckets for i in range(1, buckets)]
    cuts = df.approxQuantile(col, probs, 1.0 / (4 * buckets))
    return sorted(set(cuts))


def with_bucket(df: DataFrame, col: str, cuts: Sequence[float], out: str = "_bkt") -> DataFrame:
    """Bucket k holds cuts[k-1] <= col < cuts[k] (binary search in the JVM)."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *[float(c) for c in cuts], float("inf")]
    named = Bucketizer(splits=splits, inputCol="_order", outputCol="_bktd")
    return (named.transform(df.withColumn("_order", F.col(col).cast("double")))
            .withColumn(out, F.col("_bktd").cast("int")).drop("_order", "_bktd"))


def _two_levels(df: DataFrame, order: str) -> tuple[DataFrame, int]:
    """``df`` with _top and _bkt, rising with ``order``, and the upper ranges used; one bucket holds about BUCKET_ROWS rows."""
    side = math.ceil(math.sqrt(df.count() / BUCKET_ROWS)) or 1
    if side == 1:
        return df.withColumns({"_top": F.lit(0), "_bkt": F.lit(0)}), 1
    tops = with_bucket(df, order, cut_points(df, order, side), "_top")
    shares = F.array(*[F.lit(i / side) for i in range(1, side)])
    # one row per upper range, at most ``side`` cuts each: as many numbers as there are buckets
    inner = tops.groupBy("_top").agg(F.percentile_approx(F.col(order).cast("double"), shares, F.lit(10 * side)).alias("_cuts"))
    placed = tops.join(F.broadcast(inner), "_top")
    at = F.aggregate("_cuts", F.lit(0), lambda n, c: n + (F.col(order).cast("double") >= c).cast("int"))
    return placed.withColumn("_bkt", at).drop("_cuts"), side


def running_sums(df: DataFrame, order: str, sums: Sequence[str], groups: Sequence[str] = (),
                 tie: str | None = None, ascending: bool = True) -> DataFrame:
    """Adds ``<c>_upto`` (inclusive running sum) and ``<c>_all`` (group total) for each c in sums.

    ``tie`` orders rows of one ``order`` value. Where a single value of ``order``
    fills several quantile steps, its rows are cut once more by ``tie``.
    """
    # one struct key: never null itself, and its null fields compare as equal
    group = F.struct(*groups) if groups else F.lit(0)
    base, side = _two_levels(df, order)
    base = base.withColumn("_g", group)
    if tie is not None and side > 1:
        # rows of one order value lie in one bucket; where that is more than a bucket's share they are cut by ``tie``
        busy = base.groupBy(F.col(order).alias("_o")).count().where(F.col("count") > BUCKET_ROWS)
        cuts = base.join(F.broadcast(busy), F.col(order) == F.col("_o")).groupBy("_o").agg(
            F.percentile_approx(F.col(tie).cast("double"), F.array(*[F.lit(i / (side * side)) for i in range(1, side * side)]), F.lit(10_000)).alias("_tie_cuts"))
        base = base.join(F.broadcast(cuts), F.col(order) == F.col("_o"), "left").drop("_o")
        at = F.aggregate(F.coalesce("_tie_cuts", F.array().cast("array<double>")), F.lit(0), lambda n, c: n + (F.col(tie).cast("double") >= c).cast("int"))
        low = F.when(F.col("_tie_cuts").isNull(), F.lit(None).cast("double")).otherwise(F.col(order).cast("double"))
        # rows below, at and above a busy value of the same bucket stay in order: the bucket of a busy value stands alone
        base = base.withColumns({"_sub": at, "_busy": low}).drop("_tie_cuts")
        values = base.where(F.col("_busy").isNotNull()).groupBy("_top", "_bkt").agg(F.array_sort(F.collect_set("_busy")).alias("_values"))
        base = base.join(F.broadcast(values), ["_top", "_bkt"], "left")
        o = F.col(order).cast("double")
        part = F.aggregate(F.coalesce("_values", F.array().cast("array<double>")), F.lit(0),
                           lambda n, v: n + (o >= v).cast("int") + (o > v).cast("int"))
        base = base.withColumn("_bkt", F.struct("_bkt", part.alias("part"), "_sub")).drop("_sub", "_busy", "_values")
    keys = ["_g", "_top", "_bkt"]

    def way(c):
        return F.col(c).asc() if ascending else F.col(c).desc()

    up_to_here = (Window.unboundedPreceding, Window.currentRow)
    inner = Window.partitionBy(*keys).orderBy(*[way(c) for c in ([order, tie] if tie else [order])]).rowsBetween(*up_to_here)
    rows = base.withColumns({f"_in_{c}": F.sum(c).over(inner) for c in sums})
    totals = base.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    tops = totals.groupBy("_g", "_top").agg(*[F.sum(f"_t_{c}").alias(f"_t_{c}") for c in sums])
    before = (Window.unboundedPreceding, -1)
    upper, lower = Window.partitionBy("_g"), Window.partitionBy("_g", "_top")
    # at most one row per (group, upper range), then per (group, bucket) of one upper range: the windows are small
    above = tops.select("_g", "_top",
                        *[F.coalesce(F.sum(f"_t_{c}").over(upper.orderBy(way("_top")).rowsBetween(*before)), F.lit(0)).alias(f"_up_{c}") for c in sums],
                        *[F.sum(f"_t_{c}").over(upper).alias(f"{c}_all") for c in sums])
    inside = totals.select(*keys, *[F.coalesce(F.sum(f"_t_{c}").over(lower.orderBy(way("_bkt")).rowsBetween(*before)), F.lit(0)).alias(f"_lo_{c}") for c in sums])
    offsets = inside.join(above, ["_g", "_top"])
    # the rows are already partitioned and sorted by the join keys for the window above
    out = rows.join(offsets, keys)
    return (out.withColumns({f"{c}_upto": F.col(f"_up_{c}") + F.col(f"_lo_{c}") + F.col(f"_in_{c}") for c in sums})
            .drop(*keys, *[f"{k}_{c}" for c in sums for k in ("_up", "_lo", "_in")]))


def exact_quantiles(df: DataFrame, col: str, probs: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Works on value counts and running sums, so that no group is held by one task.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(*groups, col).agg(F.count(F.lit(1)).alias("cnt"))
    ranked = running_sums(counts, col, ["cnt"], groups)
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("cnt_all") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        first, last = F.col("cnt_upto") - F.col("cnt"), F.col("cnt_upto") - 1
        v_lo = F.max(F.when((first <= lo) & (lo <= last), F.col(col)))
        v_hi = F.max(F.when((first <= hi) & (hi <= last), F.col(col)))
        frac = F.max(pos - lo)
        aggs.append((v_lo + (v_hi - v_lo) * frac).alias(name))
    return ranked.groupBy(*groups).agg(*aggs)
