"""Helpers that keep hot keys from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

#: a key with more than 1/HOT_SHARE of all rows is hot, so fewer than HOT_SHARE keys can be
HOT_SHARE = 2000


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                   nulls: bool = True) -> DataFrame:
    """Join on keys where null equals null; the key columns come from the left side.

    ``nulls=False`` says that no key is null: the plain equality then keeps an
    existing partitioning by the keys.
    """
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    return left.join(renamed, _on(left, renamed, keys, nulls), how).drop(*[f"__{k}" for k in keys])


def _on(left: DataFrame, renamed: DataFrame, keys: Sequence[str], nulls: bool):
    parts = [left[k].eqNullSafe(renamed[f"__{k}"]) if nulls else left[k] == renamed[f"__{k}"] for k in keys]
    return reduce(lambda a, b: a & b, parts)


def join_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], count: str = "n", nulls: bool = True) -> DataFrame:
    """Attach one row of group statistics to every row of ``df`` (inner).

    ``stats`` has one row per key and the number of rows of ``df`` in ``count``.
    Keys that hold more than 1/HOT_SHARE of all rows are joined by broadcast
    (there are fewer than HOT_SHARE of them, whatever the data size); the rest
    takes the ordinary shuffle join, which then has no hot key.
    """
    total = stats.agg(F.sum(count)).scalar()
    is_hot = F.col(count) * HOT_SHARE > total
    hot, cold = stats.where(is_hot), stats.where(~is_hot)
    hot_rows = join_null_safe(df, F.broadcast(hot), keys, nulls=nulls)
    renamed = hot.select(*[F.col(k).alias(f"__{k}") for k in keys])
    other_rows = df.join(F.broadcast(renamed), _on(df, renamed, keys, nulls), "left_anti")
    return hot_rows.unionByName(join_null_safe(other_rows, cold, keys, nulls=nulls))


def join_unique(df: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on non-null keys with a side that has one row per key, where keys may be hot in ``df``."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return join_stats(df, right.join(counts, list(keys)), keys, "_n", nulls=False).drop("_n")
