"""Missing-value, flag and consolidation columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import join_null_safe
from .geo import time_zone_minutes

C = F.col


def match_status(c: Column) -> Column:
    return (F.when(c == -1, "Partial Match").when(c == -2, "No Match").when(c.isNull() | F.isnan(c), "Missing")
            .otherwise("Other"))


def clear_codes(c: Column) -> Column:
    return F.when(~c.isin(-1, -2), c)


def consolidate_levels(a: Column, b: Column, ranks: Mapping[str, float]) -> Column:
    """Row-wise higher rank of two ordered columns, null only when both have none; back to its level."""
    if not ranks:
        return F.lit(None).cast("string")
    to_rank = F.create_map(*[F.lit(x) for x in chain.from_iterable(ranks.items())])
    inverse = {v: k for k, v in ranks.items()}
    to_level = F.create_map(*[F.lit(x) for x in chain.from_iterable(inverse.items())])
    return F.element_at(to_level, F.greatest(F.element_at(to_rank, a), F.element_at(to_rank, b)))


def match_flag(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False)).cast("int")


def feature_consolidator(df: DataFrame, ida_vars: Sequence[str], consolidation_vars: Sequence[Sequence[str]],
                         consolidation_mapping: Mapping[str, float], match_vars: Sequence[Sequence[str]],
                         time_zone_col: str = "tmx_raw_time_zone") -> DataFrame:
    """Match status of coded numerics, merged level pairs, time zone in hours, equality flags; absent columns are skipped."""
    have = set(df.columns)
    ida = [c for c in ida_vars if c in have]
    out = df.withColumns({f"{c}_ft_matchstatus": match_status(C(c)) for c in ida})
    out = out.withColumns({c: clear_codes(C(c)) for c in ida})
    for new, a, b in consolidation_vars:
        if {a, b} <= have:
            out = out.withColumn(new, consolidate_levels(C(a), C(b), consolidation_mapping)).drop(
                *[c for c in (a, b) if c != new])
    if time_zone_col in have:
        out = out.withColumn(time_zone_col, time_zone_minutes(C(time_zone_col)))
    now = set(out.columns)
    return out.withColumns({new: match_flag(C(a), C(b)) for new, a, b in match_vars if {a, b} <= now})


def missing_indicators(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    have = set(df.columns)
    return df.withColumns({f"{c}_ft_missing_ind": C(c).isNull().cast("double") for c in cols if c in have})


def impute_dates(df: DataFrame, cols: Sequence[str], reference: Mapping[str, str], imputation_col: str) -> DataFrame:
    """Null dates take the creation date, unless the paired reference column is null."""
    have = set(df.columns)
    out = {}
    for c in cols:
        if c in have:
            filled = F.coalesce(C(c), C(imputation_col))
            ref = reference.get(c)
            out[c] = F.when(C(ref).isNotNull(), filled) if ref else filled
    return df.withColumns(out)


def impute_constant(df: DataFrame, cols: Sequence[str], value: float = 99999999.0) -> DataFrame:
    return df.na.fill(value, list(cols))


def impute_categorical(df: DataFrame, cols: Sequence[str], value: str = "Missing") -> DataFrame:
    return df.na.fill(value, list(cols))


def standardize_present(df: DataFrame, cols: Sequence[str], window: str) -> DataFrame:
    """Per window: z-score over the present values (population deviation), missing values become -1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}")]
    stats = df.groupBy(window).agg(*aggs)
    z = {c: F.coalesce((C(c) - C(f"_mu_{c}")) / F.when(C(f"_sd_{c}") == 0, 1.0).otherwise(C(f"_sd_{c}")), F.lit(-1.0))
         for c in cols}
    return join_null_safe(df, stats, [window]).withColumns(z).drop(*[f"_{s}_{c}" for c in cols for s in ("mu", "sd")])
