"""Schema, filter, join, set, sample and top-k operators on application tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

C = F.col

# ---------------------------------------------------------------- schema


def select_existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Listed columns that exist, in table order."""
    wanted = set(names)
    return df.select(*[c for c in df.columns if c in wanted])


def drop_existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def pii_projection(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Keep only the allow-list; everything else, personal data included, is pruned from the scan."""
    return select_existing(df, allowed)


def add_missing_columns(df: DataFrame, names: Sequence[str], fill: str = "") -> DataFrame:
    have = set(df.columns)
    return df.withColumns({c: F.lit(fill) for c in names if c not in have})


def lowercase_columns(df: DataFrame) -> DataFrame:
    lower = [c.lower() for c in df.columns]
    clash = sorted({c for c in lower if lower.count(c) > 1})
    if clash:
        raise ValueError(f"column names collide in lower case: {clash}")
    return df.toDF(*lower)


def name_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def vector_slot_names(df: DataFrame, vector: str) -> list[str]:
    """Names kept in the ML attributes of an assembled vector column."""
    attrs = df.schema[vector].metadata.get("ml_attr", {}).get("attrs", {})
    slots = sorted((a["idx"], a.get("name", str(a["idx"]))) for kind in attrs.values() for a in kind)
    return [name for _, name in slots]


def coerce_types(df: DataFrame, dates: Sequence[str] = (), numerics: Sequence[str] = (),
                 categoricals: Sequence[str] = (), fmt: str = "yyyy-MM-dd HH:mm:ss",
                 null_as: str | None = None) -> DataFrame:
    """Dates by one format, numerics strictly (bad text raises under ANSI), the rest to string."""
    have = set(df.columns)
    out: dict[str, Column] = {}
    for c in dates:
        if c in have:
            is_text = isinstance(df.schema[c].dataType, T.StringType)
            out[c] = F.to_timestamp(C(c), fmt) if is_text else C(c).cast("timestamp")
    for c in numerics:
        if c in have:
            out[c] = C(c).cast("double")
    for c in categoricals:
        if c in have:
            text = C(c).cast("string")
            out[c] = text if null_as is None else F.coalesce(text, F.lit(null_as))
    return df.withColumns(out)


def coerce_numeric_lenient(c: Column) -> Column:
    """Strip single quotes, cast, bad text becomes null."""
    return F.regexp_replace(c, "'", "").try_cast("double")


def resolve_collision(left: DataFrame, right: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Inner join that keeps the right side's version of a column both sides have."""
    return left.drop(column).join(right, list(keys), "inner")


def fraud_label(df: DataFrame, mode: str, out: str = "fraud_specified") -> DataFrame:
    rules = {
        "general": (C("dep_var") == 1) | (C("first_party_fraud") == 1),
        "first": C("first_party_fraud") == 1,
        "third": C("dep_var") == 1,
        "any": C("any_fraud") == 1,
    }
    if mode not in rules:
        raise ValueError(f"unknown fraud type {mode!r}; choose one of {sorted(rules)}")
    return df.withColumn(out, F.when(rules[mode], 1).otherwise(0))


def map_flag(c: Column, hit: str = "fraud") -> Column:
    return F.when(c == hit, 1).otherwise(0)


def conditional_update(df: DataFrame, column: str, rules: Sequence[tuple[Column, object]]) -> DataFrame:
    """Rules are applied in order, so the last matching one wins."""
    new = C(column)
    for cond, value in rules:
        new = F.when(cond, F.lit(value)).otherwise(new)
    return df.withColumn(column, new)


def split_features_label(df: DataFrame, target: str, key: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(key, target)


# ---------------------------------------------------------------- filters


def filter_product(df: DataFrame, product: str = "installment") -> DataFrame:
    return df.where(C("product_type") == product)


def filter_scored(df: DataFrame, score: str = "fm_5_score") -> DataFrame:
    return df.where(C(score).isNotNull())


def search_exact(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(C(column) == value)


def search_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column, read as text, starts with ``prefix`` (pushes down for text columns)."""
    return df.where(C(column).cast("string").startswith(prefix))


# ---------------------------------------------------------------- joins


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("ca_id", "customer_id"),
                 how: str = "inner") -> DataFrame:
    return left.join(right, list(keys), how)


def lookup_default(df: DataFrame, dim: DataFrame, key: str, value: str, default) -> DataFrame:
    """Dimension lookup where an unknown key gives ``default``; Spark broadcasts the dimension when its size allows."""
    return df.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(C(value), F.lit(default)))


def membership_flag(df: DataFrame, key: str, listed: DataFrame, out: str) -> DataFrame:
    """1 when the row's key is in the list, else 0."""
    marks = listed.select(C(key)).where(C(key).isNotNull()).distinct().withColumn("_in", F.lit(1))
    return df.join(marks, key, "left").withColumn(out, F.coalesce(C("_in"), F.lit(0))).drop("_in")


def anti_join_holdout(train: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    return train.join(holdout.select(key), key, "left_anti")


# ---------------------------------------------------------------- repeatable sampling


def hash_bucket(key: Column, modulus: int, seed: int = 42) -> Column:
    """A repeatable bucket 0..modulus-1 from md5, the same on every engine."""
    text = F.concat_ws(":", key.cast("string"), F.lit(str(seed)))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(modulus))


def sample_fraction(df: DataFrame, key: str, percent: int = 20, seed: int = 42) -> DataFrame:
    return df.where(hash_bucket(C(key), 100, seed) < percent)


def poisson_steps(rate: float) -> list[int]:
    """Where a 32-bit hash passes from one number of copies to the next: the Poisson distribution's sums, in hash units."""
    steps, share, total, k = [], math.exp(-rate), 0.0, 0
    while (total := total + share) * (1 << 32) < (1 << 32) - 1:
        steps.append(int(total * (1 << 32)))
        k += 1
        share *= rate / k
        if share <= 0 or k > 1000 + 10 * rate:
            break
    return steps


def sample_with_replacement(df: DataFrame, key: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Each row as often as a Poisson draw from the hash of its key says: the same rows for any partitioning."""
    h = hash_bucket(C(key), 1 << 32, seed)
    copies = F.aggregate(F.array(*[F.lit(s) for s in poisson_steps(fraction)]), F.lit(0), lambda n, s: n + (h >= s).cast("int"))
    return (df.withColumn("_copies", copies).where(C("_copies") > 0)
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), C("_copies")))).drop("_copies", "_copy"))


def stratified_fold(df: DataFrame, key: str, label: str, folds: int = 10, seed: int = 42,
                    out: str = "fold") -> DataFrame:
    """Hash folds per label: no shuffle, the same on every run, even shares in expectation."""
    strat = F.concat_ws("|", C(label).cast("string"), C(key).cast("string"))
    return df.withColumn(out, hash_bucket(strat, folds, seed).cast("int"))


# ---------------------------------------------------------------- top-k, sets, windows by key


def topk(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(C(by).desc(), C(tie)).limit(k)


def drop_bottom_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """Remove the k rows with the smallest values (k small: only the keys of the bottom k are held)."""
    bottom = df.orderBy(C(by).asc(), C(tie)).limit(k).select(tie)
    return df.join(bottom, tie, "left_anti")


def head_n(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(key).limit(n)


def argmax_trial(trials: DataFrame, score: str, params: str) -> DataFrame:
    return trials.agg(F.max(score).alias("best_score"), F.max_by(params, score).alias("best_params"))


def union_rows(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def concat_columns(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Column-wise concat of aligned results: one projection, no join."""
    return df.withColumns(dict(columns))


def unique_row_ids(df: DataFrame, column: str, key: str) -> DataFrame:
    """Keys of the rows whose value in ``column`` occurs once (nulls count as one value)."""
    return (df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias(key))
            .where(C("n") == 1).select(key))


def duplicated_filter(df: DataFrame, repeated: str, single: str, key: str) -> DataFrame:
    """Rows whose ``repeated`` value occurs more than once and whose ``single`` value occurs once.

    Groups are pre-aggregated and the joins run on the unique row key, so a hot value costs nothing.
    """
    return (df.join(unique_row_ids(df, repeated, key), key, "left_anti")
            .join(unique_row_ids(df, single, key), key, "left_semi"))


def first_occurrence(df: DataFrame, column: str, key: str) -> DataFrame:
    """First row (smallest key) of every value; again a join on the unique key only."""
    firsts = df.groupBy(column).agg(F.min(key).alias(key)).select(key)
    return df.join(firsts, key, "left_semi")


# ---------------------------------------------------------------- column profiles


def _profile(df: DataFrame) -> DataFrame:
    """One pass over all columns: null share, smallest and largest value as text."""
    aggs = []
    for c in df.columns:
        aggs.append(F.struct(
            F.lit(c).alias("column"),
            F.avg(C(c).isNull().cast("double")).alias("null_fraction"),
            F.min(C(c)).cast("string").alias("lo"), F.max(C(c)).cast("string").alias("hi"),
            (F.count(C(c)) > 0).alias("any_value"), (F.count(C(c)) < F.count(F.lit(1))).alias("any_null"),
            (F.coalesce(F.min(C(c)) == F.max(C(c)), F.lit(True))).alias("one_value")))
    return df.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def null_fraction(df: DataFrame) -> DataFrame:
    return _profile(df).select("column", "null_fraction")


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with one distinct value, null counted as a value."""
    p = _profile(df)
    return p.where(C("one_value") & (C("any_value") != C("any_null"))).select("column")


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def time_span_and_rate(df: DataFrame, ts: str, label: str) -> DataFrame:
    """Whole elapsed days between first and last row, and the label rate rounded to 5 digits."""
    def micros(c):
        return F.unix_micros(c.cast("timestamp"))

    span = F.floor((micros(F.max(ts)) - micros(F.min(ts))) / F.lit(86_400_000_000))
    return df.agg(span.cast("bigint").alias("days"), F.round(F.avg(label), 5).alias("rate"))


def importance_mean(df: DataFrame, feature: str = "feature", value: str = "importance") -> DataFrame:
    return df.groupBy(feature).agg(F.avg(value).alias("mean_importance")).orderBy(
        C("mean_importance").desc(), C(feature))


# ---------------------------------------------------------------- time windows


def period_windows(df: DataFrame, ts: str, days: int, closed: str = "both") -> DataFrame:
    """Adds ``window_no`` and ``window_end``: N-day windows from the first timestamp.

    With ``closed='both'`` a row on an inner boundary belongs to both windows;
    with ``'right'`` only to the earlier one. Rows after the last full boundary are left out.
    """
    us = F.unix_micros(C(ts).cast("timestamp"))
    step = F.lit(days * 86_400_000_000)
    bounds = df.agg(F.struct(F.min(us).alias("lo"), F.max(us).alias("hi"))).scalar()
    rows = df.withColumns({"_lo": bounds["lo"], "_last": F.floor((bounds["hi"] - bounds["lo"]) / step)})
    elapsed = us - C("_lo")
    k = F.greatest(F.lit(1), F.ceil(elapsed / step)).cast("bigint")
    numbers = F.array(k)
    if closed == "both":
        inner = (elapsed > 0) & (elapsed % step == 0)
        numbers = F.when(inner, F.array(k, k + 1)).otherwise(numbers)
    return (rows.withColumn("window_no", F.explode(numbers)).where(C("window_no") <= C("_last"))
            .withColumn("window_end", F.timestamp_micros(C("_lo") + C("window_no") * step).cast("date"))
            .drop("_lo", "_last"))


def assign_window(df: DataFrame, ts: str, days: int, keys: DataFrame | None = None, key: str = "ca_id") -> DataFrame:
    """Window membership; windows lie over the whole table, ``keys`` then selects the rows of a slice."""
    rows = period_windows(df, ts, days)
    return rows if keys is None else rows.join(keys.select(key), key, "left_semi")
