"""Level statistics, encoders and scalers as DataFrame operators.

Formulas follow the published methods; see the README for the constants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .prefix import exact_quantiles, running_sums
from .relational import hash_bucket
from .skew import join_stats

C = F.col
MISSING = "Missing"
OTHERS = "Others"
#: levels that are sorted and numbered by one task
LEVELS_A_PART = 1 << 20


def level_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, level) with one row per input row and column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"),
                               F.coalesce(C(c).cast("string"), F.lit(MISSING)).alias("level")) for c in cols])
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.column", "_c.level")


def level_table(df: DataFrame, cols: Sequence[str], label: str | None = None) -> DataFrame:
    """One grouped pass over all columns: rows, label sum, mean and population variance per level, and the totals."""
    if label is None:
        stats = level_long(df, cols).groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
        totals = stats.groupBy("column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("levels"))
        return stats.join(totals, "column")
    stats = level_long(df, cols, [label]).groupBy("column", "level").agg(
        F.count(F.lit(1)).alias("n"), F.sum(C(label).cast("double")).alias("pos"),
        F.avg(label).alias("mean"), F.var_pop(label).alias("var"))
    all_of = df.agg(F.struct(F.count(F.lit(1)).alias("total"), F.sum(C(label).cast("double")).alias("pos_all"),
                             F.avg(label).alias("prior"), F.var_pop(label).alias("var_all"))).scalar()
    return stats.withColumns({k: all_of[k] for k in ("total", "pos_all", "prior", "var_all")})


def rare_value(n_categories: int, tol: float) -> Column:
    return F.when((C("levels") <= n_categories) | (C("n") / C("total") >= tol), C("level")).otherwise(F.lit(OTHERS))


def woe_value(reg: float = 1.0) -> Column:
    pos = (C("pos") + reg) / (C("pos_all") + 2 * reg)
    neg = (C("n") - C("pos") + reg) / (C("total") - C("pos_all") + 2 * reg)
    return F.when(C("n") == 1, F.lit(0.0)).otherwise(F.ln(pos / neg))


def target_value() -> Column:
    w = 1.0 / (1.0 + F.exp(-(C("n") - 1.0)))
    return F.when(C("n") == 1, C("prior")).otherwise(C("prior") * (1 - w) + C("mean") * w)


def james_stein_value() -> Column:
    b = F.coalesce(F.try_divide(C("var"), C("var") + C("var_all")), F.lit(0.0))
    return (1 - b) * C("mean") + b * C("prior")


def ordered_value() -> Column:
    """Level totals form used when scoring."""
    return (C("pos") + C("prior")) / (C("n") + 1)


VALUES = {"woe": woe_value, "target": target_value, "james_stein": james_stein_value, "ordered": ordered_value}


def encoded_levels(df: DataFrame, cols: Sequence[str], label: str, method: str) -> DataFrame:
    """(column, level, n, value) for one of woe, target, james_stein, ordered."""
    return level_table(df, cols, label).select("column", "level", "n", VALUES[method]().alias("value"))


def apply_levels(df: DataFrame, col: str, levels: DataFrame, out: str) -> DataFrame:
    """Attach the value of each row's level (levels: column, level, n, value of the same rows); hot levels do not shuffle."""
    one = levels.where(C("column") == col).select(C("level").alias("_level"), "n", C("value").alias(out))
    rows = df.withColumn("_level", F.coalesce(C(col).cast("string"), F.lit(MISSING)))
    return join_stats(rows, one, ["_level"], "n").drop("_level", "n")


def rare_label(df: DataFrame, cols: Sequence[str], tol: float = 0.0017, n_categories: int = 3) -> DataFrame:
    """(column, level, n, value): the kept level or Others."""
    return level_table(df, cols).select("column", "level", "n", rare_value(n_categories, tol).alias("value"))


def ordered_target_encode(df: DataFrame, level: str, label: str, ts: str, key: str, out: str) -> DataFrame:
    """(sum of earlier labels of the level + prior)/(earlier rows + 1) in (ts, key) order.

    Running sums in time buckets, so a level with a third of all rows is spread over tasks.
    """
    rows = df.withColumns({"_us": F.unix_micros(C(ts).cast("timestamp")).cast("double"),
                           "_one": F.lit(1), "_y": C(label).cast("double")})
    run = running_sums(rows, "_us", ["_one", "_y"], [level], tie=key)
    prior = df.agg(F.avg(label)).scalar()
    seen = C("_one_upto") - 1
    return run.withColumn(out, (C("_y_upto") - C("_y") + prior) / (seen + 1)).select(*df.columns, out)


def ordered_rows(df: DataFrame, cols: Sequence[str], label: str, key: str | None = None, seed: int = 42) -> DataFrame:
    """Training rows with every level replaced by what the rows before it in a hashed order say; its own label takes no part."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]
    tie = F.xxhash64(*([key] if key else names), F.lit(seed))
    rows = df.withColumns({"_ord": tie.cast("double"), "_one": F.lit(1), "_y": C(label).cast("double")})
    prior = df.agg(F.avg(label)).first()[0] or 0.0
    for c in cols:
        run = running_sums(rows.withColumn("_level", F.coalesce(C(c).cast("string"), F.lit(MISSING))), "_ord", ["_one", "_y"], ["_level"])
        value = (C("_y_upto") - C("_y") + prior) / C("_one_upto")
        rows = run.withColumn(c, value).drop("_level", *[f"{n}_{k}" for n in ("_one", "_y") for k in ("upto", "all")])
    return rows.select(*df.columns)


def hash_encode(df: DataFrame, cols: Sequence[str], n: int, prefix: str = "hash") -> DataFrame:
    """Hashing trick: counts of column=level tokens in n components (md5, same on every engine)."""
    tokens = [F.concat_ws("=", F.lit(c), F.coalesce(C(c).cast("string"), F.lit(MISSING))) for c in cols]
    slots = [hash_bucket(t, n, 0) for t in tokens]
    total = {}
    for i in range(n):
        s = F.lit(0)
        for slot in slots:
            s = s + (slot == i).cast("int")
        total[f"{prefix}_{i}"] = s
    return df.withColumns(total)


def level_index(df: DataFrame, window: str, cols: Sequence[str]) -> DataFrame:
    """(window, column, level, share, at, pos): the levels of every window and column, numbered in their order.

    ``at`` counts from 0 inside the column; ``pos`` is the slot in the window's dummy vector, columns by name, and null
    for the smallest level of a column, which has no dummy. Levels are sorted in ranges of about LEVELS_A_PART and numbered
    inside a range; a range goes on from the counts of those before it, so no row or task holds all levels of a window.
    """
    found = settle(level_long(df, cols, [window]).groupBy(window, "column", "level").agg(F.count(F.lit(1)).alias("n")), "levels")
    parts = found.count() // LEVELS_A_PART + 1
    laid = settle(found.repartitionByRange(parts, window, "column", "level").withColumn("_part", F.spark_partition_id()), "levels-sorted")
    sums = laid.groupBy(window, "column", "_part").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    before = F.sum("_k").over(Window.partitionBy(window, "column").orderBy("_part")) - C("_k")
    sums = settle(sums.withColumn("_before", before), "level-ranges")  # one row per range, window and column
    dummies = F.sum("_k") - 1
    heads = sums.groupBy(window, "column").agg(F.sum("_n").alias("_rows"), dummies.alias("_d"))
    heads = heads.withColumn("_slots", F.sum("_d").over(Window.partitionBy(window).orderBy("column")) - C("_d")).drop("_d")
    local = F.row_number().over(Window.partitionBy(window, "column", "_part").orderBy("level")) - 1
    out = laid.withColumn("_at", local).join(sums.drop("_n", "_k"), [window, "column", "_part"]).join(heads, [window, "column"])
    at = C("_before") + C("_at")
    return out.select(window, "column", "level", "n", (C("n") / C("_rows")).alias("share"), at.alias("at"),
                      F.when(at > 0, C("_slots") + at - 1).alias("pos"))


def one_hot_sparse(df: DataFrame, key: str, window: str, cols: Sequence[str], index: DataFrame | None = None) -> DataFrame:
    """(key, window, own): one row per input key, its own dummies as (pos, share), however many levels there are.

    ``index`` is a written ``level_index``. All other dummies of the row are 0; scaled as in ``famd_scale`` an own dummy
    is 1/sqrt(share) - share and another one -share, which the index holds once per window.
    """
    index = settle(level_index(df, window, cols), "level-index") if index is None else index
    rows = join_stats(level_long(df, cols, [key, window]), index, [window, "column", "level"], "n")
    slot = F.when(C("pos").isNotNull(), F.struct("pos", "share"))  # collect_list leaves nulls out
    return rows.groupBy(key, window).agg(F.array_sort(F.collect_list(slot)).alias("own"))


def one_hot_drop_first(df: DataFrame, key: str, window: str, cols: Sequence[str], block: int = 1024) -> DataFrame:
    """Long dummies (key, window, column, level, x) per window, smallest level of each column left out.

    Rows get every remaining level, so zeros are explicit, in blocks of at most ``block`` levels; ``one_hot_sparse`` has
    the same dummies without the zeros.
    """
    kept = level_index(df, window, cols).filter("pos IS NOT NULL").withColumn("_block", F.floor(C("at") / block))
    lists = kept.groupBy(window, "column", "_block").agg(F.collect_list(F.struct("level", "share")).alias("levels")).drop("_block")
    rows = level_long(df, cols, [key, window]).withColumnRenamed("level", "_own").join(lists, [window, "column"])
    return rows.select(key, window, "column", "_own", F.explode("levels").alias("l")).select(
        key, window, "column", C("l.level").alias("level"), (C("l.level") == C("_own")).cast("double").alias("x"), C("l.share").alias("share"))


def famd_scale(dummies: DataFrame, center: str = "share") -> DataFrame:
    """x/sqrt(p) - p of every dummy, p its share in the window (center='sqrt' subtracts sqrt(p))."""
    sub = C("share") if center == "share" else F.sqrt("share")
    return dummies.withColumn("x_scaled", C("x") / F.sqrt("share") - sub)


def _whole_table(df: DataFrame, aggs: Sequence[Column]) -> Column:
    return df.agg(F.struct(*aggs)).scalar()


def scale_standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = [a for c in cols for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    s = _whole_table(df, aggs)
    return df.withColumns({c: (C(c) - s[f"m_{c}"]) / F.when(s[f"s_{c}"] == 0, 1.0).otherwise(s[f"s_{c}"])
                           for c in cols})


def scale_minmax(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    aggs = [a for c in cols for a in (F.min(c).alias(f"l_{c}"), F.max(c).alias(f"h_{c}"))]
    s = _whole_table(df, aggs)
    return df.withColumns({
        c: F.coalesce(F.try_divide((C(c) - s[f"l_{c}"]) * (high - low), s[f"h_{c}"] - s[f"l_{c}"]),
                      F.when(C(c).isNotNull(), F.lit(0.0))) + low for c in cols})


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """(column, quantiles...) exact, all columns in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), C(c).cast("double").alias("value")) for c in cols])
    long = df.select(F.explode(cells).alias("c")).select("c.column", "c.value").where(C("value").isNotNull())
    return exact_quantiles(long, "value", probs, ["column"])


def scale_robust(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    q = column_quantiles(df, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    one = q.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("q25", "q50", "q75"))))).scalar()
    out = {}
    for c in cols:
        s = one[c]
        iqr = s["q75"] - s["q25"]
        out[c] = (C(c) - s["q50"]) / F.when(iqr == 0, 1.0).otherwise(iqr)
    return df.withColumns(out)
