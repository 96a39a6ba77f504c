"""Exact score evaluation: curves, areas, threshold tables.

Every operator starts from ``curve_counts``: labels are summed per distinct
score (map-side combine first), then running sums give the confusion counts at
each cut. All curves and areas are plain column arithmetic on that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .prefix import running_sums

C = F.col


def curve_counts(scores: DataFrame, score: str = "score", label: str = "ytrue",
                 groups: Sequence[str] = (), weight: str | None = None, keep: bool = True) -> DataFrame:
    """One row per (group, distinct score): pos, neg at the score, tp, fp at or above it, totals p, n.

    ``keep`` writes the per-score counts to the shared folder, so that the source is read once although
    rows are counted in a pass of their own; pass False when the scores are stored already.
    """
    value = C(score).cast("double")
    rows = scores.where(value.isNotNull() & ~F.isnan(value) & C(label).isNotNull())
    w: Column = F.lit(1) if weight is None else C(weight)
    per_score = rows.groupBy(*groups, C(score).cast("double").alias("score")).agg(
        F.sum(F.when(C(label) == 1, w).otherwise(F.lit(0))).alias("pos"),
        F.sum(F.when(C(label) == 1, F.lit(0)).otherwise(w)).alias("neg"))
    if keep:
        per_score = settle(per_score, "curve")
    out = running_sums(per_score, "score", ["pos", "neg"], groups, ascending=False)
    return out.select(*groups, "score", "pos", "neg",
                      C("pos_upto").alias("tp"), C("neg_upto").alias("fp"),
                      C("pos_all").alias("p"), C("neg_all").alias("n"))


def _ap() -> Column:
    return F.sum(F.try_divide(C("pos"), C("p")) * (C("tp") / (C("tp") + C("fp"))))


def _auc() -> Column:
    return F.try_divide(F.sum(C("neg") * (C("tp") - C("pos") / 2)), F.max(C("p") * C("n")))


def _trapezoid_pr() -> Column:
    before_tp, before_fp = C("tp") - C("pos"), C("fp") - C("neg")
    prev_precision = F.when(before_tp + before_fp == 0, F.lit(1.0)).otherwise(
        F.try_divide(before_tp, before_tp + before_fp))
    return F.sum(F.try_divide(C("pos"), C("p")) * (C("tp") / (C("tp") + C("fp")) + prev_precision) / 2)


def average_precision(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*groups).agg(_ap().alias("auc_pr"))


def roc_auc(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*groups).agg(_auc().alias("auc_roc"))


def pr_auc_trapezoid(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*groups).agg(_trapezoid_pr().alias("pr_auc"))


def group_metrics(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Rows, positives, ROC AUC and average precision of each group; areas are null for one-class groups."""
    both = F.max(C("p") * C("n")) > 0
    return counts.groupBy(*groups).agg(
        F.max(C("p") + C("n")).alias("total_applications"), F.max("p").alias("actual_fraud"),
        F.when(both, _auc()).alias("auc_roc"), F.when(both, _ap()).alias("auc_pr"))


def pr_curve(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(threshold, precision, recall) per distinct score and the closing point (null, 1, 0)."""
    points = counts.select(*groups, C("score").alias("threshold"),
                           (C("tp") / (C("tp") + C("fp"))).alias("precision"),
                           F.try_divide(C("tp"), C("p")).alias("recall"))
    closing = counts.groupBy(*groups).agg(F.lit(None).cast("double").alias("threshold"),
                                          F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(closing)


def roc_curve(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) from (0, 0), all distinct scores."""
    points = counts.select(*groups, C("score").alias("threshold"),
                           F.try_divide(C("fp"), C("n")).alias("fpr"), F.try_divide(C("tp"), C("p")).alias("tpr"))
    origin = counts.groupBy(*groups).agg(F.lit(None).cast("double").alias("threshold"),
                                         F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def mean_roc_curve(counts: DataFrame, fold: str = "fold", grid: int = 100) -> DataFrame:
    """Each fold's tpr read at evenly spaced fprs, then mean and one-deviation band over folds.

    A grid point belongs to the one curve segment that contains it, found by
    integer arithmetic on the counts, so no join with the grid is needed.
    """
    g = grid - 1
    fp_before, tp_before = C("fp") - C("neg"), C("tp") - C("pos")

    def ceil_div(a):
        return F.floor((a * g + C("n") - 1) / C("n"))

    on_segment = counts.where((C("neg") > 0) & (C("p") > 0)).select(
        fold, "p", "n", "neg", "pos", fp_before.alias("f0"), tp_before.alias("t0"),
        F.sequence(ceil_div(fp_before), ceil_div(C("fp"))).alias("pts"), ceil_div(C("fp")).alias("stop"))
    read = on_segment.select(
        fold, "p", "n", "neg", "pos", "f0", "t0",
        F.explode(F.filter("pts", lambda i: i < C("stop"))).alias("point"))
    tpr = (C("t0") + C("pos") * ((C("point") / F.lit(float(g))) * C("n") - C("f0")) / C("neg")) / C("p")
    inner = read.select(fold, "point", F.when(C("point") == 0, F.lit(0.0)).otherwise(tpr).alias("tpr"))
    end = counts.where((C("p") > 0) & (C("n") > 0)).groupBy(fold).agg(
        F.lit(g).cast("long").alias("point"), F.lit(1.0).alias("tpr"))
    stats = inner.unionByName(end).groupBy("point").agg(
        F.avg("tpr").alias("mean_tpr"), F.stddev_pop("tpr").alias("std_tpr"))
    return stats.select(
        "point", (C("point") / F.lit(float(g))).alias("fpr"), "mean_tpr",
        F.greatest(C("mean_tpr") - C("std_tpr"), F.lit(0.0)).alias("tpr_lower"),
        F.least(C("mean_tpr") + C("std_tpr"), F.lit(1.0)).alias("tpr_upper"))


def mean_roc_auc(counts: DataFrame, fold: str = "fold", grid: int = 100) -> DataFrame:
    """Area under the mean curve and the deviation of the fold areas (one row)."""
    curve = mean_roc_curve(counts, fold, grid)
    step = Window.partitionBy(F.lit(0)).orderBy("point")  # `grid` rows
    area = curve.select(((C("mean_tpr") + F.lag("mean_tpr").over(step)) / 2 / (grid - 1)).alias("a")).agg(
        F.sum("a").alias("mean_auc"))
    return roc_auc(counts, [fold]).agg(F.stddev_pop("auc_roc").alias("std_auc"),
                                       F.avg("auc_roc").alias("avg_fold_auc")).select(
        area.scalar().alias("mean_auc"), "std_auc", "avg_fold_auc")


def with_pooled(scores: DataFrame, fold: str, pooled: str = "pooled") -> DataFrame:
    """Every row once under its fold and once under the pooled group."""
    return scores.withColumn(fold, F.explode(F.array(C(fold).cast("string"), F.lit(pooled))))


def unpivot_scores(scores: DataFrame, label: str, score_cols: Sequence[str]) -> DataFrame:
    """Long form (model, ytrue, score); rows with a missing score are left out per column."""
    parts = F.array(*[F.struct(F.lit(c).alias("model"), C(c).cast("double").alias("score")) for c in score_cols])
    return (scores.select(C(label).alias("ytrue"), F.explode(parts).alias("s"))
            .select("ytrue", "s.model", "s.score").where(C("score").isNotNull()))


def model_comparison(scores: DataFrame, label: str, score_cols: Sequence[str]) -> DataFrame:
    """Average precision per score column and of the no-skill score (the base rate)."""
    long = unpivot_scores(scores, label, score_cols)
    skill = average_precision(curve_counts(long, "score", "ytrue", ["model"]), ["model"])
    none = scores.agg(F.lit("no_skill").alias("model"), F.avg(C(label).cast("double")).alias("auc_pr"))
    return skill.unionByName(none)


def model_curves(scores: DataFrame, label: str, score_cols: Sequence[str]) -> DataFrame:
    """Precision-recall points (model, threshold, precision, recall) per score column, and both ends of the no-skill line."""
    long = unpivot_scores(scores, label, score_cols)
    points = pr_curve(curve_counts(long, "score", "ytrue", ["model"]), ["model"])
    none = scores.agg(F.lit("no_skill").alias("model"), F.lit(None).cast("double").alias("threshold"),
                      F.avg(C(label).cast("double")).alias("precision"))
    return points.unionByName(none.withColumn("recall", F.explode(F.array(F.lit(0.0), F.lit(1.0)))))


def ks_statistic(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Largest gap between the class-wise score distributions and the score where it is reached."""
    gap = F.abs(F.try_divide(C("tp"), C("p")) - F.try_divide(C("fp"), C("n")))
    best = F.max(F.struct(gap.alias("ks"), C("score").alias("threshold")))
    return counts.groupBy(*groups).agg(best.alias("b")).select(*groups, "b.ks", "b.threshold")


def threshold_sweep(scores: DataFrame, score: str = "score", label: str = "ytrue",
                    groups: Sequence[str] = (), top: int = 100) -> DataFrame:
    """Confusion counts and rates at thresholds 0..top on 100*score, strict greater.

    One scan: rows fall into at most top+2 buckets, and bucket b counts as
    predicted positive at threshold t when b > t. A row without a score (null or NaN)
    is never predicted positive; a row without a label is not counted.
    """
    value = C(score).cast("double")
    bucket = F.when(value.isNull() | F.isnan(value), 0).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(top + 1), F.ceil(value * 100)))).cast("int")
    hist = scores.groupBy(*groups, bucket.alias("b")).agg(
        F.sum(F.when(C(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(C(label) != 1, 1).otherwise(0)).alias("neg"))
    spread = hist.withColumn("threshold", F.explode(F.sequence(F.lit(0), F.lit(top))))
    hit = C("b") > C("threshold")
    sums = spread.groupBy(*groups, "threshold").agg(
        F.sum(F.when(hit, C("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, C("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    fn = C("p") - C("tp")
    return sums.select(
        *groups, "threshold", (C("p") + C("n")).alias("total_applications"), C("p").alias("actual_fraud"),
        (C("tp") + C("fp")).alias("predicted_fraud"),
        F.coalesce(F.try_divide(C("tp"), C("tp") + C("fp")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(C("tp"), C("p")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * C("tp"), 2 * C("tp") + C("fp") + fn), F.lit(0.0)).alias("f1score"),
        F.try_divide(C("fp"), C("n")).alias("false_positive_rate"),
        F.try_divide(fn, C("p")).alias("fraud_missed_rate"),
        (C("tp") - 0.05 * C("fp") - fn).alias("net_effect_fraud"))


def confusion_at(scores: DataFrame, threshold: float, score: str = "score", label: str = "ytrue",
                 groups: Sequence[str] = ()) -> DataFrame:
    pred, fraud = C(score) > threshold, C(label) == 1

    def cnt(cond):
        return F.count(F.when(cond, 1))

    return scores.groupBy(*groups).agg(
        cnt(pred & fraud).alias("true_positives"), cnt(pred & ~fraud).alias("false_positives"),
        cnt(~pred & fraud).alias("false_negatives"), cnt(~pred & ~fraud).alias("true_negatives"))


def partner_objective(metrics: DataFrame, partners: Sequence[str], metric: str = "auc_pr",
                      partner: str = "partner") -> DataFrame:
    """Mean of a metric per partner over folds, then the mean over the chosen partners."""
    per_partner = metrics.where(C(partner).isin(*partners)).groupBy(partner).agg(F.avg(metric).alias("m"))
    return per_partner.agg(F.avg("m").alias("objective"))


def cv_partner_performance(scores: DataFrame, fold: str, partner: str, score: str = "score",
                           label: str = "ytrue", weight: str | None = None) -> DataFrame:
    """Per fold and partner AP and ROC AUC, next to the fold's overall values."""
    per = group_metrics(curve_counts(scores, score, label, [fold, partner], weight), [fold, partner])
    overall = group_metrics(curve_counts(scores, score, label, [fold], weight), [fold]).select(
        fold, C("auc_pr").alias("ovl_auc_pr"), C("auc_roc").alias("ovl_auc_roc"))
    return per.select(fold, partner, "auc_pr", "auc_roc").join(overall, fold)


def cv_summary(metrics: DataFrame, metric: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation of fold values."""
    return metrics.groupBy(*groups).agg(F.avg(metric).alias(f"{metric}_cv_mean"),
                                        F.stddev_samp(metric).alias(f"{metric}_cv_std"))

