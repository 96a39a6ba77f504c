"""Queries of score evaluation, augmentation and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import unscale_score
from ..ml import train
from ..operators import cost, curves
from .base import AP, AUC, C, PR_AREA, SCORED, curve_sql, q6, query, rounded, scored, tbl
from .tables import CV_SQL, cv_scores

_CUM = f"WITH {SCORED}, {curve_sql('scored')}"
#: scores rounded to two digits have many ties
_TIED = f"WITH {SCORED}, tied AS (SELECT * REPLACE (round(score, 2) AS score) FROM scored), {curve_sql('tied')}"


def _counts(spark, sf, digits=None):
    s = scored(spark, sf)
    return curves.curve_counts(s if digits is None else s.withColumn("score", F.round("score", digits)))


@query("average_precision", f"{_TIED} SELECT {q6(AP)} AS auc_pr FROM cum")
def average_precision(spark, sf):
    return rounded(curves.average_precision(_counts(spark, sf, 2)), "auc_pr")


@query("roc_auc", f"{_TIED} SELECT {q6(AUC)} AS auc_roc FROM cum")
def roc_auc(spark, sf):
    return rounded(curves.roc_auc(_counts(spark, sf, 2)), "auc_roc")


@query("pr_curve", f"""{_CUM} SELECT {q6('score')} AS threshold, {q6('tp / (tp + fp)')} AS precision, {q6('tp / p')} AS recall FROM cum
  UNION ALL SELECT NULL, 1, 0""")
def pr_curve(spark, sf):
    return rounded(curves.pr_curve(_counts(spark, sf)), "threshold", "precision", "recall")


@query("pr_auc_trapezoid", f"{_TIED} SELECT {q6(PR_AREA)} AS pr_auc FROM cum")
def pr_auc_trapezoid(spark, sf):
    return rounded(curves.pr_auc_trapezoid(_counts(spark, sf, 2)), "pr_auc")


@query("roc_curve", f"""{_CUM} SELECT {q6('score')} AS threshold, {q6('fp / n')} AS fpr, {q6('tp / p')} AS tpr FROM cum UNION ALL SELECT NULL, 0, 0""")
def roc_curve(spark, sf):
    return rounded(curves.roc_curve(_counts(spark, sf)), "threshold", "fpr", "tpr")


_FOLD_CURVES = f"""{CV_SQL}, {curve_sql('cv', ('fold',))},
  pts AS (SELECT fold, fp, MAX(tp) AS hi, MIN(tp) AS lo, MAX(p) AS p, MAX(n) AS n FROM
          (SELECT fold, fp, tp, p, n FROM cum UNION ALL SELECT fold, 0, 0, MAX(p), MAX(n) FROM cum GROUP BY fold) GROUP BY fold, fp),
  seg AS (SELECT *, LEAD(fp) OVER w AS fp2, LEAD(lo) OVER w AS lo2 FROM pts WINDOW w AS (PARTITION BY fold ORDER BY fp)),
  rd AS (SELECT fold, i, CASE WHEN i = 0 THEN 0.0e0 ELSE (hi + (lo2 - hi) * (i / 99.0e0 * n - fp) / (fp2 - fp)) / p END AS t
         FROM seg, range(0, 99) r(i) WHERE i * n >= 99 * fp AND i * n < 99 * fp2
         UNION ALL SELECT DISTINCT fold, 99, 1.0e0 FROM seg)"""


@query("mean_roc_curve", f"""WITH {_FOLD_CURVES}
  SELECT i AS point, {q6('i / 99.0e0')} AS fpr, {q6('AVG(t)')} AS mean_tpr, {q6('greatest(AVG(t) - stddev_pop(t), 0)')} AS tpr_lower,
  {q6('least(AVG(t) + stddev_pop(t), 1)')} AS tpr_upper FROM rd GROUP BY i""")
def mean_roc_curve(spark, sf):
    c = curves.mean_roc_curve(curves.curve_counts(cv_scores(spark, sf), groups=["fold"]), "fold")
    return rounded(c, "fpr", "mean_tpr", "tpr_lower", "tpr_upper")


@query("mean_roc_auc", f"""WITH {_FOLD_CURVES}, a AS (SELECT fold, {AUC} AS auc FROM cum GROUP BY fold),
  m AS (SELECT i, AVG(t) AS t FROM rd GROUP BY i), area AS (SELECT (t + LAG(t) OVER (ORDER BY i)) / 2 / 99 AS s FROM m)
  SELECT {q6('(SELECT SUM(s) FROM area)')} AS mean_auc, {q6('stddev_pop(auc)')} AS std_auc, {q6('AVG(auc)')} AS avg_fold_auc FROM a""")
def mean_roc_auc(spark, sf):
    c = curves.curve_counts(cv_scores(spark, sf), groups=["fold"])
    return rounded(curves.mean_roc_auc(c, "fold"), "mean_auc", "std_auc", "avg_fold_auc")


@query("pooled_pr_curve", f"""WITH {CV_SQL}, two AS (SELECT CAST(fold AS VARCHAR) AS fold, round(score, 2) AS score, ytrue FROM cv
  UNION ALL SELECT 'pooled', round(score, 2), ytrue FROM cv), {curve_sql('two', ('fold',))}
  SELECT fold, score AS threshold, {q6('tp / (tp + fp)')} AS precision, {q6('tp / p')} AS recall FROM cum
  UNION ALL SELECT DISTINCT fold, NULL, 1.0e0, 0.0e0 FROM cum""")
def pooled_pr_curve(spark, sf):
    s = curves.with_pooled(cv_scores(spark, sf).withColumn("score", F.round("score", 2)), "fold")
    return rounded(curves.pr_curve(curves.curve_counts(s, groups=["fold"]), ["fold"]), "precision", "recall")


@query("model_comparison", f"""WITH {SCORED}, long AS (SELECT 'score' AS model, score, ytrue FROM scored
  UNION ALL SELECT 'fm_5_score', fm_5_score, ytrue FROM scored UNION ALL SELECT 'amount', requested_loan_amount, ytrue FROM scored),
  {curve_sql('long', ('model',))} SELECT model, {q6(AP)} AS auc_pr FROM cum GROUP BY model
  UNION ALL SELECT 'no_skill', {q6('AVG(ytrue)')} FROM scored""")
def model_comparison(spark, sf):
    s = scored(spark, sf).withColumnRenamed("requested_loan_amount", "amount")
    return rounded(curves.model_comparison(s, "ytrue", ["score", "fm_5_score", "amount"]), "auc_pr")


@query("model_curves", f"""WITH {SCORED}, long AS (SELECT 'score' AS model, score, ytrue FROM scored
  UNION ALL SELECT 'fm_5_score', fm_5_score, ytrue FROM scored), {curve_sql('long', ('model',))}
  SELECT model, {q6('score')} AS threshold, {q6('tp / (tp + fp)')} AS precision, {q6('tp / p')} AS recall FROM cum
  UNION ALL SELECT DISTINCT model, NULL, 1.0e0, 0.0e0 FROM cum
  UNION ALL SELECT 'no_skill', NULL, {q6('AVG(ytrue)')}, r FROM scored, (VALUES (0.0e0), (1.0e0)) v(r) GROUP BY r""")
def model_curves(spark, sf):
    return rounded(curves.model_curves(scored(spark, sf), "ytrue", ["score", "fm_5_score"]), "threshold", "precision", "recall")


@query("ks_statistic", f"""{_CUM} SELECT {q6('ks')} AS ks, {q6('threshold')} AS threshold FROM
  (SELECT abs(tp / p - fp / n) AS ks, score AS threshold FROM cum) ORDER BY ks DESC, threshold DESC LIMIT 1""")
def ks_statistic(spark, sf):
    return rounded(curves.ks_statistic(_counts(spark, sf)).select("ks", "threshold"), "ks", "threshold")


@query("labelled_documents_metrics", f"""WITH docs AS (SELECT source, documents.n_chars / 20000.0e0 AS score, toxic AS ytrue FROM documents JOIN labels USING (doc_id)),
  {curve_sql('docs', ('source',))} SELECT source, MAX(p + n) AS total_applications, MAX(p) AS actual_fraud,
  CASE WHEN MAX(p * n) > 0 THEN {q6("SUM(neg * (tp - pos / 2)) / nullif(MAX(p * n), 0)")} END AS auc_roc,
  CASE WHEN MAX(p * n) > 0 THEN {q6("SUM(pos / nullif(p, 0) * (tp / (tp + fp)))")} END AS auc_pr FROM cum GROUP BY source""")
def labelled_documents_metrics(spark, sf):
    d = tbl(spark, sf, "documents").join(tbl(spark, sf, "labels"), "doc_id").select(
        "source", (C("n_chars") / F.lit(20000.0)).alias("score"), C("toxic").alias("ytrue"))
    return rounded(curves.group_metrics(curves.curve_counts(d, groups=["source"]), ["source"]), "auc_roc", "auc_pr")


@query("threshold_sweep", f"""WITH {SCORED}, c AS (SELECT CAST(t AS INTEGER) AS threshold, COUNT(*) AS total_applications, CAST(SUM(ytrue) AS BIGINT) AS actual_fraud,
    COUNT(*) FILTER (100 * score > t) AS predicted_fraud, COUNT(*) FILTER (100 * score > t AND ytrue = 1) AS tp,
    COUNT(*) FILTER (100 * score > t AND ytrue = 0) AS fp, COUNT(*) FILTER (100 * score <= t AND ytrue = 1) AS fn,
    COUNT(*) FILTER (100 * score <= t AND ytrue = 0) AS tn FROM scored, range(0, 101) r(t) GROUP BY t)
  SELECT threshold, total_applications, actual_fraud, predicted_fraud, {q6('COALESCE(tp / nullif(tp + fp, 0), 0)')} AS precision,
  {q6('COALESCE(tp / nullif(tp + fn, 0), 0)')} AS recall, {q6('COALESCE(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1score,
  {q6('fp / (fp + tn)')} AS false_positive_rate, {q6('fn / (fn + tp)')} AS fraud_missed_rate, {q6('tp - 0.05e0 * fp - fn')} AS net_effect_fraud FROM c""")
def threshold_sweep(spark, sf):
    return rounded(curves.threshold_sweep(scored(spark, sf)), "precision", "recall", "f1score", "false_positive_rate",
                   "fraud_missed_rate", "net_effect_fraud")


@query("cv_partner_performance", f"""WITH {CV_SQL}, {curve_sql('cv', ('fold', 'partner'))}, {curve_sql('cv', ('fold',), name='ovl')},
  o AS (SELECT fold, {AP} AS ap, {AUC} AS auc FROM ovl GROUP BY fold)
  SELECT cum.fold, partner, {q6(AP)} AS auc_pr, {q6(AUC)} AS auc_roc, {q6('MAX(o.ap)')} AS ovl_auc_pr, {q6('MAX(o.auc)')} AS ovl_auc_roc
  FROM cum JOIN o ON cum.fold = o.fold GROUP BY cum.fold, partner""")
def cv_partner_performance(spark, sf):
    return rounded(curves.cv_partner_performance(cv_scores(spark, sf), "fold", "partner"),
                   "auc_pr", "auc_roc", "ovl_auc_pr", "ovl_auc_roc")


@query("cv_partner_weighted", f"""WITH {CV_SQL}, w AS (SELECT *, 1 + ca_id % 3 AS wt FROM cv), {curve_sql('w', ('fold', 'partner'), weight='wt')}
  SELECT fold, partner, {q6(AP)} AS auc_pr, {q6(AUC)} AS auc_roc FROM cum GROUP BY fold, partner""")
def cv_partner_weighted(spark, sf):
    s = cv_scores(spark, sf).withColumn("wt", 1 + C("ca_id") % 3)
    out = curves.cv_partner_performance(s, "fold", "partner", weight="wt")
    return rounded(out.select("fold", "partner", "auc_pr", "auc_roc"), "auc_pr", "auc_roc")


@query("score_with_extras", f"""WITH {SCORED} SELECT ca_id, {q6('score')} AS yscore, ytrue, {q6('(fm_5_score - 0.00197736842965041e0) / 1.22643393399164e0')} AS unscaled_base_score,
  partner AS channel, requested_loan_amount AS amount FROM scored""")
def score_with_extras(spark, sf):
    out = train.scores_table(scored(spark, sf), "ca_id", "ytrue", "score", "fm_5_score", channel="partner", amount="requested_loan_amount")
    return rounded(out, "yscore", "unscaled_base_score")


@query("cv_accuracy", f"""WITH {CV_SQL} SELECT fold, {q6('AVG(CASE WHEN CAST(score > 0.5 AS INTEGER) = ytrue THEN 1.0e0 ELSE 0 END)')} AS accuracy FROM cv GROUP BY fold""")
def cv_accuracy(spark, sf):
    s = cv_scores(spark, sf).withColumn("prediction", (C("score") > 0.5).cast("int"))
    return rounded(train.accuracy(s, "prediction", "ytrue", ["fold"]), "accuracy")


# ---------------------------------------------------------------- augmentation and cost

_DETECTORS = ("amount", "age")


def augmented(spark, sf):
    """Scored applications with the unscaled base score and an anomaly probability from the loan amount."""
    s = scored(spark, sf).where(C("fm_5_score").isNotNull())
    return s.withColumns({"base": unscale_score(C("fm_5_score")), "proba": C("requested_loan_amount") / F.lit(500000.0)})


_AUG = SCORED + """, aug AS (SELECT *, CAST(base > 0.05e0 AS INTEGER) AS base_pred, CAST(base > 0.05e0 OR proba > 0.7e0 AS INTEGER) AS augmented_pred
  FROM (SELECT *, (fm_5_score - 0.00197736842965041e0) / 1.22643393399164e0 AS base, requested_loan_amount / 500000.0e0 AS proba
        FROM scored WHERE fm_5_score IS NOT NULL))"""


def _aug(spark, sf):
    return cost.augmented_prediction(augmented(spark, sf), "base", C("proba") > cost.ANOMALY_CUT)


@query("augmented_prediction", f"WITH {_AUG} SELECT ca_id, base_pred, augmented_pred FROM aug")
def augmented_prediction(spark, sf):
    return _aug(spark, sf).select("ca_id", "base_pred", "augmented_pred")


_LONG = _AUG + """, lng AS (SELECT 'amount' AS detector, CAST(year(ca_created_at) AS INTEGER) AS window_end, ytrue, base_pred, augmented_pred FROM aug
  UNION ALL SELECT 'age', CAST(year(ca_created_at) AS INTEGER), ytrue, base_pred, CAST(base_pred = 1 OR ca_id % 50 = 0 AS INTEGER) FROM aug),
  cs AS (SELECT detector, window_end, COUNT(*) FILTER (base_pred = 0 AND ytrue = 1) * 7000.0e0 AS tcf,
    COUNT(*) FILTER (base_pred = 1 AND ytrue = 0) * (0.22e0 * 0.10e0 * 5000) AS tcol,
    COUNT(*) FILTER (augmented_pred = 0 AND ytrue = 1) * 7000.0e0 AS augmented_tcf,
    COUNT(*) FILTER (augmented_pred = 1 AND ytrue = 0) * (0.22e0 * 0.10e0 * 5000) AS augmented_tcol FROM lng GROUP BY 1, 2)"""


def _savings(spark, sf):
    a = augmented(spark, sf)
    flags = F.array(F.struct(F.lit("amount").alias("detector"), (C("proba") > cost.ANOMALY_CUT).alias("hit")),
                    F.struct(F.lit("age").alias("detector"), (C("ca_id") % 50 == 0).alias("hit")))
    rows = a.select("ytrue", "base", F.year("ca_created_at").alias("window_end"), F.explode(flags).alias("f")).select(
        "ytrue", "base", "window_end", "f.detector", "f.hit")
    return cost.cost_saving(cost.augmented_prediction(rows, "base", C("hit")), "ytrue", ["detector", "window_end"])


@query("cost_saving", f"""WITH {_LONG} SELECT detector, window_end, {q6('tcf', 4)} AS tcf, {q6('tcol', 4)} AS tcol, {q6('augmented_tcf', 4)} AS augmented_tcf,
  {q6('augmented_tcol', 4)} AS augmented_tcol, {q6('tcf + tcol - augmented_tcf - augmented_tcol', 4)} AS saving FROM cs""")
def cost_saving(spark, sf):
    return rounded(_savings(spark, sf), "tcf", "tcol", "augmented_tcf", "augmented_tcol", "saving", digits=4)


_YEARS = (1995, 1996, 1997, 1998, 1999, 2000, 2001)


@query("cost_matrix", f"WITH {_LONG} SELECT detector, " + ", ".join(
    f"""COALESCE({q6(f'SUM(tcf + tcol - augmented_tcf - augmented_tcol) FILTER (window_end = {y})', 4)}, 0) AS "{y}" """ for y in _YEARS)
    + " FROM cs GROUP BY detector")
def cost_matrix(spark, sf):
    return rounded(cost.cost_matrix(_savings(spark, sf), "detector", "window_end", _YEARS), *[str(y) for y in _YEARS], digits=4)


@query("dominance_adjust", f"WITH {_AUG} SELECT ca_id, {q6('CASE WHEN augmented_pred <> base_pred THEN proba ELSE base END')} AS adjusted_score FROM aug")
def dominance_adjust(spark, sf):
    return rounded(cost.dominance_adjust(_aug(spark, sf), "base", "proba").select("ca_id", "adjusted_score"), "adjusted_score")


@query("dominance_check", f"WITH {_AUG} SELECT CAST(SUM(augmented_pred) - SUM(base_pred) AS BIGINT) AS added, COUNT(*) FILTER (augmented_pred <> base_pred) AS changed FROM aug")
def dominance_check(spark, sf):
    return cost.dominance_check(_aug(spark, sf))


@query("lift_report", f"""WITH {_AUG}, adj AS (SELECT *, CASE WHEN augmented_pred <> base_pred THEN proba ELSE base END AS adjusted FROM aug),
  {curve_sql('adj', (), 'base', name='c1')}, {curve_sql('adj', (), 'adjusted', name='c2')},
  r AS (SELECT COUNT(*) FILTER (base_pred = 1 AND ytrue = 1) AS bt, COUNT(*) FILTER (base_pred = 1) AS b,
    COUNT(*) FILTER (augmented_pred = 1 AND ytrue = 1) AS att, COUNT(*) FILTER (augmented_pred = 1) AS a, COUNT(*) FILTER (ytrue = 1) AS f FROM adj)
  SELECT {q6('bt / b')} AS base_precision, {q6('att / a')} AS augmented_precision, {q6('bt / f')} AS base_recall, {q6('att / f')} AS augmented_recall,
  {q6(f'(SELECT {PR_AREA} FROM c1)')} AS pr_auc, {q6(f'(SELECT {PR_AREA} FROM c2)')} AS pr_auc_adj, {q6('att / f - bt / f')} AS recall_gain FROM r""")
def lift_report(spark, sf):
    df = cost.dominance_adjust(_aug(spark, sf), "base", "proba", "adjusted")
    out = cost.lift_report(df, "ytrue", "base", "adjusted")
    return rounded(out, *out.columns)


@query("contamination_flag", f"""WITH {SCORED}, cut AS (SELECT partner, quantile_cont(requested_loan_amount, 0.9) AS c FROM scored GROUP BY partner)
  SELECT ca_id, CAST(requested_loan_amount > c AS INTEGER) AS flag FROM scored JOIN cut USING (partner)""")
def contamination_flag(spark, sf):
    s = scored(spark, sf).select("ca_id", "partner", "requested_loan_amount")
    return cost.contamination_flag(s, "requested_loan_amount", 0.1, ["partner"]).select("ca_id", "flag")
