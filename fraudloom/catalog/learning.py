"""Queries of training, tuning, scoring, importances and streams.

Each one runs over its whole tables with the library's trees, ten folds and fifty trials with patience ten;
``choice_search``, which fits every preprocessing stage anew per fold and trial, runs fewer.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from ..ml import stages, train
from ..operators import relational as rel
from ..session import scratch_path, settle
from ..streaming import jobs
from .base import C, applications, query, rounded, tbl
from .features import FEATURE_PLAN_SQL, feature_plan, payloads, rounded_features
from .evaluation import augmented

TREES = {"maxIter": 20, "maxDepth": 5}
RANKS = {"low": 1, "mid": 2, "high": 3}
FEATURES = ["requested_loan_amount", "k3", "k5", "partner", "product_type", "nation", "ida", "ida_ft_matchstatus", "band",
            "same_status", "tmx_raw_time_zone", "ca_created_at_ft_dayofweek_sin", "ca_created_at_ft_dayofweek_cos", "ca_created_at_ft_is_holiday",
            "last_seen_ft_days_since", "last_seen_ft_dayofweek_sin", "last_seen_ft_dayofweek_cos"]


def training_rows(spark, sf):
    """Applications with numbers, dates and levels and a label that depends on them."""
    a = applications(spark, sf)
    risky = (C("requested_loan_amount") > 300000) & (C("ca_id") % 3 == 0) | (C("partner") == "BUILDING") & (C("ca_id") % 5 == 0)
    return a.select("ca_id", "ca_created_at", "requested_loan_amount", (C("ca_id") % 3).cast("double").alias("k3"),
                    (C("ca_id") % 5).cast("double").alias("k5"), "partner", "product_type",
                    F.when(C("ca_id") % 9 != 0, C("c_nationkey").cast("double")).alias("nation"),
                    risky.cast("int").alias("dep_var"))


def raw_training_rows(spark, sf):
    """The training rows as a vendor sends them: encoded text, dates as text with gaps, coded numbers, level pairs."""
    k = C("ca_id")
    seen = F.date_format(F.date_sub("ca_created_at", (k % 40).cast("int")), "yyyy-MM-dd HH:mm:ss")
    level = F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("high")), (k % 3).cast("int") + 1)
    return training_rows(spark, sf).withColumns({
        "partner": F.replace("partner", F.lit("I"), F.lit("%49")),
        "last_seen": F.when(k % 4 != 0, seen), "seen_at": F.when(k % 6 != 0, "web"),
        "ida": F.when(k % 7 == 0, -1.0).when(k % 7 == 1, -2.0).when(k % 7 != 2, C("requested_loan_amount") / 1000),
        "band_a": level, "band_b": F.when(k % 2 == 0, "mid"), "status_a": C("product_type"), "status_b": F.when(k % 5 != 0, "F"),
        "tmx_raw_time_zone": (k % 1441 - 720).cast("double")})


def _front():
    """Parsing, date gaps, types; consolidated columns, date features, the selected features."""
    return [stages.Parsing(unclean_vars=["partner"], exact_match_vars=[["product_type", {"OPEN": ["O"], "DONE": ["F"]}]],
                           regex_match_vars=[["partner", "^AUTO.*", "CARS"]]),
            stages.DateMissing(datemissing_cols=["last_seen"], reference_dict={"last_seen": "seen_at"}, imputation_col="ca_created_at"),
            stages.DataIntegrity(date_vars=["ca_created_at", "last_seen"], numeric_vars=["requested_loan_amount", "k3", "k5", "nation", "ida"],
                                 categorical_vars=["partner", "product_type"]),
            stages.FeatureConsolidator(ida_vars=["ida"], consolidation_vars=[["band", "band_a", "band_b"]], consolidation_mapping=RANKS,
                                       match_vars=[["same_status", "status_a", "status_b"]]),
            stages.DateFeatures(date_cols=["ca_created_at", "last_seen"], timestamp_cols=[], todrop_cols=["ca_created_at", "last_seen"],
                                creation_col="ca_created_at"),
            stages.FeatureSelector(feature_names=["ca_id", "dep_var", *FEATURES])]


def _fit(**params):
    def fit(df):
        return train.train_model(df, "dep_var", _front(), ["ca_id", "fold"], **{**TREES, **params})
    return fit


def _shaped(spark, sf):
    """The raw training rows behind the front stages, which learn nothing: all folds share them."""
    return PipelineModel(stages=_front()).transform(raw_training_rows(spark, sf))


def _fit_shaped(df):
    return train.train_model(df, "dep_var", [], ["ca_id", "fold"], **TREES)


def _assembled(spark, sf):
    """Numeric feature vectors with slot names, prepared once."""
    df = training_rows(spark, sf).drop("ca_created_at")
    back = Pipeline(stages=train.preprocess_by_type(df, "dep_var", ["ca_id"])).fit(df)
    return settle(back.transform(df).select("ca_id", "dep_var", "features"), "assembled")


@query("train_model")
def train_model(spark, sf):
    df = raw_training_rows(spark, sf)
    model = _fit()(df)
    return rounded(train.probability(model, df).select("ca_id", "score"), "score")


@query("save_load_model", "SELECT COUNT(*) AS rows, CAST(0 AS DOUBLE) AS largest_gap FROM orders JOIN customer ON o_custkey = c_custkey")
def save_load_model(spark, sf):
    df = raw_training_rows(spark, sf)
    model = _fit()(df)
    path = scratch_path(spark, "model")
    train.save_model(model, path)
    again = train.load_model(path)
    both = train.probability(model, df, "first").select("ca_id", "first").join(
        train.probability(again, df, "second").select("ca_id", "second"), "ca_id")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(C("first") - C("second"))).alias("largest_gap"))


@query("score_batch")
def score_batch(spark, sf):
    df = raw_training_rows(spark, sf)
    scored_rows = train.probability(_fit()(df), df)
    return rounded(scored_rows.select("ca_id", "score", "prediction"), "score")


@query("stage_outputs")
def stage_outputs(spark, sf):
    df = raw_training_rows(spark, sf)
    parts = train.stage_outputs(_fit()(df), df)
    out = None
    for i, p in enumerate(parts):
        row = p.agg(F.lit(i).alias("stage"), F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(p.columns)))
        out = row if out is None else out.unionByName(row)
    return out


@query("cross_validate")
def cross_validate(spark, sf):
    return train.cross_validate(_shaped(spark, sf), "ca_id", "dep_var", _fit_shaped, folds=10)


@query("oof_predictions")
def oof_predictions(spark, sf):
    return rounded(train.out_of_fold(_shaped(spark, sf), "ca_id", "dep_var", _fit_shaped, folds=10), "score")


@query("tune_search")
def tune_search(spark, sf):
    data = _assembled(spark, sf)
    space = {"maxDepth": train.Range(2, 5, whole=True), "stepSize": train.Range(0.05, 0.5, log=True),
             "maxIter": train.Range(3, 10, whole=True), "subsamplingRate": train.Range(0.6, 1.0)}
    return train.tune_search(data, "ca_id", "dep_var", lambda p: train.boosted_trees("dep_var", **p).fit, space,
                             max_evals=50, patience=10, folds=10)


@query("choice_search")
def choice_search(spark, sf):
    df = training_rows(spark, sf).drop("ca_created_at")

    def make(p):
        return lambda d: train.train_model(d, "dep_var", [], ["ca_id"], p, maxIter=2, maxDepth=2)

    return train.tune_search(df, "ca_id", "dep_var", make, {"encoder": list(train.ENCODERS), "scaler": ["standard", "robust"],
                                                            "imputer": ["mean", "constant"]}, max_evals=3, folds=2)


@query("rfe_importance")
def rfe_importance(spark, sf):
    data = _assembled(spark, sf)
    return train.eliminate_features(data, "ca_id", "dep_var", train.feature_names(data), step=2, folds=5, **TREES)


@query("rfe_attribution")
def rfe_attribution(spark, sf):
    data = _assembled(spark, sf)
    return train.eliminate_features(data, "ca_id", "dep_var", train.feature_names(data), step=2, folds=5, importance="shapley",
                                    permutations=2, **TREES)


@query("permutation_importance")
def permutation_importance(spark, sf):
    data = _assembled(spark, sf)
    model = train.boosted_trees("dep_var", **TREES).fit(data)
    return rounded(train.permutation_importance(model, data, "ca_id", "dep_var"), "importance")


@query("learning_curve")
def learning_curve(spark, sf):
    data = _assembled(spark, sf)
    return train.learning_curve(data, "ca_id", "dep_var", train.boosted_trees("dep_var", **TREES).fit, folds=10)


@query("boosting_curve")
def boosting_curve(spark, sf):
    split = rel.stratified_fold(_assembled(spark, sf), "ca_id", "dep_var", 5)
    fit_rows, test = split.where(C("fold") != 0), split.where(C("fold") == 0)
    model = train.boosted_trees("dep_var", maxDepth=3).fit(fit_rows)
    return train.boosting_curve(model, fit_rows, test)


@query("logit_blend")
def logit_blend(spark, sf):
    return rounded(train.logit_blend(augmented(spark, sf).select("ca_id", "ytrue", "base", "proba"), "ytrue", "base", "proba"), "blended")


# ---------------------------------------------------------------- streams


def _stored_payloads(spark, sf):
    """Payload rows written once as a folder a file stream can follow."""
    path = scratch_path(spark, "payload-stream")
    rows = payloads(spark, sf)
    rows.write.parquet(path)
    return path, rows.schema


@query("stream_features", FEATURE_PLAN_SQL)
def stream_features(spark, sf):
    path, schema = _stored_payloads(spark, sf)
    stream = spark.readStream.schema(schema).parquet(path)
    out = jobs.stream_features(stream, lambda df: feature_plan(df, spark, sf))
    return rounded_features(jobs.run_to_table(out, "features"))


@query("stream_score")
def stream_score(spark, sf):
    df = raw_training_rows(spark, sf)
    path = scratch_path(spark, "score-stream")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    return jobs.run_to_table(jobs.stream_score(stream, _fit()(df), "ca_id"), "responses")


@query("stream_velocity", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id AS "from", event_type AS "to",
  COUNT(*) AS velocity, round(AVG(CASE WHEN event_type = 'error' THEN 1.0e0 ELSE 0 END), 6) + 0.0 AS fraud FROM events GROUP BY 1, 2, 3""")
def stream_velocity(spark, sf):
    columns = {"ts": C("ts").cast("timestamp"), "flag": rel.map_flag(C("event_type"), "error")}
    e = jobs.stream_table(spark, sf, "events").withColumns(columns)
    out = jobs.run_upserts(jobs.stream_velocity(e, "ts", "user_id", "event_type", "flag"), "velocity", ["window_start", "from", "to"])
    return rounded(out, "fraud").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
