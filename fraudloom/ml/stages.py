"""pyspark.ml stages for the cleaning, feature and encoding steps.

Plain transformers hold their settings as one JSON param, so they save and load
with any Pipeline. Fitted models hold bounded statistics as JSON; level tables
that are longer than HOT_LEVELS keep the rest as a parquet table beside it.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, Window, functions as F

from ..anomaly.knn import knn_table
from ..functions import dates, missing, text
from ..operators import encode, relational
from ..operators.skew import join_unique
from ..session import settle

C = F.col
HOT_LEVELS = 200


class _Configured(Params):
    config = Param(Params._dummy(), "config", "settings as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, **settings):
        super().__init__()
        self._set(config=json.dumps(settings))

    @property
    def settings(self) -> dict:
        return json.loads(self.getOrDefault(self.config))


class _Stage(_Configured, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    pass


class FeatureSelector(_Stage):
    """feature_names: keep those that exist, in table order."""

    def _transform(self, df):
        return relational.select_existing(df, self.settings["feature_names"])


class FeatureDropper(_Stage):
    """feature_to_drop: drop those that exist."""

    def _transform(self, df):
        return relational.drop_existing(df, self.settings["feature_to_drop"])


class DataIntegrity(_Stage):
    """date_vars, numeric_vars, categorical_vars: coerce types."""

    def _transform(self, df):
        s = self.settings
        return relational.coerce_types(df, s.get("date_vars", []), s.get("numeric_vars", []),
                                       s.get("categorical_vars", []), null_as=s.get("null_as"))


class Parsing(_Stage):
    """unclean_vars are percent-decoded; regex_match_vars [col, regex, level]; exact_match_vars [col, {level: [spellings]}]."""

    def _transform(self, df):
        s = self.settings
        df = text.url_decode_columns(df, s.get("unclean_vars", []))
        df = text.fold_levels_regex(df, [tuple(r) for r in s.get("regex_match_vars", [])])
        for col, levels in s.get("exact_match_vars", []):
            if col in df.columns:
                df = df.withColumn(col, text.fold_levels_exact(C(col), levels))
        return df


class DateMissing(_Stage):
    """datemissing_cols, reference_dict, imputation_col."""

    def _transform(self, df):
        s = self.settings
        return missing.impute_dates(df, s["datemissing_cols"], s.get("reference_dict", {}), s["imputation_col"])


class FeatureConsolidator(_Stage):
    """ida_vars, consolidation_vars, consolidation_mapping, match_vars."""

    def _transform(self, df):
        s = self.settings
        return missing.feature_consolidator(df, s.get("ida_vars", []), s.get("consolidation_vars", []),
                                            s.get("consolidation_mapping", {}), s.get("match_vars", []))


class DateFeatures(_Stage):
    """date_cols, timestamp_cols, todrop_cols, creation_col."""

    def _transform(self, df):
        s = self.settings
        return dates.date_feature_bundle(df, s.get("date_cols", []), s.get("timestamp_cols", []),
                                         s.get("todrop_cols", []), s["creation_col"])


class MissingIndicators(_Stage):
    """missingind_vars."""

    def _transform(self, df):
        return missing.missing_indicators(df, self.settings["missingind_vars"])


class CategoricalImputer(_Stage):
    """columns: null becomes 'Missing'."""

    def _transform(self, df):
        return missing.impute_categorical(df, self.settings["columns"])


class HashEncoder(_Stage):
    """columns, n: counts of column=level tokens in n hashed components."""

    def _transform(self, df):
        return encode.hash_encode(df, self.settings["columns"], self.settings["n"])


class _Fitted(_Configured, Model, DefaultParamsReadable, DefaultParamsWritable):
    pass


class MissingHandler(_Configured, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """missing_threshold (default 1): learn columns with at least that null share or one distinct value."""

    def _fit(self, df):
        limit = self.settings.get("missing_threshold", 1)
        protect = set(self.settings.get("protect", []))
        sparse = relational.null_fraction(df).where(C("null_fraction") >= limit).select("column")
        drop = sparse.union(relational.constant_columns(df)).distinct().collect()  # column names only
        return MissingHandlerModel(drop=sorted(r.column for r in drop if r.column not in protect))


class MissingHandlerModel(_Fitted):
    def _transform(self, df):
        return df.drop(*self.settings["drop"])


class NumericScaler(_Configured, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """columns; fill: mean, constant or none; method: standard, minmax, robust or none. One aggregate pass (two for robust)."""

    def _fit(self, df):
        s = self.settings
        cols, method, fill = s["columns"], s.get("method", "standard"), s.get("fill", "mean")
        filled = df
        plan = {c: {"fill": None, "shift": 0.0, "scale": 1.0, "base": 0.0} for c in cols}
        if fill == "mean":
            means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
            for c in cols:
                plan[c]["fill"] = 0.0 if means[c] is None else means[c]
        elif fill == "constant":
            for c in cols:
                plan[c]["fill"] = s.get("value", 99999999.0)
        if fill != "none":
            filled = df.na.fill({c: plan[c]["fill"] for c in cols})
        if method == "standard":
            row = filled.agg(*[a for c in cols for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
            for c in cols:
                plan[c] |= {"shift": row[f"m_{c}"] or 0.0, "scale": row[f"s_{c}"] or 1.0}
        elif method == "minmax":
            lo, hi = s.get("low", 0.01), s.get("high", 0.99)
            row = filled.agg(*[a for c in cols for a in (F.min(c).alias(f"l_{c}"), F.max(c).alias(f"h_{c}"))]).first()
            for c in cols:
                span = (row[f"h_{c}"] - row[f"l_{c}"]) if row[f"l_{c}"] is not None else 0.0
                plan[c] |= {"shift": float(row[f"l_{c}"] or 0.0), "scale": (span / (hi - lo)) or 1.0, "base": lo}
        elif method == "robust":
            rows = encode.column_quantiles(filled, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).collect()
            for r in rows:
                plan[r["column"]] |= {"shift": r.q50, "scale": (r.q75 - r.q25) or 1.0}
        return NumericScalerModel(plan=plan)


class NumericScalerModel(_Fitted):
    def _transform(self, df):
        out = {}
        for c, p in self.settings["plan"].items():
            x = C(c).cast("double")
            if p["fill"] is not None:
                x = F.coalesce(x, F.lit(float(p["fill"])))
            out[c] = (x - F.lit(float(p["shift"]))) / F.lit(float(p["scale"])) + F.lit(float(p["base"]))
        return df.withColumns(out)


class LevelEncoder(_Configured, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """columns, method (rare, woe, target, james_stein, ordered), label, tol, n_categories; key orders the rows of ``ordered``."""

    def _fit(self, df):
        s = self.settings
        cols, method = s["columns"], s["method"]
        if method == "rare":
            levels = encode.rare_label(df, cols, s.get("tol", 0.0017), s.get("n_categories", 3))
            rest = {c: encode.OTHERS for c in cols}
        else:
            levels = encode.encoded_levels(df, cols, s["label"], method)
            default = 0.0 if method == "woe" else float(df.agg(F.avg(s["label"])).first()[0] or 0.0)
            rest = {c: default for c in cols}
        # window group limit keeps this cheap: only HOT_LEVELS rows per column leave a task
        top = Window.partitionBy("column").orderBy(C("n").desc(), "level")
        levels = settle(levels, "levels")
        hot = levels.withColumn("r", F.row_number().over(top)).where(C("r") <= HOT_LEVELS).drop("r")
        rows = hot.collect()
        hot_map = {c: {} for c in cols}
        for r in rows:
            hot_map[r["column"]][r["level"]] = r["value"]
        sizes = {r["column"]: r["n"] for r in levels.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        long_cols = [c for c in cols if sizes.get(c, 0) > HOT_LEVELS]
        model = LevelEncoderModel(columns=cols, hot=hot_map, rest=rest, long=long_cols)
        if long_cols:
            model.cold = settle(levels.where(C("column").isin(long_cols))
                                .join(hot.select("column", "level"), ["column", "level"], "left_anti")
                                .select("column", "level", "value"), "levels")
        return model

    def training_rows(self, df, model):
        """What the next stage learns from: with ``ordered``, values that a row's own label has no part in."""
        s = self.settings
        if s["method"] != "ordered":
            return model.transform(df)
        return encode.ordered_rows(df, s["columns"], s["label"], s.get("key"))


def fit_stages(parts: list, df: DataFrame, ready=None) -> PipelineModel:
    """Fit stage after stage; a stage that has other rows for training than for scoring hands those on.

    ``ready`` is applied to the rows of the last stage.
    """
    fitted = []
    for i, part in enumerate(parts):
        if ready is not None and i + 1 == len(parts):
            df = ready(df)
        model = part.fit(df) if isinstance(part, Estimator) else part
        fitted.append(model)
        if i + 1 < len(parts):
            df = part.training_rows(df, model) if hasattr(part, "training_rows") else model.transform(df)
    return PipelineModel(stages=fitted)


class _TableModel(_Configured, Model, MLReadable, MLWritable):
    """A fitted stage that may hold a table (``cold``), saved as parquet beside its settings."""

    cold: DataFrame | None = None

    def write(self):
        return _TableWriter(self)

    @classmethod
    def read(cls):
        return _TableReader(cls)


class LevelEncoderModel(_TableModel):
    """The most frequent levels are a literal map; only longer level lists need a join."""

    def _transform(self, df):
        s = self.settings
        for c in s["columns"]:
            level = F.coalesce(C(c).cast("string"), F.lit(encode.MISSING))
            hot, rest = s["hot"][c], F.lit(s["rest"][c])
            pairs = [F.lit(x) for kv in hot.items() for x in kv]
            value = F.try_element_at(F.create_map(*pairs), level) if pairs else F.lit(None)
            if c in s["long"] and self.cold is not None:
                # rows with a hot level get a spread join key, so no key of this join is hot
                plain = [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]
                spread = F.concat(F.lit("\u0000"), F.xxhash64(*plain).cast("string"))
                key = F.when(level.isin(*hot), spread).otherwise(level)
                cold = self.cold.where(C("column") == c).select(C("level").alias("_k"), C("value").alias("_v"))
                df = df.withColumn("_k", key).join(cold, "_k", "left")
                df = df.withColumn(c, F.coalesce(value, C("_v"), rest)).drop("_k", "_v")
            else:
                df = df.withColumn(c, F.coalesce(value, rest))
        return df


class KnnImputer(_Configured, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """columns, key, k: a null takes the mean of the k nearest fitted rows that have the value.

    Distances use the other columns, scaled and mean-filled with the fitted statistics.
    """

    def _fit(self, df):
        s = self.settings
        cols = s["columns"]
        row = df.agg(*[a for c in cols for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
        model = KnnImputerModel(columns=cols, key=s["key"], k=s.get("k", 5), long=True,
                                mean={c: row[f"m_{c}"] or 0.0 for c in cols}, dev={c: row[f"s_{c}"] or 1.0 for c in cols})
        model.cold = settle(df.select(s["key"], *[C(c).cast("double").alias(c) for c in cols]), "donors")
        return model


class KnnImputerModel(_TableModel):
    def _vectors(self, df, target):
        s = self.settings
        others = [c for c in s["columns"] if c != target]
        z = [(F.coalesce(C(c).cast("double"), F.lit(s["mean"][c])) - s["mean"][c]) / s["dev"][c] for c in others]
        return df.select(C(s["key"]).alias("id"), F.lit("all").alias("window"), F.array(*z).alias("vec"), C(target).alias("_t"))

    def _transform(self, df):
        s, key = self.settings, self.settings["key"]
        fills = {}
        for c in s["columns"]:
            open_rows = self._vectors(df, c).where(C("_t").isNull())
            if len(s["columns"]) > 1 and not open_rows.isEmpty():
                donors = self._vectors(self.cold, c).where(C("_t").isNotNull())
                values = donors.select(C("id").alias("nbr"), "_t")
                nbrs = knn_table(open_rows, s["k"], donors)
                fills[c] = join_unique(nbrs, values, ["nbr"]).groupBy(C("id").alias(key)).agg(F.avg("_t").alias(f"_f_{c}"))
        for c, fill in fills.items():
            df = df.join(fill, key, "left").withColumn(c, F.coalesce(C(c).cast("double"), C(f"_f_{c}"))).drop(f"_f_{c}")
        return df


class _TableWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path):
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        if self.instance.cold is not None:
            self.instance.cold.write.parquet(f"{path}/cold")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        if model.settings["long"]:
            model.cold = self.sparkSession.read.parquet(f"{path}/cold")
        return model
