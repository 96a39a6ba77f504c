"""Training, tuning, scoring and importance jobs on pyspark.ml."""

from __future__ import annotations

import itertools
import json
import math
import random
import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.util import inheritable_thread_target

from ..functions.geo import unscale_score
from ..operators.curves import average_precision, curve_counts, group_metrics
from ..operators.relational import hash_bucket, stratified_fold
from ..session import settle
from ..sources.writers import write_table
from . import stages
from .boosting import BoostedTrees, BoostedTreesModel, _binned, unlikely

C = F.col

#: names accepted as preprocess choices
IMPUTERS = ("mean", "constant", "knn", "none")
ENCODERS = ("woe", "target", "hash", "james_stein", "ordered")
SCALERS = ("standard", "minmax", "robust", "none")


def preprocess_by_type(df: DataFrame, label: str, exclude: Sequence[str] = (), imputer: str = "mean",
                       encoder: str = "woe", scaler: str = "standard", tol: float = 0.0017,
                       n_categories: int = 3, output: str = "features", key: str | None = None,
                       hash_size: int = 8, neighbours: int = 5) -> list:
    """Stages chosen from the schema: numbers are imputed and scaled, strings imputed, folded and encoded.

    The ``knn`` imputer needs the unique ``key`` column of the rows.
    """
    for name, value, known in (("imputer", imputer, IMPUTERS), ("encoder", encoder, ENCODERS), ("scaler", scaler, SCALERS)):
        if value not in known:
            raise ValueError(f"unknown {name} {value!r}; choose one of {known}")
    skip = {label, *exclude}
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    categorical = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]
    out = []
    if numeric and imputer == "knn":
        out.append(stages.KnnImputer(columns=numeric, key=key, k=neighbours))
    if numeric:
        out.append(stages.NumericScaler(columns=numeric, fill="mean" if imputer == "knn" else imputer, method=scaler))
    encoded = categorical
    if categorical:
        out += [stages.CategoricalImputer(columns=categorical),
                stages.LevelEncoder(columns=categorical, method="rare", tol=tol, n_categories=n_categories)]
        if encoder == "hash":
            out.append(stages.HashEncoder(columns=categorical, n=hash_size))
            encoded = [f"hash_{i}" for i in range(hash_size)]
        else:
            out.append(stages.LevelEncoder(columns=categorical, method=encoder, label=label, key=key))
    out.append(VectorAssembler(inputCols=[*numeric, *encoded], outputCol=output, handleInvalid="keep"))
    return out


def boosted_trees(label: str, features: str = "features", **params) -> BoostedTrees:
    settings = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 1.0, "seed": 42, **params}
    return BoostedTrees(label=label, features=features, **settings)


def boosting_params(max_depth: int = 5, learning_rate: float = 0.1, n_estimators: int = 20, subsample: float = 1.0,
                    min_child_weight: int = 1, gamma: float = 0.0) -> dict:
    """Common booster argument names as the params of ``boosted_trees``."""
    return {"maxDepth": max_depth, "stepSize": learning_rate, "maxIter": n_estimators, "subsamplingRate": subsample,
            "minInstancesPerNode": max(1, int(min_child_weight)), "minInfoGain": gamma}


def train_model(df: DataFrame, label: str, front: Sequence = (), exclude: Sequence[str] = (),
                choices: Mapping | None = None, **tree_params) -> PipelineModel:
    """Parse and feature stages, preprocess by type and boosted trees as one fitted object."""
    front_model = Pipeline(stages=list(front)).fit(df)
    # scaler and levels each read the shaped rows; the trees read the assembled ones several times
    shaped = settle(front_model.transform(df), "shaped") if front else df
    back = stages.fit_stages([*preprocess_by_type(shaped, label, exclude, **(choices or {})), boosted_trees(label, **tree_params)],
                             shaped, lambda rows: settle(rows.select(label, "features"), "assembled"))
    return PipelineModel(stages=[*front_model.stages, *back.stages])


def probability(model, df: DataFrame, out: str = "score") -> DataFrame:
    """Adds the probability of class 1; works for any number of rows."""
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability")


def scores_table(scored: DataFrame, key: str, label: str, score: str, base: str, **extras: str) -> DataFrame:
    """(key, score, ytrue, unscaled base score) and renamed raw columns."""
    return scored.select(key, C(score).alias("yscore"), C(label).alias("ytrue"),
                         unscale_score(C(base)).alias("unscaled_base_score"),
                         *[C(src).alias(name) for name, src in extras.items()])


def stage_outputs(model: PipelineModel, df: DataFrame) -> list[DataFrame]:
    """The table after each stage prefix (lazy)."""
    return [PipelineModel(stages=model.stages[:k]).transform(df) for k in range(1, len(model.stages) + 1)]


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


Fit = Callable[[DataFrame], object]


_FOLD_TABLES: WeakKeyDictionary = WeakKeyDictionary()


def fold_table(df: DataFrame, key: str, label: str, folds: int = 10, seed: int = 42) -> DataFrame:
    """The rows with their fold, written once for a ``df``: every fold, trial and round reads the same files."""
    made = _FOLD_TABLES.setdefault(df, {})
    if (key, label, folds, seed) not in made:
        made[key, label, folds, seed] = settle(stratified_fold(df, key, label, folds, seed), "folds")
    return made[key, label, folds, seed]


def side_by_side(spark, work: Callable, items: Iterable, workers: int) -> list:
    """Results of independent fits in the order of ``items``, a few at a time: one small fit alone leaves most cores idle."""
    jobs = [inheritable_thread_target(spark)(partial(work, item)) for item in items]
    with ThreadPoolExecutor(max(1, min(workers, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def _fold_models(split: DataFrame, fit: Fit, folds: int, workers: int) -> list[tuple]:
    """(fold, fit time, model that did not see the fold) of every fold."""
    def one(k):
        t0 = time.perf_counter()
        model = fit(split.where(C("fold") != k).drop("fold"))
        return k, time.perf_counter() - t0, model
    return side_by_side(split.sparkSession, one, range(folds), workers)


def _fold_scores(split: DataFrame, key: str, label: str, models: list[tuple]) -> DataFrame:
    # the fold is known here, and a model that selects its columns does not hand it on
    fold = split.schema["fold"].dataType
    parts = [probability(model, split.where(C("fold") == k)).select(
        key, F.lit(k).cast(fold).alias("fold"), C(label).alias("ytrue"), "score") for k, _, model in models]
    return reduce(DataFrame.unionByName, parts)


def out_of_fold(df: DataFrame, key: str, label: str, fit: Fit, folds: int = 10, seed: int = 42, workers: int = 8) -> DataFrame:
    """Every row scored by the model that did not see its fold: (key, fold, ytrue, score)."""
    split = fold_table(df, key, label, folds, seed)
    return _fold_scores(split, key, label, _fold_models(split, fit, folds, workers))


def cross_validate(df: DataFrame, key: str, label: str, fit: Fit, folds: int = 10, seed: int = 42, workers: int = 8) -> DataFrame:
    """(fold, auc_pr, auc_roc, fit_time, score_time); only these numbers reach the driver. Times are of folds that run together."""
    rows = _validated(fold_table(df, key, label, folds, seed), label, fit, folds, workers)
    return df.sparkSession.createDataFrame(
        rows, "fold int, auc_pr double, auc_roc double, fit_time double, score_time double")


def _validated(split: DataFrame, label: str, fit: Fit, folds: int, workers: int) -> list[tuple]:
    def one(k):
        t0 = time.perf_counter()
        model = fit(split.where(C("fold") != k).drop("fold"))
        t1 = time.perf_counter()
        scored = probability(model, split.where(C("fold") == k)).select(C(label).alias("ytrue"), "score")
        m = group_metrics(curve_counts(scored)).first()
        return k, m.auc_pr, m.auc_roc, t1 - t0, time.perf_counter() - t1
    return side_by_side(split.sparkSession, one, range(folds), workers)


@dataclass(frozen=True)
class Range:
    """A continuous search range; ``log`` spreads draws evenly over magnitudes, ``whole`` rounds them to whole numbers."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def at(self, u: float) -> float | int:
        if self.log:
            x = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        else:
            x = self.low + u * (self.high - self.low)
        x = min(max(x, self.low), self.high)
        return round(x) if self.whole else x


Space = Mapping[str, "Sequence | Range"]


def _van_der_corput(i: int, base: int) -> float:
    """The i-th point of the sequence that fills [0, 1) evenly: the digits of i in ``base``, mirrored at the point."""
    x, step = 0.0, 1.0
    while i:
        i, digit = divmod(i, base)
        step /= base
        x += digit * step
    return x


def _primes():
    found: list[int] = []
    for n in itertools.count(2):
        if all(n % q for q in found):
            found.append(n)
            yield n


def draw_points(space: Space, seed: int = 42):
    """Endless draws from a space with ranges, one at a time: a shifted low-discrepancy point per draw, a prime base per name."""
    rnd = random.Random(seed)
    axes = [(name, values, base, rnd.random()) for (name, values), base in zip(space.items(), _primes())]
    for i in itertools.count(1):
        at = {name: (_van_der_corput(i, base) + shift) % 1.0 for name, _, base, shift in axes}
        yield {name: v.at(at[name]) if isinstance(v, Range) else v[min(int(at[name] * len(v)), len(v) - 1)] for name, v, _, _ in axes}


def draw_params(space: Space, n: int, seed: int = 42):
    """n draws: low-discrepancy points if the space has a range, else distinct ones (all combinations when there are fewer)."""
    if any(isinstance(v, Range) for v in space.values()):
        return itertools.islice(draw_points(space, seed), n)
    total = math.prod(len(v) for v in space.values())
    draws = []
    for i in random.Random(seed).sample(range(total), min(n, total)):
        params = {}
        for name, values in space.items():
            i, at = divmod(i, len(values))
            params[name] = values[at]
        draws.append(params)
    return draws


def tune_search(df: DataFrame, key: str, label: str, make_fit: Callable[[dict], Fit], space: Space,
                max_evals: int = 50, patience: int = 10, folds: int = 10) -> DataFrame:
    """Trials (trial, params, score): cross-validated average precision, maximised; stops after ``patience`` without gain.

    All trials share one table of folds, as they cross-validate the same ``df``.
    """
    trials, best, since = [], float("-inf"), 0
    for i, params in enumerate(draw_params(space, max_evals)):
        score = cross_validate(df, key, label, make_fit(params), folds).agg(F.avg("auc_pr")).first()[0]
        trials.append((i, json.dumps(params, sort_keys=True), score))
        best, since = (score, 0) if score > best else (best, since + 1)
        if since >= patience:
            break
    return df.sparkSession.createDataFrame(trials, "trial int, params string, score double")


def feature_names(df: DataFrame, features: str = "features") -> list[str]:
    from ..operators.relational import vector_slot_names
    return vector_slot_names(df, features)


def importances(model, names: Sequence[str], spark) -> DataFrame:
    """(feature, importance) of a fitted tree ensemble: one row per feature."""
    values = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double")


def _slice_fit(label: str, names: Sequence[str], **tree_params) -> Fit:
    """Trees on a named subset of an assembled vector."""
    def fit(df):
        slicer = VectorSlicer(inputCol="features", outputCol="chosen", names=list(names))
        return Pipeline(stages=[slicer, boosted_trees(label, "chosen", **tree_params)]).fit(df)
    return fit


def eliminate_features(df: DataFrame, key: str, label: str, names: Sequence[str], step: int, folds: int = 5,
                       small_step: int | None = None, small_below: int = 200, importance: str = "tree",
                       permutations: int = 2, lists_path: str | None = None, workers: int = 8, **tree_params) -> DataFrame:
    """Recursive elimination: (num_features, auc_pr_cv_mean, auc_pr_cv_std).

    Each round cross-validates, averages the importance over folds and drops the
    ``step`` least important features (``small_step`` once fewer than ``small_below``),
    while more than ``step`` are left. With ``lists_path`` the ranked list of every
    round is written as CSV.
    """
    spark, left, rows = df.sparkSession, list(names), []
    split = fold_table(df, key, label, folds)
    while len(left) > step:
        models = _fold_models(split, _slice_fit(label, left, **tree_params), folds, workers)
        oof = _fold_scores(split, key, label, models)
        ap = average_precision(curve_counts(oof, groups=["fold"]), ["fold"])
        m = ap.agg(F.avg("auc_pr").alias("m"), F.stddev_samp("auc_pr").alias("s")).first()
        rows.append((len(left), m.m, m.s))
        if small_step and len(left) < small_below:
            step = small_step
        mean = {f: 0.0 for f in left}
        def importance_of(fitted):
            trees = fitted[-1].stages[-1]
            if importance == "tree":
                return dict(zip(left, trees.featureImportances.toArray()))
            table = sampled_attribution(trees, df, key, left, "features", permutations)
            return {r.feature: r.importance for r in table.collect()}  # one row per feature

        for values in side_by_side(spark, importance_of, models, workers):
            for f in left:
                mean[f] += float(values.get(f, 0.0)) / len(models)
        order = sorted(left, key=lambda f: (mean[f], f))
        if lists_path:
            ranked = [(f, mean[f]) for f in reversed(order)]
            write_table(spark.createDataFrame(ranked, "feature string, importance double").coalesce(1),
                        f"{lists_path}/{len(left)}_features", "csv")
        dropped = set(order[:step])
        left = [f for f in left if f not in dropped]
    return spark.createDataFrame(rows, "num_features int, auc_pr_cv_mean double, auc_pr_cv_std double")


def sampled_attribution(model, df: DataFrame, key: str, names: Sequence[str], features: str = "features",
                        permutations: int = 2, seed: int = 42) -> DataFrame:
    """(feature, importance): mean absolute sampled Shapley value over all rows.

    For each row and permutation the features switch from the background's values (their means) to the row's in a
    hashed order, and each switch is scored. Rows of one key count together: they, and any other model, take one exploded
    table; the other rows of a ``BoostedTreesModel`` are scored where they lie. Only the means are collected.
    """
    all_names = feature_names(df, features)
    pos = [all_names.index(n) for n in names]
    arr = vector_to_array(features)
    base = df.select(C(key).alias("k"), F.array(*[arr[i] for i in pos]).alias("x"))
    d = len(pos)
    # background: feature means (one small row)
    mean = base.agg(F.array(*[F.avg(C("x")[i]) for i in range(d)])).first()[0]
    if isinstance(model, BoostedTreesModel) and None not in mean:
        again, some = _repeated_keys(df, key)
        same = C("k").eqNullSafe(C("_k"))
        parts = _phi_in_place(model, base.join(again, same, "left_anti") if some else base, mean, permutations, seed)
        if some:
            parts = parts.unionByName(_phi_summed(_phi_exploded(model, base.join(again, same, "left_semi"), mean, permutations, seed)))
    else:
        parts = _phi_summed(_phi_exploded(model, base, mean, permutations, seed))
    labels = F.array(*[F.lit(n) for n in names])
    return parts.groupBy("feat").agg((F.sum("total") / F.sum("n")).alias("importance")).select(
        F.get(labels, C("feat")).alias("feature"), "importance")


_REPEATED: WeakKeyDictionary = WeakKeyDictionary()


def _repeated_keys(df: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """The keys with several rows (_k), written once for a ``df``, and whether there are any."""
    made = _REPEATED.setdefault(df, {})
    if key not in made:
        again = settle(df.groupBy(C(key).alias("_k")).count().where("count > 1").select("_k"), "repeated-keys")
        made[key] = again, not again.isEmpty()
    return made[key]


def _phi_summed(phi: DataFrame) -> DataFrame:
    return phi.groupBy("feat").agg(F.sum(F.abs("phi")).alias("total"), F.count("phi").alias("n"))


def _phi_in_place(model: BoostedTreesModel, base: DataFrame, mean: Sequence[float], permutations: int, seed: int) -> DataFrame:
    """(feat, total, n): sums of the absolute value of each feature over the rows of a batch, for keys that come once."""
    dims, by_tree, (cuts, _) = len(mean), model.by_tree(), model.bins()
    start = _binned(np.array([mean], dtype="float64"), cuts)
    hashes = F.array(*[F.xxhash64("k", F.lit(run), F.lit(i), F.lit(seed)) for run in range(1, permutations + 1) for i in range(dims)])

    def score(bins: np.ndarray) -> np.ndarray:
        margin = np.zeros(bins.shape[1])
        for step in by_tree(bins):
            margin += step
        return 1.0 - 1.0 / (1.0 + np.exp(2.0 * margin))

    def summed(batches):
        total, n = np.zeros(dims), 0
        for batch in batches:
            rows = np.arange(batch.num_rows)
            x = _binned(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dims), cuts)
            order = np.argsort(batch.column("h").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), permutations, dims), axis=2, kind="stable")
            phi = np.zeros((dims, len(rows)))
            for run in range(permutations):
                point = np.repeat(start, len(rows), axis=1)
                before = score(point)
                for step in range(dims):
                    feat = order[:, run, step]
                    point[feat, rows] = x[feat, rows]
                    after = score(point)
                    phi[feat, rows] += after - before
                    before = after
            total, n = total + np.abs(phi / permutations).sum(axis=1), n + len(rows)
        if n:
            yield pa.RecordBatch.from_pydict({"feat": pa.array(range(dims), pa.int32()), "total": pa.array(total), "n": pa.array([n] * dims, pa.int64())})

    return base.select("x", hashes.alias("h")).mapInArrow(summed, "feat int, total double, n bigint")


def _phi_exploded(model, base: DataFrame, mean: Sequence[float | None], permutations: int, seed: int) -> DataFrame:
    """(k, feat, phi) from one table of all switches; rows of one key come together."""
    d = len(mean)
    runs = base.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.struct(
        F.xxhash64(C("k"), C("run"), i, F.lit(seed)).alias("h"), i.alias("i"))))
    runs = runs.withColumn("order", F.transform(order, lambda o: o["i"])).withColumn("mu", F.array(*[F.lit(m).cast("double") for m in mean]))
    # each feature carries its place in the order, so a step only compares numbers: linear in the features
    placed = F.array_sort(F.transform("order", lambda f, p: F.struct(f.alias("f"), p.alias("p"))))
    steps = runs.withColumn("rank", F.transform(placed, lambda s: s["p"])).select("k", "run", "x", "mu", "rank", F.posexplode(
        F.concat(F.array(F.lit(-1)), C("order"))).alias("step", "feat"))
    point = F.transform("x", lambda v, i: F.when(F.get("rank", i) < C("step"), v).otherwise(F.get("mu", i)))
    mixed = steps.select("k", "run", "step", "feat", array_to_vector(point).alias(model.getFeaturesCol()))
    scored = model.transform(mixed).select("k", "run", "step", "feat", vector_to_array("probability")[1].alias("p"))
    per_run = scored.groupBy("k", "run").agg(F.array_sort(F.collect_list(F.struct("step", "feat", "p"))).alias("s"))
    diffs = per_run.select("k", F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(d)), lambda j: F.struct(
            F.get("s", j)["feat"].alias("feat"), (F.get("s", j)["p"] - F.get("s", j - 1)["p"]).alias("v")))).alias("d"))
    return diffs.groupBy("k", "d.feat").agg(F.avg("d.v").alias("phi"))


def permutation_importance(model, df: DataFrame, key: str, label: str, features: str = "features",
                           repeats: int = 10, seed: int = 42, shard_rows: int = 50_000) -> DataFrame:
    """(feature, importance): mean drop of average precision when one feature is shuffled.

    Rows are dealt into hash shards of about ``shard_rows``, whatever the session's settings; inside a
    shard the rows of two independent hash orders change features, which permutes
    the rows. All features and repeats are scored and evaluated by one grouped curve job. A shard of a
    ``BoostedTreesModel`` is scored as a block of binned rows and sends counts by score; other models score every changed vector.
    """
    names = feature_names(df, features)
    shards = max(1, -(-df.count() // shard_rows))
    permuted = _permuted_blocks if isinstance(model, BoostedTreesModel) else _permuted_rows
    base = df.select(C(key).alias("k"), C(label).alias("ytrue"), vector_to_array(features).alias("x"))
    scored = settle(permuted(model, base, len(names), repeats, seed, shards), "permuted")
    ap = settle(average_precision(curve_counts(scored, groups=["rep", "f"], weight="n", keep=False), ["rep", "f"]), "permuted-ap")
    whole = ap.where(C("f") == -1).select("auc_pr").scalar()
    labels = F.array(*[F.lit(n) for n in names])
    return ap.where(C("f") >= 0).groupBy("f").agg((whole - F.avg("auc_pr")).alias("importance")).select(
        F.get(labels, C("f")).alias("feature"), "importance")


def _copies(rows: DataFrame, repeats: int, seed: int, shards: int) -> DataFrame:
    """Each row once a repeat, in its hash shard."""
    copies = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return copies.withColumn("shard", F.pmod(F.xxhash64("k", "rep", F.lit(seed)), F.lit(shards)))


def _permuted_blocks(model: BoostedTreesModel, base: DataFrame, dims: int, repeats: int, seed: int, shards: int) -> DataFrame:
    """(rep, f, ytrue, score, n): how many rows of a shard have a score, with feature f of the other row; f is -1 for the rows as they are."""
    cuts, kind = model.bins()
    exchanged = model.exchanged()
    truth = F.when(C("ytrue") == 1, 1).when(C("ytrue").isNotNull(), 0).otherwise(-1)

    def binned(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            bins = np.stack([np.searchsorted(c, x[:, f]).astype(kind) for f, c in enumerate(cuts)], axis=1)
            yield pa.RecordBatch.from_pydict({"k": batch.column("k"), "y": batch.column("y"),
                                              "bins": pa.array([row.tobytes() for row in bins], pa.binary())})

    def counted(group: pa.Table) -> pa.Table:
        bins = np.frombuffer(b"".join(group["bins"].to_pylist()), kind).reshape(-1, dims)
        one, two = (np.argsort(group[c].to_numpy(), kind="stable") for c in ("one", "two"))
        y, rep = group["y"].to_numpy()[one], group["rep"][0].as_py()
        found = {"rep": [], "f": [], "ytrue": [], "margin": [], "n": []}
        for f, margin in exchanged(np.ascontiguousarray(bins[one].T), np.ascontiguousarray(bins[two].T)):
            if f < 0 and rep != 1:  # the rows as they are: once
                continue
            values, at = np.unique(margin, return_inverse=True)
            for label in (0, 1):
                n = np.bincount(at[y == label], minlength=len(values))
                some = np.flatnonzero(n)
                for column, part in (("rep", np.full(len(some), rep if f >= 0 else 0)), ("f", np.full(len(some), f)), ("ytrue", np.full(len(some), label)),
                                     ("margin", values[some]), ("n", n[some])):
                    found[column].append(part)
        return pa.table({c: pa.array(np.concatenate(v), pa.float64() if c == "margin" else pa.int64() if c == "n" else pa.int32())
                         for c, v in found.items()})

    key = base.schema["k"].dataType
    schema = T.StructType([T.StructField("k", key), T.StructField("y", T.IntegerType()), T.StructField("bins", T.BinaryType())])
    rows = settle(base.select("k", truth.alias("y"), "x").mapInArrow(binned, schema), "binned")
    orders = {"one": F.xxhash64("k", "rep", F.lit(1)), "two": F.xxhash64("k", "rep", F.lit(2))}
    dealt = _copies(rows, repeats, seed, shards).withColumns(orders).drop("k")
    counts = dealt.groupBy("rep", "shard").applyInArrow(counted, "rep int, f int, ytrue int, margin double, n bigint")
    return counts.select("rep", "f", "ytrue", (1.0 - unlikely(C("margin"))).alias("score"), "n")


def _permuted_rows(model, base: DataFrame, dims: int, repeats: int, seed: int, shards: int) -> DataFrame:
    """The same for any model: (rep, f, ytrue, score, n), n 1, from one table of all changed vectors."""
    from pyspark.sql import Window
    numbered = _copies(base, repeats, seed, shards)
    by = Window.partitionBy("rep", "shard")
    one = numbered.withColumn("r", F.row_number().over(by.orderBy(F.xxhash64("k", "rep", F.lit(1)), "k")))
    two = numbered.select("rep", "shard", C("x").alias("y"), F.row_number().over(
        by.orderBy(F.xxhash64("k", "rep", F.lit(2)), "k")).alias("r"))
    paired = one.join(two, ["rep", "shard", "r"])
    spread = paired.select("rep", "ytrue", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("f"))
    mixed = F.transform("x", lambda v, i: F.when(i == C("f"), F.get("y", i)).otherwise(v))
    shuffled = spread.select("rep", "f", "ytrue", array_to_vector(mixed).alias(model.getFeaturesCol()))
    plain = base.select(F.lit(0).alias("rep"), F.lit(-1).alias("f"), "ytrue",
                        array_to_vector("x").alias(model.getFeaturesCol()))
    return model.transform(shuffled.unionByName(plain)).select(
        "rep", "f", "ytrue", vector_to_array("probability")[1].alias("score"), F.lit(1).alias("n"))


def learning_curve(df: DataFrame, key: str, label: str, fit: Fit, folds: int = 3,
                   shares: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0), workers: int = 8) -> DataFrame:
    """(share, train_ap_mean, train_ap_std, valid_ap_mean, valid_ap_std, fit_time): nested hash samples, all folds."""
    # the bucket of a row is written with it: every fit and score reads it
    split = settle(fold_table(df, key, label, folds).withColumn("_u", hash_bucket(C(key), 100_000, 7)), "learning-folds")

    def one(run):
        share, k = run
        part = split.where((C("fold") != k) & (C("_u") < int(share * 100_000))).drop("fold", "_u")
        t0 = time.perf_counter()
        model = fit(part)
        took = time.perf_counter() - t0
        aps = []
        for side in (part, split.where(C("fold") == k)):
            s = probability(model, side).select(C(label).alias("ytrue"), "score")
            aps.append(average_precision(curve_counts(s)).first()[0])
        return share, *aps, took

    rows = side_by_side(df.sparkSession, one, itertools.product(shares, range(folds)), workers)
    runs = df.sparkSession.createDataFrame(rows, "share double, train_ap double, valid_ap double, fit_time double")
    return runs.groupBy("share").agg(
        F.avg("train_ap").alias("train_ap_mean"), F.stddev_pop("train_ap").alias("train_ap_std"),
        F.avg("valid_ap").alias("valid_ap_mean"), F.stddev_pop("valid_ap").alias("valid_ap_std"),
        F.avg("fit_time").alias("fit_time"))


def boosting_curve(model, train: DataFrame, test: DataFrame) -> DataFrame:
    """(round, train_loss, test_loss): mean log loss after each boosting round."""
    # the ensemble's loss is 2*log(1+exp(-2*y*F)) with y in {-1, 1}; half of it is the log loss of its probability
    a = model.evaluateEachIteration(train)
    b = model.evaluateEachIteration(test)
    rows = [(i + 1, x / 2, y / 2) for i, (x, y) in enumerate(zip(a, b))]
    return train.sparkSession.createDataFrame(rows, "round int, train_loss double, test_loss double")


def accuracy(df: DataFrame, prediction: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(F.avg((C(prediction) == C(label)).cast("double")).alias("accuracy"))


def logit_blend(df: DataFrame, label: str, score: str, proba: str, out: str = "blended") -> DataFrame:
    """Logistic regression on (base score, anomaly probability); L2 with unit inverse strength, no standardising."""
    vec = VectorAssembler(inputCols=[score, proba], outputCol="_xy")
    rows = vec.transform(df)
    n = rows.count()
    lr = LogisticRegression(labelCol=label, featuresCol="_xy", regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                            standardization=False)
    model = lr.fit(rows)
    return probability(model, rows, out).drop("_xy", "prediction")
