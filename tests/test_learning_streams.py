"""Fitted stages, persistence, training jobs, and streams that equal batch."""

import json
import random
from collections import Counter

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fraudloom.catalog import features, learning
from fraudloom.ml import boosting, stages, train
from fraudloom.operators import encode
from fraudloom.session import scratch_path, settle
from fraudloom.streaming import jobs

C = F.col


def _levels(spark, n=1500):
    rows = [(i, "hot" if i % 3 == 0 else f"l{i % 400}", int(i % 7 == 0), float(i % 11) if i % 13 else None) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, level string, y int, x double")


def test_long_level_list_survives_saving(spark):
    df = _levels(spark)
    model = Pipeline(stages=[stages.LevelEncoder(columns=["level"], method="target", label="y")]).fit(df)
    assert model.stages[0].cold is not None
    path = scratch_path(spark, "levels")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = {r.id: r.level for r in model.transform(df).collect()}
    b = {r.id: r.level for r in again.transform(df).collect()}
    assert a == b and len(a) == 1500
    new = spark.createDataFrame([(1, "never seen", 0, 1.0)], df.schema)
    assert again.transform(new).first().level == pytest.approx(df.agg(F.avg("y")).first()[0])


def test_ordered_levels_do_not_leak_the_label(spark):
    rnd = random.Random(11)
    rows = [(i, f"l{i // 2}", rnd.randint(0, 1)) for i in range(3000)]  # two rows a level, labels are noise
    df = spark.createDataFrame(rows, "id bigint, level string, y int")

    def auc(values):
        pos, neg = ([v for v, y in values if y == k] for k in (1, 0))
        order = sorted(pos + neg)
        rank = {v: (order.index(v) + len(order) - order[::-1].index(v) - 1) / 2 for v in set(order)}
        return (sum(rank[v] for v in pos) - len(pos) * (len(pos) - 1) / 2) / (len(pos) * len(neg))

    stage = stages.LevelEncoder(columns=["level"], method="ordered", label="y", key="id")
    model = stage.fit(df)
    learned = [(r["level"], r["y"]) for r in stage.training_rows(df, model).collect()]
    assert len(learned) == 3000 and abs(auc(learned) - 0.5) < 0.04
    assert auc([(r["level"], r["y"]) for r in model.transform(df).collect()]) > 0.7  # totals hold the own label: for scoring only
    fitted = train.train_model(df, "y", exclude=["id"], choices={"encoder": "ordered", "key": "id", "tol": 0.0}, maxIter=3, maxDepth=3)
    held = spark.createDataFrame([(5000 + i, f"l{i // 2}", rnd.randint(0, 1)) for i in range(1000)], df.schema)
    assert abs(auc([(r["score"], r["y"]) for r in train.probability(fitted, held).collect()]) - 0.5) < 0.08


def test_ordered_rows_count_only_what_came_before(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None, i % 2) for i in range(60)], "id bigint, level string, y int")
    got = sorted(encode.ordered_rows(df, ["level"], "y", "id").collect(), key=lambda r: r["id"])
    assert [r["id"] for r in got] == list(range(60))
    for keep in (lambda i: i % 3 == 0, lambda i: i % 3 != 0):
        mine = [r for r in got if keep(r["id"])]
        # among n rows of a level the values are (earlier labels + prior) / (earlier rows + 1): one row sees none, one sees all others
        assert sum(abs(r["level"] - 0.5) < 1e-12 for r in mine) >= 1
        total = sum(r["y"] for r in mine)
        assert any(abs(r["level"] - (total - r["y"] + 0.5) / len(mine)) < 1e-12 for r in mine)


def test_scaler_methods(spark):
    df = _levels(spark)
    for method in ("standard", "minmax", "robust", "none"):
        for fill in ("mean", "constant"):
            out = stages.NumericScaler(columns=["x"], method=method, fill=fill).fit(df).transform(df)
            assert out.where(C("x").isNull()).count() == 0
    lo, hi = stages.NumericScaler(columns=["x"], method="minmax").fit(df).transform(df).agg(F.min("x"), F.max("x")).first()
    assert (lo, hi) == pytest.approx((0.01, 0.99))


def test_missing_handler(spark):
    df = _levels(spark).withColumns({"c": F.lit(1), "e": F.lit(None).cast("string")})
    model = stages.MissingHandler().fit(df)
    assert model.transform(df).columns == ["id", "level", "y", "x"]


def test_model_saves_and_scores_one_row(spark, sf):
    r = learning.save_load_model(spark, sf).first()
    assert r.rows == 1500 and r.largest_gap == 0.0


def test_trained_model_beats_chance(spark, sf):
    cv = train.cross_validate(learning.raw_training_rows(spark, sf), "ca_id", "dep_var", learning._fit(), folds=2)
    assert cv.agg(F.avg("auc_roc")).first()[0] > 0.8


def test_every_row_is_scored_out_of_fold_once(spark, sf):
    oof = learning.oof_predictions(spark, sf)
    assert oof.count() == oof.select("ca_id").distinct().count() == 1500


def test_attribution_adds_up(spark, sf):
    data = learning._assembled(spark, sf)
    model = train.boosted_trees("dep_var", **learning.TREES).fit(data)
    names = train.feature_names(data)
    table = {r.feature: r.importance for r in train.sampled_attribution(model, data, "ca_id", names).collect()}
    assert set(table) == set(names) and max(table, key=table.get) in ("k3", "k5", "requested_loan_amount", "partner")


def test_tuning_stops_and_ranks(spark, sf):
    data = learning._assembled(spark, sf)
    space = {"maxDepth": [2, 3], "stepSize": [0.1, 0.3]}
    trials = train.tune_search(data, "ca_id", "dep_var", lambda p: train.boosted_trees("dep_var", maxIter=2, **p).fit, space,
                               max_evals=3, patience=1, folds=2).collect()
    assert 2 <= len(trials) <= 3 and all(json.loads(t.params) for t in trials)
    best = [max(t.score for t in trials[:i + 1]) for i in range(len(trials))]
    assert all(b > a for a, b in zip(best, best[1:-1]))  # every trial but the last was a gain


def test_folds_fitted_side_by_side_equal_one_by_one(spark, sf):
    data = learning._assembled(spark, sf)
    fit = train.boosted_trees("dep_var", maxIter=2, maxDepth=2).fit
    together, alone = ({r.fold: (r.auc_pr, r.auc_roc) for r in train.cross_validate(
        data, "ca_id", "dep_var", fit, folds=3, workers=w).collect()} for w in (3, 1))
    assert set(together) == {0, 1, 2}
    for k, v in alone.items():
        assert together[k] == pytest.approx(v, abs=1e-9)


def test_front_stages_fill_fold_and_derive(spark, sf):
    raw = learning.raw_training_rows(spark, sf)
    done = {r.ca_id: r for r in PipelineModel(stages=learning._front()).transform(raw).collect()}
    assert len(done) == 1500 and set(next(iter(done.values())).asDict()) == {"ca_id", "dep_var", *learning.FEATURES}
    for r in raw.collect():
        d = done[r.ca_id]
        assert d.partner == ("CARS" if r.partner.startswith("AUTO") else r.partner.replace("%49", "I"))
        assert d.ida_ft_matchstatus == {0: "Partial Match", 1: "No Match", 2: "Missing"}.get(r.ca_id % 7, "Other")
        assert d.same_status == int(r.status_b is not None and r.status_a == "F")
        gap = None if r.seen_at is None else 0 if r.last_seen is None else r.ca_id % 40
        assert (d.last_seen_ft_days_since is None) == (gap is None)
        assert gap is None or int(d.last_seen_ft_days_since) == gap


def test_stream_features_equal_batch(spark, sf):
    batch = features.application_features_query(spark, sf)
    stream = learning.stream_features(spark, sf)
    assert sorted(map(str, batch.select(*sorted(batch.columns)).collect())) == sorted(
        map(str, stream.select(*sorted(stream.columns)).collect()))


def test_stream_scores_equal_batch(spark, sf):
    df = learning.raw_training_rows(spark, sf)
    want = {r.ca_id: r.score for r in train.probability(learning._fit()(df), df).select("ca_id", "score").collect()}
    rows = learning.stream_score(spark, sf).collect()
    got = {r.ca_id: json.loads(r.response)["keyAttributes"]["scores"]["model_v1"]["probability_fraud"] for r in rows}
    assert got == want


def test_upserts_keep_open_windows_from_the_state_alone(spark, monkeypatch):
    base, fixed = scratch_path(spark, "open"), {}
    schema = "ts timestamp, l string, r string, f int"

    def path(s, name):  # the same output and state at every start of the stream
        return fixed.setdefault(name, scratch_path(s, name))

    monkeypatch.setattr(jobs, "scratch_path", path)
    rows = []
    for step in range(3):
        new = [(f"2024-01-0{1 + step} 10:0{i}:00", "a" if i % 3 else None, "b", i % 2) for i in range(6)] + [("2024-01-01 22:30:00", "a", "b", 1)] * (step < 2)
        rows += new
        spark.createDataFrame(new, "ts string, l string, r string, f int").selectExpr("timestamp(ts) AS ts", "l", "r", "f").coalesce(1).write.mode("append").parquet(base)
        stream = jobs.stream_velocity(spark.readStream.schema(schema).parquet(base), "ts", "l", "r", "f", late="3 days")
        got = {(str(r["window_start"])[:10], r["from"]): (r["velocity"], round(r["fraud"], 9)) for r in jobs.run_upserts(stream, "velocity", ["window_start", "from", "to"]).collect()}
        want = {}
        for ts, left, _, f in rows:
            want.setdefault((ts[:10], left), []).append(f)
        assert got == {k: (len(v), round(sum(v) / len(v), 9)) for k, v in want.items()}
    # a batch that is written again replaces itself
    log = spark.read.parquet(fixed["velocity"])
    last = log.agg(F.max("batch")).first()[0]
    again = log.where(C("batch") == last).drop("batch").collect()
    spark.createDataFrame(again, log.drop("batch").schema).write.mode("overwrite").parquet(f"{fixed['velocity']}/batch={last}")
    assert jobs.latest(spark.read.parquet(fixed["velocity"]), ["window_start", "from", "to"]).count() == len(want)


def test_velocity_drops_late_rows_only(spark):
    base = scratch_path(spark, "late")
    rows = "SELECT TIMESTAMP'2024-01-0{d} {h}:00:00' AS ts, 'a' AS l, 'b' AS r, 1 AS f"
    schema = "ts timestamp, l string, r string, f int"
    out, state = scratch_path(spark, "late-out"), scratch_path(spark, "late-state")

    def push(day, hour):
        spark.sql(rows.format(d=day, h=hour)).write.mode("append").parquet(base)
        q = (jobs.stream_velocity(spark.readStream.schema(schema).parquet(base), "ts", "l", "r", "f")
             .writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
             .trigger(availableNow=True).start())
        q.awaitTermination()

    push(1, "10")
    push(1, "20")
    push(3, "05")   # closes day 1
    push(1, "21")   # too late for day 1
    push(5, "05")
    got = {str(r.window_start)[:10]: r.velocity for r in spark.read.parquet(out).collect()}
    assert got == {"2024-01-01": 2, "2024-01-03": 1}


def test_knn_imputer_stage(spark):
    rows = [(1, 0.0, 10.0), (2, 1.0, 20.0), (3, 50.0, 99.0), (4, 0.4, None), (5, None, 99.0)]
    df = spark.createDataFrame(rows, "id bigint, x double, t double")
    model = stages.KnnImputer(columns=["x", "t"], key="id", k=2).fit(df)
    path = scratch_path(spark, "knn-imputer")
    Pipeline(stages=[model]).fit(df).write().overwrite().save(path)
    got = {r.id: (r.x, r.t) for r in PipelineModel.load(path).transform(df).collect()}
    assert got[4] == (0.4, 15.0) and got[1] == (0.0, 10.0) and got[5][0] == pytest.approx(25.2)


@pytest.mark.parametrize("encoder", train.ENCODERS)
def test_every_encoder_choice_trains(spark, encoder):
    df = _levels(spark, 400)
    model = train.train_model(df, "y", exclude=["id"], choices={"encoder": encoder, "scaler": "robust"}, maxIter=1, maxDepth=2)
    assert train.probability(model, df).where(C("score").isNull()).count() == 0


def test_unknown_choice_is_refused(spark):
    with pytest.raises(ValueError):
        train.preprocess_by_type(_levels(spark, 5), "y", encoder="nope")


def test_permutation_importance_ignores_session_settings(spark):
    rows = [(i, int(i % 4 == 0), float(i % 4), float(i * 7919 % 101)) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, y int, useful double, noise double")
    data = VectorAssembler(inputCols=["useful", "noise"], outputCol="features").transform(df)
    model = train.boosted_trees("y", maxIter=2, maxDepth=2).fit(data)
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            out = train.permutation_importance(model, data, "id", "y", repeats=2, shard_rows=150)
            got.append({r.feature: round(r.importance, 9) for r in out.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and got[0]["useful"] > 0.2 > abs(got[0]["noise"])


def test_ranges_are_drawn_evenly_and_lazily():
    space = {"rate": train.Range(0.001, 0.3, log=True), "depth": train.Range(3, 9, whole=True), "share": train.Range(0.5, 1.0), "kind": ["a", "b"]}
    draws = list(train.draw_params(space, 400))
    assert draws == list(train.draw_params(space, 400)) and draws[:50] == list(train.draw_params(space, 50))
    assert len({tuple(d.values()) for d in draws}) == 400
    assert all(0.001 <= d["rate"] <= 0.3 and d["depth"] in range(3, 10) and 0.5 <= d["share"] <= 1 and d["kind"] in "ab" for d in draws)
    assert {d["depth"] for d in draws} == set(range(3, 10)) and 190 < sum(d["kind"] == "a" for d in draws) < 210
    for lo in range(10):  # every tenth of the range gets its tenth of the draws
        assert 36 <= sum(lo / 10 <= (d["share"] - 0.5) * 2 < (lo + 1) / 10 for d in draws) <= 44
    assert next(train.draw_points(space))["kind"] in "ab"


def test_search_runs_fifty_draws_and_stops_without_gain(spark, monkeypatch):
    seen = []

    def fake(df, key, label, fit, folds, seed=42):
        seen.append((fit, folds))
        return spark.createDataFrame([(fit,)], "auc_pr double")

    monkeypatch.setattr(train, "cross_validate", fake)
    df = spark.range(1)
    out = train.tune_search(df, "id", "y", lambda p: p["x"], {"x": train.Range(0.0, 1.0)}).collect()
    assert len(out) <= 50 and all(f == 10 for _, f in seen)
    best = max(range(len(seen)), key=lambda i: (seen[i][0], -i))
    assert len(seen) == min(50, best + 11)
    rising = iter(range(1000))
    assert train.tune_search(df, "id", "y", lambda p: float(next(rising)), {"x": train.Range(0.0, 1.0)}).count() == 50


def test_draws_are_distinct_and_need_no_listing():
    small = {"a": [1, 2], "b": ["x", "y", "z"]}
    every = train.draw_params(small, 50)
    assert len(every) == 6 and len({(d["a"], d["b"]) for d in every}) == 6
    huge = {f"p{i}": list(range(100)) for i in range(8)}
    draws = train.draw_params(huge, 50)
    assert len({tuple(d.values()) for d in draws}) == 50 and draws == train.draw_params(huge, 50)


def test_boosted_blocks_equal_the_library_trees(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, round(rnd.gauss(0, 3), 3), float(i % 5), rnd.choice([0.0, 1.5, -2.0])) for i in range(1200)]
    rows = [(*r, int(r[1] + r[2] + rnd.gauss(0, 1) > 2)) for r in rows]
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        spark.createDataFrame(rows, "id bigint, a double, b double, c double, y int"))
    params = {"maxIter": 4, "maxDepth": 3, "stepSize": 0.2}
    want = GBTClassifier(labelCol="y", featuresCol="features", seed=42, **params).fit(df)
    expected = {r.id: r.score for r in train.probability(want, df).collect()}
    for part_rows in (200_000, 300):  # in one task, and a level at a time over four blocks
        monkeypatch.setattr(boosting, "PART_ROWS", part_rows)
        model = train.boosted_trees("y", **params).fit(df)
        got = {r.id: r.score for r in train.probability(model, df).collect()}
        assert len(got) == 1200 and all(got[i] == pytest.approx(expected[i], abs=1e-9) for i in got)
        assert model.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=1e-9)
        assert model.evaluateEachIteration(df) == pytest.approx(want.evaluateEachIteration(df), abs=1e-9)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_folds_share_the_front_stages(spark, sf, monkeypatch):
    written = []
    monkeypatch.setattr(train, "settle", lambda df, name: (written.append(name), settle(df, name))[1])
    cv = learning.cross_validate(spark, sf)
    assert cv.count() == 10 and written.count("folds") == 1 and "shaped" not in written


@pytest.mark.parametrize("table", [1 << 16, 4])
def test_shuffled_blocks_score_as_shuffled_rows(spark, monkeypatch, table):
    monkeypatch.setattr(boosting, "TABLE_SIZE", table)
    rnd = random.Random(8)
    rows = [(f"k{i}", round(rnd.gauss(0, 2), 2), float("nan") if i % 11 == 0 else float(i % 6), rnd.choice([0.0, 1.5]), 3.0) for i in range(900)]
    rows = [(*r, None if i % 50 == 0 else int(r[1] + r[3] + rnd.gauss(0, 1) > 1)) for i, r in enumerate(rows)]
    df = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features", handleInvalid="keep").transform(
        spark.createDataFrame(rows, "id string, a double, b double, c double, d double, y int"))
    model = train.boosted_trees("y", maxIter=5, maxDepth=4).fit(df.where("y is not null and not isnan(b)"))
    counted = []
    monkeypatch.setattr(train, "settle", lambda d, name: (counted.append(d.columns) if name == "permuted" else None, settle(d, name))[1])
    got = {r.feature: r.importance for r in train.permutation_importance(model, df, "id", "y", repeats=3, shard_rows=300).collect()}
    blocks = settle(train._permuted_blocks(model, _permuted(df), 4, 3, 42, 3), "t")
    singles = train._permuted_rows(model, _permuted(df), 4, 3, 42, 3).where("ytrue is not null")
    want = Counter((r.rep, r.f, r.ytrue, r.score) for r in singles.collect())
    assert Counter({(r.rep, r.f, r.ytrue, r.score): 0 for r in blocks.collect()}).keys() == want.keys()
    totals = Counter()
    for r in blocks.collect():
        totals[(r.rep, r.f, r.ytrue, r.score)] += r.n
    assert totals == want and blocks.count() < sum(want.values()) // 2 and counted == [["rep", "f", "ytrue", "score", "n"]]
    monkeypatch.setattr(train, "_permuted_blocks", train._permuted_rows)
    rowwise = {r.feature: r.importance for r in train.permutation_importance(model, df, "id", "y", repeats=3, shard_rows=300).collect()}
    assert got == pytest.approx(rowwise, abs=1e-12) and set(got) == {"a", "b", "c", "d"} and got["d"] == pytest.approx(0, abs=1e-12)


def _permuted(df):
    return df.select(F.col("id").alias("k"), F.col("y").alias("ytrue"), vector_to_array("features").alias("x"))


def _repeated_rows(spark):
    rnd = random.Random(6)
    rows = [(i, float(i % 7), rnd.choice([0.0, 1.5, -2.0]), float(rnd.randrange(4))) for i in range(1200)]
    rows = [(*r, int(r[1] + r[2] + rnd.gauss(0, 2) > 3)) for r in rows]
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        spark.createDataFrame(rows, "id bigint, a double, b double, c double, y int"))


@pytest.mark.parametrize("part_rows", [300, 20])  # all kinds in one task, and over several blocks
def test_kinds_of_rows_are_boosted_as_the_rows(spark, monkeypatch, part_rows):
    df = _repeated_rows(spark)
    kept = []
    monkeypatch.setattr(boosting, "PART_ROWS", part_rows)
    monkeypatch.setattr(boosting, "settle", lambda d, name: kept.append(settle(d, name)) or kept[-1])
    params = {"maxIter": 4, "maxDepth": 3, "stepSize": 0.2}
    want = GBTClassifier(labelCol="y", featuresCol="features", seed=42, **params).fit(df)
    model = train.boosted_trees("y", **params).fit(df)
    expected = {r.id: r.score for r in train.probability(want, df).collect()}
    assert {r.id: r.score for r in train.probability(model, df).collect()} == pytest.approx(expected, abs=1e-9)
    assert model.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=1e-9)
    assert len(kept) == 1 and kept[0].count() <= 7 * 3 * 4 * 2 and kept[0].agg(F.sum("n")).first()[0] == 1200
    drawn = train.boosted_trees("y", subsamplingRate=0.5, **params).fit(df)
    assert drawn.featureImportances.toArray().sum() == pytest.approx(1.0) and drawn.trees[0]["value"][0] != model.trees[0]["value"][0]


def test_rows_are_attributed_where_they_lie(spark, monkeypatch):
    df = _repeated_rows(spark)
    df = df.unionByName(df.where("id < 20")).unionByName(df.where("id < 3").withColumn("id", F.lit(None).cast("long")))
    model = train.boosted_trees("y", maxIter=4, maxDepth=3).fit(df)
    exploded, asked = train._phi_exploded, []
    monkeypatch.setattr(train, "_phi_exploded", lambda m, base, *a: asked.append(base.count()) or exploded(m, base, *a))
    got = {r.feature: r.importance for r in train.sampled_attribution(model, df, "id", ["a", "b", "c"]).collect()}
    monkeypatch.setattr(train, "BoostedTreesModel", int)
    want = {r.feature: r.importance for r in train.sampled_attribution(model, df, "id", ["a", "b", "c"]).collect()}
    assert asked == [43, 1223] and got == pytest.approx(want, abs=1e-9) and {"a", "b", "c"} <= set(got)
