"""Closed-form answers, properties and independence of partitioning for the score evaluation."""

import random

import pytest
from pyspark.sql import functions as F

from fraudloom.operators import cost, curves, prefix

SIX = [(.9, 1), (.8, 0), (.7, 1), (.6, 0), (.6, 1), (.1, 0)]


@pytest.fixture(scope="module")
def six(spark):
    return curves.curve_counts(spark.createDataFrame(SIX, "score double, ytrue int"))


def test_average_precision(six):
    # 1/3*1 + 1/3*2/3 + 1/3*3/5
    assert curves.average_precision(six).first()[0] == pytest.approx(0.755556, abs=1e-6)


def test_roc_auc(six):
    # pairs won by positives: .9 beats 3, .7 beats 2, .6 ties one and beats one
    assert curves.roc_auc(six).first()[0] == pytest.approx((3 + 2 + 1.5) / 9)


def test_curves_end_points(six):
    roc = curves.roc_curve(six).orderBy("fpr", "tpr").collect()
    assert (roc[0].fpr, roc[0].tpr) == (0, 0) and (roc[-1].fpr, roc[-1].tpr) == (1, 1)
    pr = curves.pr_curve(six).where("threshold is null").first()
    assert (pr.precision, pr.recall) == (1, 0)


def test_one_class_group_is_null(spark):
    df = spark.createDataFrame([("a", .5, 0), ("a", .6, 0), ("b", .5, 1), ("b", .2, 0)], "g string, score double, ytrue int")
    rows = {r.g: r for r in curves.group_metrics(curves.curve_counts(df, groups=["g"]), ["g"]).collect()}
    assert rows["a"].auc_roc is None and rows["a"].auc_pr is None
    assert rows["b"].auc_roc == 1.0


def _scores(spark, n=4000, seed=3, hot=0.34):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < hot else f"g{rnd.randint(0, 5)}",
             0.25 if rnd.random() < hot else round(rnd.random() ** 4, 4), int(rnd.random() < 0.2)) for _ in range(n)]
    return spark.createDataFrame(rows, "g string, score double, ytrue int"), rows


def test_auc_of_mirrored_scores(spark):
    df, _ = _scores(spark)
    a = curves.roc_auc(curves.curve_counts(df)).first()[0]
    b = curves.roc_auc(curves.curve_counts(df.withColumn("score", 1 - F.col("score")))).first()[0]
    assert a + b == pytest.approx(1.0)


def test_sweep_counts_add_up(spark):
    df, rows = _scores(spark)
    for r in curves.threshold_sweep(df).collect():
        want = [y for _, s, y in rows if 100 * s > r.threshold]
        assert r.predicted_fraud == len(want)
        assert r.precision == pytest.approx(sum(want) / len(want) if want else 0.0)
        assert r.total_applications == len(rows)


@pytest.mark.parametrize("parts", ["1", "64"])
def test_partition_count_does_not_matter(spark, parts):
    df, _ = _scores(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    base = {r.g: (r.auc_pr, r.auc_roc) for r in curves.group_metrics(curves.curve_counts(df, groups=["g"]), ["g"]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.g: (r.auc_pr, r.auc_roc) for r in curves.group_metrics(curves.curve_counts(df, groups=["g"]), ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for g, pair in base.items():
        assert got[g] == pytest.approx(pair)


@pytest.mark.parametrize("bucket,ascending", [(1 << 20, True), (100, True), (100, False), (7, True)])
def test_running_sums_with_hot_order_value(spark, monkeypatch, bucket, ascending):
    monkeypatch.setattr(prefix, "BUCKET_ROWS", bucket)
    rnd = random.Random(5)
    rows = [(i, "x" if i % 3 else None, 7.0 if rnd.random() < 0.4 else float(rnd.randint(0, 30)), rnd.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, g string, o double, v int")
    got = {r.id: (r.v_upto, r.v_all) for r in prefix.running_sums(df, "o", ["v"], ["g"], tie="id", ascending=ascending).collect()}
    for g in ("x", None):
        run, mine = 0, sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]), reverse=not ascending)
        total = sum(r[3] for r in mine)
        for r in mine:
            run += r[3]
            assert got[r[0]] == (run, total)


def test_buckets_come_from_the_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BUCKET_ROWS", 50)
    df = spark.createDataFrame([(i, float(i * 7919 % 2003)) for i in range(2000)], "id bigint, o double")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("1", "32"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            placed, side = prefix._two_levels(df, "o")
            sizes = [r["count"] for r in placed.groupBy("_top", "_bkt").count().collect()]
            assert side == 7 and max(sizes) <= 120 and len(sizes) > 30
            seen.append({r["id"]: r["o"] for r in prefix.running_sums(df, "o", ["id"]).select("id", F.col("id_upto").alias("o")).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    run = 0
    for i, o in sorted(((i, float(i * 7919 % 2003)) for i in range(2000)), key=lambda r: r[1]):
        run += i
        assert seen[0][i] == seen[1][i] == run


def test_exact_quantiles(spark):
    import numpy as np
    rnd = random.Random(9)
    vals = [1.0 if rnd.random() < .4 else rnd.gauss(0, 3) for _ in range(999)]
    df = spark.createDataFrame([("a", v) for v in vals], "g string, v double")
    r = prefix.exact_quantiles(df, "v", {"q1": .25, "q2": .5, "q9": .93}, ["g"]).first()
    assert (r.q1, r.q2, r.q9) == pytest.approx(tuple(np.quantile(vals, [.25, .5, .93])))


def test_mean_roc_against_interpolation(spark):
    import numpy as np
    df, rows = _scores(spark, 900)
    got = [r.mean_tpr for r in curves.mean_roc_curve(curves.curve_counts(df, groups=["g"]), "g").orderBy("point").collect()]
    tprs = []
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        pos, neg = sum(r[2] for r in mine), sum(1 - r[2] for r in mine)
        x, y = [0.0], [0.0]
        for s in sorted({r[1] for r in mine}, reverse=True):
            x.append(sum(1 for r in mine if r[1] >= s and not r[2]) / neg)
            y.append(sum(1 for r in mine if r[1] >= s and r[2]) / pos)
        t = np.interp(np.linspace(0, 1, 100), x, y)
        t[0] = 0
        tprs.append(t)
    want = np.mean(tprs, axis=0)
    want[-1] = 1
    assert got == pytest.approx(list(want))


def test_cost_saving(spark):
    df = spark.createDataFrame([(1, .01, True), (1, .9, False), (0, .01, True), (0, .9, False), (0, .01, False)], "y int, b double, a boolean")
    flagged = cost.augmented_prediction(df, "b", F.col("a"))
    r = cost.cost_saving(flagged, "y", []).first()
    assert (r.tcf, r.augmented_tcf) == (7000.0, 0.0)
    assert r.saving == pytest.approx(7000.0 - 0.22 * 0.10 * 5000)
    c = cost.dominance_check(flagged).first()
    assert c.added == c.changed == 2
