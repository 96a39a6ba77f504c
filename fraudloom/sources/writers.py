"""Sinks: tables, metric sheets, evaluation reports, score responses, window tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.curves import group_metrics
from ..operators.prefix import running_sums

C = F.col
REPORT_POINTS = 10_000


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Detector x window sheet as one small headed CSV; the work before it keeps its own tasks."""
    write_table(df.repartition(1), path, "csv")


def evaluation_report(counts: DataFrame) -> DataFrame:
    """JSON documents (part, json): part 0 the areas, parts 1.. the curve points in descending score order.

    A curve part holds REPORT_POINTS points, so the report keeps every point and
    no document grows with the data.
    """
    head = group_metrics(counts).select(F.lit(0).alias("part"), F.to_json(F.struct(
        C("auc_pr").alias("average_precision"), C("auc_roc").alias("roc_auc"),
        C("total_applications").alias("applications"), C("actual_fraud").alias("fraud"))).alias("json"))
    placed = running_sums(counts.withColumn("one", F.lit(1)), "score", ["one"], ascending=False)
    points = placed.withColumn("part", F.floor((C("one_upto") - 1) / REPORT_POINTS).cast("int") + 1)
    point = F.struct((-C("score")).alias("o"), C("score").alias("threshold"), F.try_divide("fp", "n").alias("fpr"),
                     F.try_divide("tp", "p").alias("tpr"), (C("tp") / (C("tp") + C("fp"))).alias("precision"))
    packed = points.groupBy("part").agg(F.array_sort(F.collect_list(point)).alias("c"))

    def series(name):
        return F.transform("c", lambda x: x[name]).alias(name)

    body = packed.select("part", F.to_json(F.struct(
        series("threshold"), series("fpr"), series("tpr"), series("precision"))).alias("json"))
    return head.unionByName(body)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def score_response(app_id: Column, proba: Column, model: str = "model_v1") -> Column:
    """{"keyAttributes":{"scores":{model:{"probability_fraud":p}},"applicationId":id}}"""
    inner = F.struct(F.struct(proba.cast("double").alias("probability_fraud")).alias(model))
    return F.to_json(F.struct(F.struct(inner.alias("scores"), app_id.alias("applicationId")).alias("keyAttributes")))


def _exists(spark, path: str) -> bool:
    """Whether the folder holds a finished write (_SUCCESS), on any file system Spark can reach."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def materialise_windows(windows: DataFrame, path: str) -> DataFrame:
    """Write prepared windows once, partitioned by window_end; later calls reuse the files."""
    spark = windows.sparkSession
    if not _exists(spark, path):
        # rebalancing gathers a window's rows into few files and splits a hot window again
        windows.hint("rebalance", "window_end").write.mode("overwrite").partitionBy("window_end").parquet(path)
    return spark.read.parquet(path)
