"""Structured Streaming forms of the feature, scoring and velocity jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..ml.train import probability
from ..session import scratch_path
from ..sources.writers import score_response

C = F.col


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """File stream over ``folder/name.parquet``, a file or a folder of part files; the schema comes from the batch reader."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run an available-now query into parquet in the shared folder and read the result back.

    The parquet sink commits each batch once, so a restarted query does not repeat rows.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", out)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_upserts(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Run an available-now query in update mode and read back the last state of every key, open windows included.

    Every batch writes the rows it changed to a folder named by its number, so a batch that is run again after a failure
    replaces what it had written. The state of a key is its row in the latest batch that changed it; the source is not read again.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    write(spark.createDataFrame([], stream.schema), -1)  # a stream without any batch has an empty table
    query = (stream.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    return latest(spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).parquet(out), keys)


def latest(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the highest ``batch`` for every key (null is a key like any other)."""
    values = [c for c in log.columns if c not in (*keys, "batch")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, *[C(f"_v.{c}").alias(c) for c in values])


def stream_features(stream: DataFrame, features: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same stateless feature plan as in batch, on a stream."""
    return features(stream)


def stream_score(stream: DataFrame, model, key: str, model_name: str = "model_v1") -> DataFrame:
    """(key, response): score a stream with a saved model and shape the response document."""
    scored = probability(model, stream)
    return scored.select(key, score_response(C(key), C("score"), model_name).alias("response"))


def stream_velocity(stream: DataFrame, ts: str, left: str, right: str, flag: str, window: str = "1 day",
                    late: str = "2 hours") -> DataFrame:
    """Velocity and mean flag per entity pair and event-time window; rows later than ``late`` are not counted.

    In append mode a window is emitted once the watermark passed its end; ``run_upserts`` keeps those still open as well.
    """
    return (stream.withWatermark(ts, late)
            .groupBy(F.window(ts, window).alias("w"), C(left).alias("from"), C(right).alias("to"))
            .agg(F.count(C(flag)).alias("velocity"), F.avg(C(flag)).alias("fraud"))
            .select(C("w.start").alias("window_start"), "from", "to", "velocity", "fraud"))

