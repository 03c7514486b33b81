"""Class counters over a stream of predictions, kept by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prediction_stream(spark: SparkSession, path: str, schema: str = "truth long, pred long", files_per_trigger: int = 4) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_counts(stream: DataFrame) -> DataFrame:
    """(class_id, gt, pos, tp) of all rows so far: an aggregate that the state store keeps, one row a class."""
    at = F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col("truth") == F.col("pred")).cast("int").alias("t")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t"))))
    return stream.select(at.alias("s")).groupBy(F.col("s.c").alias("class_id")).agg(F.sum("s.g").alias("gt"), F.sum("s.p").alias("pos"), F.sum("s.t").alias("tp"))


def counts_to(stream: DataFrame, checkpoint: str, sink) -> None:
    """Process what has arrived and hand the updated counters of every micro-batch to sink(batch, number)."""
    running_counts(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
