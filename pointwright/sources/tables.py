"""Clouds and label tables derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scene_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six labelled scenes of points: cloud, pid, x, y, z, r, g, b, label, pred."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    at = lambda n: n / F.lit(1000.0)
    return o.select(
        F.concat(F.lit("Area_"), (key % 6 + 1).cast("string")).alias("cloud"), key.alias("pid"),
        at(F.round(F.col("o_totalprice") * 100).cast("long") % 5000).alias("x"), at(key * 7919 % 6000).alias("y"), at(key * 104729 % 3000).alias("z"),
        (key * 31 % 256).alias("r"), (key * 57 % 256).alias("g"), (cust * 13 % 256).alias("b"), (cust % 13).alias("label"), ((key * 7 + cust) % 13).alias("pred"),
    )


def vector_cloud(spark: SparkSession, sf_dir: str, by_label: bool = False) -> DataFrame:
    """Points from the first six components of the embeddings: one cloud, or one for each label."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda i: F.col("embedding")[i].cast("double")
    cloud = F.col("label").cast("string") if by_label else F.lit("all")
    return e.select(cloud.alias("cloud"), F.col("vec_id").alias("pid"), *[part(i).alias(c) for i, c in enumerate("xyzrgb")], F.col("label").cast("long").alias("label"))


def pred_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """truth, pred and mask of every line item."""
    line = table(spark, sf_dir, "lineitem")
    return line.select((F.col("l_suppkey") % 13).alias("truth"), (F.col("l_partkey") % 13).alias("pred"), (F.col("l_tax") > 0).alias("mask"))


def soft_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality as truth and toxic as prediction, two classes."""
    return table(spark, sf_dir, "labels").select(F.col("quality").cast("long").alias("truth"), F.col("toxic").cast("long").alias("pred"))


def intensity_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with an intensity from the events, three clouds by user."""
    e = table(spark, sf_dir, "events")
    key = F.col("event_id")
    return e.select((F.col("user_id") % 3).cast("string").alias("cloud"), key.alias("pid"), ((key * 7919) % 4000 / F.lit(1000.0)).alias("x"), ((key * 104729) % 4000 / F.lit(1000.0)).alias("y"), ((key * 1299709) % 2000 / F.lit(1000.0)).alias("z"), F.col("value").alias("intensity"))
