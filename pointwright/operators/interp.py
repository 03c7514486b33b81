"""Interpolation of features and class scores from near points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointwright.functions.columns import distance, floored, group_softmax

from .spatial import knn_join

CLOUD = "cloud"


def softmax_weights(pairs: DataFrame, least: float = 1e-10) -> DataFrame:
    """Adds w: a softmax over each query's neighbours of the reciprocal distance."""
    return group_softmax(pairs.withColumn("__r", 1.0 / floored(F.col("dist"), least)), [CLOUD, "qid"], ["__r"]).withColumnRenamed("__r_w", "w").drop("__r")


def _shares(pairs: DataFrame, column: str, least: float, extra: float = 0.0) -> DataFrame:
    """Adds <column>_s: reciprocals of a distance, by their sum over the query's neighbours (plus extra)."""
    w = Window.partitionBy(CLOUD, "qid")
    d = pairs.withColumn("__i", 1.0 / floored(F.col(column), least))
    return d.withColumn(f"{column}_s", F.col("__i") / (F.sum("__i").over(w) + extra)).drop("__i")


def weighted_sum(pairs: DataFrame, points: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(cloud, qid, columns): sums of w times the neighbours' columns."""
    met = pairs.join(points.select(CLOUD, F.col("pid").alias("nid"), *columns), [CLOUD, "nid"])
    return met.groupBy(CLOUD, "qid").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])


def three_nn(coarse: DataFrame, fine: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """Columns of the coarse points at the fine ones, by softmax weights of the k nearest."""
    return weighted_sum(softmax_weights(knn_join(coarse, fine, k)), coarse, columns)


def colour_spatial(coarse: DataFrame, fine: DataFrame, columns: Sequence[str], colours: Sequence[str] = ("r", "g", "b"), k: int = 3, share: float = 0.7, power: int = 2) -> DataFrame:
    """Columns by weights of colour (share) and spatial nearness; spatial distances to the given power."""
    return weighted_sum(_mixed(knn_join(coarse, fine, k), coarse, fine, colours, share, power, 0.0), coarse, columns)


def _mixed(pairs: DataFrame, coarse: DataFrame, fine: DataFrame, at: Sequence[str], share: float, power: int, extra: float) -> DataFrame:
    near = coarse.select(CLOUD, F.col("pid").alias("nid"), *[F.col(c).cast("double").alias(f"n_{c}") for c in at])
    own = fine.select(CLOUD, F.col("pid").alias("qid"), *[F.col(c).cast("double").alias(f"q_{c}") for c in at])
    met = pairs.join(near, [CLOUD, "nid"]).join(own, [CLOUD, "qid"])
    met = met.select(CLOUD, "qid", "nid", distance([F.col(f"n_{c}") for c in at], [F.col(f"q_{c}") for c in at]).alias("cd"), (F.col("dist") * F.col("dist") if power == 2 else F.col("dist")).alias("sd"))
    met = _shares(_shares(met, "cd", 1e-8, extra), "sd", 1e-8, extra)
    return met.select(CLOUD, "qid", "nid", (share * F.col("cd_s") + (1 - share) * F.col("sd_s")).alias("w"))


def geometry_filter(points: DataFrame, geometry: Sequence[str], columns: Sequence[str], k: int, rounds: int = 1, power: int = 2) -> DataFrame:
    """`rounds` times the columns averaged over the k nearest by likeness of geometry and nearness, half and half."""
    pairs = _mixed(knn_join(points, points, k), points, points, geometry, 0.5, power, 1e-8)
    got = weighted_sum(pairs, points, columns)
    return got.select(CLOUD, "qid", *[(F.col(c) * float(rounds)).alias(c) for c in columns])
