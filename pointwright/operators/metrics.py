"""Segmentation metrics from truth and prediction columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_counts(df: DataFrame, classes: int, mask: Column | None = None) -> DataFrame:
    """(class_id, gt, pos, tp) of every class from 0: one scan, each row counted under its truth and its prediction."""
    if mask is not None:
        df = df.where(mask)
    at = F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col("truth") == F.col("pred")).cast("int").alias("t")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t"))))
    sums = df.select(at.alias("s")).groupBy(F.col("s.c").cast("long").alias("class_id")).agg(F.sum("s.g").alias("gt"), F.sum("s.p").alias("pos"), F.sum("s.t").alias("tp"))
    every = df.sparkSession.range(classes).withColumnRenamed("id", "class_id")
    return every.join(sums, "class_id", "left").select("class_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gt", "pos", "tp")])


def iou(counts: DataFrame, eps: float = 0.0) -> DataFrame:
    """Adds iou = tp / (gt + pos - tp + eps); null where that is nothing."""
    return counts.withColumn("iou", F.try_divide(F.col("tp").cast("double"), F.col("gt") + F.col("pos") - F.col("tp") + F.lit(eps)))


def overall(df: DataFrame, eps: float = 0.0) -> DataFrame:
    """(oa): the share of rows whose prediction is the truth."""
    return df.agg(F.try_divide(F.sum((F.col("truth") == F.col("pred")).cast("double")), F.count("*") + F.lit(eps)).alias("oa"))


def report(df: DataFrame, classes: int, eps: float = 1e-8) -> DataFrame:
    """(class_id, iou, mean_iou, oa) of every class."""
    each = iou(class_counts(df, classes), eps)
    means = each.agg(F.avg("iou").alias("mean_iou")).crossJoin(overall(df, eps))
    return each.select("class_id", "iou").crossJoin(F.broadcast(means))  # one row


def masked_accuracy(df: DataFrame, mask: Column) -> DataFrame:
    """(seen, correct, accuracy) of the rows of the mask."""
    hit = (mask & (F.col("truth") == F.col("pred"))).cast("long")
    seen = F.sum(mask.cast("long"))
    return df.agg(seen.alias("seen"), F.sum(hit).alias("correct"), F.try_divide(F.sum(hit).cast("double"), seen).alias("accuracy"))


def class_accuracy(df: DataFrame, mask: Column) -> DataFrame:
    """(class_id, seen, accuracy) by true class, over the rows of the mask."""
    return df.where(mask).groupBy(F.col("truth").cast("long").alias("class_id")).agg(F.count("*").alias("seen"), F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy"))


def cross_entropy(df: DataFrame, logits: list[str], label: str = "label", weight: str | None = None) -> DataFrame:
    """(loss): mean of -log softmax at the label; weighted: the sum of weighted losses over the number of weights that are not 0."""
    top = F.greatest(*logits)
    total = sum((F.exp(F.col(c) - top) for c in logits), F.lit(0.0))
    own = F.lit(None).cast("double")
    for i, c in enumerate(logits):
        own = F.when(F.col(label) == i, F.col(c)).otherwise(own)
    loss = F.log(total) + top - own
    if weight is None:
        return df.agg(F.avg(loss).alias("loss"))
    return df.agg(F.try_divide(F.sum(loss * F.col(weight)), F.sum((F.col(weight) != 0).cast("long"))).alias("loss"))
