"""Tiles of scenes: plain, shifted in four phases, and overlapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointwright.functions.columns import inside_box

CLOUD = "cloud"


def to_origin(df: DataFrame, columns: tuple[str, ...] = ("x", "y", "z"), keys: tuple[str, ...] = (CLOUD,)) -> DataFrame:
    """Coordinates less the cloud's minimum."""
    low = df.groupBy(*keys).agg(*[F.min(c).alias(f"__l{c}") for c in columns])
    moved = df.join(low, list(keys))
    return moved.select(*[(F.col(c) - F.col(f"__l{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def zero_mean(df: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Coordinates less their mean over the block."""
    w = Window.partitionBy(*keys)
    return df.select(*[(F.col(c) - F.avg(c).over(w)).alias(c) if c in columns else F.col(c) for c in df.columns])


def tiles(df: DataFrame, size: float, inner: float) -> DataFrame:
    """Adds i, j of the tile and inner (1.0 within `inner` of its centre on either axis, border included)."""
    t = df.withColumn("i", F.floor(F.col("x") / size)).withColumn("j", F.floor(F.col("y") / size))
    return t.withColumn("inner", inside_box(F.col("x"), F.col("y"), F.col("i") * F.lit(size) + F.lit(size / 2), F.col("j") * F.lit(size) + F.lit(size / 2), inner))


def at_least(df: DataFrame, keys: tuple[str, ...], count: int, value=None) -> DataFrame:
    """Rows of blocks with so many rows (or so large a sum of `value`)."""
    size = df.groupBy(*keys).agg((F.count("*") if value is None else F.sum(value)).alias("__n"))
    return df.join(size.where(F.col("__n") >= count).select(*keys), list(keys), "left_semi")


def phased_tiles(df: DataFrame, size: float, inner: float, stride: float) -> DataFrame:
    """Tiles of the cloud and of it shifted by the stride in x, in both and in y: phases 0 to 3, in one pass."""
    shift = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for p, dx, dy in ((0, 0.0, 0.0), (1, stride, 0.0), (2, stride, stride), (3, 0.0, stride))]))
    moved = df.withColumn("__s", shift)
    moved = moved.select(*[(F.col(c) + F.col("__s")[f"d{c}"]).alias(c) if c in ("x", "y") else F.col(c) for c in df.columns], F.col("__s")["phase"].alias("phase"))
    return tiles(moved, size, inner)


def overlap_tiles(df: DataFrame, size: float, inner: float) -> DataFrame:
    """Every tile (i, j) of stride `inner` whose box of `size` holds the point, border included; valid: in the inner box.

    Coordinates must begin at the origin. Each point is sent to the few tiles that may hold it,
    one pass over the cloud, and the exact test follows.
    """
    buffer = (size - inner) / 2
    top = df.groupBy(CLOUD).agg(F.ceil(F.max("x") / inner).alias("__nx"), F.ceil(F.max("y") / inner).alias("__ny"))
    out = df.join(top, CLOUD)
    for c, t in (("x", "i"), ("y", "j")):
        first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(c) - F.lit(inner + buffer)) / inner) - 1)
        last = F.least(F.col(f"__n{c}") - 1, F.floor((F.col(c) + F.lit(buffer)) / inner) + 1)
        out = out.withColumn(t, F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    ok, valid = F.lit(True), F.lit(True)
    for c, t in (("x", "i"), ("y", "j")):
        begin = F.col(t) * F.lit(inner)
        ok = ok & (F.col(c) <= begin + F.lit(inner) + F.lit(buffer)) & (F.col(c) >= begin - F.lit(buffer))
        valid = valid & (F.col(c) <= begin + F.lit(inner)) & (F.col(c) >= begin)
    return out.where(ok).select(*df.columns, "i", "j", valid.alias("valid"))


def strict_block(df: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Points strictly inside a box."""
    return df.where((F.col("x") > x0) & (F.col("x") < x1) & (F.col("y") > y0) & (F.col("y") < y1))
