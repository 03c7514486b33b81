"""Column expressions: distances, keys, activations, augmentations and schedules."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = None
    for p, q in zip(a, b, strict=True):
        d = p - q
        total = d * d if total is None else total + d * d
    return total


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(squared_distance(a, b))


def floored(value: Column, least: float) -> Column:
    return F.greatest(value, F.lit(least))


def order_key(pid: Column) -> Column:
    """A fixed scrambling of ids, the same in any SQL engine (64-bit arithmetic, ids below 2^32)."""
    return (pid * F.lit(1103515245) + F.lit(12345)) % F.lit(2147483648)


def unit_number(pid: Column, salt: int = 0) -> Column:
    """A fixed number in [0, 1) for an id."""
    return order_key(pid + F.lit(salt)) / F.lit(2147483648.0)


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.exp(x) - 1)


def linear(columns: Sequence[Column], weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> list[Column]:
    """Outputs of a 1x1 convolution with given weights[input][output]."""
    out = []
    for o in range(len(weights[0])):
        total = F.lit(float(bias[o])) if bias else F.lit(0.0)
        for c, row in zip(columns, weights, strict=True):
            total = total + c * F.lit(float(row[o]))
        out.append(total)
    return out


def mlp(columns: Sequence[Column], layers: Sequence[tuple]) -> list[Column]:
    """Linear maps with ELU after each but those marked plain: layers of (weights, bias[, 'plain'])."""
    out = list(columns)
    for weights, bias, *plain in layers:
        out = linear(out, weights, bias)
        if not plain:
            out = [elu(c) for c in out]
    return out


def row_softmax(columns: Sequence[Column]) -> list[Column]:
    """Softmax across columns of a row, shifted by their maximum."""
    top = F.greatest(*columns) if len(columns) > 1 else columns[0]
    parts = [F.exp(c - top) for c in columns]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return [p / total for p in parts]


def group_softmax(df: DataFrame, keys: Sequence[str], columns: Sequence[str], suffix: str = "_w") -> DataFrame:
    """Softmax of each column over the rows of a group, shifted by the group's maximum; one window sort for all columns."""
    w = Window.partitionBy(*keys)
    shifted = df.select("*", *[F.exp(F.col(c) - F.max(c).over(w)).alias(f"__e_{c}") for c in columns])
    return shifted.select(*df.columns, *[(F.col(f"__e_{c}") / F.sum(f"__e_{c}").over(w)).alias(f"{c}{suffix}") for c in columns])


def argmax(columns: Sequence[Column]) -> Column:
    """Place of the largest column, the first of equals."""
    top = F.greatest(*columns)
    out = F.lit(len(columns) - 1)
    for i in range(len(columns) - 2, -1, -1):
        out = F.when(columns[i] == top, F.lit(i)).otherwise(out)
    return out.cast("int")


def soft_label(label: Column, classes: int, on: float = 0.95, off: float = 0.05) -> list[Column]:
    return [F.when(label == i, F.lit(on)).otherwise(F.lit(off)) for i in range(classes)]


def rotated_z(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def rotated_y(x: Column, z: Column, angle: Column) -> tuple[Column, Column]:
    return x * F.cos(angle) - z * F.sin(angle), x * F.sin(angle) + z * F.cos(angle)


def normal_number(pid: Column, salt: int = 0) -> Column:
    """A fixed standard normal number for an id: two scrambled numbers by the Box-Muller transform."""
    first = order_key(pid + F.lit(salt))
    u, v = first / F.lit(2147483648.0), order_key(first) / F.lit(2147483648.0)
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-9)))) * F.cos(v * F.lit(2 * math.pi))


def jittered(x: Column, pid: Column, sigma: float = 0.01, salt: int = 0) -> Column:
    """A value with normal noise that is a fixed function of the point's id."""
    return x + normal_number(pid, salt) * sigma


def learning_rate(batch: Column, base: float, batch_size: int, decay_step: float, decay_rate: float, least: float | None = None) -> Column:
    """Staircase exponential decay; `least` is a floor, off by default."""
    rate = F.lit(base) * F.pow(F.lit(decay_rate), F.floor(batch * batch_size / F.lit(decay_step)))
    return rate if least is None else F.greatest(rate, F.lit(least))


def norm_decay(batch: Column, batch_size: int, step: float = 300000.0, rate: float = 0.5, start: float = 0.5, most: float = 0.99) -> Column:
    return F.least(F.lit(most), 1 - F.lit(start) * F.pow(F.lit(rate), F.floor(batch * batch_size / F.lit(step))))


def inside_box(x: Column, y: Column, cx: Column, cy: Column, radius: float) -> Column:
    """1.0 inside a square with its border, else 0.0."""
    return F.when((F.abs(x - cx) <= radius) & (F.abs(y - cy) <= radius), F.lit(1.0)).otherwise(F.lit(0.0))
