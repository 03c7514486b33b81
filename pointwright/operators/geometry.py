"""Local covariance and its eigen-features, in closed form as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import _written, knn_join, radius_moments

CLOUD = "cloud"
TINY = 1.1754943508222875e-38


def covariance(pairs: DataFrame, points: DataFrame, sample: bool = True) -> DataFrame:
    """(cloud, qid, n, xx, xy, xz, yy, yz, zz): covariance of each query's neighbours (divisor n-1, or n)."""
    met = pairs.select(CLOUD, "qid", "nid").join(points.select(CLOUD, F.col("pid").alias("nid"), "x", "y", "z"), [CLOUD, "nid"])
    cov = F.covar_samp if sample else F.covar_pop
    pairs_ = ("xx", "xy", "xz", "yy", "yz", "zz")
    return met.groupBy(CLOUD, "qid").agg(F.count("*").alias("n"), *[cov(F.col(p[0]), F.col(p[1])).alias(p) for p in pairs_])


def eigen(df: DataFrame) -> DataFrame:
    """Adds l1 >= l2 >= l3 of the symmetric matrix in xx .. zz (trigonometric solution; equal where isotropic)."""
    q = (F.col("xx") + F.col("yy") + F.col("zz")) / 3
    d = df.withColumn("__q", q)
    off = F.col("xy") * F.col("xy") + F.col("xz") * F.col("xz") + F.col("yz") * F.col("yz")
    a, b, c = (F.col(k) - F.col("__q") for k in ("xx", "yy", "zz"))
    d = d.withColumn("__p", F.sqrt((a * a + b * b + c * c + 2 * off) / 6))
    safe = F.when(F.col("__p") > 0, F.col("__p")).otherwise(F.lit(1.0))
    d = d.withColumn("__s", safe)
    a, b, c = ((F.col(k) - F.col("__q")) / F.col("__s") for k in ("xx", "yy", "zz"))
    e, f, g = (F.col(k) / F.col("__s") for k in ("xy", "xz", "yz"))
    det = a * (b * c - g * g) - e * (e * c - g * f) + f * (e * g - b * f)
    d = d.withColumn("__t", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3)
    d = d.withColumn("l1", F.col("__q") + 2 * F.col("__p") * F.cos("__t"))
    d = d.withColumn("l3", F.col("__q") + 2 * F.col("__p") * F.cos(F.col("__t") + F.lit(2 * math.pi / 3)))
    return d.withColumn("l2", 3 * F.col("__q") - F.col("l1") - F.col("l3")).drop("__q", "__p", "__s", "__t")


def share(value: Column, size: Column) -> Column:
    """value / size, NaN where the size is 0: neighbours that are all in one place have no shape."""
    return F.when(size == 0, F.lit(float("nan"))).otherwise(value / F.when(size != 0, size))


def normal(df: DataFrame) -> DataFrame:
    """Adds nx, ny, nz: absolute components of the unit vector of the smallest eigenvalue; null where it is not unique."""
    m = [[F.col("xx") - F.col("l3"), F.col("xy"), F.col("xz")], [F.col("xy"), F.col("yy") - F.col("l3"), F.col("yz")], [F.col("xz"), F.col("yz"), F.col("zz") - F.col("l3")]]
    d = df
    for name, (u, v) in {"a": (0, 1), "b": (0, 2), "c": (1, 2)}.items():
        x = m[u][1] * m[v][2] - m[u][2] * m[v][1]
        y = m[u][2] * m[v][0] - m[u][0] * m[v][2]
        z = m[u][0] * m[v][1] - m[u][1] * m[v][0]
        d = d.withColumn(f"__{name}", F.struct(x.alias("x"), y.alias("y"), z.alias("z"))).withColumn(f"__n{name}", F.sqrt(F.col(f"__{name}.x") * F.col(f"__{name}.x") + F.col(f"__{name}.y") * F.col(f"__{name}.y") + F.col(f"__{name}.z") * F.col(f"__{name}.z")))
    first = (F.col("__na") >= F.col("__nb")) & (F.col("__na") >= F.col("__nc"))
    second = F.col("__nb") >= F.col("__nc")
    size = F.greatest("__na", "__nb", "__nc")
    unique = (F.col("l2") - F.col("l3") > F.lit(1e-9) * F.col("l1")) & (size > 0)
    for c in "xyz":
        best = F.when(first, F.col(f"__a.{c}")).when(second, F.col(f"__b.{c}")).otherwise(F.col(f"__c.{c}"))
        d = d.withColumn(f"n{c}", F.when(unique, F.abs(best) / size))
    return d.drop("__a", "__b", "__c", "__na", "__nb", "__nc")


def features(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """(cloud, qid, e1, e2, e3, nx, ny, nz): eigenvalues by their norm, descending, and the normal."""
    return features_of(covariance(pairs, points))


def features_of(cov: DataFrame) -> DataFrame:
    """features() of covariances."""
    d = normal(eigen(cov))
    size = F.greatest(F.sqrt(F.col("l1") * F.col("l1") + F.col("l2") * F.col("l2") + F.col("l3") * F.col("l3")), F.lit(TINY))
    return d.select(CLOUD, "qid", *[F.greatest(F.abs(F.col(f"l{i}") / size), F.lit(TINY)).alias(f"e{i}") for i in (1, 2, 3)], "nx", "ny", "nz")


def intensity_variance(pairs: DataFrame, points: DataFrame, column: str = "intensity") -> DataFrame:
    """(cloud, qid, ivar): variance of the neighbours' intensity, with divisor n + 1e-8. Pairs that keep the column are not joined again."""
    if column in pairs.columns:
        met = pairs.select(CLOUD, "qid", F.col(column).alias("__i"))
    else:
        met = pairs.select(CLOUD, "qid", "nid").join(points.select(CLOUD, F.col("pid").alias("nid"), F.col(column).alias("__i")), [CLOUD, "nid"])
    return met.groupBy(CLOUD, "qid").agg((F.var_pop("__i") * F.count("*") / (F.count("*") + 1e-8)).alias("ivar"))


def variance_around(data: DataFrame, queries: DataFrame, radius: float, column: str = "intensity") -> DataFrame:
    """(cloud, qid, ivar): intensity_variance() of the points nearer than the radius, without a row for each pair."""
    d = radius_moments(data, queries, radius, (column,))
    return d.select(CLOUD, "qid", (F.col(f"c_{column}_{column}") / (F.col("n") + 1e-8)).alias("ivar"))


def covariance_around(data: DataFrame, queries: DataFrame, radius: float, sample: bool = True) -> DataFrame:
    """covariance() of the points nearer than the radius, without a row for each pair."""
    d = radius_moments(data, queries, radius, ("x", "y", "z"))
    by = F.col("n") - 1 if sample else F.col("n")
    return d.select(CLOUD, "qid", "n", *[F.when(by > 0, F.col(f"c_{a}_{b}") / by).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])


def covariance_radius_or_knn(data: DataFrame, queries: DataFrame, radius: float, k: int) -> DataFrame:
    """covariance() of radius_or_knn(): only the k nearest of queries with at most k points in the radius are pairs."""
    around = _written(covariance_around(data, queries, radius).where(F.col("n") > k))
    rest = _written(queries.join(around.select(CLOUD, F.col("qid").alias("pid")), [CLOUD, "pid"], "left_anti"))
    return around.unionByName(covariance(knn_join(data, rest, k), data))


def eigenvector(matrix: Column, index: Column) -> Column:
    """Column `index` of a matrix given as an array of rows."""
    return F.transform(matrix, lambda row: F.get(row, index))
