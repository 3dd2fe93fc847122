"""Vector expressions on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inner(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    return inner(a, b) / (norm(a) * norm(b))


def euclid(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalised(a: str, tiny: float = 1e-10) -> Column:
    return F.transform(a, lambda x: x / F.greatest(norm(a), F.lit(tiny)))


def valid(a: str, dim: int | None = None) -> Column:
    ok = F.col(a).isNotNull() & ~F.exists(a, lambda x: x.isNull())
    return ok & (F.size(a) == dim) if dim else ok


def centroid(df: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """Mean vector of each group, as rows by, ``centroid``; component sums combine early."""
    long = df.select(*by, F.posexplode(v).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return long.groupBy(*by).agg(ordered.alias("centroid"))


def band(s: Column) -> Column:
    """Label of a similarity: bounds 0.85, 0.7 and 0.5."""
    return F.when(s > 0.85, "very similar").when(s > 0.7, "similar").when(s > 0.5, "somewhat similar").otherwise("different")


def scaled(distance: Column) -> Column:
    """0 under a similarity of 0.5, else (similarity - 0.5) * 2."""
    s = 1 - distance
    return F.when(s >= 0.5, (s - 0.5) * 2).otherwise(0.0)


def usable(v: str) -> Column:
    """Whether a vector is there and its components are numbers whose products stay finite."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 1e150)), F.lit(False))
