"""Balance scores of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINITE_INF = 9999.9


def imbalance(n1: Column, n2: Column) -> Column:
    return F.abs(F.log(n1.cast("double") / n2))


def magnitude(n1: Column, n2: Column, counted: bool = False) -> Column:
    return 1.0 / (n1 + n2) if counted else F.lit(0.0)


def finite(c: Column, empty_side: Column) -> Column:
    """The sentinel stands only in output; inside, an empty side is null."""
    return F.when(empty_side, F.lit(FINITE_INF)).otherwise(c)


def z_score(x: str, by: list[str]) -> Column:
    """(x - mean) / population deviation within a group; 0 where there is none."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(x).over(w)
    return F.when(sd > 1e-12, (F.col(x) - F.avg(x).over(w)) / sd).otherwise(0.0)


def fit_scaler(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def scaled_sum(metrics: list[str]) -> Column:
    """Sum of the metrics, each scaled by the columns of :func:`fit_scaler`."""
    return sum((F.when(F.col(f"sd_{m}") > 1e-12, (F.col(m) - F.col(f"mean_{m}")) / F.col(f"sd_{m}")).otherwise(0.0) for m in metrics), F.lit(0.0))


def apply_scaler(df: DataFrame, scaler: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return df.join(scaler, by).withColumn("score", scaled_sum(metrics))


def histogram(df: DataFrame, x: str, by: list[str], bins: int = 20) -> DataFrame:
    """Counts and mean by equal bins between the least and greatest value of all rows.  Values
    are amounts of two decimals, summed as such, so the mean does not depend on their order."""
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    d = df.join(F.broadcast(ends))  # one row
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return d.groupBy(*by, b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col(x).cast("decimal(16,2)")) / F.count(x).cast("decimal(12,0)")).alias("mean"))


def weighted_sum(metrics: dict[str, float]) -> Column:
    """Sum of the metrics, each times its weight."""
    return sum((F.col(c) * w for c, w in metrics.items()), F.lit(0.0))


def matched_distance(members: DataFrame, by: list[str], side: str, v: str = "v") -> DataFrame:
    """1 - similarity of the optimal matching of both sides of each cluster; null if one is empty."""
    from .similarity import matched_similarity

    return matched_similarity(members, by, side, v).select(*by, (1 - F.col("similarity")).alias("dist"))
