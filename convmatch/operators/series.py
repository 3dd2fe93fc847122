"""Message series: runs, hourly totals, gaps, sessions and change points."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import in_groups, whole_groups


def collapse_runs(df: DataFrame, by: list[str], value: list[str], order: list[str], ts: str) -> DataFrame:
    """Runs of equal values: first time and length; the first row starts run 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.lit(False)
    for v in value:
        new = new | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    new = F.coalesce(F.row_number().over(w) == 1, F.lit(False)) | new
    runs = df.withColumn("run_id", F.sum(new.cast("long")).over(w))
    return runs.groupBy(*by, "run_id", *value).agg(F.min(ts).alias("start"), F.count(F.lit(1)).alias("n"))


def hourly(df: DataFrame, ts: str, value: str | None = None, fill: bool = False) -> DataFrame:
    """Totals by hour; with ``fill`` hours without a row count 0."""
    total = F.sum(value) if value else F.count(F.lit(1))
    h = df.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(total.alias("total"))
    if not fill:
        return h
    span = h.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).where("lo is not null")
    hours = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("hour"))
    return hours.join(h, "hour", "left").withColumn("total", F.coalesce("total", F.lit(0)))


def gaps(df: DataFrame, by: list[str], order: list[str], ts: str) -> DataFrame:
    """Seconds since the series began and since the previous row (first: 0)."""
    w = Window.partitionBy(*by)
    o = w.orderBy(*order)
    sec = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    return df.withColumn("since_start", sec - F.min(sec).over(w)).withColumn("gap", F.coalesce(sec - F.lag(sec).over(o), F.lit(0.0)))


def gap_sessions(df: DataFrame, by: list[str], order: list[str], ts: str, seconds: float) -> DataFrame:
    """Session number of each row: a longer gap starts the next one."""
    o = Window.partitionBy(*by).orderBy(*order)
    return gaps(df, by, order, ts).withColumn("session", F.sum((F.col("gap") > seconds).cast("long")).over(o))


#: Rows up to which a series' kernel is held whole.
WHOLE_KERNEL = 2_000


def _features(x: np.ndarray, width: float, count: int) -> np.ndarray:
    """Fourier features: inner products of rows are about ``exp(-d * d / width)``.

    The frequencies are normal quantiles of an evenly spread sequence (the base of each
    dimension a prime), which for the few dimensions of a series errs less than random ones.
    """
    half = count // 2
    even = np.empty((half, x.shape[1]))
    primes = [p for p in range(2, 2 + 20 * x.shape[1]) if all(p % q for q in range(2, p))]
    normal = NormalDist().inv_cdf
    for d, base in enumerate(primes[: x.shape[1]]):
        for i in range(half):
            u, f, rest = 0.0, 1.0 / base, i + 1
            while rest:
                u, f, rest = u + f * (rest % base), f / base, rest // base
            even[i, d] = normal(u)
    turn = x @ (even.T * np.sqrt(2 / width))
    return np.hstack([np.cos(turn), np.sin(turn)]) / np.sqrt(half)


def _segment_sums(x: np.ndarray, whole: int):
    """``f(starts, t)``: the sums of the kernel over all pairs of rows of the segments [start, t).

    The kernel is Gaussian, its width the median squared distance.  Up to ``whole`` rows it is held
    itself; the sums of longer series come from prefix sums of Fourier features, in memory that
    grows with the rows.
    """
    n = len(x)
    if n <= whole:
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        med = np.median(d[np.triu_indices(n, 1)])
        k = np.exp(-np.clip(d / (med if med > 0 else 1.0), 1e-2, 1e2))
        np.fill_diagonal(k, 1.0)
        total = np.zeros((n + 1, n + 1))
        total[1:, 1:] = k.cumsum(0).cumsum(1)
        return lambda s, t: total[t, t] - total[s, t] - total[t, s] + total[s, s]
    r = np.random.default_rng(13)
    i, j = r.integers(0, n, 200_000), r.integers(0, n, 200_000)
    med = np.median(((x[i] - x[j]) ** 2).sum(1)[i != j])
    # as many as 200 MB of sums hold: the longer a series, the clearer a change in it has to be
    f = _features(x, med if med > 0 else 1.0, int(np.clip(25_000_000 // n, 256, 4096)) // 2 * 2)
    sums = np.vstack([np.zeros(f.shape[1]), f]).cumsum(0)
    return lambda s, t: ((sums[t] - sums[s]) ** 2).sum(1)


#: Rows of a segment at least.
LEAST = 3


def pelt(x: np.ndarray, min_size: int = LEAST, penalty: float | None = None, whole: int = WHOLE_KERNEL) -> list[int]:
    """Change points of the rows of ``x`` with the Gaussian-kernel cost, pruned search."""
    n = len(x)
    if n < 2 * min_size:
        return []
    penalty = np.log(n) if penalty is None else penalty
    block = _segment_sums(np.asarray(x, dtype=float), whole)
    best, prev, live = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.array([0])
    best[0] = -penalty
    for t in range(min_size, n + 1):
        ready = live[: np.searchsorted(live, t - min_size, side="right")]
        value = best[ready] + (t - ready) - block(ready, t) / (t - ready) + penalty
        i = int(value.argmin())
        best[t], prev[t] = value[i], ready[i]
        keep = np.ones(len(live), dtype=bool)
        keep[: len(ready)] = value - penalty <= best[t]
        live = np.append(live[keep], t)
    cuts, t = [], n
    while t > 0:
        t = int(prev[t])
        if t > 0:
            cuts.append(t)
    return sorted(cuts)


def change_sessions(df: DataFrame, by: list[str], order: list[str], x: list[str], key: str) -> DataFrame:
    """Session of each row by change points of ``x``; ``by`` must bound a series (say by day).

    A task runs over its series in one stream, so millions of short ones cost little more than
    their rows; one series is held at a time.
    """
    kinds = dict(df.dtypes)
    names = [f"_x{n}" for n in range(len(x))]

    def run(batches):
        for rows, start, size in whole_groups(batches):
            values = np.column_stack([rows[c].to_numpy() for c in names])
            session = np.zeros(len(values), dtype=np.int64)
            for s, n in zip(start.tolist(), size.tolist()):
                if n >= 2 * LEAST:
                    session[s : s + n] = np.searchsorted(pelt(values[s : s + n]), np.arange(n), side="right")
            yield from rows.select([*by, key]).append_column("session", pa.array(session)).to_batches()

    rows = df.select(*dict.fromkeys([*by, key, *order]), *[F.col(c).cast("double").alias(o) for c, o in zip(x, names)])
    rows = in_groups(rows, by, [F.col(c).asc_nulls_last() for c in order]).select(*by, key, *names, "_at", "_of")
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in [*by, key]) + ", session long")
