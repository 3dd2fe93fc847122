"""Quality statistics and robust outliers, with DataFrame functions only.

Base rules come first.  Then, for every language and source, the minimum covariance
determinant gives a location and a scatter that a quarter of outliers cannot move, and
documents far from it by Mahalanobis distance are rejected.  The estimates are regularised:
floors are added to the variances, and a group of ``n`` rows leans on the estimate of all
rows with a weight of ``prior / (n + prior)``, so groups of all sizes are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, WORD_SPLIT, columns, discard, left_out, written

_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Standard deviations below which a feature is not taken to vary (see ``features``).
_FLOORS = (0.15, 0.15, 0.12, 0.12)
_P = len(_FLOORS)
#: 0.5 quantile of chi-squared with four degrees of freedom (fixed value).
_CHI2_MEDIAN = 3.3566939800333224


def with_stats(docs: DataFrame, window: int = 8) -> DataFrame:
    """``docs`` (all columns) with a struct ``_s`` of the statistics; one pass, no shuffle.

    Windows are compared by a 64-bit hash inside their own document: sorted hashes show
    whether any repeats; only then are the windows' places looked up.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # columns are read more than once on purpose: a projection whose columns are used twice is
    # not merged into the next one, where a lambda would evaluate it again for every element
    d = docs.withColumn("_w", F.filter(F.split(text, WORD_SPLIT), lambda w: w != ""))
    d = d.withColumn("_n", F.size("_w"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_l", lines).withColumn(
        "_k",
        F.when(
            F.col("_n") >= window,
            F.transform(F.sequence(F.lit(1), F.col("_n") - (window - 1)), lambda i: F.xxhash64(F.slice(F.col("_w"), i, window))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    d = d.withColumn("_o", F.sort_array("_k"))
    d = d.withColumn("_twice", F.size(F.array_distinct("_k")) < F.size("_o"))
    d = d.withColumn(
        "_q",
        F.when(F.col("_twice") & (F.size("_o") > 0), F.sort_array(F.transform(F.col("_k"), lambda k, i: F.struct(k.alias("k"), i.alias("i"))))),
    )
    d = d.withColumn(
        "_at",
        F.when(
            F.col("_twice"),
            F.sort_array(
                F.transform(
                    F.filter(
                        "_q",
                        lambda x, i: ((i > 0) & (F.get("_q", i - 1)["k"] == x["k"])) | F.coalesce(F.get("_q", i + 1)["k"] == x["k"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        ),
    )
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(window), p - s["last"])).alias("n")),
    )["n"]
    stats = [
        F.col("_n"),
        F.length(F.translate(text, WORD_SPACE, "")),
        F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")),
        F.size("_l") - F.size(F.array_distinct("_l")),
        F.coalesce(covered, F.lit(0)),
    ]
    # the struct holds plain columns: Spark puts a struct's parts wherever its fields are read,
    # and a distance reads each many times
    d = d.select("*", *[c.cast("long").alias(f"_s{i}") for i, c in enumerate(stats)])
    d = d.withColumn("_s", F.struct(*[F.col(f"_s{i}").alias(c) for i, c in enumerate(_STATS)]))
    return d.drop("_w", "_n", "_l", "_k", "_o", "_twice", "_q", "_at", *[f"_s{i}" for i in range(len(_STATS))])


def base_failed() -> Column:
    return (F.col("_s.n_words") < 20) | (100 * F.col("_s.n_repeat_words") > 30 * F.col("_s.n_words"))


def group_key() -> Column:
    return F.concat_ws("\u0001", F.lit("g"), F.coalesce(F.col("lang").cast("string"), F.lit("\u0002")), F.coalesce(F.col("source").cast("string"), F.lit("\u0002")))


def features() -> list[Column]:
    """Log word length, log symbol rate, duplicate-line weight and share of repeated words."""
    n = F.greatest(F.col("_s.n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("_s.word_chars"), F.lit(1)).cast("double")
    return [
        F.log(chars / n),
        F.log1p(F.col("_s.n_symbols") * 20.0 / chars),
        F.log1p(F.col("_s.n_dup_lines") * 20.0 / n),
        F.col("_s.n_repeat_words") / n,
    ]


def distance(m: list[Column], c: list[list[Column]], x: list[Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor ``c``."""
    y: list[Column] = []
    total = F.lit(0.0)
    for i in range(_P):
        rest = x[i] - m[i]
        for j in range(i):
            rest = rest - c[i][j] * y[j]
        y.append(rest / c[i][i])
        total = total + y[i] * y[i]
    return total


_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
_X = [f"_x{i}" for i in range(_P)]


def _own_distance(x: list[Column]) -> Column:
    return distance([F.col(f"m{i}") for i in range(_P)], [[F.col(f"c{i}{j}") for j in range(i + 1)] for i in range(_P)], x)


def _factored(d: DataFrame) -> DataFrame:
    """Add the Cholesky factor (c00, c10, ...) of the scatter (s00, s10, ...)."""
    for i, j in _PAIRS:
        rest = F.col(f"s{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"c{i}{k}") * F.col(f"c{j}{k}")
        d = d.withColumn(f"c{i}{j}", F.sqrt(F.greatest(rest, F.lit(_FLOORS[i] ** 2 / 4))) if i == j else rest / F.col(f"c{j}{j}"))
    return d


def _concentrated(near: DataFrame, by: list[str], share: float) -> DataFrame:
    """Location and scatter (floors added) of the ``share`` of rows of each group with the
    least ``_d``.  Quantiles and moments are partial aggregates; tables of one row a group are
    written, so that Spark knows their sizes and one hot group costs no task more than others."""
    cut = written(near.groupBy(*by).agg(F.percentile_approx("_d", share, 1000).alias("_cut")))
    means = [F.avg(f"_x{i}").alias(f"m{i}") for i in range(_P)]
    covs = [(F.coalesce(F.covar_pop(f"_x{i}", f"_x{j}"), F.lit(0.0)) + (_FLOORS[i] ** 2 if i == j else 0.0)).alias(f"s{i}{j}") for i, j in _PAIRS]
    out = written(_factored(near.join(cut, by).where("_d <= _cut").groupBy(*by).agg(*means, *covs)))
    discard(cut)
    return out


def robust_scatter(rows: DataFrame, share: float = 0.75, first: int = 2, more: int = 2) -> DataFrame:
    """Minimum covariance determinant of each group ``_g`` of ``rows`` (_g, _x0, ...).

    Three starts: the ``share`` of rows nearest to the coordinatewise medians, measured by the
    floors or by the quartiles' distance, and a share taken by a hash of the values.  From
    each come ``first`` concentration steps (mean and covariance of the subset, then the share
    of rows nearest to them, which never raises the determinant), from the one with the least
    determinant ``more``.  Returns _g, m0.., s00.., c00.., _det.
    """
    x = [F.col(c) for c in _X]
    mid = written(rows.groupBy("_g").agg(F.struct(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, c in enumerate(x)]).alias("_m")))
    floors, quartiles = F.lit(0.0), F.lit(0.0)
    for i in range(_P):
        q = F.col(f"_m.q{i}")
        floors = floors + ((x[i] - q[1]) / _FLOORS[i]) ** 2
        quartiles = quartiles + ((x[i] - q[1]) / F.greatest(F.lit(_FLOORS[i] / 4), (q[2] - q[0]) / 1.349)) ** 2
    chance = F.pmod(F.xxhash64(*x), F.lit(1_000_003)).cast("double")
    starts = F.array(*[F.struct(F.lit(k).alias("_k"), d.alias("_d")) for k, d in enumerate((floors, quartiles, chance))])
    params = _concentrated(rows.join(mid, "_g").select("_g", *_X, F.explode(starts).alias("e")).select("_g", *_X, "e.*"), ["_g", "_k"], share)
    discard(mid)
    each = rows.withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    for _ in range(first):
        last, params = params, _concentrated(each.join(params, ["_g", "_k"]).select("_g", "_k", *_X, _own_distance(x).alias("_d")), ["_g", "_k"], share)
        discard(last)
    det = F.lit(0.0)
    for i in range(_P):
        det = det + 2 * F.log(f"c{i}{i}")
    names = [f"m{i}" for i in range(_P)] + [f"{v}{i}{j}" for v in "sc" for i, j in _PAIRS]
    last, params = params, written(params.withColumn("_det", det).groupBy("_g").agg(F.min(F.struct("_det", "_k", *names)).alias("b")).select("_g", "b.*").drop("_k", "_det"))
    discard(last)
    for _ in range(more):
        last, params = params, _concentrated(rows.join(params, "_g").select("_g", *_X, _own_distance(x).alias("_d")), ["_g"], share)
        discard(last)
    return params.withColumn("_det", det)


def fit_robust(stats: DataFrame, share: float = 0.75, prior: int = 60) -> DataFrame:
    """(_g, m0.., c00.., _scale): robust location and scatter by language and source, from
    ``stats`` (lang, source, _s).  Rows that fail a base rule take no part."""
    rows = stats.where(~base_failed()).select(group_key().alias("_g"), *[x.alias(c) for c, x in zip(_X, features())])
    rows = rows.unionByName(rows.withColumn("_g", F.lit("all")))
    params = robust_scatter(rows, share)
    near = rows.join(params, "_g").withColumn("_d", _own_distance([F.col(c) for c in _X]))
    # consistency: the median squared distance of clean rows is that of chi-squared
    scale = near.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.greatest(F.percentile_approx("_d", 0.5, 1000) / _CHI2_MEDIAN, F.lit(1.0)).alias("_scale"))
    params = written(params.join(scale, "_g"))
    kept = [f"m{i}" for i in range(_P)] + [f"s{i}{j}" for i, j in _PAIRS] + ["_scale"]
    pooled = params.where("_g = 'all'").select(*[F.col(c).alias(f"_all_{c}") for c in kept])
    both = params.where("_g <> 'all'").join(F.broadcast(pooled))  # one row
    lean = F.lit(float(prior)) / (F.col("_n") + prior)
    both = both.select("_g", *[((1 - lean) * F.col(c) + lean * F.col(f"_all_{c}")).alias(c) for c in kept])
    return written(_factored(both).drop(*[f"s{i}{j}" for i, j in _PAIRS]))


def _judge(rows: DataFrame, params: DataFrame, cutoff: float) -> DataFrame:
    """Add ``_kept`` to rows with lang, source and _s."""
    d = rows.withColumn("_g", group_key()).join(params, "_g", "left")
    d = d.withColumn("_d", _own_distance(features()) / F.col("_scale"))
    # one condition over both sides of the join: a base rule on its own would be pushed below the
    # statistics, where their lambdas would run once for every element
    far = F.greatest(F.coalesce("_d", F.lit(0.0)), base_failed().cast("double") * 1e300)
    return d.withColumn("_kept", far <= cutoff)


def judge_quality(docs: DataFrame, cutoff: float = 40.0) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and distance for every row of ``docs``.

    Null text has no word and fails the base rules; null lang and null source are groups of
    their own; repeated rows are judged alike; an empty table gives no rows; other columns are
    not read; texts of any length are read whole, each in one row.  Distances are
    squared; ``cutoff`` 40 lies far beyond the 0.9999 quantile of chi-squared with four
    degrees of freedom (23.5), so ordinary documents stay.
    """
    stats = written(with_stats(columns(docs, "doc_id", "text", "lang", "source")).select("doc_id", "lang", "source", "_s"))
    d = _judge(stats, fit_robust(stats), cutoff)
    return d.select(
        "doc_id", *[F.col(f"_s.{c}").alias(c) for c in _STATS], base_failed().alias("base_failed"), F.col("_kept").alias("kept"),
        F.col("_d").alias("distance"),
    )


def keep_good(docs: DataFrame, cutoff: float = 40.0) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`judge_quality` would keep.

    Statistics are taken once and written beside two 64-bit hashes of text, lang and source,
    which alone decide the verdict; rows whose hashes were rejected go by an anti-join, to
    which only rows that may be rejected are dealt.  Columns of any name pass, and nulls, repeated rows and empty
    tables are treated as there.
    """
    names = docs.columns
    keys = [F.xxhash64("text", "lang", "source").alias("_k0"), F.xxhash64(F.lit("key"), "source", "lang", "text").alias("_k1")]
    stats = written(with_stats(columns(docs, "text", "lang", "source")).select(*keys, "lang", "source", "_s"))
    gone = written(_judge(stats, fit_robust(stats), cutoff).where("not _kept").select("_k0", "_k1").distinct())
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), *keys)
    return left_out(packed, gone, ["_k0", "_k1"]).select(*[F.col("_row").getField(n).alias(n) for n in names])
