"""Least squares by grouped power sums: one partial and one final aggregation, whatever a series' length.

Times are centred on the group's mean first, which keeps the sums well conditioned. Fits without enough rows, or whose
normal equations are singular, are null; R2 of a constant series is NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def _centred(rows: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    used = rows.filter(F.col(t).isNotNull() & F.col(v).isNotNull())
    means = used.groupBy(*keys).agg(F.avg(t).alias("__m"))
    return used.join(means, keys).withColumn("__t", F.col(t) - F.col("__m")).withColumn("__v", F.col(v))


def quadratic_fit(rows: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """(keys, n, a, b, c, rmse, r2) of v = a t^2 + b t + c."""
    s = {f"s{k}": F.sum(F.col("__t") ** k) for k in range(1, 5)} | {f"v{k}": F.sum(F.col("__v") * F.col("__t") ** k) for k in range(3)} | {"vv": F.sum(F.col("__v") * F.col("__v"))}
    sums = _centred(rows, keys, t, v).groupBy(*keys, "__m").agg(F.count(F.lit(1)).cast("double").alias("n"), *[e.alias(k) for k, e in s.items()])

    def det(m: list[list[Column]]) -> Column:
        (a, b, c), (d, e, f), (g, h, i) = m
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    c = F.col
    left = [[c("s4"), c("s3"), c("s2")], [c("s3"), c("s2"), c("s1")], [c("s2"), c("s1"), c("n")]]
    right = [c("v2"), c("v1"), c("v0")]
    whole = det(left)
    scale = F.greatest(c("s4") * c("s2") * c("n"), F.lit(TINY))

    def part(k: int) -> Column:
        m = [[right[i] if j == k else left[i][j] for j in range(3)] for i in range(3)]
        return F.when((c("n") >= 3) & (F.abs(whole) / scale > TINY), det(m) / whole)

    fit = sums.withColumns({"p2": part(0), "p1": part(1), "p0": part(2)})
    sse = c("vv") - (c("p2") * c("v2") + c("p1") * c("v1") + c("p0") * c("v0"))
    total = c("vv") - c("v0") * c("v0") / c("n")
    return fit.select(
        *keys, c("n").cast("long").alias("n"),
        c("p2").alias("a"), (c("p1") - 2 * c("p2") * c("__m")).alias("b"), (c("p0") - c("p1") * c("__m") + c("p2") * c("__m") * c("__m")).alias("c"),
        F.sqrt(F.greatest(sse, F.lit(0.0)) / c("n")).alias("rmse"),
        F.when(total <= TINY, F.lit(float("nan"))).otherwise(1 - sse / F.greatest(total, F.lit(TINY))).alias("r2"),
    )


def linear_fit(rows: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """(keys, n, slope, intercept, rmse)."""
    used = rows.filter(F.col(t).isNotNull() & F.col(v).isNotNull())
    agg = used.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(v, t).alias("slope"), F.regr_intercept(v, t).alias("intercept"),
        F.regr_syy(v, t).alias("syy"), F.regr_sxy(v, t).alias("sxy"),
    )
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    return agg.select(*keys, "n", "slope", "intercept", F.sqrt(rest / F.col("n")).alias("rmse"))


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation, null if either side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), F.when(spread > TINY, spread))


def relative_error(estimate: Column, truth: Column) -> Column:
    """Absolute error over the truth's size; null for a truth of 0."""
    return F.when(F.abs(truth) > TINY, F.abs(estimate - truth) / F.abs(truth))


def recovered_parameters(rows: DataFrame, keys: list[str], gravity: float = 9.81) -> DataFrame:
    """(keys, g, mu): gravity from z and friction from x by whole-series quadratic fits; series of under five rows give null."""
    z = quadratic_fit(rows, keys, "time_s", "z").select(*keys, F.when(F.col("n") >= 5, -2 * F.col("a")).alias("g"))
    x = quadratic_fit(rows, keys, "time_s", "x").select(*keys, F.when(F.col("n") >= 5, F.greatest(F.lit(0.0), -2 * F.col("a") / gravity)).alias("mu"))
    return z.join(x, keys)


def zone_fit(rows: DataFrame, keys: list[str], boundary: float, gravity: float = 9.81) -> DataFrame:
    """(keys, mu_1, mu_2): friction left and right of the boundary, which belongs to both; the resting end is left out of the right side."""
    ends = rows.groupBy(*keys).agg(F.max("x").alias("far"))
    sides = {"mu_1": F.col("x") <= boundary, "mu_2": (F.col("x") >= boundary) & (F.col("x") < F.col("far") - 1e-5)}
    out = ends.select(*keys)
    for name, side in sides.items():
        fit = quadratic_fit(rows.join(ends, keys).filter(side), keys, "time_s", "x")
        out = out.join(fit.select(*keys, F.when(F.col("n") >= 5, F.greatest(F.lit(0.0), -2 * F.col("a") / gravity)).alias(name)), keys, "left")
    return out
