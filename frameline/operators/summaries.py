"""Summaries across views, styles, sweeps and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameline.operators.fits import guarded_corr
from frameline.operators.ordering import in_order
from frameline.operators.sequences import monotonic_share


def cross_view(rows: DataFrame, keys: list[str], name: str, value: str, least_views: int = 2) -> DataFrame:
    """(keys, name, n_views, mean, variance, range) of a value over views; variance is that of the population."""
    agg = rows.filter(F.col(value).isNotNull()).groupBy(*keys, name).agg(
        F.count(F.lit(1)).alias("n_views"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), (F.max(value) - F.min(value)).alias("range")
    )
    return agg.filter(F.col("n_views") >= least_views)


def cross_view_map(rows: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """(keys, by_name): a map from each name to its mean, in name order."""
    means = cross_view(rows, keys, name, value, 1)
    entry = F.struct(F.col(name).alias("key"), F.col("mean").alias("value"))
    return means.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by_name"))


def coverage(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that are not present."""
    return expected.join(present.select(*keys).distinct(), keys, "left_anti")


def numeric_mean(c: Column | str) -> Column:
    """Mean over what can be read as a number; null if nothing can."""
    return F.avg(F.try_cast(c, "double") if hasattr(F, "try_cast") else F.col(c).try_cast("double"))


def style_summary(rows: DataFrame, style: str, values: list[str], passed: str) -> DataFrame:
    """(style, n, mean of each value, pass_rate) in style order."""
    return rows.groupBy(style).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values], F.avg(F.col(passed).cast("double")).alias("pass_rate")).orderBy(style)


def ranked(rows: DataFrame, score: str, tie: str, within: list[str] | None = None) -> DataFrame:
    """Adds ``rank`` from 1 by falling score. Ranks of all rows together come from written ranges and their ends, not from one task."""
    if within:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(score), tie)))
    return in_order(rows, [], [F.desc(score), tie], label="ranked").withColumn("rank", F.col("row_at") + 1).drop("group_at", "row_at")


def ranking_lines(rows: DataFrame, name: str, score: str) -> DataFrame:
    """(rank, line): a ranking as lines of text."""
    return ranked(rows, score, name).select("rank", F.format_string("%d. %s: %.2f", F.col("rank"), F.col(name).cast("string"), F.col(score)).alias("line"))


def axis_regression(rows: DataFrame, keys: list[str], target: str, estimate: str, tie: str) -> DataFrame:
    """(keys, n, slope, intercept, r2, pearson, monotonic) of estimates against prompted values; undefined ones are null."""
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 2, F.regr_slope(estimate, target)).alias("slope"),
        F.when(F.count(F.lit(1)) >= 2, F.regr_intercept(estimate, target)).alias("intercept"), guarded_corr(target, estimate).alias("pearson"),
    )
    agg = agg.withColumn("r2", F.col("pearson") * F.col("pearson"))
    ordered = rows.withColumn("__o", F.struct(target, tie))
    return agg.join(monotonic_share(ordered, keys, estimate, "__o"), keys, "left")


def average_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, value, name): the average rank of each distinct value within its keys. Equal values are counted before they are ordered, and
    ranges of values are numbered as they are written, so few keys or many ties don't meet in one task."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    placed = in_order(counts, keys, [value], totals=["__n"], label="average-ranks")
    return placed.select(*keys, value, (F.col("__n_before") + (F.col("__n") + 1) / 2.0).alias(name))


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, spearman): Pearson correlation of average ranks over rows that have both values."""
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked_rows = rows.join(average_ranks(rows, keys, x, "__rx"), [*keys, x]).join(average_ranks(rows, keys, y, "__ry"), [*keys, y])
    return ranked_rows.groupBy(*keys).agg(guarded_corr("__rx", "__ry").alias("spearman"))


def phase_summary(results: DataFrame, errors: DataFrame, target: str, estimate: str, means: list[str]) -> DataFrame:
    """One row: numbers of results, errors and valid pairs (a target and a finite estimate), the means over all results (0 if there are
    none), and Pearson, Spearman, slope, intercept and r2 over the valid pairs (null where undefined)."""
    one = F.lit(1).alias("everything")
    valid = F.col(target).isNotNull() & F.col(estimate).isNotNull() & ~F.isnan(estimate) & (F.abs(estimate) < float("inf"))
    pairs = results.filter(valid).select(one, F.col(target).cast("double").alias("x"), F.col(estimate).cast("double").alias("y"))
    lines = pairs.groupBy("everything").agg(
        F.count(F.lit(1)).alias("num_valid"), guarded_corr("x", "y").alias("pearson"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")
    )
    counts = results.agg(F.count(F.lit(1)).alias("num_results"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"mean_{m}") for m in means]).select(one, "*")
    failed = errors.agg(F.count(F.lit(1)).alias("num_errors")).select(one, "*")
    out = counts.join(failed, "everything").join(lines, "everything", "left").join(spearman(pairs, ["everything"], "x", "y"), "everything", "left")
    known = F.col("pearson").isNotNull()
    return out.select(
        "num_results", "num_errors", F.coalesce("num_valid", F.lit(0)).alias("num_valid"), *[f"mean_{m}" for m in means], "pearson", "spearman",
        F.when(known, F.col("slope")).alias("slope"), F.when(known, F.col("intercept")).alias("intercept"), (F.col("pearson") * F.col("pearson")).alias("r2"),
    )


def motion_extents(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, vertical, horizontal, ratio): extents of both coordinates over the given window; 0 where nothing was found."""
    span = lambda c: F.coalesce(F.max(c) - F.min(c), F.lit(0.0))
    out = rows.groupBy(*keys).agg(span(y).alias("vertical"), span(x).alias("horizontal"))
    return out.withColumn("ratio", F.col("horizontal") / F.greatest("vertical", F.lit(1e-8)))
