"""Physical parameters recovered from tracked motion: peaks, decay of amplitudes, periods, and slopes of speed.

Each is a windowed projection and one aggregation by track. Too few peaks, crossings or rows for a fit, and values without a logarithm, give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def peaks(rows: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """(keys, t, v) of the local maxima: above the value before and not below the next one."""
    track = Window.partitionBy(*keys).orderBy(t)
    near = rows.filter(F.col(v).isNotNull()).select(*keys, t, v, F.lag(v).over(track).alias("__p"), F.lead(v).over(track).alias("__n"))
    return near.filter((F.col(v) > F.col("__p")) & (F.col(v) >= F.col("__n"))).select(*keys, t, v)


def restitution(rows: DataFrame, keys: list[str], t: str, height: str, least: int = 2) -> DataFrame:
    """(keys, n_ratios, e): geometric mean of the square roots of successive peak heights' ratios, from ``least`` ratios on."""
    track = Window.partitionBy(*keys).orderBy(t)
    found = peaks(rows, keys, t, height).withColumn("__b", F.lag(height).over(track)).filter((F.col(height) > 0) & (F.col("__b") > 0))
    ratio = F.avg(F.log(F.col(height) / F.col("__b")) / 2)
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ratios"), F.when(F.count(F.lit(1)) >= least, F.exp(ratio)).alias("e"))


def amplitude_decay(rows: DataFrame, keys: list[str], t: str, v: str, least: int = 3) -> DataFrame:
    """(keys, n_peaks, gamma): fall of the logarithm of the peaks of |v| with time."""
    found = peaks(rows.withColumn("__a", F.abs(v)), keys, t, "__a").filter(F.col("__a") > 0)
    many = F.count(F.lit(1))
    return found.groupBy(*keys).agg(many.alias("n_peaks"), F.when(many >= least, -F.regr_slope(F.log("__a"), F.col(t))).alias("gamma"))


def crossing_period(rows: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """(keys, n_crossings, period): mean time between the upward crossings of zero, each placed on the line between its two rows."""
    track = Window.partitionBy(*keys).orderBy(t)
    steps = rows.filter(F.col(v).isNotNull()).select(*keys, t, v, F.lag(v).over(track).alias("__p"), F.lag(t).over(track).alias("__t"))
    at = F.col("__t") + (F.col(t) - F.col("__t")) * (-F.col("__p")) / (F.col(v) - F.col("__p"))
    many = F.count(F.lit(1))
    found = steps.filter((F.col("__p") < 0) & (F.col(v) >= 0)).select(*keys, at.alias("__at"))
    return found.groupBy(*keys).agg(many.alias("n_crossings"), F.when(many >= 2, (F.max("__at") - F.min("__at")) / (many - 1)).alias("period"))


def spring(rows: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """(keys, gamma, omega0): undamped angular frequency from the period and the decay."""
    both = amplitude_decay(rows, keys, t, v).join(crossing_period(rows, keys, t, v), keys)
    damped = 2 * F.pi() / F.col("period")
    return both.select(*keys, "gamma", F.sqrt(damped * damped + F.col("gamma") * F.col("gamma")).alias("omega0"))


def friction_of_phases(rows: DataFrame, keys: list[str], t: str, x: str, phases: dict[str, Column], gravity: float = 9.81, least: int = 3) -> DataFrame:
    """(keys, one column a phase): friction from a straight line through the speed, which is the difference of neighbouring rows, in each phase."""
    track = Window.partitionBy(*keys).orderBy(t)
    gap = F.col(t) - F.lag(t).over(track)
    speeds = rows.filter(F.col(x).isNotNull()).withColumn("__v", F.when(gap > 0, (F.col(x) - F.lag(x).over(track)) / gap))
    out = []
    for name, phase in phases.items():
        used = phase & F.col("__v").isNotNull()
        slope = F.regr_slope(F.when(used, F.col("__v")), F.when(used, F.col(t)))
        out.append(F.when(F.count_if(used) >= least, F.greatest(F.lit(0.0), -slope / gravity)).alias(name))
    return speeds.groupBy(*keys).agg(*out)


def speed_ratio(rows: DataFrame, keys: list[str], t: str, x: str) -> DataFrame:
    """(keys, hit_at, e): where the speed first turns from rising to falling, as at a wall, and the ratio of the speeds after and before."""
    track = Window.partitionBy(*keys).orderBy(t)
    speeds = rows.filter(F.col(x).isNotNull()).select(*keys, t, ((F.col(x) - F.lag(x).over(track)) / (F.col(t) - F.lag(t).over(track))).alias("__v"))
    turns = speeds.withColumn("__p", F.lag("__v").over(track)).filter((F.col("__p") > 0) & (F.col("__v") < 0))
    return turns.groupBy(*keys).agg(F.min(t).alias("hit_at"), F.min_by(-F.col("__v") / F.col("__p"), t).alias("e"))
