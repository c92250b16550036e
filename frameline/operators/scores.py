"""Scores of a track from its measures, as column expressions. A null measure, which is one that is not known, takes nothing off a deduction; NaN takes the most."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper limits (lower limits for shares) and the points taken off at each, then beyond the last.
UPPER_STEPS = {
    "g_rel": ((0.10, 0), (0.20, 5), (0.30, 10), (0.50, 20), 35),
    "v0_abs": ((0.2, 0), (0.5, 5), (1.0, 10), (2.0, 15), 20),
    "h0_rel": ((0.1, 0), (0.2, 3), (0.3, 6), (0.5, 10), 15),
    "verticality": ((0.02, 0), (0.05, 3), (0.10, 6), 10),
    "bounce_norm": ((0.02, 0), (0.05, 2), (0.10, 4), 6),
}
LOWER_STEPS = {
    "r2": ((0.995, 0), (0.99, 2), (0.98, 4), (0.95, 6), 8),
    "monotonic_rate": ((0.98, 0), (0.95, 2), (0.90, 4), 8),
    "detection_rate": ((0.95, 0), (0.90, 2), (0.80, 4), 8),
    "single_object_rate": ((0.98, 0), (0.95, 1), (0.90, 3), 6),
    "in_frame_rate": ((0.98, 0), (0.95, 1), (0.90, 3), 5),
}


def deduction(name: str) -> Column:
    """Points taken off for one measure; a null measure takes nothing off, NaN the most."""
    value = F.col(name)
    steps = UPPER_STEPS.get(name) or LOWER_STEPS[name]
    out = None
    for limit, points in steps[:-1]:
        fits = value <= limit if name in UPPER_STEPS else value >= limit
        fits = fits & ~F.isnan(value)
        out = F.when(value.isNull(), F.lit(0)) if out is None else out
        out = out.when(fits, F.lit(points))
    return out.otherwise(F.lit(steps[-1]))


def penetration_deduction() -> Column:
    norm = F.col("penetration_norm")
    return F.when(F.col("penetration_px").isNull() | (F.col("penetration_px") <= 2), 0).when(norm <= 0.10, 2).when(norm <= 0.25, 4).otherwise(6)


def deduction_score(measures: list[str]) -> Column:
    """100 less the deductions of the measures and of penetration, 0 at least."""
    return F.greatest(F.lit(0), 100 - sum((deduction(m) for m in measures), penetration_deduction())).cast("double")


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def weighted_score(parameter: Column | None = None) -> Column:
    """0 to 100: weights tracking .20, vertical .20, downward .10, quadratic .20, penetration .15, bounce .10 and, if known, the parameter .05."""
    c = F.col
    tracking = 0.5 * c("detection_rate") + 0.25 * c("single_object_rate") + 0.25 * c("in_frame_rate")
    vertical = 0.6 * clip01(1 - c("verticality") / 0.15) + 0.4 * clip01(1 - c("rmse_x") / F.greatest(0.05 * c("y_span"), F.lit(1e-8)))
    downward = 0.5 * c("monotonic_rate") + 0.5 * (c("g_hat") > 0).cast("double")
    quadratic = clip01((c("r2") - 0.90) / 0.09)
    sunk = F.when(c("penetration_px") <= 2, 1.0).otherwise(clip01(1 - c("penetration_norm") / 0.5))
    bounced = F.when(c("bounce_norm") <= 0.02, 1.0).otherwise(clip01(1 - c("bounce_norm") / 0.2))
    total = 0.20 * tracking + 0.20 * vertical + 0.10 * downward + 0.20 * quadratic + 0.15 * sunk + 0.10 * bounced
    if parameter is None:
        return 100 * total / 0.95
    return 100 * F.when(parameter.isNull(), total / 0.95).otherwise(total + 0.05 * parameter)


def fit_quality() -> Column:
    return clip01((F.col("r2") - 0.90) / 0.09)


def sweep_video_score() -> Column:
    """A sweep's video, 0 to 100: tracking .25, shape .25, no sideways motion .20, penetration .15, bounce .15."""
    c = F.col
    tracking = 0.5 * c("detection_rate") + 0.25 * c("single_object_rate") + 0.25 * c("in_frame_rate")
    sunk = F.when(c("penetration_px") <= 2, 1.0).otherwise(clip01(1 - c("penetration_norm") / 0.5))
    bounced = F.when(c("bounce_norm") <= 0.02, 1.0).otherwise(clip01(1 - c("bounce_norm") / 0.2))
    return 100 * (0.25 * tracking + 0.25 * fit_quality() + 0.20 * clip01(1 - c("verticality") / 0.15) + 0.15 * sunk + 0.15 * bounced)


def hard_constraints(parameters: bool = True, scaled_v0: bool = False) -> dict[str, Column]:
    """Eight checks that a track must pass, and three on recovered parameters, which are null where the true value is not known. NaN never passes.
    The first speed may miss by 1, or (``scaled_v0``) by a share of the one that was asked for, ``v0``, and a little."""
    c = F.col
    checks = {
        "ok_detection": c("detection_rate") >= 0.90,
        "ok_single": c("single_object_rate") >= 0.90,
        "ok_in_frame": c("in_frame_rate") >= 0.95,
        "ok_vertical": c("verticality") <= 0.10,
        "ok_downward": c("monotonic_rate") >= 0.90,
        "ok_fit": (c("r2") >= 0.98) & ~F.isnan("r2"),
        "ok_penetration": c("penetration_px") <= 2,
        "ok_bounce": c("bounce_norm") <= 0.05,
    }
    checks = {n: F.coalesce(e, F.lit(False)) for n, e in checks.items()}
    if parameters:
        checks |= {"ok_g": c("g_rel") <= 0.30, "ok_v0": c("v0_abs") <= (F.greatest(F.lit(0.5), 0.3 * F.abs("v0") + 0.2) if scaled_v0 else 1.0), "ok_h0": c("h0_rel") <= 0.30}
    return checks


def strict_pass(checks: dict[str, Column]) -> Column:
    """Whether all checks hold; a check that is null says nothing."""
    out = F.lit(True)
    for n in checks:
        out = out & F.coalesce(F.col(n), F.lit(True))
    return out


def axis_score() -> Column:
    """A sweep's axis, 0 to 100, from its regression and the means of its videos: fit .40, correlation .20, order .15, fit quality .15,
    constraints .10. What is not defined counts as 0."""
    c = F.col
    known = lambda x: F.when(c(x).isNull() | F.isnan(c(x)), 0.0).otherwise(c(x))
    quality = clip01((known("mean_r2") - 0.90) / 0.09)
    constraints = 0.4 * c("mean_detection") + 0.3 * clip01(1 - c("mean_verticality") / 0.15) + 0.3 * c("clean_share")
    return 100 * (0.40 * clip01(known("r2")) + 0.20 * F.abs(known("pearson")) + 0.15 * known("monotonic") + 0.15 * quality + 0.10 * constraints)
