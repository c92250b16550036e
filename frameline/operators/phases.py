"""Motions of several phases: where a track's phases part, and what the fits of the phases say together.

Phases are numbered by windows over a track; every fit is a grouped sum. A window reads a track in order within one task, as a track has as many rows as
its video has frames. Phases with too few rows, and equations without a solution, give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameline.functions.vectors import dot, swing_angle, tilted_basis, whole_turns
from frameline.operators.fits import quadratic_fit
from frameline.operators.recovery import amplitude_decay, crossing_period, peaks

TINY = 1e-12


def _line(n: Column, t: Column, tt: Column, v: Column, tv: Column, vv: Column) -> tuple[Column, Column]:
    """Slope of a least-squares line from power sums, and the squares it leaves."""
    spread = tt - t * t / n
    across = tv - t * v / n
    slope = F.when(spread > TINY, across / spread)
    return slope, F.greatest(vv - v * v / n - F.coalesce(slope * across, F.lit(0.0)), F.lit(0.0))


def best_break(rows: DataFrame, keys: list[str], t: str, v: str, least: int = 3) -> DataFrame:
    """(keys, break_at, n_before, n_after, slope_before, slope_after, squares): the two lines through v, parted before the row at ``break_at``, that leave the
    least squares; ties go to the earlier break. Sums before each row and of the whole track give both lines at every break, so all breaks of a
    track are tried in one pass. Tracks of under 2 * ``least`` rows have none."""
    whole, track = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(t)
    used = rows.filter(F.col(t).isNotNull() & F.col(v).isNotNull()).select(*keys, F.col(t).alias("__at"), (F.col(t) - F.min(t).over(whole)).alias("__t"), (F.col(v) - F.avg(v).over(whole)).alias("__v"))
    track = Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    powers = {"n": F.lit(1.0), "t": F.col("__t"), "tt": F.col("__t") * F.col("__t"), "v": F.col("__v"), "tv": F.col("__t") * F.col("__v"), "vv": F.col("__v") * F.col("__v")}
    summed = used.select(*keys, "__at", *[F.coalesce(F.sum(p).over(track), F.lit(0.0)).alias(f"a_{k}") for k, p in powers.items()], *[F.sum(p).over(whole).alias(f"w_{k}") for k, p in powers.items()])
    first, first_left = _line(*[F.col(f"a_{k}") for k in powers])
    second, second_left = _line(*[F.col(f"w_{k}") - F.col(f"a_{k}") for k in powers])
    tried = summed.filter((F.col("a_n") >= least) & (F.col("w_n") - F.col("a_n") >= least)).select(
        *keys, F.struct((first_left + second_left).alias("squares"), F.col("__at").alias("break_at")).alias("cost"),
        F.struct(F.col("a_n").cast("long").alias("n_before"), (F.col("w_n") - F.col("a_n")).cast("long").alias("n_after"), first.alias("slope_before"), second.alias("slope_after")).alias("lines"),
    )
    best = tried.groupBy(*keys).agg(F.min("cost").alias("cost"), F.min_by("lines", "cost").alias("lines"))
    return best.select(*keys, "cost.break_at", "lines.*", "cost.squares")


def speeds(rows: DataFrame, keys: list[str], t: str, axes: list[str], out: str) -> DataFrame:
    """(keys, t, out): for one axis its signed speed, for several the size of the velocity, from each row and the one before it, at the time between them."""
    track = Window.partitionBy(*keys).orderBy(t)
    used = rows.filter(" AND ".join(f"{a} IS NOT NULL" for a in [t, *axes]))
    gap = F.col(t) - F.lag(t).over(track)
    steps = [F.col(a) - F.lag(a).over(track) for a in axes]
    size = steps[0] if len(axes) == 1 else F.sqrt(sum((s * s for s in steps[1:]), steps[0] * steps[0]))
    made = used.select(*keys, (F.col(t) - gap / 2).alias(t), F.when(gap > 0, size / gap).alias(out))
    return made.filter(F.col(out).isNotNull())


def ramp_and_floor(rows: DataFrame, keys: list[str], t: str, x: str, z: str, degrees: float = 20.0, gravity: float = 9.81) -> DataFrame:
    """(keys, break_at, a_ramp, a_floor, mu, ramp_error): accelerations on the ramp and on the floor, friction from the latter, and how far the ramp's
    acceleration is from the one which that friction predicts, as a share of the prediction."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    found = best_break(speeds(rows, keys, t, [x, z], "__speed"), keys, t, "__speed")
    mu = F.greatest(F.lit(0.0), -F.col("slope_after") / gravity)
    predicted = gravity * (s - c * F.col("mu"))
    out = found.withColumn("mu", mu).withColumn("ramp_error", F.when(F.abs(predicted) > TINY, F.abs(F.col("slope_before") - predicted) / F.abs(predicted)))
    return out.select(*keys, "break_at", F.col("slope_before").alias("a_ramp"), (-F.col("slope_after")).alias("a_floor"), "mu", "ramp_error")


def slide_friction(rows: DataFrame, keys: list[str], t: str, x: str, gravity: float = 9.81, still: float = 0.01, least: int = 3) -> DataFrame:
    """(keys, stops_at, v0, mu): friction of a slide along x. Of a track that comes to rest, from its first speed, by a line through the speeds before that, and the time to the
    first step slower than ``still``; of one that does not, from the slope of the speed."""
    moving = speeds(rows, keys, t, [x], "__v")
    starts = rows.filter(F.col(x).isNotNull()).groupBy(*keys).agg(F.min(t).alias("__from"))
    stops = moving.groupBy(*keys).agg(F.min(F.when(F.abs("__v") < still, F.col(t))).alias("stops_at")).join(starts, keys)
    met = moving.join(stops, keys).withColumn("__used", F.col("stops_at").isNull() | (F.col(t) < F.col("stops_at")))
    at, speed = F.when(F.col("__used"), F.col(t) - F.col("__from")), F.when(F.col("__used"), F.abs("__v"))
    enough = F.count_if("__used") >= least
    fit = met.groupBy(*keys, "stops_at", "__from").agg(F.when(enough, F.regr_intercept(speed, at)).alias("v0"), F.when(enough, F.regr_slope(speed, at)).alias("__a"))
    lasts = F.col("stops_at") - F.col("__from")
    mu = F.when(F.col("stops_at").isNull(), -F.col("__a") / gravity).when(lasts > TINY, F.col("v0") / (gravity * lasts))
    return fit.select(*keys, "stops_at", "v0", F.when(mu.isNotNull(), F.greatest(F.lit(0.0), mu)).alias("mu"))


def flights(rows: DataFrame, keys: list[str], t: str, height: str, reach: float) -> DataFrame:
    """The rows with ``flight``, the number of contacts before: rows at which the height has a low of at most ``reach``. Rows of contact, which may be on either side of it, are left out."""
    track = Window.partitionBy(*keys).orderBy(t)
    near = rows.filter(F.col(height).isNotNull() & F.col(t).isNotNull()).withColumns({"__p": F.lag(height).over(track), "__n": F.lead(height).over(track)})
    contact = F.coalesce((F.col(height) < F.col("__p")) & (F.col(height) <= F.col("__n")) & (F.col(height) <= reach), F.lit(False))
    marked = near.withColumn("__contact", contact)
    return marked.withColumn("flight", F.count_if("__contact").over(track.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("__contact")).drop("__p", "__n", "__contact")


def flight_ends(rows: DataFrame, keys: list[str], t: str, height: str, level: float, least: int = 4) -> DataFrame:
    """(keys, flight, a, started, ended, speed): of the parabola through each flight of ``least`` rows or more, its curvature, the times at which it is at
    ``level``, and its speed across the level there, which is equal at both."""
    fit = quadratic_fit(rows, [*keys, "flight"], t, height).filter((F.col("n") >= least) & (F.col("a") < -TINY))
    under = F.col("b") * F.col("b") - 4 * F.col("a") * (F.col("c") - level)
    fit = fit.withColumn("speed", F.sqrt(F.when(under > 0, under))).filter("speed IS NOT NULL")
    side = lambda sign: (-F.col("b") + sign * F.col("speed")) / (2 * F.col("a"))
    return fit.select(*keys, "flight", "a", side(1).alias("started"), side(-1).alias("ended"), "speed")


def tilted_restitution(rows: DataFrame, keys: list[str], t: str, x: str, z: str, degrees: float, plane: tuple[float, float], reach: float, radius: float = 0.0) -> DataFrame:
    """(keys, n_impacts, e, retention): what each impact on a plane through ``plane`` leaves of the speeds off and along it, one constant each for all impacts of a track.

    Positions are taken along and off the plane, flights are parabolas in both, and the constants are the least-squares ratios of the speeds after
    and before each impact."""
    along, off = tilted_basis(degrees)
    here = F.array(F.col(x) - plane[0], F.col(z) - plane[1])
    turned = rows.filter(F.col(x).isNotNull() & F.col(z).isNotNull()).withColumns({"__s": dot(here, along), "__d": dot(here, off)})
    parts = flights(turned, keys, t, "__d", reach)
    ends = flight_ends(parts, keys, t, "__d", radius)
    slides = quadratic_fit(parts, [*keys, "flight"], t, "__s").select(*keys, "flight", F.col("a").alias("sa"), F.col("b").alias("sb"))
    both = ends.join(slides, [*keys, "flight"])
    track = Window.partitionBy(*keys).orderBy("flight")
    leaving, arriving = 2 * F.col("sa") * F.col("started") + F.col("sb"), 2 * F.col("sa") * F.col("ended") + F.col("sb")
    met = both.select(*keys, "flight", F.lag("flight").over(track).alias("before"), F.col("speed").alias("vn"), F.lag("speed").over(track).alias("un"), leaving.alias("vt"), F.lag(arriving).over(track).alias("ut"))
    met = met.filter("flight = before + 1")
    ratio = lambda after, before: F.sum(F.col(after) * F.col(before)) / F.sum(F.col(before) * F.col(before))
    return met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_impacts"), ratio("vn", "un").alias("e"), F.when(F.sum(F.col("ut") * F.col("ut")) > TINY, ratio("vt", "ut")).alias("retention"))


def projectile_gravity(rows: DataFrame, keys: list[str], t: str, height: str, level: float, reach: float) -> DataFrame:
    """(keys, g_fit, g_gap, g, disagreement): gravity from the flight before the first bounce, and from the time between the first two bounces and the speed after the
    first; their mean (or the one there is), and their difference as a share of it."""
    ends = flight_ends(flights(rows, keys, t, height, reach), keys, t, height, level)
    of = lambda flight, value: F.max(F.when(F.col("flight") == flight, value))
    both = ends.groupBy(*keys).agg(
        (-2 * of(0, F.col("a"))).alias("g_fit"), of(0, F.col("ended")).alias("first"), F.coalesce(of(2, F.col("started")), of(1, F.col("ended"))).alias("second"), of(1, F.col("speed")).alias("speed")
    )
    gap = F.col("second") - F.col("first")
    out = both.withColumn("g_gap", F.when(gap > TINY, 2 * F.col("speed") / gap))
    out = out.withColumn("g", F.coalesce((F.col("g_fit") + F.col("g_gap")) / 2, "g_fit", "g_gap")).filter("g IS NOT NULL")
    return out.select(*keys, "g_fit", "g_gap", "g", (F.abs(F.col("g_fit") - F.col("g_gap")) / F.col("g")).alias("disagreement"))


def unwrapped_angles(rows: DataFrame, keys: list[str], t: str, part: str, ball: Column, pivot: Column, x: str, z: str) -> DataFrame:
    """(keys, t, angle): of rows for a pivot and a ball, the ball's angle about the pivot at each time that has both, without jumps: each step is the nearest way round.

    The steps are not summed, only the whole turns taken off them, which are exact: no error grows along a track, and equal places at equal turns have equal angles."""
    of = lambda who, c: F.max(F.when(F.col(part) == who, F.col(c)))
    met = rows.groupBy(*keys, t).agg(*[of(who, c).alias(f"__{name}{c}") for name, who in (("b", ball), ("p", pivot)) for c in (x, z)])
    met = met.filter(" AND ".join(f"`__{name}{c}` IS NOT NULL" for name in "bp" for c in (x, z)))
    met = met.select(*keys, t, swing_angle(*[F.col(f"__{name}{c}") for name in "bp" for c in (x, z)]).alias("__a"))
    track = Window.partitionBy(*keys).orderBy(t)
    steps = met.withColumn("__n", whole_turns(F.col("__a") - F.lag("__a").over(track)))
    turns = F.coalesce(F.sum("__n").over(track.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return steps.select(*keys, t, (F.col("__a") - 2 * math.pi * turns).alias("angle"))


def swing_recovery(angles: DataFrame, keys: list[str], t: str, angle: str, length: float) -> DataFrame:
    """(keys, n_peaks, gamma, period, g, ratio): of a damped swing, the decay of its amplitudes, its period, gravity from the two and the rod's length, and the
    mean ratio of each amplitude to the one before it, a half period earlier."""
    track = Window.partitionBy(*keys).orderBy(t)
    tops = peaks(angles.withColumn("__a", F.abs(angle)), keys, t, "__a").filter(F.col("__a") > 0).withColumn("__b", F.lag("__a").over(track))
    ratios = tops.groupBy(*keys).agg(F.avg(F.col("__a") / F.col("__b")).alias("ratio"))
    both = amplitude_decay(angles, keys, t, angle).join(ratios, keys).join(crossing_period(angles, keys, t, angle), keys, "left")
    damped = 2 * math.pi / F.col("period")
    return both.select(*keys, "n_peaks", "gamma", "period", (length * (damped * damped + F.col("gamma") * F.col("gamma"))).alias("g"), "ratio")


def two_ball_collision(rows: DataFrame, keys: list[str], t: str, part: str, first: Column, second: Column, x: str, least: int = 3) -> DataFrame:
    """(keys, hit_at, v_before, v1_after, v2_after, e, c_1, c_2, c): the time of the closest approach, the speeds that lines through the logarithms of the speeds have there,
    restitution from them, and the drag of each ball after it and their mean.

    Both sides are anchored at the hit, and one aggregation fits all three lines; the steps that meet the hit's row, which may hold the impact, are on neither side. A ball that rests on a side has no logarithm; its speed there is 0."""
    of = lambda who: F.max(F.when(F.col(part) == who, F.col(x)))
    met = rows.groupBy(*keys, t).agg(of(first).alias("__x1"), of(second).alias("__x2")).filter("__x1 IS NOT NULL AND __x2 IS NOT NULL")
    track, whole = Window.partitionBy(*keys).orderBy(t), Window.partitionBy(*keys)
    met = met.withColumn("__hit", F.min_by(F.col(t), F.struct(F.abs(F.col("__x2") - F.col("__x1")), F.col(t))).over(whole))
    gap = F.col(t) - F.lag(t).over(track)
    steps = met.select(
        *keys, "__hit", F.when(F.lag(t).over(track) > F.col("__hit"), F.lit(1)).when(F.col(t) < F.col("__hit"), F.lit(0)).alias("__side"), (F.col(t) - gap / 2 - F.col("__hit")).alias("__s"),
        *[F.when(gap > 0, (F.col(c) - F.lag(c).over(track)) / gap).alias(v) for c, v in (("__x1", "__v1"), ("__x2", "__v2"))],
    )

    def line(v: str, side: int) -> tuple[Column, Column]:
        used = (F.col("__side") == side) & (F.abs(v) > TINY)
        size, at = F.when(used, F.log(F.abs(v))), F.when(used, F.col("__s"))
        sign = F.signum(F.sum(F.when(F.col("__side") == side, F.col(v))))
        speed = F.when(F.count_if(used) >= least, sign * F.exp(F.regr_intercept(size, at))).when((F.count_if(used) == 0) & (F.count_if(F.col("__side") == side) >= least), F.lit(0.0))
        return speed, F.when(F.count_if(used) >= least, -F.regr_slope(size, at))

    (before, _), (after1, c1), (after2, c2) = line("__v1", 0), line("__v1", 1), line("__v2", 1)
    out = steps.filter("__side IS NOT NULL").groupBy(*keys).agg(F.min("__hit").alias("hit_at"), before.alias("v_before"), after1.alias("v1_after"), after2.alias("v2_after"), c1.alias("c_1"), c2.alias("c_2"))
    e = F.when(F.abs("v_before") > TINY, (F.col("v2_after") - F.col("v1_after")) / F.col("v_before"))
    return out.select(*keys, "hit_at", "v_before", "v1_after", "v2_after", e.alias("e"), "c_1", "c_2", F.coalesce((F.col("c_1") + F.col("c_2")) / 2, "c_1", "c_2").alias("c"))


def wall_recovery(rows: DataFrame, keys: list[str], t: str, x: str, z: str, degrees: float = 20.0, gravity: float = 9.81, least: int = 3) -> DataFrame:
    """(keys, hit_at, break_at, a_ramp, a_floor, a_back, e, g, mu, mu_rolling): a ramp, a floor and a wall.

    The wall is where the speed along x first turns back (the steps at the turn, one of which holds the impact, are in no phase); the ramp ends at the best break of the speed before it. Lines through the speed of the floor before
    and after the wall give both decelerations, and at the wall the speeds whose ratio is e. Gravity and friction solve mu * g = a_floor and
    g * (sin - cos * mu) = a_ramp; with gravity known, ``mu_rolling`` is a_floor / gravity."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    track = Window.partitionBy(*keys).orderBy(t)
    along = speeds(rows, keys, t, [x], "__v").join(speeds(rows, keys, t, [x, z], "__speed"), [*keys, t])
    turns = along.withColumn("__p", F.lag("__v").over(track)).withColumn("__last", F.lag(t).over(track)).filter((F.col("__p") > 0) & (F.col("__v") < 0))
    turns = turns.groupBy(*keys).agg(F.min(t).alias("hit_at"), F.min_by("__last", t).alias("__last"))
    met = along.join(turns, keys)
    early = met.filter(F.col(t) < F.col("__last"))
    breaks = best_break(early, keys, t, "__speed").select(*keys, "break_at", F.col("slope_before").alias("a_ramp"))
    phased = met.join(breaks, keys, "left")
    floor = (F.col(t) < F.col("__last")) & (F.col(t) >= F.col("break_at"))
    back = (F.col(t) > F.col("hit_at")) & (F.col("__v") < 0)
    sides = {"floor": floor, "back": back}
    fits = {}
    for name, side in sides.items():
        speed, at = F.when(side, F.abs("__v")), F.when(side, F.col(t) - F.col("hit_at"))
        enough = F.count_if(side) >= least
        fits[f"a_{name}"] = F.when(enough, -F.regr_slope(speed, at))
        fits[f"v_{name}"] = F.when(enough, F.regr_intercept(speed, at))
    out = phased.groupBy(*keys, "hit_at", "break_at", "a_ramp").agg(*[f.alias(n) for n, f in fits.items()])
    g = (F.col("a_ramp") + c * F.col("a_floor")) / s
    e = F.when(F.abs("v_floor") > TINY, F.abs(F.col("v_back") / F.col("v_floor")))
    return out.select(*keys, "hit_at", "break_at", "a_ramp", "a_floor", "a_back", e.alias("e"), g.alias("g"), F.when(F.abs(g) > TINY, F.col("a_floor") / g).alias("mu"), (F.col("a_floor") / gravity).alias("mu_rolling"))
