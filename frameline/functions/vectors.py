"""Vectors as arrays of numbers, and directions of planes and swings, as column expressions."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays; null if either is null or their lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def tilted_basis(degrees: float) -> tuple[Column, Column]:
    """Unit vectors (x, z) along a plane that rises by so many degrees, and off it."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return F.array(F.lit(c), F.lit(s)), F.array(F.lit(-s), F.lit(c))


@F.arrow_udf(DoubleType())
def direction(y: pa.Array, x: pa.Array) -> pa.Array:
    """atan2 of the C library, whose error is under 0.6 of the last place; Java's differs there for one pair in five, which decides which way round half a turn goes."""
    return pa.array([None if a is None or b is None else math.atan2(a, b) for a, b in zip(y.to_pylist(), x.to_pylist(), strict=True)], pa.float64())


def swing_angle(x: Column, z: Column, pivot_x: Column, pivot_z: Column) -> Column:
    """Angle of a hanging weight from straight down, positive towards rising x, within half a turn."""
    return direction(x - pivot_x, pivot_z - z)


def whole_turns(angle: Column) -> Column:
    """How many whole turns leave the angle nearest to 0; NaN has NaN."""
    return F.when(F.isnan(angle), angle).otherwise(F.floor(angle / (2 * math.pi) + 0.5).cast("double"))


def above_floor(y: Column, floor: float, radius: Column) -> Column:
    """The height at which a ball of this radius is drawn: never below its place on the floor."""
    return F.greatest(y, radius + floor)


def floor_run(configured: Column, ramp_length: Column, degrees: Column, friction: Column, gravity: float = 9.81, margin: float = 1.5) -> Column:
    """Length of floor that a block needs which slides down a ramp from rest: as configured, or its way to the stop and a margin if that is longer."""
    angle = F.radians(degrees)
    down = F.greatest(F.lit(0.08), gravity * (F.sin(angle) - friction * F.cos(angle)))  # a ramp too flat to slide down is taken as one that barely is not
    speed = F.sqrt(2 * down * ramp_length) * F.cos(angle)
    return F.greatest(configured, speed * speed / (2 * F.greatest(F.lit(1e-6), friction * gravity)) + margin)
