"""Angles in degrees, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float


def _c(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def wrap180(x: Num) -> Column:
    """Into [-180, 180)."""
    return F.pmod(_c(x) + 180.0, F.lit(360.0)) - 180.0


def wrap180_closed(x: Num) -> Column:
    """Into [-180, 180]: whole turns are taken off one by one, so both ends survive with their sign."""
    x = _c(x)
    w = wrap180(x)
    return F.when(x.between(-180.0, 180.0), x).when((w == -180.0) & (x > 0), 180.0).otherwise(w)


def step_wrap(x: Num) -> Column:
    """One turn at most: not a full wrap."""
    x = _c(x)
    return F.when(x > 180.0, x - 360.0).when(x < -180.0, x + 360.0).otherwise(x)


def wrapped_difference(a: Num, b: Num) -> Column:
    """Shortest way from b to a."""
    return wrap180(_c(a) - _c(b))


def triple_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Euclidean length of the wrapped differences of two angle triples."""
    return F.sqrt(sum(((d := wrapped_difference(x, y)) * d for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def cosine_ease(t: Num) -> Column:
    return 0.5 * (1.0 - F.cos(_c(t) * F.pi()))


def level_delta(value: Column, target: Column, multiplier: float = 1.0, backwards: bool = False) -> Column:
    """Correction that levels an axis; a camera mounted backwards turns the other way."""
    return (value - target) * F.lit(-multiplier if backwards else multiplier)


def gravity_camera(roll: Column, pitch: Column) -> tuple[Column, Column, Column]:
    """Gravity as an accelerometer at rest shows it, x negated (used when rates are fused)."""
    r, p = F.radians(roll), F.radians(pitch)
    return -F.sin(p), F.sin(r) * F.cos(p), F.cos(r) * F.cos(p)


def gravity_log(roll: Column, pitch: Column) -> tuple[Column, Column, Column]:
    """Gravity in the sign convention of IMU logs: x is the sine of the pitch."""
    r, p = F.radians(roll), F.radians(pitch)
    return F.sin(p), -F.sin(r) * F.cos(p), F.cos(r) * F.cos(p)


def tilt_of_gravity(ax: Column, ay: Column, az: Column) -> tuple[Column, Column]:
    """Roll and pitch that an accelerometer at rest gives."""
    return F.degrees(F.atan2(ay, az + 1e-8)), F.degrees(F.atan2(-ax, F.sqrt(ay * ay + az * az) + 1e-8))
