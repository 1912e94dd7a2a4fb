"""Rotations as column expressions: quaternions are structs, matrices are nine columns by row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import Num, _c

Matrix = tuple[Column, ...]


def quaternion(w: Num, x: Num, y: Num, z: Num) -> Column:
    return F.struct(*[_c(v).alias(n) for n, v in zip("wxyz", (w, x, y, z), strict=True)])


def _half(angle: Num) -> tuple[Column, Column]:
    a = F.radians(_c(angle)) * 0.5
    return F.cos(a), F.sin(a)


def quaternion_zyx(roll: Num, pitch: Num, yaw: Num) -> Column:
    """Aerospace order: yaw about z, then pitch about y, then roll about x."""
    (cr, sr), (cp, sp), (cy, sy) = _half(roll), _half(pitch), _half(yaw)
    return quaternion(cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy)


def quaternion_yxz(yaw: Num, pitch: Num, roll: Num) -> Column:
    """Camera order: yaw about y, then pitch about x, then roll about z."""
    (cy, sy), (cp, sp), (cr, sr) = _half(yaw), _half(pitch), _half(roll)
    return normalised(quaternion(cy * cp * cr + sy * sp * sr, cy * sp * cr + sy * cp * sr, sy * cp * cr - cy * sp * sr, cy * cp * sr - sy * sp * cr))


def dot(a: Column, b: Column) -> Column:
    return a["w"] * b["w"] + a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def scaled(q: Column, by: Num) -> Column:
    return quaternion(*(q[n] * _c(by) for n in "wxyz"))


def normalised(q: Column) -> Column:
    n = F.sqrt(dot(q, q))
    return scaled(q, 1.0 / F.when(n == 0, 1.0).otherwise(n))


def euler_zyx(q: Column) -> tuple[Column, Column, Column]:
    """roll, pitch, yaw; the pitch is exactly a right angle where the sine reaches it."""
    w, x, y, z = (q[n] for n in "wxyz")
    sine = 2.0 * (w * y - z * x)
    pitch = F.when(F.abs(sine) >= 1.0, F.signum(sine) * 90.0).otherwise(F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine)))))
    roll = F.degrees(F.atan2(2.0 * (w * x + y * z), 1.0 - 2.0 * (x * x + y * y)))
    yaw = F.degrees(F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (y * y + z * z)))
    return roll, pitch, yaw


def euler_yxz(q: Column) -> tuple[Column, Column, Column]:
    """yaw, pitch, roll of the camera order; the sine of the pitch is clamped."""
    w, x, y, z = (normalised(q)[n] for n in "wxyz")
    pitch = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2.0 * (w * x - y * z)))))
    yaw = F.degrees(F.atan2(2.0 * (w * y + x * z), 1.0 - 2.0 * (x * x + y * y)))
    roll = F.degrees(F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (x * x + z * z)))
    return yaw, pitch, roll


#: Above this cosine two orientations are blended on the chord.
NEAR = 0.9995


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once: an expression used for several parts of a result would be repeated for each."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def slerp(a: Column, b: Column, t: Num) -> Column:
    """Spherical interpolation along the shorter arc."""

    def blended(s: Column) -> Column:
        a, b, t, near, sign = (s[n] for n in ("a", "b", "t", "near", "sign"))
        chord = _let(quaternion(*(a[n] + t * (b[n] * sign - a[n]) for n in "wxyz")), normalised)
        whole = F.acos(F.least(near, F.lit(1.0)))
        second = F.sin(whole * t) / F.sin(whole)
        weights = F.struct((F.cos(whole * t) - near * second).alias("a"), (second * sign).alias("b"))
        arc = _let(weights, lambda w: quaternion(*(w["a"] * a[n] + w["b"] * b[n] for n in "wxyz")))
        return F.when(near > NEAR, chord).otherwise(arc)

    d = dot(a, b)
    return _let(F.struct(a.alias("a"), b.alias("b"), _c(t).cast("double").alias("t"), F.abs(d).alias("near"), F.when(d < 0, -1.0).otherwise(1.0).alias("sign")), blended)


def nlerp(a: Column, b: Column, t: Num) -> Column:
    """Normalised blend along the shorter arc."""
    sign = F.when(dot(a, b) < 0, -1.0).otherwise(1.0)
    return normalised(quaternion(*(a[n] + _c(t) * (b[n] * sign - a[n]) for n in "wxyz")))


def matrix(yaw: Num, pitch: Num, roll: Num) -> Matrix:
    """Projection order of the command series."""
    y, p, r = (F.radians(_c(v)) for v in (yaw, pitch, roll))
    cy, sy, cp, sp, cr, sr = F.cos(y), F.sin(y), F.cos(p), F.sin(p), F.cos(r), F.sin(r)
    return (cy * cr - sy * sp * sr, -sr * cp, sy * cr + cy * sp * sr, cy * sr + sy * sp * cr, cr * cp, sy * sr - cy * sp * cr, -sy * cp, sp, cy * cp)


def euler(m: Sequence[Column]) -> tuple[Column, Column, Column]:
    """yaw, pitch, roll of a matrix in projection order; no roll where the pitch is a right angle."""
    p = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m[7])))
    free = F.cos(p) > 1e-6
    yaw = F.when(free, F.atan2(-m[6], m[8])).otherwise(F.atan2(m[2], m[0]))
    roll = F.when(free, F.atan2(-m[1], m[4])).otherwise(F.lit(0.0))
    return F.degrees(yaw), F.degrees(p), F.degrees(roll)


def euler_tracked(m: Sequence[Column]) -> tuple[Column, Column, Column]:
    """yaw, pitch, roll of a tracked rotation: the roll turns the other way."""
    flat = F.sqrt(m[2] * m[2] + m[8] * m[8])
    free = flat > 1e-6
    yaw = F.when(free, F.atan2(m[2], m[8])).otherwise(F.atan2(-m[6], m[0]))
    roll = F.when(free, -F.degrees(F.atan2(m[3], m[4]))).otherwise(F.lit(0.0))
    return F.degrees(yaw), F.degrees(F.atan2(m[5], flat)), roll


def product(a: Sequence[Column], b: Sequence[Column]) -> Matrix:
    return tuple(a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3))


def about(axis: str, angle: Num) -> Matrix:
    """The matrix of a turn about one axis."""
    c, s = F.cos(F.radians(_c(angle))), F.sin(F.radians(_c(angle)))
    k = "xyz".index(axis)
    u, v = (k + 1) % 3, (k + 2) % 3  # the plane that turns
    cells = {(k, k): F.lit(1.0), (u, u): c, (v, v): c, (u, v): -s, (v, u): s}
    return tuple(cells.get((i, j), F.lit(0.0)) for i in range(3) for j in range(3))


def matrix_in_order(order: str, **angles: Num) -> Matrix:
    """The product of turns about axes in a stated order, such as 'zyx' for aerospace and 'yxz' for a camera: x, y, z give the angles."""
    first, *rest = (about(axis, angles[axis]) for axis in order)
    for m in rest:
        first = product(first, m)
    return first


def transposed(m: Sequence[Column]) -> Matrix:
    return tuple(m[3 * j + i] for i in range(3) for j in range(3))


def axis_angle_matrix(x: Column, y: Column, z: Column) -> Matrix:
    """Rodrigues' formula; the identity for a zero vector."""
    angle = F.sqrt(x * x + y * y + z * z)
    still = angle < 1e-12
    a, b, c = (F.when(still, 0.0).otherwise(v / F.when(still, 1.0).otherwise(angle)) for v in (x, y, z))
    s, k = F.sin(angle), 1.0 - F.cos(angle)
    return (1.0 - k * (b * b + c * c), k * a * b - s * c, k * a * c + s * b, k * a * b + s * c, 1.0 - k * (a * a + c * c), k * b * c - s * a, k * a * c - s * b, k * b * c + s * a, 1.0 - k * (a * a + b * b))


def matrix_axis_angle(m: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Rotation vector of a matrix below half a turn."""
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0] + m[4] + m[8] - 1.0) / 2.0)))
    by = F.when(angle < 1e-9, 0.5).otherwise(angle / (2.0 * F.sin(angle)))
    return (m[7] - m[5]) * by, (m[2] - m[6]) * by, (m[3] - m[1]) * by


def pixel_direction(x: Num, y: Num, width: Num, height: Num) -> tuple[Column, Column, Column]:
    """Unit vector of a pixel of an equirectangular picture."""
    lon = 2.0 * F.pi() * (_c(x) / _c(width)) - F.pi()
    lat = F.pi() / 2.0 - F.pi() * (_c(y) / _c(height))
    return F.cos(lat) * F.sin(lon), F.sin(lat), F.cos(lat) * F.cos(lon)


def octant(x: Column, y: Column, z: Column) -> Column:
    """0 to 7 by the signs of the axes."""
    bit = lambda v, n: F.when(v >= 0, n).otherwise(0)
    return bit(x, 1) + bit(y, 2) + bit(z, 4)


def axis_weights(x: Column, y: Column, z: Column, sharpness: float = 5.0) -> list[Column]:
    """Softmax weights of the six axis directions."""
    e = [F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), v * sharpness))) for v in (x, -x, y, -y, z, -z)]
    total = sum(e[1:], e[0])
    return [v / total for v in e]


def cauchy_loss(squared: Column, scale2: float) -> Column:
    return scale2 * F.log1p(squared / scale2)


def fisheye_radius(theta: Column, k: Sequence[float]) -> Column:
    """Angle times 1 + k1 theta^2 + k2 theta^4 + ..."""
    t2, factor, power = theta * theta, F.lit(1.0), F.lit(1.0)
    for c in k:
        power = power * t2
        factor = factor + float(c) * power
    return theta * factor
