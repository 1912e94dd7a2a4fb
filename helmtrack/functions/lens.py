"""Directions of picture elements, and blend masks, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import Num, _c

#: Of each cube face: the axis it looks along, the one to its right, and the one downwards (fixed values).
FACES = {
    "px": ((1, 0, 0), (0, 0, -1), (0, -1, 0)), "nx": ((-1, 0, 0), (0, 0, 1), (0, -1, 0)), "py": ((0, 1, 0), (1, 0, 0), (0, 0, 1)),
    "ny": ((0, -1, 0), (1, 0, 0), (0, 0, -1)), "pz": ((0, 0, 1), (1, 0, 0), (0, -1, 0)), "nz": ((0, 0, -1), (-1, 0, 0), (0, -1, 0)),
}


def cube_direction(face: Column, u: Num, v: Num, size: Num) -> tuple[Column, Column, Column]:
    """Unit vector of pixel (u, v) of a cube face; null for an unknown face."""
    across, down = (2.0 * _c(x) / (_c(size) - 1.0) - 1.0 for x in (u, v))
    length = F.sqrt(1.0 + across * across + down * down)

    def axis(i: int) -> Column:
        out = F.lit(None).cast("double")
        for name, (ahead, right, below) in FACES.items():
            out = F.when(face == name, float(ahead[i]) + across * float(right[i]) + down * float(below[i])).otherwise(out)
        return out / length

    return axis(0), axis(1), axis(2)


def seam_alpha(x: Num, *, left: float = 960.0, right: float = 2880.0, half: float = 60.0) -> Column:
    """Blend mask of a picture row, 0 to 255: none between the seams, full beyond, cosine slopes across them."""
    x = _c(x)
    slope = lambda t: 255.0 - F.floor(255.0 * (0.5 - 0.5 * F.cos(math.pi * t)))
    inner = F.when(x.between(left + half, right - half), 0.0)
    rising = inner.when((x >= left - half) & (x < left + half), slope((x - (left - half)) / (2.0 * half)))
    return rising.when((x > right - half) & (x <= right + half), slope((right + half - x) / (2.0 * half))).otherwise(255.0).cast("int")


def fisheye_place(lon: Num, lat: Num, *, fov: float, radius: float, centre: tuple[float, float], roll: float = 0.0) -> tuple[Column, Column]:
    """Where a direction (degrees) falls in an equidistant fisheye picture that is turned by ``roll``."""
    lon, lat = F.radians(_c(lon)), F.radians(_c(lat))
    x, y, z = F.cos(lat) * F.sin(lon), F.sin(lat), F.cos(lat) * F.cos(lon)
    c, s = math.cos(math.radians(-roll)), math.sin(math.radians(-roll))
    phi = F.atan2(s * x + c * y, c * x - s * y)
    r = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))) / math.radians(fov / 2.0) * radius
    return centre[0] + r * F.cos(phi), centre[1] + r * F.sin(phi)
