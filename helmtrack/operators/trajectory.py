"""From tracked motion to corrections: capped smoothing, chained key rotations, whole trajectories."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rotation as ro
from .joins import bracketed
from .recurrence import Chain, scan
from .series import FRAME, ID, gaussian_smooth, hemisphere_sign, ordered, so_far

PARTS = ("w", "x", "y", "z")
#: No correction turns an axis further than this, in degrees.
CAP = 5.0


def clipped(x: Column, cap: float) -> Column:
    return F.greatest(F.lit(-cap), F.least(F.lit(cap), x))


def shake_cap(shakiness: float) -> float:
    """The cap that a shakiness setting allows: one and a half times, within 1 and ``CAP`` degrees."""
    return min(CAP, max(1.0, 1.5 * shakiness))


def smoothing_correction(df: DataFrame, axes: Sequence[str], *, smoothing: float = 30.0, cap: float = CAP, tripod: bool = False, mode: str = "reflect") -> DataFrame:
    """series_id, frame and a correction for each axis, from changes by frame.

    The correction leads from the summed-up path to its Gaussian mean, within
    the cap.  With ``tripod`` it takes all of the path back, without a cap.
    """
    path = df.select(ID, FRAME, *[F.sum(a).over(so_far()).alias(a) for a in axes])
    if tripod:
        return path.select(ID, FRAME, *[(-F.col(a)).alias(a) for a in axes])
    both = path.select("*", *[F.col(a).alias(f"_{a}") for a in axes])
    smooth = gaussian_smooth(both, [f"_{a}" for a in axes], max(1.0, smoothing / 3.0), mode)
    return smooth.select(ID, FRAME, *[clipped(F.col(f"_{a}") - F.col(a), cap).alias(a) for a in axes])


def conjugate(q: Column) -> Column:
    return ro.quaternion(q["w"], -q["x"], -q["y"], -q["z"])


def times(a: Column, b: Column) -> Column:
    """The rotation b, then a."""
    return ro.quaternion(
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
    )


def of_matrix(m: Sequence[Column]) -> Column:
    """Unit quaternion of a rotation matrix (rows first), from its largest part, so that nothing is divided by a small one."""
    squares = {"w": m[0] + m[4] + m[8], "x": m[0] - m[4] - m[8], "y": m[4] - m[0] - m[8], "z": m[8] - m[0] - m[4]}
    wx, wy, wz = m[7] - m[5], m[2] - m[6], m[3] - m[1]
    xy, xz, yz = m[1] + m[3], m[2] + m[6], m[5] + m[7]
    rows = {"w": (None, wx, wy, wz), "x": (wx, None, xy, xz), "y": (wy, xy, None, yz), "z": (wz, xz, yz, None)}
    largest = F.greatest(*squares.values())
    out = None
    for part, row in rows.items():
        size = F.sqrt(1.0 + squares[part])
        q = ro.quaternion(*[size / 2.0 if v is None else v / (2.0 * size) for v in row])
        out = F.when(squares[part] == largest, q) if out is None else out.when(squares[part] == largest, q)
    return out


def euler_zyx_of(m: Sequence[Column]) -> tuple[Column, Column, Column]:
    """yaw, pitch, roll of a matrix in aerospace order (about z, then y, then x)."""
    pitch = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m[6]))))
    return F.degrees(F.atan2(m[3], m[0])), pitch, F.degrees(F.atan2(m[7], m[8]))


def chained(turns: DataFrame) -> DataFrame:
    """series_id, frame, w, x, y, z: absolute rotations of key frames.

    ``turns`` has the rotation (w, x, y, z) from the key frame before, and
    ``matches``, the pairs it was found from.  The first key frame is the
    reference.  Each turn is taken back from the rotation before it; one found
    from fewer than three pairs is left out, and the rotation goes on.
    """
    enough = F.col("matches") >= 3
    unit = {"w": 1.0, "x": 0.0, "y": 0.0, "z": 0.0}
    back = turns.select(ID, FRAME, *[F.when(enough, F.col(p) if p == "w" else -F.col(p)).otherwise(unit[p]).alias(p) for p in PARTS])

    return scan(back, PARTS, PARTS, Chain())


def _quaternion(prefix: str = "") -> Column:
    return ro.quaternion(*[F.col(f"{prefix}{p}") for p in PARTS])


def corrections(keys: DataFrame, frames: DataFrame, *, smoothing: float = 30.0, deformed: bool = False, reapply: bool = False, cap: float = CAP) -> DataFrame:
    """series_id, frame, yaw, pitch, roll that lead from a trajectory to its smooth course.

    Rotations of key frames (w, x, y, z) are filled for all ``frames`` on the
    shorter arc, brought to one hemisphere, and smoothed by a Gaussian; of the
    difference each axis is capped.  ``deformed`` halves the width of the
    Gaussian; ``reapply`` mixes in three tenths of a far smoother course.
    """
    sigma = max(1.0, smoothing / 3.0)
    if deformed:
        sigma = max(1.0, sigma * 0.5)
    found = bracketed(keys.select(ID, FRAME, *PARTS), frames.select(ID, FRAME), ID, FRAME, PARTS)
    a, b = F.col("before"), F.col("after")
    qa, qb = (ro.quaternion(*[s[p] for p in PARTS]) for s in (a, b))
    span = b[FRAME] - a[FRAME]
    part = F.when(span > 0, (F.col(FRAME) - a[FRAME]) / span).otherwise(0.0)
    q = F.when(a.isNull(), qb).when(b.isNull() | (span <= 0), qa).otherwise(ro.slerp(qa, qb, part))
    # parts are columns from here on: a struct's expression would be repeated for each use of a part
    filled = found.select(ID, FRAME, q.alias("q")).select(ID, FRAME, *[F.col("q")[p].alias(p) for p in PARTS])
    before = ro.quaternion(*[F.lag(p).over(ordered()) for p in PARTS])
    turned = filled.withColumn("near", ro.dot(_quaternion(), before)).withColumn("sign", hemisphere_sign(F.col("near")))
    one_side = turned.select(ID, FRAME, *[(F.col(p) * F.col("sign")).alias(p) for p in PARTS])
    wide = one_side.select(ID, FRAME, *PARTS, *[F.col(p).alias(f"{n}{p}") for n in ("s", "l") for p in PARTS])
    smooth = _unit(gaussian_smooth(wide, [f"s{p}" for p in PARTS], sigma), "s")
    if reapply:
        smooth = _unit(gaussian_smooth(smooth, [f"l{p}" for p in PARTS], max(1.0, smoothing * 2.0)), "l")
        mixed = smooth.withColumn("mixed", ro.slerp(_quaternion("s"), _quaternion("l"), 0.3))
        smooth = mixed.withColumns({f"s{p}": F.col("mixed")[p] for p in PARTS})
    turn = smooth.select(ID, FRAME, times(_quaternion("s"), conjugate(_quaternion())).alias("turn")).select(ID, FRAME, *[F.col("turn")[p].alias(p) for p in PARTS])
    roll, pitch, yaw = ro.euler_zyx(_quaternion())
    return turn.select(ID, FRAME, *[clipped(v, cap).alias(n) for v, n in ((yaw, "yaw"), (pitch, "pitch"), (roll, "roll"))])


def _unit(df: DataFrame, prefix: str) -> DataFrame:
    """The prefixed parts scaled to length 1; parts of no length stay."""
    q = _quaternion(prefix)
    sized = df.withColumn("size", F.sqrt(ro.dot(q, q)))
    return sized.withColumns({f"{prefix}{p}": F.col(f"{prefix}{p}") / F.when(F.col("size") < 1e-9, 1.0).otherwise(F.col("size")) for p in PARTS}).drop("size")


def separated(df: DataFrame, key: str, order: str, vector: Sequence[str], degrees: float = 2.0) -> DataFrame:
    """The rows of each key that are taken one after another, a row too near to one already taken being left out.

    A key is the candidates of one frame, which are few.
    """
    least = float(np.cos(np.radians(degrees)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        v = rows[list(vector)].to_numpy(np.float64)
        open_ = np.ones(len(v), bool)
        taken = np.zeros(len(v), bool)
        for i in range(len(v)):
            if open_[i]:
                taken[i] = True
                open_ &= np.clip(v @ v[i], -1.0, 1.0) <= least
        return rows[taken]

    return df.groupBy(key).applyInPandas(run, df.schema)
