"""Fits and searches that stay sums: small systems are solved from moments, in columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def ridge2(df: DataFrame, key: str, a1: Column, a2: Column, b: Column, weight: Column, *, prior: float = 25.0, within: float = 2.0) -> DataFrame:
    """key, x1, x2: weighted ridge solution of a1 x1 + a2 x2 = b, refitted once on rows within ``within``.

    Rows and right-hand sides are both multiplied by the weight.  Keys with
    fewer than three rows are left out; with fewer than three close rows the
    first solution stands.
    """
    rows = df.select(F.col(key).alias("k"), a1.alias("a1"), a2.alias("a2"), b.alias("b"), weight.alias("w"))
    w2 = F.col("w") * F.col("w")

    def solve(rows: DataFrame, names: tuple[str, str]) -> DataFrame:
        s = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[F.sum(w2 * F.col(x) * F.col(y)).alias(n) for n, x, y in (("s11", "a1", "a1"), ("s12", "a1", "a2"), ("s22", "a2", "a2"), ("t1", "a1", "b"), ("t2", "a2", "b"))]).where("n >= 3")
        p, q = F.col("s11") + prior, F.col("s22") + prior
        det = p * q - F.col("s12") * F.col("s12")
        return s.select("k", ((q * F.col("t1") - F.col("s12") * F.col("t2")) / det).alias(names[0]), ((p * F.col("t2") - F.col("s12") * F.col("t1")) / det).alias(names[1]))

    first = solve(rows, ("u1", "u2"))
    close = rows.join(first, "k").where(F.abs(F.col("a1") * F.col("u1") + F.col("a2") * F.col("u2") - F.col("b")) < within)
    out = first.join(solve(close, ("v1", "v2")), "k", "left")
    return out.select(F.col("k").alias(key), F.coalesce("v1", "u1").alias("x1"), F.coalesce("v2", "u2").alias("x2"))


def sinusoid(df: DataFrame, key: str, angle: Column, y: Column) -> DataFrame:
    """key, mean, cosine, sine, rmse: least squares of mean + cosine cos(angle) + sine sin(angle), by Cramer's rule."""
    rows = df.select(F.col(key).alias("k"), F.cos(angle).alias("c"), F.sin(angle).alias("s"), y.alias("y"))
    p = lambda *x: F.sum(_product([F.col(v) for v in x]))
    m = rows.groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("n"), p("c").alias("sc"), p("s").alias("ss"), p("c", "c").alias("cc"), p("c", "s").alias("cs"), p("s", "s").alias("s2"), p("y").alias("sy"), p("c", "y").alias("cy"), p("s", "y").alias("sy2"), p("y", "y").alias("yy"))
    g = lambda *names: [F.col(x) for x in names]
    left = [g("n", "sc", "ss"), g("sc", "cc", "cs"), g("ss", "cs", "s2")]
    right = g("sy", "cy", "sy2")
    whole = _det(left)
    fits = []
    for j in range(3):
        fits.append(_det([[right[i] if k == j else left[i][k] for k in range(3)] for i in range(3)]) / whole)
    out = m.select("k", "n", "yy", *right, *[f.alias(n) for f, n in zip(fits, ("mean", "cosine", "sine"), strict=True)])
    rest = F.col("yy") - F.col("mean") * F.col("sy") - F.col("cosine") * F.col("cy") - F.col("sine") * F.col("sy2")
    return out.select(F.col("k").alias(key), "mean", "cosine", "sine", F.sqrt(F.greatest(rest, F.lit(0.0)) / F.col("n")).alias("rmse"))


def _product(x: Sequence[Column]) -> Column:
    out = x[0]
    for v in x[1:]:
        out = out * v
    return out


def _det(m: list[list[Column]]) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


CELLS = tuple(f"h{i}{j}" for i in range(3) for j in range(3))


def cross_covariance(df: DataFrame, key: str, a: Sequence[Column], b: Sequence[Column]) -> DataFrame:
    """key, h00..h22: sums of the products of the b vectors' parts with the a vectors'."""
    return df.groupBy(key).agg(*[F.sum(b[i] * a[j]).alias(f"h{i}{j}") for i in range(3) for j in range(3)])


def kabsch(df: DataFrame, key: str, a: Sequence[Column], b: Sequence[Column]) -> DataFrame:
    """key, r00..r22: the rotation that turns the b vectors onto the a vectors best.

    The nine sums of the cross-covariance are partial aggregates, so a key may
    have any number of rows; only its 3 x 3 matrix meets the SVD.
    """
    kind = df.schema[key].dataType.simpleString()
    sums = cross_covariance(df, key, a, b)
    names = [c.replace("h", "r") for c in CELLS]

    def solve(batches):
        for rows in batches:
            r = rotations(rows[list(CELLS)].to_numpy(np.float64).reshape(-1, 3, 3)).reshape(-1, 9)
            yield pd.DataFrame({key: rows[key], **{n: r[:, i] for i, n in enumerate(names)}})

    return sums.mapInPandas(solve, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))


def rotations(h: np.ndarray) -> np.ndarray:
    """Rotations of cross-covariances, each with determinant 1."""
    u, _, vt = np.linalg.svd(h)
    v, ut = np.swapaxes(vt, -1, -2), np.swapaxes(u, -1, -2)
    v[..., :, 2] *= np.sign(np.linalg.det(v @ ut))[..., None]
    return v @ ut


#: Settings of the consensus for features of key frames: three points, 0.035 rad, numpy's newer generator (fixed values).
KEY_FRAMES = {"points": 3, "degrees": math.degrees(0.035), "least": 3, "generator": np.random.default_rng}


def kabsch_consensus(a: np.ndarray, b: np.ndarray, *, rounds: int = 100, points: int = 4, degrees: float = 1.5, least: int = 8, seed: int = 42, generator=np.random.RandomState) -> np.ndarray:
    """Rotation of the largest set of vector pairs that agree on one; all pairs where there are few."""
    fit = lambda x, y: rotations((y.T @ x)[None])[0]
    if len(a) < least:
        return fit(a, b)
    rng = generator(seed)
    picks = [rng.choice(len(a), size=points, replace=False) for _ in range(rounds)]
    tried = rotations(np.stack([b[i].T @ a[i] for i in picks]))
    agree = np.einsum("ni,rij,nj->rn", a, tried, b) >= np.cos(np.radians(degrees))
    best = agree[agree.sum(axis=1).argmax()]
    return fit(a[best], b[best]) if best.sum() >= least else fit(a, b)


def frame_rotations(df: DataFrame, key: str, a: Sequence[str], b: Sequence[str], order: str, **options) -> DataFrame:
    """key, r00..r22 by consensus; a key is the features of one frame, which are few."""
    kind = df.schema[key].dataType.simpleString()
    names = [c.replace("h", "r") for c in CELLS]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        r = kabsch_consensus(rows[list(a)].to_numpy(np.float64), rows[list(b)].to_numpy(np.float64), **options)
        return pd.DataFrame([[rows[key].iloc[0], *r.ravel()]], columns=[key, *names])

    return df.groupBy(key).applyInPandas(run, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))


def best_parameter(df: DataFrame, key: str, parameters: Sequence[float], cost) -> DataFrame:
    """key, parameter, cost: the parameter of least mean cost, ties to the first.

    The grid is a literal: every row is spread over it and summed up before the
    shuffle, so what moves is one number for each key and parameter.
    """
    grid = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(float(p)).alias("p")) for i, p in enumerate(parameters)])
    spread = df.select("*", F.inline(grid))
    mean = spread.groupBy(key, "place", "p").agg(F.avg(cost(F.col("p"))).alias("cost"))
    return mean.groupBy(key).agg(F.min(F.struct("cost", "place", "p")).alias("b")).select(key, F.col("b.p").alias("parameter"), "b.cost")


def best_pair(df: DataFrame, key: str, first: Sequence[float], second: Sequence[float], a: Column, b: Column, penalty=None) -> DataFrame:
    """key, first, second, cost: the pair (p, q) of least mean of (a - p)^2 + (b - q)^2, ties to the first in order of both.

    The mean is a variance and a squared distance for each of the two, so that
    a key's rows are summed up once, and the grid is gone through for a key, not
    for a row.  ``penalty`` of the pair is added to the mean.
    """
    side = lambda values: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(values)])
    sums = df.select(key, a.alias("a"), b.alias("b")).groupBy(key).agg(*[f(c).alias(f"{n}_{c}") for c in ("a", "b") for n, f in (("mean", F.avg), ("var", F.var_pop))])
    off = lambda c, v: F.col(f"var_{c}") + (F.col(f"mean_{c}") - v) * (F.col(f"mean_{c}") - v)
    extra = penalty if penalty is not None else lambda p, q: F.lit(0.0)
    pair = lambda p, q: F.struct((off("a", p["v"]) + off("b", q["v"]) + extra(p["v"], q["v"])).alias("cost"), p["i"].alias("i"), q["i"].alias("j"), p["v"].alias("p"), q["v"].alias("q"))
    best = F.array_min(F.transform(side(first), lambda p: F.array_min(F.transform(side(second), lambda q: pair(p, q)))))
    return sums.withColumn("b", best).select(key, F.col("b.p").alias("first"), F.col("b.q").alias("second"), "b.cost")


def refined(df: DataFrame, key: str, start: tuple[float, float, float], cost, rounds: int = 3) -> float:
    """Coarse-to-fine search for one parameter over all keys: (low, high, step), then around the best with a step of a fifth."""
    low, high, step = start
    best = low
    for _ in range(rounds):
        n = round((high - low) / step)
        best = best_parameter(df.withColumn("_all", F.lit(0)), "_all", [low + i * step for i in range(n + 1)], cost).first()["parameter"]
        low, high, step = best - step, best + step, step / 5.0
    return best


#: Bits of a part of a descriptor, and how many of them may differ in the last round that looks parts up.
PART, FLIPS = 8, 3


def _flipped(flips: int) -> list[int]:
    """Masks that change at most so many bits of a part."""
    return [m for m in range(1 << PART) if m.bit_count() <= flips]


def nearest_bits(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """key, l, r, distance: for every l the r of fewest differing bits within its key, ties to the smaller r.

    ``left`` has key, l and x, ``right`` key, r and y; x and y are ``width``
    bits.  Bits are cut into parts of eight.  Two descriptors that differ in
    fewer than (f + 1) * parts bits have a part that differs in f bits at most,
    so that they meet where x is looked up by its parts with up to f bits
    changed.  A find below that number is proven; what is left is asked with
    more bits changed, and at last against its whole key.  Joins are by sorting:
    descriptors compress so well that a broadcast is chosen for tables of which
    the driver would have to hold many millions of rows.
    """
    parts = -(-width // PART)
    cut = lambda v: [F.shiftrightunsigned(v, PART * i).bitwiseAND((1 << PART) - 1).cast("int") for i in range(parts)]
    listed = right.select(key, "r", "y", F.posexplode(F.array(*cut(F.col("y")))).alias("part", "value"))
    asked, found = left, None
    distance = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    for flips in range(FLIPS + 2):
        if flips <= FLIPS:
            masks = F.array(*map(F.lit, _flipped(flips)))
            own = asked.select(key, "l", "x", F.posexplode(F.array(*cut(F.col("x")))).alias("part", "own"))
            looked = own.select(key, "l", "x", "part", F.explode(F.transform(masks, lambda m: F.col("own").bitwiseXOR(m))).alias("value"))
            met = looked.join(listed.hint("merge"), [key, "part", "value"])
        else:
            met = asked.join(right.hint("merge"), key)
        best = met.groupBy(key, "l").agg(F.min(F.struct(distance.alias("distance"), "r")).alias("best"))
        sure = F.lit(True) if flips > FLIPS else F.col("best.distance") < (flips + 1) * parts
        best = written(best.where(sure).select(key, "l", "best.r", "best.distance"), "bits")
        found = best if found is None else found.unionByName(best)
        asked = written(asked.join(best.select(key, "l").hint("merge"), [key, "l"], "left_anti"), "asked")
        if asked.isEmpty():
            break
    return found


def mutual_nearest(left: DataFrame, right: DataFrame, key: str, bits: str, id_: str, width: int = 64) -> DataFrame:
    """key, l, r, distance: pairs of which each is the other's nearest by differing bits, ties to the smaller id.

    Descriptors meet only within a key, the features of one frame; ids are unique within it.
    """
    x = lambda df, n, v: df.select(key, F.col(id_).alias(n), F.col(bits).cast("bigint").alias(v))
    there = nearest_bits(x(left, "l", "x"), x(right, "r", "y"), key, width)
    back = nearest_bits(x(right, "l", "x"), x(left, "r", "y"), key, width).select(key, F.col("l").alias("r"), F.col("r").alias("l"))
    return there.join(back.hint("merge"), [key, "l", "r"]).select(key, "l", "r", "distance")


def best_median(matches: DataFrame, key: str, value: str, distance: str, order: str, most: int = 60) -> DataFrame:
    """key, value, n: median of the value over the ``most`` matches of least distance."""
    w = Window.partitionBy(key).orderBy(distance, order)
    top = matches.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return top.groupBy(key).agg(F.percentile(value, F.lit(0.5)).alias(value), F.count(F.lit(1)).alias("n"))
