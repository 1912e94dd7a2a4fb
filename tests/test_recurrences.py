"""Kernels against plain or known results."""

from __future__ import annotations

import math

import numpy as np
import pytest

from helmtrack.operators import recurrence as rec
from helmtrack.operators import robust


def plain_rdp(points, epsilon):
    if len(points) < 3:
        return list(range(len(points)))
    a, b = points[0], points[-1]
    gaps = []
    for p in points[1:-1]:
        f = (p[0] - a[0]) / (b[0] - a[0])
        gaps.append(math.dist(p[1:], a[1:] + f * (b[1:] - a[1:])))
    i = int(np.argmax(gaps)) + 1
    if gaps[i - 1] <= epsilon:
        return [0, len(points) - 1]
    left, right = plain_rdp(points[: i + 1], epsilon), plain_rdp(points[i:], epsilon)
    return left[:-1] + [i + k for k in right]


@pytest.mark.parametrize("seed", range(5))
def test_rdp(seed):
    rng = np.random.default_rng(seed)
    p = np.stack([np.arange(80.0), np.cumsum(rng.normal(size=80)), np.cumsum(rng.normal(size=80))], axis=1)
    assert np.flatnonzero(rec.rdp(p, 1.5)).tolist() == plain_rdp(p, 1.5)


@pytest.mark.parametrize("kind", ["walk", "spiral", "steps", "ties"])
def test_rdp_of_long_lines(kind, monkeypatch):
    """The tree finds the rows that a look at all rows finds, the first of equal ones too."""
    monkeypatch.setattr(rec, "DIRECT", 40)
    n = 3000
    rng, t = np.random.default_rng(9), np.arange(float(n))
    xy = {"walk": np.cumsum(rng.normal(size=(n, 2)), axis=0), "spiral": np.stack([t * np.cos(t / 40), t * np.sin(t / 40)], axis=1), "steps": np.round(rng.normal(size=(n, 2)) * 2), "ties": np.stack([t % 7, t % 5], axis=1)}[kind]
    points = np.column_stack([t, xy])
    for epsilon in (0.5, 3.0, 20.0):
        keep = np.zeros(n, bool)
        keep[[0, -1]] = True
        stack = [(0, n - 1)]
        while stack:
            a, b = stack.pop()
            if b - a >= 2:
                f = (t[a + 1 : b] - t[a]) / (t[b] - t[a])
                gap = np.sqrt(((xy[a + 1 : b] - (xy[a] + f[:, None] * (xy[b] - xy[a]))) ** 2).sum(axis=1))
                i = a + 1 + int(gap.argmax())
                if gap.max() > epsilon:
                    keep[i] = True
                    stack += [(a, i), (i, b)]
        assert rec.rdp(points, epsilon).tolist() == keep.tolist()


@pytest.mark.parametrize("n", [4, 5, 63, 64, 65, 66, 67, 130, 131, 132, 133, 1000, 5000])
def test_solve_equals_a_dense_one(n):
    rng = np.random.default_rng(n)
    first, second, x = rng.random(n - 1) * 50, rng.random(n - 2) * 500, rng.normal(size=n)
    got = rec._penalised(x, first, second)
    if n <= 1000:
        d1, d2 = np.diff(np.eye(n), axis=0), np.diff(np.eye(n), 2, axis=0)
        want = np.linalg.solve(np.eye(n) + d1.T @ np.diag(first) @ d1 + d2.T @ np.diag(second) @ d2, x)
        assert got == pytest.approx(want, rel=1e-8, abs=1e-10)
    back = got.copy()
    v = first * np.diff(got)
    back[:-1] -= v
    back[1:] += v
    w = second * np.diff(got, 2)
    back[:-2] += w
    back[1:-1] -= 2 * w
    back[2:] += w
    assert back == pytest.approx(x, abs=1e-8)


def test_rdp_of_few_rows():
    assert rec.rdp(np.zeros((0, 3)), 1.0).tolist() == []
    assert rec.rdp(np.zeros((1, 3)), 1.0).tolist() == [True]


def dense_trend(x, strength, rounds=5, scale=10.0):
    n = len(x)
    d1, d2 = np.diff(np.eye(n), axis=0), np.diff(np.eye(n), 2, axis=0)
    base = np.eye(n) + strength * scale * 0.2 * d1.T @ d1
    y = np.linalg.solve(base + strength**2 * scale * d2.T @ d2, x)
    for _ in range(rounds):
        w = 1 / np.maximum(np.abs(d2 @ y), 1e-4)
        y = np.linalg.solve(base + strength**2 * scale * d2.T @ np.diag(w / w.mean()) @ d2, x)
    return y


def test_trend_filter_equals_a_dense_solve():
    x = np.cumsum(np.random.default_rng(1).normal(size=60))
    assert np.allclose(rec.trend_filter(x, 3.0), dense_trend(x, 3.0), atol=1e-6)
    assert rec.trend_filter(x[:3], 3.0).tolist() == x[:3].tolist()


def test_cinematic_is_never_worse_and_smoother():
    x = np.cumsum(np.random.default_rng(2).normal(size=120))
    y = rec.cinematic(x)
    assert rec.cinematic_cost(y, x, 50.0, 5.0) < rec.cinematic_cost(x, x, 50.0, 5.0)
    assert np.abs(np.diff(y, 2)).mean() < 0.2 * np.abs(np.diff(x, 2)).mean()


def test_limits():
    x = np.array([0.0, 10.0, 10.0, -10.0])
    assert rec.slew_limited(x, 2.5).tolist() == [0.0, 2.5, 5.0, 2.5]
    assert rec.despiked(np.array([0.0, 9.0, 1.0])).tolist() == [0.0, 0.5, 1.0]
    assert rec.deadband_follow(np.array([1.0, 10.0]), damping=0.5).tolist() == [0.0, 5.0]
    assert rec.ema(np.array([1.0, 3.0, 2.0]), np.array([0.0, 0.1, 0.6])).tolist() == [1.0, 1.0, 0.3 * 2 + 0.7 * 1]


@pytest.mark.parametrize("method", ["ekf", "mahony", "complementary"])
def test_filters_find_a_steady_tilt(method):
    f = rec.FILTERS[method](30.0, 0.51 if method != "complementary" else 0.9)
    roll, pitch = math.radians(10.0), math.radians(5.0)
    force = (-math.sin(pitch), math.sin(roll) * math.cos(pitch), math.cos(roll) * math.cos(pitch))
    samples = np.tile([0.0, 0.0, 0.0, *force], (3000, 1))
    out, _ = rec.run_filter(f, f.start(1), np.array([0, 3000]), samples)
    assert out[-1, 0] == pytest.approx(10.0, abs=0.5) and out[-1, 1] == pytest.approx(5.0, abs=0.5)


def test_unknown_method_only_integrates():
    f = rec.FILTERS.get("something", rec.GyroOnly)(30.0, 0.5)
    out, _ = rec.run_filter(f, f.start(1), np.array([0, 30]), np.tile([3.0, 0.0, -3.0, 0.0, 0.0, 1.0], (30, 1)))
    assert out[-1] == pytest.approx((3.0, 0.0, -3.0))


@pytest.mark.parametrize("method", ["ekf", "mahony", "complementary", "gyro"])
def test_series_step_together_and_go_on(method):
    """Many series of odd lengths at once, in one piece or cut in two with the state carried, give what each gives alone."""
    rng = np.random.default_rng(3)
    f = rec.FILTERS.get(method, rec.GyroOnly)(30.0, 0.5)
    sizes = [7, 1, 30, 0, 12]
    start = np.concatenate([[0], np.cumsum(sizes)])
    samples = rng.normal(size=(sum(sizes), 6)) * 20
    samples[3, 3:] = 0.0  # no force felt
    both, _ = rec.run_filter(f, f.start(5), start, samples)
    for i, n in enumerate(sizes):
        mine = samples[start[i] : start[i + 1]]
        head, state = rec.run_filter(f, f.start(1), np.array([0, n // 2]), mine[: n // 2])
        tail, _ = rec.run_filter(f, state, np.array([0, n - n // 2]), mine[n // 2 :])
        assert both[start[i] : start[i + 1]] == pytest.approx(np.concatenate([head, tail]))


STEPS = {"despike": (rec.Despike(2, 0.8), 4), "slew": (rec.Slew(2, 0.7), 2), "rate": (rec.RateLimit(2.0), 2), "deadband": (rec.Deadband(deadband=0.5), 1), "ema": (rec.Ema(), 2), "chain": (rec.Chain(), 4), **{k: (f(30.0, 0.5), 6) for k, f in rec.FILTERS.items()}, "gyro": (rec.GyroOnly(30.0), 6)}


@pytest.mark.parametrize("name", sorted(STEPS))
def test_numbers_and_arrays_agree(name, monkeypatch):
    """A batch of lanes of odd lengths in frame order, cut anywhere, on arrays or on numbers."""
    f, width = STEPS[name]
    rng = np.random.default_rng(5)
    rows = sorted((frame, lane) for lane, n in enumerate([40, 1, 17, 33, 40, 2]) for frame in range(n))
    lane = np.array([x for _, x in rows])
    values = rng.normal(size=(len(rows), width)) * 3
    if name in ("rate", "ema"):
        values[:, 1] = [0.3 * frame for frame, _ in rows]
    outputs = len(f.step(rec.Numbers, f.parts, values[0].tolist())[0])
    found = {}
    for few in (0, 10**9):
        monkeypatch.setattr(rec, "FEW", few)
        for cut in (len(rows), 50, 7):
            state = f.start(6)
            found[few, cut] = np.concatenate([rec.walked(f, state, lane[i : i + cut], values[i : i + cut], outputs) for i in range(0, len(rows), cut)])
    for other in found.values():
        assert other == pytest.approx(found[0, len(rows)], rel=1e-9, abs=1e-9)


def test_a_task_walks_all_its_series(spark):
    """Long and short series in one table, ids that are texts, a null id, one row."""
    from pyspark.sql import functions as F

    lengths = {"long": 30000, "one": 1, **{f"s{i}": 50 + i for i in range(40)}}
    df = spark.createDataFrame([(k, n) for k, n in lengths.items()], "series_id string, n int").select("series_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame"))
    df = df.withColumn("x", F.sin(F.col("frame") * 7.0 + F.length("series_id")) * 10).unionByName(df.limit(1).select(F.lit(None).cast("string").alias("series_id"), "frame", F.lit(1.0).alias("x")))
    got = rec.scan(df.repartition(6), ["x"], ["x"], rec.Slew(1, 2.5)).toPandas()
    want = df.where("series_id is not null").toPandas()
    assert len(got) == sum(lengths.values())
    for k in ("long", "one", "s7", "s39"):
        mine, plain = got[got.series_id == k].sort_values("frame").x.to_numpy(), want[want.series_id == k].sort_values("frame").x.to_numpy()
        assert mine == pytest.approx(rec.slew_limited(plain, 2.5))
        assert np.abs(np.diff(mine)).max(initial=0.0) <= 2.5 + 1e-12


def turn(rng):
    q = rng.normal(size=4)
    w, x, y, z = q / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


@pytest.mark.parametrize("seed", range(4))
def test_kabsch_recovers_a_planted_rotation(seed):
    rng = np.random.default_rng(seed)
    r, b = turn(rng), rng.normal(size=(40, 3))
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    a = b @ r.T
    assert np.allclose(robust.rotations((b.T @ a)[None])[0], r)
    a[:8] = rng.normal(size=(8, 3))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    assert np.allclose(robust.kabsch_consensus(a, b), r, atol=1e-9)
    assert np.linalg.det(robust.rotations(rng.normal(size=(1, 3, 3)))[0]) == pytest.approx(1.0)


def test_smoothed_side_by_side_as_alone(spark, monkeypatch):
    rng = np.random.default_rng(5)
    series = [rng.normal(0, 10, n).cumsum() for n in (1, 3, 4, 5, 67, 40, 99, 130)]
    for many, alone in ((rec.cinematic_all, rec.cinematic), (lambda s: rec.trend_filter_all(s, 6.0), lambda x: rec.trend_filter(x, 6.0))):
        calls = []
        real = rec._penalised_all
        monkeypatch.setattr(rec, "_penalised_all", lambda *a: calls.append(1) or real(*a))
        for x, y in zip(series, many(series), strict=True):
            assert np.allclose(y, alone(x), atol=1e-6)
        assert len(calls) <= 60  # solves of all series at once
        monkeypatch.undo()
    rows = [(i, k, float(v)) for i, x in enumerate(series) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id long, frame long, roll double")
    got = rec.side_by_side(df, ("roll",), ("roll",), lambda found: [x[::-1].copy() for x in found]).collect()
    assert sorted((r.series_id, r.frame, r.roll) for r in got) == sorted((i, k, float(v)) for i, x in enumerate(series) for k, v in enumerate(x[::-1]))
