"""Known results of composed operators."""

from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helmtrack.functions import rotation, text
from helmtrack.operators import catalog, checkpoints, index, joins, metrics, robust, search, stages, trajectory


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("peak", "jitter", "overall", "dy", "sidecar", "want"), [(-6.1, 6.6, 7.4, 19.3, None, "+6.8%"), (2.4, 4.2, 6.0, 13.4, None, "+6.5%"), (5.0, 5.0, -15.0, 11.0, None, "+7.0%"), (-3.4, -1.3, -1.4, -4.6, 84.7, "+84.7%"), (10.5, 8.1, -6.2, -24.4, None, "+9.3%")])
def test_composite_scores(spark, peak, jitter, overall, dy, sidecar, want):
    c = metrics.composite(*[F.lit(x) for x in (peak, jitter, overall, dy)], F.lit(True), None if sidecar is None else F.lit(sidecar))
    assert one(spark, metrics.percent_text(c)) == want


def test_cadence(spark):
    def frames(total, fps, interval, most=None):
        t = spark.createDataFrame([("a", total)], "series_id string, total bigint")
        return [r.frame for r in checkpoints.cadence(t, fps=fps, interval=interval, most=most).orderBy("frame").collect()]

    assert frames(90, 30.0, 0.5) == [0, 15, 30, 45, 60, 75, 89]
    assert len(frames(27000, 30.0, 0.5, 60)) <= 60
    assert frames(1, 30.0, 0.5) == [0] and frames(0, 30.0, 0.5) == []


def curve(spark, values):
    return spark.createDataFrame([("a", i, float(v), 0.0) for i, v in enumerate(values)], "series_id string, frame bigint, pitch double, roll double")


def test_checkpoints_of_curves(spark):
    sine = checkpoints.from_extrema(curve(spark, [3 * math.sin(2 * math.pi * i / 30) for i in range(90)]), fps=30.0).orderBy("frame").collect()
    assert len(sine) > 3 and (sine[0].frame, sine[-1].frame) == (0, 89)
    assert {r.kind for r in sine} == {"boundary", "crest", "trough"}
    flat = checkpoints.from_extrema(curve(spark, [0.05 * ((i * 7919 % 101) / 50 - 1) for i in range(1000)]), fps=30.0).collect()
    assert len(flat) == 2
    few = checkpoints.from_extrema(curve(spark, [5 * math.sin(4 * math.pi * i / 30) for i in range(1000)]), fps=30.0, most=25).collect()
    assert len(few) <= 25


def test_rotations_are_orthogonal(spark):
    m = [F.col(f"m{i}") for i in range(9)]
    r = spark.createDataFrame([(10.0, 20.0, 30.0), (-170.0, 89.0, 3.0)], "y double, p double, r double").select(*[v.alias(f"m{i}") for i, v in enumerate(rotation.matrix(F.col("y"), F.col("p"), F.col("r")))])
    for row in r.select(*[v.alias(f"p{i}") for i, v in enumerate(rotation.product(m, rotation.transposed(m)))]).collect():
        assert list(row) == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1], abs=1e-12)


def test_right_angle_has_no_roll(spark):
    m = [F.col(f"m{i}") for i in range(9)]
    r = spark.range(1).select(*[v.alias(f"m{i}") for i, v in enumerate(rotation.matrix(40.0, 90.0, 0.0))])
    assert list(r.select(*rotation.euler(m)).first()) == pytest.approx([40.0, 90.0, 0.0], abs=1e-6)


def test_composition_of_still_stages_keeps_the_grid(spark):
    still = spark.createDataFrame([("a", float(t), 0.001, 0.0, 0.0) for t in range(3)], "series_id string, t double, yaw double, pitch double, roll double")
    out = stages.compose([still, still.limit(1)]).orderBy("frame").collect()
    assert [(r.t, round(r.yaw, 6)) for r in out] == [(0.0, 0.001), (1.0, 0.001), (2.0, 0.001)]


def test_telemetry_levels_and_follows_modes(spark):
    rows = spark.createDataFrame([("a", i, 2.0, 4.0, 1.0) for i in range(6)], "series_id string, frame bigint, roll double, pitch double, yaw double")
    level = stages.telemetry(rows, mode="level").orderBy("frame").collect()
    assert all(abs(r.roll) < 1e-12 and abs(r.pitch) < 1e-12 and r.yaw == 0 for r in level)
    zero = stages.telemetry(rows, mode="zero").orderBy("frame").collect()
    assert sum(r.pitch for r in zero) == pytest.approx(-4.0) and zero[0].t_start == 0.0
    for mode in ("smooth", "lock"):
        assert stages.telemetry(rows, mode=mode).count() == 6
    assert stages.telemetry(rows, mode="level", fusion="ekf").count() == 6


def test_travel_direction_narrows_a_weave(spark):
    rows = spark.createDataFrame([("a", i, 20 * math.sin(math.pi * i / 30)) for i in range(90)], "series_id string, frame bigint, yaw double")
    for mode in ("travel_direction", "damped_follow", "target_lock"):
        out = stages.travel_direction(rows, mode=mode, damping=0.85, deadband=1.5).toPandas()
        assert len(out) == 90
        if mode != "damped_follow":
            assert out.locked_yaw.std() < out.raw_yaw.std()


def test_texts(spark):
    assert one(spark, text.clock(F.lit(3723.4))) == "01:02:03"
    assert one(spark, text.clock(F.lit(-5.0))) == "00:00:00"
    assert one(spark, text.subtitle_clock(F.lit(3723.999))) == "1:02:03.99"
    assert one(spark, text.seconds(F.lit("1:x"))) is None
    assert one(spark, text.listed(F.lit('["a", "b"]'))) == ["a", "b"] == one(spark, text.listed(F.lit("a, b,")))
    assert one(spark, text.clip_offset(F.lit("run_300_600.mp4"), 30.0)) == 10.0
    assert one(spark, text.natural_key(F.lit("A10b2"))) > one(spark, text.natural_key(F.lit("a9b30")))


def test_search(spark):
    docs = spark.createDataFrame([("1", "alpha beta beta"), ("2", "gamma"), ("3", "betatron"), ("4", None)], "id string, content string")
    assert [r.id for r in search.search(docs, "beta!").collect()] == ["3", "1"]  # the shorter one first
    assert search.search(docs, "zeta").count() == 0
    assert [r.id for r in search.search(docs, "a").collect()] == ["1", "2", "3"]  # too short to rank
    assert search.terms("A b-c, d.e x") == ["b-c", "d.e"]


def test_catalog(spark):
    assert one(spark, catalog.next_prefix(F.lit(9999))) == 1001
    assert one(spark, catalog.preset_value(F.lit('{"a": "1.5"}'), "a", "double", 0.0)) == 1.5
    assert one(spark, catalog.degraded(F.lit("X : 1\nSTATUS : NO (UNSTABILIZED) -23.8%")))
    assert not one(spark, catalog.degraded(F.lit("STATUS : YES (STABILIZED) +36.0%")))


def test_a_long_series_is_interpolated_in_linear_time(spark):
    """200,000 points and as many grid rows of one series; frames to the series' end would take hours."""
    import time

    n = 200_000
    points = spark.range(n).select(F.lit("a").alias("k"), (F.col("id") * 2.0).alias("t"), (F.col("id") * 4.0).alias("v"))
    grid = spark.range(n).select(F.lit("a").alias("k"), (F.col("id") * 2.0 + 1.0).alias("t"))
    began = time.perf_counter()
    found = joins.interpolated(points, grid, "k", "t", ["v"])
    wrong = found.where(F.abs(F.col("v") - F.least(F.col("t") * 2, F.lit(4.0 * (n - 1)))) > 1e-6)
    assert (found.count(), wrong.count()) == (n, 0)
    assert time.perf_counter() - began < 60


def test_places_of_all_rows(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 977).alias("a"), F.col("id").alias("b"))
    got = [(r.a, r.b, r.place) for r in catalog.placed(rows.repartition(7), "a", "b").collect()]
    want = sorted((i * 7919 % 977, i) for i in range(5000))
    assert sorted(got, key=lambda r: r[2]) == [(*x, k) for k, x in enumerate(want, 1)]
    assert catalog.placed(rows.limit(0), "a", "b").count() == 0


def test_quaternions_of_matrices(spark):
    rows = [(10.0, 20.0, 30.0), (179.0, 5.0, -3.0), (0.0, 89.0, 170.0), (-120.0, -60.0, 95.0), (0.0, 0.0, 180.0), (180.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "roll double, pitch double, yaw double").withColumn("q", rotation.quaternion_zyx(F.col("roll"), F.col("pitch"), F.col("yaw")))
    w, x, y, z = (F.col("q")[n] for n in "wxyz")
    m = [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]
    df = df.select("*", *[v.alias(f"m{i}") for i, v in enumerate(m)])
    cells = [F.col(f"m{i}") for i in range(9)]
    back = df.select(F.abs(rotation.dot(F.col("q"), trajectory.of_matrix(cells))).alias("same"), *[v.alias(n) for v, n in zip(trajectory.euler_zyx_of(cells), ("y", "p", "r"), strict=True)], "roll", "pitch", "yaw").collect()
    assert [r.same for r in back] == pytest.approx([1.0] * len(rows), abs=1e-9)
    assert [(r.r, r.p, r.y) for r in back[:4]] == [pytest.approx(r, abs=1e-6) for r in rows[:4]]


def test_key_rotations_are_chained_and_taken_back(spark):
    """A camera that turns by 2 degrees a key frame: the chain undoes it; a turn from two pairs is left out."""
    turn = lambda deg: rotation.quaternion_zyx(0.0, 0.0, F.lit(deg))
    rows = spark.range(6).select(F.lit("a").alias("series_id"), (F.col("id") * 10).alias("frame"), F.when(F.col("id") == 3, 2).otherwise(9).alias("matches"), turn(2.0).alias("q"))
    turns = rows.select("series_id", "frame", "matches", *[F.col("q")[p].alias(p) for p in trajectory.PARTS])
    keys = trajectory.chained(turns)
    yaw = keys.select("frame", rotation.euler_zyx(rotation.quaternion(*[F.col(p) for p in trajectory.PARTS]))[2].alias("yaw")).orderBy("frame")
    assert [r.yaw for r in yaw.collect()] == pytest.approx([0, -2, -4, -4, -6, -8], abs=1e-9)
    frames = spark.range(51).select(F.lit("a").alias("series_id"), F.col("id").alias("frame"))
    for options in ({}, {"deformed": True}, {"reapply": True}):
        out = trajectory.corrections(keys, frames, smoothing=6.0, **options).orderBy("frame").collect()
        assert len(out) == 51 and all(abs(r.yaw) <= 5 and abs(r.pitch) < 1e-6 for r in out)
        assert abs(out[15].yaw) < (0.1 if "reapply" not in options else 1.0)  # an even turn needs no correction


def test_rows_that_lie_apart(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(int(i) % 3, int(i), *map(float, r)) for i, r in enumerate(v)], "f int, id int, x double, y double, z double")
    got = sorted(r.id for r in trajectory.separated(df, "f", "id", ("x", "y", "z"), 25.0).collect())
    want = []
    for f in range(3):
        taken = []
        for i in range(f, 120, 3):
            if all(math.acos(max(-1.0, min(1.0, float(v[i] @ v[j])))) >= math.radians(25.0) for j in taken):
                taken.append(i)
        want += taken
    assert got == sorted(want) and len(got) < 120


def test_presets_are_stamped(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": [1, null]}, "type": "old"}',), ("[1]",), ("{}",), (None,)], "j string")
    got = [r.v for r in df.select(catalog.preset_document(F.col("j"), F.lit("2026-01-02T03:04:05")).alias("v")).collect()]
    assert got == ['{"a":1,"b":{"c":[1,null]},"type":"pipeline_config","saved_at":"2026-01-02T03:04:05"}', None, '{"type":"pipeline_config","saved_at":"2026-01-02T03:04:05"}', None]


def test_density_and_windows_of_checkpoints(spark):
    rows = curve(spark, [5 * math.sin(2 * math.pi * i / 60) for i in range(300)])
    n = {d: checkpoints.by_density(rows, d, fps=30.0).count() for d in ("low", "medium", "high")}
    assert n["low"] < n["medium"] < n["high"]
    some = [r.frame for r in checkpoints.from_extrema(rows, fps=30.0, frames=(100, 200)).collect()]
    assert set(some) - {0, 299} and all(100 <= f <= 200 for f in some if f not in (0, 299))


def plain_nearest(points, targets):
    def metres(a, b):
        la, lo, lb, ob = map(math.radians, (*a, *b))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
        return 6371000.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    return {t: min((metres(t, p), i) for i, p in enumerate(points)) for t in targets}


def test_nearest_by_cells(spark):
    """Clusters, poles, both sides of the date line, equal places; every find is the least of all."""
    rng = random.Random(0)
    points = [(40 + rng.random() * 0.01, 20 + rng.random() * 0.01) for _ in range(300)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(40)]
    points += [(89.9, 10.0), (-89.95, 0.0), (5.0, 179.99), (5.0, 179.99), (0.0, 180.0)]
    targets = [(40.005, 20.005), (39.0, 19.0), (89.9, -170.0), (-90.0, 55.0), (5.0, -179.99), (0.0, -180.0), (-40.0, 150.0)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(30)]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)] + [(9999, None, 1.0)], "i int, lat double, lon double").repartition(4)
    t = spark.createDataFrame([(*x, "extra") for x in targets] + [(None, 2.0, "x")], "tlat double, tlon double, note string")
    got = {(r.tlat, r.tlon): r for r in joins.nearest(p, t, order="i", target=("tlat", "tlon")).collect()}
    want = plain_nearest(points, targets)
    assert set(got) == set(want)
    for k, (metres, _) in want.items():
        assert got[k].distance == pytest.approx(metres, rel=1e-6, abs=1e-3), k
        at = (got[k].point.lat, got[k].point.lon)
        assert got[k].note == "extra" and points.index(at) == got[k].point.i
    assert joins.nearest(p.limit(0), t, order="i", target=("tlat", "tlon")).count() == 0


def test_nearest_makes_no_pairs_of_all(spark):
    """Hundreds of thousands of targets and points in one go; the finest cells hold about a point."""
    grid = lambda n, a, b: spark.range(n).select(F.col("id").alias("i"), (F.col("id") * a % 100003 / 1000.0 - 50).alias("lat"), (F.col("id") * b % 200003 / 1000.0 - 100).alias("lon"))
    found = joins.nearest(grid(100000, 7919, 104729), grid(100000, 3571, 50021).withColumnRenamed("i", "j"), order="i")
    r = found.agg(F.count("*").alias("n"), F.max("distance").alias("far")).first()
    assert r.n == 100000 and r.far < 500_000
    sample = found.where("j % 20000 = 7").collect()
    every = [(x.lat, x.lon) for x in grid(100000, 7919, 104729).collect()]
    want = plain_nearest(every, [(x.lat, x.lon) for x in sample])
    assert all(x.distance == pytest.approx(want[x.lat, x.lon][0], rel=1e-6) for x in sample)


@pytest.mark.parametrize("width", [16, 64])
def test_mutual_nearest_by_parts(spark, width):
    rng = random.Random(width)
    base = [rng.getrandbits(width) for _ in range(60)]
    rows = []
    for i in range(240):
        bits = rng.choice(base)
        for _ in range(rng.choice([0, 0, 1, 3, 9, 30])):
            bits ^= 1 << rng.randrange(width)
        rows.append((i % 2, i // 80, i // 2, bits))
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    df = spark.createDataFrame([(s, f, i, signed(b)) for s, f, i, b in rows], "side int, f int, id int, bits bigint")
    got = {tuple(r) for r in robust.mutual_nearest(df.where("side = 0"), df.where("side = 1"), "f", "bits", "id", width=width).collect()}
    want = set()
    for f in range(3):
        a, b = ([(i, x) for s, g, i, x in rows if s == side and g == f] for side in (0, 1))
        to = lambda v, others: min(((v ^ y).bit_count(), j) for j, y in others)
        want |= {(f, i, to(x, b)[1], to(x, b)[0]) for i, x in a if to(dict(b)[to(x, b)[1]], a)[1] == i}
    assert got == want


def test_index(spark, tmp_path):
    """Upserts append; what they replace and what is removed is found no more; a batch is taken once, a failed one again."""
    docs = [(i, None if i == 3 else f"alpha beta{i % 4} gamma-delta " + "word " * (i % 5) + ("alphabet" if i % 3 == 0 else "")) for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, content string")
    found = index.Index(spark, str(tmp_path / "idx"))
    assert found.bm25("alpha").count() == 0 and found.upsert(frame(docs[:40]), "one")
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "idx").rglob("*.parquet")}
    newer = [(i, f"gamma {t}") for i, t in docs[30:60]]
    (tmp_path / "idx/postings/batch=two/lead=al").mkdir(parents=True)
    frame([(99, "x")]).write.parquet(str(tmp_path / "idx/documents/batch=two"))  # a run that failed before its end
    same = lambda now: all([tuple(r) for r in found.bm25(q, limit=9).collect()] == [tuple(r) for r in search.bm25(frame(now), q, limit=9).collect()] for q in ("alpha", "gamma delta", "beta2 word", "al", "zeta", "b-e"))
    assert same(docs[:40])
    assert found.upsert(frame(newer), "two") and same(docs[:30] + newer)
    assert not found.upsert(frame(docs), "two") and same(docs[:30] + newer)
    assert found.remove(frame([(5, None), (45, None), (777, None)]), "three")
    assert same([x for x in docs[:30] + newer if x[0] not in (5, 45)])
    assert {p: p.stat().st_mtime_ns for p in files} == files
    assert [r.docs for r in found.history().orderBy("place").collect()] == [40, 60, 58]
    plan = found.bm25("gamma")._jdf.queryExecution().toString()
    assert "lead" in plan.split("PartitionFilters")[1][:200]
    with pytest.raises(ValueError):
        found.upsert(frame(docs), "a/b")


def test_index_keeps_lists_of_documents(spark, tmp_path):
    """A term has a row a task's stretch of text, not a row a document; odd texts and ids of another kind are found as by the plain search."""
    texts = ["Alpha \u00c4b-ALPHA\nx1 \u212aelvin", "", None, "\u00df \u0130stanbul alpha", "--", "beta\x00gamma " * 50, "\U0001f600alphabet\u00e9"]
    docs = spark.createDataFrame([(f"d{i:04}", texts[i % 7]) for i in range(2100)], "id string, content string").repartition(3, "id")
    found = index.Index(spark, str(tmp_path / "idx"), "string")
    assert found.upsert(docs, "one")
    for q in ("alpha", "kelvin b", "stanbul gamma", "x1 alp", "zeta"):
        assert [tuple(r) for r in found.bm25(q, limit=700).collect()] == [tuple(r) for r in search.bm25(docs, q, limit=700).collect()], q
    r = found.table("postings").where("term = 'alpha'").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("docs")).alias("docs")).first()
    assert r.rows <= 3 and r.docs == 600
    assert found.living().count() == 2100 and found.history().first().words == 300 * (5 + 3 + 100 + 1)


def test_index_deals_a_frequent_lead(spark):
    """A lead that most words have is dealt to most tasks, a rare one to one; long texts are cut between documents."""
    text = pa.array([" ".join(["the"] * 3 + [f"th{i}x{j}" for j in range(9)] + ["zz"]) for i in range(400)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), text], names=["id", "text"])
    (rows,) = index._listing(40)(iter([batch]))
    parts = {}
    for lead, part in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        parts.setdefault(lead, set()).add(part)
    assert len(parts["th"]) > 20 and parts["zz"] <= set(range(4)) and max(parts["th"]) < 40
    assert {len(d) for t, d in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True) if t in ("the", "zz", index.LISTED)} == {400}


def test_companions_meet_in_rows_of_folders(spark):
    """As by looking for each name; a video gives a row a folder to the join, not a row a name."""
    rng = random.Random(3)
    names = ["v1", "v1.mp4", "v1.mov", "v1_telemetry", ".mp4", "a.b.c", "v1.mp4.gcsv", "", "v\u00e92.MP4"]
    videos = [(f + n, rng.choice(["auto", "gyroflow", "witmotion", "custom_csv", None])) for f in ("", "in/", "work/", "/", "in/work/") for n in names for _ in (0, 1)]
    tails = [x.split("}")[1] for x in (*catalog.RATE_LOGS, *catalog.ANGLE_LOGS)]
    files = [(f + n + t, rng.choice([0, 1, 5])) for f in ("", "in/", "work/", "/", "in/work/") for n in (*names, "v") for t in (*tails, ".mp4") for _ in (0, 1)] + [(None, 3), ("in/v1.gcsv", None)]
    there = {p for p, n in files if p and n}
    folder = lambda v: v.rpartition("/")[0]

    def names_of(video, hint):
        name = video.rpartition("/")[2]
        stem = name[: name.rfind(".")] if name.rfind(".") > 0 else name
        for endings in (catalog.RATE_LOGS, catalog.ANGLE_LOGS):
            if catalog.HINTS.get(hint, endings) == endings:
                for at in (folder(video), "work", "in"):
                    yield from ((at + "/" if at else "") + e.format(name=name, stem=stem) for e in endings)

    want = set()
    for v in {v for v, _ in videos}:
        kinds = [list(names_of(v, h)) for x, h in videos if x == v]
        every = [p for p in names_of(v, None) if any(p in k for k in kinds) and p in there]
        want |= {(v, i + 1, p) for i, p in enumerate(dict.fromkeys(every))}
    found = catalog.companions(spark.createDataFrame(videos, "path string, hint string"), spark.createDataFrame(files, "path string, size int"), folders=["work", "in"])
    got = [tuple(r) for r in found.select("video", "place", "path").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(" not in plan and plan.count("Generate") == 2


def test_parts_of_a_checkpoint_are_found_once(spark):
    """The work of a line doesn't grow with how often its parts are named."""
    plan = spark.range(1).select(text.checkpoint_list(F.col("id").cast("string")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert "more fields" not in plan and 0 < plan.count("regexp_extract(") <= 10 and 0 < plan.count("get_json_object(") <= 4 and 0 < plan.count("from_json(") <= 1
    read = lambda x: [tuple(p) for p in one(spark, text.checkpoint_list(F.lit(x).cast("string")))]
    assert read("# a\n00:01:10, 48.5, 11.25\n\n5, 6, 7m\n1, 2:00, 3\n9, 1, 2, 3z") == [(48.5, 11.25, 70.0, None), (5.0, 6.0, None, 7.0), (1.0, 2.0, 9.0, 3.0)]
    assert read('[{"lat": "1.5", "lon": 2, "time": "1:00", "ele": "8m"}, {"lat": 1}, "x"]') == [(1.5, 2.0, 60.0, 8.0)] and read(None) == []
    assert read('["0:30 https://maps/@48.1,11.2,315m", "https://maps/!3d1.5!4d2.5/@3.5,4.5z", "@1, 2, 3"]') == [(48.1, 11.2, 30.0, 315.0), (1.5, 2.5, None, None)]


def test_nearest_descriptors_are_never_broadcast(spark, monkeypatch):
    from helmtrack.operators import robust

    plans, real = [], robust.written

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(robust, "written", kept)
    df = spark.range(4000).select((F.col("id") / 40).cast("bigint").alias("f"), "id", F.col("id").bitwiseXOR(F.col("id") * 77).alias("bits"))
    out = robust.mutual_nearest(df.where("id % 2 = 0"), df.where("id % 2 = 1"), "f", "bits", "id", width=32)
    assert out.count() > 0
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert plans and not any("Broadcast" in p for p in plans)


def test_points_at_one_time_keep_their_order(spark):
    from helmtrack.operators import track

    # frames 1 and 2 are at one place, so at one time: what comes before blends into 9, what comes after starts from 2
    points = [(1, 0, 0.0, 0.0, 5.0, None), (1, 1, 0.0, 2.0, 9.0, None), (1, 2, 0.0, 2.0, 2.0, None), (1, 3, 0.0, 4.0, 4.0, None)]
    df = spark.createDataFrame(points, "series_id long, frame long, lat double, lon double, ele double, time double")
    got = track.route(df, spark.createDataFrame([(1, 4.0)], "series_id long, length double")).orderBy("sec").collect()
    assert [r.ele for r in got] == [5.0, 7.0, 2.0, 3.0, 4.0]


def test_tasks_follow_the_size_of_what_is_dealt(spark, tmp_path, monkeypatch):
    from helmtrack import storage

    spark.range(20000).select((F.col("id") % 300).alias("series_id"), "id").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(storage, "TASK_BYTES", 1 << 13)
    few, many = (storage.dealt(x, "series_id").select("series_id", F.spark_partition_id().alias("p")).distinct() for x in (df.where("id < 0"), df.union(df).union(df)))
    assert many.count() == 300 and many.select("p").distinct().count() > 8
    assert few.count() == 0
