"""Readers and writers on small files of every format."""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from helmtrack.operators import catalog, track
from helmtrack.sinks import files as sink
from helmtrack.sources import binary, logs, tracks


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("series_id", "frame").select(*columns).collect()]


def test_imu_log(spark, tmp_path):
    head = ["GYROFLOW IMU LOG", "version,1.3", "id,x", "orientation,Xyz", "tscale,1.0", "gscale,0.017", "ascale,1.0", "t,gx,gy,gz,ax,ay,az"]
    (tmp_path / "a.gcsv").write_text("\n".join([*head, "0.0,1,2,3,0,0,1", "0.5,1,2,3,0,0,1", "bad,line", "2000,4,0,0,0,0,1"]) + "\n")
    log = logs.imu_log(spark, str(tmp_path))
    assert rows(log, "frame", "t", "gx") == [(0, 0.0, 1.0), (1, 0.5, 1.0), (2, 2.0, 4.0)]  # 2000 is milliseconds
    assert rows(logs.integrated(log), "roll") == [(0.0,), (0.5,), (6.5,)]


def test_euler_log(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Time\tAngleX(deg)\tAngleY(deg)\tAngleZ(deg)\n0\t1\t2\t3\n0.1\tx\t2\t3\n0.2\t4\t5\t6\n")
    (tmp_path / "b.txt").write_text("yaw;pitch;roll\n3;2;1\n")
    assert rows(logs.euler_log(spark, str(tmp_path)), "frame", "roll", "pitch", "yaw") == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0), (0, 1.0, 2.0, 3.0)]


def test_motion_and_commands(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.motion").write_text("# frame key yaw pitch roll\n0 1 0.5 1.5 2.5\n1 0 x 1 1\n2 0 1 2 3\n")
    assert rows(logs.motion(spark, str(tmp_path / "m"), "kopf"), "frame", "yaw", "pitch", "roll") == [(0, 0.5, 1.5, 2.5), (2, 1.0, 2.0, 3.0)]
    (tmp_path / "c").mkdir()
    body = "".join(f"{t:.6f}-{t + 1:.6f} [enter] v360 {a} {v:.6f};\n" for t in (0.0, 1.0) for a, v in (("yaw", 1.0), ("pitch", 2.0), ("roll", -3.0)))
    (tmp_path / "c/a.txt").write_text("# format: delta\n" + body)
    (tmp_path / "c/b.txt").write_text(body)
    out = logs.commands(spark, str(tmp_path / "c"))
    assert rows(out, "frame", "yaw", "roll") == [(0, 1.0, -3.0), (1, 2.0, -6.0), (0, 1.0, -3.0), (1, 1.0, -3.0)]
    assert {r.fps for r in logs.rate(out).collect()} == {1.0}


def box(kind, payload):
    return struct.pack(">I4s", 8 + len(payload), kind) + payload


def test_boxes_and_orientation(spark, tmp_path):
    records = struct.pack(">6i", 100, 1000, 10, 50, 1, 200) + struct.pack(">6i", 0, 5, 1, -190, 2, 3)
    media = box(b"ftyp", b"isom") + box(b"moov", box(b"udta", box(b"vrot", b"\0\0\0\0" + records))) + struct.pack(">I4s", 0, b"mdat") + b"xyz"
    (tmp_path / "a.mp4").write_bytes(media)
    found = binary.files(spark, str(tmp_path))
    assert [r.box for r in binary.boxes(found).orderBy("offset").collect()] == ["ftyp", "moov", "moov/udta", "moov/udta/vrot", "mdat"]
    assert rows(binary.box_orientation(found), "roll", "pitch", "yaw") == [(-160.0, 5.0, 10.0), (1.5, 170.0, 0.0)]


def test_streams(spark, tmp_path):
    klv = b"CORIs\x02" + struct.pack(">H", 4) + struct.pack(">4h", 32767, 0, 0, 0) + b"ABCDb\x01" + struct.pack(">H", 3) + b"abc\0"
    (tmp_path / "a.bin").write_bytes(klv)
    assert rows(binary.stream_orientation(binary.files(spark, str(tmp_path)), "klv"), "roll", "pitch", "yaw") == [(0.0, 0.0, 0.0)]
    packets = struct.pack("<HH3f", 0, 0, 1, 2, 3) + struct.pack("<HH4f", 0, 4, 0.0, 0.0, np.sin(np.pi / 4), np.cos(np.pi / 4)) + b"\0" * 8
    assert [q[:, [0, 3]].round(6).tolist() for q in binary.packet_quaternions(binary.Held(packets))] == [[[0.707107, 0.707107]]]
    assert list(binary.packet_quaternions(binary.Held(b""))) == []


def test_a_recording_of_many_gigabytes(spark, tmp_path):
    """Heads and the payload are read, the pictures between them are not; the payload is dealt out in ranges."""
    n = 50000
    angles = np.arange(n) % 359
    records = np.zeros((n, 6), ">i4")
    records[:, 0::2], records[:, 5] = 100, angles * 100
    tail = box(b"moov", box(b"trak", b"") + box(b"udta", box(b"vrot", b"\0\0\0\0" + records.tobytes())))
    at = tmp_path / "long recording.mp4"
    with open(at, "wb") as f:
        f.write(box(b"ftyp", b"isom") + struct.pack(">I4sQ", 1, b"mdat", 16 + 5 * 10**9))
        f.seek(5 * 10**9, 1)
        f.write(tail)
    found = binary.files(spark, str(tmp_path))
    assert found.columns == ["series_id", "length"]
    assert [(r.box, r.size) for r in binary.boxes(found).orderBy("offset").collect()][1:3] == [("mdat", 16 + 5 * 10**9), ("moov", len(tail))]
    assert binary.ranges(found, lambda d: tuple(x + y for x, y in zip(binary.find(d, "moov/udta/vrot"), (4, 0), strict=True)), 24, size=1 << 18).count() == 5
    got = binary.box_orientation(found, size=1 << 18).orderBy("frame").select("frame", "roll").toPandas()
    assert got.frame.tolist() == list(range(n)) and got.roll.tolist() == np.where(angles > 180, angles - 360, angles).tolist()
    with binary.Stored(str(at)) as data:
        start, end = binary.find(data, "moov/udta/vrot")
        assert end - start == 4 + n * 24 and data.fetched < 20000


def test_contents_give_what_files_give(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(struct.pack("<q", 700) + np.arange(3500.0).tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    stored = binary.files(spark, str(tmp_path))
    held = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("path as series_id", "content")
    assert rows(binary.binary_motion(stored, size=4000), "series_id", "frame", "yaw") == rows(binary.binary_motion(held), "series_id", "frame", "yaw")
    assert binary.binary_motion(stored).count() == 700


def test_lines_of_split_files(spark, tmp_path):
    """Numbers of lines and frames don't depend on where a file is cut; many tasks read it."""
    for name, n in (("a.gcsv", 30000), ("b.gcsv", 3), ("c.gcsv", 9000)):
        body = [f"{i / 100},{i % 7},2,3,0,0,1\r" if i % 13 else "" if i % 2 else "no,number" for i in range(n)]
        (tmp_path / name).write_bytes("\n".join(["LOG", "x", "t,gx,gy,gz,ax,ay,az", *body, ""]).encode())
    whole = sorted(map(tuple, logs.lines(spark, str(tmp_path)).collect()))
    log = rows(logs.imu_log(spark, str(tmp_path)), "series_id", "frame", "t", "gx")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        cut = logs.lines(spark, str(tmp_path))
        assert cut.rdd.getNumPartitions() > 10
        assert sorted(map(tuple, cut.collect())) == whole
        assert rows(logs.imu_log(spark, str(tmp_path)), "series_id", "frame", "t", "gx") == log
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    a = [x for x in whole if x[0].endswith("a.gcsv")]
    assert [n for _, n, _ in a] == [i for i in range(30003) if i < 3 or (i - 3) % 13 or not (i - 3) % 2]
    assert [f for s, f, *_ in log if s.endswith("a.gcsv")] == list(range(sum(1 for i in range(30000) if i % 13)))


def test_frames_over_many_spans(spark, monkeypatch):
    monkeypatch.setattr(logs, "SPAN", 10)
    df = spark.range(1000).selectExpr("cast(id % 3 as string) as series_id", "id * 7 as n", "id as x").where("x % 5 <> 1")
    got = logs.renumbered(df).collect()
    want = {}
    for r in sorted(got, key=lambda r: r.x):
        assert r.frame == want.get(r.series_id, 0)
        want[r.series_id] = r.frame + 1
    assert len(got) == 800


def test_binary_motion(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(struct.pack("<q", 2) + np.arange(10.0).tobytes())
    (tmp_path / "cut.bin").write_bytes(struct.pack("<q", 9) + np.arange(10.0).tobytes())
    assert rows(binary.binary_motion(binary.files(spark, str(tmp_path))), "t_start", "roll") == [(0.0, 4.0), (5.0, 9.0)]


def test_gpx_round_trip(spark, tmp_path):
    points = spark.createDataFrame([("a", s, 46.5 + s * 0.001, 11.3, 315.0) for s in range(4)], "series_id string, sec int, lat double, lon double, ele double")
    (tmp_path / "t.gpx").write_text(sink.gpx(points, "2026-01-02 03:04:05").first()["document"])
    back = tracks.gpx(spark, str(tmp_path / "t.gpx"))
    assert rows(back, "lat", "ele") == [(46.5 + s * 0.001, 315.0) for s in range(4)]
    assert str(back.agg(F.min("time")).first()[0]) == "2026-01-02 03:04:05"


def test_track_over_a_window_of_91_rows(spark):
    fixes = spark.createDataFrame([("a", i, 60.0 * i, 46.513 + i * 0.002 - (0.001 if i == 0 else 0.0), 11.0 + i, 300.0) for i in range(4)], "series_id string, frame int, sec double, lat double, lon double, ele double")
    windows = spark.createDataFrame([("a", 60.0, 90)], "series_id string, start double, length int")
    out = track.synchronised(fixes, windows).orderBy("sec").collect()
    assert len(out) == 91 and out[30].lon == 12.5 and out[0].lon == 12.0 and out[90].lon == 13.5


def test_route_and_checkpoints(spark, tmp_path):
    (tmp_path / "p.txt").write_text("00:00:00, 46.0, 11.0, 300m\n# note\n00:01:00, 46.5, 11.5, 310m\n00:02:00, 47.0, 12.5, 320m\n")
    p = tracks.checkpoints(spark, str(tmp_path))
    assert rows(p, "frame", "lat", "time", "ele") == [(0, 46.0, 0.0, 300.0), (1, 46.5, 60.0, 310.0), (2, 47.0, 120.0, 320.0)]
    out = track.route(p, p.select("series_id").distinct().withColumn("length", F.lit(120.0))).orderBy("sec").collect()
    assert len(out) == 121 and (out[30].lat, out[60].lon, out[120].ele) == (46.25, 11.5, 320.0)


def test_levelling_documents_and_presets(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h/a.json").write_text(json.dumps({"fps": 30.0, "ignoreYaw": False, "checkpoints": [{"frame": 3, "pitch": 1.5, "yaw": 2.0}, {"time": 2.0, "roll": 4.0}, {"pitch": 1}]}))
    (tmp_path / "h/b.json").write_text(json.dumps([{"frame": 1, "yaw": 9.0}]))
    assert rows(tracks.levelling(spark, str(tmp_path / "h")), "frame", "pitch", "roll", "yaw") == [(3, 1.5, 0.0, 2.0), (60, 0.0, 4.0, 0.0), (1, 0.0, 0.0, 0.0)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/one.json").write_text('{"type": "export", "fov": "90"}')
    (tmp_path / "p/two.json").write_text('{"fov": 100}')
    assert [tuple(r) for r in tracks.presets(spark, str(tmp_path / "p")).orderBy("name").select("name", "kind").collect()] == [("one", "export"), ("two", "pipeline")]


def test_written_files_read_back(spark, tmp_path):
    angles = spark.createDataFrame([("a", i, float(i), 2.0 * i, -1.0 * i) for i in range(5)], "series_id string, frame bigint, roll double, pitch double, yaw double")
    sink.save(sink.telemetry_log(angles), str(tmp_path / "tele"))
    assert rows(logs.euler_log(spark, str(tmp_path / "tele/*")), "roll", "pitch", "yaw") == [(float(i), 2.0 * i, -1.0 * i) for i in range(5)]
    sink.save(sink.command_file(angles, fps=10.0, delta=True), str(tmp_path / "cmd"))
    assert [r[0] for r in rows(logs.commands(spark, str(tmp_path / "cmd/*")), "roll")] == [0.0, 1.0, 3.0, 6.0, 10.0]
    imu = angles.select("series_id", "frame", (F.col("frame") * 0.1).alias("t"), *[F.lit(1.0).alias(c) for c in ("gx", "gy", "gz", "ax", "ay", "az")])
    sink.save(sink.imu_log(imu), str(tmp_path / "imu"))
    assert logs.imu_log(spark, str(tmp_path / "imu/*")).count() == 5
    sink.save(sink.motion_file(angles.withColumn("key", F.lit(1.0)), ["key", "yaw", "pitch", "roll"], "frame key yaw pitch roll"), str(tmp_path / "mot"))
    assert rows(logs.motion(spark, str(tmp_path / "mot/*"), "kopf"), "roll") == [(float(i),) for i in range(5)]


def test_subtitles_page_and_report(spark):
    a = spark.createDataFrame([("a", 0, 0.0, "x"), ("a", 1, 1.5, "y")], "series_id string, frame bigint, t double, text string")
    assert [r.line for r in sink.subtitles(a, "text", fps=10.0).orderBy("n").collect()] == ["Dialogue: 0,0:00:00.00,0:00:01.50,Default,,0,0,0,,x", "Dialogue: 0,0:00:01.50,0:00:01.60,Default,,0,0,0,,y"]
    p = spark.createDataFrame([("a", 1, 1.0, 2.0, 3.0), ("a", 0, 0.0, 2.0, 3.0)], "series_id string, sec int, lat double, lon double, ele double")
    assert '[{"sec":0,"lat":0.0' in sink.route_page(p).first()["document"]
    assert [r.line for r in sink.report(a.where("frame = 0"), ["t"]).collect()] == [f"{'T':<20}: 0.0"]


def test_missing_parameter(spark):
    from helmtrack.functions.text import required

    with pytest.raises(Exception, match="missing parameter: fov"):
        spark.range(1).select(required(F.lit(" "), "fov")).collect()


def test_transform_files_of_either_form(spark, tmp_path):
    (tmp_path / "a.trf").write_text("# frame x y a\n1 0.5 -1 2\nbad line here x\n2 1e-1 0 0 9\n3 1 2\n")
    (tmp_path / "b.txt").write_text("0.000000-0.033333 [enter] v360 yaw 1.5;\n0.000000-0.033333 [enter] v360 roll -2;\n0.033333-0.066667 [enter] v360 pitch 3;\n")
    got = sorted((r.series_id.rsplit("/", 1)[-1][0], r.frame, r.yaw, r.pitch, r.roll) for r in logs.trajectory(spark, str(tmp_path)).collect())
    assert got == [("a", 1, 0.5, -1.0, 2.0), ("a", 2, 0.1, 0.0, 0.0), ("b", 1, 1.5, 0.0, -2.0), ("b", 2, 0.0, 3.0, 0.0)]


def test_logs_of_forces_alone(spark, tmp_path):
    rows = [(0.1 * i % 0.3, 5.0, 8.66) for i in range(12)]
    (tmp_path / "a.csv").write_text("time, ACC_X ,acc_y,acc_z\n" + "".join(f"{i},{x},{y},{z}\n" for i, (x, y, z) in enumerate(rows)) + "13,x,1,1\n")
    (tmp_path / "b.csv").write_text("time,ax,ay\n1,2,3\n")
    (tmp_path / "c.csv").write_text("ax,ay,az\n" + "0,0,1\n" * 10)
    log = logs.force_log(spark, str(tmp_path))
    assert log.count() == 22
    (tilt,) = logs.force_tilt(log).collect()
    x = sorted(r[0] for r in rows)
    x = (x[5] + x[6]) / 2
    assert tilt.pitch == pytest.approx(math.degrees(math.atan2(-5.0, math.hypot(x, 8.66)))) and tilt.roll == pytest.approx(math.degrees(math.atan2(x, 8.66)))


def test_binary_motion_files(spark):
    df = spark.createDataFrame([("a", 1, 4.0, 5.0, 6.0), ("a", 0, 1.0, 2.0, 3.0), ("b", 0, 0.5, 0.0, 0.0)], "series_id string, frame bigint, yaw double, pitch double, roll double")
    got = {r.series_id: bytes(r.content) for r in sink.motion_binary(df, fps=10.0).collect()}
    assert got["a"] == struct.pack("<q10d", 2, 0.0, 0.1, 1, 2, 3, 0.1, 0.2, 4, 5, 6) and len(got["b"]) == 48


def test_exports_are_padded_and_smoothed(spark):
    fixes = spark.createDataFrame([("a", i, 40.0 + 0.001 * (i % 2), 20.0 + 0.001 * i, 5.0, 100.0 + 10 * i) for i in range(5)], "series_id string, frame bigint, lat double, lon double, ele double, sec double")
    videos = spark.createDataFrame([("a", 30.0, None, 40.001, 20.0011, 2.0)], "series_id string, duration double, start double, lat double, lon double, shift double")
    (window,) = track.export_windows(videos, fixes).collect()
    assert (window.start, window.length, window.padded) == (112.0, 126, True)
    rough, smooth = ([(r.lat, r.lon) for r in track.exported(videos, fixes, smooth=s).orderBy("sec").collect()] for s in (False, True))
    assert len(rough) == len(smooth) == 127 and rough[0] == smooth[0] and rough[-1] == smooth[-1] == (40.0, 20.004)
    assert rough[7:10] != smooth[7:10]


def test_listing_of_media_and_companions(spark, tmp_path):
    import os

    for name, size in (("in/a.MP4", 3), ("in/b.jpg", 1), ("in/notes.txt", 2), ("in/a.gcsv", 5), ("in/a_telemetry.txt", 4), ("work/a.gcsv", 6), ("work/a.txt", 0)):
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_bytes(b"x" * size)
        os.utime(at, (1_000_000 + size, 1_000_000 + size))
    files = binary.listing(spark, str(tmp_path))
    media = catalog.media(files.unionByName(files)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.kind) for r in media] == [("a.MP4", "video"), ("b.jpg", "image")]
    video = files.where(F.col("path").endswith(".MP4"))
    work = media[0].path.rsplit("/in/", 1)[0] + "/work"
    tell = lambda hint: [r.path.rsplit("/", 2)[1:] for r in catalog.companions(video.select("path", F.lit(hint).alias("hint")), files, folders=[work]).orderBy("place").collect()]
    assert tell("auto") == [["in", "a.gcsv"], ["work", "a.gcsv"], ["in", "a_telemetry.txt"]] == tell(None)
    assert tell("gyroflow") == [["in", "a.gcsv"], ["work", "a.gcsv"]] and tell("custom_csv") == [["in", "a_telemetry.txt"]]


def test_appends_happen_once(spark, tmp_path):
    at = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "series_id string, x int")
    (tmp_path / "log/batch=two").mkdir(parents=True)
    (tmp_path / "log/batch=two/part-0.parquet").write_bytes(b"left by a run that failed")
    assert sink.append(rows, at, "one") and sink.append(rows, at, "two")
    assert not sink.append(rows, at, "one") and not sink.append(rows.limit(1), at, "two")
    assert sorted((r.series_id, r.x, r.batch) for r in spark.read.parquet(at).collect()) == [("a", 1, "one"), ("a", 1, "two"), ("b", 2, "one"), ("b", 2, "two")]


def test_checkpoint_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"lat": 46.5, "lon": "11.25", "time": "1:30", "ele": "208m"}, {"lon": 3}, "44.5, 26.25, 12", "# no", 5]')
    (tmp_path / "b.txt").write_text("# route\n44.5, 26.25\n\nhttps://maps.example/@46.5,11.25,40m/data=!3d46.625!4d-11.375\n")
    (tmp_path / "c.txt").write_text("")
    out = tracks.checkpoint_documents(spark, str(tmp_path)).orderBy("series_id", "frame").collect()
    assert [tuple(r)[1:] for r in out] == [(0, 46.5, 11.25, 90.0, 208.0), (1, 44.5, 26.25, None, 12.0), (0, 44.5, 26.25, None, None), (1, 46.625, -11.375, 11.25, 40.0)]  # what an address has after its first comma can be a time


def _headed_twice(spark):
    """Heads and bodies that are both dealt by series, as sinks make them, of many rows."""
    rows = spark.range(60000).select((F.col("id") % 3000).alias("series_id"), (F.col("id") / 3000).cast("bigint").alias("frame"), *[(F.col("id") % 7).cast("double").alias(c) for c in ("roll", "pitch", "yaw")])
    body = rows.groupBy("series_id", "frame").agg(*[F.first(c).alias(c) for c in ("roll", "pitch", "yaw")]).repartition("series_id")
    return rows, sink.telemetry_log(body)


def test_packed_series_stay_whole_and_few_files(spark, tmp_path):
    import glob

    rows, log = _headed_twice(spark)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:  # small partitions, as on large tables
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        at = sink.pack(log, str(tmp_path / "tele"))
        sink.save(log.where("series_id < 60"), str(tmp_path / "few"))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(glob.glob(f"{at}/part-*")) <= 16 and len(glob.glob(f"{tmp_path}/few/*/part-*")) == 60
    got = logs.euler_log(spark, at)
    assert got.count() == 60000 and got.select("series_id").distinct().count() == 3000
    want = rows.select(F.concat(F.lit("series_id="), F.col("series_id").cast("string"), F.lit("/")).alias("series_id"), "frame", "roll", "pitch", "yaw")
    assert got.select(want.columns).exceptAll(want).isEmpty()


def test_packed_documents(spark, tmp_path):
    points = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0), (1, 1, 1.5, 2.5, None), (2, 0, 4.0, 5.0, 6.0)], "series_id long, sec long, lat double, lon double, ele double")
    docs = sink.gpx(points, "2024-01-01 00:00:00").select("series_id", F.lit(0).alias("n"), F.translate("document", "\n", " ").alias("line"))
    got = tracks.gpx(spark, sink.pack(docs, str(tmp_path / "gpx"))).select("series_id", "frame", "lat", "lon", "ele", F.unix_seconds("time").alias("s")).collect()
    assert sorted(map(tuple, got)) == [("series_id=1/", 0, 1.0, 2.0, 3.0, 1704067200), ("series_id=1/", 1, 1.5, 2.5, 0.0, 1704067201), ("series_id=2/", 0, 4.0, 5.0, 6.0, 1704067200)]
    doc = spark.createDataFrame([(5, 0, '{"fps": 10, "ignoreYaw": false, "checkpoints": [{"time": 2, "yaw": 7}]}')], "series_id long, n long, line string")
    assert [tuple(r) for r in tracks.levelling(spark, sink.pack(doc, str(tmp_path / "lev"))).collect()] == [("series_id=5/", 20, 0.0, 0.0, 7.0)]
