"""Readers, writers, augmentations, colour, geometry and streams."""

import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenequarry.functions import augment, colour, geometry
from scenequarry.operators import projection, spatial
from scenequarry.plans.views import Views
from scenequarry.sources import readers, writers
from scenequarry.streaming import sweeps


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    rows = [(s, i, *map(float, rng.uniform(0, 4, 3)), int(c), int(c) // 2, 7, i % 3, i % 4 - 1) for s in (0, 1) for i, c in enumerate(rng.integers(0, 256, 80))]
    return spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, z double, r long, g long, b long, label int, instance_id int")


ASCII = """ply
format ascii 1.0
element vertex 3
property float x
property float y
property float z
property uchar red
element face 1
property list uchar int vertex_indices
end_header
0 0 0 1
1 0 0 2
0 1 0 3
3 0 1 2
"""


def test_ply(spark, tmp_path, points):
    (tmp_path / "a.ply").write_text(ASCII)
    rows = readers.read_ply(spark, str(tmp_path)).orderBy("v").collect()
    assert [(r.scene, r.v, r.x, r.y, r.red, r.nx) for r in rows] == [("a", 0, 0, 0, 1, None), ("a", 1, 1, 0, 2, None), ("a", 2, 0, 1, 3, None)]
    face = readers.read_ply_faces(spark, str(tmp_path)).first()
    assert (face.i1, face.i2, face.i3) == (0, 1, 2)
    out = tmp_path / "out"
    made = writers.write_ply(points, f"file://{out}", ["x", "y", "z", "r", "g", "b"]).collect()
    assert sorted(r.n for r in made) == [80, 80]
    back = readers.read_ply(spark, str(out)).where("scene = '1'").orderBy("v").collect()
    want = points.where("scene_id = 1").orderBy("point_id").collect()
    assert all(b.x == pytest.approx(w.x, abs=1e-6) and b.red == w.r for b, w in zip(back, want, strict=True))


def test_binary_ply_with_lists(tmp_path):
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty double x\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n"
    body = struct.pack("<dd", 1.5, 2.5) + struct.pack("<B3i", 3, 0, 1, 0) + struct.pack("<B4i", 4, 1, 0, 1, 0)
    t = readers.parse_ply(head + body)
    assert t["vertex"]["x"].tolist() == [1.5, 2.5] and t["face"].iloc[1, 0] == [1, 0, 1, 0]


def test_text_formats(spark, tmp_path):
    (tmp_path / "m.obj").write_text("# c\nv 0 0 1\nv 1 0 1\nv 0 1 1\nf 1/1 2/2 3/3\n")
    vertices, faces = readers.read_obj(spark, str(tmp_path))
    assert vertices.count() == 3 and tuple(faces.first())[2:] == (0, 1, 2)
    (tmp_path / "room.txt").write_text("1 2 3 10 20 30\n4 5  6 40 50 60\nbad line\n")
    rows = readers.read_columns(spark, str(tmp_path), ["x", "y", "z", "r", "g", "b"], "room.txt").collect()
    assert [(r.x, r.b) for r in rows] == [(1, 30), (4, 60)]
    (tmp_path / "out.csv").write_text("1,2,3,4,5,6,7,-100\n1,2,3,4,5,6,7,8\n")
    rows = readers.read_csv_points(spark, str(tmp_path / "out.csv")).collect()
    assert sorted((r.instance_id or 0, r.label) for r in rows) == [(0, 7), (8, 7)]
    (tmp_path / "pose.mat").write_text("1 0 0 5\n0 1 0 6\n0 0 1 7\n0 0 0 1\n")
    assert readers.read_matrices(spark, str(tmp_path), "pose.mat").first().matrix[3] == 5
    (tmp_path / "s1.info").write_text("fx_color = 500.5\naxisAlignment = " + "2 " * 16 + "\n")
    (tmp_path / "s2.info").write_text("fx_color = 1\n")
    info = {r.scene: r for r in readers.read_key_values(spark, str(tmp_path), "*.info").collect()}
    assert info["s1"].info["fx_color"] == [500.5] and info["s1"].alignment == [2.0] * 16 and info["s2"].alignment[:6] == [1, 0, 0, 0, 0, 1]
    (tmp_path / "ids.gt").write_text("1001\n0\n2003\n")
    assert [r.gt_id for r in readers.read_ids(spark, str(tmp_path), "ids.gt").orderBy("point_id").collect()] == [1001, 0, 2003]


def test_label_map(spark, tmp_path):
    (tmp_path / "labels.tsv").write_text("raw\tnum\nchair\t2\nchair\t2\nodd\tx\n")
    rows = {r.raw: r.id for r in readers.read_label_map(spark, str(tmp_path / "labels.tsv"), "raw", "num").collect()}
    assert rows == {"chair": 2, "odd": None}


def test_json_and_zip(spark, tmp_path):
    (tmp_path / "a.segs.json").write_text(json.dumps({"segIndices": [5, 5, 9]}))
    (tmp_path / "a.aggregation.json").write_text('{"segGroups": [{"id": 3, "label": "a\\odd", "segments": [5, 9]}]}')
    assert [tuple(r) for r in readers.read_segment_indices(spark, str(tmp_path)).collect()] == [("a.segs", 0, 5), ("a.segs", 1, 5), ("a.segs", 2, 9)]
    g = readers.read_segment_groups(spark, str(tmp_path)).first()
    assert (g.group_id, g.segments) == (3, [5, 9])
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("r/one.ply", ASCII)
        z.writestr("r/two.txt", "x")
    assert [r.member for r in readers.read_zip(spark, str(tmp_path), ".ply").collect()] == ["r/one.ply"]


def test_lidar(spark, tmp_path):
    (tmp_path / "0.bin").write_bytes(np.array([[1, 2, 3, 0.5]], "<f4").tobytes())
    (tmp_path / "0.label").write_bytes(np.array([(7 << 16) | 40], "<u4").tobytes())
    assert tuple(readers.read_sweeps(spark, str(tmp_path)).first()) == ("0", 0, 1.0, 2.0, 3.0, 0.5)
    assert tuple(readers.read_packed_labels(spark, str(tmp_path)).first()) == ("0", 0, 40, 7)
    tr = readers.parse_calibration("P0: " + "0 " * 12 + "\nTr: 1 0 0 1 0 1 0 2 0 0 1 3\n")["Tr"]
    (tmp_path / "poses.txt").write_text("1 0 0 4 0 1 0 5 0 0 1 6\n")
    assert readers.read_poses(spark, str(tmp_path), tr).first().pose == pytest.approx([1, 0, 0, 4, 0, 1, 0, 5, 0, 0, 1, 6, 0, 0, 0, 1])


def test_predictions_refuse_outside_paths(spark, tmp_path):
    (tmp_path / "s.txt").write_text("masks/a.txt 4 0.5\n")
    assert readers.read_predictions(spark, str(tmp_path / "s.txt")).first().conf == 0.5
    for bad in ("/etc/x 1 0.5", "masks/../../x 1 0.5"):
        (tmp_path / "bad.txt").write_text(bad + "\n")
        with pytest.raises(Exception, match="outside its folder"):
            readers.read_predictions(spark, str(tmp_path / "bad.txt")).collect()


def test_writers(spark, tmp_path, points):
    writers.write_scenes(points, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.where("scene_id = 1").count() == 80
    writers.write_report(points.groupBy("label").count(), str(tmp_path / "r"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "r")).count() == 3
    masks = points.select("scene_id", "point_id", F.col("label").alias("mask_id"))
    for i in (0, 1):
        writers.write_masks(masks, str(tmp_path / "m"), iteration=i)
    assert spark.read.parquet(str(tmp_path / "m")).where("iteration = 1").count() == 160
    writers.write_ids(points.withColumn("gt_id", F.col("point_id")), str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g")).count() == 160
    preds = masks.select("scene_id", "mask_id").distinct().withColumns({"label": F.lit(1), "conf": F.col("mask_id") / 2.0})
    writers.export_predictions(preds, masks, str(tmp_path / "e"), 0.4)
    assert spark.read.text(str(tmp_path / "e/index")).count() == 4
    writers.write_records(preds, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 6


def test_colour_round_trip(points):
    there = colour.rgb_to_hsv(points.select("point_id", "scene_id", "r", "g", "b"))
    back = colour.hsv_to_rgb(there.withColumnsRenamed({"r": "r0", "g": "g0", "b": "b0"})).collect()
    assert all((row.r, row.g, row.b) == pytest.approx((row.r0, row.g0, row.b0), abs=1e-6) for row in back)
    full = colour.contrast(points, 1.0).agg(F.min("r"), F.max("r")).first()
    assert tuple(full) == pytest.approx((0, 255))


def test_geometry(spark):
    turn = geometry.axis_angle((0, 0, 1), np.pi / 2)
    assert np.allclose(turn, geometry.rotation("z", np.pi / 2))
    m = geometry.rigid(turn, (1, 2, 3))
    assert np.allclose(np.array(m) @ np.array(geometry.inverse(m)), np.eye(4))
    p = spark.createDataFrame([(0.25, 0.5, 0.75)], "x double, y double, z double")
    assert tuple(projection.transform(p, m).first()) == pytest.approx((1 - 0.5, 2 + 0.25, 3.75))
    r = p.select(geometry.sine_encoding(F.col("x"), 4).alias("s"), geometry.fourier_encoding(("x", "y"), 3).alias("f"), geometry.rescale(F.col("x"), (0, 1), (2, 4)).alias("c"), geometry.ravel([F.lit(1), F.lit(2)], [5, 7]).alias("k")).first()
    assert r.s[0] == pytest.approx(1) and len(r.f) == 6 and np.allclose(np.square(r.f[:3]) + np.square(r.f[3:]), 1) and (r.c, r.k) == (2.5, 9)


def test_gather_finds_the_points_that_a_view_made(spark):
    eye = F.array(*(F.lit(float(i % 5 == 0)) for i in range(16)))
    px = spark.createDataFrame([(0, 0, u, v, 2.0) for u in range(4) for v in range(4)], "scene_id long, view_id int, u long, v long, depth double")
    lens = {"fx": F.lit(4.0), "fy": F.lit(4.0), "mx": F.lit(2.0), "my": F.lit(2.0)}
    world = projection.unproject(px.withColumns({"pose": eye, **lens})).select("scene_id", "u", "v", "x", "y", "z").withColumnsRenamed({"u": "u0", "v": "v0"})
    views = spark.createDataFrame([(0, 0)], "scene_id long, view_id int").withColumns({"inverse": eye, **lens})
    rows = projection.gather(world, views, px, 4, 4, 0.1).collect()
    assert len(rows) == 16 and all((r.u, r.v) == (r.u0, r.v0) for r in rows)


def test_augmentations_do_not_depend_on_partitions(points):
    steps = [
        lambda p: augment.dropout(p, 0.3, 1.0, 1), lambda p: augment.horizontal_flip(p, 0.9, 2), lambda p: augment.flip_in_centre(p),
        lambda p: augment.colour_shift(p, 0.1, 1.0, 3), lambda p: augment.colour_jitter(p, 0.05, 1.0, 4), lambda p: augment.rotate_about_z(p, 5),
        lambda p: augment.resample_around(p, 0.2, 0.1, 6), lambda p: augment.cutouts(p, 2, 1.0, 7), lambda p: augment.grid_noise(p, 1.0, 0.5, 8), lambda p: augment.oversample_instances(p, 0.5, 1.0, 9),
    ]
    for step in steps:
        rows = lambda p: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in step(p).collect())  # noqa: B023, E731
        assert rows(points) == rows(points.repartition(5))
    kept = augment.dropout(points, 0.3, 1.0, 1).count()
    assert 80 < kept < 150
    moved = augment.elastic(points, 1.0, 0.1, 1).withColumnRenamed("x", "x1").join(points.select("scene_id", "point_id", "x"), ["scene_id", "point_id"])
    gap = moved.select(F.max(F.abs(F.col("x1") - F.col("x"))).alias("m")).first().m
    assert 0 < gap < 1


def test_occupied_centres_and_windows(points):
    grid = spatial.occupancy(points, 8, 4.0)
    centres = spatial.occupied_centres(grid, 8, 4.0)
    assert spatial.occupancy(centres, 8, 4.0).subtract(grid).count() == 0
    every = spatial.sliding_windows(points, 10.0, 5.0, 1)
    assert sorted((r.scene_id, r.n) for r in every.collect()) == [(0, 80), (1, 80)]
    inner = spatial.inner_tiles(points, 3.0, 2.0, 2.0).where("in_core")
    assert inner.select("scene_id", "point_id").distinct().count() == 160
    assert spatial.clip_around_centre(points, (9, 9, 9)).count() == 160
    assert spatial.cluster_region(points, points.where("instance_id = 0"), 0.5).count() <= 160


def test_streams_match_batch(spark, sf, tmp_path):
    frames = Views(spark, sf).frames.select("scene_id", "frame_id", "ts", "value").where("scene_id < 40")
    frames.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "scene_id long, frame_id long, ts timestamp, value double"
    stream = sweeps.frame_stream(spark, str(tmp_path / "in"), schema)
    sweeps.run_once(sweeps.window_stats(stream, "1 day", late="3650 days"), str(tmp_path / "w"), str(tmp_path / "c1"))
    q = sweeps.fuse_running(stream).writeStream.outputMode("update").format("memory").queryName("fused").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = {r.scene_id: r.n for r in spark.table("fused").groupBy("scene_id").agg(F.max("n").alias("n")).collect()}
    assert seen == {r.scene_id: r["count"] for r in frames.groupBy("scene_id").count().collect()}
