"""Sequential operators against plain versions and invariants."""

import itertools
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scenequarry.operators import aggregates, assign, graph, grouped, masks, metrics, spatial


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    rows = [(s, i, *map(float, rng.uniform(0, 4, 3))) for s in (0, 1) for i in range(120)]
    return spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, z double")


def by_scene(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.scene_id].append(r)
    return out


def test_knn_for_any_cell(cloud):
    xyz = {s: np.array([[r.x, r.y, r.z] for r in sorted(rs, key=lambda r: r.point_id)]) for s, rs in by_scene(cloud).items()}
    for cell in (0.2, 1.0, 9.0):
        got = defaultdict(list)
        for r in spatial.knn(cloud.withColumnRenamed("point_id", "q"), cloud.withColumnRenamed("point_id", "n"), 4, cell).collect():
            got[r.scene_id, r.q].append((r["rank"], r.n))
        assert len(got) == 240
        for (s, q), found in got.items():
            d = ((xyz[s] - xyz[s][q]) ** 2).sum(axis=1)
            assert [n for _, n in sorted(found)] == sorted(range(120), key=lambda i: (d[i], i))[:4]


def test_knn_reaches_far_neighbours_or_says_so(spark):
    q = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0)], "scene_id long, q long, x double, y double, z double")
    for far in (20.0, 500.0, 1e5):
        n = spark.createDataFrame([(0, 7, far, 0.0, 0.0)], "scene_id long, n long, x double, y double, z double")
        assert [(r.q, r.n, r.d2) for r in spatial.knn(q, n, 1, 1.0).collect()] == [(1, 7, far * far)]
    with pytest.raises(RuntimeError, match="open after 4 rounds"):
        spatial.knn(q, n, 1, 1.0, rounds=4)
    assert spatial.knn(q, n.limit(0), 1, 1.0).count() == 0


def test_patches_take_each_scene_by_its_own_count(spark):
    rng = np.random.default_rng(11)
    rows = [(s, i, *map(float, rng.normal(size=3))) for s, n in ((0, 40), (1, 9), (2, 2)) for i in range(n)]
    points = spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, z double")
    got = grouped.patches(points, 4, 2, 1.0).collect()
    for s, n in ((0, 10), (1, 2), (2, 1)):
        place = {i: np.array(p) for t, i, *p in rows if t == s}
        picked, gap = [0], {i: float(((p - place[0]) ** 2).sum()) for i, p in place.items()}
        while len(picked) < n:
            picked.append(max(gap, key=gap.get))
            gap = {i: min(g, float(((place[i] - place[picked[-1]]) ** 2).sum())) for i, g in gap.items()}
        want = {(q, k, i) for q in picked for k, i in enumerate(sorted(place, key=lambda i: (((place[i] - place[q]) ** 2).sum(), i))[:2], 1)}
        assert {(r.q, r["rank"], r.n) for r in got if r.scene_id == s} == want


def test_short_groups_are_padded(cloud):
    q = cloud.where("point_id < 2").withColumnRenamed("point_id", "q")
    near = spatial.knn(q, cloud.where("point_id < 3").withColumnRenamed("point_id", "n"), 5, 1.0)
    rows = by_scene(spatial.knn_padded(near, 5))
    for r in rows[0]:
        assert (r.d2 == 1e10) == (r["rank"] > 3)
    assert sum(len(v) for v in rows.values()) == 20


def test_farthest_points_have_the_prefix_property(cloud):
    short, long = (by_scene(grouped.farthest_points(cloud, n)) for n in (5, 12))
    for s in (0, 1):
        order = [r.point_id for r in sorted(long[s], key=lambda r: r["rank"])]
        assert order[0] == 0 and len(set(order)) == 12
        assert [r.point_id for r in sorted(short[s], key=lambda r: r["rank"])] == order[:5]


@pytest.mark.parametrize("shape", [(3, 3), (4, 6), (6, 4), (1, 5)])
def test_hungarian_is_the_least_total(spark, shape):
    rng = np.random.default_rng(sum(shape))
    cost = rng.integers(0, 20, shape).astype(float)
    rows = [(0, int(q), int(t), float(cost[q, t])) for q in range(shape[0]) for t in range(shape[1])]
    got = assign.hungarian(spark.createDataFrame(rows, "scene_id long, q long, t long, cost double")).collect()
    small, wide = sorted(shape)
    table = cost if shape[0] <= shape[1] else cost.T
    best = min(sum(table[i, p[i]] for i in range(small)) for p in itertools.permutations(range(wide), small))
    assert sum(r.cost for r in got) == best and len({r.q for r in got}) == len({r.t for r in got}) == small


def test_components_and_eps_clusters(spark, cloud):
    rng = np.random.default_rng(1)
    edges = [(0, int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2)) if a != b] + [(1, i, i + 1) for i in range(59)]
    nodes = spark.createDataFrame([(s, i) for s in (0, 1) for i in range(60)], "scene_id long, node long")
    got = {(r.scene_id, r.node): r.component for r in graph.connected_components(nodes, spark.createDataFrame(edges, "scene_id long, src long, dst long")).collect()}
    root = {k: k[1] for k in got}
    for _ in range(60):
        for s, a, b in edges:
            root[s, a] = root[s, b] = min(root[s, a], root[s, b])
    assert got == root
    eps, points = 0.5, {(r.scene_id, r.point_id): np.array([r.x, r.y, r.z]) for r in cloud.collect()}
    found = {(r.scene_id, r.point_id): (r.scene_id, r.cluster) for r in graph.eps_clusters(cloud, eps).collect()}
    close = {(a, b) for a in points for b in points if a[0] == b[0] and a < b and np.linalg.norm(points[a] - points[b]) <= eps}
    assert all(found[a] == found[b] for a, b in close)
    label = {p: p for p in points}
    for _ in range(120):
        for a, b in close:
            label[a] = label[b] = min(label[a], label[b])
    assert len(set(found.values())) == len(set(label.values()))


def test_separate_keeps_connected_parts(spark):
    m = spark.createDataFrame([(0, 1, s) for s in (1, 2, 3, 7, 8)] + [(0, 2, 9)], "scene_id long, mask_id int, segment_id long")
    adj = spark.createDataFrame([(0, a, b) for a, b in ((1, 2), (2, 3), (3, 4), (4, 7), (7, 8))], "scene_id long, src long, dst long")
    adj = adj.union(adj.select("scene_id", "dst", "src"))
    parts = {(r.mask_id, r.segment_id): r.part for r in graph.separate(m, adj).collect()}
    assert parts == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 7): 7, (1, 8): 7, (2, 9): 9}
    assert {r.segment_id for r in graph.separate(m, adj, keep="largest").where("mask_id = 1").collect()} == {1, 2, 3}


def test_felzenszwalb_cuts_at_a_heavy_edge(spark):
    edges = [(0, i, i + 1, 5.0 if i == 9 else 0.001) for i in range(19)]
    got = {r.v: r.segment_id for r in graph.felzenszwalb(spark.createDataFrame(edges, "scene_id long, src long, dst long, w double"), k=0.5, least=2).collect()}
    assert len({got[i] for i in range(10)}) == len({got[i] for i in range(10, 20)}) == 1 and got[0] != got[19]
    one = graph.multi_resolution(spark.createDataFrame(edges, "scene_id long, src long, dst long, w double"), [2, 15], k=0.5)
    assert one.where("least = 15").select("segment_id").distinct().count() == 1


def test_ncut_splits_two_groups(spark):
    f = [(0, i, [1.0, 0.05 * i] if i < 6 else [0.05, 1.0]) for i in range(12)]
    adj = [(0, a, b) for a in range(12) for b in range(12) if abs(a - b) == 1]
    rows = graph.ncut_masks(spark.createDataFrame(f, "scene_id long, segment_id long, f array<double>"), spark.createDataFrame(adj, "scene_id long, src long, dst long"), "f", tau=0.6, least=2).collect()
    first = {r.segment_id for r in rows if r.mask_id == 0}
    assert first in ({*range(6)}, {*range(6, 12)})


def test_hard_nms_survivors_are_apart_and_cover(spark):
    rng = np.random.default_rng(2)
    m = [(0, int(p), int(k)) for k in range(12) for p in rng.choice(60, 25, replace=False)]
    mask = spark.createDataFrame(m, "scene_id long, point_id long, mask_id int")
    preds = mask.groupBy("scene_id", "mask_id").agg(F.count(F.lit(1)).alias("vert_count")).withColumns({"label": F.lit(1), "conf": (F.col("mask_id") * 7 % 5).cast("double")})
    sets = defaultdict(set)
    for _, p, k in m:
        sets[k].add(p)
    iou = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    kept = {r.mask_id: r.kept for r in masks.hard_nms(preds, masks.mask_iou(preds, mask), 0.25).collect()}
    order = sorted(kept, key=lambda k: (-(k * 7 % 5), k))
    want = []
    for k in order:
        if all(iou(k, o) <= 0.25 for o in want):
            want.append(k)
    assert {k for k, v in kept.items() if v} == set(want)


def test_append_takes_only_what_is_uncovered(spark):
    base = spark.createDataFrame([(0, p, 1) for p in range(4)], "scene_id long, point_id long, mask_id int")
    new = spark.createDataFrame([(0, p, 5) for p in range(3, 9)] + [(0, p, 6) for p in range(0, 5)] + [(0, p, 7) for p in range(20, 25)], "scene_id long, point_id long, mask_id int")
    got = {(r.mask_id, r.point_id) for r in masks.append_masks(base, new, 1).where("added").collect()}
    assert got == {(5, p) for p in range(4, 9)}


def box(spark, rows):
    return spark.createDataFrame([(0, i, *map(float, b), *rest) for i, (b, *rest) in enumerate(rows)], "scene_id long, id long, cx double, cy double, cz double, lx double, ly double, lz double, conf double")


def test_golden_box_overlaps(spark):
    a = spark.createDataFrame([(0.0,) * 3 + (1.0,) * 3], "a_cx double, a_cy double, a_cz double, a_lx double, a_ly double, a_lz double")
    for centre, want in ((0.0, 1 / 8), (10.0, 0.0)):
        b = spark.createDataFrame([(centre,) * 3 + (2.0,) * 3], "b_cx double, b_cy double, b_cz double, b_lx double, b_ly double, b_lz double")
        assert a.crossJoin(b).select(masks.box_iou().alias("i")).first().i == pytest.approx(want)


GT = [([0, 0, 0, 1, 1, 1], 1.0), ([3, 0, 1, 1, 10, 1], 1.0)]


@pytest.mark.parametrize("dets, want", [
    ([([0, 0, 0, 1, 1, 1], 0.9), ([3, 0, 1, 1, 10, 1], 0.9)], (2, 0, 0, 1.0, 1.0)),
    ([([0, 0, 0, 1, 1, 1], 0.9), ([3, 0, 1, 1, 10, 1], 0.3)], (1, 0, 1, 1.0, 0.5)),
    ([([0, 0, 0, 1, 1, 1], 0.9), ([9, 9, 9, 1, 1, 1], 0.9)], (1, 1, 1, 0.5, 0.5)),
])
def test_golden_scene_counts(spark, dets, want):
    d, g = box(spark, dets).withColumnRenamed("id", "mask_id"), box(spark, GT).withColumnRenamed("id", "gt_id")
    r = metrics.box_counts(d, g, 0.5, 0.5).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == want


def test_oriented_boxes(spark):
    rows = [(0, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0), (1, 1.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0), (2, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0, np.pi / 4)]
    b = spark.createDataFrame(rows, "i long, cx double, cy double, cz double, l double, w double, h double, t double")
    corners = b.select("i", F.flatten(F.transform(masks.oriented_corners(("cx", "cy", "cz"), ("l", "w", "h"), "t"), lambda c: F.array(c.x, c.y, c.z))).alias("c"))
    pairs = corners.select(F.col("i").alias("p"), F.col("c").alias("a")).crossJoin(corners.select(F.col("i").alias("q"), F.col("c").alias("b")))
    got = {(r.p, r.q): (r.iou3d, r.iou2d) for r in masks.oriented_iou(pairs).collect()}
    assert got[0, 0] == pytest.approx((1, 1)) and got[0, 1] == pytest.approx((1 / 3, 1 / 3))
    shared = 8 * (np.sqrt(2) - 1)
    assert got[0, 2] == pytest.approx((shared / (8 - shared),) * 2)


def test_graph_cut_separates_at_the_weak_edge(spark):
    nodes = spark.createDataFrame([(0, i, 9.0 if i == 0 else 0.0, 9.0 if i == 5 else 0.0) for i in range(6)], "scene_id long, node long, to_source double, to_sink double")
    edges = spark.createDataFrame([(0, i, i + 1, 0.5 if i == 2 else 3.0) for i in range(5)], "scene_id long, src long, dst long, capacity double")
    side = {r.node: r.source_side for r in grouped.graph_cut(nodes, edges).collect()}
    assert [side[i] for i in range(6)] == [True] * 3 + [False] * 3


def test_density_tree_finds_two_blobs_and_noise(spark):
    rng = np.random.default_rng(3)
    xyz = np.concatenate([rng.normal(0, 0.1, (40, 3)), rng.normal(5, 0.1, (40, 3)), [[20, 20, 20]]])
    p = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(xyz)], "scene_id long, point_id long, x double, y double, z double")
    got = {r.point_id: r.cluster for r in grouped.density_tree_clusters(p, 10).collect()}
    assert len({got[i] for i in range(40)} - {-1}) == 1 and len({got[i] for i in range(40, 80)} - {-1}) == 1
    assert got[80] == -1 and max(got.values()) == 1


def test_floor_plane_and_normals(spark):
    rng = np.random.default_rng(4)
    xy = rng.uniform(0, 3, (150, 2))
    p = spark.createDataFrame([(0, i, float(x), float(y), 0.1) for i, (x, y) in enumerate(xy)] + [(0, 999, 1.0, 1.0, 0.2)], "scene_id long, point_id long, x double, y double, z double")
    r = grouped.floor_plane(p, tries=50).first()
    assert (r.c, r.d, r.inliers) == (pytest.approx(1), pytest.approx(0.1), 150)
    near = spatial.knn(p.withColumnRenamed("point_id", "q"), p.where("point_id < 999").withColumnRenamed("point_id", "n"), 6, 0.5)
    n = grouped.estimate_normals(p, near, 9.0).where("point_id < 999").collect()
    assert all(abs(r.nz) == pytest.approx(1) for r in n)


def test_group_folds_keep_groups_and_balance(spark):
    rows = [(g, g % 2) for g in range(8) for _ in range(10 + g)]
    got = assign.group_folds(spark.createDataFrame(rows, "scene_id long, label int"), "scene_id", "label", 4).collect()
    assert sorted(r.scene_id for r in got) == list(range(8)) and {r.fold for r in got} == set(range(4))


def test_cuboid_is_a_subset(cloud):
    got = by_scene(grouped.random_cuboid(cloud, 0.6, 5, seed=1))
    assert all(5 <= len(v) <= 120 for v in got.values()) and len(got) == 2


def test_whitening_and_blur(spark):
    rng = np.random.default_rng(5)
    f = [(0, i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3)))]
    got = np.array([r.f for r in graph.whiten(spark.createDataFrame(f, "scene_id long, segment_id long, f array<double>"), "f").collect()])
    assert np.cov(got.T) == pytest.approx(np.eye(3), abs=0.02)
    sharp = np.indices((64, 64)).sum(axis=0) % 2 * 255.0
    flat = np.full((64, 64), 100.0)
    images = spark.createDataFrame([(i, 64, 64, x.ravel().tolist()) for i, x in enumerate((sharp, flat))], "image_id long, rows int, cols int, grey array<double>")
    s = {r.image_id: r.score for r in grouped.blur_scores(images, size=8).collect()}
    assert s[0] > s[1]


def test_moving_average_and_sample(spark):
    rows = [(0, t, float(v)) for t, v in enumerate([4, 8, 2])]
    got = aggregates.moving_average(spark.createDataFrame(rows, "k long, t long, v double"), ["k"], ["t"], "v", 0.5).first()
    assert got.v == 4.0
    many = spark.range(1000).toDF("id")
    assert sorted(aggregates.sample_exact(many, 20, 3, "id").toPandas().id) == sorted(aggregates.sample_exact(many.repartition(7), 20, 3, "id").toPandas().id)


def test_sequential_events_agree_with_the_relational_rule(spark, sf):
    from scenequarry.catalogue import association
    from scenequarry.plans.views import Views

    a = association(Views(spark, sf))
    one = metrics.average_precision(metrics.precision_recall_events(a, (0.6,)), a.gt, (0.6,)).toPandas()
    two = metrics.average_precision(metrics.sequential_events(a, 0.6), a.gt, (0.6,)).toPandas()
    pd.testing.assert_frame_equal(one.sort_values("label", ignore_index=True), two.sort_values("label", ignore_index=True))
