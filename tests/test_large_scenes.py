"""Joins of whole point tables go by shuffle, and a scene's edges go through the segmentation in small parts."""

import numpy as np
import pytest

from scenequarry import catalogue
from scenequarry.operators import graph


@pytest.mark.parametrize("name", ["dbscan_eps_cc", "mesh_reindex", "vertex_normals", "edge_weights", "felzenszwalb", "mesh_adjacency"])
def test_no_table_of_points_or_faces_is_broadcast(spark, sf, name):
    out = catalogue.queries()[name](spark, sf)
    assert out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan.split("Initial Plan")[0]


def test_points_on_one_place_make_no_pairs(spark, monkeypatch):
    """Copies of points are compared once: 2 * 40 copies on either side of a gap meet as one pair."""
    points = [(0, i, x, 0.0, 0.0) for i, x in enumerate([0.01, 0.17] * 40 + [0.35, 0.46] * 40 + [2.0])]
    df, sizes = spark.createDataFrame(points, "scene_id long, point_id long, x double, y double, z double"), []
    written = graph.written
    monkeypatch.setattr(graph, "written", lambda d: (lambda t: sizes.append((t.columns, t.count())) or t)(written(d)))
    got = {r.point_id: r.cluster for r in graph.eps_clusters(df, 0.3).collect()}
    assert set(got.values()) == {0, 160} and got[160] == 160 and len(got) == 161
    assert [n for c, n in sizes if c == ["scene_id", "cell", "x", "y", "z"]] == [5]


def plain(edges, k, least):
    """Segments of one scene as sets of vertices, edge by edge."""
    edges = sorted(edges, key=lambda e: (e[2] is None, e[2] or 0.0, e[0], e[1]))
    part = {v: {v} for a, b, _ in edges for v in (a, b)}
    limit = dict.fromkeys(part, k)

    def join(a, b, at=None):
        part[a] |= part[b]
        for v in part[b]:
            part[v] = part[a]
        for v in part[a]:
            limit[v] = limit[v] if at is None else at + k / len(part[a])

    for a, b, w in edges:
        if part[a] is not part[b] and w is not None and w <= limit[a] and w <= limit[b]:
            join(a, b, w)
    for a, b, _ in edges:
        if part[a] is not part[b] and min(len(part[a]), len(part[b])) < least:
            join(a, b)
    return {frozenset(p) for p in part.values()}


def test_felzenszwalb_in_small_batches(spark):
    """Scenes that end within a batch and go over many, unknown weights and equal ones."""
    rng = np.random.default_rng(3)
    rows = []
    for scene, n in ((0, 60), (1, 7), (2, 200), (7, 3)):
        for a, b in rng.integers(0, n, (3 * n, 2)).tolist():
            rows.append((scene, a * 10, b * 10, None if rng.random() < 0.1 else float(np.round(rng.random() ** 3, 3))))
    df = spark.createDataFrame(rows, "scene_id long, src long, dst long, w double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = graph.felzenszwalb(df, k=0.3, least=5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for scene in (0, 1, 2, 7):
        found = {}
        for r in got:
            if r.scene_id == scene:
                found.setdefault(r.segment_id, set()).add(r.v)
        assert sorted(found) == list(range(len(found)))
        assert set(map(frozenset, found.values())) == plain([r[1:] for r in rows if r[0] == scene], 0.3, 5)
