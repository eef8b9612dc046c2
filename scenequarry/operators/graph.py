"""Meshes, segment graphs, similarity, components and oversegmentation."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import shuffled
from .spatial import written

AXES = ("x", "y", "z")


def face_edges(faces: DataFrame, by: str = "scene_id") -> DataFrame:
    """Three edges a face, in its order; shared edges stay repeated."""
    pair = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return faces.select(by, F.inline(F.array(pair("i1", "i2"), pair("i1", "i3"), pair("i3", "i2"))))


def face_normals(vertices: DataFrame, faces: DataFrame, by: str = "scene_id") -> DataFrame:
    """Unit normals of faces; null for one without area."""
    out = faces
    for k in ("1", "2", "3"):
        out = out.join(shuffled(vertices.select(by, F.col("v").alias(f"i{k}"), *(F.col(a).alias(f"{a}{k}") for a in AXES))), [by, f"i{k}"])
    u, w = ({a: F.col(f"{a}{k}") - F.col(f"{a}1") for a in AXES} for k in ("2", "3"))
    n = {"x": u["y"] * w["z"] - u["z"] * w["y"], "y": u["z"] * w["x"] - u["x"] * w["z"], "z": u["x"] * w["y"] - u["y"] * w["x"]}
    out = out.select(by, "f", "i1", "i2", "i3", *(c.alias(f"n{a}") for a, c in n.items()))
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return out.withColumn("_s", size).select(by, "f", "i1", "i2", "i3", *(F.when(F.col("_s") > 0, F.col(f"n{a}") / F.col("_s")).alias(f"n{a}") for a in AXES))


def vertex_normals(normals: DataFrame, by: str = "scene_id") -> DataFrame:
    """Mean of the unit normals of a vertex's faces, not normalised again."""
    each = normals.select(by, F.explode(F.array("i1", "i2", "i3")).alias("v"), "nx", "ny", "nz")
    return each.groupBy(by, "v").agg(*(F.avg(f"n{a}").alias(f"n{a}") for a in AXES))


def edge_weights(edges: DataFrame, vertices: DataFrame, by: str = "scene_id") -> DataFrame:
    """(1 - n1.n2) * |c1 - c2|_1, squared where the second normal leans along the edge and the colours are close.

    ``vertices``: v, x, y, z, nx, ny, nz and colours r, g, b in 0..1. An edge of no length has no direction and isn't squared.
    """
    cols = [*AXES, "nx", "ny", "nz", "r", "g", "b"]
    end = lambda name, p: shuffled(vertices.select(by, F.col("v").alias(name), *(F.col(c).alias(f"{p}{c}") for c in cols)))
    both = edges.join(end("src", "a_"), [by, "src"]).join(end("dst", "b_"), [by, "dst"])
    add = lambda cs: reduce(Column.__add__, cs)
    colour = add([F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in "rgb"])
    lean = add([F.col(f"b_n{a}") * (F.col(f"b_{a}") - F.col(f"a_{a}")) for a in AXES])
    w = (1 - add([F.col(f"a_n{a}") * F.col(f"b_n{a}") for a in AXES])) * colour
    return both.select(by, "src", "dst", F.when((lean > 0) & (colour < 0.05), w * w).otherwise(w).alias("w"))


def segment_adjacency(points: DataFrame, edges: DataFrame, by: str = "scene_id") -> DataFrame:
    """Directed, distinct pairs of different segments whose points share an edge."""
    own = lambda c, n: shuffled(points.select(by, F.col("v").alias(c), F.col("segment_id").alias(n)))
    pairs = edges.select(by, F.col("src").alias("v1"), F.col("dst").alias("v2"))
    met = pairs.join(own("v1", "src"), [by, "v1"]).join(own("v2", "dst"), [by, "v2"]).where("src <> dst").select(by, "src", "dst")
    return met.unionByName(met.select(by, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def voxel_adjacency(voxels: DataFrame, by: str = "scene_id") -> DataFrame:
    """Directed, distinct pairs of different segments in one voxel or in face-adjacent ones.

    ``voxels``: distinct (scene, vx, vy, vz, segment_id).
    """
    step = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(z).alias("dz")) for x, y, z in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))))
    moved = voxels.select(by, F.col("segment_id").alias("src"), "vx", "vy", "vz", F.explode(step).alias("s"))
    moved = moved.select(by, "src", (F.col("vx") + F.col("s.dx")).alias("vx"), (F.col("vy") + F.col("s.dy")).alias("vy"), (F.col("vz") + F.col("s.dz")).alias("vz"))
    met = moved.join(voxels.withColumnRenamed("segment_id", "dst"), [by, "vx", "vy", "vz"]).where("src <> dst").select(by, "src", "dst").distinct()
    return met.unionByName(met.select(by, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, by: str = "scene_id", node: str = "node", rounds: int = 60) -> DataFrame:
    """(scene, node, component): component is the least node that can be reached over edges in either direction.

    Minimum labels spread with pointer jumping, so rounds grow with the
    logarithm of the diameter; each round is a table in the shared folder.
    """
    both = edges.select(by, "src", "dst").unionByName(edges.select(by, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = written(both)
    label = written(nodes.select(by, node).distinct().withColumn("component", F.col(node)))
    for _ in range(rounds):
        heard = both.join(shuffled(label.select(by, F.col(node).alias("dst"), F.col("component").alias("_c"))), [by, "dst"]).groupBy(by, F.col("src").alias(node)).agg(F.min("_c").alias("_c"))
        least = label.join(shuffled(heard), [by, node], "left").select(by, node, F.col("component").alias("_was"), F.least("component", F.coalesce("_c", "component")).alias("component"))
        jump = least.select(by, F.col(node).alias("component"), F.col("component").alias("_next"))
        new = written(least.join(shuffled(jump), [by, "component"], "left").select(by, node, "_was", F.least("component", F.coalesce("_next", "component")).alias("component")))
        changed = new.where("component < _was").limit(1).count()
        label = new.select(by, node, "component")
        if not changed:
            return label
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def separate(masks: DataFrame, adjacency: DataFrame, by: str = "scene_id", keep: str = "all") -> DataFrame:
    """Split segment masks into connected parts: (scene, mask_id, segment_id, part), parts named by their least segment.

    ``keep``: all parts or the ``largest`` (ties: the least name).
    """
    inside = masks.select(by, "mask_id", F.col("segment_id").alias("src")).join(adjacency, [by, "src"])
    inside = inside.join(masks.select(by, "mask_id", F.col("segment_id").alias("dst")), [by, "mask_id", "dst"])
    nodes = masks.select(by, F.struct("mask_id", F.col("segment_id").alias("n")).alias("node"))
    edges = inside.select(by, F.struct("mask_id", F.col("src").alias("n")).alias("src"), F.struct("mask_id", F.col("dst").alias("n")).alias("dst"))
    parts = connected_components(nodes, edges, by).select(by, F.col("node.mask_id").alias("mask_id"), F.col("node.n").alias("segment_id"), F.col("component.n").alias("part"))
    if keep == "all":
        return parts
    size = parts.groupBy(by, "mask_id", "part").agg(F.count(F.lit(1)).alias("_n"))
    best = size.groupBy(by, "mask_id").agg(F.max_by("part", F.struct(F.col("_n"), -F.col("part"))).alias("part"))
    return parts.join(best, [by, "mask_id", "part"], "left_semi")


def eps_clusters(points: DataFrame, eps: float, by: str = "scene_id", node: str = "point_id") -> DataFrame:
    """Density clusters with one point as enough: components of the graph of pairs within ``eps``.

    Points go to cells of side eps / sqrt(3), whose points are all within eps of
    one another, so cells, not points, are the graph's nodes; two cells are
    linked if some pair of their points is close. Dense cells form no pairs
    within themselves.
    """
    side = eps / 3**0.5
    cells = {f"v{a}": F.floor(F.col(a) / side).cast("long") for a in AXES}
    placed = points.select(by, node, *AXES, *(c.alias(n) for n, c in cells.items()))
    head = written(placed.groupBy(by, "vx", "vy", "vz").agg(F.min(node).alias("cell")))
    steps = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    offsets = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(k).alias("dz")) for i, j, k in steps))
    near = head.select(by, F.col("cell").alias("src"), "vx", "vy", "vz", F.explode(offsets).alias("o"))
    near = near.select(by, "src", *((F.col(f"v{a}") + F.col(f"o.d{a}")).alias(f"v{a}") for a in AXES))
    linked = near.join(shuffled(head.withColumnRenamed("cell", "dst")), [by, "vx", "vy", "vz"]).select(by, "src", "dst")
    named = written(placed.select(by, "vx", "vy", "vz", *AXES).distinct().join(shuffled(head), [by, "vx", "vy", "vz"]).select(by, "cell", *AXES))  # points on one place are one
    a = named.select(by, F.col("cell").alias("src"), *(F.col(c).alias(f"a{c}") for c in AXES))
    b = named.select(by, F.col("cell").alias("dst"), *(F.col(c).alias(f"b{c}") for c in AXES))
    d2 = reduce(Column.__add__, [(F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in AXES])
    # Boxes of the cells' points settle many pairs of cells: too far apart, or close at any points. The others go point by point.
    box = named.groupBy(by, "cell").agg(*(f(c).alias(f"{n}{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))))
    side_of = lambda x, name: box.select(by, F.col("cell").alias(x), *(F.col(f"{n}{c}").alias(f"{name}_{n}{c}") for c in AXES for n in ("lo", "hi")))
    gap = [F.greatest(F.lit(0.0), F.col(f"b_lo{c}") - F.col(f"a_hi{c}"), F.col(f"a_lo{c}") - F.col(f"b_hi{c}")) for c in AXES]
    reach = [F.greatest(F.col(f"b_hi{c}") - F.col(f"a_lo{c}"), F.col(f"a_hi{c}") - F.col(f"b_lo{c}")) for c in AXES]
    total = lambda parts: reduce(Column.__add__, [g * g for g in parts])
    near = linked.join(shuffled(side_of("src", "a")), [by, "src"]).join(shuffled(side_of("dst", "b")), [by, "dst"]).where(total(gap) <= eps * eps)
    near = written(near.select(by, "src", "dst", (total(reach) <= eps * eps).alias("sure")))
    sure = near.where("sure").select(by, "src", "dst")
    open_ = near.where("not sure").select(by, "src", "dst")
    met = open_.join(shuffled(a), [by, "src"]).join(shuffled(b), [by, "dst"]).where(d2 <= eps * eps).select(by, "src", "dst").distinct()
    edges = written(sure.unionByName(met))
    roots = connected_components(head.select(by, F.col("cell").alias("node")), edges, by)
    return placed.join(shuffled(head.join(shuffled(roots.withColumnRenamed("node", "cell")), [by, "cell"])), [by, "vx", "vy", "vz"]).select(by, node, F.col("component").alias("cluster"))


def unit(rows: DataFrame, feature: str) -> DataFrame:
    """Feature arrays scaled to length 1; zero stays zero."""
    size = F.sqrt(F.aggregate(feature, F.lit(0.0), lambda s, v: s + v * v))
    return rows.withColumn("_s", size).withColumn(feature, F.when(F.col("_s") > 0, F.transform(feature, lambda v: v / F.col("_s"))).otherwise(F.col(feature))).drop("_s")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def similarity(rows: DataFrame, feature: str, key: str, by: str = "scene_id", kind: str = "cosine", normalise: bool = True) -> DataFrame:
    """(scene, i, j, sim) over all pairs of a scene's *segments*, a few thousand at most; ``kind``: cosine or l2.

    ``normalise`` spreads each row i over 0..1; l2 turns distance d into 1 - spread d.
    """
    rows = unit(rows, feature) if kind == "cosine" else rows
    a = rows.select(by, F.col(key).alias("i"), F.col(feature).alias("_a"))
    b = rows.select(by, F.col(key).alias("j"), F.col(feature).alias("_b"))
    gap = F.sqrt(F.aggregate(F.zip_with("_a", "_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    pairs = a.join(b, by).select(by, "i", "j", (dot("_a", "_b") if kind == "cosine" else gap).alias("sim"))
    if not normalise:
        return pairs if kind == "cosine" else pairs.withColumn("sim", 1 - F.col("sim"))
    edge = pairs.groupBy(by, "i").agg(F.min("sim").alias("_lo"), F.max("sim").alias("_hi"))
    spread = F.when(F.col("_hi") > F.col("_lo"), (F.col("sim") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    out = pairs.join(edge, [by, "i"]).withColumn("sim", spread).drop("_lo", "_hi")
    return out if kind == "cosine" else out.withColumn("sim", 1 - F.col("sim"))


def affinity(pairs: DataFrame, tau: float, by: str = "scene_id", eps: float = 1e-5) -> DataFrame:
    """Scale similarities by scene (less the least non-zero, over the largest) and binarise: 1 above ``tau``, else ``eps``."""
    least = pairs.groupBy(by).agg(F.min(F.when(F.col("sim") != 0, F.col("sim"))).alias("_lo"), F.max("sim").alias("_hi"))
    lo = F.coalesce("_lo", F.lit(0.0))
    scaled = F.greatest(F.col("sim") - lo, F.lit(0.0)) / (F.greatest(F.col("_hi") - lo, F.lit(0.0)) + eps)
    return pairs.join(least, by).select(by, "i", "j", F.when(scaled > tau, 1.0).otherwise(eps).alias("a"))


def degrees(pairs: DataFrame, by: str = "scene_id") -> DataFrame:
    return pairs.groupBy(by, F.col("j").alias("i")).agg(F.sum("a").alias("d"))


def felzenszwalb(edges: DataFrame, k: float = 0.005, least: int = 20, by: str = "scene_id") -> DataFrame:
    """Graph-based oversegmentation of each scene: (scene, v, segment_id) with dense ids.

    Edges in rising weight (ties by ends) merge two segments if the weight is
    within both thresholds (internal weight + k / size); then edges join
    segments below ``least`` vertices. The merge order is sequential, so a
    scene's edges go through one task, in order and a batch at a time; what it
    holds are the ends of a scene's edges and three numbers a vertex.
    """

    def segments(scene: int, ends: list[np.ndarray], weights: list[np.ndarray]) -> pa.RecordBatch:
        names = np.unique(np.concatenate([np.unique(e) for e in ends]))
        for i, e in enumerate(ends):  # places among the names, in half the bytes
            ends[i] = np.searchsorted(names, e).astype("<i4")
        parent, size, limit = array("i", range(len(names))), array("i", [1]) * len(names), array("d", [k]) * len(names)

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        def merge(a: int, b: int) -> int:
            if size[a] < size[b]:
                a, b = b, a
            parent[b], size[a] = a, size[a] + size[b]
            return a

        most = k  # no threshold is above it
        for both, rising in zip(ends, weights):
            for (a, b), w in zip(both.tolist(), rising.tolist()):
                if not w <= most:
                    break
                a, b = root(a), root(b)
                if a != b and w <= limit[a] and w <= limit[b]:
                    a = merge(a, b)
                    limit[a] = w + k / size[a]
                    most = max(most, limit[a])
        for both in ends:
            for a, b in both.tolist():
                a, b = root(a), root(b)
                if a != b and (size[a] < least or size[b] < least):
                    merge(a, b)
        roots = np.fromiter(map(root, range(len(names))), "<i4", len(names))
        segment = np.unique(roots, return_inverse=True)[1].astype("<i8")
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), scene, "<i8")), pa.array(names), pa.array(segment)], names=[by, "v", "segment_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scene, ends, weights = None, [], []
        for batch in batches:
            of, src, dst, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            starts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else []
            for at, to in zip(starts, starts[1:]):
                if ends and of[at] != scene:
                    yield segments(scene, ends, weights)
                    ends, weights = [], []
                scene = int(of[at])
                ends.append(np.stack([src[at:to], dst[at:to]], axis=1))
                weights.append(w[at:to].copy())
        if ends:
            yield segments(scene, ends, weights)

    weight = F.coalesce("w", F.lit(float("nan"))).alias("w")  # unknown weights come last
    rows = edges.select(F.col(by).cast("long").alias(by), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight)
    return rows.repartition(by).sortWithinPartitions(by, "w", "src", "dst").mapInArrow(run, f"{by} long, v long, segment_id long")


def multi_resolution(edges: DataFrame, sizes: list[int], k: float = 0.005, by: str = "scene_id") -> DataFrame:
    """Oversegmentations for several least sizes, with column ``least``."""
    made = [felzenszwalb(edges, k, n, by).withColumn("least", F.lit(n)) for n in sizes]
    return reduce(DataFrame.unionByName, made)


def second_eigenvector(a: np.ndarray) -> np.ndarray:
    """Second solution of (D - A) v = lambda D v, largest entry positive; D is the column sum."""
    d = a.sum(axis=0)
    s = 1 / np.sqrt(d)
    _, v = np.linalg.eigh(s[:, None] * (np.diag(d) - a) * s[None, :])
    v = s * v[:, 1]
    return v if v[np.abs(v).argmax()] >= 0 else -v


def ncut_masks(segments: DataFrame, adjacency: DataFrame, feature: str, tau: float = 0.6, rounds: int = 20, least: int = 3, most_extent: float = 0.8, by: str = "scene_id") -> DataFrame:
    """Iterative normalised cuts: (scene, mask_id, segment_id).

    Each round bipartitions the unpainted segments' affinity graph at the mean
    of its second eigenvector, takes the connected part that holds the
    strongest segment, and keeps it if it is large enough and at most half
    covered by earlier masks; what it covers is painted. A group holds a
    scene's segments, not its points.
    """
    near = adjacency.groupBy(by, F.col("src").alias("segment_id")).agg(F.collect_list("dst").alias("near"))
    rows = segments.join(near, [by, "segment_id"], "left").select(by, "segment_id", feature, F.coalesce("near", F.array().cast("array<long>")).alias("near"))

    def run(scene: pd.DataFrame) -> pd.DataFrame:
        scene = scene.sort_values("segment_id", ignore_index=True)
        ids = scene["segment_id"].tolist()
        at = {s: i for i, s in enumerate(ids)}
        links = [[at[n] for n in near if n in at] for near in scene["near"]]
        f = np.stack(scene[feature].to_numpy()).astype(float)
        f /= np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-12)
        a = np.where(f @ f.T > tau, 1.0, 1e-5)
        painted, out = np.zeros(len(ids), bool), []
        for _ in range(rounds):
            if painted.all() or len(ids) < 2:
                break
            b = a.copy()
            b[painted], b[:, painted] = 1e-5, 1e-5
            v = second_eigenvector(b)
            on = v > v.mean()
            if on.mean() > most_extent:
                on, v = ~on, -v
            start = int(np.where(on, v, -np.inf).argmax())
            part, todo = {start}, [start]
            while todo:
                for n in links[todo.pop()]:
                    if on[n] and n not in part:
                        part.add(n)
                        todo.append(n)
            part = np.array(sorted(part))
            fresh = part[~painted[part]]
            if len(fresh) >= least and len(fresh) >= 0.5 * len(part):
                name = out[-1][0] + 1 if out else 0
                out += [(name, ids[i]) for i in fresh]
            painted[part] = True
        return pd.DataFrame({by: scene[by].iloc[0], "mask_id": [m for m, _ in out], "segment_id": [s for _, s in out]}).astype("int64")

    return rows.groupBy(by).applyInPandas(run, f"{by} long, mask_id long, segment_id long")


def whiten(rows: DataFrame, feature: str, by: str = "scene_id", eps: float = 1e-5) -> DataFrame:
    """ZCA whitening of segment features within a scene."""
    fields = ", ".join(f"{k} {t}" for k, t in rows.dtypes)

    def run(scene: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(scene[feature].to_numpy()).astype(float)
        x = x - x.mean(axis=0)
        u, s, _ = np.linalg.svd(x.T @ x / max(1, len(x) - 1))
        return scene.assign(**{feature: list(x @ (u / np.sqrt(s + eps)) @ u.T)})

    return rows.groupBy(by).applyInPandas(run, fields)
