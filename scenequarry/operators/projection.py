"""Cameras, rays and voxels: projection between images and scenes as equi-joins.

A ray is exploded into steps of half a voxel and meets occupied voxels by key;
the first step that hits decides. Voxel ids may be 0: emptiness is a missing
row, not a number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def unproject(pixels: DataFrame) -> DataFrame:
    """World position of each pixel with depth above 0.

    ``pixels``: u, v, depth, intrinsics fx, fy, mx, my and pose, a row-major 4x4 array camera to world.
    """
    d = F.col("depth")
    cam = [(F.col("u") - F.col("mx")) * d / F.col("fx"), (F.col("v") - F.col("my")) * d / F.col("fy"), d]
    world = [reduce(Column.__add__, [F.col("pose")[4 * i + j] * cam[j] for j in range(3)]) + F.col("pose")[4 * i + 3] for i in range(3)]
    return pixels.where(d > 0).withColumns(dict(zip(AXES, world)))


def backproject(pixels: DataFrame, most: float, low: float, high: float) -> DataFrame:
    """``unproject`` without depths of 0 or 65535 or above ``most``, and heights outside [low, high]."""
    kept = pixels.where((F.col("depth") != 65535) & (F.col("depth") <= most))
    return unproject(kept).where(F.col("z").between(low, high))


def transform(points: DataFrame, matrix: list[list[float]], axes: tuple[str, ...] = AXES, right: bool = False) -> DataFrame:
    """Apply a 4x4 matrix, or with ``right`` multiply rows by its rotation before adding its translation."""
    m = (lambda i, j: matrix[j][i]) if right else (lambda i, j: matrix[i][j])
    return points.withColumns({a: reduce(Column.__add__, [F.lit(float(m(i, j))) * F.col(b) for j, b in enumerate(axes)]) + float(matrix[i][3]) for i, a in enumerate(axes)})


def gather(points: DataFrame, views: DataFrame, depths: DataFrame, width: int, height: int, tolerance: float, by: str = "scene_id") -> DataFrame:
    """Points seen in a view: the pixel they fall on whose depth agrees within ``tolerance``.

    ``views``: scene, view_id, inverse (world to camera 4x4) and intrinsics; ``depths``: scene, view_id, u, v, depth and values.
    """
    both = points.join(views, by)
    cam = [reduce(Column.__add__, [F.col("inverse")[4 * i + j] * F.col(a) for j, a in enumerate(AXES)]) + F.col("inverse")[4 * i + 3] for i in range(3)]
    both = both.withColumns({f"c{a}": c for a, c in zip(AXES, cam)}).where("cz > 0")
    u = F.rint(F.col("cx") * F.col("fx") / F.col("cz") + F.col("mx")).cast("long")
    v = F.rint(F.col("cy") * F.col("fy") / F.col("cz") + F.col("my")).cast("long")
    placed = both.withColumns({"u": u, "v": v}).where(F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1))
    return placed.join(depths, [by, "view_id", "u", "v"]).where(F.abs(F.col("depth") - F.col("cz")) < tolerance)


def cast_rays(rays: DataFrame, voxels: DataFrame, size: float, near: float, far: float, keys: list[str], by: str = "scene_id", step: float = 0.5) -> DataFrame:
    """The first occupied voxel of each ray: ``keys``, voxel_id and distance.

    ``rays``: keys, origin ox.. and unit direction dx..; steps of ``step`` voxels from ``near`` to ``far``.
    """
    n = int((far - near) / (step * size))
    marched = rays.select(by, *keys, *(F.col(f"{p}{a}") for p in "od" for a in AXES), F.explode(F.sequence(F.lit(0), F.lit(n))).alias("s"))
    at = F.col("s") * (step * size) + near
    placed = marched.select(by, *keys, "s", at.alias("distance"), *(F.floor((F.col(f"o{a}") + F.col(f"d{a}") * at) / size).cast("long").alias(f"v{a}") for a in AXES))
    hit = placed.join(voxels.select(by, "vx", "vy", "vz", "voxel_id"), [by, "vx", "vy", "vz"])
    return hit.groupBy(by, *keys).agg(F.min_by("voxel_id", "s").alias("voxel_id"), F.min("distance").alias("distance"))


def project_features(hits: DataFrame, pixels: DataFrame, keys: list[str], values: list[str], by: str = "scene_id") -> DataFrame:
    """Features of pixels on the voxels they hit: sum / (count + 1e-4), and the count."""
    joined = hits.join(pixels, [by, *keys])
    n = F.count(F.lit(1))
    return joined.groupBy(by, "voxel_id").agg(*((F.sum(v) / (n + 1e-4)).alias(v) for v in values), n.alias("n"))


def project_labels(hits: DataFrame, pixels: DataFrame, keys: list[str], label: str, by: str = "scene_id") -> DataFrame:
    """The greatest label of the pixels that hit a voxel."""
    return hits.join(pixels, [by, *keys]).groupBy(by, "voxel_id").agg(F.max(label).alias(label))


def interpolate_corners(queries: DataFrame, voxels: DataFrame, values: list[str], by: str = "scene_id", query_id: str = "q") -> DataFrame:
    """Mean of the eight voxels around each query (in voxel units), weighted (root 3 - d) / root 3, over the weights + 1e-4.

    Queries with a corner that holds no voxel are left out.
    """
    root = 3**0.5
    corners = F.array(*(F.struct(F.lit(i).alias("ox"), F.lit(j).alias("oy"), F.lit(k).alias("oz")) for i in (0, 1) for j in (0, 1) for k in (0, 1)))
    spread = queries.select(by, query_id, *AXES, F.inline(corners))
    spread = spread.select(by, query_id, *AXES, *((F.floor(a) + F.col(f"o{a}")).cast("long").alias(f"v{a}") for a in AXES))
    gap = F.sqrt(reduce(Column.__add__, [(F.col(a) - F.col(f"v{a}")) * (F.col(a) - F.col(f"v{a}")) for a in AXES]))
    met = spread.join(voxels, [by, "vx", "vy", "vz"]).withColumn("_w", (root - gap) / root)
    sums = met.groupBy(by, query_id).agg(*((F.sum(F.col(v) * F.col("_w")) / (F.sum("_w") + 1e-4)).alias(v) for v in values), F.count(F.lit(1)).alias("_n"))
    return sums.where("_n = 8").drop("_n")


def plane_means(voxels: DataFrame, values: list[str], by: str = "scene_id", instance: str = "instance_id") -> DataFrame:
    """Means of ``values`` over the three axis planes by instance, in one pass of grouping sets."""
    sets = [(["vy", "vz"], "x"), (["vx", "vz"], "y"), (["vx", "vy"], "z")]
    struct = lambda cs, name: F.struct(F.lit(name).alias("plane"), F.col(cs[0]).alias("a"), F.col(cs[1]).alias("b"))
    long = voxels.select(by, instance, *values, F.inline(F.array(*(struct(c, n) for c, n in sets))))
    return long.groupBy(by, instance, "plane", "a", "b").agg(*(F.avg(v).alias(v) for v in values), F.count(F.lit(1)).alias("n"))


def projection_loss(planes: DataFrame, p: str, t: str, keys: list[str]) -> DataFrame:
    """Mean binary cross entropy between plane means of predictions and targets, clipped away from 0 and 1."""
    safe = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    return planes.groupBy(*keys).agg(F.avg(-(F.col(t) * F.log(safe) + (1 - F.col(t)) * F.log(1 - safe))).alias("loss"))
