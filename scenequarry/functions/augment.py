"""Seeded augmentations. Randomness is hashed from (seed, scene or point), so a
result depends neither on partitions nor on row order; what the original draws
once a scene is drawn once a scene here."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from a hash of the seed and keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def normal(seed: int, *keys: Column | str) -> Column:
    a, b = uniform(2 * seed + 1, *keys), uniform(2 * seed + 2, *keys)
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * math.pi * b)


def dropout(points: DataFrame, share: float, chance: float, seed: int, by: str = "scene_id", key: str = "point_id") -> DataFrame:
    """In a ``chance`` of scenes, drop a ``share`` of the points."""
    return points.where((uniform(seed, by) >= chance) | (uniform(seed + 1, by, key) >= share))


def horizontal_flip(points: DataFrame, chance: float, seed: int, by: str = "scene_id", axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Mirror each axis at the scene's largest coordinate in a ``chance`` of scenes."""
    most = points.groupBy(by).agg(*(F.max(a).alias(f"_{a}") for a in axes))
    flip = {a: F.when(uniform(seed + i, by) < chance, F.col(f"_{a}") - F.col(a)).otherwise(F.col(a)) for i, a in enumerate(axes)}
    return points.join(most, by).withColumns(flip).drop(*(f"_{a}" for a in axes))


def flip_in_centre(points: DataFrame, axes: tuple[str, ...] = ("x", "y"), by: str = "scene_id") -> DataFrame:
    """Mirror each axis within the scene's own range."""
    edge = points.groupBy(by).agg(*((F.min(a) + F.max(a)).alias(f"_{a}") for a in axes))
    return points.join(edge, by).withColumns({a: F.col(f"_{a}") - F.col(a) for a in axes}).drop(*(f"_{a}" for a in axes))


def colour_shift(points: DataFrame, ratio: float, chance: float, seed: int, by: str = "scene_id", rgb: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Shift every channel by one draw a scene of up to ``ratio`` of 255, clipped."""
    move = lambda i: (uniform(seed + 1 + i, by) - 0.5) * 2 * 255 * ratio
    return points.withColumns({c: F.when(uniform(seed, by) < chance, F.least(F.greatest(F.col(c) + move(i), F.lit(0.0)), F.lit(255.0))).otherwise(F.col(c)) for i, c in enumerate(rgb)})


def colour_jitter(points: DataFrame, std: float, chance: float, seed: int, by: str = "scene_id", key: str = "point_id", rgb: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Gaussian noise of ``std`` times 255 on every point's channels, clipped."""
    return points.withColumns({c: F.when(uniform(seed, by) < chance, F.least(F.greatest(F.col(c) + normal(seed + 1 + i, by, key) * (std * 255), F.lit(0.0)), F.lit(255.0))).otherwise(F.col(c)) for i, c in enumerate(rgb)})


def elastic(points: DataFrame, cell: float, size: float, seed: int, by: str = "scene_id", smooth: int = 2) -> DataFrame:
    """Move points by a smooth noise field: hashed Gaussian noise on a grid, averaged over
    ``smooth`` cells a side and interpolated between the eight grid corners around a point."""
    base = [F.floor(F.col(a) / cell) for a in AXES]
    part = [F.col(a) / cell - b for a, b in zip(AXES, base)]

    def noise(axis: int, corner: tuple[int, int, int]) -> Column:
        around = [(i, j, k) for i in range(smooth) for j in range(smooth) for k in range(smooth)]
        total = sum((normal(seed + axis, by, *(b + c + o for b, c, o in zip(base, corner, off))) for off in around), F.lit(0.0))
        return total / len(around)

    corners = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]

    def field(axis: int) -> Column:
        out = F.lit(0.0)
        for corner in corners:
            weight = F.lit(1.0)
            for p, c in zip(part, corner):
                weight = weight * (p if c else 1 - p)
            out = out + weight * noise(axis, corner)
        return out

    return points.withColumns({a: F.col(a) + field(i) * size for i, a in enumerate(AXES)})


def grid_noise(points: DataFrame, step: float, share: float, seed: int, by: str = "scene_id") -> DataFrame:
    """Points at a hashed ``share`` of the cells of a grid over each scene, with label 255 and no instance.

    Cells are generated by one range a scene and thinned before their coordinates are made.
    """
    box = points.groupBy(by).agg(*(F.min(a).alias(f"lo{a}") for a in AXES), *(F.ceil((F.max(a) - F.min(a)) / step + 1e-9).cast("long").alias(f"n{a}") for a in AXES))
    cells = box.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("nx") * F.col("ny") * F.col("nz") - 1, F.lit(0).cast("long"))))).where(uniform(seed, by, "i") < share)
    at = {"x": F.col("i") % F.col("nx"), "y": F.floor(F.col("i") / F.col("nx")) % F.col("ny"), "z": F.floor(F.col("i") / (F.col("nx") * F.col("ny")))}
    return cells.select(by, *((F.col(f"lo{a}") + at[a] * step).alias(a) for a in AXES), F.lit(255).alias("label"), F.lit(-1).alias("instance_id"))


def resample_around(points: DataFrame, share: float, spread: float, seed: int, by: str = "scene_id", key: str = "point_id") -> DataFrame:
    """Noise near a hashed ``share`` of the points: moved copies with label 255 and no instance."""
    some = points.where(uniform(seed, by, key) < share)
    return some.withColumns({a: F.col(a) + normal(seed + 1 + i, by, key) * spread for i, a in enumerate(AXES)} | {"label": F.lit(255), "instance_id": F.lit(-1)})


def oversample_instances(points: DataFrame, chance: float, reach: float, seed: int, by: str = "scene_id") -> DataFrame:
    """A hashed ``chance`` of instances again, shifted by one draw an instance, under new instance ids."""
    most = points.groupBy(by).agg((F.max("instance_id") + 1).alias("_m"))
    again = points.where("instance_id >= 0").where(uniform(seed, by, "instance_id") < chance).join(most, by)
    moved = {a: F.col(a) + (uniform(seed + 1 + i, by, "instance_id") - 0.5) * 2 * reach for i, a in enumerate("xy")}
    return points.unionByName(again.withColumns(moved).withColumn("instance_id", (F.col("instance_id") + F.col("_m")).cast(points.schema["instance_id"].dataType)).drop("_m"))


def cutouts(points: DataFrame, n: int, side: float, seed: int, by: str = "scene_id") -> DataFrame:
    """Remove the points of ``n`` boxes at hashed places in the scene's range."""
    edge = points.groupBy(by).agg(*(f(a).alias(f"_{p}{a}") for a in AXES for p, f in (("lo", F.min), ("hi", F.max))))
    gone = F.lit(False)
    for i in range(n):
        inside = F.lit(True)
        for j, a in enumerate(AXES):
            centre = F.col(f"_lo{a}") + uniform(seed + 3 * i + j, by) * (F.col(f"_hi{a}") - F.col(f"_lo{a}"))
            inside = inside & (F.abs(F.col(a) - centre) <= side / 2)
        gone = gone | inside
    return points.join(edge, by).where(~gone).select(points.columns)


def rotate_about_z(points: DataFrame, seed: int, by: str = "scene_id") -> DataFrame:
    """Turn each scene by one hashed angle."""
    angle = uniform(seed, by) * (2 * np.pi)
    c, s = F.cos(angle), F.sin(angle)
    return points.withColumns({"x": F.col("x") * c - F.col("y") * s, "y": F.col("x") * s + F.col("y") * c})
