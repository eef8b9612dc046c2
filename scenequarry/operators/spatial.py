"""Voxels, tiles, crops and nearest neighbours.

All operators are scene-local and keep the scene in every key, together with a
cell where a scene may be large, so that a scene of many points spreads over
tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES, CELL = ("x", "y", "z"), ("vx", "vy", "vz")


def cell_of(c: Column | str, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size).cast("long")


def voxelize(points: DataFrame, size: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Add the voxel coordinates floor(coordinate / size)."""
    return points.withColumns({f"v{a}": cell_of(a, size) for a in axes})


def first_in_voxel(points: DataFrame, size: float, by: str = "scene_id", order: str = "point_id") -> DataFrame:
    """One row a voxel: its first point (least ``order``) and its number of points."""
    return voxelize(points, size).groupBy(by, *CELL).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("n"))


def voxel_mean(points: DataFrame, size: float, values: list[str], by: str = "scene_id") -> DataFrame:
    """Unweighted means of ``values`` by voxel."""
    return voxelize(points, size).groupBy(by, *CELL).agg(*(F.avg(v).alias(v) for v in values), F.count(F.lit(1)).alias("n"))


def pool(voxels: DataFrame, values: list[str], how: str, stride: int = 2, by: str = "scene_id") -> DataFrame:
    """Pool voxel features over ``stride``-wide cells: ``how`` is avg, max or sum."""
    parent = [F.floor(F.col(c) / stride).cast("long").alias(c) for c in CELL]
    f = {"avg": F.avg, "max": F.max, "sum": F.sum}[how]
    return voxels.groupBy(by, *parent).agg(*(f(v).alias(v) for v in values))


def unpool(children: DataFrame, parents: DataFrame, stride: int = 2, by: str = "scene_id") -> DataFrame:
    """Give each child voxel its parent's columns."""
    up = [F.floor(F.col(c) / stride).cast("long").alias(f"p{c}") for c in CELL]
    renamed = reduce(lambda d, c: d.withColumnRenamed(c, f"p{c}"), CELL, parents)
    return children.select("*", *up).join(renamed, [by, *(f"p{c}" for c in CELL)]).drop(*(f"p{c}" for c in CELL))


def to_points(points: DataFrame, voxels: DataFrame, size: float, by: str = "scene_id", how: str = "inner") -> DataFrame:
    """The inverse map as a join: each point with its voxel's columns."""
    return voxelize(points, size).join(voxels, [by, *CELL], how)


def occupancy(points: DataFrame, cells: int, radius: float, by: str = "scene_id") -> DataFrame:
    """Occupied cells of a grid of ``cells`` a side over [-radius, radius]; points outside are clipped to the border."""
    step = 2 * radius / cells
    place = lambda a: F.least(F.greatest(F.floor((F.col(a) + radius) / step), F.lit(0)), F.lit(cells - 1)).cast("long").alias(f"v{a}")
    return points.select(by, *map(place, AXES)).distinct()


def occupied_centres(grid: DataFrame, cells: int, radius: float) -> DataFrame:
    """Cell centres of an occupancy grid: the inverse of ``occupancy``."""
    step = 2 * radius / cells
    return grid.select("*", *(((F.col(f"v{a}") + 0.5) * step - radius).alias(a) for a in AXES))


def sampled_volume(points: DataFrame, cells: int, radius: float, n: int, seed: int = 0, by: str = "scene_id", key: str = "point_id") -> DataFrame:
    """``n`` points of every occupied cell, relative to its centre in cell units: (cell, slot, x, y, z).

    A fuller cell gives a seeded sample; a sparser one repeats its last point.
    """
    step = 2 * radius / cells
    placed = points.select(by, key, *AXES, *(F.floor((F.col(a) + radius) / step).cast("long").alias(f"v{a}") for a in AXES))
    w = Window.partitionBy(by, *CELL).orderBy(F.xxhash64(F.lit(seed), key), key)
    kept = placed.withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < n)
    some = kept.groupBy(by, *CELL).agg((F.max("slot") + 1).alias("_n"))
    slots = some.select(by, *CELL, "_n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_s")).withColumn("slot", F.least(F.col("_s"), F.col("_n") - 1))
    local = [((F.col(a) - ((F.col(f"v{a}") + 0.5) * step - radius)) / step).alias(a) for a in AXES]
    return slots.join(kept, [by, *CELL, "slot"]).select(by, *CELL, F.col("_s").alias("slot"), *local)


def extents(points: DataFrame, by: str = "scene_id", axes: tuple[str, ...] = AXES) -> DataFrame:
    return points.groupBy(by).agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))))


def shift_to_origin(points: DataFrame, by: str = "scene_id", axes: tuple[str, ...] = AXES) -> DataFrame:
    """Subtract the scene's least coordinates: one aggregate and a broadcastable join, no sort of the scene."""
    least = points.groupBy(by).agg(*(F.min(a).alias(f"_{a}") for a in axes))
    return points.join(least, by).withColumns({a: F.col(a) - F.col(f"_{a}") for a in axes}).drop(*(f"_{a}" for a in axes))


def mean_centre(points: DataFrame, by: str | list[str] = "scene_id", axes: tuple[str, ...] = AXES) -> DataFrame:
    mean = points.groupBy(by).agg(*(F.avg(a).alias(f"_{a}") for a in axes))
    return points.join(mean, by).withColumns({a: F.col(a) - F.col(f"_{a}") for a in axes}).drop(*(f"_{a}" for a in axes))


def tiles(points: DataFrame, size: float, stride: float, by: str = "scene_id") -> DataFrame:
    """Square tiles from the origin with closed borders: a point on a shared border is in both.

    The tiles of a point follow from its coordinates, so no range join is needed.
    """
    most = points.groupBy(by).agg(*((F.ceil((F.max(a) - size) / stride) + 1).alias(f"_n{a}") for a in "xy"))

    def reach(a: str) -> Column:
        first = F.greatest(F.ceil((F.col(a) - size) / stride), F.lit(0)).cast("long")
        last = F.least(F.floor(F.col(a) / stride), F.col(f"_n{a}") - 1).cast("long")
        return F.when(first <= last, F.sequence(first, last))

    return points.join(most, by).withColumn("tile_x", F.explode(reach("x"))).withColumn("tile_y", F.explode(reach("y"))).drop("_nx", "_ny")


def inner_tiles(points: DataFrame, size: float, core: float, stride: float, by: str = "scene_id") -> DataFrame:
    """Tiles of side ``size`` around cores of side ``core``; ``in_core`` marks the points to keep."""
    grow = (size - core) / 2
    most = points.groupBy(by).agg(*((F.ceil((F.max(a) - core) / stride) + 1).alias(f"_n{a}") for a in "xy"))

    def reach(a: str) -> Column:
        first = F.greatest(F.ceil((F.col(a) - core - grow) / stride), F.lit(0)).cast("long")
        last = F.least(F.floor((F.col(a) + grow) / stride), F.col(f"_n{a}") - 1).cast("long")
        return F.when(first <= last, F.sequence(first, last))

    placed = points.join(most, by).withColumn("tile_x", F.explode(reach("x"))).withColumn("tile_y", F.explode(reach("y"))).drop("_nx", "_ny")
    inside = reduce(Column.__and__, [F.col(a).between(F.col(f"tile_{a}") * stride, F.col(f"tile_{a}") * stride + core) for a in "xy"])
    return placed.withColumn("in_core", inside)


def box_crop(points: DataFrame, low: tuple[float, ...], high: tuple[float, ...], axes: tuple[str, ...] = AXES) -> DataFrame:
    """Points in the half-open box [low, high)."""
    return points.where(reduce(Column.__and__, [(F.col(a) >= lo) & (F.col(a) < hi) for a, lo, hi in zip(axes, low, high)]))


def clip_around_centre(points: DataFrame, half: tuple[float, ...], by: str = "scene_id", axes: tuple[str, ...] = AXES) -> DataFrame:
    """Points within ``half`` of the scene's mid-point on every axis, half-open."""
    mid = points.groupBy(by).agg(*(((F.min(a) + F.max(a)) / 2).alias(f"_{a}") for a in axes))
    inside = reduce(Column.__and__, [(F.col(a) >= F.col(f"_{a}") - h) & (F.col(a) < F.col(f"_{a}") + h) for a, h in zip(axes, half)])
    return points.join(mid, by).where(inside).drop(*(f"_{a}" for a in axes))


def cluster_region(points: DataFrame, cluster: DataFrame, growth: float, most: float = 300.0, by: str = "scene_id") -> DataFrame:
    """Points strictly within the cluster's reach around its centre plus ``growth``; none for a scene whose reach exceeds ``most``."""
    mean = cluster.groupBy(by).agg(*(F.avg(a).alias(f"c{a}") for a in AXES))
    off = cluster.join(mean, by).groupBy(by).agg(*(F.max(F.abs(F.col(a) - F.col(f"c{a}"))).alias(f"o{a}") for a in AXES))
    inside = [(F.abs(F.col(a) - F.col(f"c{a}")) < F.col(f"o{a}") + growth) & (F.col(f"o{a}") <= most) for a in AXES]
    return points.join(mean.join(off, by), by).where(reduce(Column.__and__, inside)).select(points.columns)


def quadrant_crops(points: DataFrame, by: str = "scene_id") -> DataFrame:
    """Mean-centre, add a point in every quadrant, cut into open quadrants and centre each."""
    centred = mean_centre(points.select(by, "point_id", *AXES), by)
    corner = F.array(*(F.struct(F.lit(sx * 0.1).alias("x"), F.lit(sy * 0.1).alias("y"), F.lit(0.1).alias("z")) for sx in (1, -1) for sy in (1, -1)))
    extra = points.select(by).distinct().select(by, F.lit(None).cast("long").alias("point_id"), F.explode(corner).alias("c")).select(by, "point_id", "c.*")
    side = lambda a: F.when(F.col(a) > 0, 1).when(F.col(a) < 0, 0)
    cut = centred.unionByName(extra).withColumn("quadrant", side("x") * 2 + side("y")).where("quadrant is not null")
    return mean_centre(cut, [by, "quadrant"])


def sliding_windows(points: DataFrame, size: float, stride: float, least: int, by: str = "scene_id") -> DataFrame:
    """Windows over x and y with at least ``least`` points; the last one of an axis is pulled back to end at the scene's border."""
    box = points.groupBy(by).agg(*(f(a).alias(f"{n}{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))))

    def starts(a: str) -> Column:
        span = F.col(f"hi{a}") - F.col(f"lo{a}")
        last = F.greatest(F.ceil((span - size) / stride), F.lit(0)).cast("long")
        return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.greatest(F.least(F.col(f"lo{a}") + i * stride, F.col(f"hi{a}") - size), F.col(f"lo{a}")))

    grid = box.withColumn("wx", F.explode(starts("x"))).withColumn("wy", F.explode(starts("y"))).select(by, "wx", "wy")
    inside = reduce(Column.__and__, [(F.col(a) >= F.col(f"w{a}")) & (F.col(a) <= F.col(f"w{a}") + size) for a in "xy"])
    return points.join(grid, by).where(inside).groupBy(by, "wx", "wy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _squared(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    return reduce(Column.__add__, [(F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(a, b)])


def knn(queries: DataFrame, refs: DataFrame, k: int, cell: float, by: str = "scene_id", query_id: str = "q", ref_id: str = "n", rounds: int = 64) -> DataFrame:
    """The ``k`` nearest refs of each query in its scene: by, q, n, d2 and rank (from 1); ties go to the lesser id.

    Refs are bucketed in cells and a query looks into the 27 around it, as an
    equi-join. A query is settled when its k-th neighbour is no farther than a
    cell's side; the others go on with twice the side, until a cell is as wide
    as all the data. Each round's results and open queries are tables of their
    own, so plans stay flat. Scenes with fewer refs give fewer rows, a scene
    without refs none. Queries still open after ``rounds`` are an error.
    """
    box = refs.select(*AXES).unionByName(queries.select(*AXES)).agg(*(f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max)))).first()
    span = max((box[f"hi{a}"] - box[f"lo{a}"] for a in AXES if box[f"lo{a}"] is not None), default=0.0)
    found, open_, size = [], queries.select(by, query_id, *AXES), cell
    offsets = F.array(*(F.struct(*(F.lit(o).alias(f"o{a}") for a, o in zip(AXES, (i, j, l)))) for i in (-1, 0, 1) for j in (-1, 0, 1) for l in (-1, 0, 1)))
    for _ in range(rounds):
        held = voxelize(refs.select(by, ref_id, *AXES), size).select(by, *CELL, ref_id, *(F.col(a).alias(f"r{a}") for a in AXES))
        look = voxelize(open_, size).select(by, query_id, *AXES, *CELL, F.explode(offsets).alias("o"))
        look = look.withColumns({c: F.col(c) + F.col(f"o.o{c[1]}") for c in CELL}).drop("o")
        near = look.join(held, [by, *CELL]).select(by, query_id, ref_id, _squared(AXES, ("rx", "ry", "rz")).alias("d2"))
        place = Window.partitionBy(by, query_id).orderBy("d2", ref_id)
        ranked = near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        if size >= span:
            return reduce(DataFrame.unionByName, [*found, ranked])
        ranked = cut_lineage(ranked)
        settled = ranked.where((F.col("rank") == k) & (F.col("d2") <= size * size)).select(by, query_id)
        found.append(ranked.join(settled, [by, query_id], "left_semi"))
        open_ = cut_lineage(open_.join(settled, [by, query_id], "left_anti"))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found)
        size *= 2
    raise RuntimeError(f"queries are open after {rounds} rounds; cell {cell} is too small for a span of {span}")


def _shared_folder(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir; where none is set and the master is local, a temporary one. On a cluster that is an error."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scenequarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that later plans start from it."""
    _shared_folder(df)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, as a table, for loops of joins: a checkpoint keeps its plan's estimated size, which joins
    multiply until planning is all arithmetic on huge numbers; a table has the size of its files."""
    out = f"{_shared_folder(df).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def nearest(queries: DataFrame, refs: DataFrame, cell: float, **how) -> DataFrame:
    """1-NN join: resolution transfer and label transfer."""
    return knn(queries, refs, 1, cell, **how).drop("rank")


def knn_padded(neighbours: DataFrame, k: int, by: str = "scene_id", query_id: str = "q", ref_id: str = "n") -> DataFrame:
    """Fill queries with fewer than ``k`` neighbours: the nearest repeated, at squared distance 1e10."""
    lists = neighbours.groupBy(by, query_id).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(ref_id).alias("id"), "d2"))).alias("l"))
    full = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when(i <= F.size("l"), F.struct(i.alias("rank"), F.col("l")[i - 1]["id"].alias(ref_id), F.col("l")[i - 1]["d2"].alias("d2"))).otherwise(F.struct(i.alias("rank"), F.col("l")[0]["id"].alias(ref_id), F.lit(1e10).alias("d2"))))
    return lists.select(by, query_id, F.inline(full))


def query_and_group(queries: DataFrame, refs: DataFrame, neighbours: DataFrame, values: list[str], relative: bool = True, by: str = "scene_id", query_id: str = "q", ref_id: str = "n") -> DataFrame:
    """Each neighbour's offset from its query (or own position) and its ``values``."""
    q = queries.select(by, query_id, *(F.col(a).alias(f"q{a}") for a in AXES))
    r = refs.select(by, ref_id, *AXES, *values)
    near = neighbours.select(by, query_id, ref_id, "rank")
    joined = near.join(r, [by, ref_id]).join(q, [by, query_id])
    place = [(F.col(a) - F.col(f"q{a}") if relative else F.col(a)).alias(a) for a in AXES]
    return joined.select(by, query_id, "rank", ref_id, *place, *values)


def interpolate(neighbours: DataFrame, refs: DataFrame, values: list[str], by: str = "scene_id", query_id: str = "q", ref_id: str = "n", inside: bool = False) -> DataFrame:
    """Inverse-distance means of ``values`` over a query's neighbours; ``inside`` puts the guard under the root."""
    near = F.sqrt(F.col("d2") + 1e-8) if inside else F.sqrt("d2") + 1e-8
    w = neighbours.select(by, query_id, ref_id, (1 / near).alias("_w"))
    joined = w.join(refs.select(by, ref_id, *values), [by, ref_id])
    return joined.groupBy(by, query_id).agg(*((F.sum(F.col(v) * F.col("_w")) / F.sum("_w")).alias(v) for v in values))


def neighbour_difference(neighbours: DataFrame, a: DataFrame, b: DataFrame, values: list[str], by: str = "scene_id", query_id: str = "q", ref_id: str = "n") -> DataFrame:
    """a[q] - b[n] for every (query, neighbour)."""
    left = a.select(by, query_id, *(F.col(v).alias(f"a_{v}") for v in values))
    right = b.select(by, ref_id, *(F.col(v).alias(f"b_{v}") for v in values))
    joined = neighbours.select(by, query_id, ref_id, "rank").join(left, [by, query_id]).join(right, [by, ref_id])
    return joined.select(by, query_id, "rank", *((F.col(f"a_{v}") - F.col(f"b_{v}")).alias(v) for v in values))


def weighted_gather(neighbours: DataFrame, refs: DataFrame, values: list[str], weights: list[Column], by: str = "scene_id", query_id: str = "q", ref_id: str = "n") -> DataFrame:
    """Sum over neighbours of value times weight; channel c uses weight c mod len(weights)."""
    joined = neighbours.join(refs.select(by, ref_id, *values), [by, ref_id])
    return joined.groupBy(by, query_id).agg(*(F.sum(F.col(v) * weights[i % len(weights)]).alias(v) for i, v in enumerate(values)))


def chamfer(a: DataFrame, b: DataFrame, cell: float, kind: str = "l2", by: str = "scene_id", a_id: str = "q", b_id: str = "n") -> DataFrame:
    """Both directions of nearest distance with the match; ``kind``: l2 (squared) or huber, on the L2 distance.

    Nearest neighbours come from the cell join, so neither side is crossed with the other.
    """
    there = nearest(a, b, cell, by=by, query_id=a_id, ref_id=b_id).select(by, F.lit("a").alias("side"), F.col(a_id).alias("id"), F.col(b_id).alias("match"), "d2")
    back = nearest(b, a, cell, by=by, query_id=b_id, ref_id=a_id).select(by, F.lit("b").alias("side"), F.col(b_id).alias("id"), F.col(a_id).alias("match"), "d2")
    both = there.unionByName(back)
    return both if kind == "l2" else both.withColumn("d2", huber(F.sqrt("d2")))


def huber(error: Column, delta: float = 1.0) -> Column:
    size = F.abs(error)
    low = F.least(size, F.lit(delta))
    return 0.5 * low * low + delta * (size - low)
