"""The queries over the test tables and their DuckDB counterparts.

Each query applies one operator to whole views; ``@query`` registers it with
the views its SQL needs and the SQL itself (none where SQL can't express it).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import augment, colour, geometry
from .operators import aggregates, assign, attention, graph, grouped, masks, metrics, projection, spatial
from .plans import proposals
from .plans.views import Views, with_views

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Least points of an instance or prediction in the evaluation queries, small enough for the smallest tables.
LEAST = 10


def query(views: str = "", sql: str | None = None):
    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = with_views(views, sql) if views else sql.strip()
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(Views(spark, sf_dir)) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


VOXEL = "cast(floor(x / {0}) as bigint) as vx, cast(floor(y / {0}) as bigint) as vy, cast(floor(z / {0}) as bigint) as vz"


# -- voxels and pooling


@query("points", f"select scene_id, {VOXEL.format(0.5)}, min(point_id) as point_id, count(*) as n from points group by 1, 2, 3, 4")
def voxelize_first(v):
    return spatial.first_in_voxel(v.points, 0.5)


@query("points", f"""with voxels as (select scene_id, {VOXEL.format(0.5)}, avg(r) as r, avg(g) as g from points group by 1, 2, 3, 4)
    select scene_id, cast(floor(vx / 2) as bigint) as vx, cast(floor(vy / 2) as bigint) as vy, cast(floor(vz / 2) as bigint) as vz, round(avg(r), 6) as r, round(avg(g), 6) as g
    from voxels group by 1, 2, 3, 4""")
def voxel_avg_pool2(v):
    return rounded(spatial.pool(spatial.voxel_mean(v.points, 0.5, ["r", "g"]), ["r", "g"], "avg"), "r", "g", digits=6)


@query("points", f"""with voxels as (select scene_id, {VOXEL.format(0.5)}, avg(r) as r from points group by 1, 2, 3, 4),
    up as (select scene_id, cast(floor(vx / 2) as bigint) as px, cast(floor(vy / 2) as bigint) as py, cast(floor(vz / 2) as bigint) as pz, max(r) as r_max, sum(r) as r_sum from voxels group by 1, 2, 3, 4)
    select scene_id, px as vx, py as vy, pz as vz, round(r_max, 4) as r_max, round(r_sum, 4) as r_sum from up""")
def voxel_max_pool2(v):
    vox = spatial.voxel_mean(v.points, 0.5, ["r"]).withColumn("r_max", F.col("r"))
    top = spatial.pool(vox, ["r_max"], "max")
    total = spatial.pool(vox.withColumn("r_sum", F.col("r")), ["r_sum"], "sum")
    return rounded(top.join(total, ["scene_id", "vx", "vy", "vz"]), "r_max", "r_sum")


@query("points", f"""with voxels as (select scene_id, {VOXEL.format(0.5)}, avg(r) as r from points group by 1, 2, 3, 4),
    up as (select scene_id, cast(floor(vx / 2) as bigint) as px, cast(floor(vy / 2) as bigint) as py, cast(floor(vz / 2) as bigint) as pz, max(r) as up from voxels group by 1, 2, 3, 4)
    select v.scene_id, vx, vy, vz, round(r, 4) as r, round(up, 4) as up from voxels v join up u
    on v.scene_id = u.scene_id and floor(vx / 2) = px and floor(vy / 2) = py and floor(vz / 2) = pz""")
def voxel_unpool(v):
    vox = spatial.voxel_mean(v.points, 0.5, ["r"]).drop("n")
    up = spatial.pool(vox.withColumn("up", F.col("r")), ["up"], "max")
    return rounded(spatial.unpool(vox, up), "r", "up")


@query("points", f"""with voxels as (select scene_id, {VOXEL.format(1.0)}, count(*) as n from points group by 1, 2, 3, 4)
    select p.scene_id, point_id, n from (select scene_id, point_id, {VOXEL.format(1.0)} from points) p join voxels v using (scene_id, vx, vy, vz)""")
def voxel_to_point(v):
    vox = spatial.voxelize(v.points, 1.0).groupBy("scene_id", "vx", "vy", "vz").agg(F.count(F.lit(1)).alias("n"))
    return spatial.to_points(v.points, vox, 1.0).select("scene_id", "point_id", "n")


@query("points", """with shifted as (select scene_id, x - 5 as x, y - 5 as y, z - 1.5 as z from points)
    select distinct scene_id, cast(least(greatest(floor((x + 5.0) / 0.625), 0), 15) as bigint) as vx, cast(least(greatest(floor((y + 5.0) / 0.625), 0), 15) as bigint) as vy,
    cast(least(greatest(floor((z + 5.0) / 0.625), 0), 15) as bigint) as vz from shifted""")
def occupancy_grid(v):
    p = v.points.select("scene_id", (F.col("x") - 5).alias("x"), (F.col("y") - 5).alias("y"), (F.col("z") - 1.5).alias("z"))
    return spatial.occupancy(p, 16, 5.0)


@query("frames", f"""select scene_id, cast(floor(t / 4) as bigint) as step, cast(floor(value / 5) as bigint) as cell, min(frame_id) as frame_id, count(*) as n from frames group by 1, 2, 3""")
def temporal_voxels(v):
    f = v.frames.select("scene_id", "frame_id", F.floor(F.col("t") / 4).cast("long").alias("step"), F.floor(F.col("value") / 5).cast("long").alias("cell"))
    return f.groupBy("scene_id", "step", "cell").agg(F.min("frame_id").alias("frame_id"), F.count(F.lit(1)).alias("n"))


# -- segments and aggregates


@query("points", """select scene_id, segment_id, round(coalesce(avg(case when r <> 0 or g <> 0 then r end), 0), 4) as r, round(coalesce(avg(case when r <> 0 or g <> 0 then g end), 0), 4) as g from points group by 1, 2""")
def segment_mean(v):
    return rounded(aggregates.segment_stat(v.points, ["r", "g"]), "r", "g")


@query("points", "select scene_id, segment_id, cast(max(r) as double) as r, cast(max(b) as double) as b from points group by 1, 2")
def segment_max(v):
    return aggregates.segment_stat(v.points, ["r", "b"], "max").select("scene_id", "segment_id", F.col("r").cast("double").alias("r"), F.col("b").cast("double").alias("b"))


@query("points masks", """with size as (select scene_id, segment_id, count(*) as n from points group by 1, 2),
    hit as (select m.scene_id, mask_id, segment_id, count(*) as k from masks m join points p using (scene_id, point_id) group by 1, 2, 3)
    select h.scene_id, mask_id, h.segment_id, k, n from hit h join size s using (scene_id, segment_id) where k > 0.25 * n""")
def segment_vote(v):
    return aggregates.segment_vote(v.points, v.masks, share=0.25)


@query("points", """with seg as (select scene_id, segment_id, case when segment_id % 3 = 0 then 0.0 else avg(r) end as f from points group by 1, 2),
    edges as (select a.scene_id, a.segment_id as src, b.segment_id as dst from seg a join seg b on a.scene_id = b.scene_id and abs(a.segment_id - b.segment_id) = 1),
    near as (select e.scene_id, src, avg(f) as f from edges e join seg s on s.scene_id = e.scene_id and s.segment_id = dst where f <> 0 group by 1, 2),
    mean as (select scene_id, avg(f) as f from seg group by 1)
    select s.scene_id, s.segment_id, round(case when s.f <> 0 then s.f else coalesce(n.f, m.f) end, 4) as f
    from seg s join mean m on m.scene_id = s.scene_id left join near n on n.scene_id = s.scene_id and n.src = s.segment_id""")
def zero_segment_impute(v):
    seg = v.points.groupBy("scene_id", "segment_id").agg(F.avg("r").alias("f")).withColumn("f", F.when(F.col("segment_id") % 3 == 0, 0.0).otherwise(F.col("f")))
    edges = seg.select("scene_id", F.col("segment_id").alias("src"), F.explode(F.array(F.col("segment_id") - 1, F.col("segment_id") + 1)).alias("dst"))
    return rounded(aggregates.impute_zero_segments(seg, edges, "f"), "f").select("scene_id", "segment_id", "f")


@query("points", "select scene_id, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z from points group by 1")
def scene_extent(v):
    return spatial.extents(v.points)


@query("points", """select scene_id, point_id, round(x - min(x) over w, 4) as x, round(y - avg(y) over w, 4) as y from points window w as (partition by scene_id)""")
def shift_and_centre(v):
    p = spatial.shift_to_origin(v.points.select("scene_id", "point_id", "x", "y"), axes=("x",))
    return rounded(spatial.mean_centre(p, axes=("y",)), "x", "y").select("scene_id", "point_id", "x", "y")


@query("points", """select scene_id, instance_id, round(avg(x), 4) as mean_x, min(x) as min_x, max(x) as max_x, round(avg(y), 4) as mean_y, min(y) as min_y, max(y) as max_y,
    round(avg(z), 4) as mean_z, min(z) as min_z, max(z) as max_z, count(*) as n from points where instance_id >= 0 group by 1, 2""")
def instance_info(v):
    return rounded(aggregates.instance_info(v.points), "mean_x", "mean_y", "mean_z")


@query("points", """select scene_id, instance_id, round(avg(x), 4) as cx, round(avg(y), 4) as cy, round(avg(z), 4) as cz, round(max(x) - min(x), 4) as lx, round(max(y) - min(y), 4) as ly,
    round(max(z) - min(z), 4) as lz, count(*) as n from points where instance_id >= 0 group by 1, 2""")
def aabb_mean_center(v):
    b = aggregates.boxes(v.points.where("instance_id >= 0"), ["scene_id", "instance_id"])
    return rounded(b, "cx", "cy", "cz", "lx", "ly", "lz")


@query("points", """with m as (select scene_id, avg(r / 255.0) as mr, avg(g / 255.0) as mg, avg(b / 255.0) as mb, avg((r / 255.0) * (r / 255.0)) as sr, avg((g / 255.0) * (g / 255.0)) as sg, avg((b / 255.0) * (b / 255.0)) as sb from points group by 1)
    select round(avg(mr), 4) as mean_r, round(avg(mg), 4) as mean_g, round(avg(mb), 4) as mean_b, round(sqrt(avg(sr) - avg(mr) * avg(mr)), 4) as std_r, round(sqrt(avg(sg) - avg(mg) * avg(mg)), 4) as std_g, round(sqrt(avg(sb) - avg(mb) * avg(mb)), 4) as std_b from m""")
def color_stats_two_level(v):
    s = aggregates.colour_stats(aggregates.colour_moments(v.points))
    return rounded(s, *s.columns)


@query("points", """with m as (select scene_id, avg(r / 255.0) as mr, avg(g / 255.0) as mg, avg(b / 255.0) as mb, avg((r / 255.0) * (r / 255.0)) as sr, avg((g / 255.0) * (g / 255.0)) as sg, avg((b / 255.0) * (b / 255.0)) as sb from points group by 1)
    select a.scene_id, round(avg(o.mr), 4) as mean_r, round(avg(o.mg), 4) as mean_g, round(avg(o.mb), 4) as mean_b, round(sqrt(avg(o.sr) - avg(o.mr) * avg(o.mr)), 4) as std_r,
    round(sqrt(avg(o.sg) - avg(o.mg) * avg(o.mg)), 4) as std_g, round(sqrt(avg(o.sb) - avg(o.mb) * avg(o.mb)), 4) as std_b from m a join m o on a.scene_id <> o.scene_id group by 1""")
def leave_one_out_stats(v):
    s = aggregates.leave_one_out(aggregates.colour_moments(v.points))
    return rounded(s, *s.columns[1:])


@query("points", """with c as (select scene_id, segment_id, label, count(*) as n from points where label <> 3 group by 1, 2, 3)
    select scene_id, segment_id, label, n from (select *, row_number() over (partition by scene_id, segment_id order by n desc, label) as k from c) where k = 1""")
def majority_label(v):
    return aggregates.majority(v.points, ["scene_id", "segment_id"], "label", ignore=3)


@query("frames", """select scene_id, round(list_reduce(list_prepend(cast(0 as double), list(value order by t)), lambda a, x: (a + x) / 2), 6) as value, count(*) as n from frames group by 1""")
def view_fusion_ordered(v):
    return rounded(masks.fuse_views(v.frames, ["scene_id"], "t", "value"), "value", digits=6).withColumn("n", F.col("n").cast("long"))


@query("frames", """with s as (select *, (frame_id * 7919) % 100 as conf from frames)
    select scene_id, frame_id, conf from (select *, row_number() over (partition by scene_id order by conf desc, t) as k from s) where k = 1""")
def confidence_fusion(v):
    f = v.frames.withColumn("conf", F.col("frame_id") * 7919 % 100)
    return masks.fuse_confident(f, ["scene_id"], "t", "frame_id", "conf").select("scene_id", "frame_id", "conf")


# -- labels, ids, relational steps


@query("points", "select label, case label when 1 then 0 when 3 then 1 else 255 end as mapped, count(*) as n from points group by 1, 2")
def label_remap(v):
    return aggregates.remap_labels(v.points.withColumn("mapped", F.col("label")), "mapped", [3, 1]).groupBy("label", "mapped").agg(F.count(F.lit(1)).alias("n"))


@query("points", """with e as (select label, instance_id, cast(label * 1000 + instance_id + 1 as bigint) as gt_id from points where instance_id >= 0)
    select gt_id, cast(floor(gt_id / 1000) as int) as dec_label, cast(gt_id % 1000 as int) as dec_instance, count(*) as n from e group by 1""")
def gt_encode_decode(v):
    e = v.points.where("instance_id >= 0").select(aggregates.encode_gt(F.col("label"), F.col("instance_id")).alias("gt_id"))
    label, instance = aggregates.decode_gt(F.col("gt_id"))
    return e.groupBy("gt_id").agg(F.count(F.lit(1)).alias("n")).select("gt_id", label.alias("dec_label"), instance.alias("dec_instance"), "n")


@query("", "select (l_suppkey % 65536) as sem, cast(floor((l_partkey * 65536) / 65536) as bigint) % 65536 as ins, count(*) as n from lineitem group by 1, 2")
def bit_unpack(v):
    packed = F.col("l_partkey") * 65536 + F.col("l_suppkey") % 65536
    sem, ins = aggregates.unpack_label(packed)
    return v.table("lineitem").select(sem.alias("sem"), ins.alias("ins")).groupBy("sem", "ins").agg(F.count(F.lit(1)).alias("n"))


@query("points", """with d as (select distinct scene_id, r from points),
    n as (select scene_id, r, cast(row_number() over (partition by scene_id order by r) - 1 as bigint) as k from d)
    select p.scene_id, k as r, count(*) as n from points p join n using (scene_id, r) group by 1, 2""")
def dense_relabel(v):
    return aggregates.dense_ids(v.points.select("scene_id", "r"), "r").groupBy("scene_id", "r").agg(F.count(F.lit(1)).alias("n"))


FACES = """base as (select scene_id, max(point_id) + 1 as n from points group by 1),
    tri as (select scene_id, unnest(generate_series(0, cast(floor((n - 4) / 3) as bigint))) as k from base where n >= 4),
    faces as (select scene_id, 2 * k as f, 3 * k as i1, 3 * k + 1 as i2, 3 * k + 2 as i3 from tri union all select scene_id, 2 * k + 1, 3 * k + 1, 3 * k + 2, 3 * k + 3 from tri)"""


def faces(v) -> DataFrame:
    """Consecutive triples of points as triangles."""
    n = v.points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")  # point ids are 0 to n - 1
    k = n.select("scene_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 4) / 3))).alias("k"))
    three = lambda f, a: F.struct((F.col("k") * 2 + f).alias("f"), *((F.col("k") * 3 + a + i).alias(f"i{i + 1}") for i in range(3)))
    return k.select("scene_id", F.inline(F.array(three(0, 0), three(1, 1))))


def vertices(v) -> DataFrame:
    return v.points.select("scene_id", F.col("point_id").alias("v"), "x", "y", "z", *((F.col(c) / 255.0).alias(c) for c in "rgb"), "segment_id")


@query("points", f"""with {FACES}, kept as (select faces.* from faces join points p on p.scene_id = faces.scene_id and p.point_id = i1 where label <> 3),
    used as (select distinct scene_id, unnest([i1, i2, i3]) as v from kept), new as (select scene_id, v, row_number() over (partition by scene_id order by v) - 1 as k from used)
    select kept.scene_id, f, cast(a.k as bigint) as i1, cast(b.k as bigint) as i2, cast(c.k as bigint) as i3 from kept join new a on a.scene_id = kept.scene_id and a.v = i1
    join new b on b.scene_id = kept.scene_id and b.v = i2 join new c on c.scene_id = kept.scene_id and c.v = i3""")
def mesh_reindex(v):
    good = v.points.where("label <> 3").select("scene_id", F.col("point_id").alias("i1"))
    _, out = aggregates.reindex(vertices(v), faces(v).join(aggregates.shuffled(good), ["scene_id", "i1"], "left_semi"))
    return out.select("scene_id", "f", "i1", "i2", "i3")


@query("points", f"""with {FACES}, e as (select scene_id, i1 as src, i2 as dst from faces union all select scene_id, i1, i3 from faces union all select scene_id, i3, i2 from faces),
    own as (select scene_id, point_id, segment_id from points),
    met as (select e.scene_id, a.segment_id as src, b.segment_id as dst from e join own a on a.scene_id = e.scene_id and a.point_id = src join own b on b.scene_id = e.scene_id and b.point_id = dst where a.segment_id <> b.segment_id)
    select scene_id, src, dst from met union select scene_id, dst, src from met""")
def mesh_adjacency(v):
    return graph.segment_adjacency(vertices(v), graph.face_edges(faces(v)))


NORMALS = f"""{FACES}, p as (select scene_id, point_id, x, y, z from points),
    c as (select f.scene_id, f, i1, i2, i3, b.x - a.x as ux, b.y - a.y as uy, b.z - a.z as uz, c.x - a.x as wx, c.y - a.y as wy, c.z - a.z as wz from faces f
        join p a on a.scene_id = f.scene_id and a.point_id = i1 join p b on b.scene_id = f.scene_id and b.point_id = i2 join p c on c.scene_id = f.scene_id and c.point_id = i3),
    n as (select scene_id, f, i1, i2, i3, uy * wz - uz * wy as x, uz * wx - ux * wz as y, ux * wy - uy * wx as z from c),
    u as (select scene_id, f, i1, i2, i3, case when x*x + y*y + z*z > 0 then x / sqrt(x*x + y*y + z*z) end as nx, case when x*x + y*y + z*z > 0 then y / sqrt(x*x + y*y + z*z) end as ny, case when x*x + y*y + z*z > 0 then z / sqrt(x*x + y*y + z*z) end as nz from n),
    vn as (select scene_id, v, avg(nx) as nx, avg(ny) as ny, avg(nz) as nz from (select scene_id, unnest([i1, i2, i3]) as v, nx, ny, nz from u) group by 1, 2)"""


@query("points", f"with {NORMALS} select scene_id, v, round(nx, 4) as nx, round(ny, 4) as ny, round(nz, 4) as nz from vn")
def vertex_normals(v):
    return rounded(graph.vertex_normals(graph.face_normals(vertices(v), faces(v))), "nx", "ny", "nz")


@query("points", f"""with {NORMALS}, e as (select scene_id, i1 as src, i2 as dst from faces union all select scene_id, i1, i3 from faces union all select scene_id, i3, i2 from faces),
    q as (select o.scene_id, v, x, y, z, r / 255.0 as r, g / 255.0 as g, b / 255.0 as b, nx, ny, nz from points o join vn on vn.scene_id = o.scene_id and v = point_id),
    w as (select e.scene_id, src, dst, (1 - (a.nx * b.nx + a.ny * b.ny + a.nz * b.nz)) * (abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b)) as w, abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b) as c,
        b.nx * (b.x - a.x) + b.ny * (b.y - a.y) + b.nz * (b.z - a.z) as lean from e join q a on a.scene_id = e.scene_id and a.v = src join q b on b.scene_id = e.scene_id and b.v = dst)
    select scene_id, count(*) as n, round(sum(case when lean > 0 and c < 0.05 then w * w else w end), 2) as total from w group by 1""")
def edge_weights(v):
    w = _weights(v)
    return w.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 2).alias("total"))


def _weights(v) -> DataFrame:
    normals = graph.vertex_normals(graph.face_normals(vertices(v), faces(v)))
    return graph.edge_weights(graph.face_edges(faces(v)), vertices(v).join(aggregates.shuffled(normals), ["scene_id", "v"]))


@query("points", """with m as (select scene_id, floor(scene_id / 4) as merged_id, max(instance_id) as m from points group by 1, 2),
    s as (select scene_id, merged_id, coalesce(sum(m + 1) over (partition by merged_id order by scene_id rows between unbounded preceding and 1 preceding), 0) as shift from m)
    select cast(merged_id as bigint) as merged_id, p.scene_id, cast(case when instance_id < 0 then instance_id else instance_id + shift end as bigint) as instance_id, count(*) as n
    from points p join s using (scene_id) group by 1, 2, 3""")
def merge_scenes_offsets(v):
    merged = aggregates.merge_scenes(v.points, group=F.floor(F.col("scene_id") / 4).cast("long"))
    return merged.groupBy("merged_id", "scene_id", "instance_id").agg(F.count(F.lit(1)).alias("n"))


@query("frames", "select scene_id, frame_id, cast(floor(t / 5) as bigint) as chunk from frames")
def sweep_chunks(v):
    return aggregates.chunks(v.frames, 5).select("scene_id", "frame_id", "chunk")


@query("frames", """with w as (select scene_id, t, frame_id as frame_id_0, lead(frame_id, 2) over (partition by scene_id order by t) as frame_id_1, lead(frame_id, 4) over (partition by scene_id order by t) as frame_id_2 from frames)
    select scene_id, cast(t as bigint) as t, frame_id_0, frame_id_1, frame_id_2 from w where frame_id_2 is not null""")
def dilated_frames(v):
    return aggregates.dilated(v.frames, 3, 2, "frame_id").withColumn("t", F.col("t").cast("long"))


@query("points", "select scene_id, instance_id, count(*) as n, md5(cast(scene_id as varchar) || cast(instance_id as varchar)) as name from points where instance_id >= 0 group by 1, 2")
def instance_database(v):
    return aggregates.instance_names(v.points)


@query("points", """with g as (select scene_id, instance_id as group_id, instance_id as ordinal, list_distinct(list(segment_id)) as segments from points where instance_id >= 0 group by 1, 2),
    o as (select scene_id, segment_id, max_by(group_id, ordinal) as group_id from (select scene_id, group_id, ordinal, unnest(segments) as segment_id from g) group by 1, 2)
    select p.scene_id, coalesce(o.group_id, -1) as group_id, count(*) as n from points p left join o using (scene_id, segment_id) group by 1, 2""")
def json_seg_groups(v):
    packed = v.points.where("instance_id >= 0").groupBy("scene_id", "instance_id").agg(F.to_json(F.struct(F.collect_set("segment_id").alias("segments"))).alias("j"))
    groups = packed.select("scene_id", F.col("instance_id").alias("group_id"), F.col("instance_id").alias("ordinal"), F.from_json("j", "segments array<long>")["segments"].alias("segments"))
    return aggregates.segments_to_instances(v.points, groups).groupBy("scene_id", "group_id").agg(F.count(F.lit(1)).alias("n"))


@query("", "select cast(json_extract(props, '$.k') as bigint) as k, count(*) as n from events group by 1")
def json_props(v):
    return v.table("events").select(F.from_json("props", "k long")["k"].alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


# -- tiles and crops


@query("points", """with m as (select scene_id, cast(ceil((max(x) - 2.5) / 2.5) as bigint) + 1 as nx, cast(ceil((max(y) - 2.5) / 2.5) as bigint) + 1 as ny from points group by 1),
    t as (select scene_id, tx, ty from (select scene_id, ny, unnest(generate_series(0, nx - 1)) as tx from m), lateral (select unnest(generate_series(0, ny - 1)) as ty))
    select t.scene_id, cast(tx as bigint) as tile_x, cast(ty as bigint) as tile_y, count(*) as n from t join points p on p.scene_id = t.scene_id
    and x between tx * 2.5 and tx * 2.5 + 2.5 and y between ty * 2.5 and ty * 2.5 + 2.5 group by 1, 2, 3""")
def tile_split_closed(v):
    return spatial.tiles(v.points, 2.5, 2.5).groupBy("scene_id", "tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"))


@query("points", "select scene_id, point_id from points where x >= 2.0 and x < 6.0 and y >= 1.0 and y < 5.0 and z >= 0.3 and z < 2.1")
def box_crop(v):
    return spatial.box_crop(v.points, (2.0, 1.0, 0.3), (6.0, 5.0, 2.1)).select("scene_id", "point_id")


@query("points", """with c as (select scene_id, x - avg(x) over w as x, y - avg(y) over w as y, z - avg(z) over w as z from points window w as (partition by scene_id)
    union all select scene_id, sx, sy, 0.1 from (select distinct scene_id from points), (values (0.1, 0.1), (0.1, -0.1), (-0.1, 0.1), (-0.1, -0.1)) s(sx, sy)),
    q as (select scene_id, (case when x > 0 then 2 else 0 end) + (case when y > 0 then 1 else 0 end) as quadrant, x, y from c where x <> 0 and y <> 0),
    d as (select scene_id, quadrant, x - avg(x) over w as x, y - avg(y) over w as y from q window w as (partition by scene_id, quadrant))
    select scene_id, quadrant, count(*) as n, round(min(x), 4) as min_x, round(max(y), 4) as max_y from d group by 1, 2""")
def quadrant_crops(v):
    q = spatial.quadrant_crops(v.points)
    return q.groupBy("scene_id", "quadrant").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 4).alias("min_x"), F.round(F.max("y"), 4).alias("max_y"))


# -- nearest neighbours over embeddings


def clouds(v) -> tuple[DataFrame, DataFrame]:
    """Two whole clouds: every vector's components 1 to 3 as queries, its components 4 to 6 as candidates."""
    far = v.table("embeddings").select("vec_id", *((F.col("embedding")[i + 3].cast("double") * 10).alias(a) for i, a in enumerate("xyz")), "label")
    q = v.feat_points.select("scene_id", F.col("vec_id").alias("q"), "x", "y", "z", "label")
    return q, far.select((F.col("vec_id") % 8).alias("scene_id"), F.col("vec_id").alias("n"), "x", "y", "z", "label")


NEAR = """far_points as (select vec_id % 8 as scene_id, vec_id, label, cast(embedding[4] as double) * 10 as x,
        cast(embedding[5] as double) * 10 as y, cast(embedding[6] as double) * 10 as z from embeddings),
    near as (select a.scene_id, a.vec_id as q, b.vec_id as n, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) as d2, b.label, b.x - a.x as dx, b.y - a.y as dy
        from feat_points a join far_points b on a.scene_id = b.scene_id),
    k as (select *, row_number() over (partition by scene_id, q order by d2, n) as rank from near)"""


@query("feat_points", f"with {NEAR} select scene_id, q, n, round(d2, 6) as d2, cast(rank as int) as rank from k where rank <= 3")
def knn(v):
    return rounded(spatial.knn(*clouds(v), 3, 1.0), "d2", digits=6)


@query("feat_points", f"with {NEAR} select scene_id, q, n, round(d2, 6) as d2 from k where rank = 1")
def nn_join(v):
    return rounded(spatial.nearest(*clouds(v), 1.0), "d2", digits=6)


@query("feat_points", f"with {NEAR} select scene_id, q, cast(rank as int) as rank, n, label, round(dx, 6) as dx, round(dy, 6) as dy from k where rank <= 3")
def query_and_group(v):
    q, n = clouds(v)
    g = spatial.query_and_group(q, n, spatial.knn(q, n, 3, 1.0), ["label"])
    return g.select("scene_id", "q", "rank", "n", "label", F.round("x", 6).alias("dx"), F.round("y", 6).alias("dy"))


@query("feat_points", f"with {NEAR} select scene_id, q, round(sum(label / (sqrt(d2) + 1e-8)) / sum(1 / (sqrt(d2) + 1e-8)), 4) as label from k where rank <= 3 group by 1, 2")
def knn_interpolate(v):
    q, n = clouds(v)
    return rounded(spatial.interpolate(spatial.knn(q, n, 3, 1.0), n, ["label"]), "label")


@query("feat_points", f"with {NEAR} select scene_id, q, cast(rank as int) as rank, round(-dx, 6) as x, round(-dy, 6) as y from k where rank <= 3")
def neighbor_diff(v):
    q, n = clouds(v)
    return rounded(spatial.neighbour_difference(spatial.knn(q, n, 3, 1.0), q, n, ["x", "y"]), "x", "y", digits=6)


@query("feat_points", f"""with {NEAR} select k.scene_id, q, round(sum(p.x / rank), 4) as x, round(sum(p.y * 2), 4) as y, round(sum(p.z / rank), 4) as z
    from k join far_points p on p.vec_id = k.n where rank <= 3 group by 1, 2""")
def gathered_weighted_sum(v):
    q, n = clouds(v)
    return rounded(spatial.weighted_gather(spatial.knn(q, n, 3, 1.0), n, ["x", "y", "z"], [1 / F.col("rank"), F.lit(2.0)]), "x", "y", "z")


@query("feat_points", f"""with {NEAR}, r as (select *, row_number() over (partition by scene_id, n order by d2, q) as back from near)
    select scene_id, 'a' as side, q as id, n as match, round(d2, 6) as d2 from k where rank = 1 union all select scene_id, 'b', n, q, round(d2, 6) from r where back = 1""")
def chamfer(v):
    return rounded(spatial.chamfer(*clouds(v), 1.0), "d2", digits=6)


# -- similarity and affinity


def segment_features(v) -> DataFrame:
    f = v.table("embeddings").select((F.col("vec_id") % 8).alias("scene_id"), (F.col("vec_id") % 40).alias("segment_id"), F.transform("embedding", lambda c: c.cast("double")).alias("f"))
    return aggregates.feature_mean(f, "f", ["scene_id", "segment_id"])


FEATURES = """parts as (select vec_id % 8 as scene_id, vec_id % 40 as segment_id, generate_subscripts(embedding, 1) as pos, cast(unnest(embedding) as double) as x from embeddings),
    means as (select scene_id, segment_id, pos, avg(x) as x from parts group by 1, 2, 3),
    seg as (select scene_id, segment_id, list(x order by pos) as f from means group by 1, 2),
    unit as (select scene_id, segment_id, list_transform(f, lambda x: x / sqrt(list_inner_product(f, f))) as f from seg),
    cosine as (select p.scene_id, p.segment_id as i, q.segment_id as j, list_inner_product(p.f, q.f) as raw from unit p join unit q using (scene_id)),
    spread as (select scene_id, i, j, case when max(raw) over w > min(raw) over w then (raw - min(raw) over w) / (max(raw) over w - min(raw) over w) else 0 end as sim from cosine window w as (partition by scene_id, i))"""


@query("", f"with {FEATURES} select scene_id, i, j, round(sim, 4) as sim from spread")
def cosine_affinity(v):
    return rounded(graph.similarity(segment_features(v), "f", "segment_id"), "sim")


@query("", f"""with {FEATURES}, gap as (select p.scene_id, p.segment_id as i, q.segment_id as j, list_distance(p.f, q.f) as raw from seg p join seg q using (scene_id))
    select scene_id, i, j, round(1 - case when max(raw) over w > min(raw) over w then (raw - min(raw) over w) / (max(raw) over w - min(raw) over w) else 0 end, 4) as sim from gap window w as (partition by scene_id, i)""")
def l2_similarity(v):
    return rounded(graph.similarity(segment_features(v), "f", "segment_id", kind="l2"), "sim")


@query("", f"""with {FEATURES}, e as (select scene_id, coalesce(min(case when sim <> 0 then sim end), 0) as lo, max(sim) as hi from spread group by 1),
    b as (select s.scene_id, i, j, case when greatest(sim - lo, 0) / (greatest(hi - lo, 0) + 1e-5) > 0.6 then 1.0 else 1e-5 end as a from spread s join e using (scene_id))
    select scene_id, j as i, round(sum(a), 4) as d from b group by 1, 2""")
def affinity_binarise(v):
    sim = graph.similarity(segment_features(v), "f", "segment_id")
    return rounded(graph.degrees(graph.affinity(sim, 0.6)), "d")


# -- attention


def attention_inputs(v) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = v.table("embeddings")
    part = lambda name, c, a: e.select(F.col("vec_id").alias(name), F.transform(F.slice("embedding", a, 8), lambda x: x.cast("double")).alias(c))
    n = max(e.count(), 1)
    edges = v.table("lineitem").select((F.col("l_orderkey") % n).alias("i0"), (F.col("l_partkey") % n).alias("i1")).distinct()
    return edges, part("i0", "q", 1), part("i1", "k", 9)


EDGES = "edges as (select distinct l_orderkey % n as i0, l_partkey % n as i1 from lineitem, (select greatest(count(*), 1) as n from embeddings) size)"
LOGITS = f"""{EDGES}, heads as (select unnest([0, 1]) as head),
    logit as (select i0, i1, cast(head as int) as head, list_sum(list_transform([1, 2, 3, 4], lambda c: cast(a.embedding[head * 4 + c] as double) * cast(b.embedding[8 + head * 4 + c] as double))) as logit
        from edges join embeddings a on a.vec_id = i0 join embeddings b on b.vec_id = i1, heads)"""


@query("", f"with {LOGITS} select i0, i1, head, round(logit, 5) as logit from logit")
def sparse_attention_logits(v):
    return rounded(attention.logits(*attention_inputs(v), heads=2), "logit", digits=5)


@query("", f"""with {LOGITS}, w as (select i0, i1, head, exp(logit) / sum(exp(logit)) over (partition by i0, head) as attn from logit),
    cs as (select unnest([0, 1, 2, 3]) as c)
    select i0, head, cast(c as int) as c, round(sum(attn * cast(e.embedding[8 + head * 4 + c + 1] as double)), 5) as value from w join embeddings e on e.vec_id = i1, cs group by 1, 2, 3""")
def sparse_attention_apply(v):
    edges, q, k = attention_inputs(v)
    weights = attention.softmax(attention.logits(edges, q, k, heads=2))
    return rounded(attention.apply(weights, k.withColumnRenamed("k", "v"), heads=2), "value", digits=5)


@query("", f"""with {EDGES}, rel as (select i0, i1, axis, (i0 * (axis + 1) + i1) % 5 as rel from edges, (values (0), (1), (2)) t(axis)), heads as (select unnest([0, 1]) as head)
    select i0, i1, cast(head as int) as head, round(sum(list_sum(list_transform([0, 1, 2, 3], lambda c: cast(e.embedding[head * 4 + c + 1] as double) * ((axis * 100 + rel * 10 + head * 4 + c) % 7) / 7.0))), 5) as bias
    from rel join embeddings e on e.vec_id = i0, heads group by 1, 2, 3""")
def rpe_bias(v):
    edges, q, _ = attention_inputs(v)
    edges = edges.select("i0", "i1", *(((F.col("i0") * (a + 1) + F.col("i1")) % 5).alias(f"r{a}") for a in range(3)))
    rows = [(a, r, h, [((a * 100 + r * 10 + h * 4 + c) % 7) / 7.0 for c in range(4)]) for a in range(3) for r in range(5) for h in range(2)]
    table = v.spark.createDataFrame(rows, "axis int, rel long, head int, row array<double>")
    return rounded(attention.position_bias(edges, q, table, heads=2), "bias", digits=5)


# -- evaluation


@query("points preds masks", """with pm as (select scene_id, point_id, max_by(mask_id, conf * 1e6 + mask_id / 1e4) as mask_id from masks join preds using (scene_id, mask_id) group by 1, 2)
    select scene_id, point_id, mask_id from pm""")
def painter_fusion(v):
    return masks.paint(v.masks, v.preds)


PAINTED = """painted as (select scene_id, point_id, max_by(mask_id, conf * 1e6 + mask_id / 1e4) as mask_id from masks join preds using (scene_id, mask_id) group by 1, 2),
    cells as (select p.label as target, coalesce(cast(floor((mask_id % 1000) / 100) as int), 0) as predicted, count(*) as n from points p left join painted using (scene_id, point_id) group by 1, 2)"""


def painted_labels(v) -> DataFrame:
    p = masks.paint(v.masks, v.preds)
    return v.points.join(p, ["scene_id", "point_id"], "left").select("label", F.coalesce(F.floor((F.col("mask_id") % 1000) / 100).cast("int"), F.lit(0)).alias("predicted"))


@query("points preds masks", f"with {PAINTED} select target, predicted, n from cells")
def confusion_matrix(v):
    return metrics.confusion(painted_labels(v), "label", "predicted")


@query("points preds masks", f"""with {PAINTED}, l as (select target as label from cells union select predicted from cells),
    s as (select label, coalesce(sum(case when target = label and predicted = label then n end), 0) as tp, coalesce(sum(case when target <> label and predicted = label then n end), 0) as fp,
        coalesce(sum(case when target = label and predicted <> label then n end), 0) as fn from l, cells group by 1)
    select label, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, round(case when tp + fp + fn > 0 then tp / (tp + fp + fn) end, 4) as iou from s""")
def iou_per_class(v):
    return rounded(metrics.class_iou(metrics.confusion(painted_labels(v), "label", "predicted")), "iou")


@query("points preds masks", f"with {PAINTED} select round(100.0 * sum(case when target = predicted then n else 0 end) / sum(n), 4) as precision from cells where target <> 3")
def precision_at_one(v):
    return rounded(metrics.precision_at_one(painted_labels(v), "label", "predicted", ignore=3), "precision")


PAIRS = f"""size as (select scene_id, gt_id, label, count(*) as gt_n, count(*) >= {LEAST} as counts from gt group by 1, 2, 3),
    kept as (select * from preds where vert_count >= {LEAST}),
    near as (select m.scene_id, mask_id, gt_id, count(*) as inter from masks m join gt using (scene_id, point_id) group by 1, 2, 3),
    hit as (select n.*, k.label, k.conf, k.vert_count, s.label as gt_label, s.gt_n, s.counts from near n join kept k using (scene_id, mask_id) join size s using (scene_id, gt_id)),
    ign as (select scene_id, mask_id, sum(inter) as valid, sum(case when label = gt_label and not counts then inter else 0 end) as small from hit group by 1, 2),
    pr as (select k.scene_id, k.mask_id, k.label, k.conf, k.vert_count, k.vert_count - coalesce(valid, 0) + coalesce(small, 0) as ignored from kept k left join ign using (scene_id, mask_id)),
    pairs as (select scene_id, mask_id, gt_id, label, conf, counts, gt_n, inter, inter / (gt_n + vert_count - inter) as iou from hit where label = gt_label)"""
EVENTS = f"""{PAIRS}, ths as (select unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]::double[]) as th),
    hits as (select * from pairs, ths where iou > th),
    events as (select th, label, conf, case when row_number() over (partition by th, scene_id, gt_id order by conf desc, mask_id) = 1 then 1 else 0 end as tp from hits where counts
        union all select th, label, conf, 0 from pr, ths where ignored / vert_count <= th and not exists (select 1 from hits h where h.th = ths.th and h.scene_id = pr.scene_id and h.mask_id = pr.mask_id)),
    ng as (select label, count(*) as n_gt from size where counts group by 1),
    pts as (select th, label, conf, sum(tp) as tp, sum(1 - tp) as fp from events group by 1, 2, 3),
    curve as (select th, a.label, conf, sum(tp) over w / n_gt as r, sum(tp) over w / sum(tp + fp) over w as p from pts a join ng using (label) window w as (partition by th, a.label order by conf desc rows unbounded preceding)),
    steps as (select *, lag(r) over w as up, lead(r) over w as down from curve window w as (partition by th, label order by conf desc)),
    area as (select th, label, sum(p * (coalesce(down, r) - coalesce(up, 0)) / 2) + sum(case when up is null then r / 2 else 0 end) as ap, sum(r * (coalesce(down, r) - coalesce(up, 0)) / 2) as ar from steps group by 1, 2),
    classes as (select label from ng union select label from events),
    report as (select ths.th, c.label, case when n_gt is not null then coalesce(ap, 0) end as ap, case when n_gt is null then 0 else ar end as ar from classes c cross join ths left join ng using (label) left join area a on a.th = ths.th and a.label = c.label)"""


def association(v) -> metrics.Association:
    return metrics.associate(v.gt, v.preds, v.masks, LEAST)


def ap_table(v) -> DataFrame:
    a = association(v)
    a.pairs = a.pairs.persist()  # one row an overlapping pair; read by several branches
    return metrics.average_precision(metrics.precision_recall_events(a), a.gt)


@query("gt preds masks", f"with {EVENTS} select th, label, round(ap, 4) as ap, round(ar, 4) as ar from report")
def instance_ap(v):
    return rounded(ap_table(v), "ap", "ar")


@query("gt preds masks", f"with {EVENTS} select label, round(avg(ap), 4) as ap, round(max(case when th = 0.5 then ap end), 4) as ap50, round(avg(ar), 4) as ar, round(max(case when th = 0.5 then ar end), 4) as ar50 from report group by 1")
def instance_ar(v):
    return rounded(metrics.class_report(ap_table(v)), "ap", "ap50", "ar", "ar50")


@query("gt preds masks", f"with {EVENTS} select round(avg(ap), 4) as ap, round(avg(case when th = 0.5 then ap end), 4) as ap50, round(avg(ar), 4) as ar, round(avg(case when th = 0.5 then ar end), 4) as ar50 from report")
def instance_averages(v):
    return rounded(metrics.averages(ap_table(v)), "ap", "ap50", "ar", "ar50")


def per_scene(sql: str) -> str:
    """The evaluation chain with the scene kept as a key."""
    for old, new in (
        ("select th, label, conf, case when", "select th, scene_id, label, conf, case when"), ("select th, label, conf, 0 from pr", "select th, scene_id, label, conf, 0 from pr"),
        ("select label, count(*) as n_gt from size where counts group by 1", "select scene_id, label, count(*) as n_gt from size where counts group by 1, 2"),
        ("select th, label, conf, sum(tp) as tp, sum(1 - tp) as fp from events group by 1, 2, 3", "select th, scene_id, label, conf, sum(tp) as tp, sum(1 - tp) as fp from events group by 1, 2, 3, 4"),
        ("select th, a.label, conf,", "select th, a.scene_id, a.label, conf,"), ("join ng using (label) window w as (partition by th, a.label", "join ng using (scene_id, label) window w as (partition by th, a.scene_id, a.label"),
        ("partition by th, label order by conf desc)", "partition by th, scene_id, label order by conf desc)"), ("area as (select th, label,", "area as (select th, scene_id, label,"), ("as ar from steps group by 1, 2)", "as ar from steps group by 1, 2, 3)"),
        ("select label from ng union select label from events", "select scene_id, label from ng union select scene_id, label from events"), ("select ths.th, c.label,", "select ths.th, c.scene_id, c.label,"),
        ("left join ng using (label) left join area a on a.th = ths.th and a.label = c.label", "left join ng using (scene_id, label) left join area a on a.th = ths.th and a.scene_id = c.scene_id and a.label = c.label"),
    ):
        assert old in sql, old
        sql = sql.replace(old, new)
    return sql


@query("gt preds masks", f"with {per_scene(EVENTS)} select scene_id, label, round(avg(ap), 4) as ap, round(max(case when th = 0.5 then ap end), 4) as ap50 from report group by 1, 2")
def instance_ap_by_scene(v):
    a = association(v)
    a.pairs = a.pairs.persist()
    table = metrics.average_precision(metrics.precision_recall_events(a), a.gt, keys=("scene_id", "label"))
    return table.groupBy("scene_id", "label").agg(F.round(F.avg("ap"), 4).alias("ap"), F.round(F.max(F.when(F.col("th") == 0.5, F.col("ap"))), 4).alias("ap50"))


@query()
def instance_ap25(v):
    a = association(v)
    return rounded(metrics.average_precision(metrics.sequential_events(a, 0.25), a.gt, (0.25,)), "ap", "ar")


@query("gt preds masks", f"""with {PAIRS}, best as (select scene_id, gt_id, max(iou) as best from pairs group by 1, 2)
    select s.label, round(avg(coalesce(best, 0)), 4) as mucov, round(sum(coalesce(best, 0) * gt_n) / sum(gt_n), 4) as mwcov, count(*) as n from size s left join best using (scene_id, gt_id) group by 1""")
def coverage_mucov_mwcov(v):
    return rounded(metrics.coverage(association(v)), "mucov", "mwcov")


@query("gt preds masks", f"""with {PAIRS}, p as (select scene_id, mask_id, max(iou) as m from pairs group by 1, 2), g as (select scene_id, gt_id, max(iou) as m from pairs group by 1, 2),
    pp as (select k.label, avg(case when m >= 0.5 then 1.0 else 0.0 end) as precision from kept k left join p using (scene_id, mask_id) group by 1),
    gg as (select s.label, avg(case when m >= 0.5 then 1.0 else 0.0 end) as recall from size s left join g using (scene_id, gt_id) group by 1)
    select label, round(precision, 4) as precision, round(recall, 4) as recall from pp full join gg using (label)""")
def instance_precision_recall(v):
    return rounded(metrics.instance_precision_recall(association(v)), "precision", "recall")


BOXES = """xyz as (select scene_id, point_id, x, y, z from points),
    g as (select scene_id, gt_id, label, avg(x) as cx, avg(y) as cy, avg(z) as cz, max(x) - min(x) as lx, max(y) - min(y) as ly, max(z) - min(z) as lz from gt join xyz using (scene_id, point_id) group by 1, 2, 3),
    d as (select m.scene_id, m.mask_id, p.label, p.conf, avg(x) as cx, avg(y) as cy, avg(z) as cz, max(x) - min(x) as lx, max(y) - min(y) as ly, max(z) - min(z) as lz
        from masks m join xyz using (scene_id, point_id) join preds p on p.scene_id = m.scene_id and p.mask_id = m.mask_id group by 1, 2, 3, 4)"""
INTER = " * ".join(f"greatest(least(d.c{a} + d.l{a} / 2, g.c{a} + g.l{a} / 2) - greatest(d.c{a} - d.l{a} / 2, g.c{a} - g.l{a} / 2), 0)" for a in "xyz")


def box_tables(v) -> tuple[DataFrame, DataFrame]:
    xyz = v.points.select("scene_id", "point_id", "x", "y", "z")
    g = aggregates.boxes(v.gt.join(xyz, ["scene_id", "point_id"]), ["scene_id", "gt_id", "label"]).drop("n")
    d = aggregates.boxes(v.masks.join(xyz, ["scene_id", "point_id"]), ["scene_id", "mask_id"]).drop("n").join(v.preds.select("scene_id", "mask_id", "label", "conf"), ["scene_id", "mask_id"])
    return d, g


@query("points gt masks preds", f"""with {BOXES}, met as (select d.scene_id, d.label, d.mask_id, d.conf, g.gt_id, {INTER} as i, d.lx * d.ly * d.lz + g.lx * g.ly * g.lz as vol from d left join g on g.scene_id = d.scene_id and g.label = d.label),
    best as (select *, case when gt_id is null then null when vol - i > 0 then i / (vol - i) else 0 end as iou from met),
    top as (select * from (select *, row_number() over (partition by scene_id, label, mask_id order by round(iou, 12) desc nulls last, gt_id) as k from best) where k = 1),
    ev as (select *, coalesce(iou > 0.25, false) as hit from top),
    tp as (select scene_id, label, mask_id, conf, case when hit and row_number() over (partition by scene_id, label, gt_id, hit order by conf desc, mask_id) = 1 then 1 else 0 end as tp from ev),
    ng as (select label, count(*) as n_gt from g group by 1),
    pr as (select label, conf, scene_id, mask_id, sum(tp) over w / (n_gt + 1e-5) as r, sum(tp) over w / count(*) over w as p from tp join ng using (label) window w as (partition by label order by conf desc, scene_id, mask_id rows unbounded preceding)),
    en as (select label, max(p) over (partition by label order by conf desc, scene_id, mask_id rows between current row and unbounded following) * (r - coalesce(lag(r) over (partition by label order by conf desc, scene_id, mask_id), 0)) as a from pr)
    select label, round(sum(a), 4) as ap from en group by 1""")
def box_ap_voc(v):
    d, g = box_tables(v)
    n = g.groupBy("label").agg(F.count(F.lit(1)).alias("n_gt"))
    return rounded(metrics.voc_ap(metrics.box_events(d, g, 0.25), n), "ap")


@query("points gt masks preds", f"""with {BOXES}, c as (select * from d where conf > 0.3), good as (select d.scene_id, d.mask_id, g.gt_id from (select d.*, 1 as one from c d) d join g on g.scene_id = d.scene_id
        where (case when d.lx * d.ly * d.lz + g.lx * g.ly * g.lz - ({INTER}) > 0 then ({INTER}) / (d.lx * d.ly * d.lz + g.lx * g.ly * g.lz - ({INTER})) else 0 end) >= 0.5),
    s as (select g.scene_id, g.n as ng, coalesce(c.n, 0) as nd, coalesce(td, 0) as td, coalesce(tg, 0) as tg from (select scene_id, count(*) as n from g group by 1) g left join (select scene_id, count(*) as n from c group by 1) c using (scene_id)
        left join (select scene_id, count(distinct mask_id) as td, count(distinct gt_id) as tg from good group by 1) using (scene_id))
    select scene_id, td as tp, nd - td as fp, ng - tg as fn, round(case when nd > 0 then td / nd else 0 end, 4) as precision, round(case when td + ng - tg > 0 then td / (td + ng - tg) else 0 end, 4) as recall from s""")
def box_pr(v):
    d, g = box_tables(v)
    return rounded(metrics.box_counts(d, g, 0.5, 0.3), "precision", "recall")


# -- mask algebra


OVER = """ov as (select a.scene_id, a.mask_id as i, b.mask_id as j, count(*) as inter from (select distinct * from masks) a join (select distinct * from masks) b on a.scene_id = b.scene_id and a.point_id = b.point_id and a.mask_id <> b.mask_id group by 1, 2, 3),
    rk as (select *, row_number() over (partition by scene_id order by conf desc, mask_id) as rank from preds)"""


@query("preds masks", f"""with {OVER} select scene_id, mask_id, conf from rk where conf >= 0.1 and vert_count > 0 and not exists (
    select 1 from ov join rk o on o.scene_id = ov.scene_id and o.mask_id = ov.j where ov.scene_id = rk.scene_id and ov.i = rk.mask_id and o.rank < rk.rank and inter > 0.6 * o.vert_count)""")
def mask_overlap_dedup(v):
    return masks.drop_duplicates(v.preds, v.masks, 0.1, 0.6).select("scene_id", "mask_id", "conf")


@query("preds masks", f"""with {OVER}, pairs as (select ov.scene_id, i, j, inter / (a.vert_count + b.vert_count - inter) as iou from ov join rk a on a.scene_id = ov.scene_id and a.mask_id = i join rk b on b.scene_id = ov.scene_id and b.mask_id = j and a.label = b.label where a.rank < b.rank),
    comp as (select scene_id, j as i, max(iou) as comp from pairs group by 1, 2),
    dec as (select p.scene_id, p.j as mask_id, min((1 - iou) / (1 - coalesce(comp, 0) + 1e-6)) as decay from pairs p left join comp c on c.scene_id = p.scene_id and c.i = p.i group by 1, 2)
    select rk.scene_id, rk.mask_id, round(conf * least(coalesce(decay, 1), 1), 4) as conf from rk left join dec using (scene_id, mask_id)""")
def matrix_nms(v):
    return rounded(masks.matrix_nms(v.preds, v.masks), "conf").select("scene_id", "mask_id", "conf")


@query()
def hard_mask_nms(v):
    return masks.hard_nms(v.preds, masks.mask_iou(v.preds, v.masks), 0.3)


@query("preds masks", "select scene_id, mask_id, conf, cast(rank as int) as rank from (select *, row_number() over (partition by scene_id order by conf desc, mask_id) as rank from preds) where rank <= 20")
def mask_scores_topk(v):
    return masks.top_k(v.preds, 20).select("scene_id", "mask_id", "conf", "rank")


@query("preds masks", """with s as (select scene_id, mask_id, cast(c as int) as label, cast((cast(mask_id as bigint) * 7919 + c * 104729) % 1000 as double) / 1000.0 as conf from preds, (values (0), (1), (2)) t(c))
    select scene_id, mask_id, label, conf, cast(rank as int) as rank from (select *, row_number() over (partition by scene_id order by conf desc, mask_id, label) as rank from s) where rank <= 20""")
def class_scores_topk(v):
    scores = F.array(*((F.col("mask_id").cast("long") * 7919 + c * 104729) % 1000 / 1000.0 for c in range(3)))
    return masks.top_k_classes(v.preds.withColumn("scores", scores), "scores", 20)


@query("points masks", """with s as (select scene_id, max(x) - min(x) as sx, max(y) - min(y) as sy from points group by 1),
    m as (select m.scene_id, mask_id, max(x) - min(x) as mx, max(y) - min(y) as my, count(*) as n from masks m join points p using (scene_id, point_id) group by 1, 2)
    select m.scene_id, mask_id, n, round(mx, 4) as mx, round(my, 4) as my from m join s using (scene_id) where mx <= 0.95 * sx and my <= 0.95 * sy""")
def extent_filter(v):
    return rounded(masks.extent_filter(v.masks, v.points, 0.95), "mx", "my")


@query()
def mask_append_self_train(v):
    base, new = v.masks.where("mask_id between 1000 and 1999"), v.masks.where("mask_id >= 2000")
    return masks.append_masks(base, new, 10).groupBy("scene_id", "mask_id", "added").agg(F.count(F.lit(1)).alias("n"))


@query()
def nms_3d(v):
    d, _ = box_tables(v)
    corner = {f"{a}{k}": F.col(f"c{a}") + (1 if k == 2 else -1) * F.col(f"l{a}") / 2 for a in "xyz" for k in (1, 2)}
    return masks.box_nms(d.withColumns(corner).withColumnsRenamed({"mask_id": "box_id", "conf": "score"}), 0.5, ["scene_id", "label"])


@query("points", """with vox as (select distinct scene_id, cast(floor(x / 1.0) as bigint) as vx, cast(floor(y / 1.0) as bigint) as vy, cast(floor(z / 1.0) as bigint) as vz, instance_id, label from points),
    l as (select scene_id, instance_id, label, 'x' as plane, vy as a, vz as b from vox union all select scene_id, instance_id, label, 'y', vx, vz from vox union all select scene_id, instance_id, label, 'z', vx, vy from vox)
    select scene_id, instance_id, plane, a, b, round(avg(label), 4) as label, count(*) as n from l group by 1, 2, 3, 4, 5""")
def triplane_projection(v):
    vox = spatial.voxelize(v.points, 1.0).select("scene_id", "vx", "vy", "vz", "instance_id", "label").distinct()
    return rounded(projection.plane_means(vox, ["label"]), "label")


# -- projection


CAMERAS = [(2.0, 3.0), (5.0, 5.0), (8.0, 4.0), (4.0, 7.5)]
PIXEL_SQL = """cams(view_id, ox, oy) as (values (0, 2.0, 3.0), (1, 5.0, 5.0), (2, 8.0, 4.0), (3, 4.0, 7.5)), uv as (select a.u, b.v from (select unnest(generate_series(0, 15)) as u) a, (select unnest(generate_series(0, 15)) as v) b),
    rays as (select s.scene_id, view_id, u, v, cast(ox as double) as ox, cast(oy as double) as oy, -2.0 as oz, (u - 7.5) / 10.0 as px, (v - 7.5) / 10.0 as py from (select distinct scene_id from points) s, cams, uv),
    dirs as (select *, px / sqrt(px * px + py * py + 1) as dx, py / sqrt(px * px + py * py + 1) as dy, 1 / sqrt(px * px + py * py + 1) as dz from rays)"""


def rays(v) -> DataFrame:
    """Four literal cameras a scene, 16 x 16 pixels looking along z."""
    cams = v.spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(CAMERAS)], "view_id int, ox double, oy double")
    grid = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias(n)
    r = v.points.select("scene_id").distinct().crossJoin(F.broadcast(cams)).select("*", grid("u")).select("*", grid("v"))
    p = r.withColumns({"oz": F.lit(-2.0), "px": (F.col("u") - 7.5) / 10.0, "py": (F.col("v") - 7.5) / 10.0})
    size = F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py") + 1)
    return p.withColumns({"dx": F.col("px") / size, "dy": F.col("py") / size, "dz": 1 / size})


def numbered_voxels(v) -> DataFrame:
    vox = spatial.voxelize(v.points, 0.5).groupBy("scene_id", "vx", "vy", "vz").agg(F.min("point_id").alias("voxel_id"))
    return vox


HITS = f"""{PIXEL_SQL}, vox as (select scene_id, {VOXEL.format(0.5)}, min(point_id) as voxel_id from points group by 1, 2, 3, 4),
    steps as (select unnest(generate_series(0, 23)) as s),
    met as (select d.scene_id, view_id, u, v, s, voxel_id from dirs d, steps, vox where vox.scene_id = d.scene_id and vx = floor((ox + dx * (s * 0.25 + 0.1)) / 0.5) and vy = floor((oy + dy * (s * 0.25 + 0.1)) / 0.5) and vz = floor((oz + dz * (s * 0.25 + 0.1)) / 0.5)),
    hits as (select scene_id, view_id, u, v, min_by(voxel_id, s) as voxel_id from met group by 1, 2, 3, 4)"""


def ray_hits(v) -> DataFrame:
    return projection.cast_rays(rays(v), numbered_voxels(v), 0.5, 0.1, 5.9, ["view_id", "u", "v"])


@query("points", f"with {HITS} select scene_id, view_id, u, v, voxel_id from hits")
def ray_first_hit(v):
    return ray_hits(v).select("scene_id", "view_id", "u", "v", "voxel_id")


@query("points", f"with {HITS} select scene_id, voxel_id, round(sum(u) / (count(*) + 1e-4), 4) as feat, max(v) as label, count(*) as n from hits group by 1, 2")
def ray_project_features(v):
    hits = ray_hits(v).select("scene_id", "view_id", "u", "v", "voxel_id")
    both = hits.withColumn("feat", F.col("u").cast("double")).withColumn("label", F.col("v"))
    keys = ["view_id", "u", "v"]
    pix = both.select("scene_id", *keys, "feat", "label")
    mean = projection.project_features(hits, pix.drop("label"), keys, ["feat"])
    top = projection.project_labels(hits, pix.drop("feat"), keys, "label")
    return rounded(mean.join(top, ["scene_id", "voxel_id"]), "feat").select("scene_id", "voxel_id", "feat", "label", "n")


@query("points", """with px as (select scene_id, point_id, point_id % 64 as u, point_id % 48 as v, cast(z as double) as depth from points)
    select scene_id, point_id, round(5.0 - (v - 24.0) * depth / 50.0, 4) as x, round((u - 32.0) * depth / 60.0 + 5.0, 4) as y, round(depth - 2.0, 4) as z from px where depth > 0""")
def depth_unproject(v):
    pose = F.array(*(F.lit(float(c)) for c in (0, -1, 0, 5, 1, 0, 0, 5, 0, 0, 1, -2, 0, 0, 0, 1)))
    px = v.points.select("scene_id", "point_id", (F.col("point_id") % 64).alias("u"), (F.col("point_id") % 48).alias("v"), F.col("z").alias("depth"), F.lit(60.0).alias("fx"), F.lit(50.0).alias("fy"), F.lit(32.0).alias("mx"), F.lit(24.0).alias("my"), pose.alias("pose"))
    return rounded(projection.unproject(px), "x", "y", "z").select("scene_id", "point_id", "x", "y", "z")


@query("points", f"""with vox as (select scene_id, {VOXEL.format(1.0)}, avg(r) as r from points group by 1, 2, 3, 4), q as (select scene_id, point_id as q, x - 0.5 as x, y - 0.5 as y, z - 0.5 as z from points),
    o as (select unnest([0, 1]) as o), c as (select scene_id, q, x, y, z, floor(x) + a.o as vx, floor(y) + b.o as vy, floor(z) + c.o as vz from q, o a, o b, o c),
    m as (select c.scene_id, q, r, (sqrt(3) - sqrt((x - c.vx) * (x - c.vx) + (y - c.vy) * (y - c.vy) + (z - c.vz) * (z - c.vz))) / sqrt(3) as w from c join vox on vox.scene_id = c.scene_id and vox.vx = c.vx and vox.vy = c.vy and vox.vz = c.vz)
    select scene_id, q, round(sum(r * w) / (sum(w) + 1e-4), 4) as r from m group by 1, 2 having count(*) = 8""")
def voxel_interpolate(v):
    vox = spatial.voxel_mean(v.points, 1.0, ["r"]).drop("n")
    q = v.points.select("scene_id", F.col("point_id").alias("q"), *((F.col(a) - 0.5).alias(a) for a in "xyz"))
    return rounded(projection.interpolate_corners(q, vox, ["r"]), "r")


# -- assignment


def pair_inputs(v) -> tuple[DataFrame, DataFrame]:
    """Logits of all masks as queries, instances as targets."""
    m = v.masks.select("scene_id", F.col("mask_id").cast("long").alias("q"), "point_id", ((F.col("point_id") * 7 + F.col("mask_id")) % 11 - 5).cast("double").alias("logit"))
    return m.withColumn("p", geometry.sigmoid(F.col("logit"))), v.gt.select("scene_id", F.col("gt_id").alias("t"), "point_id")


PAIR_SQL = """sc as (select scene_id, cast(mask_id as bigint) as q, point_id, cast((point_id * 7 + mask_id) % 11 - 5 as double) as logit, 1 / (1 + exp(-cast((point_id * 7 + mask_id) % 11 - 5 as double))) as p from masks),
    tg as (select scene_id, gt_id as t, point_id from gt),
    grid as (select scene_id, q, t from (select distinct scene_id, q from sc) join (select distinct scene_id, t from tg) using (scene_id)),
    met as (select sc.scene_id, q, t, sum(p) as pt, sum(logit) as lt from sc join tg using (scene_id, point_id) group by 1, 2, 3),
    tot as (select scene_id, q, sum(p) as sp, sum(ln(1 + exp(logit))) as soft, count(*) as n from sc group by 1, 2), siz as (select scene_id, t, count(*) as st from tg group by 1, 2),
    costs as (select g.scene_id, g.q, g.t, 1 - (2 * coalesce(pt, 0) + 1) / (sp + st + 1) as dice, (soft - coalesce(lt, 0)) / n as bce from grid g join tot using (scene_id, q) join siz using (scene_id, t) left join met m on m.scene_id = g.scene_id and m.q = g.q and m.t = g.t)"""


@query("gt masks", f"with {PAIR_SQL} select scene_id, q, t, round(dice, 4) as cost from costs")
def dice_cost_matrix(v):
    return rounded(assign.dice_costs(*pair_inputs(v)), "cost")


@query("gt masks", f"with {PAIR_SQL} select scene_id, q, t, round(bce, 4) as cost from costs")
def bce_cost_matrix(v):
    return rounded(assign.bce_costs(*pair_inputs(v)), "cost")


@query()
def hungarian(v):
    s, t = pair_inputs(v)
    return rounded(assign.hungarian(assign.total_costs({5.0: assign.bce_costs(s, t), 2.0: assign.dice_costs(s, t)})), "cost")


@query("points", """select scene_id, instance_id, greatest(min(label) - 1, 0) as label, count(*) as n, cast(count(distinct segment_id) as int) as n_segments from points where instance_id >= 0 and label <> 3 group by 1, 2""")
def instance_targets(v):
    t = assign.instance_targets(v.points, [3], least_label=1)
    return t.select("scene_id", "instance_id", "label", "n", F.size("segments").alias("n_segments"))


@query()
def stratified_group_kfold(v):
    return assign.group_folds(v.points, "scene_id", "label", 4)


# -- graph


@query("feat_points", """with recursive near as (select a.scene_id, a.vec_id as q, b.vec_id as n, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) as d2 from feat_points a join feat_points b on a.scene_id = b.scene_id),
    k as (select scene_id, q, n from (select *, row_number() over (partition by scene_id, q order by d2, n) as rank from near) where rank <= 2 and q <> n),
    e as (select scene_id, q as a, n as b from k union select scene_id, n, q from k),
    r as (select scene_id, vec_id as v, vec_id as c from feat_points union select r.scene_id, e.b, r.c from r join e on e.scene_id = r.scene_id and e.a = r.v)
    select scene_id, v as node, min(c) as component from r group by 1, 2""")
def connected_components(v):
    """Components of the graph that joins each vector to its nearest neighbour."""
    p = v.feat_points
    near = spatial.knn(p.withColumnRenamed("vec_id", "q"), p.withColumnRenamed("vec_id", "n"), 2, 1.0).where("q <> n")
    edges = near.select("scene_id", F.col("q").alias("src"), F.col("n").alias("dst"))
    return graph.connected_components(p.select("scene_id", F.col("vec_id").alias("node")), edges)


@query("points", f"""with vox as (select distinct scene_id, {VOXEL.format(0.5)}, segment_id from points),
    step(dx, dy, dz) as (values (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)),
    moved as (select scene_id, segment_id as src, vx + dx as vx, vy + dy as vy, vz + dz as vz from vox, step),
    met as (select distinct scene_id, src, segment_id as dst from moved join vox using (scene_id, vx, vy, vz) where src <> segment_id)
    select scene_id, src, dst from met union select scene_id, dst, src from met""")
def segment_adjacency(v):
    return graph.voxel_adjacency(spatial.voxelize(v.points, 0.5).select("scene_id", "vx", "vy", "vz", "segment_id").distinct())


@query()
def dbscan_eps_cc(v):
    return graph.eps_clusters(v.points, 0.3).groupBy("scene_id", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def felzenszwalb(v):
    return graph.felzenszwalb(_weights(v), least=20).groupBy("scene_id", "segment_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def ncut_masks(v):
    seg = segment_features(v)
    adjacency = seg.select("scene_id", F.col("segment_id").alias("src"), F.explode(F.array(F.col("segment_id") - 8, F.col("segment_id") + 8)).alias("dst"))
    return graph.ncut_masks(seg, adjacency, "f", tau=0.3, least=1)


@query()
def fps(v):
    return grouped.farthest_points(v.points, 64)


@query()
def estimate_normals(v):
    p = v.feat_points.select("scene_id", F.col("vec_id").alias("point_id"), "x", "y", "z")
    near = spatial.knn(p.withColumnRenamed("point_id", "q"), p.withColumnRenamed("point_id", "n"), 8, 0.5)
    return rounded(grouped.estimate_normals(p, near, 3.0), "nx", "ny", "nz", digits=3)


def ring(seg: DataFrame) -> DataFrame:
    """Adjacency of the eight-apart segments of the embedding scenes."""
    return seg.select("scene_id", F.col("segment_id").alias("src"), F.explode(F.array(F.col("segment_id") - 8, F.col("segment_id") + 8)).alias("dst"))


@query()
def attention_proposals(v):
    seg = segment_features(v)
    some = v.feat_points.select("scene_id", F.col("vec_id").alias("point_id"), (F.col("vec_id") % 40).alias("segment_id"), "x", "y")
    settings = proposals.ProposalSettings(least_before=2, least_after=2, scene_ratio=1.0, least_maskness=0.3, hard_threshold=0.2)
    return rounded(proposals.attention_proposals(seg, "f", ring(seg), some, settings), "conf")


@query()
def density_tree_clusters(v):
    p = v.feat_points.select("scene_id", F.col("vec_id").alias("point_id"), "x", "y", "z")
    return grouped.density_tree_clusters(p, 5)


@query()
def floor_plane(v):
    return rounded(grouped.floor_plane(v.points, within=0.1, tries=100), "a", "b", "c", "d")


@query()
def random_cuboid(v):
    return grouped.random_cuboid(v.points, 0.5, 50).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def graph_cut(v):
    p = v.feat_points
    nodes = p.select("scene_id", F.col("vec_id").alias("node"), F.greatest("x", F.lit(0.0)).alias("to_source"), F.greatest(-F.col("x"), F.lit(0.0)).alias("to_sink"))
    near = spatial.knn(p.withColumnRenamed("vec_id", "q"), p.withColumnRenamed("vec_id", "n"), 3, 1.0).where("q <> n")
    edges = near.select("scene_id", F.least("q", "n").alias("src"), F.greatest("q", "n").alias("dst"), F.exp(-F.sqrt("d2")).alias("capacity")).dropDuplicates(["scene_id", "src", "dst"])
    return grouped.graph_cut(nodes, edges)


@query()
def zca_whitening(v):
    w = graph.whiten(segment_features(v), "f")
    return w.select("scene_id", "segment_id", F.posexplode("f").alias("i", "value")).select("scene_id", "segment_id", "i", F.round("value", 3).alias("value"))


@query()
def patches(v):
    p = v.feat_points.select("scene_id", F.col("vec_id").alias("point_id"), "x", "y", "z")
    return grouped.patches(p, 4, 3, 1.0).select("scene_id", "q", "n", "rank")


@query()
def sampled_volume(v):
    p = v.points.select("scene_id", "point_id", (F.col("x") - 5).alias("x"), (F.col("y") - 5).alias("y"), (F.col("z") - 1.5).alias("z"))
    return rounded(spatial.sampled_volume(p, 8, 5.2, 4), "x", "y", "z")


@query()
def elastic_distortion(v):
    return rounded(augment.elastic(v.points.select("scene_id", "point_id", "x", "y", "z"), 2.0, 0.2, 1), "x", "y", "z")


@query()
def point_dropout(v):
    return augment.dropout(v.points, 0.2, 0.9, 1).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def self_train_iteration(v):
    """Two rounds: proposals, then what the next round adds to what the last one kept."""
    kept = masks.drop_duplicates(v.preds, v.masks, 0.2, 0.6).select("scene_id", "mask_id")
    first = v.masks.where("mask_id < 1000").join(kept, ["scene_id", "mask_id"], "left_semi")
    second = masks.append_masks(first, v.masks.where("mask_id >= 1000"), 5)
    return second.groupBy("scene_id", "mask_id", "added").agg(F.count(F.lit(1)).alias("n"))


# -- colour and columns


@query("points", "select distinct segment_id, segment_id * 217 % 256 % 256 as c1, segment_id * 217 % 311 % 256 as c2, segment_id * 217 % 541 % 256 as c3 from points")
def segment_colours(v):
    return v.points.select("segment_id").distinct().select("segment_id", *(c.alias(f"c{i}") for i, c in enumerate(colour.segment_colour(F.col("segment_id")), 1)))


@query("points", """with c as (select scene_id, point_id, r, g, b, greatest(r, g, b) as top, greatest(r, g, b) - least(r, g, b) as span from points),
    h as (select scene_id, point_id, top, span, case when span = 0 then 0 when top = r then (g - b) / span when top = g then 2 + (b - r) / span else 4 + (r - g) / span end as h6 from c)
    select scene_id, point_id, round(case when h6 < 0 then h6 / 6.0 + 1 else h6 / 6.0 end, 6) as h, round(case when top > 0 then span / top else 0 end, 6) as s, cast(top as double) as v from h""")
def rgb_to_hsv(v):
    return rounded(colour.rgb_to_hsv(v.points.select("scene_id", "point_id", "r", "g", "b")), "h", "s", digits=6).select("scene_id", "point_id", "h", "s", "v")


@query("points masks", "select distinct scene_id, point_id from masks")
def union_mask(v):
    return masks.union_mask(v.masks)


@query("frames", "select scene_id, frame_id from (select *, sum(1 + frame_id % 3) over (partition by scene_id order by t rows unbounded preceding) as total from frames) where total <= 20")
def batch_budget(v):
    f = v.frames.withColumn("size", 1 + F.col("frame_id") % 3)
    return aggregates.within_budget(f, "size", 20, "t", "scene_id").select("scene_id", "frame_id")


@query("points", """select scene_id, point_id, round(sqrt((x - avg(x) over w) * (x - avg(x) over w) + (y - avg(y) over w) * (y - avg(y) over w) + (z - avg(z) over w) * (z - avg(z) over w)), 4) as d from points window w as (partition by scene_id)""")
def centroid_distance(v):
    c = spatial.mean_centre(v.points.select("scene_id", "point_id", "x", "y", "z"))
    return c.select("scene_id", "point_id", F.round(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")), 4).alias("d"))


@query("points", """select scene_id, point_id, round(x * 0.6 - y * 0.8 + 1, 4) as x, round(x * 0.8 + y * 0.6 - 2, 4) as y, round(z + 0.5, 4) as z from points""")
def rigid_transform(v):
    m = [[0.6, -0.8, 0, 1], [0.8, 0.6, 0, -2], [0, 0, 1, 0.5], [0, 0, 0, 1]]
    return rounded(projection.transform(v.points.select("scene_id", "point_id", "x", "y", "z"), m), "x", "y", "z")


@query("points", "select scene_id, segment_id, label from points where true group by 1, 2, 3 having count(*) >= 20")
def drop_small_clusters(v):
    return aggregates.drop_small(v.points, 20, ["scene_id", "segment_id", "label"]).select("scene_id", "segment_id", "label").distinct()


@query("preds masks", """select scene_id, mask_id, round(case when max(conf) over w > min(conf) over w then (conf - min(conf) over w) / (max(conf) over w - min(conf) over w) else 0 end, 4) as conf from preds window w as (partition by scene_id)""")
def minmax_scores(v):
    return v.preds.select("scene_id", "mask_id", F.round(masks.minmax("conf", ["scene_id"]), 4).alias("conf"))


@query("gt masks", """with m as (select scene_id, mask_id, 1 / (1 + exp(-(cast((point_id * 7 + mask_id) % 11 - 5 as double)))) as h, case when (point_id * 7 + mask_id) % 11 > 5 then 1 else 0 end as o from masks)
    select scene_id, mask_id, round(sum(h * o) / (sum(o) + 1e-6), 4) as score, cast(sum(o) as bigint) as n from m group by 1, 2""")
def mask_confidence(v):
    m = v.masks.withColumn("logit", ((F.col("point_id") * 7 + F.col("mask_id")) % 11 - 5).cast("double"))
    return rounded(masks.mask_scores(m, ["scene_id", "mask_id"], "logit"), "score")
