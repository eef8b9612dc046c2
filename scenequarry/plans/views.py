"""Scene tables derived from the driver's tables, as DataFrames and as SQL.

The data has no scans, so points, ground truth, masks, predictions and frames
are derived from ``lineitem``, ``embeddings`` and ``events``, the same way in
both forms.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCENES = 8


class Views:
    """Lazy views over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def points(self) -> DataFrame:
        line = self.table("lineitem")
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]
        scene = F.col("l_suppkey") % SCENES
        return line.select(
            scene.alias("scene_id"),
            (F.row_number().over(Window.partitionBy(scene).orderBy(*order)) - 1).cast("long").alias("point_id"),
            (F.col("l_quantity") / 5.0).alias("x"),
            (F.col("l_extendedprice") / 10500.0).alias("y"),
            (F.col("l_discount") * 30.0).alias("z"),
            (F.col("l_partkey") % 256).alias("r"),
            (F.col("l_orderkey") % 256).alias("g"),
            (F.col("l_suppkey") % 256).alias("b"),
            (F.col("l_partkey") % 40).alias("segment_id"),
            F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("label"),
            F.when(F.col("l_linestatus") == "F", (F.col("l_partkey") % 6).cast("int")).otherwise(-1).alias("instance_id"),
        )

    @cached_property
    def feat_points(self) -> DataFrame:
        e = self.table("embeddings")
        axis = lambda i: (F.col("embedding")[i].cast("double") * 10)
        return e.select((F.col("vec_id") % SCENES).alias("scene_id"), "vec_id", "label", axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z"))

    @cached_property
    def gt(self) -> DataFrame:
        p = self.points.where("instance_id >= 0")
        return p.select("scene_id", "point_id", (F.col("label") * 1000 + F.col("instance_id") + 1).cast("long").alias("gt_id"), "label")

    @cached_property
    def masks(self) -> DataFrame:
        p = self.points
        one = p.where("segment_id % 5 <> 0").select("scene_id", "point_id", (F.col("label") * 100 + F.floor("x")).cast("int").alias("mask_id"))
        own = F.col("label") * 100 + F.col("instance_id")
        kept = p.where("instance_id >= 0")
        two = kept.where("g % 10 < 2 + (label * 6 + instance_id + scene_id) % 9").select("scene_id", "point_id", (own + 1000).cast("int").alias("mask_id"))
        three = kept.where("g % 10 >= 6 - scene_id % 5").select("scene_id", "point_id", (own + 2000).cast("int").alias("mask_id"))
        return one.unionByName(two).unionByName(three)

    @cached_property
    def preds(self) -> DataFrame:
        n = self.masks.groupBy("scene_id", "mask_id").agg(F.count(F.lit(1)).alias("vert_count"))
        return n.select(
            "scene_id", "mask_id", F.floor((F.col("mask_id") % 1000) / 100).cast("int").alias("label"), "vert_count",
            F.round((F.col("mask_id") * 7919 % 1000).cast("double") / 1000.0, 3).alias("conf"),
        )

    @cached_property
    def frames(self) -> DataFrame:
        t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
        return self.table("events").select(F.col("user_id").alias("scene_id"), F.col("event_id").alias("frame_id"), "ts", "value", t.alias("t"))


SQL = {
    "points": """select l_suppkey % 8 as scene_id,
        cast(row_number() over (partition by l_suppkey % 8 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) - 1 as bigint) as point_id,
        l_quantity / 5.0 as x, l_extendedprice / 10500.0 as y, l_discount * 30.0 as z,
        l_partkey % 256 as r, l_orderkey % 256 as g, l_suppkey % 256 as b, l_partkey % 40 as segment_id,
        case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as label,
        case when l_linestatus = 'F' then cast(l_partkey % 6 as int) else -1 end as instance_id
        from lineitem""",
    "feat_points": """select vec_id % 8 as scene_id, vec_id, label, cast(embedding[1] as double) * 10 as x,
        cast(embedding[2] as double) * 10 as y, cast(embedding[3] as double) * 10 as z from embeddings""",
    "gt": """select scene_id, point_id, cast(label * 1000 + instance_id + 1 as bigint) as gt_id, label from points where instance_id >= 0""",
    "masks": """select scene_id, point_id, cast(label * 100 + floor(x) as int) as mask_id from points where segment_id % 5 <> 0
        union all select scene_id, point_id, cast(1000 + label * 100 + instance_id as int) from points
        where instance_id >= 0 and g % 10 < 2 + (label * 6 + instance_id + scene_id) % 9
        union all select scene_id, point_id, cast(2000 + label * 100 + instance_id as int) from points
        where instance_id >= 0 and g % 10 >= 6 - scene_id % 5""",
    "preds": """select scene_id, mask_id, cast(floor((mask_id % 1000) / 100) as int) as label, count(*) as vert_count,
        round(cast((mask_id * 7919) % 1000 as double) / 1000.0, 3) as conf from masks group by scene_id, mask_id""",
    "frames": """select user_id as scene_id, event_id as frame_id, ts, value,
        row_number() over (partition by user_id order by ts, event_id) - 1 as t from events""",
}
NEEDS = {"points": (), "feat_points": (), "gt": ("points",), "masks": ("points",), "preds": ("points", "masks"), "frames": ()}


def with_views(names: str, body: str) -> str:
    """``body`` with the named views (and those they need) as common table expressions before it."""
    wanted = [n for n in SQL if any(n == w or n in NEEDS[w] for w in names.split())]
    views = ",\n".join(f"{n} as ({SQL[n]})" for n in wanted)
    body = body.strip()
    for head in ("with recursive ", "with "):
        if body.lower().startswith(head):
            return f"{head}{views},\n{body[len(head):]}"
    return f"with {views}\n{body}"
