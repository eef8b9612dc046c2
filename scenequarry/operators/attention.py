"""Sparse attention over edge lists, as joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import dot


def logits(edges: DataFrame, queries: DataFrame, keys: DataFrame, heads: int) -> DataFrame:
    """(i0, i1, head, logit): dot of query i0 and key i1 within each head's channels.

    ``queries``: i0, q and ``keys``: i1, k, arrays of heads * width values.
    """
    joined = edges.join(queries, "i0").join(keys, "i1")
    per = joined.select("i0", "i1", "q", "k", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("head"))
    width = (F.size("q") / heads).cast("int")
    return per.select("i0", "i1", "head", F.slice("q", F.col("head") * width + 1, width).alias("a"), F.slice("k", F.col("head") * width + 1, width).alias("b")).select("i0", "i1", "head", dot("a", "b").alias("logit"))


def softmax(rows: DataFrame) -> DataFrame:
    """Weights over each query's edges and head, by one aggregate and a join."""
    top = rows.groupBy("i0", "head").agg(F.max("logit").alias("_m"))
    e = rows.join(top, ["i0", "head"]).withColumn("_e", F.exp(F.col("logit") - F.col("_m")))
    total = e.groupBy("i0", "head").agg(F.sum("_e").alias("_t"))
    return e.join(total, ["i0", "head"]).select("i0", "i1", "head", (F.col("_e") / F.col("_t")).alias("attn"))


def apply(weights: DataFrame, values: DataFrame, heads: int) -> DataFrame:
    """(i0, head, c, value): sum over edges of weight times value i1; ``values``: i1, v."""
    width = (F.size("v") / heads).cast("int")
    joined = weights.join(values, "i1").select("i0", "head", "attn", F.posexplode(F.slice("v", F.col("head") * width + 1, width)).alias("c", "v"))
    return joined.groupBy("i0", "head", "c").agg(F.sum(F.col("attn") * F.col("v")).alias("value"))


def position_bias(edges: DataFrame, queries: DataFrame, table: DataFrame, heads: int) -> DataFrame:
    """(i0, i1, head, bias): sum over three axes of the query's dot with the table row of the edge's relative index.

    ``edges``: i0, i1, r0, r1, r2; ``table``: axis, rel, head, row (an array as wide as a head).
    """
    width = (F.size("q") / heads).cast("int")
    axes = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"r{a}").alias("rel")) for a in range(3)))
    long = edges.select("i0", "i1", F.inline(axes)).join(queries, "i0").join(F.broadcast(table) if _small(table) else table, ["axis", "rel"])
    return long.select("i0", "i1", "head", F.slice("q", F.col("head") * width + 1, width).alias("a"), "row").groupBy("i0", "i1", "head").agg(F.sum(dot("a", "row")).alias("bias"))


def position_value(weights: DataFrame, edges: DataFrame, values: DataFrame, table: DataFrame, heads: int) -> DataFrame:
    """(i0, head, c, value): sum over edges and axes of weight times (value / 3 + table row)."""
    width = (F.size("v") / heads).cast("int")
    axes = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"r{a}").alias("rel")) for a in range(3)))
    long = edges.select("i0", "i1", F.inline(axes)).join(weights, ["i0", "i1"]).join(values, "i1").join(table, ["axis", "rel", "head"])
    added = F.zip_with(F.slice("v", F.col("head") * width + 1, width), "row", lambda v, r: v / 3 + r)
    return long.select("i0", "head", "attn", F.posexplode(added).alias("c", "v")).groupBy("i0", "head", "c").agg(F.sum(F.col("attn") * F.col("v")).alias("value"))


def mask_logits(segments: DataFrame, queries: DataFrame, by: str = "scene_id") -> DataFrame:
    """(scene, segment_id, q, logit): dot of each segment's feature with each query of its scene."""
    joined = segments.select(by, "segment_id", F.col("feature").alias("a")).join(queries.select(by, "q", F.col("feature").alias("b")), by)
    return joined.select(by, "segment_id", "q", dot("a", "b").alias("logit"))


def _small(table: DataFrame, most: int = 8 << 20) -> bool:
    """Whether the optimizer's size estimate allows a broadcast."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most
