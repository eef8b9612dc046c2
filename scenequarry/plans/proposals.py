"""Composed scene queries: attention proposals and pseudo-mask generation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, graph, masks


@dataclass(frozen=True)
class ProposalSettings:
    """Thresholds of the proposal query."""

    similarity: str = "cosine"
    hard_threshold: float = 0.35
    least_before: int = 3
    least_after: int = 4
    scene_ratio: float = 0.8
    overlap: float = 0.5
    most: int = 50
    least_maskness: float = 0.6


def attention_proposals(segments: DataFrame, feature: str, adjacency: DataFrame, points: DataFrame, settings: ProposalSettings = ProposalSettings(), by: str = "scene_id") -> DataFrame:
    """(scene, mask_id, segment_id, conf): instance proposals from the similarity of segments.

    Every segment asks for the segments like it; what is similar enough is cut
    into connected parts, scored by mean similarity, filtered by its reach in
    the scene, thinned by greedy suppression and capped. Only segment tables
    meet one another; points enter for the reach and the sizes alone.
    """
    s = settings
    soft = graph.similarity(segments.where(F.exists(feature, lambda v: v != 0)), feature, "segment_id", by, s.similarity)
    hard = soft.where(F.col("sim") >= s.hard_threshold).select(by, F.col("i").alias("mask_id"), F.col("j").alias("segment_id"), "sim")
    hard = aggregates.drop_small(hard, s.least_before, [by, "mask_id"])
    parts = graph.separate(hard.select(by, "mask_id", "segment_id"), adjacency, by).join(hard, [by, "mask_id", "segment_id"])
    parts = aggregates.drop_small(parts, s.least_after, [by, "mask_id", "part"])
    named = parts.select(by, (F.col("mask_id") * 100_000 + F.col("part")).cast("int").alias("mask_id"), "segment_id", "sim")
    conf = named.groupBy(by, "mask_id").agg(F.avg("sim").alias("conf"))
    lifted = aggregates.lift(named, points, by)
    near = masks.extent_filter(lifted, points, s.scene_ratio, by).select(by, "mask_id", F.col("n").alias("vert_count"))
    preds = near.join(conf, [by, "mask_id"]).withColumn("label", F.lit(1)).persist()
    kept = lifted.join(preds.select(by, "mask_id"), [by, "mask_id"], "left_semi")
    apart = masks.hard_nms(preds, masks.mask_iou(preds, kept, by), s.overlap, by).where("kept").select(by, "mask_id", "conf")
    best = masks.top_k(apart, s.most, by).where(F.col("conf") > s.least_maskness).select(by, "mask_id", "conf")
    return named.select(by, "mask_id", "segment_id").join(best, [by, "mask_id"])


def pseudo_masks(points: DataFrame, features: DataFrame, feature: str, edges: DataFrame, by: str = "scene_id", tau: float = 0.6, rounds: int = 20, least: int = 3) -> DataFrame:
    """(scene, point_id, mask_id) by normalised cuts over segment features, lifted to points.

    ``features``: scene, point_id and a feature array; ``edges``: scene, src, dst segment adjacency.
    """
    owned = features.join(points.select(by, "point_id", "segment_id"), [by, "point_id"])
    segments = aggregates.feature_mean(owned, feature, [by, "segment_id"])
    return aggregates.lift(graph.ncut_masks(segments, edges, feature, tau, rounds, least, by=by), points, by)
