"""Pair costs, one-to-one assignment, losses, targets and stratified folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pairs(scores: DataFrame, targets: DataFrame, by: str) -> DataFrame:
    """(scene, q, t, pt): sum over points of probability inside a target, for all pairs of a scene's queries and targets."""
    q, t = scores.select(by, "q").distinct(), targets.select(by, "t").distinct()
    met = scores.join(targets, [by, "point_id"]).groupBy(by, "q", "t").agg(F.sum("p").alias("pt"), F.sum("logit").alias("lt"))
    return q.join(t, by).join(met, [by, "q", "t"], "left").select(by, "q", "t", F.coalesce("pt", F.lit(0.0)).alias("pt"), F.coalesce("lt", F.lit(0.0)).alias("lt"))


def dice_costs(scores: DataFrame, targets: DataFrame, by: str = "scene_id") -> DataFrame:
    """1 - (2 sum p t + 1) / (sum p + sum t + 1) for all pairs of queries and targets.

    ``scores``: scene, q, point_id, p and logit; ``targets``: scene, t, point_id of the points inside.
    """
    p = scores.groupBy(by, "q").agg(F.sum("p").alias("sp"))
    t = targets.groupBy(by, "t").agg(F.count(F.lit(1)).alias("st"))
    joined = _pairs(scores, targets, by).join(p, [by, "q"]).join(t, [by, "t"])
    return joined.select(by, "q", "t", (1 - (2 * F.col("pt") + 1) / (F.col("sp") + F.col("st") + 1)).alias("cost"))


def bce_costs(scores: DataFrame, targets: DataFrame, by: str = "scene_id") -> DataFrame:
    """Mean binary cross entropy of logits for all pairs: softplus(logit) less the logit inside the target."""
    soft = F.greatest("logit", F.lit(0.0)) + F.log1p(F.exp(-F.abs("logit")))
    q = scores.groupBy(by, "q").agg(F.sum(soft).alias("all"), F.count(F.lit(1)).alias("n"))
    return _pairs(scores, targets, by).join(q, [by, "q"]).select(by, "q", "t", ((F.col("all") - F.col("lt")) / F.col("n")).alias("cost"))


def total_costs(parts: dict[float, DataFrame], by: str = "scene_id") -> DataFrame:
    """Weighted sum of cost tables."""
    rows = None
    for weight, table in parts.items():
        scaled = table.select(by, "q", "t", (F.col("cost") * weight).alias("cost"))
        rows = scaled if rows is None else rows.unionByName(scaled)
    return rows.groupBy(by, "q", "t").agg(F.sum("cost").alias("cost"))


def shortest_augmenting(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least total cost, rows at most columns.

    Each row in turn is added along a shortest augmenting path with potentials.
    """
    n, m = cost.shape
    row_of = np.full(m, -1)
    u, v = np.zeros(n), np.zeros(m)
    for start in range(n):
        dist, prev = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        row, reached, column = start, 0.0, -1
        while True:
            step = reached + cost[row] - u[row] - v
            closer = ~done & (step < dist)
            dist[closer], prev[closer] = step[closer], column
            column = int(np.where(done, np.inf, dist).argmin())
            reached = dist[column]
            done[column] = True
            if row_of[column] < 0:
                break
            row = row_of[column]
        u[start] += reached
        for c in np.flatnonzero(done):
            if c != column:
                u[row_of[c]] += reached - dist[c]
            v[c] -= reached - dist[c]
        while column >= 0:
            before = int(prev[column])
            row_of[column] = row_of[before] if before >= 0 else start
            column = before
    out = np.full(n, -1)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


def hungarian(costs: DataFrame, by: str = "scene_id") -> DataFrame:
    """One-to-one matches of least total cost: (scene, q, t, cost). A group is one scene's cost table."""

    def run(scene: pd.DataFrame) -> pd.DataFrame:
        table = scene.pivot(index="t", columns="q", values="cost").sort_index().sort_index(axis=1)
        flat = table.to_numpy(float)
        turned = flat.shape[0] > flat.shape[1]
        got = shortest_augmenting(flat.T if turned else flat)
        pairs = [(c, r) if turned else (r, c) for r, c in enumerate(got) if c >= 0]
        return pd.DataFrame({by: scene[by].iloc[0], "q": [table.columns[c] for _, c in pairs], "t": [table.index[r] for r, _ in pairs], "cost": [flat[r, c] for r, c in pairs]})

    return costs.groupBy(by).applyInPandas(run, f"{by} long, q long, t long, cost double")


def class_loss(rows: DataFrame, keys: list[str], logits: str, target: str, no_object: int, weight: float) -> DataFrame:
    """Weighted mean cross entropy of logit arrays; the no-object class counts ``weight``."""
    top = F.array_max(logits)
    log_sum = top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
    w = F.when(F.col(target) == no_object, weight).otherwise(1.0)
    return rows.groupBy(*keys).agg((F.sum(w * (log_sum - F.element_at(logits, F.col(target) + 1))) / F.sum(w)).alias("loss"))


def mask_losses(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Dice and cross-entropy losses of matched masks given per point: logit, p and t (0 or 1)."""
    soft = F.greatest("logit", F.lit(0.0)) - F.col("logit") * F.col("t") + F.log1p(F.exp(-F.abs("logit")))
    return matched.groupBy(*keys).agg((1 - (2 * F.sum(F.col("p") * F.col("t")) + 1) / (F.sum("p") + F.sum("t") + 1)).alias("dice"), F.avg(soft).alias("bce"))


def drop_loss_weights(ious: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """1 for predictions whose best overlap with a target reaches ``threshold``, else 0."""
    return ious.groupBy(*keys).agg((F.max("iou") >= threshold).cast("int").alias("weight"))


def instance_targets(points: DataFrame, skip: list[int], least_label: int = 0, by: str = "scene_id") -> DataFrame:
    """Instances as targets: label, points and segments; -1 and labels of ``skip`` are left out."""
    kept = points.where((F.col("instance_id") >= 0) & ~F.col("label").isin(skip)) if skip else points.where("instance_id >= 0")
    return kept.groupBy(by, "instance_id").agg(F.greatest(F.min("label") - least_label, F.lit(0)).alias("label"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("segment_id")).alias("segments"))


def mask_targets(masks: DataFrame, points: DataFrame, by: str = "scene_id") -> DataFrame:
    """Non-empty masks as targets with the segments they touch."""
    joined = masks.join(points.select(by, "point_id", "segment_id"), [by, "point_id"])
    return joined.groupBy(by, "mask_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("segment_id")).alias("segments"))


def group_folds(rows: DataFrame, group: str, label: str, folds: int) -> DataFrame:
    """Stratified folds of whole groups: (group, fold).

    Label counts by group come from one aggregation; groups, most uneven
    first, then go where the label shares of the folds stay most even. The
    loop is over groups (scenes), not rows.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("n")).toPandas()
    table = counts.pivot(index=group, columns=label, values="n").fillna(0).sort_index()
    values, total = table.to_numpy(float), table.to_numpy(float).sum(axis=0)
    held, fold_of = np.zeros((folds, values.shape[1])), {}
    for g in np.argsort(-values.std(axis=1), kind="stable"):
        spread = [np.mean((held + values[g] * (np.arange(folds) == f)[:, None]).std(axis=0) / total) for f in range(folds)]
        f = int(np.argmin(spread))
        held[f] += values[g]
        fold_of[table.index[g]] = f
    return spark.createDataFrame([(int(g), f) for g, f in sorted(fold_of.items())], f"{group} long, fold int")
