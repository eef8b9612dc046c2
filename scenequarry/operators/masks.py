"""Mask and box algebra: overlap, suppression, extent filters, fusion and box overlap."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LENGTHS = ("x", "y", "z")


def overlaps(masks: DataFrame, by: str = "scene_id") -> DataFrame:
    """(scene, i, j, inter) of all pairs of distinct masks that share points: a self-join on the point."""
    a, b = (masks.select(by, "point_id", F.col("mask_id").alias(n)).distinct() for n in "ij")
    return a.join(b, [by, "point_id"]).where("i <> j").groupBy(by, "i", "j").agg(F.count(F.lit(1)).alias("inter"))


def ranked(preds: DataFrame, by: str = "scene_id", score: str = "conf") -> DataFrame:
    """Rank of each prediction in its scene by falling score; ties by mask_id."""
    return preds.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "mask_id")))


def top_k(preds: DataFrame, k: int, by: str = "scene_id", score: str = "conf") -> DataFrame:
    return ranked(preds, by, score).where(F.col("rank") <= k)


def top_k_classes(preds: DataFrame, scores: str, k: int, by: str = "scene_id") -> DataFrame:
    """(scene, mask_id, label, conf, rank): a scene's ``k`` best (mask, class) pairs; a mask may come with several classes.

    ``scores``: array column of one score a class, label 0 first. Null scores take no part; ties by mask_id, then label.
    """
    pairs = preds.select(by, "mask_id", F.posexplode(scores).alias("label", "conf")).where("conf is not null")
    order = Window.partitionBy(by).orderBy(F.desc("conf"), "mask_id", "label")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def drop_duplicates(preds: DataFrame, masks: DataFrame, least_score: float, share: float, by: str = "scene_id") -> DataFrame:
    """Keep a mask unless it scores below ``least_score`` or some better ranked mask, kept or
    not, has more than ``share`` of its own points in it."""
    order = ranked(preds, by)
    i, j = (order.select(by, F.col("mask_id").alias(n), F.col("rank").alias(f"rank_{n}"), F.col("vert_count").alias(f"n_{n}")) for n in "ij")
    covered = overlaps(masks, by).join(i, [by, "i"]).join(j, [by, "j"]).where((F.col("rank_j") < F.col("rank_i")) & (F.col("inter") > share * F.col("n_j")))
    return order.where((F.col("conf") >= least_score) & (F.col("vert_count") > 0)).join(covered.select(by, F.col("i").alias("mask_id")).distinct(), [by, "mask_id"], "left_anti")


def matrix_nms(preds: DataFrame, masks: DataFrame, kernel: str = "linear", sigma: float = 2.0, by: str = "scene_id", eps: float = 1e-6) -> DataFrame:
    """Decayed scores: each better ranked mask i of the same label lowers j's score by f(iou_ij) / f(largest iou of i)."""
    f = (lambda x: 1 - x) if kernel == "linear" else (lambda x: F.exp(-sigma * x * x))
    order = ranked(preds, by)
    i, j = (order.select(by, "label", F.col("mask_id").alias(n), F.col("rank").alias(f"rank_{n}"), F.col("vert_count").alias(f"n_{n}")) for n in "ij")
    pairs = overlaps(masks, by).join(i, [by, "i"]).join(j, [by, "label", "j"]).where("rank_i < rank_j")
    pairs = pairs.select(by, "i", "j", (F.col("inter") / (F.col("n_i") + F.col("n_j") - F.col("inter"))).alias("iou"))
    own = pairs.groupBy(by, F.col("j").alias("i")).agg(F.max("iou").alias("comp"))
    decay = pairs.join(own, [by, "i"], "left").groupBy(by, F.col("j").alias("mask_id")).agg(F.min(f(F.col("iou")) / (f(F.coalesce("comp", F.lit(0.0))) + eps)).alias("decay"))
    return order.join(decay, [by, "mask_id"], "left").withColumn("conf", F.col("conf") * F.least(F.coalesce("decay", F.lit(1.0)), F.lit(1.0))).drop("decay", "rank")


def hard_nms(preds: DataFrame, pairs: DataFrame, threshold: float = 0.5, by: str = "scene_id") -> DataFrame:
    """Greedy suppression within a label: ``kept`` masks in falling score, none above ``threshold`` IoU with an earlier kept one.

    ``pairs``: scene, i, j, iou above the threshold. The greedy order is sequential,
    so a scene's masks and close pairs, not its points, go to one grouped function.
    """
    close = pairs.where(F.col("iou") > threshold).groupBy(by, F.col("i").alias("mask_id")).agg(F.collect_list("j").alias("near"))
    rows = preds.join(close, [by, "mask_id"], "left").select(by, "mask_id", "label", "conf", F.coalesce("near", F.array().cast("array<int>")).alias("near"))

    def suppress(scene: pd.DataFrame) -> pd.DataFrame:
        scene = scene.sort_values(["conf", "mask_id"], ascending=[False, True])
        kept: set[int] = set()
        flags = []
        for mask, near in zip(scene["mask_id"], scene["near"]):
            flags.append(kept.isdisjoint(near))
            if flags[-1]:
                kept.add(mask)
        return scene.assign(kept=flags)[[by, "mask_id", "label", "conf", "kept"]]

    return rows.groupBy(by, "label").applyInPandas(suppress, f"{by} long, mask_id int, label int, conf double, kept boolean")


def mask_iou(preds: DataFrame, masks: DataFrame, by: str = "scene_id", same_label: bool = True) -> DataFrame:
    """(scene, i, j, iou) for overlapping masks, of one label if asked."""
    extra = ["label"] if same_label else []
    i, j = (preds.select(by, *extra, F.col("mask_id").alias(n), F.col("vert_count").alias(f"n_{n}")) for n in "ij")
    return overlaps(masks, by).join(i, [by, "i"]).join(j, [by, *extra, "j"]).select(by, "i", "j", (F.col("inter") / (F.col("n_i") + F.col("n_j") - F.col("inter"))).alias("iou"))


def extent_filter(masks: DataFrame, points: DataFrame, ratio: float, by: str = "scene_id") -> DataFrame:
    """Masks whose reach along neither x nor y exceeds ``ratio`` of the scene's."""
    span = lambda a, n: (F.max(a) - F.min(a)).alias(f"{n}{a}")
    scene = points.groupBy(by).agg(*(span(a, "s") for a in "xy"))
    mask = masks.join(points.select(by, "point_id", "x", "y"), [by, "point_id"]).groupBy(by, "mask_id").agg(*(span(a, "m") for a in "xy"), F.count(F.lit(1)).alias("n"))
    return mask.join(scene, by).where(reduce(Column.__and__, [F.col(f"m{a}") <= ratio * F.col(f"s{a}") for a in "xy"])).select(by, "mask_id", "n", "mx", "my")


def paint(masks: DataFrame, preds: DataFrame, by: str = "scene_id") -> DataFrame:
    """One mask a point: that of highest score, as if painted in rising order; ties go to the greater mask_id."""
    scored = masks.join(preds.select(by, "mask_id", "conf"), [by, "mask_id"])
    return scored.groupBy(by, "point_id").agg(F.max_by("mask_id", F.struct("conf", "mask_id")).alias("mask_id"))


def union_mask(masks: DataFrame, by: str = "scene_id") -> DataFrame:
    return masks.select(by, "point_id").distinct()


def fuse_views(rows: DataFrame, keys: list[str], view: str, value: str) -> DataFrame:
    """Running mean of views in order, from 0: acc = (acc + value) / 2."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(view).alias("_t"), F.col(value).alias("_v"))))
    return rows.groupBy(*keys).agg(ordered.alias("_l")).select(*keys, F.aggregate("_l", F.lit(0.0), lambda a, s: (a + s["_v"]) / 2).alias(value), F.size("_l").alias("n"))


def fuse_confident(rows: DataFrame, keys: list[str], view: str, value: str, conf: str) -> DataFrame:
    """The value of the most confident view; the earlier one on a tie."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(F.col(conf), -F.col(view))).alias(value), F.max(conf).alias(conf))


def mask_scores(rows: DataFrame, keys: list[str], logit: str) -> DataFrame:
    """Mean sigmoid over the points that a mask takes (logit above 0)."""
    heat = 1 / (1 + F.exp(-F.col(logit)))
    on = (F.col(logit) > 0).cast("double")
    return rows.groupBy(*keys).agg((F.sum(heat * on) / (F.sum(on) + 1e-6)).alias("score"), F.sum(on).cast("long").alias("n"))


def append_masks(base: DataFrame, new: DataFrame, most: int, by: str = "scene_id", share: float = 0.5) -> DataFrame:
    """Self-training append: in order of mask_id, take up to ``most`` new masks of which more than
    ``share`` is uncovered so far, and of each only the uncovered part.

    Sequential in a scene's masks, so each scene is one group; masks go in as point lists.
    """
    schema = f"{by} long, mask_id int, point_id long, added boolean"
    rows = base.select(by, "mask_id", "point_id", F.lit(False).alias("added")).unionByName(new.select(by, "mask_id", "point_id", F.lit(True).alias("added")))

    def run(scene: pd.DataFrame) -> pd.DataFrame:
        old, fresh = scene[~scene["added"]], scene[scene["added"]]
        covered, out, n = set(old["point_id"]), [old], 0
        for mask, lot in sorted(fresh.groupby("mask_id")):
            if n == most:
                break
            left = lot[~lot["point_id"].isin(covered)]
            if len(left) > share * len(lot):
                covered.update(left["point_id"])
                out.append(left)
                n += 1
        return pd.concat(out)

    return rows.groupBy(by).applyInPandas(run, schema)


def box_iou(a: str = "a_", b: str = "b_") -> Column:
    """Overlap of two axis-aligned boxes given as centre and length columns with prefixes."""
    lo = lambda p, x: F.col(f"{p}c{x}") - F.col(f"{p}l{x}") / 2
    hi = lambda p, x: F.col(f"{p}c{x}") + F.col(f"{p}l{x}") / 2
    over = [F.greatest(F.least(hi(a, x), hi(b, x)) - F.greatest(lo(a, x), lo(b, x)), F.lit(0.0)) for x in LENGTHS]
    inter = reduce(Column.__mul__, over)
    volume = lambda p: reduce(Column.__mul__, [F.col(f"{p}l{x}") for x in LENGTHS])
    union = volume(a) + volume(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def box_nms(boxes: DataFrame, threshold: float, by: list[str], old_type: bool = False, axes: str = "xyz") -> DataFrame:
    """Greedy suppression by falling score within ``by``, in 3-D or with ``axes`` "xy" in 2-D;
    ``old_type`` divides by the other box's volume.

    ``boxes``: keys, box_id, x1, x2 and so on, and score.
    """
    fields = ", ".join(f"{k} {t}" for k, t in boxes.select(*by, "box_id", "score").dtypes)

    def run(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(["score", "box_id"], ascending=[False, True], ignore_index=True)
        low, high = lot[[f"{a}1" for a in axes]].to_numpy(float), lot[[f"{a}2" for a in axes]].to_numpy(float)
        volume, alive, kept = (high - low).prod(axis=1), np.ones(len(lot), bool), []
        for i in range(len(lot)):
            if not alive[i]:
                continue
            kept.append(i)
            inter = np.maximum(0, np.minimum(high[i], high) - np.maximum(low[i], low)).prod(axis=1)
            share = inter / np.maximum(volume if old_type else volume[i] + volume - inter, 1e-12)
            alive &= ~(share > threshold)
        return lot.loc[kept, [*by, "box_id", "score"]]

    return boxes.groupBy(*by).applyInPandas(run, fields)


def corner_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """1 less the mean distance of corners over the mean diagonal, at the best of four turns; at least 0.

    Corners 0-3 and 4-7 go round the two faces.
    """
    turns = [[(x + y) % 4 + side for side in (0, 4) for x in range(4)] for y in range(4)]
    gap = min(np.linalg.norm(b[t] - a, axis=1).mean() for t in turns)
    diagonal = (np.linalg.norm(a[0] - a[6]) + np.linalg.norm(b[0] - b[6])) / 2
    return max(1 - gap / diagonal, 0.0)


def corner_nms(boxes: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """Greedy suppression of oriented boxes by corner similarity; ``boxes``: keys, box_id, score and ``corners`` (24 values)."""
    fields = ", ".join(f"{k} {t}" for k, t in boxes.select(*by, "box_id", "score").dtypes)

    def run(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(["score", "box_id"], ascending=[False, True], ignore_index=True)
        corners, kept = [np.reshape(c, (8, 3)) for c in lot["corners"]], []
        for i in range(len(lot)):
            if all(corner_similarity(corners[k], corners[i]) <= threshold for k in kept):
                kept.append(i)
        return lot.loc[kept, [*by, "box_id", "score"]]

    return boxes.groupBy(*by).applyInPandas(run, fields)


def minmax(column: str, keys: list[str]) -> Column:
    """Min-max normalised within ``keys``; 0 where all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(F.lit(0.0))


def oriented_corners(centre: tuple[str, str, str], size: tuple[str, str, str], heading: str) -> Column:
    """The eight corners of a box of given size turned about y, as an array of (x, y, z)."""
    c, s = F.cos(heading), F.sin(heading)
    length, width, height = (F.col(v) / 2 for v in size)
    signs = [(1, 1, 1), (1, 1, -1), (-1, 1, -1), (-1, 1, 1), (1, -1, 1), (1, -1, -1), (-1, -1, -1), (-1, -1, 1)]
    corner = lambda i, j, k: F.struct((c * length * i + s * width * k + F.col(centre[0])).alias("x"), (height * j + F.col(centre[1])).alias("y"), (-s * length * i + c * width * k + F.col(centre[2])).alias("z"))
    return F.array(*(corner(i, j, k) for i, j, k in signs))


def oriented_iou(pairs: DataFrame) -> DataFrame:
    """3-D and bird's-eye IoU of box pairs given as flat corner arrays ``a`` and ``b`` (24 values, corners 0-3 on top).

    Convex clipping of the ground polygons, times the overlap in height; batches run in Arrow.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in batches:
            got = [_corner_iou(np.reshape(a, (8, 3)), np.reshape(b, (8, 3))) for a, b in zip(lot["a"], lot["b"])]
            yield lot.drop(columns=["a", "b"]).assign(iou3d=[g[0] for g in got], iou2d=[g[1] for g in got])

    rest = [f"{k} {t}" for k, t in pairs.drop("a", "b").dtypes]
    return pairs.mapInPandas(run, ", ".join([*rest, "iou3d double", "iou2d double"]))


def _corner_iou(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    ground = [_wound(p[:4, [0, 2]]) for p in (a, b)]
    areas = [_area(p) for p in ground]
    shared = ground[0]
    for p, q in zip(ground[1], np.roll(ground[1], -1, axis=0)):
        shared = _half_plane(shared, p, q)
        if not len(shared):
            break
    flat = _area(shared) if len(shared) > 2 else 0.0
    tall = max(0.0, min(a[:, 1].max(), b[:, 1].max()) - max(a[:, 1].min(), b[:, 1].min()))
    volume = [s * np.ptp(p[:, 1]) for s, p in zip(areas, (a, b))]
    return flat * tall / (sum(volume) - flat * tall), flat / (sum(areas) - flat)


def _area(p: np.ndarray) -> float:
    x, y = p.T
    return abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2


def _wound(p: np.ndarray) -> np.ndarray:
    x, y = p.T
    return p if x @ np.roll(y, -1) >= y @ np.roll(x, -1) else p[::-1]


def _half_plane(polygon: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The part of a convex polygon on the left of the line from p to q."""
    side = (q[0] - p[0]) * (polygon[:, 1] - p[1]) - (q[1] - p[1]) * (polygon[:, 0] - p[0])
    out = []
    for i in range(len(polygon)):
        j = (i + 1) % len(polygon)
        if side[i] >= 0:
            out.append(polygon[i])
        if side[i] * side[j] < 0:
            out.append(polygon[i] + (polygon[j] - polygon[i]) * side[i] / (side[i] - side[j]))
    return np.array(out).reshape(-1, 2)
