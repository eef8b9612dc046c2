"""Evaluation: confusion, overlap, average precision and recall, boxes and coverage."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .masks import box_iou

#: The overlap thresholds of instance evaluation.
THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9)


def confusion(rows: DataFrame, target: str, predicted: str, valid: list[int] | None = None, ignore: int | None = None) -> DataFrame:
    """Counts by (target, predicted); with ``valid`` only cells of valid classes count."""
    if ignore is not None:
        rows = rows.where(F.col(target) != ignore)
    if valid is not None:
        rows = rows.where(F.col(target).isin(valid) & F.col(predicted).isin(valid))
    return rows.groupBy(F.col(target).alias("target"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def row_normalised(counts: DataFrame) -> DataFrame:
    total = counts.groupBy("target").agg(F.sum("n").alias("_t"))
    return counts.join(total, "target").withColumn("share", F.col("n") / F.greatest(F.col("_t"), F.lit(1e-12))).drop("_t")


def class_iou(counts: DataFrame) -> DataFrame:
    """tp / (tp + fp + fn) by class; null for a class without rows."""
    side = F.array(F.struct(F.col("target").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))
    tp = F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)) / 2
    long = counts.select(tp.alias("tp"), F.explode(side).alias("s")).select("tp", "s.*")
    sums = long.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    union = F.col("t") + F.col("p") - F.col("tp")
    return sums.select("label", F.col("tp").cast("long").alias("tp"), (F.col("p") - F.col("tp")).cast("long").alias("fp"), (F.col("t") - F.col("tp")).cast("long").alias("fn"), F.when(union > 0, F.col("tp") / union).alias("iou"))


def precision_at_one(rows: DataFrame, target: str, predicted: str, ignore: int = 255) -> DataFrame:
    """Percentage of rows whose prediction is right; 0 without rows."""
    hit = (F.col(target) == F.col(predicted)).cast("double")
    return rows.where(F.col(target) != ignore).agg(F.coalesce(100 * F.avg(hit), F.lit(0.0)).alias("precision"))


@dataclass
class Association:
    """Matches of predictions and ground truth of the same label; all tables are small against the points."""

    gt: DataFrame
    preds: DataFrame
    pairs: DataFrame


def associate(gt: DataFrame, preds: DataFrame, masks: DataFrame, least: int = 100, by: str = "scene_id") -> Association:
    """Points of a mask meet ground truth on (scene, point); counts by (scene, mask, instance).

    Predictions below ``least`` points are dropped, instances below it are
    marked as not counting. ``ignored`` is a prediction's number of points
    without valid ground truth or on instances of its label that don't count.
    """
    size = gt.groupBy(by, "gt_id", "label").agg(F.count(F.lit(1)).alias("gt_n"))
    size = size.withColumn("counts", (F.col("gt_n") >= least) & (F.col("gt_id") >= 1000))
    kept = preds.where(F.col("vert_count") >= least)
    near = masks.join(gt.select(by, "point_id", "gt_id"), [by, "point_id"]).groupBy(by, "mask_id", "gt_id").agg(F.count(F.lit(1)).alias("inter"))
    hit = near.join(kept, [by, "mask_id"]).join(size.withColumnRenamed("label", "gt_label"), [by, "gt_id"])
    valid = hit.groupBy(by, "mask_id").agg(F.sum("inter").alias("_valid"), F.sum(F.when((F.col("label") == F.col("gt_label")) & ~F.col("counts"), F.col("inter")).otherwise(0)).alias("_small"))
    ignored = F.col("vert_count") - F.coalesce("_valid", F.lit(0)) + F.coalesce("_small", F.lit(0))
    kept = kept.join(valid, [by, "mask_id"], "left").select(by, "mask_id", "label", "conf", "vert_count", ignored.alias("ignored"))
    pairs = hit.where("label = gt_label").select(by, "mask_id", "gt_id", "label", "conf", "counts", "gt_n", "inter", (F.col("inter") / (F.col("gt_n") + F.col("vert_count") - F.col("inter"))).alias("iou"))
    return Association(size, kept, pairs)


def precision_recall_events(a: Association, thresholds: tuple[float, ...] = THRESHOLDS, by: str = "scene_id") -> DataFrame:
    """(th, scene, label, conf, tp): one row a scored prediction.

    From a threshold of 0.5 on a prediction can match one instance at most, so
    of an instance's matches the best scored is its true positive and the
    others are false; predictions without any match are false unless the
    ignored share exceeds the threshold.
    """
    if min(thresholds) < 0.5:
        raise ValueError("below 0.5 matching depends on order: use sequential_events")
    th = F.explode(F.array(*map(F.lit, thresholds))).alias("th")
    hits = a.pairs.select("*", th).where(F.col("iou") > F.col("th"))
    place = Window.partitionBy("th", by, "gt_id").orderBy(F.desc("conf"), "mask_id")
    scored = hits.where("counts").select("th", by, "label", "conf", (F.row_number().over(place) == 1).cast("int").alias("tp"))
    lone = a.preds.select("*", th).join(hits.select("th", by, "mask_id").distinct(), ["th", by, "mask_id"], "left_anti")
    false = lone.where(F.col("ignored") / F.col("vert_count") <= F.col("th")).select("th", by, "label", "conf", F.lit(0).alias("tp"))
    return scored.unionByName(false)


def sequential_events(a: Association, threshold: float = 0.25, by: str = "scene_id") -> DataFrame:
    """The same for any threshold, by the order-dependent rule: instances in order of id, their
    matches in order of mask id; a first match marks its prediction as used, later ones keep the
    higher score as true and leave the lower one as false. One group a scene and label, of matches only."""
    pairs = a.pairs.where((F.col("iou") > threshold)).select(by, "label", "gt_id", "mask_id", "conf", "counts")

    def run(lot: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        out = []
        for _, own in lot[lot["counts"]].sort_values(["gt_id", "mask_id"]).groupby("gt_id", sort=True):
            best = None
            for mask, conf in zip(own["mask_id"], own["conf"]):
                if best is None:
                    if mask in used:
                        continue
                    used.add(mask)
                    best = conf
                else:
                    out.append((min(best, conf), 0))
                    best = max(best, conf)
            if best is not None:
                out.append((best, 1))
        return pd.DataFrame({"th": threshold, by: lot[by].iloc[0], "label": lot["label"].iloc[0], "conf": [c for c, _ in out], "tp": [t for _, t in out]})

    scored = pairs.groupBy(by, "label").applyInPandas(run, f"th double, {by} long, label int, conf double, tp int")
    lone = a.preds.join(pairs.select(by, "mask_id").distinct(), [by, "mask_id"], "left_anti")
    false = lone.where(F.col("ignored") / F.col("vert_count") <= threshold).select(F.lit(threshold).alias("th"), by, "label", "conf", F.lit(0).alias("tp"))
    return scored.unionByName(false)


def average_precision(events: DataFrame, gt: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """th, ``keys``, ap and ar; with the scene among ``keys`` every scene is evaluated alone.

    Precision and recall at each distinct score, an artificial last point
    (1, 0), and half the recall between neighbours as widths. Without
    predictions ap is 0 and ar null; without ground truth ap is null and ar 0.
    """
    n_gt = gt.where("counts").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt"))
    at = events.groupBy("th", *keys, "conf").agg(F.sum("tp").alias("tp"), F.sum(1 - F.col("tp")).alias("fp"))
    down = Window.partitionBy("th", *keys).orderBy(F.desc("conf"))
    total = down.rowsBetween(Window.unboundedPreceding, 0)
    pr = at.join(n_gt, [*keys]).select("th", *keys, "conf", (F.sum("tp").over(total) / F.col("n_gt")).alias("r"), (F.sum("tp").over(total) / F.sum(F.col("tp") + F.col("fp")).over(total)).alias("p"))
    higher = F.lag("r").over(down)
    width = (F.coalesce(F.lead("r").over(down), F.col("r")) - F.coalesce(higher, F.lit(0.0))) / 2
    area = pr.withColumn("w", width).withColumn("last", F.when(higher.isNull(), F.col("r") / 2).otherwise(0.0))
    sums = area.groupBy("th", *keys).agg((F.sum(F.col("p") * F.col("w")) + F.sum("last")).alias("ap"), F.sum(F.col("r") * F.col("w")).alias("ar"))
    seen = n_gt.select(*keys, "n_gt").join(events.select(*keys).distinct(), [*keys], "full")
    grid = seen.select(*keys, "n_gt", F.explode(F.array(*map(F.lit, thresholds))).alias("th"))
    none = F.col("n_gt").isNull()
    return grid.join(sums, ["th", *keys], "left").select("th", *keys, F.when(~none, F.coalesce("ap", F.lit(0.0))).alias("ap"), F.when(none, 0.0).otherwise(F.col("ar")).alias("ar"))


def averages(table: DataFrame) -> DataFrame:
    """Means over classes that have a value: all thresholds, and 0.5 alone."""
    return table.agg(F.avg("ap").alias("ap"), F.avg(F.when(F.col("th") == 0.5, F.col("ap"))).alias("ap50"), F.avg("ar").alias("ar"), F.avg(F.when(F.col("th") == 0.5, F.col("ar"))).alias("ar50"))


def class_report(table: DataFrame, low: DataFrame | None = None) -> DataFrame:
    """label, ap, ap50, ap25, ar, ar50, ar25: the per-class report; ``low`` has the rows at 0.25."""
    half = lambda c: F.max(F.when(F.col("th") == 0.5, F.col(c)))
    out = table.groupBy("label").agg(F.avg("ap").alias("ap"), half("ap").alias("ap50"), F.avg("ar").alias("ar"), half("ar").alias("ar50"))
    if low is not None:
        out = out.join(low.select("label", F.col("ap").alias("ap25"), F.col("ar").alias("ar25")), "label", "left")
    return out


def bucket_report(report: DataFrame, buckets: DataFrame, values: tuple[str, ...] = ("ap", "ap50")) -> DataFrame:
    """Means by frequency bucket (head, common, tail) over classes that have a value."""
    return report.join(buckets, "label").groupBy("bucket").agg(*(F.avg(v).alias(v) for v in values))


def box_events(dets: DataFrame, gts: DataFrame, threshold: float, by: str = "scene_id") -> DataFrame:
    """label, conf, mask_id, scene and tp of every detection.

    A detection goes for its best overlapping box of its scene and label; it
    is true above the threshold if no better scored one took that box.
    """
    g = gts.select(by, "label", F.col("gt_id"), *(F.col(c).alias(f"b_{c}") for c in ("cx", "cy", "cz", "lx", "ly", "lz")))
    d = dets.select(by, "label", "mask_id", "conf", *(F.col(c).alias(f"a_{c}") for c in ("cx", "cy", "cz", "lx", "ly", "lz")))
    met = d.join(g, [by, "label"], "left").withColumn("iou", F.when(F.col("gt_id").isNotNull(), box_iou()))
    best = met.groupBy(by, "label", "mask_id", "conf").agg(F.max_by("gt_id", F.struct(F.col("iou"), -F.col("gt_id"))).alias("gt_id"), F.max("iou").alias("iou"))
    over = best.withColumn("hit", F.coalesce(F.col("iou") > threshold, F.lit(False)))
    first = F.row_number().over(Window.partitionBy(by, "label", "gt_id", "hit").orderBy(F.desc("conf"), "mask_id")) == 1
    return over.select(by, "label", "mask_id", "conf", (F.col("hit") & first).cast("int").alias("tp"))


def voc_ap(events: DataFrame, n_gt: DataFrame, by: str = "scene_id", eleven: bool = False) -> DataFrame:
    """label and ap: area under the precision envelope, or its mean at eleven recalls."""
    down = Window.partitionBy("label").orderBy(F.desc("conf"), by, "mask_id")
    total = down.rowsBetween(Window.unboundedPreceding, 0)
    tp = F.sum("tp").over(total)
    pr = events.join(n_gt, "label").select("label", "conf", by, "mask_id", (tp / (F.col("n_gt") + 1e-5)).alias("r"), (tp / F.count(F.lit(1)).over(total)).alias("p"))
    if eleven:
        at = pr.select("label", "r", "p", F.explode(F.array(*(F.lit(i / 10) for i in range(11)))).alias("t"))
        best = at.groupBy("label", "t").agg(F.coalesce(F.max(F.when(F.col("r") >= F.col("t"), F.col("p"))), F.lit(0.0)).alias("p"))
        return best.groupBy("label").agg((F.sum("p") / 11).alias("ap"))
    envelope = F.max("p").over(down.rowsBetween(0, Window.unboundedFollowing))
    step = F.col("r") - F.coalesce(F.lag("r").over(down), F.lit(0.0))
    return pr.withColumn("a", envelope * step).groupBy("label").agg(F.sum("a").alias("ap"))


def box_counts(dets: DataFrame, gts: DataFrame, iou: float, conf: float, by: str = "scene_id") -> DataFrame:
    """tp, fp, fn, precision and recall of boxes by scene, whatever their class and without one-to-one matching."""
    sides = ("cx", "cy", "cz", "lx", "ly", "lz")
    d = dets.where(F.col("conf") > conf).select(by, "mask_id", *(F.col(c).alias(f"a_{c}") for c in sides))
    g = gts.select(by, "gt_id", *(F.col(c).alias(f"b_{c}") for c in sides))
    good = d.join(g, by).where(box_iou() >= iou).select(by, "mask_id", "gt_id")
    n_d, n_g = d.groupBy(by).agg(F.count(F.lit(1)).alias("_d")), g.groupBy(by).agg(F.count(F.lit(1)).alias("_g"))
    n_good = good.groupBy(by).agg(F.countDistinct("mask_id").alias("_td"), F.countDistinct("gt_id").alias("_tg"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = n_g.join(n_d, by, "full").join(n_good, by, "left").select(by, z("_td").alias("tp"), (z("_d") - z("_td")).alias("fp"), (z("_g") - z("_tg")).alias("fn"))
    return rows.withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)).withColumn("recall", F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0))


def coverage(a: Association, by: str = "scene_id") -> DataFrame:
    """Mean and size-weighted mean, by label, of the best IoU of each instance."""
    best = a.pairs.groupBy(by, "gt_id").agg(F.max("iou").alias("best"))
    rows = a.gt.join(best, [by, "gt_id"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return rows.groupBy("label").agg(F.avg("best").alias("mucov"), (F.sum(F.col("best") * F.col("gt_n")) / F.sum("gt_n")).alias("mwcov"), F.count(F.lit(1)).alias("n"))


def instance_precision_recall(a: Association, threshold: float = 0.5, by: str = "scene_id") -> DataFrame:
    """By label: share of predictions and of instances with an IoU of at least ``threshold`` to any counterpart."""
    p = a.pairs.groupBy(by, "mask_id").agg(F.max("iou").alias("m"))
    g = a.pairs.groupBy(by, "gt_id").agg(F.max("iou").alias("m"))
    hit = F.coalesce((F.col("m") >= threshold).cast("double"), F.lit(0.0))
    pp = a.preds.join(p, [by, "mask_id"], "left").groupBy("label").agg(F.avg(hit).alias("precision"))
    gg = a.gt.join(g, [by, "gt_id"], "left").groupBy("label").agg(F.avg(hit).alias("recall"))
    return pp.join(gg, "label", "full")
