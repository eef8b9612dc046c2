"""Writers of scene tables and reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import pack_ply


def write_scenes(points: DataFrame, path: str, by: str = "scene_id", mode: str = "overwrite") -> None:
    """Parquet partitioned by scene, so that scans of some scenes prune the others."""
    points.repartition(by, F.pmod(F.xxhash64("point_id"), F.lit(16))).sortWithinPartitions(by, "point_id").write.mode(mode).partitionBy(by).parquet(path)


def write_masks(masks: DataFrame, path: str, iteration: int | None = None, by: str = "scene_id") -> None:
    """Masks by scene; self-training rounds go side by side under ``iteration``."""
    rows = masks if iteration is None else masks.withColumn("iteration", F.lit(iteration))
    keys = [by] if iteration is None else ["iteration", by]
    rows.write.mode("overwrite" if iteration is None else "append").partitionBy(*keys).parquet(path)


def write_records(scenes: DataFrame, path: str) -> None:
    """Scene or label records as JSON lines."""
    scenes.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A per-class or per-scene metrics table as one CSV; a report has one row a class or scene."""
    report.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_ids(gt: DataFrame, path: str, by: str = "scene_id") -> None:
    """Ground truth ids, one a line in point order, a folder a scene."""
    rows = gt.repartition(by).sortWithinPartitions(by, "point_id")
    rows.select(by, F.col("gt_id").cast("string").alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def export_predictions(preds: DataFrame, masks: DataFrame, path: str, least: float, by: str = "scene_id") -> None:
    """Benchmark layout: an index line a prediction above ``least``, and its points."""
    kept = preds.where(F.col("conf") > least)
    name = F.concat(F.lit("predicted_masks/"), F.col(by).cast("string"), F.lit("_"), F.col("mask_id").cast("string"))
    kept.select(by, F.concat_ws(" ", name, "label", "conf").alias("value")).write.mode("overwrite").partitionBy(by).text(f"{path}/index")
    masks.join(kept.select(by, "mask_id"), [by, "mask_id"], "left_semi").write.mode("overwrite").partitionBy(by).parquet(f"{path}/predicted_masks")


def write_ply(points: DataFrame, path: str, columns: list[str], by: str = "scene_id") -> DataFrame:
    """A binary PLY file a scene below ``path`` (any store Arrow knows); returns scene, uri and rows.

    A mesh viewer opens a scene as a whole, so a scene is one file and one group.
    """
    uri = path if "://" in path or not path.startswith("/") else f"file://{path}"

    def run(scene: pd.DataFrame) -> pd.DataFrame:
        scene = scene.sort_values("point_id")
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        colours = {"r": "red", "g": "green", "b": "blue"}
        table = {colours.get(c, c): scene[c].to_numpy(np.uint8 if c in colours else np.float32 if scene[c].dtype.kind == "f" else np.int32) for c in columns}
        name = f"{root}/{scene[by].iloc[0]}.ply"
        staged = f"{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(staged) as f:
            f.write(pack_ply(table))
        fs.move(staged, name)
        return pd.DataFrame({by: [scene[by].iloc[0]], "uri": [name], "n": [len(scene)]})

    return points.select(by, "point_id", *columns).groupBy(by).applyInPandas(run, f"{by} long, uri string, n long")


def each_scene(tables: Iterator[DataFrame], path: str) -> None:
    """Union of several data sets under one folder."""
    for table in tables:
        table.write.mode("append").parquet(path)
