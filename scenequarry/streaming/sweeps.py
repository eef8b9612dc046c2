"""Structured Streaming over ordered frames: an extension, as batch tables alone are asked of scenes.

A frame stream has ``scene_id``, ``frame_id``, ``ts`` and ``value``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def frame_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder as a stream; files already seen are skipped on restart."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def window_stats(frames: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, sum and mean of ``value`` by scene in tumbling or sliding event-time windows."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = frames.withWatermark("ts", late).groupBy("scene_id", span.alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean")).select("scene_id", F.col("w.start").alias("start"), "n", "total", "mean")


def fuse_running(frames: DataFrame) -> DataFrame:
    """Running fusion a scene: acc = (acc + value) / 2 over frames as they arrive, with the number seen."""

    def step(key: tuple, lots: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        acc, n = state.get if state.exists else (0.0, 0)
        for lot in lots:
            for v in lot.sort_values(["ts", "frame_id"])["value"]:
                acc, n = (acc + v) / 2, n + 1
        state.update((acc, n))
        yield pd.DataFrame({"scene_id": [key[0]], "acc": [acc], "n": [n]})

    return frames.groupBy("scene_id").applyInPandasWithState(step, "scene_id long, acc double, n long", "acc double, n long", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; the checkpoint lets the next call go on from here."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
