"""What the operators share: cluster storage, salted ranks and word helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of bytes other than these six (the white space of ASCII).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Whether shuffle files go at the end of the query that made them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (tests, a laptop)
    one is made under the local temporary folder and set on the session; on a
    cluster a missing setting is an error, as no local folder is shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scenequarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its place, for loops.

    A checkpoint keeps the size that was estimated for its plan, and joins
    multiply estimates; after some rounds planning handles numbers of millions
    of digits. A table has the size of its files.
    """
    out, conf = scratch(df.sparkSession, "written"), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")  # what was shuffled for the table is of no use once it is written, and would lie on disk until the driver collects garbage
    try:
        df.write.parquet(out)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(out), out


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it, for a local path or any URI that Arrow knows."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def publish(fs: pafs.FileSystem, staged: str, final: str) -> None:
    """Move a finished file into place; a retried task replaces its own earlier copy."""
    if isinstance(fs, pafs.LocalFileSystem):
        os.replace(staged, final)
        return
    if fs.get_file_info(final).type != pafs.FileType.NotFound:
        fs.delete_file(final)
    fs.move(staged, final)


_HELD: dict[object, object] = {}


def held(name: object, make: Callable[[], object]) -> object:
    """What this Python worker remembers under ``name``; asking for another name drops the last.

    Workers serve many tasks and operators, so what they remember is bounded by the largest, not the sum.
    """
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def row_keys(columns: list[str], seed: int = 42) -> list[Column]:
    """Two 64-bit hashes of all ``columns``, nulls told apart: rows that agree in both are taken as the same row."""
    parts = [c for name in columns for c in (F.isnull(F.col(f"`{name}`")), F.col(f"`{name}`"))]
    return [F.xxhash64(F.lit(seed + i), *parts) for i in (0, 1)]


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder that no later read needs, through the file system that Spark uses for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Alike rows that are ranked as one lot.
LOT = 8192


def salted_rank(df: DataFrame, keys: list[str], size: str, order: list[str], seed: int) -> DataFrame:
    """Add ``rank`` (from 0, unique within ``keys``) without gathering a key in one task.

    ``size`` names a column holding the key's row count n. Rows alike in all
    columns are interchangeable: they are counted first and ranked in lots of
    at most ``LOT``, so that a row that occurs very often makes no hot task.
    Lots go to about sqrt(n) seeded buckets; a row's rank is the count in
    earlier buckets plus its place in its own, so neither step holds more than
    about sqrt(n) lots of one key. The rank depends on values only, never on
    partitions; ``order`` must tell unlike rows apart, or the tie between them
    is broken by their remaining columns.
    """
    columns = df.columns
    rest = [c for c in columns if c not in keys and c not in order and c != size]
    alike = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_alike"))
    lots = alike.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_alike") - 1) / LOT))))
    lots = lots.withColumn("_rows", F.least(F.col("_alike") - F.col("_lot") * LOT, F.lit(LOT).cast("long"))).drop("_alike")
    mixed = F.xxhash64(F.lit(seed), *order, "_lot")
    dealt = lots.withColumn("_bucket", F.pmod(mixed, F.ceil(F.sqrt(F.col(size))).cast("long")))
    dealt = dealt.repartition(*keys, "_bucket")  # else a partitioning by the keys alone would do for all that follows
    counts = dealt.groupBy(*keys, "_bucket").agg(F.sum("_rows").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = Window.partitionBy(*keys, "_bucket").orderBy(mixed, *order, "_lot", *rest).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_place", F.coalesce(F.sum("_rows").over(place), F.lit(0)))
    joined = ranked.join(counts, [*keys, "_bucket"])
    first = F.col("_before") + F.col("_place")
    return joined.select(*columns, F.explode(F.sequence(first, first + F.col("_rows") - 1)).alias("rank"))
