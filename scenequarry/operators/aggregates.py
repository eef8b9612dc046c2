"""Per-scene, per-segment and per-instance aggregates, labels and relabelling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLOURS = ("r", "g", "b")


def segment_stat(points: DataFrame, values: list[str], how: str = "avg", keys: tuple[str, ...] = ("scene_id", "segment_id"), nonzero: bool = True) -> DataFrame:
    """Mean or maximum of ``values`` by segment over rows that aren't all zero; segments without such rows get 0."""
    live = reduce(Column.__or__, [F.col(v) != 0 for v in values]) if nonzero else F.lit(True)
    f = {"avg": F.avg, "max": F.max, "sum": F.sum}[how]
    return points.groupBy(*keys).agg(*(F.coalesce(f(F.when(live, F.col(v))), F.lit(0.0)).alias(v) for v in values))


def feature_mean(rows: DataFrame, feature: str, keys: list[str]) -> DataFrame:
    """Element-wise mean of an array column by ``keys``; one shuffle of partial sums by position."""
    long = rows.select(*keys, F.posexplode(feature).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.avg("_v").alias("_v"))
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias(feature))


def impute_zero_segments(segments: DataFrame, edges: DataFrame, value: str, by: str = "scene_id") -> DataFrame:
    """Zero segments take the mean of their non-zero neighbours, else the scene's mean over all segments."""
    mean = segments.groupBy(by).agg(F.avg(value).alias("_all"))
    other = segments.where(F.col(value) != 0).select(by, F.col("segment_id").alias("dst"), F.col(value).alias("_v"))
    near = edges.join(other, [by, "dst"]).groupBy(by, F.col("src").alias("segment_id")).agg(F.avg("_v").alias("_near"))
    joined = segments.join(mean, by).join(near, [by, "segment_id"], "left")
    return joined.withColumn(value, F.when(F.col(value) != 0, F.col(value)).otherwise(F.coalesce("_near", "_all"))).drop("_all", "_near")


def segment_vote(points: DataFrame, masks: DataFrame, by: str = "scene_id", share: float = 0.5) -> DataFrame:
    """Segments that a mask takes as a whole: those with more than ``share`` of their points in it."""
    size = points.groupBy(by, "segment_id").agg(F.count(F.lit(1)).alias("n"))
    hit = masks.join(points.select(by, "point_id", "segment_id"), [by, "point_id"]).groupBy(by, "mask_id", "segment_id").agg(F.count(F.lit(1)).alias("k"))
    return hit.join(size, [by, "segment_id"]).where(F.col("k") > share * F.col("n")).select(by, "mask_id", "segment_id", "k", "n")


def lift(segment_masks: DataFrame, points: DataFrame, by: str = "scene_id") -> DataFrame:
    """Segment masks as point masks."""
    return segment_masks.select(by, "mask_id", "segment_id").join(points.select(by, "point_id", "segment_id"), [by, "segment_id"]).select(by, "point_id", "mask_id")


def dense_ids(rows: DataFrame, column: str, by: str = "scene_id", start: int = 0) -> DataFrame:
    """Renumber ``column`` by its sorted distinct values in each scene; only distinct values are ranked."""
    ranks = rows.select(by, column).distinct()
    ranks = ranks.withColumn("_new", F.row_number().over(Window.partitionBy(by).orderBy(column)) - 1 + start)
    return rows.join(ranks, [by, column]).withColumn(column, F.col("_new").cast("long")).drop("_new")


def remap_labels(rows: DataFrame, label: str, valid: list[int], ignore: int = 255) -> DataFrame:
    """Valid labels to 0..K-1 in sorted order, any other to ``ignore``."""
    index = {v: i for i, v in enumerate(sorted(valid))}
    mapped = F.create_map(*[F.lit(x) for kv in index.items() for x in kv]) if index else None
    return rows.withColumn(label, F.coalesce(F.try_element_at(mapped, F.col(label)), F.lit(ignore)) if index else F.lit(ignore))


def lookup_first(rows: DataFrame, names: DataFrame, key: str, value: str, order: str, miss: int = 0) -> DataFrame:
    """Each row's ``value`` by ``key``: the first match in ``order``, else ``miss``."""
    first = names.groupBy(key).agg(F.min_by(value, order).alias(value))
    return rows.join(first, key, "left").withColumn(value, F.coalesce(value, F.lit(miss)))


def segments_to_instances(points: DataFrame, groups: DataFrame, by: str = "scene_id") -> DataFrame:
    """Instance of each point's segment; of groups that share a segment the last wins, none gives -1.

    ``groups``: scene, group_id, ordinal and an array of segments.
    """
    owner = groups.select(by, "group_id", "ordinal", F.explode("segments").alias("segment_id"))
    owner = owner.groupBy(by, "segment_id").agg(F.max_by("group_id", "ordinal").alias("group_id"))
    return points.join(owner, [by, "segment_id"], "left").withColumn("group_id", F.coalesce("group_id", F.lit(-1)))


def encode_gt(label: Column, instance: Column, base: int = 1000, label_shift: int = 0, shift: int = 1) -> Column:
    """Ground truth id label * base + instance + shift; data sets differ in the two shifts."""
    return ((label + label_shift) * base + instance + shift).cast("long")


def decode_gt(gt: Column, base: int = 1000) -> tuple[Column, Column]:
    return F.floor(gt / base).cast("int"), (gt % base).cast("int")


def unpack_label(packed: Column) -> tuple[Column, Column]:
    """Low 16 bits: semantic label; high 16 bits: instance."""
    return packed.bitwiseAND(F.lit(0xFFFF)), F.shiftright(packed, 16).bitwiseAND(F.lit(0xFFFF))


def instance_info(points: DataFrame, by: str = "scene_id") -> DataFrame:
    """Centroid, box and size of every instance; -1 is none."""
    kept = points.where("instance_id >= 0")
    stats = [f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return kept.groupBy(by, "instance_id").agg(*stats, F.count(F.lit(1)).alias("n"))


def boxes(points: DataFrame, keys: list[str], centre: str = "mean") -> DataFrame:
    """Axis-aligned boxes as centre and length; the centre is the points' mean or the box's middle."""
    mid = {"mean": F.avg, "middle": lambda a: (F.min(a) + F.max(a)) / 2}[centre]
    return points.groupBy(*keys).agg(*(mid(a).alias(f"c{a}") for a in "xyz"), *((F.max(a) - F.min(a)).alias(f"l{a}") for a in "xyz"), F.count(F.lit(1)).alias("n"))


def colour_moments(points: DataFrame, by: str = "scene_id") -> DataFrame:
    """Scene means of colour / 255 and of its square."""
    m = [F.avg(F.col(c) / 255.0).alias(f"m_{c}") for c in COLOURS] + [F.avg((F.col(c) / 255.0) * (F.col(c) / 255.0)).alias(f"s_{c}") for c in COLOURS]
    return points.groupBy(by).agg(*m)


def colour_stats(moments: DataFrame) -> DataFrame:
    """Mean and deviation over scenes, each scene counting once."""
    out = [F.avg(f"m_{c}").alias(f"mean_{c}") for c in COLOURS]
    out += [F.sqrt(F.avg(f"s_{c}") - F.avg(f"m_{c}") * F.avg(f"m_{c}")).alias(f"std_{c}") for c in COLOURS]
    return moments.agg(*out)


def leave_one_out(moments: DataFrame, by: str = "scene_id") -> DataFrame:
    """For each scene, the statistics of the others: totals less its own share, with no pair of scenes formed."""
    names = [f"{p}_{c}" for p in "ms" for c in COLOURS]
    total = moments.agg(F.count(F.lit(1)).alias("_k"), *(F.sum(n).alias(f"_{n}") for n in names))
    joined = moments.crossJoin(F.broadcast(total))  # one row of totals
    rest = joined.where("_k > 1").select(by, *(((F.col(f"_{n}") - F.col(n)) / (F.col("_k") - 1)).alias(n) for n in names))
    return rest.select(by, *(F.col(f"m_{c}").alias(f"mean_{c}") for c in COLOURS), *(F.sqrt(F.col(f"s_{c}") - F.col(f"m_{c}") * F.col(f"m_{c}")).alias(f"std_{c}") for c in COLOURS))


def majority(rows: DataFrame, keys: list[str], label: str, ignore: int | None = None) -> DataFrame:
    """The most frequent label by key; ties go to the smallest label."""
    kept = rows if ignore is None else rows.where(F.col(label) != ignore)
    counts = kept.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct(F.col("_n"), -F.col(label))).alias(label), F.max("_n").alias("n"))


def nan_mean(value: str) -> Column:
    """Mean without NaN; 0 if there is nothing else."""
    return F.coalesce(F.avg(F.when(~F.isnan(value), F.col(value))), F.lit(0.0))


def moving_average(rows: DataFrame, keys: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """Final exponential average by key: state = alpha * state + (1 - alpha) * value, from the first value on."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda s: s["_v"])
    folded = F.aggregate(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))), F.col("_l")[0], lambda s, v: s * alpha + v * (1 - alpha))
    return rows.groupBy(*keys).agg(ordered.alias("_l")).select(*keys, folded.alias(value))


def merge_scenes(points: DataFrame, by: str = "scene_id", group: Column | None = None) -> DataFrame:
    """Concatenate scenes of a group with instance ids shifted so that they stay apart; -1 stays -1."""
    group = F.lit(0) if group is None else group
    most = points.groupBy(by, group.alias("merged_id")).agg(F.max("instance_id").alias("_m"))
    before = Window.partitionBy("merged_id").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    shift = most.withColumn("_shift", F.coalesce(F.sum(F.col("_m") + 1).over(before), F.lit(0))).select(by, "merged_id", "_shift")
    moved = F.when(F.col("instance_id") < 0, F.col("instance_id").cast("long")).otherwise(F.col("instance_id") + F.col("_shift"))
    return points.join(shift, by).withColumn("instance_id", moved).drop("_shift")


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, to be joined by shuffle and never broadcast.

    Sizes are guessed from compressed files, or from rows before they are exploded (eight scenes for all their faces), and
    a broadcast of what turns out large takes the driver's memory.
    """
    return df.hint("merge")


def reindex(vertices: DataFrame, faces: DataFrame, by: str = "scene_id") -> tuple[DataFrame, DataFrame]:
    """Drop vertices that no face uses; number the others anew and rewrite the faces."""
    used = faces.select(by, F.explode(F.array("i1", "i2", "i3")).alias("v")).distinct()
    new = used.withColumn("_new", (F.row_number().over(Window.partitionBy(by).orderBy("v")) - 1).cast("long"))
    kept = vertices.join(shuffled(new), [by, "v"]).withColumn("v", F.col("_new")).drop("_new")
    out = faces
    for c in ("i1", "i2", "i3"):
        out = out.join(shuffled(new.select(by, F.col("v").alias(c), F.col("_new").alias(f"n_{c}"))), [by, c]).drop(c).withColumnRenamed(f"n_{c}", c)
    return kept, out


def chunks(frames: DataFrame, n: int, by: str = "scene_id", order: str = "t") -> DataFrame:
    """Consecutive frames in chunks of ``n``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return frames.withColumn("chunk", F.floor(place / n).cast("long"))


def dilated(frames: DataFrame, n: int, step: int, value: str, by: str = "scene_id", order: str = "t") -> DataFrame:
    """Windows of ``n`` frames ``step`` apart; those that run over the end are left out."""
    w = Window.partitionBy(by).orderBy(order)
    cols = {f"{value}_{i}": F.lead(value, i * step).over(w) for i in range(n)}
    return frames.select(by, order, *(c.alias(k) for k, c in cols.items())).where(F.col(f"{value}_{n - 1}").isNotNull())


def within_budget(rows: DataFrame, size: str, budget: int, order: str, by: str) -> DataFrame:
    """The leading rows whose running total of ``size`` stays within ``budget``."""
    total = F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_total", total).where(F.col("_total") <= budget).drop("_total")


def sample_exact(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows by seeded hash of ``key``: the same rows for any partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def drop_small(points: DataFrame, least: int, keys: list[str]) -> DataFrame:
    """Rows of clusters with at least ``least`` rows."""
    big = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    return points.join(big, keys, "left_semi")


def instance_names(points: DataFrame, by: str = "scene_id") -> DataFrame:
    """One row an instance with the name of its file: md5 of scene and instance."""
    one = points.where("instance_id >= 0").groupBy(by, "instance_id").agg(F.count(F.lit(1)).alias("n"))
    return one.withColumn("name", F.md5(F.concat(F.col(by).cast("string"), F.col("instance_id").cast("string"))))
