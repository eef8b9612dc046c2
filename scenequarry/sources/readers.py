"""Readers of scene files.

Text formats are read line by line with built-in functions; binary formats are
decoded in Arrow batches of whole files, each a row. No reader needs the driver
to open a file, so inputs may lie in any store that Spark reads.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Scalar types of PLY headers.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def scene_name(path: str = "path") -> Column:
    """The file name without its extension."""
    return F.regexp_extract(F.col(path), r"([^/]+?)(\.[^./]*)?$", 1)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """scene, path and content of the files below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(scene_name().alias("scene"), "path", "content")


def parse_ply(raw: bytes) -> dict[str, pd.DataFrame]:
    """Elements of an ASCII or binary PLY file; list properties become columns of arrays."""
    head, _, body = raw.partition(b"end_header")
    body = body[body.index(b"\n") + 1 :]
    order, elements = "ascii", []
    for line in head.decode("latin-1").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            order = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], w[1:-1]))
    return _ply_text(body, elements) if order == "ascii" else _ply_binary(body, elements, "<" if "little" in order else ">")


def _ply_text(body: bytes, elements: list) -> dict[str, pd.DataFrame]:
    lines, out = iter(body.decode("latin-1").splitlines()), {}
    for name, n, properties in elements:
        rows = []
        for _ in range(n):
            words, at, row = next(lines).split(), 0, []
            for _, kind in properties:
                if kind[0] == "list":
                    k = int(words[at])
                    row.append([float(v) for v in words[at + 1 : at + 1 + k]])
                    at += 1 + k
                else:
                    row.append(float(words[at]))
                    at += 1
            rows.append(row)
        out[name] = pd.DataFrame(rows, columns=[p for p, _ in properties])
    return out


def _ply_binary(body: bytes, elements: list, order: str) -> dict[str, pd.DataFrame]:
    at, out = 0, {}
    for name, n, properties in elements:
        if all(kind[0] != "list" for _, kind in properties):
            kind = np.dtype([(p, order + PLY_TYPES[k[0]]) for p, k in properties])
            table = np.frombuffer(body, kind, n, at)
            at += kind.itemsize * n
            out[name] = pd.DataFrame({p: table[p].astype(table[p].dtype.newbyteorder("=")) for p, _ in properties})
            continue
        rows = []
        for _ in range(n):
            row = []
            for _, kind in properties:
                types = [np.dtype(order + PLY_TYPES[k]) for k in kind if k != "list"]
                k = int(np.frombuffer(body, types[0], 1, at)[0]) if kind[0] == "list" else 1
                at += types[0].itemsize if kind[0] == "list" else 0
                got = np.frombuffer(body, types[-1], k, at)
                at += types[-1].itemsize * k
                row.append(got.tolist() if kind[0] == "list" else got[0].item())
            rows.append(row)
        out[name] = pd.DataFrame(rows, columns=[p for p, _ in properties])
    return out


VERTEX = ("x", "y", "z", "nx", "ny", "nz", "red", "green", "blue", "label", "instance")


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """scene, v and the usual vertex columns; those that a file lacks are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in batches:
            for scene, raw in zip(lot["scene"], lot["content"]):
                t = parse_ply(raw)["vertex"]
                yield pd.DataFrame({"scene": scene, "v": np.arange(len(t)), **{c: t[c].astype(float) if c in t else np.nan for c in VERTEX}})

    rows = files(spark, path, "*.ply").mapInPandas(run, "scene string, v long, " + ", ".join(f"{c} double" for c in VERTEX))
    return rows.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in VERTEX[3:]})


def read_ply_faces(spark: SparkSession, path: str) -> DataFrame:
    """scene, f, i1, i2, i3 of triangles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in batches:
            for scene, raw in zip(lot["scene"], lot["content"]):
                t = parse_ply(raw).get("face")
                if t is not None and len(t):
                    tri = np.array([v[:3] for v in t.iloc[:, 0]], dtype="int64")
                    yield pd.DataFrame({"scene": scene, "f": np.arange(len(tri)), "i1": tri[:, 0], "i2": tri[:, 1], "i3": tri[:, 2]})

    return files(spark, path, "*.ply").mapInPandas(run, "scene string, f long, i1 long, i2 long, i3 long")


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (scene, line order v) and faces of OBJ text; indexes from 1 become indexes from 0."""
    text = files(spark, path, "*.obj").select("scene", F.posexplode(F.split(F.col("content").cast("string"), r"\r?\n")).alias("n", "line"))
    words = text.withColumn("w", F.split(F.trim("line"), r"\s+"))
    kind = lambda k: words.where(F.col("w")[0] == k)
    number = lambda i: F.col("w")[i].cast("double")
    nth = F.row_number().over(Window.partitionBy("scene").orderBy("n")) - 1
    vertices = kind("v").select("scene", nth.cast("long").alias("v"), number(1).alias("x"), number(2).alias("y"), number(3).alias("z"))
    corner = lambda i: (F.split(F.col("w")[i], "/")[0].cast("long") - 1)
    faces = kind("f").select("scene", nth.cast("long").alias("f"), *(corner(i).alias(f"i{i}") for i in (1, 2, 3)))
    return vertices, faces


def read_columns(spark: SparkSession, path: str, names: list[str], pattern: str = "*.txt") -> DataFrame:
    """White-space separated numbers, a scene a file, with the line number ``point_id``; malformed lines are left out."""
    text = files(spark, path, pattern).select("scene", F.posexplode(F.split(F.col("content").cast("string"), r"\r?\n")).alias("point_id", "line"))
    words = text.withColumn("w", F.split(F.trim("line"), r"\s+")).where(F.size("w") == len(names))
    return words.select("scene", F.col("point_id").cast("long").alias("point_id"), *(F.expr(f"try_cast(w[{i}] as double)").alias(c) for i, c in enumerate(names)))


def read_csv_points(spark: SparkSession, path: str) -> DataFrame:
    """Headerless outdoor CSV: x y z r g b semantic instance; instance -100 becomes null."""
    schema = "x double, y double, z double, r double, g double, b double, label double, instance_id double"
    rows = spark.read.schema(schema).csv(path).withColumn("scene", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1))
    return rows.withColumns({"label": F.col("label").cast("int"), "instance_id": F.when(F.col("instance_id") != -100, F.col("instance_id").cast("int"))})


def read_sweeps(spark: SparkSession, path: str) -> DataFrame:
    """Binary LiDAR scans of float32 x y z reflectance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in batches:
            for scene, raw in zip(lot["scene"], lot["content"]):
                t = np.frombuffer(raw, "<f4").reshape(-1, 4).astype(float)
                yield pd.DataFrame({"scene": scene, "point_id": np.arange(len(t)), "x": t[:, 0], "y": t[:, 1], "z": t[:, 2], "reflectance": t[:, 3]})

    return files(spark, path, "*.bin").mapInPandas(run, "scene string, point_id long, x double, y double, z double, reflectance double")


def read_packed_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a LiDAR scan: low 16 bits semantic, high 16 bits instance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in batches:
            for scene, raw in zip(lot["scene"], lot["content"]):
                t = np.frombuffer(raw, "<u4").astype("int64")
                yield pd.DataFrame({"scene": scene, "point_id": np.arange(len(t)), "packed": t})

    packed = files(spark, path, "*.label").mapInPandas(run, "scene string, point_id long, packed long")
    low = F.col("packed").bitwiseAND(F.lit(0xFFFF))
    return packed.select("scene", "point_id", low.alias("label"), F.shiftright("packed", 16).alias("instance_id"))


def read_matrices(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """A 4x4 matrix a file, row-major."""
    numbers = F.filter(F.split(F.col("content").cast("string"), r"\s+"), lambda w: w != "")
    return files(spark, path, pattern).select("scene", F.transform(numbers, lambda w: w.cast("double")).alias("matrix"))


def read_key_values(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """``key = v1 v2 ...`` lines as a map of number arrays by scene; a missing alignment is the identity."""
    line = F.explode(F.split(F.col("content").cast("string"), r"\r?\n"))
    pairs = files(spark, path, pattern).select("scene", line.alias("line")).where(F.col("line").contains("="))
    key, rest = F.trim(F.substring_index("line", "=", 1)), F.trim(F.substring_index("line", "=", -1))
    values = F.transform(F.split(rest, r"\s+"), lambda w: w.try_cast("double"))
    maps = pairs.groupBy("scene").agg(F.map_from_entries(F.collect_list(F.struct(key, values))).alias("info"))
    eye = F.array(*(F.lit(float(i % 5 == 0)) for i in range(16)))
    return maps.withColumn("alignment", F.coalesce(F.try_element_at("info", F.lit("axisAlignment")), eye))


def read_poses(spark: SparkSession, path: str, calibration: list[list[float]]) -> DataFrame:
    """Poses of a LiDAR sequence, 12 numbers a line, brought into the sensor's frame: Tr^-1 P Tr."""
    tr = np.asarray(calibration, float)
    back = np.linalg.inv(tr)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in batches:
            for scene, raw in zip(lot["scene"], lot["content"]):
                rows = [np.array(line.split(), float) for line in bytes(raw).decode().splitlines() if line.strip()]
                full = [back @ np.vstack([r.reshape(3, 4), [0, 0, 0, 1]]) @ tr for r in rows]
                yield pd.DataFrame({"scene": scene, "t": np.arange(len(full)), "pose": [p.ravel() for p in full]})

    return files(spark, path, "poses.txt").mapInPandas(run, "scene string, t long, pose array<double>")


def parse_calibration(text: str) -> dict[str, list[list[float]]]:
    """``key: 12 numbers`` lines as 4x4 matrices."""
    out = {}
    for line in text.splitlines():
        key, _, rest = line.partition(":")
        if rest.strip():
            out[key.strip()] = np.vstack([np.array(rest.split(), float).reshape(3, 4), [0, 0, 0, 1]]).tolist()
    return out


def repaired_json(c: Column) -> Column:
    """Double the backslash of escapes that JSON doesn't know."""
    return F.regexp_replace(c, r'\\(?!["\\/bfnrtu])', r"\\\\")


def read_segment_indices(spark: SparkSession, path: str, pattern: str = "*.segs.json") -> DataFrame:
    """Raw segment of every vertex, from ``segIndices``."""
    parsed = F.from_json(repaired_json(F.col("content").cast("string")), "segIndices array<long>")
    return files(spark, path, pattern).select("scene", F.posexplode(parsed["segIndices"]).alias("point_id", "segment_id"))


def read_segment_groups(spark: SparkSession, path: str, pattern: str = "*.aggregation.json") -> DataFrame:
    """Groups with their ordinal, label and segments, from ``segGroups``."""
    parsed = F.from_json(repaired_json(F.col("content").cast("string")), "segGroups array<struct<id: long, label: string, segments: array<long>>>")
    rows = files(spark, path, pattern).select("scene", F.posexplode(parsed["segGroups"]).alias("ordinal", "g"))
    return rows.select("scene", "ordinal", F.col("g.id").alias("group_id"), F.col("g.label").alias("label"), F.col("g.segments").alias("segments"))


def read_label_map(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """Two columns of a TSV, the first row of each ``source``; whole numbers stay numbers. Such a file is one split."""
    lines = spark.read.option("header", "true").option("sep", "\t").csv(path).select(source, target, F.monotonically_increasing_id().alias("_line"))
    rows = lines.groupBy(source).agg(F.min_by(target, "_line").alias(target))
    return rows.withColumn("id", F.expr(f"try_cast(`{target}` as int)"))


def read_zip(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Members of ZIP files whose name ends in ``suffix``: scene, member, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in batches:
            for scene, raw in zip(lot["scene"], lot["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for name in z.namelist():
                        if name.endswith(suffix):
                            yield pd.DataFrame({"scene": [scene], "member": [name], "content": [z.read(name)]})

    return files(spark, path, "*.zip").mapInPandas(run, "scene string, member string, content binary")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``mask-path label score``; absolute paths and paths that climb out are refused."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("scene"), F.split(F.trim("value"), " ").alias("w")).where(F.size("w") == 3)
    safe = ~F.col("w")[0].startswith("/") & ~F.array_contains(F.split(F.col("w")[0], "/"), "..")
    ok = F.when(safe, F.col("w")[0]).otherwise(F.raise_error(F.concat(F.lit("mask path outside its folder: "), F.col("w")[0])))
    return lines.select("scene", ok.alias("mask_path"), F.col("w")[1].cast("int").alias("label"), F.col("w")[2].cast("double").alias("conf"))


def read_ids(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One integer a line, numbered within its file."""
    text = files(spark, path, pattern).select("scene", F.posexplode(F.split(F.regexp_replace(F.col("content").cast("string"), r"\s+$", ""), r"\r?\n")).alias("point_id", "line"))
    return text.select("scene", F.col("point_id").cast("long").alias("point_id"), F.col("line").try_cast("long").alias("gt_id"))


def pack_ply(table: dict[str, np.ndarray]) -> bytes:
    """A binary little-endian PLY file of vertex columns."""
    kinds = {"f": ("float", "<f4"), "u": ("uchar", "u1"), "i": ("int", "<i4")}
    names = list(table)
    types = [kinds["u" if table[n].dtype == np.uint8 else "f" if table[n].dtype.kind == "f" else "i"] for n in names]
    n = len(table[names[0]]) if names else 0
    rows = np.empty(n, [(c, t[1]) for c, t in zip(names, types)])
    for c in names:
        rows[c] = table[c]
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *(f"property {t[0]} {c}" for c, t in zip(names, types)), "end_header", ""]
    return "\n".join(head).encode() + rows.tobytes()
