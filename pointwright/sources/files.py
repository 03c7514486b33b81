"""File sources and sinks of point data: text, PLY, Parquet and manifests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the cloud layouts, by name.
LAYOUTS = {"xyzrgb": "x y z r g b", "xyzrgbL": "x y z r g b label", "xyzrgbI": "x y z r g b intensity", "xyzrgbIL": "x y z r g b intensity label"}
#: Names that PLY files use for our columns.
PLY_NAMES = {"red": "r", "green": "g", "blue": "b", "scalar_intensity": "intensity", "scalar_label": "label"}
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def read_text(spark: SparkSession, path: str, layout: str = "xyzrgbL") -> DataFrame:
    """Points of white-space separated text files, one point a line, with the file they come from."""
    names = LAYOUTS[layout].split()
    parts = F.split(F.trim(F.col("value")), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    return lines.select("file", *[parts[i].cast("double").alias(c) for i, c in enumerate(names)])


def parse_ply(data: bytes) -> dict[str, np.ndarray]:
    """The vertex element of a PLY file, ASCII or binary, as columns."""
    head, _, body = data.partition(b"end_header")
    body = body[body.index(b"\n") + 1 :]
    kind, count, fields, inside = "", 0, [], False
    for line in head.decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            inside = words[1] == "vertex"
            if inside:
                count = int(words[2])
            elif not fields:
                raise ValueError("vertex must be the first element")
        elif words[:1] == ["property"] and inside:
            if words[1] == "list":
                raise ValueError("a vertex can't have lists")
            fields.append((words[2], PLY_TYPES[words[1]]))
    if kind == "ascii":
        rows = np.array([line.split()[: len(fields)] for line in body.decode("ascii").splitlines()[:count]], dtype=float).reshape(count, len(fields))
        return {n: rows[:, i] for i, (n, _) in enumerate(fields)}
    order = {"binary_little_endian": "<", "binary_big_endian": ">"}[kind]
    rows = np.frombuffer(body, dtype=[(n, order + t) for n, t in fields], count=count)
    return {n: rows[n].astype(float) for n, _ in fields}


def format_ply(columns: dict[str, np.ndarray]) -> bytes:
    """A binary PLY file: coordinates as floats, colours and labels as bytes."""
    back = {v: k for k, v in PLY_NAMES.items() if not k.startswith("scalar_")}
    small = ("r", "g", "b", "label")
    fields = [(back.get(c, c), "u1" if c in small else "<f4") for c in columns]
    n = len(next(iter(columns.values())))
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *[f"property {'uchar' if t == 'u1' else 'float'} {name}" for name, t in fields], "end_header"]
    rows = np.zeros(n, dtype=fields)
    for (name, _), v in zip(fields, columns.values(), strict=True):
        rows[name] = v
    return ("\n".join(head) + "\n").encode() + rows.tobytes()


def read_ply(spark: SparkSession, path: str, layout: str = "xyzrgbL") -> DataFrame:
    """Points of PLY files, a task for each file, with file and row number. A file is read whole."""
    names = LAYOUTS[layout].split()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                got = {PLY_NAMES.get(k, k): v for k, v in parse_ply(bytes(content)).items()}
                yield pd.DataFrame({"file": file, "row": np.arange(len(got["x"])), **{c: got[c] for c in names}})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, row long, " + ", ".join(f"{c} double" for c in names))


def read_points(spark: SparkSession, path: str, layout: str = "xyzrgbL") -> DataFrame:
    """Points of a .txt or .ply path (or glob)."""
    if path.endswith(".txt"):
        return read_text(spark, path, layout)
    if path.endswith(".ply"):
        return read_ply(spark, path, layout)
    raise ValueError(f"unknown file type: {path}")


def ply_files(df: DataFrame, key: str = "cloud", layout: str = "xyzrgbL") -> DataFrame:
    """(key, content): the PLY file of each cloud, in the order of pid."""
    names = LAYOUTS[layout].split()

    def make(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("pid")
        return pd.DataFrame({key: [g[key].iloc[0]], "content": [format_ply({c: g[c].to_numpy() for c in names})]})

    return df.select(key, "pid", *names).groupBy(key).applyInPandas(make, f"{key} string, content binary")


def read_ply_files(spark: SparkSession, path: str, key: str = "cloud", layout: str = "xyzrgbL") -> DataFrame:
    """Points of a table of PLY files as ply_files() makes it: key, row and the layout's columns."""
    names = LAYOUTS[layout].split()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cloud, content in zip(batch[key], batch["content"], strict=True):
                got = {PLY_NAMES.get(k, k): v for k, v in parse_ply(bytes(content)).items()}
                yield pd.DataFrame({key: cloud, "row": np.arange(len(got["x"])), **{c: got[c] for c in names}})

    return spark.read.parquet(path).mapInPandas(parse, f"{key} string, row long, " + ", ".join(f"{c} double" for c in names))


def write_blocks(df: DataFrame, path: str, rows_per_file: int = 100_000 * 4096) -> None:
    """Block rows as compressed Parquet files of a bounded number of rows."""
    df.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").mode("overwrite").parquet(path)


def write_whole_blocks(df: DataFrame, path: str, block: str, blocks_per_file: int = 100_000) -> None:
    """Block rows as compressed Parquet files that hold at most so many whole blocks each, numbered by the block: a new file begins where one is full."""
    number = F.floor(F.col(block) / blocks_per_file).alias("file")
    df.select("*", number).repartition(F.col("file")).write.partitionBy("file").option("compression", "zstd").mode("overwrite").parquet(path)


def write_by_scene(df: DataFrame, path: str, scene: str = "cloud") -> None:
    """A folder for each scene; rows are dealt by scene and id, so one scene is many tasks and few files."""
    df.repartition(F.col(scene), F.pmod(F.xxhash64("pid"), F.lit(4))).write.partitionBy(scene).mode("overwrite").parquet(path)


def write_pred_truth(df: DataFrame, path: str) -> None:
    """Lines of prediction and truth as two fixed-point numbers."""
    df.select(F.format_string("%f %f", F.col("pred").cast("double"), F.col("truth").cast("double")).alias("value")).write.mode("overwrite").text(path)


def read_pred_truth(spark: SparkSession, path: str) -> DataFrame:
    """Prediction and truth of all files of a path or glob."""
    return spark.read.schema("pred double, truth double").csv(path, sep=" ").select(F.col("truth").cast("long").alias("truth"), F.col("pred").cast("long").alias("pred"))


def write_text(df: DataFrame, path: str, layout: str = "xyzrgbL") -> None:
    """Points as white-space separated text."""
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in LAYOUTS[layout].split()]).alias("value")).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a list file, one a line."""
    return spark.read.text(path).select(F.rtrim("value").alias("entry")).where("entry <> ''")


def class_of_file(path, classes: list[str], other: str = "clutter"):
    """The class that a file is named for (before its first underscore), `other` where it is none of the list."""
    name = F.split(F.element_at(F.split(path, "/"), -1), "_")[0]
    return F.when(name.isin(*classes), name).otherwise(F.lit(other))


def room_of(entry):
    """Area and room of a manifest entry such as Area_1_office_2.npy or Area_1/office_2/Annotations."""
    return F.regexp_extract(entry, r"(Area_\d+)[_/]", 1), F.regexp_extract(entry, r"Area_\d+[_/]([A-Za-z]+_\d+)", 1)


