"""Reading and writing tables: files by suffix, folders of images, arrays, streams; splits into features and label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import registry

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "webp")


@dataclass(frozen=True)
class Dataset:
    """A table with its columns' parts: key, features, label."""

    data: DataFrame
    features: list[str]
    label: str | None = None
    key: str | None = None


def load(data: DataFrame, label: str | None = None, features: list[str] | None = None, exclude: list[str] | None = None, key: str | None = None) -> Dataset:
    """Split a table: the named features that exist, or all columns but label, key and excluded ones. A missing label is an error."""
    if label is not None and label not in data.columns:
        raise ValueError(f"no label column {label!r} among {data.columns}")
    named = [c for c in features if c in data.columns] if features else [c for c in data.columns if c not in {label, key, *(exclude or ())}]
    return Dataset(data.select(*dict.fromkeys([*([key] if key else []), *named, *([label] if label else [])])), named, label, key)


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None, kind: str | None = None) -> DataFrame:
    """Parquet, ORC, JSON lines, text or a registered loader's format by suffix, anything else as CSV with a header; ``kind`` overrides the suffix."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    kind = {"jsonl": "json", "ndjson": "json", "txt": "text"}.get(kind, kind)
    if kind in registry.names("loader"):
        return registry.get("loader", kind)(spark, path, schema)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("parquet", "orc", "json", "text"):
        return getattr(reader, kind)(path)
    return reader.csv(path, header=True, inferSchema=schema is None)


def from_arrays(spark: SparkSession, features, labels=None, names: list[str] | None = None) -> DataFrame:
    """Arrays of numbers as a table: columns feature_0, feature_1, ..., label; one dimension is one column."""
    import pandas as pd

    frame = pd.DataFrame(features)
    frame.columns = names or [f"feature_{i}" for i in range(frame.shape[1])]
    return spark.createDataFrame(frame if labels is None else frame.assign(label=labels))


def image_folder(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, label (the parent folder) and length of every image file below ``root``; its bytes too, if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    label = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label")
    wanted = ["path", label, "length", *(["content"] if content else [])]
    return files.where(F.lower(F.substring_index("path", ".", -1)).isin(*IMAGE_SUFFIXES)).select(*wanted)


def stream(spark: SparkSession, kind: str, schema: str | None = None, **options) -> DataFrame:
    """A streaming table: kafka with JSON values parsed by ``schema``, rate, socket, or files of any format."""
    reader = spark.readStream.format(kind).options(**{k: v for k, v in options.items() if k != "path"})
    if kind == "kafka":
        rows = reader.load()
        return rows.select(F.from_json(F.col("value").cast("string"), schema).alias("data"), "topic", "partition", "offset", "timestamp").select("data.*", "topic", "partition", "offset", "timestamp")
    reader = reader.schema(schema) if schema and kind not in ("rate", "socket") else reader
    return reader.load(options["path"]) if "path" in options else reader.load()


def write_any(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    if kind in registry.names("exporter"):
        registry.get("exporter", kind)(df, path, mode)
        return
    writer = df.write.mode(mode)
    writer.csv(path, header=True) if kind == "csv" else getattr(writer, kind)(path)


def labelling_tasks(df: DataFrame, key: str, text: str, kind: str = "prodigy") -> DataFrame:
    """One JSON document a row, as labelling tools read them: value, for ``write.text``."""
    meta = F.struct(F.col(key).cast("string").alias("id"))
    if kind == "label_studio":
        body = F.struct(F.struct(F.col(text).alias("text"), F.col(key).cast("string").alias("id")).alias("data"))
    else:
        body = F.struct(F.col(text).alias("text"), meta.alias("meta"))
    return df.select(F.to_json(body).alias("value"))
