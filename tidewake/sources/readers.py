"""Raw message files, stage tables, samples and map payloads as DataFrames."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Basenames of side tables that a stage's folder may hold beside its parts.
SIDE_OUTPUTS = ("all_motion", "segment_labels", "segment_summary", "underway_only", "manifest", "summary")
GEOMETRY = "array<struct<lat double, lon double>>"
ELEMENTS = f"elements array<struct<type string, id long, tags map<string,string>, geometry {GEOMETRY}>>"


def raw_schema(header: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in header])


def _headers(spark: SparkSession, path: str, glob: str) -> dict[tuple[str, ...], list[str]]:
    """The files of each header. Only a file's first line reaches the driver."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    # a file's first line starts at its first block; a compressed file is one block
    first = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n")).where("at = 0")
    out: dict[tuple[str, ...], list[str]] = {}
    for r in first.groupBy("file").agg(F.min_by("value", "n").alias("value")).orderBy("file").collect():
        out.setdefault(tuple(next(csv.reader([r.value.lstrip("\ufeff")]), ())), []).append(r.file)
    return out


def read_raw(spark: SparkSession, path: str, glob: str = "*.{csv,csv.gz,csv.zst,gz}", header: list[str] | None = None) -> DataFrame:
    """All files below a folder as text columns, with source_file; codecs follow the suffix. No inference, no null tokens.

    Files whose headers differ, in order or in columns, are read by their own headers; absent columns are null. A given
    header is that of all files. A folder without files gives an empty table.
    """
    plain = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if header:
        frames = [plain.schema(raw_schema(header)).option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(path)]
    else:
        frames = [plain.schema(raw_schema(list(own))).csv(files) for own, files in _headers(spark, path, glob).items()]
    if not frames:
        return spark.createDataFrame([], "source_file string")
    frames = [f.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)) for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _unzip(header: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(".csv")):
                        with z.open(name) as f:
                            for chunk in pd.read_csv(f, dtype=str, keep_default_na=False, chunksize=200_000):
                                yield chunk.reindex(columns=header).assign(source_file=path.rsplit("/", 1)[-1])

    return run


def read_raw_zip(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """CSV members of zip files, which no codec of Spark reads; a task per file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(_unzip(header), T.StructType([*raw_schema(header).fields, T.StructField("source_file", T.StringType())]))


def output_name(file_name: str) -> str:
    """Name without the suffixes of raw files."""
    for suffix in (".csv.gz", ".csv.zst", ".csv", ".zip", ".gz"):
        if file_name.endswith(suffix):
            return file_name[: -len(suffix)]
    return file_name


def read_stage(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A stage's Parquet parts; an empty table of the schema if it was never written."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).option("pathGlobFilter", "part-*").parquet(path)
    except Exception as e:
        if schema is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_stage_csv(spark: SparkSession, path: str, schema: T.StructType, primary: bool = True) -> DataFrame:
    """Gzip CSV parts of a stage; primary leaves side tables out and, below the folder itself, all but parts and messages."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv.gz").csv(path)
    if not primary:
        return df
    steps = F.split(F.col("_metadata.file_path"), "/")
    name = F.regexp_replace(F.element_at(steps, -1), r"\.csv\.gz$", "")
    return df.where(primary_file(name, F.element_at(steps, -2), path.rstrip("/").rsplit("/", 1)[-1]))


def primary_file(name: Column, folder: Column, root: str) -> Column:
    """Whether a file of a name (without suffix) in a folder is a stage's own output below a root folder."""
    return ~name.isin(*SIDE_OUTPUTS) & (name.startswith("part-") | (name == "messages") | (folder == root))


def first_rows(df: DataFrame, n: int, key: str = "split", order: str = "sample_id") -> DataFrame:
    """At most n rows of each split, the first by an order; 0 is no limit."""
    if n == 0:
        return df
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_row") <= n).drop("_row")


def find_segment(df: DataFrame, segment_id: str) -> DataFrame:
    """The rows of a segment in order of time; an error if there are none."""
    found = df.where(F.col("segment_id") == segment_id)
    if found.isEmpty():
        raise KeyError(segment_id)
    return found.orderBy("timestamp_utc")


def find_raster(rasters: DataFrame, sample_id: str) -> DataFrame:
    """A sample's (category, gy, gx) cells in order; none if its raster is empty."""
    return rasters.where(F.col("sample_id") == sample_id).orderBy("category", "gy", "gx")


def missing_keys(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys of the wanted rows that nothing present has, such as tiles whose ways were not fetched."""
    return wanted.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def read_samples(spark: SparkSession, root: str, version: str, split: str) -> DataFrame:
    """Samples of a version and split of an exported tree; an error if there are none."""
    df = spark.read.parquet(root).where((F.col("version") == version) & (F.col("split") == split))
    if df.isEmpty():
        raise FileNotFoundError(f"no samples of {version}/{split} below {root}")
    return df


def find_sample(df: DataFrame, sample_id: str | None) -> DataFrame:
    """The sample of an id, or any one if id is None; an error if there is none."""
    found = df.limit(1) if sample_id is None else df.where(F.col("sample_id") == sample_id).limit(1)
    if found.isEmpty():
        raise KeyError(sample_id)
    return found


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of cached map payloads (JSON with an elements list)."""
    return spark.read.schema(ELEMENTS).option("multiLine", True).option("recursiveFileLookup", True).json(path).select(F.explode("elements").alias("e")).select("e.*")


def union_splits(frames: dict[str, DataFrame]) -> DataFrame:
    """Frames by split as one, with a split column."""
    parts = [df.withColumn("split", F.lit(name)) for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
