"""CSV files inside archives, as a Python data source: a partition for each member of a zip file, each gzip, Zstandard or plain file.

A member is decompressed as a stream and read in Arrow batches, so memory is bounded by a batch whatever a member's size.
Headers are taken from a member's first bytes; members may have different ones.
"""

from __future__ import annotations

import csv
import io
import itertools
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..plans.stages import ship_code
from .rasters import opened

FORMAT = "csv_archives"
CODECS = {".gz": "gzip", ".zst": "zstd", ".csv": None}
#: Bytes of an Arrow batch's text, before parsing.
BLOCK = 4 << 20


@dataclass
class Member(InputPartition):
    file: str
    name: str  # within a zip file, else empty


def members(path: str) -> list[Member]:
    """All readable files below a folder (or one file), zip files by their members; of a zip only the directory is read."""
    files, inner = opened(path)
    info = files.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else []
    out = []
    for each in sorted((f.path for f in found if f.type == fs.FileType.File)):
        if each.endswith(".zip"):
            with files.open_input_file(each) as f, zipfile.ZipFile(f) as z:
                out += [Member(each, n) for n in sorted(z.namelist()) if n.endswith(".csv")]
        elif each.endswith(tuple(CODECS)):
            out.append(Member(each, ""))
    return out


def stream(files: fs.FileSystem, member: Member):
    """The member's bytes, decompressed as they are read."""
    if member.name:
        return zipfile.ZipFile(files.open_input_file(member.file)).open(member.name)
    raw = files.open_input_file(member.file)
    codec = next(c for suffix, c in CODECS.items() if member.file.endswith(suffix))
    return pa.CompressedInputStream(raw, codec) if codec else raw


def header_of(files: fs.FileSystem, member: Member, most: int = 1 << 16) -> list[str]:
    """Names in the first line; of the member no more is decompressed than that takes."""
    with stream(files, member) as f:
        head = f.read(most)
    first = head.decode("utf-8", "replace").lstrip("﻿")
    return next(csv.reader(io.StringIO(first)), [])


class Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str]) -> None:
        self.path, self.names = path, names

    def partitions(self) -> list[Member]:
        return members(self.path) or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        files, _ = opened(self.path)
        own = header_of(files, partition)
        if not own:
            return
        source = partition.name or partition.file.rsplit("/", 1)[-1]
        with stream(files, partition) as f:
            read = pacsv.ReadOptions(use_threads=False, block_size=BLOCK, column_names=own, skip_rows=1)
            text = pacsv.ConvertOptions(column_types={c: pa.string() for c in own}, strings_can_be_null=False)
            parse = pacsv.ParseOptions(newlines_in_values=False, invalid_row_handler=lambda row: "skip")
            wrapped = f if isinstance(f, pa.NativeFile) else pa.PythonFile(f, "r")
            try:
                batches = pacsv.open_csv(wrapped, read, parse, text)
            except pa.ArrowInvalid as e:
                if "Empty CSV" in str(e):
                    return
                raise
            for batch in batches:
                have = {c: batch.column(k) for k, c in enumerate(own)}
                columns = [have.get(c, pa.nulls(batch.num_rows, pa.string())) for c in self.names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([source] * batch.num_rows, pa.string())], [*self.names, "source_file"])


class CsvArchives(DataSource):
    """Option: path."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        path = self.options["path"]
        files, names = opened(path)[0], {}
        for member in members(path):
            names |= dict.fromkeys(header_of(files, member))
        return StructType([StructField(c, StringType()) for c in [*names, "source_file"]])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], [c for c in schema.names if c != "source_file"])


def read_archives(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """Text columns of all CSV files in and below a folder, zipped, gzipped, in Zstandard or plain, with source_file.

    A column that a file lacks is null, an empty field an empty text, a row with too few or many fields left out. A given
    header names the columns that are wanted and spares the reading of first lines. A folder without files has no rows.
    """
    ship_code()
    spark.dataSource.register(CsvArchives)
    reader = spark.read.format(FORMAT).option("path", path)
    if header:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in [*header, "source_file"]]))
    return reader.load()


def write_zip(df: DataFrame, path: str) -> None:
    """A zip file with one CSV member for each task that has rows, written batch by batch; all columns as text."""
    ship_code()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inner = opened(path)
        files.create_dir(inner, recursive=True)
        name, rows = uuid.uuid4().hex, 0
        first = next(batches, None)
        if first is None:
            return
        # written under another name first: a failed task leaves no archive
        with files.open_output_stream(f"{inner}/_{name}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z, z.open(f"{name}.csv", "w") as member:
            with pacsv.CSVWriter(pa.PythonFile(member, "w"), first.schema, write_options=pacsv.WriteOptions(quoting_style="needed")) as out:
                for batch in itertools.chain([first], batches):
                    out.write_batch(batch)
                    rows += batch.num_rows
        files.move(f"{inner}/_{name}", f"{inner}/{name}.zip")
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).mapInArrow(run, "rows long").write.format("noop").mode("overwrite").save()
