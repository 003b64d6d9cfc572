"""Raster shards: compressed arrays with their ids, and a manifest by which an id's shard is found.

A Python data source. Each task writes its rows as shards of stacked arrays (NumPy's .npz) to a folder of the job; the
commit moves the shards of successful tasks beside the others and adds them to the manifest, an abort removes the folder,
so a failed task leaves nothing. The manifest holds each shard's range of ids and no ids themselves.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ..plans.stages import ship_code

FORMAT, MANIFEST, ROWS = "raster_shards", "manifest.json", 256


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Shard(InputPartition):
    file: str
    first: str
    last: str
    rows: int


@dataclass
class Written(WriterCommitMessage):
    shards: list
    sizes: list  # bytes of a row of each column


def packed(ids: list[str], columns: dict[str, list[bytes]]) -> bytes:
    """Ids and columns of bytes as a compressed file of arrays."""
    arrays = {"ids": np.array(ids)}
    for name, values in columns.items():
        arrays[name] = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, key: str, columns: list[str], rows: int, overwrite: bool) -> None:
        self.path, self.key, self.columns, self.rows, self.overwrite = path, key, columns, rows, overwrite
        self.job = f"{path}/_job-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, out, held, sizes = opened(self.job), [], [], set()
        files[0].create_dir(files[1], recursive=True)

        def flush(rows: pa.Table) -> None:
            ids, columns = rows.column(self.key).to_pylist(), {c: rows.column(c).to_pylist() for c in self.columns}
            sizes.update(zip(*(map(len, v) for v in columns.values())))
            if len(sizes) > 1:
                raise ValueError(f"rasters differ in size: {sorted(sizes)}")
            name = f"shard-{uuid.uuid4().hex}.npz"
            with files[0].open_output_stream(f"{files[1]}/{name}") as f:
                f.write(packed(ids, columns))
            out.append(Shard(name, min(ids), max(ids), len(ids)))

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= self.rows:
                whole = pa.Table.from_batches(held)
                flush(whole.slice(0, self.rows))
                held = whole.slice(self.rows).to_batches()
        if sum(b.num_rows for b in held):
            flush(pa.Table.from_batches(held))
        return Written([(s.file, s.first, s.last, s.rows) for s in out], [list(x) for x in sizes])

    def commit(self, messages: list[Written | None]) -> None:
        files, path = opened(self.path)
        shards, old = [s for m in messages if m for s in m.shards], _manifest(self.path)
        sizes = [x for m in messages if m for x in m.sizes] + ([] if self.overwrite else old["sizes"])
        if any(x != sizes[0] for x in sizes):
            raise ValueError(f"rasters differ in size: {sizes}")
        for name, *_ in shards:
            files.move(f"{opened(self.job)[1]}/{name}", f"{path}/{name}")
        known = [] if self.overwrite else old["shards"]
        with files.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps({"key": self.key, "columns": self.columns, "sizes": sizes[:1], "shards": sorted(known + shards, key=lambda s: s[1])}).encode())
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, path = opened(self.job)
        if files.get_file_info(path).type != fs.FileType.NotFound:
            files.delete_dir(path)


def _manifest(path: str) -> dict:
    files, inner = opened(path)
    if files.get_file_info(f"{inner}/{MANIFEST}").type == fs.FileType.NotFound:
        return {"key": "sample_id", "columns": [], "sizes": [], "shards": []}
    with files.open_input_stream(f"{inner}/{MANIFEST}") as f:
        return json.loads(f.read())


def manifest(path: str) -> list[list]:
    """(file, first id, last id, rows) of each shard."""
    return _manifest(path)["shards"]


class Reader(DataSourceReader):
    def __init__(self, path: str, key: str, columns: list[str], wanted: str | None) -> None:
        self.path, self.key, self.columns, self.wanted = path, key, columns, wanted

    def partitions(self) -> list[Shard]:
        """The shards whose range of ids holds the wanted one."""
        shards = [Shard(*s) for s in manifest(self.path)]
        return [s for s in shards if self.wanted is None or s.first <= self.wanted <= s.last] or [Shard("", "", "", 0)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        files, path = opened(self.path)
        with files.open_input_file(f"{path}/{partition.file}") as f:
            arrays = np.load(io.BytesIO(f.read()))
        ids = arrays["ids"]
        at = np.arange(len(ids)) if self.wanted is None else np.flatnonzero(ids == self.wanted)
        rows = [pa.array(ids[at].tolist(), pa.string()), *(pa.array([v.tobytes() for v in arrays[c][at]], pa.binary()) for c in self.columns)]
        yield pa.RecordBatch.from_arrays(rows, [self.key, *self.columns])


class RasterShards(DataSource):
    """Options: path, id (one id only), columns (comma-joined, those read), rows (of a shard)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        known = _manifest(self.options["path"])
        wanted = self.options.get("columns")
        names = known["columns"] if wanted is None else wanted.split(",")
        if missing := set(names) - set(known["columns"]):
            raise ValueError(f"no rasters {sorted(missing)}")
        return StructType([StructField(known["key"], StringType()), *(StructField(c, BinaryType()) for c in names)])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema.names[0], schema.names[1:], self.options.get("id"))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema.names[0], schema.names[1:], int(self.options.get("rows", ROWS)), overwrite)


def _registered(spark: SparkSession) -> None:
    ship_code()
    spark.dataSource.register(RasterShards)


def write_rasters(df: DataFrame, path: str, key: str = "sample_id", rows: int = ROWS, make: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """The key and all binary columns as shards, in ranges of the key, so that one id is in one shard. Adds to what is there.

    make: adds the binary columns to df's rows in their order, once these lie in ranges; rasters are then neither made twice
    (ranges are found by a sample) nor shuffled and sorted.
    """
    spark = df.sparkSession
    _registered(spark)
    pick = lambda df: df.select(key, *[c for c, kind in df.dtypes if kind == "binary"])
    # as many ranges as asked for: by the size of rows without rasters they would be joined up
    ranged = (df if make else pick(df)).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)
    out = pick(make(ranged)) if make else ranged
    out.write.format(FORMAT).option("path", path).option("rows", rows).mode("append").save()


def read_rasters(spark: SparkSession, path: str, sample_id: str | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """All rasters, or those of one id, for which only its shard is read; of all columns or those named, others stay packed."""
    _registered(spark)
    reader = spark.read.format(FORMAT).option("path", path)
    reader = reader if columns is None else reader.option("columns", ",".join(columns))
    return (reader if sample_id is None else reader.option("id", sample_id)).load()
