"""Raster shards and archives: round trips, failures, what is read."""

import gzip
import json
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewake.sources import archives, rasters


def raster_rows(n, seed=0):
    chance = np.random.default_rng(seed)
    return [(f"s{i:04d}", (chance.random(64) < 0.3).astype(np.uint8).tobytes(), chance.random(16).astype(np.float32).tobytes(), i) for i in range(n)]


SCHEMA = "sample_id string, masks binary, distances binary, other int"


def test_raster_shards(spark, tmp_path):
    rows, path = raster_rows(500), str(tmp_path / "shards")
    rasters.write_rasters(spark.createDataFrame(rows, SCHEMA).repartition(6), path, rows=40)
    shards = rasters.manifest(path)
    assert sum(s[3] for s in shards) == 500 and max(s[3] for s in shards) <= 40 and not list(Path(path).glob("_job-*"))
    assert all(a[2] < b[1] for a, b in zip(shards, shards[1:]))  # ranges of ids don't overlap
    back = rasters.read_rasters(spark, path)
    assert back.columns == ["sample_id", "masks", "distances"]
    assert sorted((r.sample_id, bytes(r.masks), bytes(r.distances)) for r in back.collect()) == [r[:3] for r in rows]
    assert len(list(Path(path).glob("shard-*.npz"))) == len(shards)


def test_one_id_reads_one_shard(spark, tmp_path):
    rows, path = raster_rows(300), str(tmp_path / "shards")
    rasters.write_rasters(spark.createDataFrame(rows, SCHEMA), path, rows=25)
    assert len(rasters.Reader(path, "sample_id", ["masks", "distances"], "s0123").partitions()) == 1
    (one,) = rasters.read_rasters(spark, path, "s0123").collect()
    assert bytes(one.masks) == rows[123][1] and rasters.read_rasters(spark, path, "s9").count() == 0
    # all other shards may be gone
    kept = rasters.Reader(path, "sample_id", [], "s0123").partitions()[0].file
    for f in Path(path).glob("shard-*.npz"):
        if f.name != kept:
            f.unlink()
    assert rasters.read_rasters(spark, path, "s0123").count() == 1


def test_shards_are_added(spark, tmp_path):
    path = str(tmp_path / "shards")
    rasters.write_rasters(spark.createDataFrame(raster_rows(20), SCHEMA), path)
    rasters.write_rasters(spark.createDataFrame([("z" + r[0], *r[1:]) for r in raster_rows(20, 1)], SCHEMA), "file://" + path)
    assert rasters.read_rasters(spark, path).count() == 40
    empty = str(tmp_path / "empty")
    rasters.write_rasters(spark.createDataFrame([], SCHEMA), empty)
    assert rasters.read_rasters(spark, empty).count() == 0


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    """A row of another size fails its task, after others have written; a table written before stays as it was."""
    path = str(tmp_path / "shards")
    rasters.write_rasters(spark.createDataFrame(raster_rows(20), SCHEMA), path)
    before = {f.name for f in Path(path).rglob("*")}
    bad = spark.createDataFrame([*[("y" + r[0], *r[1:]) for r in raster_rows(200, 2)], ("zz", b"short", b"1", 1)], SCHEMA)
    with pytest.raises(PySparkException):
        rasters.write_rasters(bad, path, rows=10)
    assert {f.name for f in Path(path).rglob("*")} == before and rasters.read_rasters(spark, path).count() == 20


HEADER = "# Timestamp,MMSI,SOG"


def test_archives(spark, tmp_path):
    """A zip of several members, gzip, Zstandard and plain files of different headers, in folders."""
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.csv", f"{HEADER}\nt1,1,5\nt2,2,\n")
        z.writestr("deep/two.csv", "﻿MMSI,Extra,SOG\r\n3,\"x, y\",7\r\n")
        z.writestr("readme.txt", "MMSI\n9\n")
        z.writestr("empty.csv", "")
        z.writestr("header.csv", f"{HEADER}\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.csv.zst").write_bytes(zstandard.ZstdCompressor().compress(f"SOG,MMSI\n8,4\n{'9,5' + chr(10)}".encode()))
    (tmp_path / "sub" / "c.csv.gz").write_bytes(gzip.compress(f"{HEADER}\nt6,6,NaN\nt7,null,1\n".encode()))
    (tmp_path / "d.csv").write_text(f"{HEADER}\nt8,8,\n")
    (tmp_path / "e.json").write_text(json.dumps([1]))
    df = archives.read_archives(spark, str(tmp_path))
    assert set(df.columns) == {"# Timestamp", "MMSI", "SOG", "Extra", "source_file"}
    got = sorted((r.MMSI, r["# Timestamp"], r.SOG, r.Extra, r.source_file) for r in df.collect())
    assert got == [
        ("1", "t1", "5", None, "one.csv"), ("2", "t2", "", None, "one.csv"), ("3", None, "7", "x, y", "deep/two.csv"), ("4", None, "8", None, "b.csv.zst"), ("5", None, "9", None, "b.csv.zst"),
        ("6", "t6", "NaN", None, "c.csv.gz"), ("8", "t8", "", None, "d.csv"), ("null", "t7", "1", None, "c.csv.gz"),
    ]
    assert df.rdd.getNumPartitions() == 7
    some = archives.read_archives(spark, str(tmp_path), ["MMSI", "Length"])
    assert some.columns == ["MMSI", "Length", "source_file"] and some.count() == 8 and some.where("Length is not null").count() == 0


def test_archives_of_nothing(spark, tmp_path):
    assert archives.read_archives(spark, str(tmp_path)).count() == 0


def test_members_are_streamed(tmp_path):
    """A member of 60 MB goes by in batches of a few; its header takes its first bytes only."""
    line = "1,2,3\n"
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.csv", "a,b,c\n" + line * 10_000_000)
    (member,) = archives.members(str(tmp_path))
    before, rows, most = pa.total_allocated_bytes(), 0, 0
    for batch in archives.Reader(str(tmp_path), ["a", "c"]).read(member):
        rows, most = rows + batch.num_rows, max(most, pa.total_allocated_bytes() - before)
        del batch
    assert rows == 10_000_000 and most < 200 << 20
    assert archives.header_of(pa.fs.LocalFileSystem(), member) == ["a", "b", "c"]


def test_headers_with_the_engine_reader(spark, tmp_path):
    """Both readers of raw files agree on gzip and plain files."""
    from tidewake.sources import readers

    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(f"{HEADER}\nt1,1,5\n".encode()))
    (tmp_path / "b.csv").write_text("MMSI,SOG\n2,6\n")
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select("# Timestamp", "MMSI", "SOG", F.col("source_file")).collect())
    assert rows(archives.read_archives(spark, str(tmp_path))) == rows(readers.read_raw(spark, str(tmp_path)))


def test_written_zip(spark, tmp_path):
    """A zip of all tasks' rows comes back, with quotes, commas, nulls as empty texts."""
    rows = [(str(i), None if i % 3 else 'say "x", y') for i in range(50)]
    archives.write_zip(spark.createDataFrame(rows, "a string, b string").repartition(3), str(tmp_path / "z"))
    assert len(list((tmp_path / "z").glob("*.zip"))) == 3 and not list((tmp_path / "z").glob("_*"))
    assert sorted((r.a, r.b) for r in archives.read_archives(spark, str(tmp_path / "z")).collect()) == sorted((a, b or "") for a, b in rows)


def test_column_sets(spark, tmp_path):
    from tidewake.sources import writers

    rows = spark.sql("select 's1' as sample_id, 'test' as split, 1L as mmsi, 'g' as segment_id, timestamp '2024-01-01' as hist_end_ts, timestamp '2024-01-02' as pred_end_ts, 1.5D as anchor_lat, 2.5D as anchor_lon, 't' as tile_id, 9 as other")
    lines = lambda path: sorted(x for f in Path(path).rglob("*.csv") for x in f.read_text().splitlines())
    writers.write_anchors(rows, str(tmp_path / "anchors"))
    assert lines(tmp_path / "anchors" / "all") == ["s1,test,1,g,2024-01-01T00:00:00+00:00,2024-01-02T00:00:00+00:00,1.5,2.5,t", ",".join(writers.ANCHOR)]
    assert lines(tmp_path / "anchors" / "by_split" / "split=test") == ["s1,1,g,2024-01-01T00:00:00+00:00,2024-01-02T00:00:00+00:00,1.5,2.5,t", ",".join(c for c in writers.ANCHOR if c != "split")]
    for frame, n in ((rows, 2), (rows.limit(0), 1)):
        writers.write_metadata(frame, str(tmp_path / "meta"))
        got = lines(tmp_path / "meta")
        assert len(got) == n and ",".join(writers.METADATA) in got


def test_rasters_made_in_ranges(spark, tmp_path):
    """Rasters are made once, from rows that lie in their ranges already; one column is read without the other."""
    made, path = spark.sparkContext.accumulator(0), str(tmp_path / "shards")

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            wide = [bytes([len(i)]) * 64 for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(wide, pa.binary()), pa.array([w * 2 for w in wide], pa.binary())], ["sample_id", "masks", "distances"])

    ids = spark.range(300).select(F.format_string("s%04d", "id").alias("sample_id"))
    rasters.write_rasters(ids.repartition(6), path, rows=40, make=lambda df: df.mapInArrow(run, "sample_id string, masks binary, distances binary"))
    shards = rasters.manifest(path)
    assert made.value == 300 == sum(s[3] for s in shards) and all(a[2] < b[1] for a, b in zip(shards, shards[1:]))
    back = rasters.read_rasters(spark, path, columns=("distances",))
    assert back.columns == ["sample_id", "distances"] and {bytes(r.distances) for r in back.collect()} == {bytes([5]) * 128} and back.count() == 300
    with pytest.raises(PySparkException, match="no rasters"):
        rasters.read_rasters(spark, path, columns=("depths",)).collect()
