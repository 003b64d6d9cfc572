"""What the text operators share about the session: a work folder that all executors see, and Arrow batch sizes."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch. Texts may be long, so the default of 10,000 rows could be gigabytes.
BATCH_ROWS = 1000
#: Rows of a few longs that are broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000


def ship_code() -> None:
    """Send this package's functions to the workers by value, so that executors need no copy of it."""
    package = sys.modules[__name__.split(".")[0]]
    if package.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(package)


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session and make the code known to the workers."""
    ship_code()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def workspace(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, removed when the session's JVM ends.

    Where that is unset (tests), it is below a temporary folder of this machine, which is an error on a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir() + "/tidewake-checkpoints"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/tidewake-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def written(frame: DataFrame, path: str) -> DataFrame:
    """The frame, computed once and kept as Parquet in the shared folder: it cuts lineage and survives lost executors."""
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def bounded(frame: DataFrame) -> DataFrame:
    """A written frame of a few longs, to be broadcast if it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def with_rest(columns: str, frame: DataFrame) -> StructType:
    """Columns that a scan of (doc_id, text, others) returns, and those others."""
    return StructType([*StructType.fromDDL(columns), *frame.schema.fields[2:]])


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most so many rows of the largest n: all whose n's eighth of an octave fits with those above it.

    The cut comes from a histogram of some hundred levels, so no task sorts or gathers the candidates.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    total, cut = 0, 1 << 20
    for at, n in sorted(((r.level, r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True):
        total += n
        if total > most:
            break
        cut = at
    return counts.where(level >= cut)


def labelled_sample(known: DataFrame, most: int) -> DataFrame:
    """At most so many rows (doc_id, label): those of the lowest hashes of doc_id.

    A threshold on the hash that leaves a few more than wanted comes first, so that only those are sorted.
    """
    share = min(1.0, (most + 6 * most**0.5 + 16) / max(known.count(), 1))
    few = known.where(F.xxhash64("doc_id") <= int(-(2**63) + share * (2**64 - 1025)))
    return few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
