"""Runs of streams over growing folders, as a table that is written once and read by queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_in_rocksdb(spark: SparkSession, partitions: int):
    """Keyed state in RocksDB, in so many partitions, for streams started within; the session's settings come back afterwards."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fed(spark: SparkSession, batches: Iterable[DataFrame], plan: Callable[[DataFrame], DataFrame], home: str, partitions: int | None = None) -> DataFrame:
    """The plan's rows over a folder that gets one batch after the other; the stream stops and restarts from its checkpoint after each.

    partitions: of the state; by default as many as shuffles have, but no more than two a core, as each starts a worker in
    every batch.
    """
    partitions = partitions or min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    source, schema = f"{home}/source", None
    with state_in_rocksdb(spark, partitions):
        for batch in batches:
            schema = schema or batch.schema
            batch.write.mode("append").parquet(source)
            stream = plan(spark.readStream.schema(schema).parquet(source))
            stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{home}/checkpoint").option("path", f"{home}/result").trigger(availableNow=True).start().awaitTermination()
        result = plan(spark.readStream.schema(schema).parquet(source)).schema
    return spark.read.schema(result).parquet(f"{home}/result")
