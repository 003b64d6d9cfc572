"""Stage tables: a stage's result is written once a session to the folder all executors share, and read from there.

This cuts lineage between long chains, keeps plans small, and lets a lost executor cost one stage only.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple[str, str, str], str] = {}

#: Bytes of the largest method that the JVM compiles. Spark's default lets longer ones run, which stay interpreted: several times slower.
COMPILED = "8000"


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs run in here have steps of many columns evaluated in several methods where one would be too long to be compiled."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, COMPILED)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ship_code() -> None:
    """Send this package's functions and classes to the workers by value, so that executors need no copy of it."""
    package = sys.modules[__name__.split(".")[0]]
    if package.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(package)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset (tests), a temporary folder of this machine, which is an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or tempfile.gettempdir() + "/tidewake-checkpoints").rstrip("/")


def stage(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """The stage's table for a source, built on first use in this session.

    by: a column by whose hash the table is bucketed, in as many buckets as there are shuffle partitions. Windows, groups
    and further stages keyed by it then need no exchange. A frame already dealt by it is written as it lies.
    """
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _written:
        frame, tag = build(), f"{name}-{uuid.uuid4().hex}"
        writer = frame.write.format("parquet").option("path", f"{shared_folder(spark)}/tidewake-stage-{tag}")
        if by:
            writer = writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by)
        _written[key] = "tidewake_stage_" + tag.replace("-", "_")
        with short_methods(spark):
            writer.saveAsTable(_written[key])
    return spark.table(_written[key])


def is_written(spark: SparkSession, name: str, source: str) -> bool:
    """Whether a stage's table is there already."""
    return (spark.sparkContext.applicationId, name, source) in _written


def forget_stages() -> None:
    """Build all stages anew on their next use."""
    _written.clear()
