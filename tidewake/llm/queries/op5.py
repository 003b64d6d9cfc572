"""op5: all documents in batches of like length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..packing import pack, word_count

NAME = "op5_packing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_count(F.col("text")), buckets=16, budget=65_536)
