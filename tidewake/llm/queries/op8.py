"""op8: personal data in all documents. The boosted spans have no SQL; tests hold the strict ones against a plain scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..pii import personal_data

NAME = "op8_pii"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
