"""op9: toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..toxicity import toxicity

NAME = "op9_toxicity"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=3, held_out=1, threshold=0.7)
