"""op13: quality of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..factorisation import quality_scores

NAME = "op13_quality_classifier"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), metadata=("n_chars",), folds=4, held_out=2, threshold=0.7)
