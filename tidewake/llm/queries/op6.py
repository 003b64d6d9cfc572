"""op6: language-model scores of all documents. The model has no SQL; tests hold the unigram part against a plain count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..language_model import score_texts

NAME = "op6_lm_scoring"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), folds=10, held_out=0)
