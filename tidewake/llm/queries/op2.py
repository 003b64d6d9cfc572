"""op2: token counts of all documents under the 32k-piece vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tokens import token_counts

NAME = "op2_token_counts"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
