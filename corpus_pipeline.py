"""A corpus pipeline: quality rules, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with all their columns; the last returns the
packed batches. A stage's result is written as Parquet and read again as the next one's docs.

Every row is judged by its own text: rows with a null doc_id and several texts of one doc_id are rows like others. Where a
verdict must be brought back to its row, that is by a key of id and text; equal rows have equal keys and verdicts. Empty
tables stay empty in every stage, and extra columns pass through whatever their names and kinds (packing, the last
stage, returns none of them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.decontaminate import decontaminate
from tidewake.llm.jaccard import ngram_jaccard
from tidewake.llm.packing import pack, word_count
from tidewake.llm.quality import quality_rules
from tidewake.llm.runtime import bounded, workspace, written
from tidewake.llm.secrets import secret_scan


def _key() -> Column:
    """A row's key, which the operators carry as its doc_id: of the id and the text, either of which may be null."""
    return F.xxhash64(F.isnull("doc_id"), F.col("doc_id").cast("long"), F.isnull("text"), F.col("text").cast("string"))


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _row(docs: DataFrame) -> Column:
    return F.struct(*[_column(c) for c in docs.columns])


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    """(key, row): each row whole beside its key, so that no column of its own can clash with anything."""
    return docs.select(_key().alias("key"), _row(docs).alias("row"), *more)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key().alias("doc_id"), *[_column(c) for c in docs.columns if c != "doc_id"])


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose key isn't among the dropped; dropped: a written column `key`, which is broadcast if it is short."""
    return _rows(docs).join(bounded(dropped), "key", "left_anti").select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; repeated rows stay as often as they came."""
    return quality_rules(docs, row=_row(docs)).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: that of the smallest id, of rows without any only if there is no id.

    Of repeated rows one stays, the first by their text as JSON, which columns of any kind have. Rows without words stay, one of each id and text.
    """
    home = workspace(spark)
    component = ngram_jaccard(_keyed(docs), k=5, percent=80).select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = docs.select(_key().alias("key"), "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("times"))
    each = written(ids.join(component, "key"), f"{home}/each")
    first = each.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("first")).select("first.key")
    # what stays once: rows of dropped keys go, those of repeated ones are put aside
    dropped = written(each.select("key").join(first, "key", "left_anti"), f"{home}/dropped")
    repeated = written(each.where("times > 1").select("key").join(first, "key", "left_semi"), f"{home}/repeated")
    once = _without(docs, written(dropped.unionAll(repeated), f"{home}/aside"))
    again = _rows(docs, F.to_json(_row(docs)).alias("order")).join(bounded(repeated), "key").groupBy("key").agg(F.min_by("row", "order").alias("row")).select("row.*")
    return once.union(again)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window. Null and empty texts stay, as do repeated rows."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items, window=10, row=_row(docs)).where("not contaminated").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without secrets that look live. Null and empty texts stay, as do repeated rows."""
    scanned = secret_scan(_keyed(docs), owner="source", repository="source", common_owners=3, common_repositories=5)
    live = scanned.where("n_live > 0").select(F.col("doc_id").alias("key")).distinct()
    return _without(docs, written(live, f"{workspace(spark)}/live"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, in batches of like length; null and empty texts in the bucket of length 0."""
    return pack(docs, word_count(F.col("text")), buckets=16, budget=65_536)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scans", secrets),
    ("packing", packing),
]

#: Packing's dynamic programme has no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    home, docs = workspace(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{home}/stage{k}")
    return docs
