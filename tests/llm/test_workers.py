"""The operators in a session whose workers have no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = '''
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
from tidewake.llm import conversations, decontaminate, factorisation, jaccard, language_model, packing, phrases, quality, tokens, toxicity
import public_tokenizers
docs = spark.createDataFrame([(i, f"some words of text number {i % 3} in a row of ten words or more") for i in range(12)], "doc_id long, text string")
labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
items = spark.createDataFrame([(1, "text number 1 in a row of ten words or")], "item_id long, text string")
for frame in (
    jaccard.ngram_jaccard(docs), tokens.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")), decontaminate.decontaminate(docs, items),
    packing.pack(docs, F.length("text")), language_model.score_texts(docs), toxicity.toxicity(docs, labels), quality.quality_rules(docs),
):
    assert len(frame.collect()) == 12
talks = spark.createDataFrame([(i % 4, i, "user", "Yes.") for i in range(12)], "conv_id long, turn long, role string, text string")
assert conversations.repair_conversations(talks).count() == 4 and factorisation.quality_scores(docs, labels.withColumnRenamed("toxic", "quality")).count() == 12
assert phrases.collocations(docs.withColumn("lang", F.lit("en")), least=3).count() > 0
print("all ran")
'''


def test_workers_without_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, str(script), str(Path(__file__).resolve().parents[2]), str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in ran.stdout, ran.stderr[-2000:]
