"""License scans by diagonal voting, with DataFrame functions only.

All rolling three-word grams of all texts are joined with the grams of the templates. Each meeting votes for a diagonal,
the offset between text and template. Diagonals within a bounded width are one span, which allows for that many added or
missing words and no more: a span's stretch of text is hardly longer than its template. A span is verified by the votes
in it, each of which proves three words: the longest chain of them that goes forward both in the text and in the template
must hold enough of the template's grams. Phrases are templates that must be met in full on a single diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import prepare, workspace, written

K = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases whose every place is reported, with their labels.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Fixed wording of public license notices, in words as WORD finds them, with their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("reserved", "all rights reserved"),
)
#: Diagonals of one span lie within this width, and so many percent of a template's grams, in order, make a span.
WIDTH, ENOUGH = 6, 60


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWERED), F.lit(WORD), F.lit(0))


def grams_of(words: Column) -> Column:
    """(position, gram) of all runs of K words."""
    run = lambda i: F.struct(i.alias("at"), F.concat_ws(" ", *[F.get(words, i + j) for j in range(K)]).alias("gram"))
    return F.when(F.size(words) >= K, F.transform(F.sequence(F.lit(0), F.size(words) - K), run)).otherwise(F.array().cast("array<struct<at:int,gram:string>>"))


def template_grams(spark: SparkSession) -> DataFrame:
    """(template, label, phrase, grams, t_at, t_gram, hash): some hundred rows, whatever the corpus."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(i < len(PHRASES)).alias("phrase"), F.lit(text).alias("text")) for i, (label, text) in enumerate(PHRASES + TEMPLATES)]
    listed = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*").withColumn("all", grams_of(words_of(F.col("text"))))
    return listed.select("template", "label", "phrase", F.size("all").alias("grams"), F.inline("all").alias("t_at", "t_gram")).withColumn("hash", F.xxhash64("t_gram"))


def in_order(votes: Column) -> Column:
    """Length of the longest chain of votes (t_at, at) that rise in both; votes are sorted by t_at, then by falling at.

    The array holds the least end of a chain of each length so far.
    """

    def add(ends: Column, vote: Column) -> Column:
        n = F.size(F.filter(ends, lambda e: e < vote["at"]))
        return F.concat(F.slice(ends, F.lit(1), n), F.array(vote["at"]), F.slice(ends, n + 2, F.size(ends)))

    return F.size(F.aggregate(votes, F.array().cast("array<long>"), add))


def noticed(diagonals: DataFrame) -> DataFrame:
    """Spans of notices with the part of their grams that stands in order: from each diagonal on, those within the width."""
    own = Window.partitionBy("doc_id", "text", "template").orderBy("diagonal").rangeBetween(0, WIDTH)
    spans = diagonals.withColumn("near", F.collect_list(F.struct("diagonal", "met")).over(own))
    found = F.flatten(F.transform("near", lambda d: F.transform(d["met"], lambda t: F.struct(t.alias("t_at"), (-d["diagonal"] - t).cast("long").alias("back")))))
    spans = spans.withColumn("votes", F.array_sort(found)).drop("near")
    enough = lambda n: n * 100 >= F.col("grams") * ENOUGH
    spans = spans.where(enough(F.size(F.array_distinct(F.transform("votes", lambda v: v["t_at"])))))
    ordered = in_order(F.transform("votes", lambda v: F.struct((-v["back"]).alias("at"))))
    return spans.withColumn("n", ordered).where(enough(F.col("n"))).withColumn("part", F.col("n") / F.col("grams")).drop("votes", "n")


def license_scan(docs: DataFrame) -> DataFrame:
    """License phrases and notices in each whole text; reads doc_id and text, other columns are ignored.

    Returns a row per input row (repeated rows too): doc_id, n_words, n_base (places of phrases), first_word and last_word
    (smallest and largest start of these, null if none), base_labels and labels (distinct, sorted, comma-joined; labels
    adds those of notices), score (the largest part of a template that was found in order, 0 if none).
    Null and empty texts have no words. Rows with a null doc_id are scanned as well. An empty table gives no rows.
    Only the templates are broadcast.
    """
    prepare(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("text"), words_of(F.col("text")).alias("words"))
    rolling = named.select("doc_id", "text", F.inline(grams_of(F.col("words"))).alias("at", "gram")).withColumn("hash", F.xxhash64("gram"))
    votes = rolling.join(F.broadcast(template_grams(docs.sparkSession)), "hash").where("gram = t_gram")
    votes = votes.select("doc_id", "text", "template", "label", "phrase", "grams", "t_at", (F.col("at") - F.col("t_at")).alias("diagonal")).distinct()  # repeated rows vote once
    key = ["doc_id", "text", "template", "label", "phrase", "grams"]
    # written: few rows, used twice
    diagonals = written(votes.groupBy(*key, "diagonal").agg(F.collect_set("t_at").alias("met")), f"{workspace(docs.sparkSession)}/diagonals")
    whole = diagonals.where(F.col("phrase") & (F.size("met") == F.col("grams"))).withColumn("part", F.lit(1.0))
    spans = whole.unionByName(noticed(diagonals.where("not phrase"))).withColumnRenamed("diagonal", "start")
    base = F.col("phrase")
    labels = spans.groupBy("doc_id", "text").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("part").alias("score"),
    )
    labels = labels.withColumnsRenamed({"doc_id": "id", "text": "hash"})
    counted = named.select("doc_id", "text", F.size("words").cast("long").alias("n_words"))
    return counted.join(labels, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text").eqNullSafe(F.col("hash")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
