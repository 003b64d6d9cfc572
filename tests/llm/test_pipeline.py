"""The corpus pipeline against its plain version, on a small folder with planted cases."""

from collections import defaultdict

from pyspark.sql import functions as F

from . import brute


def plain(rows, items):
    """doc_id -> words of the documents that every stage keeps; rows: doc_id -> (text, source)."""
    kept = {i for i, (t, _) in rows.items() if brute.quality(t)[-1]}
    groups = brute.components([(i, rows[i][0]) for i in sorted(kept)])
    kept = {i for i in kept if groups[i][1] == i}
    kept = {i for i in kept if not brute.benchmark_hits(rows[i][0], items)[1]}
    owners = defaultdict(set)
    for i in kept:
        for *_, value in brute.secrets(rows[i][0]):
            owners[value].add(rows[i][1])
    kept = {i for i in kept if all(len(owners[v]) >= 3 for *_, v in brute.secrets(rows[i][0]))}
    return {i: len(brute.space_words(rows[i][0])) for i in kept}


def test_pipeline(spark, documents, prose, tmp_path):
    import corpus_pipeline

    items = [(1, prose(30, 9000)), (2, prose(12, 9000)), (3, None)]
    texts = [prose(40 + i, 9000) for i in range(20)]
    texts += [texts[0] + " tail", texts[1], texts[2].upper(), "too short", "again and again " * 40, None, ""]
    texts += [f"{prose(30, 9000)} {items[0][1]} {prose(9, 9000)}", f"{prose(60, 9000)} {items[1][1]}"]
    texts += [f"{prose(40, 9000)} password=shared99" for _ in range(4)] + [f"{prose(40, 9000)} token: onlyhere{k}" for k in range(3)]
    docs = documents(list(enumerate(texts)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain({r.doc_id: (r.text, r.source) for r in docs.collect()}, items)
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
    assert set(range(20)) <= set(want) and not {20, 21, 22, 23, 24, 25, 26, 27, 28} & set(want)
    lengths = list(want.values())
    assert sum(r.bucket - r.n_tokens for r in got) == brute.least_padding(lengths, 16)
    for b in {r.bucket for r in got}:
        most = max(1, 65_536 // b)
        own = sorted((r for r in got if r.bucket == b), key=lambda r: r.doc_id)
        assert [(r.batch, r.slot) for r in own] == [divmod(i, most) for i in range(len(own))]


def stage_rows(frame):
    """Rows as sorted JSON, nulls kept."""
    return sorted(r.j for r in frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect())


ODD = ("_key", "key", "row", "order", "component_id", "times", "first", "none", "kept", "n_live", "with.dot", "with`tick", "count(1)")


def odd_documents(spark, rows):
    """Rows (doc_id, text, source) with columns of the stages' own names, of maps in arrays, of maps by number and variants."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for k, name in enumerate(ODD):
        df = df.select("*", F.concat(F.lit(f"{k}-"), F.coalesce("doc_id", F.lit(0))).alias(name))
    maps = F.array(F.create_map(F.lit("a"), F.col("doc_id")), F.create_map(F.lit("b"), F.lit(1).cast("long")))
    return df.select("*", maps.alias("maps"), F.create_map(F.lit(3), F.array("doc_id")).alias("by_number"), F.parse_json(F.lit('{"x": [1, null]}')).alias("variant"), F.struct("doc_id", F.lit(None).cast("int").alias("nothing")).alias("pair"))


def test_columns_of_any_name_and_kind(spark, prose, tmp_path):
    """Every stage returns whole rows, and run() goes through, as with three columns only."""
    import corpus_pipeline

    a, b, c, item = (prose(n, 9000) for n in (40, 50, 60, 30))
    rows = [(1, a, "s"), (1, a, "s"), (2, a + " tail", "s"), (3, b, "t"), (None, c, None), (None, c, None), (4, f"{prose(33, 9000)} {item}", "s"), (5, f"{prose(35, 9000)} token: onlyhere1", "s"), (6, "too short", "s"), (7, None, "s")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd_documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [{1, 2, 3, 4, 5, None}, {1, 3, 4, 5, None}, {1, 3, 5, None}, {1, 3, None}]
    times = [8, 5, 4, 3]
    for k, ((name, stage), want, n) in enumerate(zip(corpus_pipeline.STAGES, kept, times)):
        before = set(stage_rows(docs))
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        got = stage_rows(docs)
        assert set(got) <= before and len(got) == n and {r.doc_id for r in docs.select("doc_id").collect()} == want, name
    assert sorted((r.doc_id or 0, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [(0, 60), (1, 40), (3, 50)]


def test_empty_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "some words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd_documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and {"doc_id", "n_tokens", "bucket", "batch", "slot"} <= set(got.columns)


def test_stages_keep_columns(spark, documents, prose, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (documents([(1, prose(50)), (1, prose(50)), (None, prose(30)), (2, None)]), documents([])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_null_and_repeated_ids(spark, documents, prose, tmp_path):
    import corpus_pipeline

    a, b, c, d, e, item = (prose(n, 9000) for n in (40, 50, 60, 70, 80, 30))
    rows = [(1, a), (1, a), (None, a), (2, b), (2, "too short"), (None, b + " tail"), (None, c), (None, c), (None, "short too")]
    rows += [(3, d), (3, f"{prose(33, 9000)} {item}"), (4, e), (4, f"{prose(35, 9000)} token: onlyhere1")]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == [(1, 40), (2, 50), (3, 70), (4, 80), (None, 60)]
