"""Conversation repair, phrase collocations and the quality classifier against plain versions, and their edge cases."""

import datetime as dt
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewake.llm import conversations, factorisation, phrases, runtime

from . import brute

CONVERSATIONS = "conv_id long, turn long, role string, text string, _key string, place long, piece string, cost map<string,int>, audit date"


@pytest.fixture(scope="session")
def talks(spark):
    """Rows (conv_id, turn, role, text) with columns of names that the operator uses itself."""
    return lambda rows: spark.createDataFrame([(*r, "k", 1, "p", {"a": 1}, dt.date(2024, 1, 1)) for r in rows], CONVERSATIONS)


def talk_rows(seed, n, most):
    chance, rows = random.Random(seed), []
    for c in range(n):
        for t in range(chance.randrange(1, most)):
            role = chance.choice(["user", "assistant"] * 3 + ["system", "tool", "", None])
            rows.append((c * 7, chance.choice([t, t, t, t + 3, None]), role, chance.choice(["Hi.", "Yes", "Well? ", "ok!\n", "", " \t", None, "last one."])))
    return rows


def expected(rows):
    left = brute.damage(rows)
    return {c: brute.repair(left.get(c, [])) for c in {r[0] for r in rows}}


def repaired(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in conversations.repair_conversations(frame).collect()}


@pytest.mark.parametrize("piece", [1024, 2])
def test_repair(talks, monkeypatch, piece):
    """As all sequences of edits tried in turn; pieces of two rows give the same as whole conversations."""
    monkeypatch.setattr(conversations, "PIECE", piece)
    rows = talk_rows(1, 150, 5) + [(None, 0, "user", "A."), (None, 1, "assistant", "B."), (None, None, None, None), (5, 1, "user", "same."), (5, 1, "user", "same."), (5, 1, "assistant", "same.")]
    assert repaired(talks(rows)) == expected(rows)


def test_repair_of_long_conversations(talks, monkeypatch):
    """Many pieces, by the same programme run plainly over whole conversations; alternating turns cost nothing."""
    rows = [(1, t, "ua"[t % 2] + "x", f"turn {t}.") for t in range(0, 400)] + [(2, t, chance, f"{t}.") for t, chance in enumerate(random.Random(2).choices(["user", "assistant", "system"], k=300))]
    rows += [(3, t, "user", "again.") for t in range(200)] + [(4, t, "assistant", "x" * 3000 + str(t)) for t in range(50)]
    whole = repaired(talks(rows))
    monkeypatch.setattr(conversations, "PIECE", 16)
    assert repaired(talks(rows)) == whole
    left = brute.damage(rows)
    for conv, got in whole.items():
        assert got[1:4] == tuple(brute.faults(left[conv]).count(f) for f in ("blank", "duplicate", "truncated"))
    assert set(whole) == {1, 2, 3, 4} and len(whole[3][6]) >= len(left[3])


def test_repair_of_nothing(talks):
    assert conversations.repair_conversations(talks([])).count() == 0
    gone = next(i for i in range(1000) if not brute.damage([(i, 0, "user", "x.")]).get(i))
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert repaired(talks([(gone, 0, "user", "x.")])) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}


def test_trie_shares_layers(monkeypatch):
    """A layer is computed once for each node of the trie."""
    made = []
    plain = conversations.deeper
    monkeypatch.setattr(conversations, "deeper", lambda layer, letter: made.append(letter) or plain(layer, letter))
    signatures = sorted(["uauaua", "uauauD", "uau", "ss", "s", "uauaua"[::-1]])
    batch = pa.RecordBatch.from_arrays([pa.array([conversations.END] * len(signatures)), pa.array([True] * len(signatures)), pa.array(signatures)], ["ends", "last", "signature"])
    list(conversations._solve(iter([batch.slice(0, 3), batch.slice(3)])))
    assert len(made) == len({s[: k + 1] for s in signatures for k in range(len(s))})


def lines(seed, n):
    chance = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Straße", "ÉTÉ", "数据", "I'm"]
    out = []
    for _ in range(n):
        text = "".join(chance.choice(words) + chance.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ". ", "!?", "; a b c d e; "]) for _ in range(chance.randrange(0, 30)))
        out.append((chance.choice(["en", "fr", "", None, "und"]), text))
    return out


@pytest.mark.parametrize("shard", [6 << 20, 60])
def test_collocations(spark, monkeypatch, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    rows = lines(3, 300) + [("en", None), (None, ""), ("de", " \n "), ("de", "x" * 50_000), ("fr", "long text " * 5_000), ("es", "A B C D E F. " * 9)]
    docs = spark.createDataFrame([(i, *r, "p", 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int").repartition(5)
    for least, best in ((5, 2000), (3, 7)):
        got = sorted(tuple(r) for r in phrases.collocations(docs, least=least, best=best).collect())
        assert got == brute.collocations(rows, least, 5, best)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_bitmaps_let_all_frequent_pass(spark, monkeypatch):
    """A bitmap of 64 bits, which nearly everything passes, changes the work and not the result."""
    rows = lines(4, 200)
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "BITMAP", 7)
    assert sorted(tuple(r) for r in phrases.collocations(docs, least=4).collect()) == brute.collocations(rows, 4, 5, 2000)


def test_counts_are_sent_once_a_core(spark, monkeypatch):
    """Splits of the input add to the rows that are shuffled no more than cores do, unless the counts held are too many."""
    docs = spark.createDataFrame([("en", " ".join(f"w{k}" for k in range(300)))] * 80, "lang string, text string")
    phrases.prepare(spark)
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for held in (phrases.HELD, 100):
            monkeypatch.setattr(phrases, "HELD", held)
            counts = phrases.phrase_counts(docs.repartition(40), 80)
            found = {r.phrase: r.n for r in counts.collect()}
            assert len(found) == 1 + sum(300 - k for k in range(5)) and {found.pop("")} == {80 * 300} and set(found.values()) == {80}
            if held > 100:
                node = counts._jdf.queryExecution().executedPlan()
                while node.nodeName() != "MapInArrow":
                    node = node.children().apply(0)
                assert node.metrics().apply("pythonNumRowsReceived").value() <= spark.sparkContext.defaultParallelism * (len(found) + 1)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)


def test_room_of_hash_counts():
    """A worker that counts pairs, nearly all different, takes a bounded room however many there are."""
    words = np.array([f"w{k}" for k in range(30_000)])
    texts = [" ".join(words[np.random.default_rng(k).integers(0, len(words), 1000)]) for k in range(3000)]
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"] * 500, "text": texts[k : k + 500]}) for k in range(0, len(texts), 500)]
    every = SimpleNamespace(value=np.full(1 << (phrases.BITMAP - 6), 2**64 - 1, np.uint64))
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in phrases._hash_counts((every, every), 2)(iter(batches)))
        room = tracemalloc.get_traced_memory()[1] + pa.default_memory_pool().max_memory()
    finally:
        tracemalloc.stop()
    assert found > 2_900_000
    assert room < 160 << 20, f"{room >> 20} MB"


def test_sums_of_packed_counts():
    """Like hashes' counts are added up; what passes 32 bits stays at the largest number that fits, which is frequent."""
    hashes = np.array([7, 9, 7, 2**31, 9], np.uint64) << np.uint64(32) | np.uint64(5)
    n = np.array([1, 2**32 - 3, 2, 2**40, 7])
    sums = phrases.hash_sums([phrases.packed(hashes[:2], n[:2]), phrases.packed(hashes[2:], n[2:])])
    assert [(int(x) >> 32, int(x) & (2**32 - 1)) for x in sums] == [(7, 3), (9, 2**32 - 1), (2**31, 2**32 - 1)]
    assert not len(phrases.hash_sums([phrases.packed(hashes[:0], n[:0])]))


def test_scores_beyond_64_bits(spark):
    """The score's products are decimals: 1000 a n of 10^24 stays exact."""
    a, n, l, r = 10**9 + 7, 10**12 + 39, 10**9 + 9, 10**9 + 21
    row = spark.createDataFrame([(a, n, l, r)], "a long, every long, l long, r long").select(phrases.cut_score().alias("s")).first()
    assert row.s == 1000 * a * n // (l * r)


def test_pairs_in_linear_time():
    """Half of the squared sum less the sum of squares is the sum over all pairs."""
    chance = np.random.default_rng(0)
    found = factorisation.features(pa.array(["some words and Some more, some", "", None, "one\none\n\none ###"]), [np.array([3.0, np.nan, 0.0, 1e9])])
    size = factorisation.size_of(1)
    machine = factorisation.Machine(0.3, chance.normal(size=size), chance.normal(size=(size, factorisation.FACTORS)))
    want = []
    for a, b in zip(found.first[:-1], found.first[1:]):
        x = list(zip(found.index[a:b], found.value[a:b].astype(float)))
        want.append(0.3 + sum(machine.weights[i] * v for i, v in x) + sum(machine.factors[i] @ machine.factors[j] * v * u for k, (i, v) in enumerate(x) for j, u in x[:k]))
    assert machine.margins(found) == pytest.approx(want)
    assert len(found.first) == 5 and found.index.max() < size


def test_slopes_of_the_fit():
    """One step of the fit goes down the slope of the plain loss, found by differences."""
    texts = [f"{'good calm' if i % 2 else 'bad junk'} w{i % 5} w{i % 7}" for i in range(40)]
    found, y = factorisation.features(pa.array(texts), []), np.arange(40) % 2 * 1.0
    model = factorisation.fit(found, y, factorisation.size_of(0), rounds=30)
    scores = 1 / (1 + np.exp(-model.margins(found)))
    assert ((scores > 0.5) == (y == 1)).all() and np.abs(scores - y).mean() < 0.2


def test_quality_classifier(spark, documents, prose):
    rows = [(i, f"{prose(20)} {'### $$$ %%% junk' if i % 3 == 0 else 'a calm sentence'}\n{prose(10)}") for i in range(300)] + [(900, ""), (901, None), (None, "no id"), (902, "x" * 50_000), (902, "long text " * 5_000), (3, "word")]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i, _ in rows[:300] if i % 7] + [(None, 1, 0), (4, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    got = factorisation.quality_scores(docs, labels, metadata=("n_chars", "n")).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(r.held_out == (r.doc_id is not None and brute.crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    late = [r for r in got if r.held_out and r.doc_id < 300]
    assert late and sum(r.predicted == (r.doc_id % 3 != 0) for r in late) >= 0.95 * len(late)
    # labels of held-out rows play no part, nor do labels, lang and source of docs
    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "label": F.lit("z")})
    again = factorisation.quality_scores(other, turned, metadata=("n_chars", "n")).collect()
    key = lambda rows: sorted((str(r.doc_id), r.score) for r in rows)
    assert [s for _, s in key(again)] == pytest.approx([s for _, s in key(got)], abs=1e-6)


def test_quality_classifier_without_labels(spark, documents):
    docs = documents([(1, "a b"), (2, "c")])
    for rows in ([], [(1, 1), (2, 1)]):
        got = factorisation.quality_scores(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect()
        assert len(got) == 2 and len({r.score for r in got}) == 1
    assert factorisation.quality_scores(documents([]), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_labelled_sample(spark):
    """At most as many as asked for, the lowest hashes of all, ties none."""
    known = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("label"))
    want = {r.doc_id for r in known.orderBy(F.xxhash64("doc_id")).limit(500).collect()}
    assert {r.doc_id for r in runtime.labelled_sample(known, 500).collect()} == want
    assert runtime.labelled_sample(known, 50_000).count() == 20_000 and runtime.labelled_sample(known.limit(0), 5).count() == 0
