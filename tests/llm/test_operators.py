"""The text operators against plain versions, and their results on edge cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewake.llm import decontaminate, jaccard, language_model, licenses, packing, pii, quality, secrets, tokens, toxicity, words
from tidewake.llm.components import connected_components

from . import brute

KNOWN = "all the world is a stage and all the men and women merely players"


@pytest.fixture(scope="session")
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def every(spark, model_path):
    """All operators as functions of documents."""
    bench = spark.createDataFrame([(1, KNOWN), (2, None), (None, KNOWN), (3, ""), (4, "word")], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    return {
        "op1": jaccard.ngram_jaccard,
        "op2": lambda d: tokens.token_counts(d, model_path),
        "op3": licenses.license_scan,
        "op4": lambda d: decontaminate.decontaminate(d, bench),
        "op5": lambda d: packing.pack(d, packing.word_count(F.col("text"))),
        "op6": language_model.score_texts,
        "op7": secrets.secret_scan,
        "op8": pii.personal_data,
        "op9": lambda d: toxicity.toxicity(d, labels),
        "op10": quality.quality_rules,
    }


@pytest.mark.parametrize("op", [f"op{i}" for i in range(1, 11)])
def test_edges(every, edges, documents, op):
    docs, rows = edges
    got = every[op](docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert every[op](documents([])).count() == 0


def test_components(spark):
    pairs = [(1, 2), (2, 3), (5, 4), (4, 4), (None, 6), (7, None), (2, 1)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {i: 100 for i in range(100, 161)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("repeated", [64, 3])
def test_jaccard(documents, prose, monkeypatch, repeated):
    chance, rows = random.Random(3), []
    for g in range(12):
        words = prose(chance.randrange(4, 90), 400).split()
        for _ in range(chance.randrange(1, 7)):
            own = list(words)
            for _ in range(chance.randrange(0, 4)):
                own[chance.randrange(len(own))] = f"e{chance.randrange(50)}"
            rows.append((len(rows) * 3 + 1, " ".join(own).upper() if chance.random() < 0.2 else " ".join(own)))
    common = prose(30, 500)  # a passage that many documents share, alone and with more
    rows += [(1000 + i, f"{common} {prose(i % 12, 900)}") for i in range(40)] + [(2000 + i, common) for i in range(30)]
    rows += [(3000, None), (3001, ""), (3002, "one"), (3003, "ONE"), (3004, "one two")]
    monkeypatch.setattr(jaccard, "TILE", 10)
    monkeypatch.setattr(jaccard, "REPEATED", repeated)
    monkeypatch.setattr(jaccard, "FREQUENT", 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard(documents(rows)).collect()}
    assert got == brute.components(rows)


def test_jaccard_family(documents, prose, monkeypatch):
    """A family of distinct near copies that is larger than a tile, with members that only link with some of the others."""
    chance, base = random.Random(4), prose(60, 4000).split()
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(chance.randrange(0, 4)):
            own[chance.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(jaccard, "TILE", 20)
    monkeypatch.setattr(jaccard, "REPEATED", 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard(documents(rows)).collect()}
    assert got == brute.components(rows)


def test_hashes_of_two_letters(spark, documents):
    """Thue-Morse orders of two letters or words and their complements, whose polynomials modulo 2**64 are equal, stay apart."""

    def order(n, x, y):
        for _ in range(n):
            x, y = x + y, y + x
        return "".join(x), "".join(y)

    a, b = order(10, ["a"], ["b"])
    u, v = order(11, ["ab "], ["ba "])
    filler = " ".join(f"w{i}" for i in range(30))
    rows = [(1, a), (2, b), (3, f"{a}\n{b}\n{filler}"), (4, u), (5, v)]
    assert {r.doc_id: r.component_id for r in jaccard.ngram_jaccard(documents(rows)).collect()} == {i: brute.components(rows)[i][1] for i, _ in rows}
    hits = decontaminate.decontaminate(documents(rows), spark.createDataFrame([(1, a)], "item_id long, text string"))
    assert {r.doc_id: r.n_hit for r in hits.collect()} == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0}
    assert {r.doc_id: r.n_dup_lines for r in quality.quality_rules(documents(rows)).collect()} == {i: 0 for i, _ in rows}
    assert {r.doc_id: r.n_known for r in language_model.score_texts(documents([(1, a), (2, b)]), folds=10, held_out=11).collect()} == {1: 2, 2: 2}


def test_token_counts(documents, model_path, prose):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    chance = random.Random(5)
    texts = [prose(50), "aaaa" * 900, "   two  spaces ", "▁ mark ▁", "tab\tand\nline\r\n", "<s> </s> <unk>", "Zürich 東京 🙂🙂   é", "a", None, "", " " * 40, "word " * 5000]
    texts += ["an" * 3000 + "banana" * 400, "".join(chance.choice("aeinrst") for _ in range(5000)), "=" * 5000, "=" * 37 + "-=" * 900]
    texts += ["".join(chance.choice("ab cde\n.,ß東▁<>0123") for _ in range(chance.randrange(1, 200))) for _ in range(60)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(documents(list(enumerate(texts))), model_path).collect()}
    want = {}
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        want[i] = (len((t or "").encode()), n, n > 4096)
    assert got == want


def test_licenses(documents, prose):
    rows = [(1, "Under the MIT license. CC-BY NC, under the mit license"), (2, "under the mit licenses"), (3, "Apache License, Version 2.0"), (4, None), (5, prose(80))]
    notice = licenses.TEMPLATES[1][1]
    rows += [(6, prose(20) + " " + notice + " " + prose(20)), (7, " ".join(notice.split()[:3])), (8, "cc by nc " * 400)]
    for r in licenses.license_scan(documents(rows)).collect():
        places = brute.phrase_places(dict(rows)[r.doc_id], licenses.PHRASES)
        starts = [i for _, i in places]
        assert (r.n_words, r.n_base) == (len(brute.plain_words(dict(rows)[r.doc_id])), len(places))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for x, _ in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.doc_id != 6 or r.labels == "mit") and (r.doc_id not in (5, 7) or r.labels == "")


def test_license_spans_are_verified(documents, prose):
    """Votes count where they stand in order within about a template's length, however many there are elsewhere."""
    words = licenses.TEMPLATES[0][1].split()
    half = len(words) // 2
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    joint = "a copy of " * 400
    changed = list(words)
    for i in (5, 14, 15):
        changed[i] = "other"
    added = words[:9] + ["so"] * 4 + words[9:17] + ["they", "say"] + words[17:]
    rows = [
        (1, " ".join(words[:half]) + f" {joint} " + " ".join(words[half:])), (2, " filler ".join(grams)), (3, " and so on ".join(reversed(grams))), (4, " ".join(reversed(words))),
        (5, " ".join(words[half:] + words[:half])), (6, " ".join(f"{prose(30)} {g}" for g in grams)), (10, " ".join(changed)), (11, f"{joint} {' '.join(words)} {joint}"), (12, " ".join(added)), (13, " ".join(words[:3] + words[5:])),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(documents(rows)).collect()}
    assert {i: r.labels for i, r in got.items()} == {i: "mit" if i >= 10 else "" for i, _ in rows}
    n = len(grams)
    assert got[11].score == 1 and got[10].score == pytest.approx((n - 7) / n) and got[13].score == pytest.approx((n - 4) / n) and got[12].score == pytest.approx((n - 4) / n)


@pytest.mark.parametrize("block", [16 << 20, 200])
def test_decontaminate(spark, documents, prose, block):
    items = [(i, prose(n, 30)) for i, n in enumerate((1, 3, 9, 10, 11, 25, 40, 10, 0))] + [(50, KNOWN), (51, KNOWN), (51, "Another, text of 51")]
    docs = [(i, prose(n, 30)) for i, n in enumerate((0, 5, 40, 300, 1300))] + [(10, "so: ALL the world is a stage, and all the men and women merely"), (11, "all the world is a stage"), (12, items[6][1] + " " + items[5][1]), (12, items[6][1] + " " + items[5][1]), (13, None)]
    docs += [(14, "another text of 51 another text of 51")]
    got = decontaminate.decontaminate(documents(docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
    want = [(i, *brute.benchmark_hits(t, items)) for i, t in docs]
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == sorted(want)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    carried = decontaminate.decontaminate(documents(docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block, row=F.struct("doc_id", "text", "c"))
    assert sorted((r.doc_id, r.n_hit, r.row.text or "") for r in carried.collect()) == sorted((i, w[2], t or "") for (i, t), w in zip(docs, want))


def test_patterns_stay_small(prose):
    """What is broadcast of a benchmark is some times its text, not a multiple for each word of a window."""
    import pickle

    import pyarrow as pa

    texts = [prose(50, 100_000) for _ in range(4000)]
    assert len(pickle.dumps(decontaminate.build_patterns(pa.array(texts), 10))) < 9 * sum(map(len, texts))


def test_bucket_boundaries():
    chance = random.Random(1)
    for _ in range(40):
        lengths = [chance.randrange(0, 40) for _ in range(chance.randrange(1, 30))]
        kinds, counts = np.unique(lengths, return_counts=True)
        for buckets in (1, 2, 4):
            ends = packing.boundaries(kinds.astype(float), counts, buckets)
            assert len(ends) <= buckets and sum(min(e for e in ends if e >= n) - n for n in lengths) == brute.least_padding(lengths, buckets)
    assert packing.boundaries(np.zeros(0), np.zeros(0, int), 4) == []


def test_packing(documents, prose, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 40)
    chance = random.Random(2)
    rows = [(i, prose(chance.choice((0, 1, 5, 30, 31, 200, 900)))) for i in range(200)] + [(7, "a b"), (500, prose(4000))]
    got = packing.pack(documents(rows), packing.word_count(F.col("text")), buckets=4, budget=2000).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((i, len(brute.space_words(t))) for i, t in rows)
    assert len({r.bucket for r in got}) <= 4 and all(r.n_tokens <= r.bucket for r in got)
    for b in {r.bucket for r in got}:
        most = max(1, 2000 // max(b, 1))
        places = sorted((r.batch, r.slot) for r in got if r.bucket == b)
        assert places == [divmod(i, most) for i in range(len(places))]


def test_packing_of_one_id(spark, monkeypatch):
    """Rows of one doc_id, or without any, are dealt over many slices, and places stay without gaps."""
    monkeypatch.setattr(packing, "SLICE", 20)
    docs = spark.createDataFrame([(None, 5 + i % 3) for i in range(300)] + [(i, 9) for i in range(60)], "doc_id long, n long")
    got = packing.pack(docs, F.col("n"), buckets=2, budget=100).collect()
    assert len(got) == 360 and sum(r.doc_id is None for r in got) == 300
    for b in {r.bucket for r in got}:
        assert sorted((r.batch, r.slot) for r in got if r.bucket == b) == [divmod(i, 100 // b) for i in range(sum(r.bucket == b for r in got))]


def test_packing_of_long_texts(spark):
    """Boundaries are optimal and buckets no longer than a text beyond 1,024 words too."""
    chance = random.Random(3)
    lengths = [chance.randrange(900, 30_000) for _ in range(60)] + [20_020] * 9
    docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    got = packing.pack(docs, F.col("n"), buckets=4, budget=65_536).collect()
    assert sum(r.bucket - r.n_tokens for r in got) == brute.least_padding(lengths, 4)
    assert {r.bucket for r in got} <= set(lengths) and max(r.bucket for r in got) == max(lengths)


def test_language_model(documents, prose):
    rows = [(i, f"{prose(12, 25)} the end of line" if i % 5 else None) for i in range(120)]
    want = brute.unigram_scores(rows)
    whole = language_model.score_texts(documents(rows)).collect()
    for got in (whole, language_model.score_texts(documents(rows), top=4).collect()):  # all but four tokens are joined
        for r in got:
            n, known, total, base = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, brute.crc(r.doc_id) % 10 == 0) and r.base_score == pytest.approx(base, abs=2e-6)
    late = [r for r in whole if r.held_out]
    assert late and sum(r.score for r in late) > sum(r.base_score for r in late) and all(r.score < 0 for r in whole)


def test_language_model_is_normalised():
    """Under any weights and history the tokens of the table and the sets of all others make up 1."""
    chance, size = np.random.default_rng(0), 37
    token, n = np.unique(chance.integers(1 << 20, 1 << 63, size).astype(np.uint64)), np.arange(1, size + 1)
    others = chance.random(1 << language_model.OTHER_BITS)
    total = (n + 0.1).sum() + others.sum()
    table = language_model.Table(language_model.vocabulary(token, n, others, total))
    every = np.concatenate([token, np.arange(len(others)).astype(np.uint64) << np.uint64(64 - language_model.OTHER_BITS)])
    rank = np.concatenate([table.look_up(token)[1], np.zeros(len(others), np.int64)])
    assert sorted(rank[:size]) == list(range(1, size + 1)) and (table.look_up(token)[0] == n).all() and not table.look_up(token + np.uint64(1))[1].any()
    weights = chance.normal(size=1 << 10).astype(np.float32)
    for history in range(4):
        gain = language_model.gains(table, weights, 10, every, rank, np.full((3, len(every)), history + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        assert (np.concatenate([n + 0.1, others]) / total * np.exp(gain)).sum() == pytest.approx(1, abs=1e-4)


def test_language_model_against_plain(documents, monkeypatch):
    """Scores are those of a plain trainer with a dictionary of weights over the same tree of choices."""
    chance = random.Random(12)
    rows = [(i, " ".join(f"w{chance.randrange(12)}" for _ in range(9)) + " the end") for i in range(40)]
    seen = []
    make = language_model.vocabulary
    monkeypatch.setattr(language_model, "LEAST_BITS", 22)  # next to no weights share a place
    monkeypatch.setattr(language_model, "vocabulary", lambda *a: seen.append(make(*a)) or seen[-1])
    got = {r.doc_id: r.score - r.base_score for r in language_model.score_texts(documents(rows).coalesce(2)).collect()}
    want = brute.history_gains(rows, language_model, seen[0])
    differ = sorted(abs(got[i] - want[i]) for i, _ in rows)
    assert differ[20] < 1e-3 and differ[-1] < 0.1, differ


def test_language_model_sums_do_not_saturate(monkeypatch):
    """20 million equal histories in one task: expectations go on adding up, where 32-bit sums stop at 2^23 or 2^24."""
    import pyspark
    from types import SimpleNamespace

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    texts, each = 10, 2_000_000
    token = np.sort(words.find_words(pa.array(["a b c"])).hashes)
    v = language_model.vocabulary(token, np.array([5, 3, 2]), np.full(1 << language_model.OTHER_BITS, 1e-3), 14.0)
    column = pa.array(["a " * each] * texts)
    (batch,) = language_model._gather(SimpleNamespace(value=(v, None, 10)), True)(iter([pa.RecordBatch.from_arrays([column], ["text"])]))
    expected, right, n = (np.concatenate([np.frombuffer(t.as_py(), np.float32).reshape(3, -1)[k] for t in batch.column(2)]) for k in range(3))
    most = n.argmax()
    assert n[most] == pytest.approx(texts * (each - 2), rel=1e-5) and right.max() <= n[most]
    table = language_model.Table(v)
    assert np.abs(expected[most] / n[most] - 1 / (1 + np.exp(-table.odds.astype(float)))).min() < 1e-4


def test_language_model_sums_in_a_tree(spark, documents, prose, monkeypatch):
    """Sums over many tasks by groups of two are those of one task."""
    docs = documents([(i, prose(9, 25)) for i in range(60)])
    one = {r.doc_id: r.score for r in language_model.score_texts(docs.coalesce(1)).collect()}
    monkeypatch.setattr(language_model, "TREE", 2)
    many = {r.doc_id: r.score for r in language_model.score_texts(docs.repartition(11, "doc_id")).collect()}
    assert all(many[i] == pytest.approx(one[i], abs=1e-3) for i in one)


def test_language_model_partitions(documents, prose):
    """A history of one place of the corpus weighs alike at every partition count."""
    rows = [(i, f"{prose(12, 25)} the end of line") for i in range(120)] + [(i, "zig zag zog " * 8) for i in (1001, 1002)]
    few, many = ({r.doc_id: (r.score, r.base_score) for r in language_model.score_texts(documents(rows).repartition(n, "doc_id")).collect()} for n in (1, 24))
    assert all(many[i][0] == pytest.approx(few[i][0], abs=1e-3) for i, _ in rows)
    assert all(many[i][0] > many[i][1] + 1 for i in (1001, 1002))


def test_secrets(documents):
    rows = [(i, "password = hunter2xyz and token: 'abc' API_KEY=abcdef") for i in range(4)]
    rows += [(10, "é🙂 AKIA" + "Z9" * 8 + "x AKIA12 " + "0123456789abcdef" * 2 + " deadbeef"), (11, 'Secret"  :  "s3cr3t/+==" passwd:=zzzzzzz'), (12, None), (13, "token=tokens=password=abcdefgh"), (14, "token = q1w2e3r4 " * 600), (15, "ghp_" + "a1B2" * 8)]
    for r in secrets.secret_scan(documents(rows)).collect():
        base = brute.secrets(dict(rows)[r.doc_id])
        joined = brute.digest([b[:3] for b in base], ["assign", "access", "hex"])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[1] == k for b in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) - {""} <= set(r.spans.split(",")), (r.doc_id, joined[:200], r.spans[:200])
        assert r.n_live == (0 if r.doc_id < 4 else 1 if r.doc_id == 15 else len(base))  # what four owners share is an example


def test_secret_owners_and_repositories(documents):
    """A value is common by its owners or by its repositories alone."""
    docs = documents([(i, "token = onlyone1") for i in range(4)] + [(10 + i, "token = another2") for i in range(2)], sources=("a", "b", "c", "d"))
    live = lambda **k: {r.doc_id: r.n_live for r in secrets.secret_scan(docs, **k).collect()}
    assert live(owner="source", repository="label", common_owners=3, common_repositories=9) == {0: 0, 1: 0, 2: 0, 3: 0, 10: 1, 11: 1}
    assert live(owner="label", repository="source", common_owners=9, common_repositories=2) == {0: 0, 1: 0, 2: 0, 3: 0, 10: 0, 11: 0}
    assert set(live(owner="label", repository="label", common_owners=2, common_repositories=2).values()) == {1}


def test_personal_data(documents):
    cards = "4111 1111 1111 1111, 4111-1111-1111-1112, 378282246310005 0000"
    rows = [(1, "Mail a.b+c@x-y.co.uk, é🙂 d@e.f..g @h@i.j k@l"), (2, "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 99999999999.1.1.1"), (3, cards), (4, "+1 (555) 010-9999 +12 345 +1234567890123456 +44 20 7946 0958."), (5, None)]
    rows += [(6, "x@" * 5000 + "y.z"), (7, "1 2 " * 4000), (8, "+1 555 010 9999 " * 300), (9, "a@b.cc@d.ee")]
    for r in pii.personal_data(documents(rows)).collect():
        base = brute.personal(dict(rows)[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[1] == k for b in base) for k in pii.KINDS[:4]), r.doc_id
        joined = brute.digest(base, list(pii.KINDS))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_personal_data_beyond_patterns(documents, prose):
    """Spelled out addresses, national numbers and disguised quads are added; look-alikes that break a rule or lack context are not."""
    chance, rows = random.Random(6), []
    for i in range(400):
        mail, host = f"ann{i}@site{i % 7}.{chance.choice(['com', 'org'])}", ".".join(str(chance.randrange(256)) for _ in range(4))
        rows.append((i, f"{prose(5)} mail {mail} or call +44 20 7946 {1000 + i} from host {host} {prose(4)}"))
        rows.append((1000 + i, f"{prose(5)} we stayed at home.then{i} left, build 1.{300 + i}.2.{i} and order {chance.randrange(10**13, 10**14)} {prose(4)}"))
    planted = {5000: "contact jane.doe at example dot com today", 5001: "mail bob (at) site (dot) org now", 5002: "from host 10[.]1[.]2[.]3 again", 5003: "call (020) 7946-1234 soon"}
    clean = {6000: "we stayed at home.then left", 6001: "build 1.300.2.4 of it", 6002: "order 12345678901234 came"}
    got = {r.doc_id: r for r in pii.personal_data(documents(rows + [*planted.items(), *clean.items()])).collect()}
    caught = [i for i in planted if got[i].n_other]
    assert {5000, 5001, 5002} <= set(caught), caught
    assert not any(got[i].n_other for i in clean) and not any(got[1000 + i].n_other for i in range(400))
    start = planted[5000].index("jane")
    assert f"other:{start}:{start + len('jane.doe at example dot com')}" in got[5000].spans.split(",")


def test_toxicity(spark, documents, prose):
    rows = [(i, f"{prose(20)} {'you vile rotten scum' if i % 3 == 0 else 'have a lovely calm day'} {prose(10)}") for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows if i % 7], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(documents(rows + [(999, "")]), labels).collect()
    assert all(r.held_out == (brute.crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    late = [r for r in got if r.held_out and r.doc_id < 999]
    assert late and all(r.predicted == (r.doc_id % 3 == 0) for r in late)
    # labels of held-out rows play no part
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(documents(rows + [(999, "")]), turned).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-9) for r in got)


def test_toxicity_against_plain(spark, documents, prose):
    chance = random.Random(8)
    rows = [(i, f"{prose(6, 40)} {chance.choice(['vile scum', 'rotten fool']) if i % 3 == 0 else chance.choice(['calm day', 'kind friend'])} {prose(3, 40)}") for i in range(90)] + [(500, None)]
    labels = [(i, int(i % 3 == 0)) for i in range(0, 90) if i % 7]
    want = brute.toxicity_scores(rows, labels)
    got = toxicity.toxicity(documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    # the bias alone, which an empty text gets, is hardly determined by separable classes and settles last
    assert all(r.score == pytest.approx(want[r.doc_id], abs=0.02) for r in got if r.doc_id < 500) and all(r.predicted == 0 for r in got if r.doc_id == 500)


def test_toxicity_without_features(spark, documents):
    rows = [(i, f"{chr(97 + i)}{i}") for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity.toxicity(documents(rows), labels).collect()
    assert len(got) == 20 and len({r.score for r in got}) == 1


def test_quality(documents, prose):
    rows = [(i, prose(n, k)) for i, (n, k) in enumerate([(0, 5), (19, 50), (20, 50), (200, 4), (200, 9), (300, 1000), (60, 1)])]
    run = prose(130, 5000)
    rows += [(10, f"{run}\n{prose(400, 5000)}\n{run}"), (11, "same line here\n" * 9 + "\n \n" + prose(30)), (12, "#*$%&|<> é🙂 a\tb\r\nA a"), (13, None), (14, "ab " * 301)]
    for r in quality.quality_rules(documents(rows)).collect():
        assert tuple(r[1:]) == brute.quality(dict(rows)[r.doc_id]), r.doc_id
