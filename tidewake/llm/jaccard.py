"""N-gram Jaccard self-join: size-banded tiles, hashed bitmap signatures, exact intersections.

1. Documents with the same words form one class; everything below joins classes, so copies are never paired.
2. One global order of all shingles: those of low hash first, rarest first by the number of classes that have them; then
   the others by hash; last the few that are frequent in any part of the corpus. Two sets whose similarity reaches the
   threshold share a shingle of their prefixes under any one order, so the order only decides how much work there is.
   A class whose prefix holds only shingles of its own has no partner and is done.
3. Classes that share a prefix shingle and a size band, or neighbouring ones, go to the tile of the least key among them.
4. In a tile, sets are sorted by size; a pair's parity bitmaps bound its overlap from above by the count of differing
   bits. First only bitmaps go to the tiles, and members for which no partner passes are left out.
5. The texts of the others follow. Pairs that pass the bound have their sorted arrays intersected; pairs already
   connected are skipped, and a tile returns a spanning forest of its links instead of all pairs.
   A large tile is dealt over many tasks: first all members meet the least key alone; then those that don't link with
   it meet all others, block by block. A family of copies is done after the first step, whatever its size.
6. Connected components of the links give each document the smallest id it reaches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import bounded, most_frequent, prepare, workspace, written
from .words import find_words, mix, sequence_hash, signed, sliced, text_grams

#: Shingles that a task holds before it passes on counts or entries, and texts of such a load from which a shingle's count is passed on.
LOAD, REPEATED = 4_000_000, 64
#: Most entries of the table of frequent shingles (12 bytes each). Beyond it the most frequent stay; results don't change.
FREQUENT = 1 << 18
#: Hashes below this are counted; the share of shingles is 0.4, twice what a prefix takes.
COUNTED = int(0.4 * 2**64)
#: Entries of a bucket; classes of a tile that one task handles, and shingles of all of them.
BUCKET_ENTRIES, TILE, TILE_SHINGLES = 200_000, 500, 2_000_000
#: Bits of a bitmap are a power of two between these.
FEWEST_BITS, MOST_BITS = 64, 4096
#: Prefix candidate: shingle, class, set size, and how many of the class's entries are counted (0: all are in the prefix anyway).
ENTRY = np.dtype([("gram", "<u8"), ("key", "<u8"), ("n", "<u4"), ("counted", "<u4")])


def _needed(n: int, percent: int) -> int:
    """The least overlap with any set that is similar enough to one of n members."""
    return (n * percent + 99) // 100


def _digest(k: int):
    """(doc_id, key of the word sequence, set size), and rows of frequent shingles: (null, shingle, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            grams, n = signed(grams[n >= REPEATED]), n[n >= REPEATED]
            return _rows("gram", np.zeros(len(grams), np.int64), grams, n, [b""] * len(grams))

        for batch in batches:
            ids = batch.column(0)
            for a, b in sliced(batch.column(1)):
                words = find_words(batch.column(1).slice(a, b - a))
                keys, sizes, maps = [], [], []
                for own, grams in text_grams(words, k):
                    keys.append(sequence_hash(own) if len(own) else 0)
                    sizes.append(len(grams))
                    maps.append(parity_bitmap(grams).tobytes())
                    held.append(grams)
                    size += len(grams)
                yield _rows("doc", ids.slice(a, b - a), signed(np.array(keys, np.uint64)), np.array(sizes), maps)
                if size > LOAD:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return run


def _rows(kind: str, ids, keys: np.ndarray, n: np.ndarray, maps: list[bytes]) -> pa.RecordBatch:
    ids = pa.array(ids) if isinstance(ids, np.ndarray) else ids.cast(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.string()), ids, pa.array(keys, pa.int64()), pa.array(np.asarray(n, np.int64)), pa.array(maps, pa.binary())], ["kind", "doc_id", "key", "n", "map"])


def _entries(k: int, percent: int, buckets: int, frequent):
    """Prefix candidates of each class that a task meets, packed by bucket: by shingle, those of frequent shingles by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = frequent.value
        seen: set[int] = set()
        held: list[np.ndarray] = []
        late: list[np.ndarray] = []
        size = 0

        def entries(grams: np.ndarray, key: int, n: int, counted: int) -> np.ndarray:
            out = np.empty(len(grams), ENTRY)
            out["gram"], out["key"], out["n"], out["counted"] = grams, key, n, counted
            return out

        def packed() -> pa.RecordBatch:
            own, often = (np.concatenate([*x, np.empty(0, ENTRY)]) for x in (held, late))
            bucket = np.concatenate([mix(own["gram"]) % np.uint64(buckets), mix(often["key"]) % np.uint64(buckets) + np.uint64(buckets)]).astype(np.int32)
            own = np.concatenate([own, often])
            order = np.argsort(bucket, kind="stable")
            own, bucket = own[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            parts = [x.tobytes() for x in np.split(own, cut[1:])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(parts, pa.binary())], ["bucket", "entries"])

        for batch in batches:
            for a, b in sliced(batch.column(0)):
                words = find_words(batch.column(0).slice(a, b - a))
                for own, grams in text_grams(words, k):
                    n = len(grams)
                    if not n or (key := sequence_hash(own)) in seen:
                        continue
                    seen.add(key)
                    p = n - _needed(n, percent) + 1
                    at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
                    often = known[at] == grams if len(known) else np.zeros(n, bool)
                    rare = grams[~often]
                    counted = int(np.searchsorted(rare, np.uint64(COUNTED)))
                    held.append(entries(rare[: max(counted, p)], key, n, counted if counted >= p else 0))
                    if len(rare) < p:
                        late.append(entries(grams[often][np.argsort(rank[at[often]], kind="stable")][: p - len(rare)], key, n, 0))
                    size += max(counted, p)
            if size > LOAD // 4:
                yield packed()
                held, late, seen, size = [], [], set(), 0
        if held:
            yield packed()

    return run


def _shared(buckets: int):
    """Entries of a bucket whose shingle other classes have as well, with the number of classes; all of frequent shingles."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.frombuffer(e, ENTRY) for e in group["entries"]])
        x = x[np.lexsort((x["key"], x["gram"]))]
        fresh = np.ones(len(x), bool)
        fresh[1:] = (x["gram"][1:] != x["gram"][:-1]) | (x["key"][1:] != x["key"][:-1])  # copies met in several tasks
        x = x[fresh]
        start = np.flatnonzero(np.append(True, x["gram"][1:] != x["gram"][:-1]))
        times = np.diff(np.append(start, len(x)))
        times = np.repeat(times, times)
        if int(key[0]) < buckets:
            x, times = x[times > 1], times[times > 1]
        return pd.DataFrame({"key": signed(x["key"]), "gram": signed(x["gram"]), "n": x["n"].astype(np.int64), "counted": x["counted"].astype(np.int64), "times": times.astype(np.int64)})

    return run


def _prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """(key, gram, n): the shared shingles of each class's prefix. Those of the class alone come first and take their places."""
    by = Window.partitionBy("key")
    place = F.row_number().over(by.orderBy("times", "gram")) + F.col("counted") - F.count("*").over(by)
    chosen = shared.where("counted > 0").withColumn("place", place).where(F.expr(f"place <= n - (n * {percent} + 99) div 100 + 1"))
    return chosen.select("key", "gram", "n").unionAll(shared.where("counted = 0").select("key", "gram", "n"))


def _tiled(prefixes: DataFrame, percent: int) -> DataFrame:
    """(tile, key): classes with a prefix shingle in common, of one size band or the one below it, by their least key.

    Bands are a little wider than the threshold's ratio, so the sizes of a linked pair differ by one band at most.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) * 1.000001)).cast("int") if percent < 100 else F.col("n").cast("int")
    each = prefixes.withColumn("band", band).withColumn("b", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    met = each.groupBy("gram", "b").agg(F.min("key").alias("leader"), F.count("*").alias("m"), F.max(F.col("b") == F.col("band")).alias("own")).where("m > 1 and own")
    return each.join(met.select("gram", "b", "leader"), ["gram", "b"]).select(F.xxhash64("leader", "b").alias("tile"), "key").distinct()


class Forest:
    """Union-find over positions, with labels in one array."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, j: int) -> None:
        self.label[self.label == self.label[j]] = self.label[i]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum()) if len(b) else 0


def parity_bitmap(grams: np.ndarray) -> np.ndarray:
    """64-bit words: bit i is the parity of how many members hash to i, of as many bits as members or more."""
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << max(0, len(grams) - 1).bit_length()))
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


class Bitmaps:
    """Bitmaps of sets in order of size, for upper bounds of overlaps. A bitmap folds in half to the next smaller size."""

    def __init__(self, maps: list[np.ndarray], sizes: np.ndarray, percent: int):
        self.sizes, self.percent = sizes, percent
        self.width = np.array([len(m) for m in maps], np.int64)
        # sizes ascend, so sets of one width are neighbours
        self.own, self.half = {}, {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            block = np.stack([maps[i] for i in at])
            self.own[w] = (at[0], block)
            if w > 1:
                self.half[w // 2] = (at[0], block[:, : w // 2] ^ block[:, w // 2 :])
        self.last = np.searchsorted(100 * sizes, 100 * sizes * 100 // percent, "right")  # end of each set's size band

    def partners(self, i: int) -> np.ndarray:
        """The larger sets of i's size band whose overlap with i may suffice."""
        w, found = int(self.width[i]), []
        mine = self.own[w][1][i - self.own[w][0]]
        for first, block in filter(None, (self.own.get(w), self.half.get(w))):
            a, b = max(i + 1, first), min(int(self.last[i]), first + len(block))
            if a < b:
                differ = np.bitwise_count(block[a - first : b - first] ^ mine).sum(1, dtype=np.int64)
                both = self.sizes[a:b] + self.sizes[i]
                found.append(a + np.flatnonzero((100 + self.percent) * ((both - differ) // 2) >= self.percent * both))
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def hopeful(maps: list[np.ndarray], sizes: list[int], percent: int) -> list[int]:
    """Positions of the sets with at least one partner that the bitmaps don't rule out."""
    n = np.array(sizes, np.int64)
    order = np.argsort(n, kind="stable")
    bitmaps, alive = Bitmaps([maps[i] for i in order], n[order], percent), np.zeros(len(maps), bool)
    for i in range(len(maps)):
        j = bitmaps.partners(i)
        alive[j] = True
        alive[i] |= len(j) > 0
    return order[alive].tolist()


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose similarity reaches percent."""
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    enough = lambda i, j: (100 + percent) * overlap(sets[i], sets[j]) >= percent * int(n[i] + n[j])
    if len(sets) == 2:
        i, j = order.tolist()
        return [(i, j)] if 100 * n[i] >= percent * n[j] and enough(i, j) else []
    bitmaps, forest, links = Bitmaps([parity_bitmap(sets[i]) for i in order], n[order], percent), Forest(len(sets)), []
    for i in range(len(sets)):
        for k in bitmaps.partners(i).tolist():
            if forest.label[i] != forest.label[k] and enough(order[i], order[k]):
                forest.join(i, k)
                links.append((int(order[i]), int(order[k])))
    return links


def _prune(percent: int):
    """Rows (tile, key, doc_id, n, map) in order of tile to rows (tile, key, doc_id) of the members that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, seen = None, [], set()
        out: list[tuple[int, int, int]] = []

        def close() -> None:
            if len(rows) > 1:
                out.extend((tile, *rows[i][:2]) for i in hopeful([r[3] for r in rows], [r[2] for r in rows], percent))

        for batch in batches:
            tiles, keys, ids, n = (batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(4))
            for i, data in enumerate(batch.column(4)):
                if tiles[i] != tile:
                    close()
                    tile, rows, seen = tiles[i], [], set()
                if keys[i] not in seen:
                    seen.add(keys[i])
                    rows.append((keys[i], ids[i], n[i], np.frombuffer(data.as_py(), np.uint64)))
            if len(out) > 10_000:
                yield _longs(out, "tile", "key", "doc_id")
                out.clear()
        close()
        yield _longs(out, "tile", "key", "doc_id")

    return run


def _longs(rows: list[tuple], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], list(names))


def _tiles(k: int, percent: int):
    """Rows (tile, doc_id, key, text) in order of tile to links (a, b) of doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, sets, seen = None, [], [], set()
        out: list[tuple[int, int]] = []

        def close() -> None:
            out.extend((ids[i], ids[j]) for i, j in linked(sets, percent))

        for batch in batches:
            tiles, docs, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for a, b in sliced(batch.column(3)):
                words = find_words(batch.column(3).slice(a, b - a))
                for i, (own, grams) in enumerate(text_grams(words, k), a):
                    if tiles[i] != tile:
                        if len(sets) > 1:
                            close()
                        tile, ids, sets, seen = tiles[i], [], [], set()
                    # a repeated doc_id may bring another text: the key tells which one is meant
                    key = int(keys[i])
                    if key not in seen and len(own) and sequence_hash(own) == key % (1 << 64):
                        seen.add(key)
                        ids.append(int(docs[i]))
                        sets.append(grams)
            if out:
                yield _longs(out, "a", "b")
                out.clear()
        if len(sets) > 1:
            close()
        yield _longs(out, "a", "b")

    return run


def _star(k: int, percent: int):
    """Rows (tile, piece, leads, key, doc_id, text), each piece with its leader first: whether each other row links with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, leader = None, None
        for batch in batches:
            tiles, pieces, leads, keys, docs = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            out: list[tuple[int, int, int, int, int]] = []
            for a, b in sliced(batch.column(5)):
                words = find_words(batch.column(5).slice(a, b - a))
                for i, (own, grams) in enumerate(text_grams(words, k), a):
                    if piece != (tiles[i], pieces[i]):
                        piece, leader = (tiles[i], pieces[i]), None
                    if not len(own) or sequence_hash(own) != int(keys[i]) % (1 << 64):
                        continue
                    if leads[i]:
                        leader = int(docs[i]), grams
                    elif leader:
                        both = len(grams) + len(leader[1])
                        out.append((int(tiles[i]), int(keys[i]), int(docs[i]), leader[0], int((100 + percent) * overlap(grams, leader[1]) >= percent * both)))
            yield _longs(out, "tile", "key", "doc_id", "leader", "linked")

    return run


def _frequent(spark: SparkSession, digest: DataFrame):
    """The most frequent shingles with a rank by the power of two of their count; at most FREQUENT rows reach the driver."""
    rows = most_frequent(digest.where("kind = 'gram'").groupBy("key").agg(F.sum("n").alias("n")), FREQUENT).select("key", F.floor(F.log2("n")).cast("int").alias("rank")).toArrow()
    grams = rows.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return spark.sparkContext.broadcast((grams[order], rows.column("rank").to_numpy()[order].astype(np.int32)))


def _large_tiles(members: DataFrame, large: DataFrame, docs: DataFrame, k: int, percent: int, n: int, home: str) -> tuple[DataFrame, DataFrame]:
    """Links of large tiles with their leaders, and tiles for what is left: rows (tile, key, doc_id, n) of bounded tiles."""
    big = members.join(bounded(large), "tile")
    block = lambda parts: F.pmod(F.xxhash64("key"), parts).cast("int")
    pieces = F.when(F.col("key") == F.col("leader"), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array(block(F.col("pieces"))))
    dealt = big.select("tile", F.explode(pieces).alias("piece"), (F.col("key") == F.col("leader")).alias("leads"), "key", "doc_id")
    star = docs.join(bounded(written(dealt, f"{home}/dealt")), "doc_id").select("tile", "piece", "leads", "key", "doc_id", "text").repartition(n, "tile", "piece").sortWithinPartitions("tile", "piece", F.desc("leads"))
    star = written(star.mapInArrow(_star(k, percent), "tile long, key long, doc_id long, leader long, linked long"), f"{home}/star")
    rest = star.where("linked = 0").select("tile", "key").distinct()
    blocks = rest.groupBy("tile").agg(F.count("*").alias("rest")).join(large, "tile").select("tile", F.ceil(F.col("rest") * F.col("pieces") / F.col("m")).cast("int").alias("rows"), F.col("pieces").alias("columns"))
    blocks = bounded(written(blocks, f"{home}/blocks"))
    again = members.join(blocks, "tile")
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    across = again.withColumn("i", every(F.col("rows"))).withColumn("j", block(F.col("columns")))
    down = again.join(rest, ["tile", "key"], "left_semi").withColumn("i", block(F.col("rows"))).withColumn("j", every(F.col("columns")))
    left = across.unionByName(down).select(F.xxhash64("tile", "i", "j").alias("tile"), "key", "doc_id", "n")
    return star.where("linked = 1").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")), left


def ngram_jaccard(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate components of documents by the Jaccard similarity of their sets of k-word shingles.

    Takes columns doc_id and text; others are ignored. Words are runs of non-space characters, A-Z in lower case; a text
    of fewer than k words is one shingle. Two documents link when 100 * intersection >= percent * union.
    Returns a row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable, its own included).
    Null and empty texts have no shingles and stay alone. Rows with a null doc_id come back with the component of
    their text, null if that has no other row. Repeated rows come back as often as they came. Whole texts are used,
    however long. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    home, partitions = workspace(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest = written(docs.mapInArrow(_digest(k), "kind string, doc_id long, key long, n long, map binary"), f"{home}/digest")
    own = digest.where("kind = 'doc'").drop("kind")
    shingles = own.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions, int(shingles * 0.4 / BUCKET_ENTRIES))
    entries = docs.select("text").mapInArrow(_entries(k, percent, buckets, _frequent(spark, digest)), "bucket int, entries binary")
    shared = written(entries.groupBy("bucket").applyInPandas(_shared(buckets), "key long, gram long, n long, counted long, times long"), f"{home}/shared")
    classes = own.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")).where("doc_id is not null")
    members = written(_tiled(_prefixes(shared, percent), percent).join(classes, "key").select("tile", "key", "doc_id", "n"), f"{home}/members")
    pieces = F.ceil(F.greatest(F.col("m") / TILE, F.col("w") / TILE_SHINGLES) * 2).cast("int")
    sizes = members.groupBy("tile").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.min("key").alias("leader")).withColumn("pieces", pieces)
    large = written(sizes.where("pieces > 2 and m > 2").select("tile", "m", "leader", "pieces"), f"{home}/large")
    n = max(partitions, buckets // 2)
    found = None
    if not large.isEmpty():
        found, left = _large_tiles(members, large, docs, k, percent, n, home)
        members = members.join(bounded(large.select("tile")), "tile", "left_anti").unionByName(left)
    maps = own.where("n > 0").dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "map")
    mapped = members.join(maps, ["doc_id", "key"]).select("tile", "key", "doc_id", "n", "map")
    pruned = mapped.repartition(n, "tile").sortWithinPartitions("tile").mapInArrow(_prune(percent), "tile long, key long, doc_id long")
    texts = docs.join(bounded(written(pruned, f"{home}/pruned")), "doc_id").select("tile", "doc_id", "key", "text")
    links = texts.repartition(n, "tile").sortWithinPartitions("tile").mapInArrow(_tiles(k, percent), "a long, b long")
    links = written((links.unionByName(found) if found else links).distinct(), f"{home}/links")
    parts = connected_components(links)
    label = classes.join(parts, F.col("doc_id") == F.col("node"), "left").select("key", F.coalesce("component", "doc_id").alias("component_id"))
    return own.drop("map").join(label, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
