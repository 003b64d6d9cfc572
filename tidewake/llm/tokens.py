"""Token counts by rank-synchronous array merging.

A batch's pre-tokens are ragged numpy arrays of symbols. Each step finds every sequence's lowest-rank pair, merges all
places of it in all sequences at once, from left to right, and drops the sequences that have no pair left; the symbols
that survive are the tokens. A place whose merge makes a pair of no higher rank ends its sequence's step, as that pair
comes next; so the result is that of one merge at a time, while the steps follow the number of different pairs, not the
length of a sequence. Each distinct pre-token of a task is merged once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare
from .words import column_bytes, sliced, span_hashes

#: The character that stands for a space in the vocabulary.
SPACE = "▁"
NEVER = np.iinfo(np.int32).max
#: Distinct pre-tokens that a task remembers.
REMEMBERED = 2_000_000
#: Bytes of new pre-tokens that are merged together.
TOGETHER = 4 << 20


@dataclass
class Merges:
    """A vocabulary as arrays: characters, pairs that merge, and neighbours that may stand inside a piece."""

    chars: np.ndarray  # sorted code points that are pieces
    char_ids: np.ndarray
    pairs: np.ndarray  # sorted left * size + right
    ranks: np.ndarray
    merged: np.ndarray
    inside: np.ndarray  # sorted left * 2**21 + right of code points
    size: int


def load_merges(path: str) -> Merges:
    """Read a sentencepiece BPE model with byte fallback, identity normalisation and a dummy prefix."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    ids = {model.id_to_piece(i): i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    if any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE) for p in ids):
        raise ValueError("pieces that join words aren't supported")
    scores = {p: model.get_score(i) for p, i in ids.items()}
    rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
    found = sorted((ids[p[:k]] * n + ids[p[k:]], rank[scores[p]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
    chars = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
    inside = sorted({(ord(a) << 21) + ord(b) for p in ids for a, b in zip(p, p[1:])})
    pairs, ranks, merged = (np.array(x, np.int64) for x in zip(*found))
    return Merges(*(np.array(x, np.int64) for x in zip(*chars)), pairs, ranks.astype(np.int32), merged, np.array(inside, np.int64), n)


def _look_up(m: Merges, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged symbol of each pair; NEVER for pairs that don't merge. Unknown characters are below 0."""
    key = left * m.size + right
    at = np.minimum(np.searchsorted(m.pairs, key), len(m.pairs) - 1)
    hit = (m.pairs[at] == key) & (left >= 0) & (right >= 0)
    return np.where(hit, m.ranks[at], NEVER), m.merged[at]


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where characters of UTF-8 bytes start, their code points and their lengths in bytes."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(start, len(data)))
    first = data[start].astype(np.int64)
    point = np.where(size == 1, first, first & (0x7F >> size))
    for k in range(1, 4):
        more = size > k
        point[more] = (point[more] << 6) | (data[start[more] + k] & 0x3F)
    return start, point, size


def _ragged(lengths: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(lengths)[:-1])


def merge_all(m: Merges, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Symbols left of each sequence (from starts[i] to the next start) when no pair of it merges any more."""
    lengths = np.diff(np.append(starts, len(symbols)))
    out, which = lengths.copy(), np.flatnonzero(lengths > 1)
    symbols, lengths = symbols[np.repeat(lengths > 1, lengths)], lengths[which]
    if not len(which):
        return out
    starts = _ragged(lengths)
    rank, merged = np.full(len(symbols), NEVER, np.int32), np.zeros(len(symbols), np.int64)
    rank[:-1], merged[:-1] = _look_up(m, symbols[:-1], symbols[1:])
    rank[starts + lengths - 1] = NEVER
    while True:
        least = np.minimum.reduceat(rank, starts)
        going = least < NEVER
        if not going.all():
            keep = np.repeat(going, lengths)
            which, lengths, least = which[going], lengths[going], least[going]
            symbols, rank, merged = symbols[keep], rank[keep], merged[keep]
            if not len(which):
                return out
            starts = _ragged(lengths)
        # places of the least pair; of overlapping ones every second
        at = np.flatnonzero(rank == np.repeat(least, lengths))
        head = np.append(True, np.diff(at) > 1)
        run = np.flatnonzero(head)
        at = at[(np.arange(len(at)) - run[np.cumsum(head) - 1]) % 2 == 0]
        owner = np.searchsorted(starts, at, "right") - 1
        # up to the first whose merge makes a pair of no higher rank
        new, ends = merged[at], starts + lengths
        before, after = symbols[at - 1], symbols[np.minimum(at + 2, len(symbols) - 1)]
        chained = np.append(False, np.diff(at) == 2)
        before[chained] = new[np.flatnonzero(chained) - 1]
        made = np.minimum(
            np.where(at > starts[owner], _look_up(m, before, new)[0], NEVER),
            np.where(at + 2 < ends[owner], _look_up(m, new, after)[0], NEVER),
        )
        early = made <= least[owner]
        if early.any():
            seen = np.cumsum(early) - early
            fine = seen == seen[np.searchsorted(owner, owner)]
            at, owner = at[fine], owner[fine]
        symbols[at] = merged[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, rank, merged = symbols[keep], rank[keep], merged[keep]
        gone = np.bincount(owner, minlength=len(which))
        out[which] -= gone
        lengths = lengths - gone
        starts = _ragged(lengths)
        at = at - np.arange(len(at))
        last = at + 1 == (starts + lengths)[owner]
        rank[at[last]] = NEVER
        right, left = at[~last], at[at > starts[owner]]
        rank[right], merged[right] = _look_up(m, symbols[right], symbols[right + 1])
        rank[left - 1], merged[left - 1] = _look_up(m, symbols[left - 1], symbols[left])


def count_spans(m: Merges, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens of each byte range, each being spaces followed by other characters, or either alone."""
    if not len(starts):
        return np.zeros(0, np.int64)
    lengths = ends - starts
    first = np.append(0, np.cumsum(lengths)[:-1])
    data = data[np.repeat(starts - first, lengths) + np.arange(lengths.sum())]
    at, point, size = _code_points(data)
    point[point == 0x20] = ord(SPACE)
    of = np.minimum(np.searchsorted(m.chars, point), len(m.chars) - 1)
    known = m.chars[of] == point
    symbols = np.where(known, m.char_ids[of], -1)
    # neighbours that no piece has inside never merge, so sequences end there
    cut = np.ones(len(at), bool)
    key = (point[:-1] << 21) + point[1:]
    found = np.minimum(np.searchsorted(m.inside, key), len(m.inside) - 1)
    cut[1:] = m.inside[found] != key
    cut[np.searchsorted(at, first)] = True
    begin = np.flatnonzero(cut)
    left = merge_all(m, symbols, begin)
    left = np.where(symbols[begin] < 0, size[begin], left)  # an unknown character stands alone, as its bytes
    return np.add.reduceat(left, np.searchsorted(at[begin], first))


def count_new(m: Merges, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """count_spans, some megabytes at a time."""
    total = np.cumsum(ends - starts)
    cuts = np.searchsorted(total, np.arange(TOGETHER, total[-1] if len(total) else 0, TOGETHER))
    parts = [count_spans(m, data, a, b) for a, b in zip(np.split(starts, cuts), np.split(ends, cuts))]
    return np.concatenate(parts)


def _counts(limit: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Merges(*table.value)
        # pre-tokens that were counted, by one hash; a second one must agree
        known, check, tokens = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for a, b in sliced(batch.column(1)):
                text = pc.fill_null(batch.column(1).slice(a, b - a), "")
                n_bytes = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
                spaced = pc.binary_join_element_wise("", pc.replace_substring(text, SPACE, " "), " ")
                data, offsets = column_bytes(spaced)
                space = data == 0x20
                start = np.zeros(len(data), bool)
                start[1:] = space[1:] & ~space[:-1]
                start[offsets[:-1]] = True
                starts = np.flatnonzero(start)
                ends = np.append(starts[1:], len(data))
                hashes, second = span_hashes(data, starts, ends), span_hashes(data, starts, ends, 0x5EC0)
                own, at, which = np.unique(hashes, return_index=True, return_inverse=True)
                place = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                have = (known[place] == own) & (check[place] == second[at]) if len(known) else np.zeros(len(own), bool)
                n = np.zeros(len(own), np.int64)
                n[have] = tokens[place[have]]
                new = at[~have]
                n[~have] = count_new(m, data, starts[new], ends[new])
                each = n[which]
                other = np.flatnonzero(second != second[at][which])
                each[other] = count_new(m, data, starts[other], ends[other])
                if len(known) > REMEMBERED:
                    known, check, tokens = own, second[at], n
                else:
                    fresh = ~have & (known[place] != own if len(known) else True)
                    known, check, tokens = (np.concatenate(x) for x in ((known, own[fresh]), (check, second[at][fresh]), (tokens, n[fresh])))
                    order = np.argsort(known, kind="stable")
                    known, check, tokens = known[order], check[order], tokens[order]
                total = np.add.reduceat(each, np.searchsorted(starts, offsets[:-1]))
                total = np.where(n_bytes > 0, total, 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(n_bytes), pa.array(total), pa.array(total > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Tokens of each whole text as sentencepiece counts them for a BPE model, without begin and end tokens.

    Takes columns doc_id and text. Returns a row per input row, repeated rows included: doc_id, n_bytes, n_tokens,
    over_limit. A null text counts as empty, with 0 tokens; a null doc_id stays null; an empty table gives no rows.
    Only the vocabulary's tables are broadcast, as plain arrays; their size depends on the vocabulary alone.
    """
    spark = docs.sparkSession
    prepare(spark)
    m = load_merges(model_path)
    table = spark.sparkContext.broadcast((m.chars, m.char_ids, m.pairs, m.ranks, m.merged, m.inside, m.size))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_counts(limit, table), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
