"""Conversation structure repair: cheapest edits by a dynamic programme whose layers are shared along a prefix trie.

A conversation becomes a signature, one letter for each row: its role's initial, whether it is truncated, whether it must
go. What an edit costs depends on that alone, so equal signatures have equal answers, and those that end alike share the
programme's layers: distinct signatures are read from their last row on, sorted, and inserted into a prefix trie, of
which one path at a time is held; a layer (for each state of the grammar the least cost and its edits up to the end) is
computed once for each node of the trie, and answers are read off at terminal nodes.

A conversation of more than PIECE rows is cut into pieces. What each costs from any state to any other comes from the
same trie; from these tables a conversation's pieces learn what lies behind them, and each is then solved for itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import prepare, workspace, written

#: Rows of a piece: a layer holds some four strings of as many letters, and a path of the trie as many layers.
PIECE = 1024
#: What counts as white space.
SPACE = " \t\n\x0b\x0c\r"
#: Costs of edits, and of a truncated row that stays. FAR: no way.
REROLE, DELETE, INSERT, TRUNCATED, FAR = 2, 3, 2, 1, 1 << 60
#: States of the grammar `(s?(ua)+)?`: nothing yet, after s, after u, after a. Where a spoken turn (u or a) leads, and a row by its initial.
STATES, SPOKEN = 4, (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
END = [0, FAR, FAR, 0]

Layer = list[tuple[int, str, int]]  # for each state: cost, edits, the state in which they leave the piece


def damaged(conversations: DataFrame, salt: int = 20) -> DataFrame:
    """Rows (conv_id, turn, role, text) after damage chosen by the checksum of `conv_id:turn`; nulls are one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    df = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"), F.pmod(F.crc32(F.concat_ws(":", name("conv_id"), name("turn")).cast("binary")), F.lit(salt)).alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    df = df.where("_kind != 0").withColumns({"text": text, "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))})
    return df.select("*", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))).drop("_kind", "col")


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("_key")


def with_faults(rows: DataFrame) -> DataFrame:
    """Numbered rows of each conversation with their first fault, their letter, and whether they may follow the row before."""
    rows = rows.select(_key(), "turn", "role", "text").repartition("_key")  # both windows below need no more than this
    w = Window.partitionBy("_key").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    seen = Window.partitionBy("_key", "role", "text").orderBy("place")
    rows = rows.withColumn("place", (F.row_number().over(w) - 1).cast("long"))
    rows = rows.withColumns({"_again": F.row_number().over(seen) > 1, "_tail": F.rtrim(F.col("text"), F.lit(SPACE)), "_letter": F.left("role", F.lit(1))})
    fault = F.when(F.col("_tail") == "", "blank").when(F.col("_again"), "duplicate").when(~F.right("_tail", F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    pair = F.concat(F.lag("_letter").over(w), F.col("_letter"))
    rows = rows.withColumns({"fault": fault, "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)), "piece": F.floor(F.col("place") / PIECE)})
    letter = F.when(F.col("_letter").isin("s", "u", "a"), F.col("_letter")).otherwise("x")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return rows.select("_key", "turn", "role", "text", "place", "piece", "fault", "illegal", letter.alias("letter"))


def inserted(layer: Layer) -> Layer:
    """The layer with turns inserted before what it stands for, where that is cheaper: two at most are of use."""
    put = lambda x: (x[0] + INSERT, "I" + x[1], x[2])
    user, assistant = min(layer[2], put(layer[3])), min(layer[3], put(layer[2]))
    return [min(layer[0], put(user)), min(layer[1], put(user)), user, assistant]


def deeper(layer: Layer, letter: str) -> Layer:
    """The layer of a node's child: one more row in front."""
    out = []
    more = 0 if letter.islower() else TRUNCATED
    kept = KEPT.get(letter.lower())
    for q in range(STATES):
        cost, audit, leave = layer[q]
        best = (cost + DELETE, "D" + audit, leave)
        if letter != "D":
            cost, audit, leave = layer[SPOKEN[q]]
            best = min(best, (cost + REROLE + more, "R" + audit, leave))
            if kept[q] is not None:
                cost, audit, leave = layer[kept[q]]
                best = min(best, (cost + more, "K" + audit, leave))
        out.append(best)
    return inserted(out)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (ends, last, signature from its last letter on) to costs, edits and leaving states by entering state.

    The path holds the layers of the signature before; the next one goes back to where both part.
    """
    path: list[Layer] = []
    root, before = None, ""
    for batch in batches:
        cost, audit, leave = [], [], []
        for ends, last, signature in zip(*(c.to_pylist() for c in batch.columns)):
            if (ends, last) != root:
                root, before = (ends, last), ""
                first = [(c, "", q) for q, c in enumerate(ends)]
                path = [inserted(first) if last else first]
            shared = 0
            for x, y in zip(before, signature):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :]
            for letter in signature[shared:]:
                path.append(deeper(path[-1], letter))
            before = signature
            for out, part in zip((cost, audit, leave), zip(*path[-1])):
                out.append(part)
        kinds = (pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, k) for x, k in zip((cost, audit, leave), kinds))], ["ends", "last", "signature", "cost", "audit", "leave"])


def solved(pieces: DataFrame) -> DataFrame:
    """Answers for distinct (ends, last, signature): the trie is dealt out by ranges, so neighbours share their layers."""
    each = pieces.select("ends", "last", "signature").distinct()
    each = each.repartitionByRange("ends", "last", "signature").sortWithinPartitions("ends", "last", "signature")
    return each.mapInArrow(_solve, "ends array<long>, last boolean, signature string, cost array<long>, audit array<string>, leave array<int>")


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs behind each piece of one conversation, from the last one back, less the least of them, which is added up in base.

    A piece's rows (to, cost) hold what it costs from each state to the state `to`; the last one's hold how it ends.
    """
    out, ends, base = [], list(END), 0
    for at in range(int(pdf["last_piece"].iloc[0]), -1, -1):
        low = min(ends)
        ends, base = [c - low for c in ends], base + low
        out.append((pdf["_key"].iloc[0], at, ends, base))
        table = np.full((STATES, STATES), FAR, np.int64)
        own = pdf[pdf["piece"] == at]
        for to, cost in zip(own["to"], own["cost"]):
            table[:, to] = cost
        ends = [int(min(FAR, *(table[q] + np.array(ends)))) for q in range(STATES)]
    return pd.DataFrame(out, columns=["_key", "piece", "ends", "base"])


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each piece of one conversation is entered."""
    pdf, state, out = pdf.sort_values("piece"), 0, []
    for leave in pdf["leave"]:
        out.append(state)
        state = leave[state]
    return pd.DataFrame({"_key": pdf["_key"], "piece": pdf["piece"], "state": out})


def audits(rows: DataFrame, home: str) -> DataFrame:
    """(_key, piece, cost, audit): the cheapest edits of each piece; the first piece's cost is its conversation's."""
    order = F.array_sort(F.collect_list(F.struct("place", "letter")))
    pieces = rows.groupBy("_key", "piece").agg(F.reverse(F.array_join(F.transform(order, lambda r: r["letter"]), "")).alias("signature"))
    pieces = written(pieces.withColumn("last_piece", F.max("piece").over(Window.partitionBy("_key"))), f"{home}/pieces")
    ends = lambda costs: F.array(*[F.lit(c).cast("long") for c in costs])
    short = pieces.where("last_piece = 0").withColumns({"ends": ends(END), "last": F.lit(True)})
    long = pieces.where("last_piece > 0").withColumn("last", F.col("piece") == F.col("last_piece"))
    whole = short.join(solved(short), ["ends", "last", "signature"]).select("_key", "piece", F.get("cost", F.lit(0)).alias("cost"), F.get("audit", F.lit(0)).alias("audit"))
    if long.isEmpty():
        return whole
    # what a piece costs from each state to each: once for each state to leave in
    units = F.array(*[F.struct(F.lit(q).alias("to"), ends([0 if q == r else FAR for r in range(STATES)]).alias("ends")) for q in range(STATES)])
    last = F.array(F.struct(F.lit(0).alias("to"), ends(END).alias("ends")))
    asked = long.select("*", F.explode(F.when(F.col("last"), last).otherwise(units)).alias("_u")).select("_key", "piece", "last_piece", "last", "signature", "_u.*")
    tables = asked.join(solved(asked), ["ends", "last", "signature"]).select("_key", "piece", "last_piece", "to", "cost")
    behind = written(tables.groupBy("_key").applyInPandas(_ends, "_key string, piece long, ends array<long>, base long"), f"{home}/behind")
    known = long.join(behind, ["_key", "piece"])
    answers = written(known.join(solved(known), ["ends", "last", "signature"]).select("_key", "piece", "base", "cost", "audit", "leave"), f"{home}/answers")
    entered = answers.select("_key", "piece", "leave").groupBy("_key").applyInPandas(_entries, "_key string, piece long, state int")
    return whole.unionByName(answers.join(entered, ["_key", "piece"]).select("_key", "piece", (F.get("cost", "state") + F.col("base")).alias("cost"), F.get("audit", "state").alias("audit")))


class _Repair:
    """Edits of one conversation, applied to its rows as they come."""

    def __init__(self) -> None:
        self.digest, self.edits, self.parts, self.state, self.lines = hashlib.sha256(), iter(""), [], 0, 0

    def put(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1

    def speak(self, text: str) -> None:
        self.state = SPOKEN[self.state]
        self.put("user" if self.state == 2 else "assistant", text)

    def next_edit(self) -> str | None:
        """The edit of the next row, after all turns inserted before it; none at a piece's end."""
        for edit in self.edits:
            if edit != "I":
                return edit
            self.speak("")
        return None

    def begin(self, audit: str) -> None:
        self.next_edit()
        self.edits = iter(audit)
        self.parts.append(audit)

    def row(self, role: str, text: str) -> None:
        edit = self.next_edit()
        if edit == "K":
            self.state = KEPT[role[0]][self.state]
            self.put(role, text)
        elif edit == "R":
            self.speak(text)

    def end(self) -> tuple[str, str]:
        self.next_edit()
        return "".join(self.parts), self.digest.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, audit, role, text), sorted, each piece's audit before its rows, to the edits and the digest of each conversation."""
    now, repair, done = None, None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done)] or [pa.array([], pa.string())] * 3, ["_key", "audit", "repaired_sha256"])

    for batch in batches:
        for key, audit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now:
                if repair:
                    done.append((now, *repair.end()))
                now, repair = key, _Repair()
            if audit is not None:
                repair.begin(audit)
            else:
                repair.row(role, text)
        if done:
            yield out()
            done = []
    if repair:
        done.append((now, *repair.end()))
        yield out()


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Damage conversations in a known way, find their faults and repair their structure by the cheapest edits.

    Takes conv_id, turn, role and text; other columns play no part. Returns for each distinct conv_id (null is one):
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_rows (after damage) and n_repaired.
    Nulls in role and text are one space, so such a text is blank; a role that doesn't begin with s, u or a, or is
    empty, can't be kept. Null turns come first.
    Rows of one turn go by role and text; repeated rows are duplicates. A conversation without rows after damage has zeros,
    no edits and the digest of the empty string. An empty table gives no rows. A conversation's texts pass through one
    task, in batches, because its digest is one sequence; all else of a long one is done piece by piece.
    """
    spark = conversations.sparkSession
    prepare(spark)
    home = workspace(spark)
    rows = written(with_faults(damaged(conversations)), f"{home}/rows")
    found = written(audits(rows, home), f"{home}/audits")
    of = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    turns = rows.groupBy("_key", "turn").agg(F.count("*").alias("n"), of("blank"), of("duplicate"), of("truncated"), F.count_if("illegal").alias("illegal"))
    stats = turns.groupBy("_key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.sum("n").cast("long").alias("n_rows"),
    )
    empty = F.lit(None).cast("string")
    lines = found.select("_key", "piece", F.lit(-1).cast("long").alias("place"), "audit", empty.alias("role"), empty.alias("text")).unionByName(rows.select("_key", "piece", "place", empty.alias("audit"), "role", "text"))
    lines = lines.repartition("_key").sortWithinPartitions("_key", "piece", "place").select("_key", "audit", "role", "text")
    digest = lines.mapInArrow(_digests, "_key string, audit string, repaired_sha256 string")
    cost = found.where("piece = 0").select("_key", "cost")
    every = conversations.groupBy("conv_id").agg(F.lit(1)).select("conv_id", _key())
    df = every.join(stats, "_key", "left").join(cost, "_key", "left").join(digest, "_key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return df.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"), zero("n_rows"), F.length(F.translate(F.coalesce("audit", F.lit("")), "D", "")).cast("long").alias("n_repaired"),
    )
