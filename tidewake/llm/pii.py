"""Personal data by gradient boosting over candidates, with DataFrame functions only.

Four strict patterns are always reported. Loose generators propose further spans, which may overlap these and each other:
numbers with separators (cards, phones), addresses whose at and dots may be spelled out, dotted quads with brackets or
words for dots. Boosted trees of depth two judge them by format and context; an address is judged by its plain form, so
that spelled out ones are like others. The trees are fitted on a table of counts by feature values. Candidates that a
strict pattern confirms are the positive ones, those that break a rule of their kind (checksum, octets, an unknown last
label) the negative ones; all others have no label and play no part in the fit. A threshold is calibrated on the labelled
candidates of a fold that the fit didn't see. The fitted trees are SQL expressions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, workspace, written
from .spans import found, listed, numbered, placed

#: A local part starts where the last match ended or where no character of its class stands before: no other start is leftmost.
#: Repeated groups are possessive: nothing follows them, so none is ever given back, and Java matches them in a loop
#: instead of a call for each repetition, which a chain of thousands would not survive.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: A match ends with its last digit, so the next one starts where a run of digits does.
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: Chains of 12 digits or more: a chain is taken whole, so shorter ones can't hold a longer one.
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"\+?\(?[0-9](?:[\x20().-]{0,3}[0-9]){6,}+"
ADDRESS = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[(\[](?:at|AT)[)\]]\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]++)++"
QUAD = r"(?<![0-9.])[0-9]{1,4}(?:\x20?[(\[]?(?:\.|dot|DOT)[)\]]?\x20?[0-9]{1,4}){3}(?![0-9])"
#: Last labels of addresses, and words that stand before personal data or before other numbers.
LAST_LABELS = ("com", "org", "net", "edu", "gov", "io", "co", "info", "biz", "eu", "uk", "de", "fr", "es", "it", "nl", "pl", "ru", "ch", "at", "us", "ca", "au", "in", "cn", "jp", "br", "example", "test")
CUES = r"(?:mail|contact|write|reach|phone|tel|call|mobile|cell|fax|card|visa|account|iban|host|server|client|address)[^\n]{0,12}$"
OTHER_CUES = r"(?:version|build|release|order|isbn|issue|page|section|chapter|ticket|ref|serial|part)[^\n]{0,12}$"
REACH = 24
KINDS = ("email", "ip", "card", "phone", "other")
#: Feature i of a candidate is a whole number below LEVELS[i].
FEATURES = ("generator", "length", "groups", "brackets", "dots", "before", "after", "cue", "last label")
LEVELS = (3, 6, 6, 2, 2, 3, 3, 3, 2)
FOLDS, CALIBRATION, PRECISION, ROUNDS, RATE = 5, 0, 0.9, 24, 0.3
LOOSE = "array<struct<start:int,end:int,f:array<int>,sure:boolean,label:int>>"

Split = tuple  # (feature, level, below, above), or a number


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _side(c: Column) -> Column:
    return F.when(c.isin("", " ", "\n", "\t"), 0).when(c.rlike(r"[.,;:!?()\"']"), 1).otherwise(2)


def _plain(address: Column) -> Column:
    """An address with at and dots as signs, in lower case."""
    signs = F.regexp_replace(F.lower(address), r"\x20?[(\[]at[)\]]\x20?|\x20at\x20", "@")
    return F.regexp_replace(signs, r"\x20?[(\[]dot[)\]]\x20?|\x20dot\x20", ".")


def _known_label(address: Column) -> Column:
    return F.element_at(F.split(_plain(address), r"\."), -1).isin(*LAST_LABELS)


def _features(generator: int, s: Column) -> Column:
    value = s["value"]
    if generator == 1:
        plain = _plain(value)
        n = F.length(F.element_at(F.split(plain, r"\."), -1))
        length = F.when(n < 2, 0).when(n == 2, 1).when(n == 3, 2).when(n == 4, 3).when(n < 7, 4).otherwise(5)
        groups = F.least(F.size(F.split(plain, r"\.", -1)) - 1, F.lit(5))
        bracket, dot, label = F.lit(0), F.lit(1), _known_label(value).cast("int")
    else:
        n = F.length(_digits(value))
        length = F.when(n < 9, 0).when(n < 11, 1).when(n < 13, 2).when(n < 16, 3).when(n == 16, 4).otherwise(5)
        groups = F.least(F.size(F.split(value, r"[^0-9]+", -1)) - 1, F.lit(5))
        bracket = (value.contains("(") if generator == 0 else F.lit(False)).cast("int")
        dot, label = value.contains(".").cast("int"), F.lit(0)
    before = F.lower(s["before"])
    cue = F.when(before.rlike(CUES), 1).when(before.rlike(OTHER_CUES), 2).otherwise(0)
    return F.array(F.lit(generator), length, groups, bracket, dot, _side(F.right(s["before"], F.lit(1))), _side(s["after"]), cue, label)


def _broken(generator: int, s: Column) -> Column:
    """Whether a candidate breaks a rule of its kind, so that it can't be personal data."""
    value = s["value"]
    if generator == 1:
        return ~_known_label(value)
    if generator == 2:
        return ~_octets(F.regexp_replace(value, "[^0-9]+", "."))
    n = F.length(_digits(value))
    within = F.right(s["before"], F.lit(1)).rlike("[A-Za-z0-9_]") | s["after"].rlike("[A-Za-z0-9_]")  # part of a longer word
    return within | (n > 19) | (n >= 13) & ~_luhn(value)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, strict spans, loose spans with features) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    patterns = (EMAIL, IP, CARD, PHONE, NUMBER, ADDRESS, QUAD)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    named = named.select("*", *[found(F.col("text"), p).alias(f"m{i}") for i, p in enumerate(patterns)])
    named = named.select("doc_id", *[placed(F.col("text"), p, F.col(f"m{i}"), REACH if i > 3 else 1).alias(f"s{i}") for i, p in enumerate(patterns)])
    digits = lambda s: F.length(_digits(s["value"]))
    keep = (
        F.col("s0"),
        F.filter("s1", lambda s: _octets(s["value"])),
        F.filter("s2", lambda s: digits(s).between(12, 19) & _luhn(s["value"])),
        F.filter("s3", lambda s: digits(s).between(9, 15)),
    )
    named = named.select("doc_id", F.array_sort(F.concat(*[numbered(k, i) for i, k in enumerate(keep)])).alias("base"), "s4", "s5", "s6")

    def loose(g: int) -> Column:
        def one(s: Column) -> Column:
            sure = F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), _features(g, s).alias("f"), sure.alias("sure"), F.when(sure, 1).when(_broken(g, s), 0).otherwise(-1).alias("label"))

        return F.coalesce(F.transform(f"s{4 + g}", one), F.array().cast(LOOSE))

    return named.select("doc_id", "base", F.concat(loose(0), loose(1), loose(2)).alias("loose"))


def _best(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[float, int, int] | None:
    """The split of the rows (gain, feature, level) that lowers the loss most."""
    whole, best = g[rows].sum() ** 2 / (h[rows].sum() + 1), None
    for f, levels in enumerate(LEVELS):
        gl = np.cumsum(np.bincount(x[rows, f], weights=g[rows], minlength=levels))
        hl = np.cumsum(np.bincount(x[rows, f], weights=h[rows], minlength=levels))
        gain = gl**2 / (hl + 1) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + 1) - whole
        k = int(np.argmax(gain[:-1]))
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = float(gain[k]), f, k
    return best


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> Split | float:
    split = _best(x, g, h, rows) if depth else None
    if split is None:
        return RATE * float(g[rows].sum() / (h[rows].sum() + 1))
    _, f, k = split
    return f, k, _tree(x, g, h, rows[x[rows, f] <= k], depth - 1), _tree(x, g, h, rows[x[rows, f] > k], depth - 1)


def _evaluate(tree: Split | float, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, k, below, above = tree
    return np.where(x[:, f] <= k, _evaluate(below, x), _evaluate(above, x))


def _expression(tree: Split | float, f: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    at, k, below, above = tree
    return F.when(F.get(f, F.lit(at)) <= k, _expression(below, f)).otherwise(_expression(above, f))


def boost(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[float, list]:
    """Bias and trees fitted to counts n and positive counts of the feature rows x, by the logistic loss."""
    bias = math.log((positive.sum() + 1) / (n.sum() - positive.sum() + 1))
    margin, trees = np.full(len(x), bias), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_tree(x, positive - n * p, n * p * (1 - p), np.arange(len(x)), 2))
        margin += _evaluate(trees[-1], x)
    return bias, trees


def calibrate(margin: np.ndarray, n: np.ndarray, positive: np.ndarray) -> float:
    """The least margin from which on positives make up PRECISION of the held-out candidates; infinite if none does."""
    order = np.argsort(-margin, kind="stable")
    precision = np.cumsum(positive[order]) / np.maximum(np.cumsum(n[order]), 1)
    last = np.append(margin[order][1:] < margin[order][:-1], True)
    good = np.flatnonzero((precision >= PRECISION) & last)
    return float(margin[order][good[-1]]) if len(good) else math.inf


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in each whole text; reads doc_id and text, other columns are ignored.

    Returns a row per input row (repeated rows too): doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the spans of
    the strict patterns), spans (these, and as kind other the loose candidates that overlap none of them, break no rule of their kind and
    whose score reaches the calibrated threshold; two generators may add overlapping ones), n_other. Null and empty texts have none; a null doc_id belongs to the fitted
    folds. Without candidates of both classes nothing is added. An empty table gives no rows. The driver gets one row of
    counts for each combination of feature values, some thousands at most.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = written(candidates(docs), f"{workspace(spark)}/candidates")
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)), F.lit(1)) == CALIBRATION
    each = own.where(F.size("loose") > 0).select(fold.alias("late"), F.explode("loose").alias("c")).where("c.label >= 0")
    table = each.groupBy("late", "c.f").agg(F.count("*").alias("n"), F.sum(F.col("c.label").cast("long")).alias("positive")).collect()
    fitted, late = ([r for r in sorted(table, key=lambda r: r.f) if r.late == side] for side in (False, True))
    arrays = lambda rows: (np.array([r.f for r in rows], np.int64).reshape(-1, len(LEVELS)), np.array([r.n for r in rows], float), np.array([r.positive for r in rows], float))
    x, n, positive = arrays(fitted)
    bias, trees = boost(x, n, positive) if 0 < positive.sum() < n.sum() else (0.0, [])
    x, n, positive = arrays(late)
    threshold = calibrate(bias + sum(_evaluate(t, x) for t in trees), n, positive) if trees and len(late) else math.inf

    def chosen(c: Column) -> Column:
        total = F.lit(bias)
        for t in trees:
            total = total + _expression(t, c["f"])
        return (c["label"] == -1) & (total >= threshold - 1e-9)

    other = F.array_distinct(F.transform(F.filter("loose", chosen), lambda c: F.struct(c["start"].alias("start"), F.lit(4).alias("kind"), c["end"].alias("end")))) if threshold < math.inf else F.array().cast("array<struct<start:int,kind:int,end:int>>")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return own.withColumn("other", other).select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"),
        listed(F.concat("base", "other"), KINDS).alias("spans"), F.size("other").cast("long").alias("n_other"),
    )
