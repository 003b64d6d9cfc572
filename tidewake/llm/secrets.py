"""Secret scans by corpus-wide ownership frequency, with DataFrame functions only.

Every candidate's value is hashed, and hashes are counted by distinct owners and repositories over the whole corpus.
Values that many owners have are copied examples; those of few owners look live. The three base kinds are always
reported; candidates of the vendor formats are reported where they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, workspace, written
from .spans import found, listed, numbered, placed

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of capitals and digits of at least 20, or of 24 hexadecimal digits: shorter ones can't hold a longer one.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
#: Fixed formats of issued keys, bearer headers, private key blocks and passwords in addresses.
VENDOR = r"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----|[Bb]earer\x20{1,9}[A-Za-z0-9._~+/=-]{16,}|://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/@]{1,64}@)"
SHORTEST = 6
KINDS = ("assign", "access", "hex", "vendor")
CANDIDATE = "array<struct<start:int,kind:int,end:int,value:bigint>>"


def _values(spans: Column, kind: int) -> Column:
    """Placed matches with the hash of the secret itself; assigned values shorter than SHORTEST are left out."""
    secret = (lambda s: F.regexp_extract(s["value"], ASSIGN, 1)) if kind == 0 else (lambda s: s["value"])
    kept = F.filter(spans, lambda s: F.length(secret(s)) >= SHORTEST) if kind == 0 else spans
    return F.coalesce(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.xxhash64(secret(s)).alias("value"))), F.array().cast(CANDIDATE))


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """(doc_id, hash of the text, owner, repository, candidates in order) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"))
    patterns = (ASSIGN, ACCESS, HEX, VENDOR)
    named = named.select("*", *[found(F.col("text"), p).alias(f"m{i}") for i, p in enumerate(patterns)])
    spans = [_values(placed(F.col("text"), p, F.col(f"m{i}")), i) for i, p in enumerate(patterns)]
    return named.select("doc_id", F.xxhash64("text").alias("text"), "owner", "repository", F.array_sort(F.concat(*spans)).alias("spans"))


def secret_scan(docs: DataFrame, owner: str = "source", repository: str = "source", common_owners: int = 3, common_repositories: int = 5) -> DataFrame:
    """Secrets in each whole text; reads doc_id, text and the owner's and repository's columns, others are ignored.

    Returns a row per input row (repeated rows too): doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans),
    spans (all of them), n_live (spans whose value less than common_owners owners and common_repositories repositories
    have). Null and empty texts have none. A null owner or repository is one of its own. Equal values in one owner's
    texts count once, however often they are copied. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = written(candidates(docs, owner, repository), f"{workspace(spark)}/candidates")
    each = own.where(F.size("spans") > 0).select("doc_id", "text", "owner", "repository", F.explode("spans").alias("s")).select("doc_id", "text", F.coalesce("owner", F.lit("\x00")).alias("owner"), F.coalesce("repository", F.lit("\x00")).alias("repository"), "s.*")
    # distinct pairs first: a value copied over a third of the corpus is then a row per owner
    pairs = each.select("value", "owner", "repository").distinct()
    common = pairs.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    common = common.where((F.col("owners") >= common_owners) | (F.col("repositories") >= common_repositories)).select("value")
    live = each.join(common, "value", "left_anti").select("doc_id", "text", "start", "kind", "end").distinct()
    live = live.groupBy("doc_id", "text").agg(F.collect_list(F.struct("start", "kind", "end")).alias("live"))
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    joined = own.select(F.col("doc_id").alias("id"), F.col("text").alias("hash"), plain.alias("spans")).join(live, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text")), "left")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    alive = F.coalesce("live", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return joined.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base, KINDS), 256).alias("base_sha256"),
        listed(F.concat(base, F.filter(alive, lambda s: s["kind"] == 3)), KINDS).alias("spans"),
        F.size(alive).cast("long").alias("n_live"),
    )
