"""As-of joins: each row's last known, next or nearest row of another table in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = ("backward", "forward", "nearest")


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str], direction: str = "backward",
    tolerance_s: float | None = None, later_ties: bool = False, block_s: float = 86_400.0, name: str = "match",
) -> DataFrame:
    """left's rows with a struct `name` of right's time and columns, null where nothing matches.

    backward: the last row of the same keys at or before the time, forward: the first at or after it, nearest: the one less
    far off, of both the earlier unless later_ties. Of right rows of one time the least by the columns counts. Rows farther
    off than tolerance_s don't match, nor do null keys or times.

    Both sides are sorted together once, in blocks of block_s of each key, so a key that holds much of the data is spread;
    what lies beyond a block comes from a table of one row for each block.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction {direction!r} is none of {DIRECTIONS}")
    micros = lambda c: F.unix_micros(c)
    keys = [f"_k{i}" for i in range(len(by))]
    own = lambda df, side, time, row, hit: df.select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)], micros(time).alias("_t"), F.lit(side).alias("_side"), row.alias("_row"), hit.alias("_hit")
    )
    hit = F.struct(micros(right_time).alias("us"), F.struct(F.col(right_time), *[F.col(c) for c in columns]).alias("value"))
    known = own(right, 0, right_time, F.lit(None).cast(left.select(F.struct("*").alias("r")).schema["r"].dataType), hit)
    known = known.where(F.col("_t").isNotNull())
    asked = own(left, 1, left_time, F.struct("*"), F.lit(None).cast(known.schema["_hit"].dataType))
    sides = known.unionByName(asked).withColumn("_block", F.floor(F.col("_t") / int(block_s * 1e6)))
    inner = Window.partitionBy(*keys, "_block")
    last = lambda w: F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = sides.withColumn("_before", last(inner.orderBy("_t", "_side", F.desc("_hit"))))
    both = both.withColumn("_after", last(inner.orderBy(F.desc("_t"), "_side", F.desc("_hit"))))
    # what the blocks before and after have: a row for each block
    latest = F.min(F.when(F.col("_side") == 0, F.struct((-F.col("_hit.us")).alias("back"), F.col("_hit").alias("hit"))))
    blocks = sides.groupBy(*keys, "_block").agg(F.min("_hit").alias("_first"), latest["hit"].alias("_last"))
    outer = Window.partitionBy(*keys)
    far = lambda c, order: F.last(c, ignorenulls=True).over(outer.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(*keys, "_block", far("_last", F.asc("_block")).alias("_earlier"), far("_first", F.desc("_block")).alias("_later"))
    rows = both.where("_side = 1")
    same = rows["_block"].eqNullSafe(blocks["_block"])
    for k in keys:
        same &= rows[k].eqNullSafe(blocks[k])
    rows = rows.join(blocks, same, "left").select("_row", rows["_t"].alias("_t"), F.coalesce("_before", "_earlier").alias("_before"), F.coalesce("_after", "_later").alias("_after"), *[rows[k].isNull().alias(f"_null{i}") for i, k in enumerate(keys)])
    off = lambda c: F.abs(F.col(f"{c}.us") - F.col("_t"))
    closer = off("_after") <= off("_before") if later_ties else off("_after") < off("_before")
    chosen: Column = {"backward": F.col("_before"), "forward": F.col("_after"), "nearest": F.when(F.col("_before").isNull() | F.coalesce(closer, F.lit(False)), F.col("_after")).otherwise(F.col("_before"))}[direction]
    rows = rows.withColumn("_chosen", chosen)
    fits = F.col("_t").isNotNull()
    for i in range(len(keys)):
        fits &= ~F.col(f"_null{i}")
    if tolerance_s is not None:
        fits &= off("_chosen") <= int(tolerance_s * 1e6)
    return rows.select("_row.*", F.when(fits, F.col("_chosen.value")).alias(name))
