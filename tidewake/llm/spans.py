"""Places of regular expressions in texts, with built-in functions only.

Spark returns the texts of all matches but not where they stand. The pieces between them, from splitting by the same
pattern, give the places: a match starts after all pieces and matches before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches (or a group of each), as an array of strings."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def placed(text: Column, pattern: str, matches: Column, reach: int = 1) -> Column:
    """matches: the column of found(text, pattern). An array of structs (start, end, value, before, after), null if empty.

    Code points, end exclusive; before and after are the neighbouring characters, `reach` before and one after, up to the
    next match.
    """

    def piece(m: Column, p: Column) -> Column:
        return F.struct(F.coalesce(F.length(m), F.lit(0)).alias("m"), F.length(p).alias("p"), F.right(p, F.lit(reach)).alias("last"), F.left(p, F.lit(1)).alias("first"))

    # a one-element array names the intermediate arrays, so that each is computed once for a text
    zipped = F.array(F.struct(matches.alias("matches"), F.zip_with(matches, F.split(text, pattern, -1), piece).alias("pieces")))

    def summed(x: Column) -> Column:
        sums = F.aggregate(x["pieces"], F.array(F.lit(0)), lambda seen, y: F.array_append(seen, F.element_at(seen, -1) + y["m"] + y["p"]))
        return F.struct(x["matches"], x["pieces"], sums.alias("sums"))

    def within(x: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            here = F.get(x["pieces"], i)
            start = F.get(x["sums"], i) + here["p"]
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"), here["last"].alias("before"), F.get(x["pieces"], i + 1)["first"].alias("after"))

        return F.transform(x["matches"], one)

    return F.when(F.size(matches) == 0, F.lit(None)).otherwise(F.get(F.transform(F.transform(zipped, summed), within), F.lit(0)))


def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """Spans, an array of structs (start, kind, end) with the kind's number, as kind:start:end by start, then kind."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def numbered(spans: Column, kind: int) -> Column:
    """Placed matches as structs (start, kind, end) for listed(); none for null."""
    return F.coalesce(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))), F.array().cast("array<struct<start:int,kind:int,end:int>>"))
