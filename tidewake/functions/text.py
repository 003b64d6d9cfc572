"""Cleaning of raw message fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.config import SHIP_CLASS_IDS

#: Texts that stand for nothing, and code lists of the second dialect.
NULL_TOKENS = ("unknown", "unknown value", "undefined", "none")
NAV_STATUS = {
    0: "under way using engine", 1: "at anchor", 2: "not under command", 3: "restricted manoeuverability", 4: "constrained by draught",
    5: "moored", 6: "aground", 7: "engaged in fishing", 8: "under way sailing", 15: "undefined",
}


def parsed(c: Column) -> Column:
    """A double from text, NaN included; null for null tokens and anything unparsable. Empty text isn't tried, as each failure is dear."""
    t = F.trim(c)
    return F.when(t != "", t.try_cast("double"))


def without_nan(v: Column) -> Column:
    """Null for NaN, which some sources write where nothing is known."""
    return F.nullif(v, F.lit(float("nan")))


def plain(c: Column) -> Column:
    """Trimmed, inner white space collapsed, lower case."""
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def known(t: Column) -> Column:
    """A plain text; null for null tokens."""
    return F.when((t != "") & ~t.isin(*NULL_TOKENS), t)


def ship_type_of_code(c: Column) -> Column:
    """Numeric type codes as words; other text in lower case passes."""
    t = F.lower(F.trim(c))
    k = t.try_cast("int")
    word = (
        F.when(k.between(70, 79), "cargo").when(k.between(80, 89), "tanker").when(k.between(60, 69), "passenger").when(k == 30, "fishing")
        .when(k.isin(31, 32, 52), "tug").when(k.isin(33, 34, 50, 51) | k.between(53, 59), "service").otherwise("unknown")
    )
    return F.when(t == "", None).when(t.rlike("^[0-9]+$"), word).otherwise(t)


def nav_status_of_code(c: Column) -> Column:
    t = F.lower(F.trim(c))
    words = F.create_map(*[F.lit(x) for kv in NAV_STATUS.items() for x in kv])
    return F.when(t == "", None).when(t.rlike("^[0-9]+$"), F.coalesce(words[t.try_cast("int")], F.lit("undefined"))).otherwise(t)


def ship_class(c: Column) -> Column:
    """Class by the first group of words found in a ship type; null if none is."""
    t = F.lower(c)
    has = lambda *words: t.rlike("|".join(words))
    return (
        F.when(has("cargo", "bulk", "container"), F.when(has("container"), "container").when(has("bulk"), "bulk").otherwise("cargo"))
        .when(has("tanker"), "tanker")
        .when(has("passenger", "ferry", "cruise"), F.when(has("ferry"), "ferry").otherwise("passenger"))
        .when(has("fishing"), "fishing")
        .when(has("tug", "pilot", "service", "port tender", "tow"), F.when(has("tug", "tow"), "tug").otherwise("service"))
    )


def ship_type_id(c: Column) -> Column:
    ids = F.create_map(*[F.lit(x) for kv in SHIP_CLASS_IDS.items() for x in kv])
    return ids[F.coalesce(ship_class(c), F.lit("unknown"))]


def class_value(c: Column, values: dict[str, float]) -> Column:
    """A value by class, null for others."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c]


def ship_group(ship_type: Column, cls: Column) -> Column:
    """Selection group by words of type and class."""
    t = F.lower(F.concat_ws(" ", ship_type, cls))
    return (
        F.when(t.rlike("cargo|tanker|bulk|container"), "cargo_tanker").when(t.rlike("passenger|ferry"), "passenger_ferry").when(t.rlike("fishing"), "fishing")
        .when(t.rlike("tug|service|pilot|tow"), "tug_service").when(t.rlike("sailing|pleasure|yacht"), "sailing_leisure").otherwise("other_unknown")
    )


def split_of(mmsi: Column) -> Column:
    """train, val or test by the md5 of the vessel's number modulo 10, from the halves of its 128 bits."""
    digest = F.md5(mmsi.cast("string"))
    half = lambda at: (F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") % 10).cast("int")
    k = (6 * half(1) + half(17)) % 10
    return F.when(k == 0, "val").when(k == 1, "test").otherwise("train")


def number_or(c: Column, kind: str, default: float | int | bool | None) -> Column:
    """A text as a number or boolean; the default where it isn't one."""
    return F.coalesce(F.trim(c).try_cast(kind), F.lit(default).cast(kind))


def utc_text(t: Column) -> Column:
    """A time as ISO text with the offset of UTC; the session's time zone must be UTC."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def floats_of(c: Column) -> Column:
    """Numbers of a JSON list; an empty list for null, empty or broken text and for other JSON, items that aren't numbers are left out."""
    items = F.from_json(F.trim(c), "array<string>")
    return F.when(F.trim(c).startswith("["), F.coalesce(F.filter(F.transform(items, json_number), F.isnotnull), F.array().cast("array<double>"))).otherwise(F.array().cast("array<double>"))


def json_number(item: Column) -> Column:
    """An item as a number: true and false count as 1 and 0."""
    return F.when(item == "true", 1.0).when(item == "false", 0.0).otherwise(F.trim(item).try_cast("double"))


def strict_array(c: Column, kind: str = "double") -> Column:
    """A JSON list of a kind; an error where the text isn't one."""
    return F.from_json(c, f"array<{kind}>", {"mode": "FAILFAST"})


def compact_json(c: Column) -> Column:
    """An array, struct or map as JSON without spaces, nulls kept."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def recompact(c: Column, kind: str = "array<double>") -> Column:
    """JSON text with any spacing in the compact form."""
    return compact_json(F.from_json(c, kind))


def spaced_json(c: Column) -> Column:
    """An array as JSON with a space after each comma between its items, as the social tables have it."""
    item = lambda v: F.to_json(F.array(v), {"ignoreNullFields": "false"})
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: F.substr(item(v), F.lit(2), F.length(item(v)) - 2)), ", "), F.lit("]"))
