"""From raw messages to clean ones: standardise, filter, dedup, speed caps. All stateless but the dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.config import DEFAULT, Thresholds

#: Source columns of the two dialects, by canonical name.
DIALECT_A = {
    "timestamp_utc": ("# Timestamp", "Timestamp"), "mmsi": ("MMSI",), "lat": ("Latitude",), "lon": ("Longitude",), "sog": ("SOG",), "cog": ("COG",), "heading": ("Heading",),
    "nav_status": ("Navigational status",), "ship_type": ("Ship type",), "length": ("Length",), "width": ("Width",), "draught": ("Draught",), "imo": ("IMO",),
}
DIALECT_B = {
    "timestamp_utc": ("base_date_time",), "mmsi": ("mmsi",), "lat": ("latitude",), "lon": ("longitude",), "sog": ("sog",), "cog": ("cog",), "heading": ("heading",),
    "nav_status": ("status",), "ship_type": ("vessel_type",), "length": ("length",), "width": ("width",), "draught": ("draft",), "imo": ("imo",),
}
NUMBERS = ("lat", "lon", "sog", "cog", "heading", "length", "width", "draught", "imo")
DATA = ("lat", "lon", "sog", "cog", "heading", "nav_status", "ship_type", "length", "width", "draught", "imo")


def dialect_of(raw: DataFrame) -> str:
    """b if the header has the second dialect's marks, else a."""
    return "b" if {"base_date_time", "vessel_type", "status"} <= {c.lower() for c in raw.columns} else "a"


def standardize(raw: DataFrame, dialect: str | None = None, source_file: Column | None = None, limits: Thresholds = DEFAULT) -> DataFrame:
    """Canonical columns from all-string rows; missing source columns are null, other ones dropped, sentinels become null."""
    names = DIALECT_B if (dialect or dialect_of(raw)) == "b" else DIALECT_A

    def source(name: str) -> Column:
        have = [F.col(f"`{c}`").cast("string") for c in names[name] if c in raw.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    stamp = F.trim(source("timestamp_utc"))
    patterns = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss") if names is DIALECT_B else ("dd/MM/yyyy HH:mm:ss",)
    # texts are parsed below a generator, which filters aren't pushed through, so each text is parsed once however often a value is used
    parsed = {
        "timestamp_utc": F.coalesce(*[F.try_to_timestamp(stamp, F.lit(p)) for p in patterns]), "mmsi": text.parsed(source("mmsi")), **{c: text.parsed(source(c)) for c in NUMBERS},
        "nav_status": text.plain(source("nav_status")), "ship_type": text.plain(source("ship_type")),
    }
    df = raw.withColumn("source_file", source_file if source_file is not None else F.lit(None).cast("string"))
    df = df.select("source_file", *[F.col(c) for c in raw.columns if c == "_ingest_order"], F.inline(F.array(F.struct(*[v.alias(c) for c, v in parsed.items()]))))
    nav, kind = text.known(F.col("nav_status")), text.known(F.col("ship_type"))
    if names is DIALECT_B:
        nav, kind = text.nav_status_of_code(nav), text.ship_type_of_code(kind)
    n = {c: text.without_nan(F.col(c)) for c in NUMBERS}
    keep = {
        "lat": F.when(F.abs(n["lat"]) < limits.lat_sentinel, n["lat"]), "lon": F.when(F.abs(n["lon"]) < limits.lon_sentinel, n["lon"]),
        "sog": F.when(n["sog"] < limits.sog_sentinel, n["sog"]), "cog": F.when(n["cog"] < limits.cog_sentinel, n["cog"]), "heading": F.when(n["heading"] != limits.heading_sentinel, n["heading"]),
    }
    number = lambda c: keep.get(c, n[c]).alias(c)
    return df.select(
        text.without_nan(F.col("mmsi")).try_cast("long").alias("mmsi"), "timestamp_utc",
        *[number(c) for c in NUMBERS[:5]], nav.alias("nav_status"), kind.alias("ship_type"), *[number(c) for c in NUMBERS[5:]],
        "source_file", *[F.col(c) for c in df.columns if c == "_ingest_order"],
    )


def basic_filter(df: DataFrame) -> DataFrame:
    """Rows with vessel, time and a valid place; courses and headings outside [0, 360) become null."""
    degrees = lambda c: F.when(F.col(c).between(0, 360) & (F.col(c) < 360), F.col(c))
    kept = df.dropna(subset=["mmsi", "timestamp_utc", "lat", "lon"]).where("lat between -90 and 90 and lon between -180 and 180 and (sog is null or sog >= 0)")
    return kept.withColumns({"cog": degrees("cog"), "heading": degrees("heading")})


def missing_count() -> Column:
    return sum((F.col(c).isNull().cast("int") for c in DATA), F.lit(0))


def exact_rows(df: DataFrame, order: str = "_ingest_order") -> DataFrame:
    """One row of those that are equal in all columns but the ingest order, of which it has the latest."""
    return df.groupBy(*[c for c in df.columns if c != order]).agg(F.max(order).alias(order)).select(*df.columns)


def dedup_messages(df: DataFrame, keep: str = "most_missing", exact: bool = False, order: str = "_ingest_order") -> DataFrame:
    """One row per vessel and time.

    keep: most_missing (what the released data embody) or fewest_missing (what their notes say); ties go to the latest row
    in ingest order. exact first drops rows that are equal in all data columns.
    """
    if exact:
        df = exact_rows(df, order)
    missing = missing_count().desc() if keep == "most_missing" else missing_count().asc()
    rank = F.row_number().over(Window.partitionBy("mmsi", "timestamp_utc").orderBy(missing, F.col(order).desc()))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def with_class(df: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    cls = text.ship_class(F.col("ship_type"))
    return df.withColumn("ship_class", cls).withColumn("shiptype_soft_cap_knots", text.class_value(F.col("ship_class"), limits.caps))


def speed_verdict(limits: Thresholds = DEFAULT) -> Column:
    """hard, soft or keep; rows without a speed are kept."""
    return F.when(F.col("sog") > limits.hard_cap_knots, "hard").when(F.col("sog") > F.col("shiptype_soft_cap_knots"), "soft").otherwise("keep")


def speed_filter(df: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """Drop speeds over the hard cap, then over the class's cap."""
    return with_class(df, limits).where(speed_verdict(limits) == "keep")
