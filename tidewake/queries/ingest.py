"""Queries of the ingest operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..operators import ingest
from ..plans.stages import shared_folder, stage
from ..registry import query
from ..sources import archives
from . import chain
from .fixtures import raw_messages, settled

ALL = f"mmsi, us AS timestamp_utc, round(lat, 6) AS lat, round(lon, 6) AS lon, sog, cog, heading, nav_status, ship_type, length, width, draught, imo"
COLUMNS = ("mmsi", "timestamp_utc", "lat", "lon", "sog", "cog", "heading", "nav_status", "ship_type", "length", "width", "draught", "imo")


@query(chain.sql(f"SELECT {ALL} FROM std", "std"))
def standardize_sentinels(spark, d):
    return settled(chain.standard(spark, d), keep=COLUMNS)


@query(chain.sql(f"SELECT {ALL} FROM filtered", "filtered"))
def basic_filter(spark, d):
    return settled(chain.filtered(spark, d), keep=COLUMNS)


@query(chain.sql(f"SELECT {ALL} FROM deduped", "deduped"))
def dedup_as_coded(spark, d):
    return settled(chain.deduped(spark, d), keep=COLUMNS)


@query(chain.sql(f"SELECT {ALL} FROM filtered QUALIFY row_number() OVER (PARTITION BY mmsi, us ORDER BY {chain.MISSING} ASC, _ingest_order DESC) = 1", "filtered"))
def dedup_documented(spark, d):
    return settled(chain.deduped(spark, d, keep="fewest_missing"), keep=COLUMNS)


@query(chain.sql(f"""SELECT 'before' AS step, count(*) AS n, count(DISTINCT mmsi) AS vessels FROM filtered UNION ALL SELECT 'exact', count(*), count(DISTINCT mmsi) FROM (SELECT DISTINCT mmsi, us, {chain.DATA} FROM filtered)
  UNION ALL SELECT 'after', count(*), count(DISTINCT mmsi) FROM (SELECT DISTINCT mmsi, us FROM filtered)""", "filtered"))
def exact_dedup(spark, d):
    """Rows and vessels after each step; a fiftieth of the rows comes a second time, as it is, which exact rows drop."""
    df = chain.filtered(spark, d)
    twice = df.unionByName(df.where("_ingest_order % 50 = 0").withColumn("_ingest_order", F.col("_ingest_order") + 1))
    steps = {"before": df, "exact": ingest.exact_rows(twice), "after": ingest.dedup_messages(twice, exact=True)}
    counts = [f.agg(F.lit(name).alias("step"), F.count("*").alias("n"), F.count_distinct("mmsi").alias("vessels")) for name, f in steps.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(chain.sql(f"SELECT {ALL} FROM std", "std"))
def archived_messages(spark, d):
    """The raw messages as gzip files and as members of zip files, read back as archives and standardised."""
    def build():
        raw, path = raw_messages(spark, d), f"{shared_folder(spark)}/tidewake-archives-{uuid.uuid4().hex}"
        raw.where("_ingest_order % 2 = 0").write.option("header", True).option("compression", "gzip").csv(path + "/gzip")
        archives.write_zip(raw.where("_ingest_order % 2 = 1"), path + "/zip")
        found = archives.read_archives(spark, path, [c for c in raw.columns])
        return ingest.standardize(found.withColumn("_ingest_order", F.col("_ingest_order").cast("long")))

    return settled(stage(spark, "archived", d, build), keep=COLUMNS)


@query(chain.sql("SELECT mmsi, us AS timestamp_utc, sog, ship_class, cap AS soft_cap FROM clean", "clean"))
def speed_filter(spark, d):
    return settled(ingest.speed_filter(chain.deduped(spark, d)).withColumnRenamed("shiptype_soft_cap_knots", "soft_cap"), keep=("mmsi", "timestamp_utc", "sog", "ship_class", "soft_cap"))


@query(chain.sql("SELECT CASE WHEN sog > 55 THEN 'hard' WHEN sog > cap THEN 'soft' ELSE 'keep' END AS verdict, count(*) AS n FROM classed GROUP BY 1", "classed"))
def speed_filter_counts(spark, d):
    return ingest.with_class(chain.deduped(spark, d)).groupBy(ingest.speed_verdict().alias("verdict")).agg(F.count("*").alias("n"))


@query(chain.sql(f"SELECT DISTINCT ship_type, {chain.ship_class('ship_type')} AS ship_class, {chain.cap('(' + chain.ship_class('ship_type') + ')')} AS soft_cap FROM std", "std"))
def ship_class(spark, d):
    df = ingest.with_class(chain.standard(spark, d).select("ship_type").distinct())
    return df.withColumnRenamed("shiptype_soft_cap_knots", "soft_cap")


@query(chain.sql("""SELECT type_code, CASE WHEN CAST(type_code AS INT) BETWEEN 70 AND 79 THEN 'cargo' WHEN CAST(type_code AS INT) BETWEEN 80 AND 89 THEN 'tanker' WHEN CAST(type_code AS INT) BETWEEN 60 AND 69 THEN 'passenger'
  ELSE 'unknown' END AS ship_type, count(*) AS n FROM raw GROUP BY 1, 2""", "raw"))
def ship_type_codes(spark, d):
    return raw_messages(spark, d).groupBy("type_code", text.ship_type_of_code(F.col("type_code")).alias("ship_type")).agg(F.count("*").alias("n"))


@query(chain.sql("""SELECT nav_code, coalesce(['under way using engine', 'at anchor', 'not under command', 'restricted manoeuverability', 'constrained by draught', 'moored', 'aground', 'engaged in fishing', 'under way sailing'][CAST(nav_code AS INT) + 1], 'undefined') AS nav_status,
  count(*) AS n FROM raw GROUP BY 1, 2""", "raw"))
def nav_status_codes(spark, d):
    return raw_messages(spark, d).groupBy("nav_code", text.nav_status_of_code(F.col("nav_code")).alias("nav_status")).agg(F.count("*").alias("n"))


@query(chain.sql("SELECT s.mmsi % 4 AS source_part, count(*) AS input_rows, count(f.mmsi) AS output_rows, count(*) - count(f.mmsi) AS dropped_rows FROM std s LEFT JOIN filtered f ON s._ingest_order = f._ingest_order GROUP BY 1", "filtered"))
def ingest_manifest(spark, d):
    df = chain.standard(spark, d)
    ok = F.expr("mmsi is not null and timestamp_utc is not null and lat between -90 and 90 and lon between -180 and 180 and (sog is null or sog >= 0)")
    return df.groupBy((F.col("mmsi") % 4).alias("source_part")).agg(F.count("*").alias("input_rows"), F.count_if(ok).alias("output_rows"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("dropped_rows"))


@query(chain.sql("""SELECT mmsi % 64 AS part, count(*) AS n FROM deduped GROUP BY 1""", "deduped"))
def hash_partitions(spark, d):
    return chain.deduped(spark, d).groupBy(F.pmod("mmsi", F.lit(64)).alias("part")).agg(F.count("*").alias("n"))
