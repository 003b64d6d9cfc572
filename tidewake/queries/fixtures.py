"""Vessel messages derived from the events table by closed-form SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import stage

#: Numbers are in scientific notation, which both engines read as doubles. Fleets of sixteen vessels in four groups that sail together,
#: one fleet for each ten thousand events. Every field has its sentinels, nulls, duplicates and jumps.
FIX = """
  SELECT event_id, 219001000 + fleet * 16 + k AS mmsi, k, j, g, rn, epoch, v, dir,
    5.5e1 - fleet % 20 * 3e0 + g * 5e-1 + j * 8e-3 + v * cos(dir) * (epoch - 1704067200) / 1.1119493e5 + 4e-3 * sin((epoch - 1704067200) / 9e2)
      + CASE WHEN g = 1 AND event_id % 31 = 0 THEN 3e-3 WHEN event_id % 307 = 0 THEN 5e-2 ELSE 0e0 END AS lat,
    1e1 + CAST(floor(fleet / 20) AS BIGINT) % 40 * 3e0 + g * 4e-1 + j * 3e-3 + v * sin(dir) * (epoch - 1704067200) / 6.34e4 AS lon
  FROM (
    SELECT event_id, k, fleet, rn, CAST(k % 4 AS BIGINT) AS j, CAST(floor(k / 4) AS BIGINT) AS g,
      1704067200 + rn * 20 + (event_id % 3) * 5 + CAST(floor(rn / 31) AS BIGINT) * 80 + CAST(floor(rn / 97) AS BIGINT) * 700 + CAST(floor(rn / 433) AS BIGINT) * 160 AS epoch,
      CASE WHEN k = 15 THEN 5e-2 WHEN k < 4 THEN 6e0 WHEN k < 8 THEN 1.7e1 WHEN k < 12 THEN 8e0 ELSE 5e0 END AS v,
      CASE WHEN k < 4 THEN 6e-1 WHEN k < 8 THEN 2.1e0 WHEN k < 12 THEN 4e0 ELSE 5.2e0 END AS dir
    FROM (SELECT event_id, vessel % 16 AS k, CAST(floor(vessel / 16) AS BIGINT) AS fleet, row_number() OVER (PARTITION BY vessel ORDER BY ts, event_id) - 1 AS rn
      FROM (SELECT event_id, ts, user_id % (SELECT 16 * greatest(1, CAST(floor(count(*) / 1e4) AS BIGINT)) FROM {events}) AS vessel FROM {events}) q) e
  ) m
"""
#: The fields as a source file of the first dialect has them, as text; every fiftieth message twice, once with less in it.
RAW = """
  SELECT event_id * 2 + copy AS _ingest_order, epoch, CAST(mmsi AS VARCHAR(12)) AS mmsi_text,
    CASE WHEN event_id % 401 = 0 THEN '91' ELSE CAST(CAST(lat AS DECIMAL(12,6)) AS VARCHAR(20)) END AS lat_text, CAST(CAST(lon AS DECIMAL(12,6)) AS VARCHAR(20)) AS lon_text,
    CASE WHEN event_id % 53 = 0 THEN '102.3' WHEN event_id % 41 = 0 THEN ' Unknown ' WHEN event_id % 211 = 0 THEN '56.5' WHEN event_id % 601 = 0 THEN '-1' WHEN k = 15 THEN '0.2'
      ELSE CAST(CAST(v * 1.94384 + (event_id % 7 - 3) * 0.1 AS DECIMAL(8,1)) AS VARCHAR(12)) END AS sog_text,
    CASE WHEN event_id % 59 = 0 THEN '360.0' WHEN copy = 1 THEN '' ELSE CAST(CAST(dir * 57.29578 + event_id % 5 - 2 AS DECIMAL(8,1)) AS VARCHAR(12)) END AS cog_text,
    CASE WHEN event_id % 37 = 0 THEN '511' ELSE CAST(CAST(floor(dir * 57.29578) AS BIGINT) + event_id % 3 AS VARCHAR(12)) END AS heading_text,
    CASE WHEN k = 5 AND CAST(floor(rn / 40) AS BIGINT) % 5 = 2 THEN 'At  Anchor' WHEN k = 13 AND CAST(floor(rn / 50) AS BIGINT) % 4 = 1 THEN ' Moored' WHEN event_id % 29 = 0 THEN 'Undefined' ELSE 'Under way using  engine' END AS nav_text,
    CASE WHEN k IN (0, 4) THEN 'Cargo' WHEN k IN (1, 5) THEN 'Tanker' WHEN k IN (2, 6) THEN 'HSC Ferry' WHEN k = 3 THEN 'Passenger' WHEN k = 7 THEN 'Bulk carrier' WHEN k = 8 THEN 'Container ship'
      WHEN k = 9 THEN 'Fishing' WHEN k = 10 THEN 'Tug' WHEN k = 11 THEN 'Pilot vessel' WHEN k = 12 THEN 'Pleasure craft' WHEN k = 13 THEN 'Undefined' ELSE 'Cargo, hazardous' END AS type_text,
    CAST(80 + k * 10 AS VARCHAR(12)) AS length_text, CAST(12 + k AS VARCHAR(12)) AS width_text, CASE WHEN event_id % 11 = 0 THEN 'None' ELSE '6.1' END AS draught_text,
    CASE WHEN k % 3 = 0 THEN '' ELSE CAST(9111111 + k AS VARCHAR(12)) END AS imo_text,
    CAST(60 + event_id % 40 AS VARCHAR(12)) AS type_code, CAST(event_id % 17 AS VARCHAR(12)) AS nav_code
  FROM (SELECT f.*, 0 AS copy FROM ({fix}) f UNION ALL SELECT f.*, 1 AS copy FROM ({fix}) f WHERE event_id % 50 = 0) u
""".replace("{fix}", FIX)
HEADER = {
    "mmsi_text": "MMSI", "lat_text": "Latitude", "lon_text": "Longitude", "sog_text": "SOG", "cog_text": "COG", "heading_text": "Heading", "nav_text": "Navigational status", "type_text": "Ship type",
    "length_text": "Length", "width_text": "Width", "draught_text": "Draught", "imo_text": "IMO",
}


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string messages under the first dialect's header; a stage, as it stands for a source."""
    return stage(spark, "raw", sf_dir, lambda: _raw(spark, sf_dir))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.sql(RAW, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    raw = raw.withColumnsRenamed(HEADER).withColumn("# Timestamp", F.date_format(F.timestamp_seconds("epoch"), "dd/MM/yyyy HH:mm:ss"))
    return raw


def settled(df: DataFrame, *, keep: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """For comparison across engines: times as microseconds, doubles to some decimals."""
    def column(name: str, kind: str) -> Column:
        if kind.startswith("timestamp"):
            return F.unix_micros(name).alias(name)
        return F.round(name, digits).alias(name) if kind == "double" else F.col(name)

    return df.select(*[column(n, k) for n, k in df.dtypes if not keep or n in keep])




DUCK_RAW = RAW.format(events="events")
