"""The observation view: the events table read as observations of moving things, hour for second.

The view's rows of one identity lie hours apart, so all windows are scaled: UNIT_US stands for a second."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT_US = 3_600_000_000
AS_OF_US = int(datetime(2024, 1, 29, 12, tzinfo=UTC).timestamp() * 1_000_000)
DAY_US = 86_400_000_000
STATION = (-95.0, 40.0)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    n, user = F.col("event_id"), F.col("user_id")
    kind = F.col("event_type")
    observed = F.unix_micros(F.col("ts").cast("timestamp"))
    source = F.when(kind == "view", "local_adsb").when(kind == "click", "network_adsb").when(kind == "purchase", "ais").when(kind == "signup", "aprs_is").otherwise("local_aprs")
    track_type = F.when(user % 3 == 0, "aircraft").when(user % 3 == 1, "vessel").otherwise("aprs_station")
    known = lambda every, c: F.when(n % every != 0, c)
    return e.select(
        n.alias("obs_id"), F.concat(F.lit("trk:"), user.cast("string")).alias("identity"), source.alias("source"), kind.isin("view", "error").alias("local_rf"), track_type.alias("track_type"),
        observed.alias("observed_us"), (observed + n % 7 * 1_000_000).alias("received_us"), n.alias("ord"),
        known(11, F.expr("cast(-95.0 + (user_id % 20) * 0.05 + (event_id % 97) * 0.001 as double)")).alias("lon"),
        known(11, F.expr("cast(40.0 + (user_id % 13) * 0.05 + (event_id % 89) * 0.001 as double)")).alias("lat"),
        known(7, F.col("value") * 100.0).alias("altitude_m"), known(5, F.col("value")).alias("speed_mps"), (n * 37 % 360).cast("double").alias("heading_deg"),
        known(3, F.concat(F.lit("L"), user.cast("string"))).alias("label"), ((kind == "error") & (F.col("value") > 200.0)).alias("emergency"),
        F.get_json_object("props", "$.k").cast("int").alias("attr_k"))


#: The same view for DuckDB, as the first table expression of a statement.
OBS_SQL = """obs as (select event_id as obs_id, concat('trk:', cast(user_id as varchar)) as identity,
  case event_type when 'view' then 'local_adsb' when 'click' then 'network_adsb' when 'purchase' then 'ais' when 'signup' then 'aprs_is' else 'local_aprs' end as source,
  event_type in ('view', 'error') as local_rf,
  case user_id % 3 when 0 then 'aircraft' when 1 then 'vessel' else 'aprs_station' end as track_type,
  epoch_us(ts) as observed_us, epoch_us(ts) + (event_id % 7) * 1000000 as received_us, event_id as ord,
  case when event_id % 11 = 0 then null else cast(-95.0 + (user_id % 20) * 0.05 + (event_id % 97) * 0.001 as double) end as lon,
  case when event_id % 11 = 0 then null else cast(40.0 + (user_id % 13) * 0.05 + (event_id % 89) * 0.001 as double) end as lat,
  case when event_id % 7 = 0 then null else value * 100.0 end as altitude_m,
  case when event_id % 5 = 0 then null else value end as speed_mps,
  cast((event_id * 37) % 360 as double) as heading_deg,
  case when event_id % 3 = 0 then null else concat('L', cast(user_id as varchar)) end as label,
  event_type = 'error' and value > 200.0 as emergency, cast(json_extract_string(props, '$.k') as int) as attr_k
  from events)"""
