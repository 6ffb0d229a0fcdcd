"""Scans of feed files: snapshots, message lines and tables as DataFrames with the columns that the normalisers take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RECORD_BYTES = 65_536
AIRCRAFT = "struct<hex:string,flight:string,lat:double,lon:double,alt_baro:string,alt_geom:double,gs:double,track:double,baro_rate:double,geom_rate:double,squawk:string,emergency:string,seen:double,seen_pos:double,dbFlags:int>"
QUAKES = "features array<struct<id:string,properties:struct<mag:double,place:string,time:bigint,updated:bigint,type:string,alert:string>,geometry:struct<coordinates:array<double>>>>"
SONDE = "map<string,map<string,struct<lat:double,lon:double,alt:double,vel_h:double,vel_v:double,heading:double,datetime:string,type:string,frame:int>>>"
BODY = "map<string,struct<Latitude:double,Longitude:double,Sog:double,Cog:double,TrueHeading:int,NavigationalStatus:int>>"
AIS = f"MessageType string, MetaData struct<MMSI:bigint,latitude:double,longitude:double,time_utc:string>, Message {BODY}"
FIRE = ("latitude", "longitude", "bright_ti4", "bright_ti5", "brightness", "bright_t31", "acq_date", "acq_time", "satellite", "instrument", "confidence", "frp", "daynight")


def snapshots(spark: SparkSession, path: str, field: str = "aircraft", now_unit_us: int = 1_000_000) -> DataFrame:
    """Receiver snapshots (field `aircraft`, now in seconds) or regional answers (field `ac`, now in milliseconds)."""
    raw = spark.read.schema(f"now double, {field} array<{AIRCRAFT}>").json(path, multiLine=True)
    return raw.select((F.col("now") * now_unit_us).cast("long").alias("now_us"), F.explode(field).alias("a")).select("now_us", "a.*")


def ais_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of at most MAX_RECORD_BYTES; lines that are no JSON go."""
    lines = spark.read.text(path).where(F.octet_length("value") <= MAX_RECORD_BYTES)
    m = lines.select(F.from_json("value", AIS).alias("m")).select("m.*").where("MessageType is not null")
    body = F.try_element_at("Message", F.col("MessageType"))
    return m.select(
        F.col("MessageType").alias("message_type"), F.col("MetaData.MMSI").alias("mmsi"), body["Latitude"].alias("latitude"), body["Longitude"].alias("longitude"), F.col("MetaData.latitude").alias("meta_latitude"),
        F.col("MetaData.longitude").alias("meta_longitude"), body["Sog"].alias("sog"), body["Cog"].alias("cog"), body["TrueHeading"].alias("true_heading"), body["NavigationalStatus"].alias("nav_status"), F.lit(None).cast("int").alias("ship_type"))


def ais_rejects(spark: SparkSession, path: str) -> DataFrame:
    """`value`: the lines that ais_lines() doesn't take, being too long, malformed or without a message type."""
    lines = spark.read.text(path)
    kind = F.when(F.octet_length("value") <= MAX_RECORD_BYTES, F.from_json("value", AIS)["MessageType"])
    return lines.where(kind.isNull())


def packet_lines(spark: SparkSession, path: str) -> DataFrame:
    """`value`: lines of a packet feed, without empty ones and the server's own, which begin with #."""
    return spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")


def quake_files(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.schema(QUAKES).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return f.select("f.id", "f.properties.type", "f.properties.mag", "f.properties.time", "f.properties.updated", "f.properties.alert", "f.geometry.coordinates")


def sonde_files(spark: SparkSession, path: str) -> DataFrame:
    """The newest frame of each sonde of each file."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", SONDE)).alias("serial", "frames"))
    newest = F.element_at("frames", F.array_max(F.map_keys("frames")))
    return raw.select("serial", newest.alias("f")).select("serial", "f.*")


def fire_files(spark: SparkSession, path: str) -> DataFrame:
    """Fire tables of either column set; a file without a latitude column is an error message, not a table."""
    raw = spark.read.csv(path, header=True)
    if "latitude" not in raw.columns:
        raise ValueError(f"no fire table: {raw.columns[:3]}")
    return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in FIRE])


def record_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, quarantined) JSON lines of one record kind; too long or malformed ones are quarantined, none is lost."""
    lines = spark.read.text(path)
    read = lines.select("value", F.when(F.octet_length("value") <= MAX_RECORD_BYTES, F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return read.where(~bad).select("r.*").drop("_bad"), read.where(bad).select("value")
