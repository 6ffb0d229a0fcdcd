"""Element sets to predicted tracks and passes.

Elements are rows of norad_id, object_id, object_name, epoch_us and the mean elements. Each row is propagated by
itself, in Arrow batches of arrays. Rows are dealt to all cores first: the work is in the times, and a table of many
elements may be a file that one task reads.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import orbital, propagator

# the propagator travels with the jobs, so that workers need not find this package
cloudpickle.register_pickle_by_value(propagator)

OMM = ", ".join(f"{c} string" for c in ("OBJECT_NAME", "OBJECT_ID", "EPOCH", "MEAN_MOTION", "ECCENTRICITY", "INCLINATION", "RA_OF_ASC_NODE", "ARG_OF_PERICENTER", "MEAN_ANOMALY", "NORAD_CAT_ID", "BSTAR"))
#: Above this a pass counts, degrees.
PASS_FLOOR = 10.0


def element_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of files that are a JSON array of element messages, numbers or strings alike."""
    return spark.read.schema(OMM).json(path, multiLine=True)


def elements(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, skipped messages): a message without a catalogue number, an epoch or a mean element is skipped, none is half-built."""
    number = lambda c: F.expr(f"try_cast(trim({c}) as double)")
    told = messages.withColumns({
        "norad_id": F.expr("try_cast(trim(NORAD_CAT_ID) as long)"), "epoch_us": F.unix_micros(F.try_to_timestamp("EPOCH")), "mean_motion": number("MEAN_MOTION"), "eccentricity": number("ECCENTRICITY"), "inclination": number("INCLINATION"),
        "node": number("RA_OF_ASC_NODE"), "perigee": number("ARG_OF_PERICENTER"), "anomaly": number("MEAN_ANOMALY"), "bstar": number("BSTAR")})
    needed = ["norad_id", "epoch_us", *propagator.ELEMENTS]
    whole = F.lit(True)
    for c in needed:
        whole = whole & F.col(c).isNotNull() & (~F.isnan(c) if c in propagator.ELEMENTS else F.lit(True))
    kept = told.where(whole).withColumn("object_name", F.coalesce(F.nullif(F.trim("OBJECT_NAME"), F.lit("")), F.concat(F.lit("NORAD "), F.col("norad_id").cast("string")))).withColumn("object_id", F.coalesce(F.nullif(F.trim("OBJECT_ID"), F.lit("")), F.lit("?")))
    return kept.select("norad_id", "object_id", "object_name", "epoch_us", *propagator.ELEMENTS), told.where(~F.coalesce(whole, F.lit(False))).select(messages.columns)


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt evenly to some tasks a core. A number of tasks is given, since by their few bytes they would be put together again."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def propagated(at_us: Column) -> Column:
    """struct<x, y, z, vx, vy, vz> (km, km/s; true equator, mean equinox) of elements at a time; null where the model has no position."""

    @F.pandas_udf("x double, y double, z double, vx double, vy double, vz double")
    def places(mean_motion: pd.Series, eccentricity: pd.Series, inclination: pd.Series, node: pd.Series, perigee: pd.Series, anomaly: pd.Series, bstar: pd.Series, minutes: pd.Series) -> pd.DataFrame:
        found = propagator.positions(mean_motion, eccentricity, inclination, node, perigee, anomaly, bstar, minutes)
        return pd.DataFrame(dict(zip(("x", "y", "z", "vx", "vy", "vz"), found, strict=True)))

    return places(*[F.col(c).cast("double") for c in propagator.ELEMENTS], (at_us - F.col("epoch_us")) / 60e6)


def predicted_tracks(rows: DataFrame, at_us: Column, station: tuple[float, float, float], valid_s: float = 30.0, floor_deg: float | None = None) -> DataFrame:
    """Tracks of elements at a time: place below, height, look angles from the station (lon, lat, altitude_m).

    Rows that have no position go; so do those below floor_deg, if given. Other columns of rows ride along."""
    km = F.lit(1000.0)
    named = spread(rows).withColumn("_at", at_us).withColumn("_p", propagated(F.col("_at"))).where(F.col("_p.x").isNotNull())
    fixed = named.withColumn("_e", orbital.teme_to_ecef(F.col("_p.x") * km, F.col("_p.y") * km, F.col("_p.z") * km, F.col("_at")))
    here = fixed.withColumn("_g", orbital.ecef_to_geodetic(F.col("_e.x"), F.col("_e.y"), F.col("_e.z"))).withColumn("_l", orbital.look_angles(F.col("_e.x"), F.col("_e.y"), F.col("_e.z"), F.lit(station[1]), F.lit(station[0]), F.lit(station[2])))
    if floor_deg is not None:
        here = here.where(F.col("_l.elevation") >= floor_deg)
    key = F.concat(F.lit("orbital:element:"), F.col("norad_id").cast("string"))
    return here.select(
        *rows.columns, key.alias("correlation_key"), F.lit("orbital_object").alias("track_type"), F.col("_at").alias("observed_us"), F.lit(True).alias("predicted"), F.lit(False).alias("locally_received"),
        F.col("_g.lon").alias("lon"), F.col("_g.lat").alias("lat"), F.col("_g.alt_m").alias("altitude_m"), F.col("_l.azimuth").alias("azimuth_deg"), F.col("_l.elevation").alias("elevation_deg"), F.col("_l.range_m").alias("slant_range_m"),
        ((F.col("_at") - F.col("epoch_us")) / 1e6).alias("element_age_s"), (F.col("_at") + F.lit(int(valid_s * 1e6))).alias("valid_until_us"))


def next_passes(rows: DataFrame, start_us: int, station: tuple[float, float, float], window_s: float = 86_400.0, floor_deg: float = PASS_FLOOR, step_s: float = 30.0) -> DataFrame:
    """rows with rise_us, culmination_us, set_us and peak_deg of the pass in work at start_us or else next; null without one, or where the orbit fails within the window."""
    lon, lat, alt = station

    @F.pandas_udf("rise_us double, culmination_us double, set_us double, peak_deg double")
    def passes(epoch: pd.Series, mean_motion: pd.Series, eccentricity: pd.Series, inclination: pd.Series, node: pd.Series, perigee: pd.Series, anomaly: pd.Series, bstar: pd.Series) -> pd.DataFrame:
        arrays = [np.asarray(x, float) for x in (mean_motion, eccentricity, inclination, node, perigee, anomaly, bstar)]
        found = propagator.next_passes(arrays, np.asarray(epoch, float), start_us, window_s, step_s, floor_deg, lat, lon, alt)
        return pd.DataFrame(dict(zip(("rise_us", "culmination_us", "set_us", "peak_deg"), found, strict=True)))

    told = spread(rows).withColumn("_p", passes(F.col("epoch_us").cast("double"), *[F.col(c).cast("double") for c in propagator.ELEMENTS]))
    return told.select(*rows.columns, *[F.col(f"_p.{c}").cast("long").alias(c) for c in ("rise_us", "culmination_us", "set_us")], "_p.peak_deg")
