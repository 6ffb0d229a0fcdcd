"""Amateur-radio packets, one text line each, to tracks: what sent them, where it is and what it reports.

The grammar is a few slices of the line: header and payload, the kind that the payload's first character names,
then name, time and body by kind. Each is a column, so lines are read in one pass without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import normalise

# fixed values of the format: longest line, callsigns, data extension, altitude, weather fields
LONGEST = 1024
CALLSIGN = "^[A-Z0-9]{1,6}(-[A-Z0-9]{1,2})?$"
COURSE_SPEED = r"^(\d{3})/(\d{3})"
ALTITUDE = r"/A=(-?\d{6})"
ITEM = r"(?s)^\)(.{3,9}?)([!_])(.*)$"
WEATHER = {"gust_mph": r"g(\d{3})", "temp_f": r"t(-?\d{2,3})", "rain_last_hr_in": r"r(\d{3})", "rain_24h_in": r"p(\d{3})", "rain_since_midnight_in": r"P(\d{3})", "humidity_pct": r"h(\d{2})", "pressure_hpa": r"b(\d{5})"}
SPACE = " \t\r\n\x0b\x0c"
HOUR_US = 3_600_000_000
#: A day and hour that lie further ahead of the receipt belong to the month before.
AHEAD_US = 12 * HOUR_US


def stripped(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE))


def part(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def frame(line: Column) -> Column:
    """struct<call, dest, path, info> of SRC>DEST,PATH:INFO; null if it is no such line."""
    header, info = F.substring_index(line, ":", 1), F.substr(line, F.locate(":", line) + 1)
    call = F.upper(stripped(F.substring_index(header, ">", 1)))
    hops = F.transform(F.split(F.substr(header, F.locate(">", header) + 1), ","), stripped)
    fit = F.length(line).between(1, LONGEST) & line.contains(":") & header.contains(">") & call.rlike(CALLSIGN) & (info != "")
    return F.when(fit, F.struct(call.alias("call"), F.upper(hops[0]).alias("dest"), F.filter(F.slice(hops, 2, F.size(hops)), lambda h: h != "").alias("path"), info.alias("info")))


def instant(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    return F.unix_micros(F.try_make_timestamp(year, month, day, hour, minute, second.cast("decimal(8, 6)"), F.lit("UTC")))


def day_time(day: Column, hour: Column, minute: Column, received_us: Column) -> Column:
    """The instant of a day and hour nearest to the receipt: of its month, or the month before if that lies well ahead."""
    at, none = F.timestamp_micros(received_us), F.lit(0)
    before = F.add_months(F.trunc(at, "month"), -1)
    here = instant(F.year(at), F.month(at), day, hour, minute, none)
    return F.when(here - received_us > AHEAD_US, instant(F.year(before), F.month(before), day, hour, minute, none)).otherwise(here)


def stamp_time(stamp: Column, received_us: Column) -> Column:
    """Microseconds of DDHHMMz or DDHHMM/, HHMMSSh, or MMDDHHMM; null for any other form or time."""
    number = lambda at: F.substring(stamp, at, 2).try_cast("int")
    at = F.timestamp_micros(received_us)
    by_day = day_time(number(1), number(3), number(5), received_us)
    by_hour = instant(F.year(at), F.month(at), F.dayofmonth(at), number(1), number(3), number(5))
    in_month = day_time(number(3), number(5), number(7), received_us)
    back = F.timestamp_micros(in_month)
    moved = F.when(number(1).between(1, 12), instant(F.year(back), number(1), F.dayofmonth(back), F.hour(back), F.minute(back), F.lit(0))).otherwise(in_month)
    return F.when(stamp.rlike(r"^\d{6}[z/]"), by_day).when(stamp.rlike(r"^\d{6}h"), by_hour).when(stamp.rlike(r"^\d{8}"), moved)


def weather(data: Column) -> Column:
    """Reported weather in the units of its keys, and temp_c; a field that isn't there is null."""
    whole = lambda c: c.try_cast("int")
    found = {k: whole(part(data, p)).cast("double") for k, p in WEATHER.items()}
    scaled = {k: v / 100 if k.startswith("rain") else v / 10 if k == "pressure_hpa" else F.when(v == 0, F.lit(100.0)).otherwise(v) if k == "humidity_pct" else v for k, v in found.items()}
    run = r"c(\d{3})s(\d{3})"
    wind = [F.coalesce(whole(part(data, COURSE_SPEED, n)), whole(part(data, run, n))).cast("double") for n in (1, 2)]
    celsius = F.round((found["temp_f"] - 32) * 5 / 9, 2)
    return F.struct(wind[0].alias("wind_dir_deg"), wind[1].alias("wind_speed_mph"), *[v.alias(k) for k, v in scaled.items()], celsius.alias("temp_c"))


def position(body: Column, altitude: str = ALTITUDE) -> Column:
    """struct<lat, lon, symbol, course, speed_kt, altitude_m, ambiguous, comment, is_weather, weather> of a plain or compressed position; null if malformed."""
    piece = lambda at, n: F.substring(body, at, n)
    data, code = F.substr(body, F.lit(20)), piece(19, 1)
    at = normalise.aprs_uncompressed(piece(1, 8), piece(10, 9))
    course, speed = part(data, COURSE_SPEED, 1).try_cast("double"), part(data, COURSE_SPEED, 2).try_cast("double")
    rest = F.regexp_replace(data, COURSE_SPEED, "")
    said = stripped(F.regexp_replace(rest, F.lit(f"^(.*?){altitude}"), F.lit("$1")))
    moves = code != "_"
    plain = F.struct(
        at["lat"].alias("lat"), at["lon"].alias("lon"), F.concat(piece(9, 1), code).alias("symbol"), F.when(moves & course.between(1, 360), course).alias("course"), F.when(moves, speed).alias("speed_kt"),
        (part(rest, altitude).try_cast("double") * normalise.FT_M).alias("altitude_m"), at["ambiguous"].alias("ambiguous"), F.when(moves, said).otherwise("").alias("comment"), (~moves).alias("is_weather"), F.when(~moves, weather(data)).alias("weather"))
    c = normalise.aprs_compressed(piece(1, 13))
    squeezed = F.struct(
        c["lat"].alias("lat"), c["lon"].alias("lon"), F.concat(piece(1, 1), piece(10, 1)).alias("symbol"), c["course"].alias("course"), c["speed_kt"].alias("speed_kt"), c["altitude_m"].alias("altitude_m"),
        F.lit(False).alias("ambiguous"), stripped(F.substr(body, F.lit(14))).alias("comment"), (piece(10, 1) == "_").alias("is_weather"), F.when(F.lit(False), weather(data)).alias("weather"))
    return F.when(body.rlike("^[0-9 ]"), F.when((F.length(body) >= 19) & at.isNotNull(), plain)).otherwise(F.when((F.length(body) >= 13) & c.isNotNull(), squeezed))


def tracks(lines: DataFrame, line: str, received_us: Column, source: str, local: bool, altitude: str = ALTITUDE) -> DataFrame:
    """lines with correlation_key and the track's columns; those that are no packet of a known kind have a null correlation_key.

    Known are positions, objects, items, status and weather; a third-party packet is unwrapped once. Others (Mic-E, telemetry,
    messages), malformed lines and lines over LONGEST characters are not. Columns of lines must not bear names of the result.
    `altitude` is the pattern of feet in a comment, for feeds that write more digits than the format's six."""
    once = lambda df, name, c: df.select("*", F.explode(F.array(c)).alias(name))  # noqa: E731  worked out once, not in each use
    df = once(lines.withColumn("_received", received_us), "_outer", frame(stripped(F.col(line))))
    relayed = F.startswith(F.col("_outer.info"), F.lit("}"))
    df = once(df, "_f", F.when(relayed, frame(stripped(F.substr(F.col("_outer.info"), F.lit(2))))).otherwise(F.col("_outer")))
    info = F.col("_f.info")
    first = F.substring(info, 1, 1)
    cut = lambda start, n=None: F.substring(info, start, n) if n else F.substr(info, F.lit(start))
    of = lambda kind, **more: F.struct(F.lit(kind).alias("kind"), *[more.get(c, F.lit(None)).cast("string").alias(c) for c in ("name", "flag", "stamp", "body", "text")])
    shape = (
        F.when((first == ";") & (F.length(info) >= 18) & cut(11, 1).isin("*", "_"), of("object", name=stripped(cut(2, 9)), flag=cut(11, 1), stamp=cut(12, 7), body=cut(19)))
        .when((first == ")") & info.rlike(ITEM), of("item", name=stripped(part(info, ITEM, 1)), flag=part(info, ITEM, 2), body=part(info, ITEM, 3)))
        .when(first == ">", of("status", text=stripped(cut(2)))).when(first == "_", of("weather", stamp=cut(2, 8), text=cut(10)))
        .when(first.isin("!", "="), of("position", body=cut(2))).when(first.isin("/", "@"), of("position", stamp=cut(2, 7), body=cut(9))))
    df = once(df, "_k", shape)
    df = once(df, "_p", F.when(F.coalesce(F.col("_k.body"), F.lit("")) != "", position(F.col("_k.body"), altitude)))
    kind, p = F.col("_k.kind"), F.col("_p")
    named = kind.isin("object", "item")
    known = kind.isNotNull() & F.when(named, F.col("_k.name") != "").when(kind == "position", p.isNotNull()).otherwise(True)
    label = F.when(named, F.col("_k.name")).otherwise(F.col("_f.call"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    told = {"object": kind == "object", "item": kind == "item", "killed": named & (F.col("_k.flag") == "_"), "status": kind == "status", "position_ambiguity": p["ambiguous"], "weather": (kind == "weather") | yes(p["is_weather"]), "third_party": relayed}
    value = lambda c: F.when(known, c)
    return df.select(
        *lines.columns, value(F.concat(F.when(named, F.lit("aprs:object:")).otherwise(F.lit("aprs:station:")), label)).alias("correlation_key"), value(F.when(named, F.lit("aprs_object")).otherwise(F.lit("aprs_station"))).alias("track_type"), value(label).alias("label"),
        value(F.lit(source)).alias("source"), value(F.lit(local)).alias("locally_received"), value(F.coalesce(stamp_time(F.col("_k.stamp"), F.col("_received")), F.col("_received"))).alias("observed_us"), value(p["lon"]).alias("lon"), value(p["lat"]).alias("lat"),
        value(p["altitude_m"]).alias("altitude_m"), value(p["speed_kt"] * normalise.KT_MPS).alias("speed_mps"), value(p["course"]).alias("heading_deg"), value(F.array_compact(F.array(*[F.when(yes(c), F.lit(t)) for t, c in told.items()]))).alias("tags"),
        value(p["symbol"]).alias("symbol"), value(F.nullif(p["comment"], F.lit(""))).alias("comment"), value(F.when(kind == "status", F.col("_k.text"))).alias("status"), value(F.when(kind == "weather", weather(F.col("_k.text"))).otherwise(p["weather"])).alias("weather"),
        value(F.col("_f.dest")).alias("dest"), value(F.col("_f.path")).alias("path"), value(F.when(named, F.col("_f.call"))).alias("reported_by"), value(F.when(relayed, F.col("_outer.call"))).alias("relayed_by"))
