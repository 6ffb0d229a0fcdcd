"""Feed rows to tracks and features: each source is one select of Column expressions over its scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FT_M = 0.3048
KT_MPS = 1852.0 / 3600.0
FPM_MPS = FT_M / 60.0
EMERGENCY_SQUAWKS = ("7500", "7600", "7700")
#: Fixed values: "not available" of speed, course and true heading in AIS reports.
SOG_NONE, COG_NONE, HEADING_NONE = 102.3, 360.0, 511
POSITION_REPORTS = ("PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport")
#: Navigational status by code.
NAV_STATUS = {
    0: "under_way_using_engine", 1: "at_anchor", 2: "not_under_command", 3: "restricted_manoeuverability", 4: "constrained_by_draught", 5: "moored", 6: "aground", 7: "engaged_in_fishing",
    8: "under_way_sailing", 9: "reserved_hsc", 10: "reserved_wig", 11: "power_driven_towing_astern", 12: "power_driven_pushing_ahead", 13: "reserved", 14: "ais_sart_mob_epirb", 15: "undefined",
}
#: Ship types by code, then by decade.
SHIP_TYPE = {
    30: "fishing", 31: "towing", 32: "towing_long", 33: "dredging", 34: "diving", 35: "military", 36: "sailing", 37: "pleasure_craft", 50: "pilot", 51: "search_and_rescue", 52: "tug", 53: "port_tender",
    54: "anti_pollution", 55: "law_enforcement", 58: "medical_transport",
}
SHIP_DECADE = {2: "wing_in_ground", 4: "high_speed_craft", 6: "passenger", 7: "cargo", 8: "tanker"}
PERCENT_HIGH, PERCENT_NOMINAL = 80.0, 30.0
STEADY_MPS = 1.0


def finite(c: Column) -> Column:
    """c as a double; null for what is no number, NaN or infinite."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def valid_position(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def decoded(code: Column, table: dict[int, str]) -> Column:
    pairs = [F.lit(x) for k, v in table.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), code.cast("int"))


def filled(c: Column) -> Column:
    """c without outer blanks; null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def is_emergency(squawk: Column, emergency: Column) -> Column:
    state = F.lower(F.coalesce(F.trim(emergency), F.lit("")))
    return F.coalesce(squawk.isin(*EMERGENCY_SQUAWKS), F.lit(False)) | ~state.isin("", "none")


def parse_ranges(spec: str) -> list[tuple[int, int]]:
    """`lo-hi` blocks of hexadecimal addresses, comma-joined; a bare one is a block of one; malformed or reversed ones are skipped."""
    out = []
    for part in spec.split(","):
        low, dash, high = part.strip().partition("-")
        try:
            a, b = int(low, 16), int(high if dash else low, 16)
        except ValueError:
            continue
        if 0 <= a <= b:
            out.append((a, b))
    return out


def classify_military(hex_id: Column, db_flags: Column, non_icao: Column, ranges: list[tuple[int, int]] | None = None, held: Column | None = None) -> Column:
    """(basis, confidence) by provider flag (bit 0) and address block, null for neither. A few blocks may be given as ranges; with a table of them, held says whether one has the address (operators.ranges)."""
    provider = F.coalesce(db_flags.bitwiseAND(1) == 1, F.lit(False))
    address = F.conv(hex_id, 16, 10).cast("long")
    block = F.lit(False) if held is None else held
    for low, high in ranges or ():
        block = block | address.between(low, high)
    block = ~non_icao & F.coalesce(block, F.lit(False))
    made = lambda basis, confidence: F.struct(F.lit(basis).alias("basis"), F.lit(confidence).alias("confidence"))
    return F.when(provider & block, made("both", "medium")).when(provider, made("provider", "medium")).when(block, made("address_block", "low"))


def aircraft(rows: DataFrame, now_us: Column, source: str, local: bool, ranges: list[tuple[int, int]] = ()) -> DataFrame:
    """Tracks of receiver snapshots: columns hex, flight, lat, lon, alt_baro (string: a number or `ground`), alt_geom, gs, track, baro_rate, geom_rate, squawk, emergency, seen, seen_pos, dbFlags.

    Rows without an address go; an impossible position leaves the track without one and tags it."""
    raw = F.trim("hex")
    non_icao = F.startswith(raw, F.lit("~"))
    hex_id = F.lower(F.trim(F.when(non_icao, F.substring(raw, 2, 100)).otherwise(raw)))
    age = F.coalesce(finite(F.col("seen_pos")), finite(F.col("seen")), F.lit(0.0))
    lon, lat, ground = finite(F.col("lon")), finite(F.col("lat")), F.coalesce(F.col("alt_baro") == "ground", F.lit(False))
    placed = valid_position(lon, lat)
    altitude = F.when(ground, F.lit(0.0)).otherwise(F.coalesce(finite(F.col("alt_baro")), finite(F.col("alt_geom"))) * FT_M)
    base = rows.where(F.coalesce(hex_id, F.lit("")) != "").withColumns({"_hex": hex_id, "_non": non_icao, "_ground": ground, "_placed": placed})
    military = classify_military(F.col("_hex"), F.col("dbFlags"), F.col("_non"), list(ranges))
    bad = (lon.isNotNull() | lat.isNotNull()) & ~F.col("_placed")
    told = {"emergency": is_emergency(F.col("squawk"), F.col("emergency")), "on_ground": F.col("_ground"), "non_icao": F.col("_non"), "bad_position": bad, "military": military.isNotNull()}
    key = F.concat(F.lit("aircraft:icao:"), F.col("_hex"))
    return base.select(
        key.alias("correlation_key"), F.lit(source).alias("source"), F.lit("aircraft").alias("track_type"), (now_us - (age * 1_000_000).cast("long")).alias("observed_us"),
        F.when(F.col("_placed"), lon).alias("lon"), F.when(F.col("_placed"), lat).alias("lat"), altitude.alias("altitude_m"), (finite(F.col("gs")) * KT_MPS).alias("speed_mps"), finite(F.col("track")).alias("heading_deg"),
        (F.coalesce(finite(F.col("baro_rate")), finite(F.col("geom_rate"))) * FPM_MPS).alias("vertical_rate_mps"), F.coalesce(filled(F.col("flight")), F.upper("_hex")).alias("label"),
        F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in told.items()])).alias("tags"), military.alias("classification"), F.lit(local).alias("locally_received"))


def vessels(rows: DataFrame) -> DataFrame:
    """Tracks of AIS position reports: columns message_type, mmsi, latitude, longitude, meta_latitude, meta_longitude, sog, cog, true_heading, nav_status, ship_type."""
    lat, lon = F.coalesce(finite(F.col("latitude")), finite(F.col("meta_latitude"))), F.coalesce(finite(F.col("longitude")), finite(F.col("meta_longitude")))
    sog, cog, heading = finite(F.col("sog")), finite(F.col("cog")), finite(F.col("true_heading"))
    fit = F.col("message_type").isin(*POSITION_REPORTS) & valid_position(lon, lat)
    kind = F.col("ship_type")
    kind = F.when(kind.between(1, 99), F.coalesce(decoded(kind, SHIP_TYPE), decoded(F.floor(kind / 10), SHIP_DECADE), F.lit("other")))
    course = F.when((heading >= 0) & (heading < HEADING_NONE), heading).when((cog >= 0) & (cog < COG_NONE), cog)
    return rows.where(fit).select(
        F.concat(F.lit("ais:vessel:"), F.col("mmsi").cast("string")).alias("correlation_key"), lon.alias("lon"), lat.alias("lat"), F.when((sog >= 0) & (sog < SOG_NONE), sog * KT_MPS).alias("speed_mps"),
        course.alias("heading_deg"), F.col("nav_status").cast("int").alias("nav_status"), decoded(F.col("nav_status"), NAV_STATUS).alias("nav_status_text"), kind.alias("ship_type_text"))


def confidence_class(raw: Column) -> Column:
    """low, nominal or high of a letter, word or percentage."""
    s = F.lower(F.trim(raw))
    percent = finite(s)
    return F.when(s.isin("h", "high"), "high").when(s.isin("n", "nominal"), "nominal").when(s.isin("l", "low"), "low").when(percent >= PERCENT_HIGH, "high").when(percent >= PERCENT_NOMINAL, "nominal").when(percent.isNotNull(), "low")


def acquired(date: Column, time: Column) -> Column:
    """Timestamp of a date and an HHMM time without leading zeros; null if malformed."""
    hhmm = F.lpad(F.trim(time), 4, "0")
    return F.try_to_timestamp(F.concat_ws(" ", F.trim(date), hhmm), F.lit("yyyy-MM-dd HHmm"))


def fires(rows: DataFrame) -> DataFrame:
    """Features of fire detections (all columns strings). The id is made of the instrument, satellite, time and place as written."""
    lat, lon = finite(F.col("latitude")), finite(F.col("longitude"))
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    ident = F.concat(F.lit("fire:firms:"), F.coalesce(filled(F.col("instrument")), F.lit("sat")), F.lit(":"), F.coalesce(filled(F.col("satellite")), F.lit("?")), F.lit(":"), text("acq_date"), F.lit("T"), text("acq_time"), F.lit(":"), text("latitude"), F.lit(":"), text("longitude"))
    return rows.where(lat.isNotNull() & lon.isNotNull()).select(
        ident.alias("id"), lon.alias("lon"), lat.alias("lat"), F.unix_micros(acquired(F.col("acq_date"), F.col("acq_time"))).alias("observed_us"),
        confidence_class(F.col("confidence")).alias("confidence_class"), finite(F.col("frp")).alias("frp_mw"), F.coalesce(finite(filled(F.col("bright_ti4"))), finite(F.col("brightness"))).alias("brightness_k"))


def quakes(rows: DataFrame) -> DataFrame:
    """Features of earthquakes: columns id, type, mag, time (ms), alert, coordinates [lon, lat, depth km]. Depth is no altitude."""
    at = F.col("coordinates")
    return rows.where(F.col("id").isNotNull() & F.coalesce(F.col("type") == "earthquake", F.lit(True)) & (F.size(at) >= 2)).select(
        F.concat(F.lit("earthquake:usgs:"), F.col("id")).alias("id"), F.get(at, F.lit(0)).alias("lon"), F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(2)).alias("depth_km"),
        finite(F.col("mag")).alias("magnitude"), (F.col("time") * 1000).alias("observed_us"), F.col("alert").alias("severity"))


def sondes(rows: DataFrame) -> DataFrame:
    """Tracks of radiosonde frames: columns serial, lat, lon, alt, vel_h, vel_v, heading, type."""
    lat, lon, rise, heading = (finite(F.col(c)) for c in ("lat", "lon", "vel_v", "heading"))
    state = F.when(rise > STEADY_MPS, "ascending").when(rise < -STEADY_MPS, "descending").when(rise.isNotNull(), "float")
    return rows.where(filled(F.col("serial")).isNotNull() & valid_position(lon, lat)).select(
        F.concat(F.lit("sonde:"), F.col("serial")).alias("correlation_key"), lon.alias("lon"), lat.alias("lat"), finite(F.col("alt")).alias("altitude_m"), finite(F.col("vel_h")).alias("speed_mps"),
        F.when(heading.between(0, 360), heading).alias("heading_deg"), rise.alias("vertical_rate_mps"), state.alias("ascent_state"), F.concat_ws(" ", F.col("type"), F.col("serial")).alias("label"))


def aprs_uncompressed(lat: Column, lon: Column) -> Column:
    """(lat, lon, ambiguous) of DDMM.hhN and DDDMM.hhW; blanks are ambiguity and read as 0; null if malformed."""
    ambiguous = F.contains(F.substring(lat, 1, 7), F.lit(" ")) | F.contains(F.substring(lon, 1, 8), F.lit(" "))
    fit = lat.rlike(r"^[0-9 ]{4}\.[0-9 ]{2}[NSns]$") & lon.rlike(r"^[0-9 ]{5}\.[0-9 ]{2}[EWew]$")
    digits = lambda c, at, n: F.replace(F.substring(c, at, n), F.lit(" "), F.lit("0")).try_cast("double")
    degrees = lambda c, n: digits(c, 1, n) + digits(c, n + 1, 5) / 60
    signed = lambda c, n, minus: F.when(F.upper(F.right(c, F.lit(1))) == minus, -degrees(c, n)).otherwise(degrees(c, n))
    y, x = signed(lat, 2, "S"), signed(lon, 3, "W")
    return F.when(fit & valid_position(x, y), F.struct(y.alias("lat"), x.alias("lon"), ambiguous.alias("ambiguous")))


def base91(text: Column) -> Column:
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: s * 91 + F.ascii(c) - 33)


def aprs_compressed(text: Column) -> Column:
    """(lat, lon, course, speed_kt, altitude_m) of 13 bytes: table, latitude, longitude, symbol, two of course and speed or altitude, type."""
    lat, lon = 90 - base91(F.substring(text, 2, 4)) / 380_926, base91(F.substring(text, 6, 4)) / 190_463 - 180
    byte = lambda at: F.ascii(F.substring(text, at, 1)) - 33
    told = F.substring(text, 11, 1) != " "
    high = told & (byte(13).bitwiseAND(0x18) == 0x10)
    course = byte(11) * 4
    flat = told & ~high
    fit = text.rlike("^.[!-~]{8}....") & valid_position(lon, lat)
    return F.when(fit, F.struct(
        lat.alias("lat"), lon.alias("lon"), F.when(flat & course.between(1, 360), course.cast("double")).alias("course"),
        F.when(flat, F.pow(F.lit(1.08), byte(12)) - 1).alias("speed_kt"), F.when(high, F.pow(F.lit(1.002), byte(11) * 91 + byte(12)) * FT_M).alias("altitude_m")))


def key_time(key: Column) -> Column:
    """Start time in a file key, `_sYYYYDDDHHMMSSt`: year, day of year, time, tenths."""
    part = lambda at, n: F.substring(F.regexp_extract(key, r"_s(\d{14})", 1), at, n).try_cast("int")
    day = F.date_add(F.make_date(part(1, 4), F.lit(1), F.lit(1)), part(5, 3) - 1)
    return F.unix_micros(day.cast("timestamp")) + (part(8, 2) * 3600 + part(10, 2) * 60 + part(12, 2)).cast("long") * 1_000_000 + part(14, 1) * 100_000
