"""Notices of restricted airspace: nested XML to features with one ring an area, or to events where no ring can be built.

Defined results: a document that does not parse, or that adds no notice (a cancellation), gives no row. A bad
vertex voids its ring; the other rings stay and `dropped_areas` counts those that do not. Times of a zone that is
not known are null; the text stays beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

# fixed values: hours from universal time of the zones that notices name
ZONES = {"UTC": 0, "GMT": 0, "Z": 0, "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10, "HDT": -9, "SST": -11, "CHST": 10}
HOUR_US = 3_600_000_000

_fields = lambda *names: ", ".join(f"{n}: string" for n in names)
_limits = [f"{kind}DistVer{end}" for end in ("Upper", "Lower") for kind in ("val", "uom", "code")]
AREA = f"struct<aseTFRArea: struct<{_fields('txtName', *_limits)}>, abdMergedArea: struct<Avx: array<struct<{_fields('geoLat', 'geoLong')}>>>>"
NOTICE = f"struct<NotUid: struct<{_fields('txtLocalName', 'dateIssued')}>, {_fields('codeTimeZone', 'dateEffective', 'dateExpire', 'codeFacility', 'txtDescrPurpose')}, AffLocGroup: array<struct<{_fields('txtNameCity', 'txtNameUSState')}>>, TfrNot: struct<codeType: string, TFRAreaGroup: array<{AREA}>>>"
DOCUMENT = f"Group struct<Add: struct<Not: {NOTICE}>>"


def degrees(raw: Column, up: str, down: str, limit: float) -> Column:
    """Signed degrees of `30.32N`; null if the letter is none of the two or the value is beyond the limit."""
    value = F.regexp_extract(raw, rf"(?i)^\s*(\d+(?:\.\d+)?)\s*([{up}{down}])\s*$", 1).try_cast("double")
    return F.when(value <= limit, F.when(F.upper(F.right(F.trim(raw), F.lit(1))) == down, -value).otherwise(value))


def instant_us(raw: Column, zone: Column) -> Column:
    """Microseconds of a time that carries its offset, or of a local one in a zone that is known."""
    text = F.trim(raw)
    text = F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    hours = F.try_element_at(F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair]), F.upper(F.trim(F.coalesce(zone, F.lit("")))))
    own = F.unix_micros(F.try_to_timestamp(text))
    there = F.unix_micros(F.try_to_timestamp(F.concat(text, F.lit("Z")))) - hours * HOUR_US
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]"), F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), own).otherwise(there))


def ring(area: Column) -> Column:
    """The area's closed ring of (lon, lat), null if a vertex is bad or there are under three."""
    points = F.transform(area["abdMergedArea"]["Avx"], lambda v: F.array(degrees(v["geoLong"], "E", "W", 180.0), degrees(v["geoLat"], "N", "S", 90.0)))
    sound = (F.size(points) >= 3) & ~F.exists(points, lambda p: p[0].isNull() | p[1].isNull())
    closed = F.when(F.get(points, F.lit(0)) == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))
    return F.when(sound, closed)


def _limit(area: Column, end: str) -> Column:
    return F.struct(*[area["aseTFRArea"][f"{kind}DistVer{end}"].alias(name) for kind, name in (("val", "value"), ("uom", "unit"), ("code", "basis"))])


def notices(docs: DataFrame, key: str, xml: str, listed: str, received_us: str) -> DataFrame:
    """A row a notice: kind `feature` with its rings and areas, or `event` where none has a ring."""
    read = docs.select(F.col(key), F.col(listed).alias("_listed"), F.col(received_us).alias("_received"), F.from_xml(F.col(xml), DOCUMENT, {"mode": "PERMISSIVE"}).alias("_d"))
    read = read.select(key, "_listed", "_received", F.col("_d.Group.Add.Not").alias("n")).where("n is not null")
    areas = F.coalesce(F.col("n.TfrNot.TFRAreaGroup"), F.array().cast(f"array<{AREA}>"))
    each = F.transform(areas, lambda a: F.struct(ring(a).alias("ring"), a["aseTFRArea"]["txtName"].alias("name"), _limit(a, "Upper").alias("upper"), _limit(a, "Lower").alias("lower")))
    read = read.withColumn("_areas", each).withColumn("areas", F.filter("_areas", lambda a: a["ring"].isNotNull()))
    place = lambda g: F.array_join(F.filter(F.array(g["txtNameCity"], g["txtNameUSState"]), lambda x: x != ""), ", ")
    name, zone, sound = F.col("n.NotUid.txtLocalName"), F.col("n.codeTimeZone"), F.size("areas") > 0
    said = F.concat(F.lit("Restriction "), F.col(key).cast("string"))
    return read.select(
        key, F.when(sound, "feature").otherwise("event").alias("kind"), F.coalesce(instant_us(F.col("n.NotUid.dateIssued"), F.lit("UTC")), F.col("_received")).alias("observed_us"), F.col("_received").alias("received_us"),
        F.when(sound, F.transform("areas", lambda a: a["ring"])).alias("rings"), F.transform("areas", lambda a: a.dropFields("ring")).alias("areas"), (F.size("_areas") - F.size("areas")).alias("dropped_areas"),
        instant_us(F.col("n.dateEffective"), zone).alias("valid_from_us"), instant_us(F.col("n.dateExpire"), zone).alias("valid_until_us"), F.col("n.dateEffective").alias("effective_local"), F.col("n.dateExpire").alias("expire_local"), zone.alias("zone"),
        F.when(sound, F.coalesce(name, said)).otherwise(F.concat(said, F.coalesce(F.concat(F.lit(", "), name), F.lit("")), F.lit(": no usable geometry"))).alias("label"),
        F.filter(F.transform(F.coalesce(F.col("n.AffLocGroup"), F.array().cast("array<struct<txtNameCity: string, txtNameUSState: string>>")), place), lambda x: x != "").alias("places"),
        F.col("n.TfrNot.codeType").alias("section"), F.col("n.codeFacility").alias("facility"), F.col("n.txtDescrPurpose").alias("purpose"), F.lower("_listed").alias("listed"))


def near(rings: Column, lon: float, lat: float, radius_m: float) -> Column:
    """A vertex within reach, or the place inside a ring (even-odd); without rings false.

    Which side of an edge the place is on is told from the place's own frame, where differences to vertices are exact or nearly so. An edge through the place counts as east of it."""
    x, y = F.lit(lon), F.lit(lat)

    def holds(r: Column) -> Column:
        sides = F.arrays_zip(F.slice(r, F.lit(1), F.size(r) - 1).alias("a"), F.slice(r, F.lit(2), F.size(r) - 1).alias("b"))
        spans = F.filter(sides, lambda s: (s["a"][1] > y) != (s["b"][1] > y))
        turn = lambda s: (s["a"][0] - x) * (s["b"][1] - y) - (s["a"][1] - y) * (s["b"][0] - x)  # noqa: E731  positive: the place lies left of the edge
        east = F.filter(spans, lambda s: F.when(s["b"][1] > y, turn(s) >= 0).otherwise(turn(s) <= 0))
        return F.size(east) % 2 == 1

    reached = F.exists(F.flatten(rings), lambda p: geo.haversine_m(p[0], p[1], x, y) <= radius_m)
    return F.coalesce(reached | F.exists(rings, holds), F.lit(False))
