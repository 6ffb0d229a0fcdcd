"""Predicates over fused tracks and records. An inactive filter is None; active ones are joined with AND."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

SEVERITY = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
CONFIDENCE = {"low": 0, "nominal": 1, "high": 2}


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def contains(c: Column, part: str) -> Column:
    return yes(F.contains(F.lower(c), F.lit(part.lower())))


def ranked(c: Column, ladder: dict[str, int], missing: int = -1) -> Column:
    out = F.lit(missing)
    for name, rank in ladder.items():
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def at_least_confidence(c: Column, floor: str) -> Column:
    return ranked(c, CONFIDENCE) >= CONFIDENCE[floor]


def severity_meets(c: Column, threshold: str) -> Column:
    return ranked(c, SEVERITY, 0) >= SEVERITY.get(threshold, 0)


@dataclass(frozen=True)
class Display:
    """What a client shows of tracks. Columns: locally_received, contributors (array of local_rf, fresh), source, track_type, lon, lat,
    altitude_m, speed_mps, observed_us, military, basis, ship_type, nav_status, name, mmsi, destination, label, category, elevation_deg, watch_key."""

    provenance: str = "all"
    live_local_only: bool = False
    sources: tuple[str, ...] | None = None
    track_types: tuple[str, ...] | None = None
    station: tuple[float, float] | None = None
    range_m: float | None = None
    altitude: tuple[float | None, float | None] = (None, None)
    speed: tuple[float | None, float | None] = (None, None)
    max_age_s: float | None = None
    military: str = "all"
    basis: tuple[str, ...] | None = None
    ship_types: tuple[str, ...] | None = None
    nav_statuses: tuple[str, ...] | None = None
    name: str = ""
    mmsi: str = ""
    destination: str = ""
    callsign: str = ""
    categories: tuple[str, ...] | None = None
    min_elevation: float | None = None

    def predicate(self, now_us: int, unit_us: int = 1_000_000) -> Column:
        c, active = F.col, []
        if self.provenance != "all":
            active.append(yes(c("locally_received")) == (self.provenance == "local"))
        if self.live_local_only:
            heard = F.exists("contributors", lambda x: x["local_rf"] & (x["fresh"] == "live"))
            active.append(yes(F.coalesce(heard, c("locally_received"))))
        for name, wanted in (("source", self.sources), ("track_type", self.track_types), ("ship_type", self.ship_types), ("nav_status", self.nav_statuses)):
            if wanted is not None:
                active.append(yes(c(name).isin(*wanted)))
        if self.range_m is not None and self.station:
            active.append(yes(geo.haversine_m(c("lon"), c("lat"), *self.station, radius=geo.DISPLAY_EARTH_M) <= self.range_m))
        for name, (low, high) in (("altitude_m", self.altitude), ("speed_mps", self.speed)):
            active += [yes(c(name) >= low)] if low is not None else []
            active += [yes(c(name) <= high)] if high is not None else []
        if self.max_age_s is not None:
            age = F.greatest(F.lit(0.0), (F.lit(now_us) - c("observed_us")) / unit_us)
            active.append(F.coalesce(age <= self.max_age_s, F.lit(True)))
        if self.military != "all":
            active.append(c("military").eqNullSafe(F.lit(self.military == "military")))
        if self.basis is not None:
            active.append(F.coalesce("basis", F.lit("unknown")).isin(*self.basis))
        for name, part in (("name", self.name), ("mmsi", self.mmsi), ("destination", self.destination), ("label", self.callsign)):
            if part:
                active.append(contains(c(name), part))
        orbital = c("track_type") == "orbital_object"
        if self.categories is not None:
            active.append(F.when(orbital, yes(c("category").isin(*self.categories))).otherwise(F.lit(True)))
        if self.min_elevation is not None:
            active.append(F.when(orbital, yes(c("elevation_deg") >= self.min_elevation)).otherwise(F.lit(True)))
        return reduce(and_, active, F.lit(True))


@dataclass(frozen=True)
class Subscription:
    """What a client is sent. Columns: kind, source, track_type, vertices (array of [lon, lat]; null without geometry: such features never pass, such tracks and events always do). Other kinds pass."""

    bbox: tuple[float, float, float, float] | None = None
    sources: tuple[str, ...] | None = None
    track_types: tuple[str, ...] | None = None
    events: bool = True
    alerts: bool = True

    def predicate(self) -> Column:
        kind, shape = F.col("kind"), F.col("vertices")
        inside = F.lit(True) if self.bbox is None else F.exists(shape, lambda p: geo.in_bbox(p[0], p[1], *self.bbox))
        member = lambda c, wanted: F.lit(True) if wanted is None else yes(F.col(c).isin(*wanted)) if wanted else F.lit(False)
        track = member("source", self.sources) & member("track_type", self.track_types) & F.coalesce(inside, F.lit(True))
        feature = member("source", self.sources) & shape.isNotNull() & F.coalesce(inside, F.lit(False))
        event = F.lit(self.events) & F.coalesce(inside, F.lit(True))
        return F.when(kind == "source_status", F.lit(True)).when(kind == "alert", F.lit(self.alerts)).when(kind == "event", event).when(kind == "track", track).when(kind == "feature", feature).otherwise(F.lit(True))


def station_box(lon: float, lat: float, radius_nm: float) -> tuple[float, float, float, float] | None:
    """The box a client may not look beyond; a station at 0, 0 is not set, and bounds nothing."""
    import math

    if lon == lat == 0:
        return None
    reach = radius_nm / geo.NM_PER_DEGREE
    scale = math.cos(math.radians(max(-geo.MAX_SCALED_LAT, min(geo.MAX_SCALED_LAT, lat))))
    return max(-180.0, lon - reach / scale), max(-90.0, lat - reach), min(180.0, lon + reach / scale), min(90.0, lat + reach)


def clamp_box(box: tuple[float, float, float, float] | None, station: tuple[float, float, float, float] | None):
    """box within the station's; wrapped boxes are left as they are, and an empty meeting gives the station's box."""
    if box is None or station is None:
        return box or station
    if box[0] > box[2] or station[0] > station[2]:
        return box
    met = max(box[0], station[0]), max(box[1], station[1]), min(box[2], station[2]), min(box[3], station[3])
    return met if met[0] <= met[2] and met[1] <= met[3] else station


def in_window(minute: Column, start: str, end: str) -> Column:
    """Minute of day in the half-open HH:MM window; it may pass midnight, and is empty if both ends are equal."""
    a, b = (int(x[:2]) * 60 + int(x[3:]) for x in (start, end))
    return (minute >= a) & (minute < b) if a <= b else (minute >= a) | (minute < b)


def schedule_open(now_us: Column, days: list[int] | None, window: tuple[str, str] | None, quiet: tuple[str, str] | None) -> Column:
    """days count from Monday as 0; the day is the present one, after midnight too."""
    minute = F.pmod(F.floor(now_us / 60_000_000), F.lit(1440))
    weekday = F.pmod(F.floor(now_us / 86_400_000_000) + 3, F.lit(7))
    out = F.lit(True) if days is None else weekday.isin(*days) if days else F.lit(False)
    out = out & in_window(minute, *window) if window and days is not None else out
    return out & ~in_window(minute, *quiet) if quiet else out


def watch_key(correlation_key: Column, kind: Column, track_type: Column, icao: Column, mmsi: Column, callsign: Column, ident: Column) -> Column:
    """What a watchlist knows a track by: its correlation key, else a key of its type, else its id; empty strings count as none."""
    full = lambda c: F.nullif(c, F.lit(""))
    by_type = F.when(track_type == "aircraft", F.concat(F.lit("icao:"), full(icao))).when(track_type == "vessel", F.concat(F.lit("mmsi:"), full(mmsi))).when(track_type == "aprs_station", F.concat(F.lit("call:"), full(callsign)))
    return F.when(kind == "track", F.coalesce(full(correlation_key), by_type, full(ident)))


def watched(rows: DataFrame, watchlist: DataFrame, key: str, on: bool = True) -> DataFrame:
    return rows.join(watchlist.select(F.col("key").alias(key)).distinct(), key, "left_semi" if on else "left_anti")
