"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

import math

from .observations import AS_OF_US, DAY_US, OBS_SQL, STATION, UNIT_US

T, U, D, H = AS_OF_US, UNIT_US, DAY_US, UNIT_US
R = 6_371_008.8
LON, LAT = STATION
ORACLE: dict[str, str] = {}


def told(name: str, body: str, *tables: str, recursive: bool = False) -> None:
    ORACLE[name] = f"with {'recursive ' * recursive}{', '.join([OBS_SQL, *tables])} {body}"


def window(which: int) -> str:
    live = {"local_adsb": (5, 60), "network_adsb": (15, 120), "local_aprs": (300, 7200), "aprs_is": (300, 7200), "ais": (60, 1800)}
    return "case source " + " ".join(f"when '{s}' then {w[which]}" for s, w in live.items()) + " else 15 end"


def haversine(lon: str, lat: str, lon0: float, lat0: float) -> str:
    half = lambda a: f"pow(sin(radians({a}) / 2), 2)"
    return f"({2 * R} * asin(sqrt(least(1.0, {half(f'({lat}) - ({lat0})')} + cos(radians({lat})) * cos(radians({lat0})) * {half(f'({lon}) - ({lon0})')}))))"


def haversine_of(lon: str, lat: str, lon0: str, lat0: str) -> str:
    """haversine() between two columns' points."""
    half = lambda a: f"pow(sin(radians({a}) / 2), 2)"
    return f"({2 * R} * asin(sqrt(least(1.0, {half(f'{lat} - {lat0}')} + cos(radians({lat})) * cos(radians({lat0})) * {half(f'{lon} - {lon0}')}))))"


LATEST = f"""latest as (select * from (select *, row_number() over (partition by identity, source order by observed_us desc, received_us desc, ord desc) as rn,
  min(ord) over (partition by identity, source) as first_ord, max(case when local_rf then observed_us end) over (partition by identity, source) as last_local_us from obs where observed_us <= {T}) where rn = 1)"""
ALL = f"""aged as (select *, ({T} - observed_us) / {U} as age from latest),
fresher as (select *, case when age < {window(0)} then 'live' when age < {window(1)} then 'stale' else 'expired' end as fresh, {window(1)} as expire from aged),
contribs as (select *, case when fresh = 'expired' then 4 when local_rf then (case when fresh = 'live' then 0 else 2 end) when fresh = 'live' then 1 else 3 end as tier from fresher)"""


def best(value: str, having: str, order: str = "tier, observed_us desc, source") -> str:
    return f"first({value} order by {order}) filter (where {having} is not null)"


_dynamic = ", ".join(f"{best(f, f)} as {f}, {best('source', f)} as {f}_source, {best('fresh', f)} as {f}_fresh" for f in ("altitude_m", "speed_mps", "heading_deg"))
_meta = "observed_us desc, source"
told("fused_snapshot", f"""select identity, coalesce({best('source', 'lon')}, first(source order by first_ord)) as source, coalesce({best('track_type', 'lon')}, first(track_type order by first_ord)) as track_type,
  {best('lon', 'lon')} as lon, {best('lat', 'lon')} as lat, {best('source', 'lon')} as position_source, {best('fresh', 'lon')} as position_fresh, {_dynamic},
  {best('label', 'label', _meta)} as label, {best('source', 'label', _meta)} as label_source, {best('fresh', 'label', _meta)} as label_fresh, max(observed_us) as observed_us, max(received_us) as received_us,
  max(observed_us) + cast(max(expire) as bigint) * {U} as valid_until_us, bool_or(local_rf) as locally_received, count(*) as fused_count from contribs where fresh <> 'expired' group by identity""", LATEST, ALL)
_had = lambda field, order: f"first({field} order by {order}) filter (where {field} is not null and alive)"
_by, _said = "tier, o_us desc, o_source", "o_us desc, o_source"
_won = lambda field, order=_by, name=None: f"{_had(field, order)} as {name or field}, first(o_source order by {order}) filter (where {field} is not null and alive) as {name or field}_source"
_LIVE = (
    f"spans as (select *, observed_us + cast({window(1)} as bigint) * {U} as expire_us from obs where observed_us <= {T})",
    f"lost as (select distinct identity, expire_us as t from (select *, lead(observed_us) over (partition by identity, source order by observed_us, received_us, ord) as nxt from spans) where (nxt is null or nxt > expire_us) and expire_us <= {T})",
    f"happened as (select identity, observed_us as t, 0 as kind, received_us as r, ord as o from spans union all select identity, t, 1, {2**62}, {2**62} from lost)",
    f"""known as (select e.*, s.source as o_source, s.local_rf, s.observed_us as o_us, s.lon, s.lat, s.altitude_m, s.speed_mps, s.label, s.expire_us > e.t as alive, (e.t - s.observed_us) / {U} as age
  from happened e join spans s on s.identity = e.identity and (s.observed_us, s.received_us, s.ord) <= (e.t, e.r, e.o)
  qualify row_number() over (partition by e.identity, e.t, e.kind, e.o, s.source order by s.observed_us desc, s.received_us desc, s.ord desc) = 1)""",
    f"ranked as (select *, case when local_rf then (case when age < {window(0).replace('source', 'o_source', 1)} then 0 else 2 end) when age < {window(0).replace('source', 'o_source', 1)} then 1 else 3 end as tier from known)",
    f"""live as (select identity, t as at_us, case when kind = 0 then o end as ord, case when kind = 0 then 'upsert' when bool_or(alive) then 'handover' else 'remove' end as op,
  coalesce(first(o_source order by {_by}) filter (where lon is not null and alive), first(o_source order by {_by}) filter (where alive)) as source, coalesce(bool_or(local_rf) filter (where alive), false) as locally_received, count(*) filter (where alive) as fused_count,
  {_won('lon')}, {_had('lat', _by)} as lat, {_won('altitude_m')}, {_won('speed_mps')}, {_won('label', _said)} from ranked group by identity, t, kind, o)""",
)
told("live_changes", "select * exclude lon_source, lon_source as position_source from live", *_LIVE)
told("live_state", f"select * exclude lon_source, lon_source as position_source from (select * from live where at_us <= {T - 30 * U} qualify row_number() over (partition by identity order by at_us desc, op = 'upsert', ord desc) = 1) where op <> 'remove'", *_LIVE)
told("valid_from_crossings", "select obs_id, w.at_us as swept_us from f join w on f.source = w.source and f.b > w.before and f.b <= w.at_us and f.seen <= w.at_us and (f.e is null or f.e > w.at_us)",
    f"f as (select obs_id, source, observed_us as seen, case when obs_id % 10 <> 0 then observed_us + (obs_id % 9 - 2) * {H} end as b, case when obs_id % 4 <> 0 then observed_us + (obs_id % 9 - 2 + obs_id % 31) * {H} end as e from obs)",
    f"w as (select *, lag(at_us) over (partition by source order by at_us) as before from (select distinct source, observed_us // {D} * {D} as at_us from obs where obs_id % 3 = 0))")
_cell = 250.0 * math.sqrt(2) * 0.85
ORACLE["query_tiles"] = f"""with n as (select n_nationkey as k, n_nationkey * 14.0::double - 170.0 as lon, n_nationkey * 6.0::double - 72.0 as lat, 100.0::double + n_nationkey * 40.0 as radius from nation),
g as (select *, j * {_cell} as up, i * {_cell} as east from n, range(-8, 9) a(j), range(-8, 9) b(i) where radius > 250 and sqrt(i * i + j * j) * {_cell} <= radius + {_cell} * sqrt(0.5))
select k as n_nationkey, cast(row_number() over (partition by k order by j desc, i) - 1 as int) as "at", round((x - 360 * floor((x + 180) / 360)), 6) as lon, round(y, 6) as lat, 250.0::double as radius_nm
from (select *, lon + east / (60 * cos(radians(lat))) as x, greatest(-90, least(90, lat + up / 60)) as y from g) union all select k, 0, round(lon, 6), round(lat, 6), round(radius, 3) from n where radius <= 250"""
_feeds = "obs_id as record_id, identity as correlation_key, track_type, source, observed_us, received_us, lon, lat, case when local_rf then altitude_m end as altitude_m"
told("store_rows", f"select {_feeds}, 'track' as kind, received_us + 5 as persisted_us, case when obs_id % 50 <> 0 and not local_rf then label end as told_label from obs")
told("replay_records", f"select {_feeds}, case when local_rf then emergency end as emergency, case when not local_rf then label end as label from obs where obs_id % 50 <> 0")
told("latest_per_source", "select identity, source, observed_us, received_us, ord, altitude_m, label, last_local_us from latest", LATEST)
told("freshness_counts", "select source, fresh, tier, count(*) as n from contribs group by all", LATEST, ALL)
_fields = ("altitude_m", "speed_mps", "heading_deg")
_picks = ", ".join(f"{best(f, f)} as v_{f}, {best('source', f)} as s_{f}" for f in ("lon", "lat", *_fields))
_off = {"altitude_m": 30, "speed_mps": 5, "heading_deg": 5}
_unions = " union all ".join([f"select c.identity, '{f}' as field, w.s_{f} as winner, c.source from alive c join w using (identity) where c.source <> w.s_{f} and abs(c.{f} - w.v_{f}) > {_off[f]}" for f in _fields] + [
    "select c.identity, 'position' as field, w.s_lon as winner, c.source from alive c join w using (identity) where c.source <> w.s_lon and pow(c.lon - w.v_lon, 2) + pow(c.lat - w.v_lat, 2) > pow(0.0005, 2)"])
told("fused_conflicts", _unions, LATEST, ALL, "alive as (select * from contribs where fresh <> 'expired')", f"w as (select identity, {_picks} from alive group by identity)")
told("merged_provenance", "select identity, string_agg(concat_ws(':', source, observed_us, fresh), ',' order by source) as provenance from contribs group by identity", LATEST, ALL)
told("merged_attributes", "select identity, key, first(value order by received_us desc, first_ord desc) as value from each group by all", LATEST, ALL, "each as (select identity, received_us, first_ord, 'k' as key, cast(attr_k as varchar) as value from contribs where attr_k is not null union all select identity, received_us, first_ord, 'from_' || source, label from contribs where label is not null)")
told("merged_tags", "select identity, string_agg(distinct tag, ',' order by tag) as tags from (select identity, source as tag from contribs union all select identity, fresh from contribs) group by identity", LATEST, ALL)
told("source_health", "select source, count(*) as received, count(*) filter (where lon is null) as rejected, max(observed_us) as last_record_us, max(received_us - observed_us) as max_lag_us from obs group by source")
told("cross_tile_dedupe", f"select identity, cast(observed_us // {D} as bigint) as day, obs_id, observed_us from obs qualify row_number() over (partition by identity, observed_us // {D} order by observed_us desc, obs_id) = 1")
told("revision_dedupe", "select a.identity, a.poll, a.token from polls a left join polls b on a.identity = b.identity and b.poll = a.poll - 1 where b.poll is null or a.token is distinct from b.token", f"polls as (select identity, cast(observed_us // {D} as bigint) as poll, max(attr_k) as token from obs group by all)")
told("first_seen_dedupe", "select identity, attr_k, observed_us, obs_id from obs qualify row_number() over (partition by identity, attr_k order by observed_us, obs_id) = 1")
told("changed_value_dedupe", "select identity, source, observed_us, obs_id from obs window w as (partition by identity order by observed_us, obs_id) qualify lag(source) over w is null or lag(source) over w <> source")


def greedy(name: str, keys: str, gap: str, free: str) -> None:
    on = " and ".join(f"r.{k} = g.{k}" for k in keys.split(", "))
    told(name, f"select {keys}, observed_us, obs_id from gate where admit",
        f"r as (select *, {gap} as gap, {free} as free, row_number() over (partition by {keys} order by observed_us, obs_id) as rn from obs)",
        f"""gate as (select {keys}, rn, observed_us, obs_id, observed_us as last, true as admit from r where rn = 1 union all
  select {', '.join('r.' + k for k in keys.split(', '))}, r.rn, r.observed_us, r.obs_id, case when r.free or r.observed_us - g.last >= r.gap then r.observed_us else g.last end, r.free or r.observed_us - g.last >= r.gap
  from gate g join r on {on} and r.rn = g.rn + 1)""", recursive=True)


greedy("cadence_gate", "source, identity", f"(case source when 'local_adsb' then 5 when 'network_adsb' then 15 when 'ais' then 30 else 0 end) * {H}", "emergency")
greedy("ttl_dedupe", "track_type, attr_k", f"{30 * H}", "false")
told("emergency_onset", "select identity, obs_id, concat('event:', identity, ':', observed_us // 1000000) as event_id from (select *, lag(emergency) over (partition by identity order by observed_us, obs_id) as before from obs) where emergency and not coalesce(before, false)")
told("static_dynamic_asof", """select d.identity, d.obs_id, (select s.label from spans s where s.identity = d.identity and s.span = d.span and s.source = 'ais' and s.label is not null and (s.observed_us, s.obs_id) < (d.observed_us, d.obs_id) order by s.observed_us desc, s.obs_id desc limit 1) as last_label,
  (select 'D' || s.attr_k from spans s where s.identity = d.identity and s.span = d.span and s.source = 'ais' and s.attr_k % 4 <> 0 and (s.observed_us, s.obs_id) < (d.observed_us, d.obs_id) order by s.observed_us desc, s.obs_id desc limit 1) as last_destination from spans d where d.source <> 'ais'""",
    f"quiet as (select *, observed_us - lag(observed_us) over (partition by identity order by observed_us, obs_id) > {60 * H} as q from obs)", "spans as (select *, sum(case when q then 1 else 0 end) over (partition by identity order by observed_us, obs_id) as span from quiet)")

RD = 6_371_000.0
told("display_filter", f"""select obs_id, identity from obs where local_rf and track_type in ('aircraft', 'vessel') and {haversine('lon', 'lat', LON, LAT).replace(str(2 * R), str(2 * RD))} <= 60000 and altitude_m >= 1000 and speed_mps <= 250
  and greatest(0, ({T} - observed_us) / {U}) <= 500 and attr_k % 3 = 1 and contains(lower(label), 'l1')""")
_kind = "case obs_id % 5 when 0 then 'event' when 1 then 'feature' when 2 then 'alert' when 3 then 'source_status' else 'track' end"
_in = "(lon between -94.8 and -94.2 and lat between 40.1 and 40.5)"
told("subscription_filter", f"""select obs_id, kind from (select *, {_kind} as kind, source in ('local_adsb', 'ais') as s from obs) where kind = 'source_status' or (kind = 'event' and coalesce({_in}, true))
  or (kind = 'track' and s and coalesce({_in}, true)) or (kind = 'feature' and s and coalesce({_in}, false))""")
told("wrapped_bbox", "select obs_id from (select obs_id, lat, lon * 7 + 180 as y from obs where lon is not null) where ((y - 360 * floor(y / 360)) - 180 >= 60 or (y - 360 * floor(y / 360)) - 180 <= -60) and lat >= 40.2 and lat <= 40.6")
told("aoi_disk", f"select obs_id from obs where {haversine('lon', 'lat', LON, LAT)} <= 40000")
told("schedule_gate", """select obs_id from (select obs_id, (observed_us // 60000000) % 1440 as m, isodow(make_timestamp(observed_us)) - 1 as day from obs) where day in (0, 2, 4, 6) and (m >= 1200 or m < 390) and not (m >= 60 and m < 135)""")
told("severity_threshold", "select severity, count(*) as n from (select list_value('info', 'low', 'medium', 'high', 'critical', 'odd')[obs_id % 6 + 1] as severity from obs) where severity in ('medium', 'high', 'critical') group by severity")
told("confidence_floor", "select confidence, count(*) as n from (select case obs_id % 7 when 0 then 'high' when 1 then 'nominal' when 3 then 'high' when 4 then 'nominal' end as confidence from obs) where confidence is not null group by confidence")
_watched = "('trk:3', 'trk:17', 'trk:42', 'trk:99')"
told("watchlist_tracks", f"select identity, count(*) as n from obs where identity in {_watched} group by identity union all select 'others', count(*) from obs where identity not in {_watched}")


def in_ring(points: list[tuple[float, float]]) -> str:
    """On an edge, or an odd number of edges crossed, edges one by one."""
    sides = list(zip(points, [*points[1:], points[0]], strict=True))
    odd = " + ".join(f"case when ({by} > lat) <> ({ay} > lat) and lon < {bx} + (lat - {by}) / ({ay} - {by}) * ({ax} - {bx}) then 1 else 0 end" for (ax, ay), (bx, by) in sides if ay != by)
    e = "1e-12::double"
    on = " or ".join(f"abs(({bx} - {ax}) * (lat - {ay}) - ({by} - {ay}) * (lon - {ax})) <= {e} and lon between {min(ax, bx)} - {e} and {max(ax, bx)} + {e} and lat between {min(ay, by)} - {e} and {max(ay, by)} + {e}" for (ax, ay), (bx, by) in sides)
    return f"({on} or ({odd}) % 2 = 1)".replace("(-", "( -").replace("- -", "+ ")


_outer = in_ring([(-94.9, 40.05), (-94.3, 40.05), (-94.3, 40.55), (-94.6, 40.65), (-94.9, 40.55)])
_hole = in_ring([(-94.7, 40.2), (-94.5, 40.2), (-94.5, 40.4), (-94.7, 40.4)])
_poly = f"({_outer} and not {_hole})"
told("geofence_join", f"select obs_id, 'polygon' as fence from obs where lon is not null and {_poly} union all select obs_id, 'circle' from obs where lon is not null and {haversine('lon', 'lat', -94.7, 40.3)} <= 25000 and altitude_m between 1000 and 30000")
_supplied = """fences as (select s_suppkey as k, -95.0::double + s_suppkey * 37 % 1009 * 0.001::double + 0.00017::double as x, 40.0::double + s_suppkey * 53 % 701 * 0.001::double + 0.00023::double as y, 0.002::double + s_suppkey % 11 * 0.003::double as reach,
  case when s_suppkey % 3 = 0 then 2000 end as low_m, case when s_suppkey % 4 = 0 then 20000 end as high_m from supplier)"""
told("fence_table", f"""select obs_id, 's' || k as fence_id from obs join fences on lon is not null and abs(lat - y) < 0.4 and case when k % 2 = 0 then {haversine_of('lon', 'lat', 'x', 'y')} <= reach * 100000 else k % 10 <> 5 and abs(lon - x) + abs(lat - y) <= reach end
  and (low_m is null or altitude_m >= low_m) and (high_m is null or altitude_m <= high_m)""", _supplied)
# a square and a square on its tip meet if the nearest point of the one lies within the other
told("area_fences", "select c_custkey, 's' || k as fence_id from areas join fences on k % 2 = 1 and k % 10 <> 5 and abs(x - greatest(lon, least(x, lon + side))) + abs(y - greatest(lat, least(y, lat + side))) <= reach", _supplied,
    "areas as (select c_custkey, -95.0::double + c_custkey * 91 % 1013 * 0.001::double + 0.00037::double as lon, 40.0::double + c_custkey * 67 % 709 * 0.001::double + 0.00041::double as lat, 0.0011::double + c_custkey % 5 * 0.002::double as side from customer)")
told("address_blocks", f"select obs_id, s_suppkey from obs join supplier on {0xADF000} + obs_id * 7 between {0xADF000} + s_suppkey * 97 and {0xADF000} + s_suppkey * 97 + s_suppkey % 50 * 13 - 5")
told("military_blocks", f"""select obs_id, case when p and b then 'both' when p then 'provider' else 'address_block' end as basis, case when p then 'medium' else 'low' end as confidence from
  (select obs_id, obs_id % 2 = 1 as p, obs_id % 13 <> 0 and ({0xADF000} + obs_id * 7 between {0xADF7C8} and {0xAFFFFF} or {0xADF000} + obs_id * 7 between {0x43C000} and {0x43CFFF}) as b from obs) where p or b""")
told("catalog_partition", f"select distinct identity, case when identity in {_watched} then 'fast' else 'slow' end as tier from obs")
told("station_distance", f"select obs_id, round(d, 2) as distance_m, round(degrees(atan2(altitude_m, d)), 6) as elevation_deg from (select *, {haversine('lon', 'lat', LON, LAT)} as d from obs where lon is not null)")
ORACLE["circle_polygon"] = f"""with c as (select n_nationkey, i as "at", radians(n_nationkey * 14.0::double - 175.0) as lon, radians(n_nationkey * 6.0::double - 75.0) as lat, (50000.0::double + n_nationkey * 1000.0) / {R} as d, 2 * pi() * (i % 16) / 16 as b from nation, range(17) r(i)),
  e as (select *, asin(sin(lat) * cos(d) + cos(lat) * sin(d) * cos(b)) as y from c), f as (select *, degrees(lon + atan2(sin(b) * sin(d) * cos(lat), cos(d) - sin(lat) * sin(y))) + 180 as x from e)
  select n_nationkey, "at", round(x - 360 * floor(x / 360) - 180, 7) as lon, round(degrees(y), 7) as lat from f"""
ORACLE["aoi_box"] = """with c as (select n_nationkey, n_nationkey * 14.0::double - 170 as lon, n_nationkey * 7.0::double - 85 as lat, 250 / 60.0::double as r from nation)
  select n_nationkey, round(greatest(-180, lon - r / cos(radians(greatest(-89.9, least(89.9, lat))))), 6) as west, round(greatest(-90, lat - r), 6) as south, round(least(180, lon + r / cos(radians(greatest(-89.9, least(89.9, lat))))), 6) as east, round(least(90, lat + r), 6) as north from c"""
told("vertex_means", "select identity, round(degrees(atan2(sum(sin(radians(lon))), sum(cos(radians(lon))))), 6) as lon, round(avg(lat), 6) as lat from obs where lon is not null group by identity")
A, E2 = 6_378_137.0, 6.69437999014e-3
_o = (math.radians(LAT), math.radians(LON))
_n = A / math.sqrt(1 - E2 * math.sin(_o[0]) ** 2)
_here = ((_n + 300) * math.cos(_o[0]) * math.cos(_o[1]), (_n + 300) * math.cos(_o[0]) * math.sin(_o[1]), (_n * (1 - E2) + 300) * math.sin(_o[0]))
_up = (math.cos(_o[0]) * math.cos(_o[1]), math.cos(_o[0]) * math.sin(_o[1]), math.sin(_o[0]))
told("orbital_frames", f"""select obs_id, round(g - 2 * pi() * floor(g / (2 * pi())), 6) as gmst, round(x, 2) as x, round(y, 2) as y, round(z, 2) as z, round(degrees(asin(((x - {_here[0]!r}) * {_up[0]!r} + (y - {_here[1]!r}) * {_up[1]!r} + (z - {_here[2]!r}) * {_up[2]!r}) / far)), 5) as elevation, round(far, 2) as range_m
  from (select *, sqrt(pow(x - {_here[0]!r}, 2) + pow(y - {_here[1]!r}, 2) + pow(z - {_here[2]!r}, 2)) as far from p)""",
    f"""n as (select *, {A} / sqrt(1 - {E2!r}::double * pow(sin(radians(lat)), 2)) as r, altitude_m * 10 as h, (observed_us / 86400e6::double + 2440587.5 - 2451545.0) / 36525 as t from obs where lon is not null and altitude_m is not null)""",
    f"""p as (select *, (r + h) * cos(radians(lat)) * cos(radians(lon)) as x, (r + h) * cos(radians(lat)) * sin(radians(lon)) as y, (r * (1 - {E2!r}::double) + h) * sin(radians(lat)) as z,
  radians((67310.54841::double + t * (876600 * 3600.0::double + 8640184.812866::double) + t * t * 0.093104::double - t * t * t * 6.2e-6::double) / 240) as g from n)""")
told("lightning_grid", "select cast(floor(lon * 4) as bigint) as cell_lon, cast(floor(lat * 4) as bigint) as cell_lat, count(*) as n from obs where lon is not null group by all")

KT, FPM = 1852.0 / 3600, 0.3048 / 60
told("normalise_aircraft", f"""select 'aircraft:icao:' || lower(h) as correlation_key, 'local_adsb' as source, 'aircraft' as track_type, observed_us - case when obs_id % 2 = 0 then 1500000 else 2000000 end as observed_us, case when ok then lon end as lon, case when ok then round(y, 6) end as lat,
  round(case when ground then 0 else coalesce(case when obs_id % 10 <> 1 then trunc(altitude_m) end, 1000) * 0.3048::double end, 6) as altitude_m, round(speed_mps * {KT!r}::double, 6) as speed_mps, heading_deg, round(600 * {FPM!r}::double, 6) as vertical_rate_mps,
  case when obs_id % 3 = 0 then upper(h) else 'F' || obs_id end as label, true as locally_received,
  array_to_string(list_filter([case when obs_id % 101 = 0 or obs_id % 97 = 0 then 'emergency' end, case when ground then 'on_ground' end, case when non then 'non_icao' end, case when (lon is not null or y is not null) and not ok then 'bad_position' end, case when obs_id % 2 = 1 or blk then 'military' end], lambda x: x is not null), ',') as tags,
  case when obs_id % 2 = 1 and blk then 'both' when obs_id % 2 = 1 then 'provider' when blk then 'address_block' end as basis from m""",
    f"""k as (select *, obs_id % 13 = 0 as non, to_hex(case when obs_id % 13 = 0 then obs_id else obs_id + {0xADF000} end) as h, lat + case when obs_id % 19 = 0 then 100.0 else 0.0 end as y, obs_id % 10 = 0 as ground,
  obs_id % 13 <> 0 and (obs_id + {0xADF000} between {0xADF7C8} and {0xAFFFFF}) as blk from obs where obs_id % 17 <> 0)""", "m as (select *, coalesce(y between -90 and 90 and lon between -180 and 180, false) as ok from k)")
_nav = ["under_way_using_engine", "at_anchor", "not_under_command", "restricted_manoeuverability", "constrained_by_draught", "moored", "aground", "engaged_in_fishing", "under_way_sailing", "reserved_hsc", "reserved_wig", "power_driven_towing_astern", "power_driven_pushing_ahead", "reserved", "ais_sart_mob_epirb", "undefined"]
_ship = {30: "fishing", 31: "towing", 32: "towing_long", 33: "dredging", 34: "diving", 35: "military", 36: "sailing", 37: "pleasure_craft", 50: "pilot", 51: "search_and_rescue", 52: "tug", 53: "port_tender", 54: "anti_pollution", 55: "law_enforcement", 58: "medical_transport"}
_case = lambda of, table: f"case {of} " + " ".join(f"when {k} then '{v}'" for k, v in table.items()) + " end"
told("normalise_vessels", f"""select 'ais:vessel:' || (obs_id + 200000000) as correlation_key, round(x, 6) as lon, round(y, 6) as lat, case when sog < 102.3 then round(sog * {KT!r}::double, 6) end as speed_mps,
  case when obs_id % 3 <> 0 then cast(obs_id % 360 as double) when obs_id % 365 < 360 then cast(obs_id % 365 as double) end as heading_deg, cast(obs_id % 18 as int) as nav_status, {_case('obs_id % 18', dict(enumerate(_nav)))} as nav_status_text,
  case when s between 1 and 99 then coalesce({_case('s', _ship)}, {_case('s // 10', {2: 'wing_in_ground', 4: 'high_speed_craft', 6: 'passenger', 7: 'cargo', 8: 'tanker'})}, 'other') end as ship_type_text
  from (select *, obs_id % 105 as s, obs_id % 1030 / 10 as sog, coalesce(lat, 1.0) as y, coalesce(case when obs_id % 4 <> 0 then lon end, 2.0) as x from obs where obs_id % 6 <> 0)""")
told("normalise_fires", """select concat('fire:firms:', i, ':', case when s = '' then '?' else s end, ':2024-02-03T', t, ':', la, ':', lo) as id, cast(lo as double) as lon, cast(la as double) as lat,
  epoch_us(try_strptime('2024-02-03 ' || lpad(t, 4, '0'), '%Y-%m-%d %H%M')) as observed_us, list_value('high', 'nominal', 'low', 'high', 'nominal', 'low', null)[obs_id % 7 + 1] as confidence_class, cast(obs_id % 700 as double) as frp_mw, case when obs_id % 2 = 0 then 299.25 else 301.5 end::double as brightness_k
  from (select obs_id, concat('4', obs_id % 10, '.25') as la, concat('-9', obs_id % 10, '.5') as lo, list_value('133', '5', '2359', '0', '2460')[obs_id % 5 + 1] as t, list_value('N', '', 'Aqua')[obs_id % 3 + 1] as s, list_value('VIIRS', 'MODIS')[obs_id % 2 + 1] as i from obs where obs_id % 11 <> 0)""")
told("normalise_quakes", """select 'earthquake:usgs:us' || obs_id as id, lon, lat, case when obs_id % 4 in (2, 3) then heading_deg end as depth_km, obs_id % 80 / 10 as magnitude, (observed_us // 1000) * 1000 as observed_us, case when obs_id % 9 = 0 then 'green' end as severity
  from obs where obs_id % 23 <> 0 and obs_id % 5 <> 0 and obs_id % 4 <> 1 and obs_id % 7 <> 0 and obs_id % 80 / 10 >= 2.5""")
told("normalise_sondes", """select 'sonde:S' || obs_id as correlation_key, round(lon, 6) as lon, round(lat, 6) as lat, round(altitude_m, 6) as altitude_m, round(speed_mps, 6) as speed_mps, case when obs_id % 400 <= 360 then cast(obs_id % 400 as double) end as heading_deg, cast(obs_id % 9 - 4 as double) as vertical_rate_mps,
  case when obs_id % 9 - 4 > 1 then 'ascending' when obs_id % 9 - 4 < -1 then 'descending' else 'float' end as ascent_state, case when obs_id % 3 <> 0 then 'RS41 S' else 'S' end || obs_id as label from obs where obs_id % 20 <> 0 and lon is not null""")
told("aprs_positions", """select obs_id, round(y, 6) as lat, round(x, 6) as lon, obs_id % 7 = 0 as ambiguous from (select obs_id, (case when obs_id % 2 = 0 then 1 else -1 end) * (obs_id % 95 + (obs_id % 60 + case when obs_id % 7 = 0 then 0 else obs_id % 100 end / 100) / 60) as y,
  (case when obs_id % 3 = 0 then 1 else -1 end) * (obs_id % 185 + (obs_id % 59 + obs_id % 97 / 100) / 60) as x from obs where obs_id % 3 = 0 or obs_id % 31 <> 0) where y between -90 and 90 and x between -180 and 180""")
told("aprs_compressed", """select obs_id, round(lat, 5) as lat, round(lon, 5) as lon, case when flat and c * 4 between 1 and 360 then cast(c * 4 as double) end as course, case when flat then round(pow(1.08::double, s) - 1, 5) end as speed_kt, case when high then round(pow(1.002::double, c * 91 + s) * 0.3048::double, 5) end as altitude_m from
  (select *, told and (t & 24) = 16 as high, told and (t & 24) <> 16 as flat from (select obs_id, 90 - ((((obs_id % 85) * 91 + obs_id * 3 % 91) * 91 + obs_id * 5 % 91) * 91 + obs_id * 7 % 91) / 380926 as lat, ((((obs_id % 83) * 91 + obs_id * 11 % 91) * 91 + obs_id * 13 % 91) * 91 + obs_id * 17 % 91) / 190463 - 180 as lon,
  obs_id % 6 <> 0 as told, obs_id % 91 as c, obs_id % 40 as s, obs_id * 19 % 91 as t from obs)) where lat between -90 and 90 and lon between -180 and 180""")
told("packet_tracks", f"""select obs_id, case when k = 1 then 'aprs:object:OBJ' || n % 1000 else 'aprs:station:N' || n % 10000 end as correlation_key, case when k = 1 then 'aprs_object' else 'aprs_station' end as track_type,
  case when k <> 1 then observed_us when epoch_us(due) - observed_us > {12 * U} then epoch_us(due - interval 1 month) else epoch_us(due) end as observed_us,
  case when k <> 2 then round(-(n % 180 + (n % 59 + n % 97 / 100) / 60), 6) end as lon, case when k <> 2 then round(n % 90 + (n % 60 + n % 100 / 100) / 60, 6) end as lat, case when k = 0 then round(n * 0.3048::double, 3) end as altitude_m,
  case when k = 0 then round(n % 200 * (1852 / 3600), 6) end as speed_mps, case when k = 0 and n % 400 between 1 and 360 then (n % 400)::double end as heading_deg,
  case k when 1 then case when n % 4 = 1 then 'object' else 'object,killed' end when 2 then 'status' when 3 then 'weather' when 4 then 'third_party' else '' end as tags, case when k = 3 then (n % 120)::double end as temp_f,
  case when k = 0 then 'on the way' end as comment, case when k = 2 then 'at work' end as status, case when k = 4 then 'RELAY-1' end as relayed_by
  from (select *, obs_id as n, obs_id % 6 as k, make_timestamp(2024, 1, obs_id % 28 + 1, obs_id % 24, obs_id % 60, 0.0) as due from obs) where k < 5""")
told("file_key_times", "select obs_id, epoch_us(timestamp '2024-01-01' + to_days(cast(obs_id % 366 as int))) + (obs_id % 24 * 3600 + obs_id % 60 * 60 + obs_id % 59) * 1000000 + obs_id % 10 * 100000 as start_us from obs")

_t = "identity as subject, observed_us as t, ord"
told("rule_matches", f"select {_t} from obs where track_type in ('aircraft', 'vessel') and altitude_m > 5000 and source <> 'ais' and not local_rf and label is not null")
told("rule_changes", f"select {_t} from obs qualify source = 'local_adsb' and lag(source) over (partition by identity order by observed_us, ord) <> 'local_adsb'")
told("rule_counts", f"select a.identity as subject, a.observed_us as t, a.ord from obs a join obs b on a.identity = b.identity and b.observed_us >= a.observed_us - {48 * H} and (b.observed_us < a.observed_us or b.observed_us = a.observed_us and b.ord <= a.ord) and b.source = 'local_adsb' where a.track_type = 'aircraft' and a.source = 'local_adsb' group by all having count(*) >= 3")


def firing(name: str, fires: str, resolves: str, stays: str) -> None:
    cool = f"(f.last is null or e.t - f.last >= {30 * H})"
    fire = f"({fires} and {cool} and not f.open)"
    res = f"({resolves} and f.open)"
    told(name, "select subject, t, ord, action from f where action is not null",
        f"l as (select {_t}, coalesce(speed_mps > 80 and altitude_m < 30000, false) as level from obs where track_type in ('aircraft', 'vessel'))",
        "e as (select *, row_number() over (partition by subject order by t, ord) as rn from (select * from l qualify level <> coalesce(lag(level) over (partition by subject order by t, ord), false)))",
        f"""f as (select distinct subject, cast(0 as bigint) as rn, cast(null as bigint) as t, cast(null as bigint) as ord, false as open, cast(null as bigint) as last, cast(null as varchar) as action from e union all
  select e.subject, e.rn, e.t, e.ord, case when {fire} then {stays} when {res} then false else f.open end, case when {fire} then e.t else f.last end, case when {fire} then 'fire' when {res} then 'resolve' end from f join e on e.subject = f.subject and e.rn = f.rn + 1)""", recursive=True)


firing("firing_enter", "e.level", "not e.level", "true")
firing("firing_exit", "not e.level", "e.level", "true")
firing("firing_change", "true", "false", "false")
_watched_level = "coalesce(speed_mps > 80 and altitude_m < 30000, false)"


def fold(transition: str, keys: str, source: str) -> tuple[str, ...]:
    """Tables that fold ticks one by one: level, open alert and last firing; a removal resolves or fires and forgets the subject."""
    n, on = f"f_{transition}", " and ".join(f"e.{k} = f.{k}" for k in keys.split(", "))
    fires, resolves = {"enter": ("e.level and not f.level", "f.level and not e.level"), "exit": ("f.level and not e.level", "e.level and not f.level"), "change": ("e.level <> f.level and not e.gone", "false")}[transition]
    fire = f"(({fires}) and not f.open and (f.last is null or e.t - f.last >= {30 * H}))"
    res = f"(({resolves}) and f.open)" if transition != "exit" else f"(({resolves}) and f.open and not e.gone)"
    stays = "not e.gone" if transition != "change" else "false"
    return (f"e_{transition} as (select *, row_number() over (partition by {keys} order by t, ord) as rn from {source})",
        f"""{n} as (select distinct {keys}, cast(0 as bigint) as rn, cast(null as bigint) as t, cast(null as bigint) as ord, false as level, false as open, cast(null as bigint) as last, cast(null as varchar) as action from e_{transition} union all
  select {', '.join('e.' + k for k in keys.split(', '))}, e.rn, e.t, e.ord, e.level, case when e.gone and e.forgets then false when {fire} then {stays} when {res} then false else f.open end, case when e.gone and e.forgets then null when {fire} then e.t else f.last end, case when {fire} then 'fire' when {res} then 'resolve' end
  from {n} f join e_{transition} e on {on} and e.rn = f.rn + 1)""")


told("removal_edges", " union all ".join(f"select subject, t, ord, action, '{x}' as transition from f_{x} where action is not null" for x in ("enter", "exit", "change")),
    f"k as (select {_t}, source <> 'aprs_is' and {_watched_level} as level, source = 'aprs_is' as gone, true as forgets from obs where track_type in ('aircraft', 'vessel') or source = 'aprs_is')",
    *[table for x in ("enter", "exit", "change") for table in fold(x, "subject", "k")], recursive=True)
told("grouped_firing", "select subject, t, ord, action from f_enter where action is not null",
    f"k as (select 'group' as subject, t, ord, level, false as gone, false as forgets from (select {_t}, {_watched_level} as level from obs where track_type in ('aircraft', 'vessel')) qualify level <> coalesce(lag(level) over (order by t, ord), false))",
    *fold("enter", "subject", "k"), recursive=True)
told("event_firing", "select subject, t, ord, 'fire' as action from g where admit",
    f"k as (select {_t}, row_number() over (partition by identity order by observed_us, ord) as rn from obs where (emergency or source = 'ais') and speed_mps > 80)",
    f"""g as (select subject, rn, t, ord, t as last, true as admit from k where rn = 1 union all
  select k.subject, k.rn, k.t, k.ord, case when k.t - g.last >= {40 * H} then k.t else g.last end, k.t - g.last >= {40 * H} from g join k on k.subject = g.subject and k.rn = g.rn + 1)""", recursive=True)
told("fence_alerts", f"select identity as subject, count(*) as evaluable, count(*) filter (where {_poly} and identity not in {_watched}) as inside from obs where lon is not null group by identity")
told("distance_alerts", f"select count(*) as evaluated, case when count(*) > 0 then count(*) filter (where d < 60000 and degrees(atan2(altitude_m, d)) >= 5) end as matched from (select *, {haversine('lon', 'lat', LON, LAT)} as d from obs where track_type = 'aircraft' and lon is not null and altitude_m is not null qualify row_number() over (partition by identity order by observed_us desc, ord desc) = 1)")
told("channel_settlement", """select obs_id as alert_id, channel, case channel when 'dashboard' then 'delivered' when 'email' then case when s >= 3 then 'delivered' else 'suppressed' end when 'browser' then case when s >= 2 then 'delivered' else 'suppressed' end else 'unconfigured' end as status
  from (select obs_id, list_value(0, 2, 4)[obs_id % 3 + 1] as s, unnest(['dashboard', 'email', 'webhook', 'browser']) as channel from obs) where channel <> 'email' or obs_id % 4 <> 0""")
told("alert_lifecycle", "select attr_k as alert_id, case when r is not null then 'resolved' when a is not null then 'acknowledged' else 'active' end as state, a as acknowledged_us, r as resolved_us from (select attr_k, min(case when source = 'ais' then observed_us end) as a, max(case when source = 'aprs_is' then observed_us end) as r from obs group by attr_k)")

told("track_history", f"select obs_id, observed_us, source from obs where identity = 'trk:7' and observed_us >= {T - 20 * D} and observed_us < {T} order by observed_us desc, obs_id desc limit 25")
told("replay_window", "select obs_id, observed_us, (select count(*) > 500 from w) as truncated from (select * from w order by observed_us, obs_id limit 500)", f"w as (select * from obs where source in ('local_adsb', 'ais') and observed_us >= {T - 3 * D} and observed_us < {T})")
told("visible_at_cursor", f"select identity, obs_id, source, observed_us from obs where observed_us <= {T} and {T} - observed_us <= cast({window(1)} as bigint) * {H} qualify row_number() over (partition by identity order by observed_us desc, ord desc) = 1")
told("retention_age", f"select source, count(*) as n from obs where observed_us < {T - 10 * D} group by source")
told("retention_downsample", f"select obs_id, identity from obs where observed_us >= {T - 5 * D} union all select min(obs_id), identity from obs where observed_us < {T - 5 * D} group by identity, observed_us // {48 * H}")
told("retention_oldest", "select obs_id from obs where obs_id not in (select obs_id from obs order by observed_us, obs_id limit 300)")
told("config_upsert", "select identity, value from c union all select identity, value from b where identity not in (select identity from c)", f"b as (select identity, min(obs_id) as value from obs where observed_us < {AS_OF_US - DAY_US} group by identity)", f"c as (select identity, cast(first(attr_k order by obs_id desc) as bigint) as value from obs where observed_us >= {AS_OF_US - DAY_US} group by identity)")
told("sequenced_changes", """select connection, record, obs_id, op, row_number() over (partition by connection order by observed_us, obs_id) as cseq from (select *, last_value(state ignore nulls) over (partition by connection, record order by observed_us, obs_id rows between unbounded preceding and 1 preceding) as before from ch)
  where case when op = 'remove' then coalesce(before, 0) = 1 else source <> 'ais' end""", "ch as (select *, case when op = 'remove' then 0 when source <> 'ais' then 1 end as state from (select track_type as connection, identity as record, obs_id, source, observed_us, case when attr_k % 5 = 0 then 'remove' else 'upsert' end as op from obs))")
told("sequence_gaps", "select case when cseq <= before then 'duplicate' when cseq <> before + 1 then 'gap' else 'next' end as arrival, count(*) as n from (select *, max(cseq) over (partition by identity order by observed_us, obs_id rows between unbounded preceding and 1 preceding) as before from fr) group by all",
    "fr as (select *, row_number() over (partition by identity order by observed_us, obs_id) + case when obs_id % 9 = 0 then 2 when obs_id % 10 = 0 then -1 else 0 end as cseq from obs)")
told("bus_routing", "select topic, qos, retain, count(*) as n from (select case when obs_id % 50 = 0 then 'status/' else 'records/' end || source as topic, case when obs_id % 50 > 1 then 0 else 1 end as qos, obs_id % 50 = 0 as retain from obs) group by all")
told("seen_sets", "select coalesce(a.identity, b.identity) as identity, case when a.identity is null then 'new' when b.identity is null then 'forgotten' else 'kept' end as part from a full join b on a.identity = b.identity",
    f"a as (select distinct identity from obs where observed_us >= {T - 2 * D} and observed_us < {T - D})", f"b as (select distinct identity from obs where observed_us >= {T - D} and observed_us < {T})")
told("presentation_layers", "select distinct case track_type when 'aircraft' then 'air' when 'vessel' then 'sea' else 'radio' end as layer, source from obs where lon is not null")
told("modem_frames", """select source, 2 * row_number() over (partition by source order by obs_id) - 1 as frame, obs_id * 2 + 1 as seq,
  'N' || obs_id % 10000 || case when obs_id % 16 > 0 then '-' || obs_id % 16 else '' end || '>APRS,WIDE1-1' || case when obs_id % 2 = 0 then '*' else '' end || ':!obs ' || obs_id || case when obs_id % 4 = 0 then chr(65533) || chr(65533) else '' end as line from obs""")
told("retention_ladder", """select source, count(*) as n, min(observed_us) as oldest_us, 'critical' as pressure, (select count(*) from obs) - (select count(*) from w) as expired, (select count(*) from w) - (select count(*) from y) as thinned, (select want from g) as oldest, 25::bigint as days
  from (select * from y qualify row_number() over (order by observed_us, obs_id) > (select want from g)) group by source""",
    f"w as (select * from obs where observed_us >= {T - 25 * D})",
    f"y as (select * from w where observed_us >= {T - D} or obs_id in (select min(obs_id) from w where observed_us < {T - D} group by identity, observed_us // 30000000))",
    "g as (select greatest(100, ceil((count(*) * 100 - ((select count(*) from obs) * 40 + 7) * 0.85) / 100))::bigint as want from y)")
_reached = " or ".join(f"{haversine(x, y, LON, LAT)} <= 20000" for x, y in (("lon - half", "lat - half"), ("lon + half", "lat - half"), ("lon + half", "lat + half")))
told("flight_restrictions", f"""select obs_id, case when bad then 'event' else 'feature' end as kind, case when bad then 'Restriction ' || obs_id || ', Area ' || obs_id || ': no usable geometry' else 'Area ' || obs_id end as label, case when bad then 1 else 0 end + case when obs_id % 4 = 0 then 1 else 0 end as dropped_areas,
  case obs_id % 3 when 2 then null else epoch_us(make_timestamp(2024, 1, obs_id % 28 + 1, 8, 0, 0.0)) + case obs_id % 3 when 0 then {5 * 3600 * 1_000_000} else 0 end end as valid_from_us, received_us as observed_us, case when not bad then 4 end as points,
  not bad and ({_reached} or ({LON} <= lon + half and {LAT} >= lat - half and {LAT} - lat < {LON} - lon)) as near
  from (select *, (obs_id % 3 + 1) * 0.0503::double as half, obs_id % 10 = 3 as bad from obs where lon is not null and obs_id % 9 > 0)""")
