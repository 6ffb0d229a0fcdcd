"""Scans, rules and helpers on small inputs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from trackweave.functions import geo, orbital
from trackweave.operators import alerts, filters, history
from trackweave.sources import normalise, scans


def test_scans(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"now": 1700000000.5, "aircraft": [{"hex": "adf7c9", "alt_baro": "ground", "lat": 1.0, "lon": 2.0, "seen": 1}, {"hex": "~2b", "alt_baro": 1000, "lat": 95.0, "lon": 2.0, "squawk": "7700"}, {"flight": "NOHEX"}]}))
    a = normalise.aircraft(scans.snapshots(spark, f"{tmp_path}/a.json"), F.col("now_us"), "local_adsb", True).collect()
    assert [(r.correlation_key, r.altitude_m, r.lon, r.tags) for r in a] == [("aircraft:icao:adf7c9", 0.0, 2.0, ["on_ground"]), ("aircraft:icao:2b", 1000 * 0.3048, None, ["emergency", "non_icao", "bad_position"])]
    message = {"MessageType": "PositionReport", "MetaData": {"MMSI": 5, "latitude": 1.0, "longitude": 2.0}, "Message": {"PositionReport": {"Sog": 102.3, "Cog": 360.0, "TrueHeading": 511, "NavigationalStatus": 5}}}
    (tmp_path / "b.txt").write_text(json.dumps(message) + "\nnot json\n")
    (tmp_path / "long.txt").write_text(json.dumps(message) + "\n" + json.dumps({**message, "pad": "x" * 70_000}) + "\n{}\n")
    assert (scans.ais_lines(spark, f"{tmp_path}/long.txt").count(), scans.ais_rejects(spark, f"{tmp_path}/long.txt").count()) == (1, 2)
    [v] = normalise.vessels(scans.ais_lines(spark, f"{tmp_path}/b.txt")).collect()
    assert (v.correlation_key, v.lon, v.speed_mps, v.heading_deg, v.nav_status_text) == ("ais:vessel:5", 2.0, None, None, "moored")
    (tmp_path / "c.json").write_text(json.dumps({"S1": {"2024-01-01T00:00:00Z": {"lat": 1.0, "lon": 1.0, "frame": 1}, "2024-01-01T00:00:09Z": {"lat": 2.0, "lon": 1.0, "vel_v": -5.0, "frame": 2}}}))
    [s] = normalise.sondes(scans.sonde_files(spark, f"{tmp_path}/c.json").withColumn("type", F.lit("RS41"))).collect()
    assert (s.lat, s.ascent_state, s.label) == (2.0, "descending", "RS41 S1")
    (tmp_path / "d.csv").write_text("latitude,longitude,acq_date,acq_time,confidence,frp\n1.5,2.5,2024-01-01,133,h,7\n")
    [f] = normalise.fires(scans.fire_files(spark, f"{tmp_path}/d.csv")).collect()
    assert (f.id, f.confidence_class, f.brightness_k) == ("fire:firms:sat:?:2024-01-01T133:1.5:2.5", "high", None)
    (tmp_path / "e.csv").write_text("Invalid key\n")
    with pytest.raises(ValueError):
        scans.fire_files(spark, f"{tmp_path}/e.csv")
    good, bad = scans.record_lines(spark, f"{tmp_path}/b.txt", "MessageType string")
    assert (good.count(), bad.count()) == (1, 1)


def ticks(spark, rows):
    return spark.createDataFrame([("s", k, k, "track", *r) for k, r in enumerate(rows)], "subject string, t long, ord long, subject_type string, x double, lon double, lat double, altitude_m double, status string")


def test_conditions(spark):
    df = ticks(spark, [(None, None, None, None, None), (5.0, 0.0, 0.0, 100.0, "stale"), (7.0, 0.5, 0.0, None, "offline")])

    def levels(op, value=None, **more):
        fence = more.pop("fence", None)
        rule = alerts.Rule("r", ("track",), (alerts.Condition("x", op, value, **more),), fence=fence)
        return [(r.ord, r.level) for r in alerts.evaluate(df, rule, alerts.Context(station=(0.0, 0.0, 0.0))).orderBy("ord").collect()]

    assert levels("equals", 5.0) == [(0, False), (1, True), (2, False)]
    assert levels("not_equals", 5.0) == [(0, True), (1, False), (2, True)]
    assert levels("in", [5.0, 7.0]) == [(0, False), (1, True), (2, True)]
    assert levels("not_in", [7.0]) == [(0, True), (1, True), (2, False)]
    assert levels("less_than", 6.0) == [(0, False), (1, True), (2, False)]
    assert levels("not_exists") == [(0, True), (1, False), (2, False)]
    assert levels("source_offline") == [(0, False), (1, False), (2, True)]
    assert levels("changed_from", 5.0) == [(0, False), (1, False), (2, True)]
    box = alerts.Fence(rings=(((-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)),))
    assert levels("entered_geofence", fence=box) == [(1, True), (2, False)]
    assert levels("exited_geofence", fence=box) == [(1, False), (2, True)]
    assert levels("entered_geofence") == []
    assert levels("distance_above", threshold=1000.0) == [(1, False), (2, True)]
    assert levels("elevation_crossed", threshold=45.0) == [(1, True)]
    assert levels("watchlist", False) == [(0, True), (1, True), (2, True)]


def test_counts_and_changes_see_qualifying_ticks_only(spark):
    c, context = alerts.Condition, alerts.Context(station=(0.0, 0.0, 0.0))
    box = alerts.Fence(rings=(((-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)),))
    level = lambda df, rule: [(r.ord, r.level) for r in alerts.evaluate(df, rule, context).orderBy("ord").collect()]

    # only ticks on which the other condition holds are counted
    df = ticks(spark, [(1.0, 0.0, 0.0, None, None)] * 2 + [(7.0, 0.0, 0.0, None, None)] * 2)
    rule = alerts.Rule("r", ("track",), (c("x", "equals", 7.0), c("id", "count_within_window", threshold=2, window_us=60)))
    assert level(df, rule) == [(0, False), (1, False), (2, False), (3, True)]

    # ticks without a point are not evaluable and leave no count; of equal times only the earlier ord counts
    df = ticks(spark, [(1.0, None, None, None, None)] * 2 + [(1.0, 0.0, 0.0, None, None)] * 2).withColumn("t", F.lit(5).cast("long"))
    rule = alerts.Rule("r", ("track",), (c("geometry", "entered_geofence"), c("id", "count_within_window", threshold=2, window_us=60)), fence=box)
    assert level(df, rule) == [(2, False), (3, True)]

    # a count leaves its window
    df = ticks(spark, [(1.0, 0.0, 0.0, None, None)] * 3).withColumn("t", F.col("ord") * 100)
    rule = alerts.Rule("r", ("track",), (c("id", "count_within_window", threshold=2, window_us=100),))
    assert level(df, rule) == [(0, False), (1, True), (2, True)]

    # the last evaluable value is what a change is told from
    df = ticks(spark, [(5.0, 0.0, 0.0, None, None), (7.0, None, None, None, None), (7.0, 0.0, 0.0, None, None)])
    rule = alerts.Rule("r", ("track",), (c("x", "changed_to", 7.0), c("geometry", "entered_geofence")), fence=box)
    assert level(df, rule) == [(0, False), (2, True)]


def test_areas(spark):
    ring = lambda x, y, d: F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((x, y), (x + d, y), (x + d, y + d), (x, y + d))])
    row = spark.range(1).select(
        geo.rings_intersect(ring(0.0, 0.0, 2.0), ring(1.0, 1.0, 2.0)).alias("cross"), geo.rings_intersect(ring(0.0, 0.0, 3.0), ring(1.0, 1.0, 1.0)).alias("nested"), geo.rings_intersect(ring(0.0, 0.0, 1.0), ring(2.0, 2.0, 1.0)).alias("apart"),
        geo.ring_intersects_circle(ring(0.0, 0.0, 1.0), 1.1, 0.5, 12_000.0).alias("near"), geo.ring_intersects_circle(ring(0.0, 0.0, 1.0), 1.1, 0.5, 10_000.0).alias("far"),
        geo.point_in_ring(F.lit(-179.5), F.lit(0.5), ring(179.0, 0.0, 2.0)).alias("wrapped")).first()
    assert row.asDict() == {"cross": True, "nested": True, "apart": False, "near": True, "far": False, "wrapped": True}


def test_segment_distance(spark):
    """Against the nearest of many points along the segment, over the antimeridian too, and for one that is a point."""
    import random

    pick = random.Random(2)
    rows = [((pick.uniform(-180, 180), pick.uniform(-70, 70)), pick.uniform(-3, 3), pick.uniform(-3, 3), pick.uniform(-3, 3), pick.uniform(-3, 3)) for _ in range(60)]
    rows = [((x + 180) % 360 - 180, y, [(x + a + 180) % 360 - 180, y + b], [(x + c + 180) % 360 - 180, y + d]) for (x, y), a, b, c, d in rows]
    rows += [(10.0, 50.0, [11.0, 50.0], [11.0, 50.0]), (179.9, 0.0, [-179.9, -1.0], [-179.9, 1.0])]
    df = spark.createDataFrame(rows, "x double, y double, a array<double>, b array<double>")
    along = F.transform(F.sequence(F.lit(0), F.lit(2000)), lambda i: geo.haversine_m(F.col("x"), F.col("y"), geo.unwrap_lon(F.col("a")[0], F.col("x")) * (1 - i / 2000) + geo.unwrap_lon(F.col("b")[0], F.col("x")) * i / 2000, F.col("a")[1] * (1 - i / 2000) + F.col("b")[1] * i / 2000))
    for r in df.select(geo.segment_distance_m(F.col("x"), F.col("y"), F.col("a"), F.col("b")).alias("d"), F.array_min(along).alias("near")).collect():
        assert r.near - 300 <= r.d <= r.near * 1.02 + 300


def test_tiles_cover_the_disk(spark):
    import random

    pick = random.Random(5)
    disks = spark.range(1).select(F.explode(geo.tiles(170.0, 55.0, 700.0, 250.0)).alias("d")).select("d.*").collect()
    points = []
    for _ in range(400):
        bearing, far = pick.uniform(0, 2 * math.pi), 700 * math.sqrt(pick.random())
        points.append((170.0 + far * math.sin(bearing) / 60 / math.cos(math.radians(55)), 55.0 + far * math.cos(bearing) / 60))
    near = lambda x, y, d: math.hypot(((x - d.lon + 180) % 360 - 180) * 60 * math.cos(math.radians(55)), (y - d.lat) * 60) <= d.radius_nm
    assert all(any(near(x, y, d) for d in disks) for x, y in points)
    assert [tuple(r.d) for r in spark.range(1).select(F.explode(geo.tiles(1.0, 2.0, 250.0, 250.0)).alias("d")).collect()] == [(1.0, 2.0, 250.0)]


def test_frames_round_trip(spark):
    there = orbital.geodetic_to_ecef(F.lit(48.0), F.lit(11.0), F.lit(550.0))
    back = spark.range(1).select(there.alias("p")).select(orbital.ecef_to_geodetic(F.col("p.x"), F.col("p.y"), F.col("p.z")).alias("g")).first().g
    assert (round(back.lat, 7), round(back.lon, 7), round(back.alt_m, 2)) == (48.0, 11.0, 550.0)


def test_config_and_helpers(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    change = spark.createDataFrame([("a", None, "z"), ("c", 3, "w")], "k string, n int, s string")
    assert sorted(map(tuple, history.patch(table, change, "k").collect())) == [("a", 1, "z"), ("b", 2, "y")]
    assert sorted(map(tuple, history.insert_ignore(table, change, "k").collect())) == [("a", 1, "x"), ("b", 2, "y"), ("c", 3, "w")]
    assert history.pressure(95, 100, 10, 1) == "critical" and history.pressure(85, 100, 10, 1) == "high" and history.pressure(1, 100, 10, 1) == "ok"
    assert filters.station_box(0, 0, 100) is None and filters.clamp_box((0, 0, 1, 1), (5, 5, 6, 6)) == (5, 5, 6, 6)
    assert normalise.parse_ranges("a-f,zz-1,9-1") == [(10, 15)]
    assert spark.range(1).select(F.size(geo.tiles(0.0, 0.0, 500.0, 250.0)).alias("n")).first().n > 4


def test_shared_dedup_key_fires_once(spark):
    rows = spark.createDataFrame([("a", 1, 1, True), ("b", 2, 2, True)], "subject string, t long, ord long, level boolean").withColumn("discrete", F.lit(False))
    fired = lambda **more: sorted((r.subject, r.t, r.action) for r in alerts.fire(rows, alerts.Rule("r", ("track",), (), **more)).collect())
    assert fired() == [("a", 1, "fire"), ("b", 2, "fire")]
    assert fired(dedup_key="group") == [("group", 1, "fire")]


def test_subscription_without_geometry(spark):
    kinds = ["feature", "track", "event", "alert", "source_status", "packet", None]
    rows = spark.createDataFrame([(k, "ais", "vessel", None) for k in kinds], "kind string, source string, track_type string, vertices array<array<double>>")
    for box in (None, (0.0, 0.0, 1.0, 1.0)):
        assert [r.kind for r in rows.where(filters.Subscription(bbox=box).predicate()).collect()] == kinds[1:]


def test_store_and_back(spark):
    """Everything that a track holds comes back, nested values too; bad payloads are skipped alone."""
    kind = "record_id string, source string, observed_us long, tags array<string>, spot struct<lon: double, lat: double>, kind string"
    tracks = spark.createDataFrame([("a", "ais", 5, ["x", 'q"'], (1.5, -2.0), "track"), ("b", "ais", 6, None, None, "track"), ("c", "ais", 7, [], None, "event")], kind)
    rows = history.flattened(tracks, F.lit(9))
    assert sorted(r.record_id for r in rows.collect()) == ["a", "b"] and rows.columns == [*history.STORED, "persisted_us", "payload"]
    bad = [("{", ), ("[1]",), (None,), ('{"record_id": "d", "source": "ais"}',), ('{"record_id": "e", "source": "ais", "observed_us": "soon"}',), ("",)]
    both = rows.select("payload").unionByName(spark.createDataFrame(bad, "payload string"))
    back, skipped = history.reconstructed(both, kind, ["record_id", "observed_us"])
    assert sorted(map(str, back.collect())) == sorted(map(str, tracks.where("kind = 'track'").collect())) and skipped.count() == len(bad)
