"""Fence tables and range tables against brute force."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackweave.functions import geo
from trackweave.operators import fences, ranges
from trackweave.plans.queries import QUERIES
from trackweave.sources import normalise

POINTS = "id long, lon double, lat double, altitude_m double, fence_id string, x string, level int"


def fence_rows(lons=(-180, 180), lats=(-80, 80), sizes=(0.01, 0.5, 5.0, 40.0)):
    pick = random.Random(8)
    rows = []
    for k in range(60):
        lon, lat, r = (pick.uniform(*lons) + 180) % 360 - 180, pick.uniform(*lats), pick.choice(sizes)
        if k % 2:
            rows.append((f"c{k}", [lon, lat], r * 90_000, None, None, None))
        else:
            ring = [[(lon + dx * r + 180) % 360 - 180, max(-89.0, min(89.0, lat + dy * r))] for dx, dy in ((-1, -1), (1, -0.8), (0.9, 1), (0, 0.4), (-1, 0.7))]
            hole = [[(lon + dx * r / 5 + 180) % 360 - 180, max(-89.0, min(89.0, lat + dy * r / 5))] for dx, dy in ((-1, -1), (1, -1), (0, 0.5))]
            rows.append((f"p{k}", None, None, [ring, hole] if k % 4 else [ring], 100.0 if k % 3 == 0 else None, 5000.0 if k % 5 == 0 else None))
    rows.append(("pole", [10.0, 89.9], 50_000.0, None, None, None))
    rows.append(("line", [179.95, 0.0], 20_000.0, None, None, None))
    return [*rows, ("empty", None, None, None, None, None), ("two points", None, None, [[[0.0, 0.0], [1.0, 1.0]]], None, None), ("no radius", [0.0, 0.0], None, None, None, None)]


def point_rows():
    pick = random.Random(9)
    rows = [(k, pick.uniform(-180, 180), pick.uniform(-90, 90), pick.choice([None, 50.0, 1000.0, 9000.0])) for k in range(400)]
    for k, (_, center, _, rings, *_) in enumerate(fence_rows()):
        at = center or (rings[0][0] if rings else None)
        rows += [(1000 + 20 * k + j, (at[0] + pick.gauss(0, 0.3) + 180) % 360 - 180 if j else at[0], max(-90.0, min(90.0, at[1] + (pick.gauss(0, 0.3) if j else 0))), 1000.0) for j in range(12) if at]
    rows += [(9000, None, 1.0, 1.0), (9001, 1.0, None, 1.0), (9002, 180.0, 0.0, None), (9003, -180.0, 0.0, 5.0), (9003, -180.0, 0.0, 5.0), (None, 10.0, 89.95, None)]
    return [(*r, "clash", "y", 3) for r in rows]


def test_points_in_fences(spark):
    table = spark.createDataFrame(fence_rows(), fences.SCHEMA)
    points = spark.createDataFrame(point_rows(), POINTS)
    every = points.select("id", "lon", "lat", "altitude_m").crossJoin(table)
    flat = F.when(F.col("center").isNotNull(), geo.point_in_circle(F.col("lon"), F.col("lat"), F.col("center")[0], F.col("center")[1], F.col("radius_m"))).otherwise(geo.point_in_polygon(F.col("lon"), F.col("lat"), F.col("rings")))
    want = every.where(flat & geo.in_altitude_band(F.col("altitude_m"), F.col("low_m"), F.col("high_m")))
    got = fences.inside(points, table, ["id"])
    told = lambda df: sorted(map(str, df.select("id", "fence_id").collect()))
    assert got.columns == ["id", "fence_id"] and len(told(got)) > 200 and told(got) == told(want)
    assert fences.inside(points, table.limit(0), ["id"]).collect() == [] == fences.inside(points.limit(0), table, ["id"]).collect()
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_areas_and_fences(spark):
    """Around the antimeridian; shapes of all sizes, but none so wide that unwrapping it at the other's first point tears it."""
    shapes = fence_rows((170, 190), (-10, 10), (0.05, 0.5, 2.0, 9.0))
    table = spark.createDataFrame(shapes, fences.SCHEMA)
    areas = spark.createDataFrame([(k, [r[3][0]]) for k, r in enumerate(shapes) if r[3]] + [(500, None), (501, [])], "area long, rings array<array<array<double>>>")
    ring = F.get("a.rings", F.lit(0))
    both = areas.alias("a").crossJoin(table.where("fence_id <> 'pole'").alias("f"))
    met = F.when(F.col("f.center").isNotNull(), geo.ring_intersects_circle(ring, F.col("f.center")[0], F.col("f.center")[1], F.col("f.radius_m"))).otherwise(geo.rings_intersect(ring, F.get("f.rings", F.lit(0))))
    near = F.abs(geo.unwrap_lon(F.coalesce(F.col("f.center"), F.get(F.get("f.rings", F.lit(0)), F.lit(0)))[0], ring[0][0]) - ring[0][0]) < 90
    want = both.where(met & near).select("area", "fence_id").collect()
    got = fences.meeting(areas, table, "area").collect()
    assert len(want) > 200 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_missing_fence_is_unknown(spark):
    rules = spark.createDataFrame([("r1", "c1"), ("r2", "gone"), ("r3", None)], "rule_id string, fence_id string")
    assert sorted(r.rule_id for r in fences.unknown(rules, spark.createDataFrame(fence_rows(), fences.SCHEMA)).collect()) == ["r2", "r3"]


def test_prepared_rings(spark):
    """Points on edges and corners, and rings over the antimeridian, as point_in_ring() tells them."""
    rings = [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]], [[179.0, 0.0], [-179.0, 0.0], [-179.0, 2.0], [179.0, 2.0]], [[0.0, 0.0], [4.0, 0.0], [0.0, 4.0], [0.0, 0.0]], [[0.0, 0.0], [1.0, 1.0]], []]
    at = [(x, y) for x in (0.0, 1.0, 2.0, 3.0, 180.0, -180.0, 179.0, -178.5) for y in (0.0, 1.0, 2.0, 2.5)]
    rows = spark.createDataFrame([(r, x, y) for r in rings for x, y in at], "ring array<array<double>>, x double, y double")
    for r in rows.select("*", geo.in_prepared(F.col("x"), F.col("y"), geo.prepared(F.col("ring"))).alias("a"), geo.point_in_ring(F.col("x"), F.col("y"), F.col("ring")).alias("b")).collect():
        assert bool(r.a) == bool(r.b), r


def test_values_in_ranges(spark):
    pick = random.Random(1)
    table = [(k, lo := pick.randint(-50, 3000), lo + pick.choice([0, 1, 7, 64, 900, 10**7])) for k in range(150)] + [(900, 10, 5), (901, None, 5), (902, 5, None), (903, 2**31, 2**40), (904, 0, 2**32 - 1)]
    values = [pick.randint(0, 4000) for _ in range(300)] + [0, 2**31, 2**32 - 1, 2**32, -1, None, 7, 7]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, v long")
    df = spark.createDataFrame(table, "k long, low long, high long")
    got = ranges.in_ranges(rows, "v", df, "low", "high")
    want = sorted((i, k) for i, v in enumerate(values) for k, lo, hi in table if None not in (v, lo, hi) and lo <= v <= hi and 0 <= v < 2**32)
    assert got.columns == ["id", "v", "k", "low", "high"] and sorted((r.id, r.k) for r in got.collect()) == want
    assert sorted(r.id for r in ranges.in_any(rows, "id", "v", df, "low", "high").collect()) == sorted({i for i, _ in want})
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=20, max_size=40))
def test_blocks_are_few_and_exact(spark, pairs):
    table = [(k, min(p), max(p)) for k, p in enumerate(pairs)]
    rows = ranges.blocks(spark.createDataFrame(table, "k long, low long, high long"), "low", "high").collect()
    for k, low, high in table:
        own = sorted((r.prefix << r.level, (r.prefix + 1) << r.level) for r in rows if r.k == k)
        assert own[0][0] == low and own[-1][1] == high + 1 and len(own) <= 2 * ranges.BITS
        assert all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))


def test_bare_address_is_a_block_of_one():
    assert normalise.parse_ranges("abcdef, 1-a,zz,5-2,") == [(0xABCDEF, 0xABCDEF), (1, 10)]


def test_cells_are_never_broadcast(spark):
    """A cover is many times as large as its table looks: small files must not send it through the driver."""
    for name in ("area_fences", "fence_table"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_pairs_are_found_once(spark):
    """Areas and fences of very different sizes, around the antimeridian too, that share many cells or just an edge."""
    square = lambda x, y, s: [[[x, y], [x + s, y], [x + s, y + s], [x, y + s]]]
    areas = spark.createDataFrame([("a", square(178.0, 0.0, 4.0)), ("b", square(-179.5, 1.0, 0.01)), ("c", square(182.0, 4.0, 1.0)), ("d", square(0.0, 0.0, 8.0))], "area string, rings array<array<array<double>>>")
    shapes = [("f", square(179.9, 0.5, 0.2)), ("g", square(-180.1, 0.9, 1.0)), ("h", square(182.0, 3.0, 1.0)), ("i", square(1.0, 1.0, 0.001)), ("j", square(-4.0, -4.0, 16.0))]
    table = spark.createDataFrame([(k, None, None, r, None, None) for k, r in shapes], fences.SCHEMA)
    got = sorted(tuple(r) for r in fences.meeting(areas, table, "area").collect())
    assert got == [("a", "f"), ("a", "g"), ("a", "h"), ("b", "g"), ("c", "h"), ("d", "i"), ("d", "j")]


def test_points_of_one_place(spark):
    """A place is tested once; its points differ in altitude and may repeat."""
    points = spark.createDataFrame([(1, 0.0, 0.0, 50.0), (2, 0.0, 0.0, 500.0), (2, 0.0, 0.0, 50.0), (3, 0.0, 0.0, None), (4, 9.0, 0.0, 50.0)], "id int, lon double, lat double, altitude_m double")
    table = spark.createDataFrame([("low", [0.0, 0.0], 100.0, None, None, 100.0), ("any", [0.0, 0.0], 100.0, None, None, None)], fences.SCHEMA)
    got = sorted(tuple(r) for r in fences.inside(points, table, ["id"]).collect())
    assert got == [(1, "any"), (1, "low"), (2, "any"), (2, "any"), (2, "low"), (3, "any")]


def test_pairs_are_told_in_the_join(spark):
    """Rings are not walked for each pair that shares a cell: no function of arrays is in the join, which compiles."""
    plan = QUERIES["area_fences"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert len(joins) == 1 and not [j for j in joins if "lambda" in j]


def test_outlines_agree_with_rings(spark):
    """Shapes that just touch, hollow and crossed ones, and some that only their sloping sides or their hollows keep apart."""
    pick = random.Random(5)
    forms = {
        "square": [(-1, -1), (1, -1), (1, 1), (-1, 1)], "tip": [(1, 0), (0, 1), (-1, 0), (0, -1)], "corner": [(-1, -1), (1, -1), (-1, 1)], "bow": [(-1, -1), (1, 1), (1, -1), (-1, 1)],
        "hook": [(-1, -1), (1, -1), (1, 1), (0.75, 1), (0.75, -0.75), (-1, -0.75)], "star": [(0, 1), (0.25, 0.25), (1, 0), (0.25, -0.25), (0, -1), (-0.25, -0.25), (-1, 0), (-0.25, 0.25)],
        "flat": [(-1, 0), (1, 0), (0, 0)], "round": [(1, 0.5), (0.5, 1), (-0.5, 1), (-1, 0.5), (-1, -0.5), (-0.5, -1), (0.5, -1), (1, -0.5), (1, 0.5)],
    }

    def shape(unit, at):
        corners, size = pick.choice(list(forms.values())), pick.choice([0.25, 1.0, 2.0, 8.0])
        x, y = at + pick.randint(-24, 24) / 2, pick.randint(-24, 24) / 2
        return [[[((x + dx * size) * unit + 180) % 360 - 180 if at else (x + dx * size) * unit, (y + dy * size) * unit] for dx, dy in corners]]

    for unit, at, n in ((0.0625, 0, 60), (2.0**-20, 0, 60), (0.25, 180 / 0.25, 50), (4.0, 0, 50)):
        own = [(k, shape(unit, at)) for k in range(n)]
        theirs = [(f"f{k}", None, None, shape(unit, at), None, None) for k in range(n + 7)]
        areas, table = spark.createDataFrame(own, "area long, rings array<array<array<double>>>"), spark.createDataFrame(theirs, fences.SCHEMA)
        want = areas.alias("a").crossJoin(table.alias("f")).where(geo.rings_intersect(F.col("a.rings")[0], F.col("f.rings")[0])).select("area", "fence_id").collect()
        assert len(want) > n and sorted(map(tuple, fences.meeting(areas, table, "area").collect())) == sorted(map(tuple, want)), unit
    assert fences.meeting(areas.limit(0), table, "area").collect() == [] == fences.meeting(areas, table.limit(0), "area").collect()
    # the larger table lies, the smaller covers, whichever they are
    swapped = fences.meeting(table.select("fence_id", "rings").withColumnRenamed("fence_id", "name"), areas.selectExpr("cast(area as string) as fence_id", "cast(null as array<double>) as center", "cast(null as double) as radius_m", "rings"), "name")
    assert sorted((int(a), f) for f, a in swapped.collect()) == sorted(map(tuple, want))
