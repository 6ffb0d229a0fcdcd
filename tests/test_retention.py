"""The retention ladder against plain Python, at several pressures."""

import math

import pytest

from trackweave.operators import history

DAY = history.DAY_US
NOW = 100 * DAY


def plain_ladder(rows, policy, free):
    """rows: (obs_id, identity, observed_us), none without a time."""
    before, days = len(rows), policy.days
    first = policy.pressure(before * policy.row_bytes, free)
    keep = lambda rs, d: [r for r in rs if r[2] >= NOW - d * DAY]
    drop = lambda rs, n: sorted(rs, key=lambda r: (r[2], r[0]))[n:]
    rows = keep(rows, days)
    if first != "none":
        lowest = {}
        for r in rows:
            key = (r[1], r[2] // history.THIN_US)
            lowest[key] = min(lowest.get(key, r[0]), r[0]) if r[2] < NOW - DAY else None
        rows = [r for r in rows if r[2] >= NOW - DAY or lowest[r[1], r[2] // history.THIN_US] == r[0]]
        for _ in range(4):
            size = len(rows) * policy.row_bytes
            if policy.pressure(size, None if free is None else free + (before - len(rows)) * policy.row_bytes) == "none" or not rows:
                break
            if policy.max_bytes and size > policy.max_bytes * policy.high:
                rows = drop(rows, max(policy.least_rows, math.ceil((size - policy.max_bytes * policy.high) / policy.row_bytes)))
            elif days > 1:
                days = max(1, days // 2)
                rows = keep(rows, days)
            else:
                rows = drop(rows, policy.least_rows)
    return sorted(r[0] for r in rows), first, days


@pytest.fixture(scope="module")
def rows():
    # ties of time, seconds full of rows, and buckets with several rows of an identity
    return [(k, f"i{k % 3}", NOW - (k * k * 7919 % 40) * DAY - k % 4 * 9_000_000 - k % 2) for k in range(400)]


@pytest.mark.parametrize(
    "policy, free",
    [
        (history.Retention(30, 0, 10), None),
        (history.Retention(30, 4_100, 10, least_rows=5), None),
        (history.Retention(30, 3_333, 10, least_rows=250), 10**9),
        (history.Retention(30, 0, 10, min_free=2_500, least_rows=20), 100),
        (history.Retention(3, 0, 10, min_free=10**6, least_rows=7), 100),
        (history.Retention(60, 10, 10, least_rows=10_000), None),
    ],
)
def test_ladder(spark, rows, policy, free):
    table = spark.createDataFrame(rows, "obs_id long, identity string, observed_us long").repartition(3)
    kept, report = history.retention_ladder(table, NOW, policy, free)
    found = sorted(r.obs_id for r in kept.collect())
    assert (found, report["pressure"], report["days"]) == plain_ladder(rows, policy, free)
    assert report["rows_before"] == len(rows) and report["rows_after"] == len(found)
    assert report["expired"] + report["thinned"] + report["oldest"] == len(rows) - len(found)
    told = history.pressure_records(report, NOW)
    assert [r["kind"] for r in told] == ([] if report["pressure"] == "none" else ["source_status", "event"])


def test_without_oldest(spark):
    rows = [(k, "i", None if k % 10 == 0 else k // 7 * 400_000) for k in range(100)]
    table = spark.createDataFrame(rows, "obs_id long, identity string, observed_us long").repartition(3)
    timed = sorted((r[2], r[0]) for r in rows if r[2] is not None)
    for n in (0, 1, 13, 89, 90, 500):
        found = {r.obs_id for r in history.without_oldest(table, n).collect()}
        assert found == {k for _, k in timed[n:]} | {r[0] for r in rows if r[2] is None}
