"""Propagation against published vectors, passes against a plain search second by second."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.functions import orbital, propagator
from trackweave.operators import orbits
from trackweave.plans import queries

# fixed values: elements and verification vectors published with the model (km, km/s)
VECTORS = [
    ((16.05824518, 0.0086731, 72.8435, 115.9689, 52.6988, 110.5714, 0.66816e-4), 0.0, (2328.96975262, -5995.22051338, 1719.97297192, 2.912073281, -0.983417956, -7.090816210)),
    ((16.05824518, 0.0086731, 72.8435, 115.9689, 52.6988, 110.5714, 0.66816e-4), 120.0, (1020.69234558, 2286.56260634, -6191.55565927, -3.746543902, 6.467532721, 1.827985678)),
    ((10.82419157, 0.1859667, 34.2682, 348.7242, 331.7664, 19.3264, 0.28098e-4), 0.0, (7022.46529266, -1400.08296755, 0.03995155, 1.893841015, 6.405893759, 4.534807250)),
    ((10.82419157, 0.1859667, 34.2682, 348.7242, 331.7664, 19.3264, 0.28098e-4), 360.0, (-7154.03120202, -3783.17682504, -3536.19412294, 4.741887409, -4.151817765, -2.093935425)),
]
ISS = dict(zip(propagator.ELEMENTS, (15.5, 0.0005, 51.64, 30.0, 90.0, 20.0, 3e-5), strict=True))
KIND = "norad_id long, epoch_us long, " + ", ".join(f"{c} double" for c in propagator.ELEMENTS)


@pytest.mark.parametrize(("elements", "minutes", "want"), VECTORS)
def test_published_vectors(elements, minutes, want):
    found = propagator.positions(*elements, minutes)
    assert np.abs(found[:3] - want[:3]).max() < 2e-5 and np.abs(found[3:] - want[3:]).max() < 2e-8


def test_no_position():
    many = [np.array([2.0, 15.0, 0.0, 15.0, 16.4, np.nan]), np.array([0.1, 1.2, 0.1, -0.1, 0.0, 0.1])]
    found = propagator.positions(*many, 50.0, 0.0, 0.0, 0.0, np.array([0, 0, 0, 0, 0.1, 0]), np.array([0, 0, 0, 0, 14400.0, 0]))
    assert np.isnan(found).all()
    assert np.isfinite(propagator.positions(*ISS.values(), 100.0)).all()


def rows(spark, *, start=1_700_000_000_000_000):
    sets = [(k, start - k * 10**9, *{**ISS, "inclination": 20.0 + 5 * k, "node": 40.0 * k, "mean_motion": 12.0 + k / 4}.values()) for k in range(14)]
    return spark.createDataFrame([*sets, (99, start, 2.0, *list(ISS.values())[1:]), (98, None, *ISS.values())], KIND), start


def test_predicted_tracks(spark):
    df, start = rows(spark)
    found = {r.norad_id: r for r in orbits.predicted_tracks(df, F.lit(start), (8.0, 47.0, 400.0)).collect()}
    assert set(found) == set(range(14))
    for k, r in found.items():
        elements = [np.array([r[c]]) for c in propagator.ELEMENTS]
        up = propagator.elevations(elements, np.array([float(r.epoch_us)]), np.array([float(start)]), 47.0, 8.0, 400.0)
        assert abs(up[0] - r.elevation_deg) < 1e-6 and 300e3 < r.altitude_m < 2500e3 and abs(r.lat) <= 20 + 5 * k + 1
        assert r.valid_until_us == start + 30_000_000 and r.correlation_key == f"orbital:element:{k}" and r.predicted and not r.locally_received
    high = orbits.predicted_tracks(df, F.lit(start), (8.0, 47.0, 400.0), floor_deg=0.0).collect()
    assert {r.norad_id for r in high} == {k for k, r in found.items() if r.elevation_deg >= 0}


def test_passes(spark):
    df, start = rows(spark)
    window = 4 * 3600
    for r in orbits.next_passes(df, start, (8.0, 47.0, 400.0), window_s=window).collect():
        if r.norad_id > 50:
            assert (r.rise_us, r.culmination_us, r.set_us, r.peak_deg) == (None,) * 4
            continue
        t = start + np.arange(window + 1) * 1e6
        up = propagator.elevations([np.array([r[c]]) for c in propagator.ELEMENTS], np.array([float(r.epoch_us)]), t, 47.0, 8.0, 400.0)
        over = up > orbits.PASS_FLOOR
        runs = np.flatnonzero(np.diff(np.r_[False, over, False].astype(int))).reshape(-1, 2)
        if not len(runs):
            assert r.culmination_us is None
            continue
        a, b = runs[0]
        best = a + up[a:b].argmax()
        if b - a < 60:  # shorter than two steps: it may fall between samples
            continue
        assert abs(r.culmination_us - t[best]) < 2e6 and abs(r.peak_deg - up[best]) < 0.01
        assert (r.rise_us is None) == (a == 0) and (a == 0 or abs(r.rise_us - t[a]) < 1.1e6)
        assert (r.set_us is None) == (b > window) and (b > window or abs(r.set_us - t[b]) < 1.1e6)


def test_elements_of_files(spark, tmp_path):
    good = {"OBJECT_NAME": "A", "OBJECT_ID": "1998-067A", "EPOCH": "2024-01-29T12:00:00.000000", "MEAN_MOTION": 15.5, "ECCENTRICITY": 0.0005, "INCLINATION": 51.64, "RA_OF_ASC_NODE": 30, "ARG_OF_PERICENTER": 90, "MEAN_ANOMALY": 20, "NORAD_CAT_ID": "25544", "BSTAR": 3e-5}
    bad = [{**good, "EPOCH": "soon"}, {k: v for k, v in good.items() if k != "BSTAR"}, {**good, "NORAD_CAT_ID": "x"}, {**good, "MEAN_MOTION": None}]
    (tmp_path / "a.json").write_text(json.dumps([good, *bad, {**good, "OBJECT_NAME": " ", "NORAD_CAT_ID": 7}]))
    kept, skipped = orbits.elements(orbits.element_files(spark, f"{tmp_path}/a.json"))
    assert sorted((r.norad_id, r.object_name, r.mean_motion) for r in kept.collect()) == [(7, "NORAD 7", 15.5), (25544, "A", 15.5)]
    assert skipped.count() == 4


def test_frames(spark):
    """Turning by sidereal time keeps length and axis, and a quarter turn of it swaps the axes."""
    row = spark.range(1).select(orbital.teme_to_ecef(F.lit(3.0), F.lit(4.0), F.lit(5.0), F.lit(10**15)).alias("e"), orbital.gmst(F.lit(10**15)).alias("g")).first()
    assert row.e.z == 5.0 and abs(row.e.x**2 + row.e.y**2 - 25) < 1e-9
    assert abs(np.arctan2(row.e.y, row.e.x) - (np.arctan2(4, 3) - row.g) % (2 * np.pi)) % (2 * np.pi) < 1e-9 or abs(row.e.x - (3 * np.cos(row.g) + 4 * np.sin(row.g))) < 1e-9


def test_queries_without_sql(spark):
    for name in queries.NO_SQL:
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_elements_of_one_file_are_dealt(spark):
    """The search of passes is the work: a table that one task reads is dealt to all cores."""
    from trackweave.plans.queries import QUERIES

    for name in ("pass_predictions", "predicted_tracks"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
