"""Packets of each kind, times by the receipt, malformed lines."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from trackweave.sources import packets, scans

RECEIVED = datetime(2024, 3, 1, 6, 30, tzinfo=UTC)
US = int(RECEIVED.timestamp() * 1e6)
AT = "4903.50N/07201.75W"


def read(spark, *lines, received=US):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "id int, line string")
    return packets.tracks(df, "line", F.lit(received), "local_aprs", True).orderBy("id").collect()


def test_kinds(spark):
    got = read(
        spark, f"ab1cde-9>apdr16,WIDE1-1, ,WIDE2-1:={AT}>088/036/A=001234Hello there", f"AB1CDE>X:/290345z{AT}-Home", "AB1CDE>X:!/5L!!<*e7>7P!note", f"AB1CDE>X:;LEADER   _290345z{AT}>270/010",
        f"AB1CDE>X:)AID#2!{AT}n Help", "AB1CDE>X:_02290556c220s004g005t077r100p000P000h00b09900w", f"AB1CDE>X:!{AT}_220/004g005t-05h50", "AB1CDE>X:> On air ", "AB1CDE>X:!4903.5 N/07201.7 W#x", f"AB1CDE>X:}}ZZ9ZZ-1>Y,P1:!{AT}>Relayed", "AB1CDE>X:;EMPTY    *111111znothing here")
    key = [r.correlation_key for r in got]
    assert key == ["aprs:station:AB1CDE-9", *["aprs:station:AB1CDE"] * 2, "aprs:object:LEADER", "aprs:object:AID#2", *["aprs:station:AB1CDE"] * 4, "aprs:station:ZZ9ZZ-1", "aprs:object:EMPTY"]
    a = got[0]
    assert (round(a.lat, 5), round(a.lon, 5), a.heading_deg, round(a.speed_mps, 3), round(a.altitude_m, 2)) == (49.05833, -72.02917, 88.0, 18.520, 376.12)
    assert (a.comment, a.symbol, a.dest, a.path, a.observed_us, a.tags, a.track_type, a.locally_received) == ("Hello there", "/>", "APDR16", ["WIDE1-1", "WIDE2-1"], US, [], "aprs_station", True)
    assert got[1].observed_us == int(datetime(2024, 2, 29, 3, 45, tzinfo=UTC).timestamp() * 1e6) and got[1].comment == "Home"
    assert (round(got[2].lat, 3), round(got[2].lon, 3), got[2].symbol, got[2].comment) == (49.5, -72.75, "/>", "note")
    assert (got[3].tags, got[3].heading_deg, got[3].reported_by, got[3].track_type) == (["object", "killed"], 270.0, "AB1CDE", "aprs_object")
    assert (got[4].tags, got[4].comment) == (["item"], "Help")
    w = got[5].weather
    assert (w.wind_dir_deg, w.wind_speed_mph, w.gust_mph, w.temp_f, w.temp_c, w.rain_last_hr_in, w.humidity_pct, w.pressure_hpa) == (220, 4, 5, 77, 25.0, 1.0, 100, 990.0)
    assert got[5].tags == ["weather"] and got[5].lon is None and got[5].observed_us == int(datetime(2024, 2, 29, 5, 56, tzinfo=UTC).timestamp() * 1e6)
    assert (got[6].weather.temp_f, got[6].weather.humidity_pct, got[6].tags, got[6].heading_deg, got[6].comment) == (-5, 50, ["weather"], None, None)
    assert (got[7].status, got[7].tags, got[7].lat) == ("On air", ["status"], None)
    assert got[8].tags == ["position_ambiguity"] and round(got[8].lat, 5) == 49.05833
    assert (got[9].tags, got[9].relayed_by, got[9].comment) == (["third_party"], "AB1CDE", "Relayed")
    assert (got[10].tags, got[10].lat) == (["object"], None)


def test_not_packets(spark):
    lines = [None, "", "no packet", "AB1CDE>X", "AB1CDE>X:", "toolongcall>X:>hi", "AB1CDE>X:`mic-e", "AB1CDE>X:Ttelemetry", f"AB1CDE>X:!{AT[:-3]}", f"AB1CDE>X:}}B>Y:}}C>Z:!{AT}>", f"AB1CDE>X:!9903.50N/07201.75W>", "AB1CDE>X:;NAME", "AB1CDE>X:;         *290345z" + AT + ">", "AB1CDE>X:)AB!" + AT, "AB1CDE>X:>" + "x" * 1020, "X:AB1CDE>hm"]
    got = read(spark, *lines)
    assert [r.id for r in got if r.correlation_key is not None] == []
    assert all(r.tags is None and r.source is None for r in got)


@pytest.mark.parametrize(("stamp", "want"), [
    ("010630z", (2024, 3, 1, 6, 30)), ("011829/", (2024, 3, 1, 18, 29)), ("011831z", (2024, 2, 1, 18, 31)), ("310000z", None), ("300000z", None), ("292359z", (2024, 2, 29, 23, 59)),
    ("235959h", (2024, 3, 1, 23, 59, 59)), ("250000h", None), ("12010500", (2024, 12, 1, 5, 0)), ("13010500", (2024, 3, 1, 5, 0)), ("x10630z", None), ("01063", None), (None, None)])
def test_times(spark, stamp, want):
    row = spark.createDataFrame([(stamp,)], "s string").select(packets.stamp_time(F.col("s"), F.lit(US)).alias("t")).first()
    assert row.t == (int(datetime(*want, tzinfo=UTC).timestamp() * 1e6) if want else None)


def test_line_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# server\n\nAB1CDE>X:>hi\n # too\n")
    df = scans.packet_lines(spark, f"{tmp_path}/a.txt")
    assert [r.label for r in packets.tracks(df, "value", F.lit(US), "aprs_is", False).collect()] == ["AB1CDE"]
