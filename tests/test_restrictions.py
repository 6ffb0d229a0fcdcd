"""Restriction notices: bad vertices, several areas, cancellations, zones, the area test."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from trackweave.sources import restrictions


def area(*points, name="A"):
    shape = "".join(f"<Avx><geoLat>{lat}</geoLat><geoLong>{lon}</geoLong></Avx>" for lon, lat in points)
    return f"<TFRAreaGroup><aseTFRArea><txtName>{name}</txtName><valDistVerUpper>3000</valDistVerUpper><uomDistVerUpper>FT</uomDistVerUpper><codeDistVerUpper>HEI</codeDistVerUpper></aseTFRArea><abdMergedArea>{shape}</abdMergedArea></TFRAreaGroup>"


def notice(*areas, zone="EST", name="<txtLocalName>Big event</txtLocalName>", start="2024-01-05T09:30:00"):
    return f"<?xml version='1.0'?><XNOTAM-Update><Group><Add><Not><NotUid>{name}<dateIssued>2024-01-04T00:00:00</dateIssued></NotUid><dateEffective>{start}</dateEffective><codeTimeZone>{zone}</codeTimeZone><AffLocGroup><txtNameCity>Omaha</txtNameCity><txtNameUSState>NE</txtNameUSState></AffLocGroup><TfrNot><codeType>91.137</codeType>{''.join(areas)}</TfrNot></Not></Add></Group></XNOTAM-Update>"


GOOD = [("96.0W", "41.0N"), ("95.0W", "41.0N"), ("95.0W", "42.0N")]
BAD = [("96.0W", "41.0N"), ("95.0W", "91.0N"), ("95.0W", "42.0N")]


def us(*at):
    return int(datetime(*at, tzinfo=timezone.utc).timestamp() * 1_000_000)


def test_notices(spark):
    docs = {
        "one": notice(area(*GOOD)), "two": notice(area(*GOOD), area(*BAD), area(*GOOD, GOOD[0], name="C"), zone="nowhere"), "bad": notice(area(*BAD)), "flat": notice(area(*GOOD[:2])), "none": notice(name=""),
        "swapped": notice(area(*[(lat, lon) for lon, lat in GOOD])), "offset": notice(area(*GOOD), start="2024-01-05T09:30:00+02:00"), "date": notice(area(*GOOD), start="2024-01-05"), "junk": notice(area(*GOOD), start="soon"),
        "cancel": "<XNOTAM-Update><Group><Cancel><Not/></Cancel></Group></XNOTAM-Update>", "broken": "<XNOTAM-Update><Group>", "empty": "", "null": None,
    }
    table = spark.createDataFrame([(k, x, "VIP", 7) for k, x in docs.items()], "id string, xml string, type string, got long").repartition(3)
    found = {r.id: r for r in restrictions.notices(table, "id", "xml", "type", "got").collect()}
    assert set(found) == set(docs) - {"cancel", "broken", "empty", "null"}
    assert {k for k, r in found.items() if r.kind == "event"} == {"bad", "flat", "none", "swapped"}
    one, two = found["one"], found["two"]
    assert one.rings == [[[-96.0, 41.0], [-95.0, 41.0], [-95.0, 42.0], [-96.0, 41.0]]] and one.label == "Big event" and one.places == ["Omaha, NE"]
    assert one.valid_from_us == us(2024, 1, 5, 14, 30) and one.observed_us == us(2024, 1, 4) and one.valid_until_us is None
    assert two.rings == one.rings * 2 and two.dropped_areas == 1 and [a.name for a in two.areas] == ["A", "C"] and two.areas[0].upper.basis == "HEI"
    assert two.valid_from_us is None and two.effective_local == "2024-01-05T09:30:00" and two.listed == "vip"
    assert found["offset"].valid_from_us == us(2024, 1, 5, 7, 30) and found["date"].valid_from_us == us(2024, 1, 5, 5) and found["junk"].valid_from_us is None
    assert found["bad"].rings is None and found["bad"].dropped_areas == 1 and found["none"].label == "Restriction none: no usable geometry"
    assert restrictions.notices(table.where("false"), "id", "xml", "type", "got").count() == 0


def test_near(spark):
    ring = [[-96.0, 41.0], [-95.0, 41.0], [-95.0, 42.0], [-96.0, 41.0]]
    table = spark.createDataFrame([(1, [ring]), (2, [ring[:1], ring]), (3, []), (4, None)], "k int, rings array<array<array<double>>>")
    told = lambda lon, lat, reach: dict(table.select("k", restrictions.near(F.col("rings"), lon, lat, reach)).collect())
    assert told(-95.2, 41.5, 10.0) == {1: True, 2: True, 3: False, 4: False}
    assert told(-95.8, 41.5, 10.0) == {1: False, 2: False, 3: False, 4: False}
    assert told(-96.05, 41.0, 5_000.0)[1] and not told(-96.05, 41.0, 4_000.0)[1]
