"""Modem frames: cut at every byte, stuffed bytes, malformed link layers."""

from pyspark.sql import functions as F

from trackweave.sources import frames


def address(call, number, last=False, relayed=False):
    return bytes(ord(c) << 1 for c in call.ljust(6)) + bytes([0x60 | number << 1 | last | relayed << 7])


def packet(info, *relays, control=b"\x03\xf0", source=("N0CALL", 9)):
    path = address("APRS", 0, relayed=True) + address(*source, last=not relays)
    return path + b"".join(address(call, number, k == len(relays) - 1, relayed) for k, (call, number, relayed) in enumerate(relays)) + control + info


def stuff(body):
    return b"\xc0" + body.replace(b"\xdb", b"\xdb\xdd").replace(b"\xc0", b"\xdb\xdc") + b"\xc0"


LINES = [
    (b"\x00" + packet(b">plain"), "N0CALL-9>APRS:>plain"),
    (b"\x10" + packet(b">a\xc0b\xdbc\xdd", ("WIDE1", 1, True), ("WIDE2", 0, False)), "N0CALL-9>APRS,WIDE1-1*,WIDE2:>a�b�c�"),
    (b"\x00" + packet(b"x", *[("R", k, k < 4) for k in range(1, 9)]), "N0CALL-9>APRS," + ",".join(f"R-{k}" + "*" * (k < 4) for k in range(1, 9)) + ":x"),
    (b"\x00" + packet(b"x", *[("R", k, False) for k in range(1, 10)]), None),  # nine relays
    (b"\xff", None),
    (b"\x06" + packet(b"x"), None),
    (b"\x00" + packet(b"x", control=b"\x00\xf0"), None),
    (b"\x00" + packet(b"x", control=b"\x03\xcf"), None),
    (b"\x00" + packet(b"x", source=("n0call", 9)), None),
    (b"\x00" + address("ALONE", 0, True) + b"\x03\xf0 and more text", None),
    (b"\x00" + packet(b"", control=b"\x03"), None),
    (b"\x00" + packet(b"", control=b""), None),
    (b"\x00" + packet(b""), "N0CALL-9>APRS:"),
    (b"\x00", None),
]


def told(spark, chunks):
    rows = [(name, k, bytearray(c) if c is not None else None) for name, cs in chunks.items() for k, c in enumerate(cs)]
    table = spark.createDataFrame(rows, "name string, seq long, bytes binary").repartition(3)
    ended, rest = frames.kiss_frames(table, "name", "seq", "bytes")
    lines = sorted(ended.select("name", "frame", "seq", "body", frames.packet_line(F.col("body")).alias("line")).collect(), key=lambda r: (r.name or "", r.frame))
    return lines, {r["name"]: r.rest for r in rest.collect()}


def test_lines(spark):
    lines, rest = told(spark, {"a": [b"".join(stuff(body) for body, _ in LINES)]})
    assert [r.line for r in lines] == [line for _, line in LINES] and rest == {}


def test_cut_at_every_byte(spark):
    stream = b"".join(stuff(body) for body, _ in LINES[:2]) + b"\xc0\xc0\x00open"
    chunks = {str(k): [stream[:k], None, b"", stream[k:]] for k in range(len(stream) + 1)}
    chunks["single"] = [stream[k : k + 1] for k in range(len(stream))]
    lines, rest = told(spark, chunks)
    for name in chunks:
        assert [r.line for r in lines if r.name == name] == [line for _, line in LINES[:2]], name
        assert rest[name] == "\x00open"


def test_escapes_and_garbage(spark, monkeypatch):
    table = spark.createDataFrame([(k, b) for k, b in enumerate(["ÛÛÜ", "aÛ", "ÛxÛÝÜ", "ÛÜÛ\n"])], "k int, b string")
    found = dict(table.select("k", frames.unstuffed(F.col("b"))).collect())
    assert found == {0: "ÛÜ", 1: "aÛ", 2: "xÛÜ", 3: "À\n"}
    monkeypatch.setattr(frames, "SLICE", 3)
    good = stuff(LINES[0][0])
    lines, rest = told(spark, {"g": [good, *[b"z" * 900] * 9, good, good[:5], good[5:]], None: [good, good[:9], b"y" * 4097]})
    assert [r.line for r in lines if r.name == "g"] == [LINES[0][1]] * 3 and [r.line for r in lines if r.name is None] == [LINES[0][1]]
    assert rest == {} and told(spark, {"e": []} | {"f": [b""]}) == ([], {})


def test_bytes_are_unstuffed_once(spark):
    """A line looks at some hundred bytes of a frame; its stuffing is taken out once, not for each."""
    plan = spark.createDataFrame([("x",)], "body string").select(frames.packet_line(F.col("body")).alias("line"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 2
