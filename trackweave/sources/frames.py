"""Byte streams of a radio modem: framing over chunks that are cut anywhere, byte stuffing, link-layer addresses.

Bytes are held as strings of one character a byte (ISO-8859-1), so all of it is Columns.

Defined results: chunks are ordered by `order`, which is unique in a stream; a null chunk is empty. Empty
frames do not exist. A frame that has grown past MAX_OPEN bytes at the end of a chunk without having ended
is garbage and goes whole. A frame that is no data, or whose link layer is malformed, has a null line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values of the framing and of the link layer
END, ESCAPE, ESCAPED_END, ESCAPED_ESCAPE = "À", "Û", "Ü", "Ý"
UNNUMBERED, NO_LAYER_3 = "\u0003", "ð"
ADDRESS_BYTES, MAX_ADDRESSES, MIN_BYTES = 7, 10, 16
CALL_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 "
MAX_OPEN = 4096

#: Orders (numbers) of a stream that are counted as one slice.
SLICE = 100_000
_WIRE = "".join(map(chr, range(256)))
_CALL = "".join(chr(b >> 1) if chr(b >> 1) in CALL_CHARACTERS else "!" for b in range(256))
_MARK = "Ā"  # no byte


def latin(data: Column) -> Column:
    return F.coalesce(F.decode(data, "ISO-8859-1"), F.lit(""))


def once(value: Column, body) -> Column:
    """body(value) with value worked out once a row, though body uses it for many bytes."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kiss_frames(chunks: DataFrame, stream: str, order: str, data: str) -> tuple[DataFrame, DataFrame]:
    """(stream, frame, order, body) of the frames that have ended, and (stream, rest) of what is still open.

    `frame` is a number that rises along the stream, `order` that of the chunk in which it ends, body its bytes
    as a string. Frames inside one chunk are told where the chunk is read. Pieces at a chunk's two ends meet by
    their frame's number, the ends before the chunk, which is counted in slices of the stream.
    """
    cut = chunks.select(F.col(stream).alias("stream"), F.col(order).cast("long").alias("at"), F.split(latin(F.col(data)), END, -1).alias("p"))
    cut = cut.withColumns({"slice": F.floor(F.col("at") / SLICE), "ends": (F.size("p") - 1).cast("long")})
    slices = cut.groupBy("stream", "slice").agg(F.sum("ends").alias("n"))
    upto = Window.partitionBy("stream").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col("stream").alias("s"), F.col("slice").alias("k"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("stream", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.join(slices, F.col("stream").eqNullSafe(F.col("s")) & F.col("slice").eqNullSafe(F.col("k")))
    placed = placed.withColumn("first", F.col("base") + F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    piece = lambda body, i, inner, ends: F.struct((F.col("first") + i).alias("frame"), body.alias("body"), inner.alias("inner"), ends.alias("closes"))
    each = F.transform("p", lambda body, i: piece(body, i, (i > 0) & (i < F.col("ends")), i < F.col("ends")))
    pieces = placed.select("stream", "at", F.explode(each).alias("e")).select("stream", "at", "e.*")
    whole = pieces.where("inner").select("stream", "frame", "at", "body")
    border = pieces.where("not inner")
    held = border.groupBy("stream", "frame").agg(F.coalesce(F.sum(F.when(~F.col("closes"), F.length("body"))), F.lit(0)).alias("open"))
    sound = held.where(F.col("open") <= MAX_OPEN).select(F.col("stream").alias("s"), F.col("frame").alias("f"))
    border = border.join(sound, F.col("stream").eqNullSafe(F.col("s")) & (F.col("frame") == F.col("f")), "left_semi").where("body <> '' or closes")
    joined = border.groupBy("stream", "frame").agg(F.sort_array(F.collect_list(F.struct("at", "body"))).alias("b"), F.max(F.when(F.col("closes"), F.col("at"))).alias("at"))
    joined = joined.select("stream", "frame", "at", F.array_join(F.col("b.body"), "").alias("body"))
    ended = whole.unionByName(joined.where("at is not null")).where("body <> ''")
    rest = joined.where("at is null and body <> ''").select(F.col("stream").alias(stream), F.col("body").alias("rest"))
    return ended.select(F.col("stream").alias(stream), "frame", F.col("at").alias(order), "body"), rest


def unstuffed(body: Column) -> Column:
    """An escape and what follows stand for one byte; one that nothing follows, or nothing known, stands for that itself."""
    marked = F.regexp_replace(body, f"(?s){ESCAPE}(.)", f"{_MARK}$1")
    for after, byte in ((ESCAPED_END, END), (ESCAPED_ESCAPE, ESCAPE), ("", "")):
        marked = F.replace(marked, F.lit(_MARK + after), F.lit(byte))
    return marked


def stuffed(body: Column) -> Column:
    escaped = F.replace(body, F.lit(ESCAPE), F.lit(ESCAPE + ESCAPED_ESCAPE))
    return F.replace(escaped, F.lit(END), F.lit(ESCAPE + ESCAPED_END))


def packet_line(body: Column) -> Column:
    """`SOURCE>DESTINATION,RELAY*:text` of a frame as it came, null if it is none."""
    data = lambda plain: F.ascii(F.substring(plain, 1, 1)) % 16 == 0
    return once(unstuffed(body), lambda plain: F.when((F.length(plain) > 0) & data(plain), once(F.substring(plain, F.lit(2), F.length(plain)), link_line)))


def link_line(link: Column) -> Column:
    """The line of an unnumbered-information packet of the link layer: destination, source, up to eight relays, two fixed bytes, text."""
    byte = lambda at: F.ascii(F.substring(link, at, F.lit(1)))
    start = lambda k: k * ADDRESS_BYTES + 1
    slots = F.sequence(F.lit(0), F.lit(MAX_ADDRESSES - 1))
    return once(F.get(F.filter(slots, lambda k: byte(start(k) + 6) % 2 == 1), F.lit(0)), lambda last: _line(link, last))  # none: null


def _line(link: Column, last: Column) -> Column:
    byte = lambda at: F.ascii(F.substring(link, at, F.lit(1)))
    start = lambda k: k * ADDRESS_BYTES + 1

    def address(k: Column) -> Column:
        call = F.rtrim(F.translate(F.substring(link, start(k), F.lit(6)), _WIRE, _CALL))
        tail = byte(start(k) + 6)
        number = F.floor(tail / 2) % 16
        relayed = F.when((k >= 2) & (tail >= 128), "*").otherwise("")
        return F.concat(call, F.when(number > 0, F.concat(F.lit("-"), number.cast("string"))).otherwise(""), relayed)

    after = (last + 1) * ADDRESS_BYTES + 1
    text = F.regexp_replace(F.substring(link, after + 2, F.length(link)), "[\u0080-ÿ]", "�")
    relays = lambda told: F.array_join(F.transform(F.slice(told, F.lit(3), F.lit(MAX_ADDRESSES)), lambda x: F.concat(F.lit(","), x)), "")
    sound = lambda told: ~F.exists(told, lambda x: F.contains(x, F.lit("!")))
    fits = (F.length(link) >= MIN_BYTES) & (last >= 1) & (F.substring(link, after, F.lit(2)) == UNNUMBERED + NO_LAYER_3)
    joined = lambda told: F.when(sound(told), F.concat(F.get(told, F.lit(1)), F.lit(">"), F.get(told, F.lit(0)), relays(told), F.lit(":"), text))
    return F.when(fits, once(F.transform(F.sequence(F.lit(0), last), address), joined))


def wire_address(call: Column, number: Column, last: bool, relayed: Column | bool = False) -> Column:
    """The seven bytes of an address, as a string."""
    shifted = "".join(chr(ord(c) << 1) for c in CALL_CHARACTERS)
    tail = F.lit(96) + number * 2 + int(last) + F.when(F.lit(relayed) if isinstance(relayed, bool) else relayed, 128).otherwise(0)
    return F.concat(F.translate(F.rpad(call, 6, " "), CALL_CHARACTERS, shifted), F.get(F.lit(list(_WIRE)), tail.cast("int")))
