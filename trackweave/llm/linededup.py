"""Line dedup across documents by a segment-partition edit join.

Of equal lines with a word, the first occurrence stays (by document id, then line number), however short
they are. It goes too if a near line first occurs earlier. How many edits are near grows with the length
of the shorter line, by LADDER; under its first step, only equal lines count. Lines without a word stay.

The join: a line of k allowed edits is cut into k + 1 segments. k edits leave one of them whole, with no
more edits left of it than its number and no more right of it than the segments there, so two near lines
share a segment, up to a shift that this bounds. Each distinct line is indexed by its segments, and probes
the indexes of its own and of the k lesser lengths with the substrings that can match; keys are hashes of
length, segment number and substring. Where more than HOT lines are indexed by one key, they are first held
against its earliest line, and keys whose lines are all decided are done. The segment is cut out of the lines
of the others, and what remains, which is still within the edits, is joined in the same way, level by level.
Near is always told from whole lines. What is hot after LEVELS levels is compared in blocks of
bounded size: no pair becomes a row, but the work grows with the square of the lines that differ only in
the little that remains and are yet too far from the earliest.
Candidates whose character counts differ in parity on more than 2 k of 64 bits cannot be within k edits and go;
the others are verified by an edit distance within a band of 2 k + 1 diagonals, kept as bit vectors
that move down one row a column. All of it is built-in functions.

Distinct lines are pre-aggregated to numbers: texts of lines are read again for the candidates only. Whole texts
are shuffled once, to meet the numbers of their removed lines; these grow with the input and are never broadcast.

Defined results: null text counts as one empty line and stays null. Repeated rows of one id and text
are one document, cleaned alike. Ties of first occurrences (an id with several texts) go to the lower
line hash. Null ids come first. A document may lose all lines; its text is then empty. An empty table
gives an empty one. Extra columns are ignored by the report and kept by the filter. Lines are told apart
by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (characters, edits): from so many characters on, lines are near within so many edits; ascending.
LADDER = ((40, 1), (100, 2))
Ladder = tuple[tuple[int, int], ...]
#: A key that indexes more lines than this is hot.
HOT = 16
#: How often what remains of hot lines is cut again, and the size of the blocks that are compared then.
LEVELS = 3
BLOCK = 64
WORD = "[^ \\t-\\r]"


def steps(ladder: Ladder) -> list[tuple[int, int | None, int]]:
    """(least length, length above, edits) of each step."""
    above = [low for low, _ in ladder[1:]]
    return [(low, high, edits) for (low, edits), high in zip(ladder, [*above, None], strict=True) if edits]


def on_step(length: Column, low: int, high: int | None) -> Column:
    return (length >= low) & (length < high) if high else length >= low


def allowed(length: Column, ladder: Ladder) -> Column:
    return reduce(lambda held, step: F.when(length >= step[0], step[1]).otherwise(held), ladder, F.lit(0))


def share(length: Column, edits: int) -> Column:
    """The length of each of the edits + 1 equal segments of a line of this length; up to edits characters at its end are in none."""
    return F.coalesce(F.call_function("div", length, F.lit(edits + 1)), F.lit(0)).cast("int")


def places(size: Column, edits: int, less: int, own: bool) -> list[tuple[int, Column, Column]]:
    """(segment, start, length) of what a text's keys are made of: its own segments, or the substrings that may match segments of a text shorter by less. size: that text's share."""
    shifts = lambda i: [0] if own else range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)
    return [(i, (size * i if i else F.lit(0)) + shift, size) for i in range(edits + 1) for shift in shifts(i)]


def base(length: Column) -> Column:
    return F.shiftleft(length.cast("long"), 16)


def key_of(text: Column, base: Column, edits: int, less: int, place: tuple[int, Column, Column], *salt: Column) -> Column:
    i, start, size = place
    # one number for the indexed length, edits and segment
    return F.xxhash64(base + F.lit((edits << 8) + i - (less << 16)).cast("long"), F.substring(text, start + 1, size), *salt)


def spots(text: Column, length: Column, edits: int, less: int, own: bool, *salt: Column) -> Column:
    """The keys of a text, as structs (key, own, less, edits, start, size)."""
    named = lambda p: (key_of(text, base(length), edits, less, p, *salt).alias("key"), F.lit(own).alias("own"), F.lit(less).alias("less"), F.lit(edits).alias("edits"), p[1].alias("start"), p[2].alias("size"))
    return F.array(*[F.struct(*named(p)) for p in places(share(length - less, edits), edits, less, own)])


def line_parts(length: Column, ladder: Ladder, own: bool) -> list[tuple[Column, int, int]]:
    """(whether the line has such keys, edits, less) of all keys of a line as an index (own) or as a probe."""
    return [(on_step(length, low + less, high and high + less), edits, less) for low, high, edits in steps(ladder) for less in ([0] if own else range(edits + 1))]


def line_spots(line: Column, length: Column, ladder: Ladder, own: bool) -> Column:
    none = F.array().cast("array<struct<key: bigint, own: boolean, less: int, edits: int, start: int, size: int>>")
    return F.concat(none, *[F.when(on, spots(line, length, edits, less, own)).otherwise(none) for on, edits, less in line_parts(length, ladder, own)])


def with_keys(lines: DataFrame, ladder: Ladder) -> DataFrame:
    """lines (line, size) with k and p: the keys of line_spots alone, as index and as probe.

    Plain expressions over shares that are columns: the code of all keys of a line has to stay under the size that the JVM compiles."""
    line, size = F.col("line"), F.col("size")
    shares = {(edits, less): f"_share_{edits}_{less}" for _, edits, less in line_parts(size, ladder, False)}
    held = lines.withColumns({"_base": base(size), **{name: share(size - less, edits) for (edits, less), name in shares.items()}})
    none = F.array().cast("array<bigint>")

    def keys(own: bool) -> Column:
        each = lambda edits, less: F.array(*[key_of(line, F.col("_base"), edits, less, p) for p in places(F.col(shares[edits, less]), edits, less, own)])
        return F.concat(none, *[F.when(on, each(edits, less)).otherwise(none) for on, edits, less in line_parts(size, ladder, own)])

    return held.withColumns({"k": keys(True), "p": keys(False)}).drop("_base", *shares.values())


def signature(line: Column) -> Column:
    """64 bits: the parity of how many characters fall on each. An edit changes two at most."""
    chars = F.filter(F.split(line, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda s, c: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c).bitwiseAND(F.lit(63)))))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether b, which is as long as a or at most edits longer, is within edits of a.

    Bit k of column j stands for row j - edits + k. Rows up to 0 are virtual with distance j - i; rows after a's end match nothing."""
    width = 2 * edits + 1
    full = (1 << width) - 1
    pad = lambda n: F.array_repeat(F.lit("").cast("string"), n)
    gap = F.length(b) - F.length(a)
    rows = F.concat(pad(edits), F.split(a, ""), pad(width + edits))

    def equal(rows: Column) -> Column:
        # a split by "" may end in an empty string, which no character equals
        masks = lambda c, j: reduce(lambda x, y: x + y, [F.when(F.get(rows, j + k) == c, 1 << k).otherwise(0) for k in range(width)])
        return F.transform(F.filter(F.split(b, ""), lambda c: c != ""), masks)

    def step(s: Column, x: Column) -> Column:
        vp, vn = s["vp"], s["vn"]
        d0 = (((x.bitwiseAND(vp)) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full))

        def rest(d: Column) -> Column:
            hp = vn.bitwiseOR(F.lit(full).bitwiseXOR(d.bitwiseOR(vp)))
            hn = d.bitwiseAND(vp)
            down = F.shiftright(d, 1)
            new_vp = hn.bitwiseOR(F.lit(full).bitwiseXOR(down.bitwiseOR(hp)))
            new_vn = down.bitwiseAND(hp)
            return F.struct(new_vp.alias("vp"), new_vn.alias("vn"), (s["d"] + 1 - F.shiftright(d, width - 1)).alias("d"))

        return common.let(d0, rest)

    start = F.struct(F.lit(full ^ ((1 << edits) - 1)).alias("vp"), F.lit((1 << edits) - 1).alias("vn"), F.lit(edits).alias("d"))
    low = F.lit((1 << 2 * edits) - 1)  # the rows of the last column, without the one below the band

    def end(s: Column) -> Column:
        count = lambda v: F.bit_count(v.bitwiseAND(low).bitwiseAND(F.call_function("shiftleft", F.lit(full), F.lit(edits) - gap)))
        return s["d"] - count(s["vp"]) + count(s["vn"])

    return (F.length(b) <= edits) | (F.aggregate(common.let(rows, equal), start, step, end) <= edits)


def may_be_near(a: Column, b: Column, edits: Column) -> Column:
    """False only for signatures of lines that are not within these edits."""
    return F.bit_count(a.bitwiseXOR(b)) <= 2 * edits


def near(a: Column, b: Column, signs: tuple[Column, Column], edits: Column, ladder: Ladder) -> Column:
    """within(a, b) of the allowed edits, which are a column with values of the ladder; b is the longer one. signs: their signatures."""
    found = F.lit(False)
    for k in sorted({k for _, _, k in steps(ladder)}):
        found = F.when(edits == k, (F.length(b) - F.length(a) <= k) & within(a, b, k)).otherwise(found)
    return may_be_near(*signs, edits) & found


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, line, lh, size) of every line with a word."""
    each = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return each.where(F.col("line").rlike(WORD)).select("doc_id", "th", "pos", "line", F.xxhash64("line").alias("lh"), F.length("line").alias("size"))


def texts_of(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(lh, line, size) of the lines of at least so many characters whose hashes are wanted (w), each once; read from the documents again."""
    found = occurrences(docs).where(F.col("size") >= least).select("lh", "line", "size")
    return found.join(common.small(wanted), found["lh"] == wanted["w"], "left_semi").dropDuplicates(["lh"])


def order(end: str = "") -> Column:
    """What decides which of two lines occurs first."""
    return F.struct(F.col(f"first{end}"), F.col(f"lh{end}"))


def hot_keys(keys: DataFrame) -> DataFrame:
    """(hot) of the keys that index more than HOT lines; written. keys: key, own."""
    counts = keys.where("own").groupBy("key").agg(F.count("*").alias("n"))
    return common.written(counts.where(F.col("n") > HOT).select(F.col("key").alias("hot")), "hot-segments")


def cool_pairs(keys: DataFrame, hot: DataFrame) -> DataFrame:
    """(a, b) of the lines that meet in keys that are not hot: index and probe. Two lines that one key indexes meet once; no line need probe a key that indexes it."""
    cool = keys.where("own").join(common.small(hot), F.col("key") == F.col("hot"), "left_anti").select("key", F.col("lh").alias("a"))
    return cool.join(keys.select("key", F.col("lh").alias("b"), "own"), "key").where("a < b or not own and a != b").select("a", "b").distinct()


def cool_rest_pairs(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(a, b) as of cool_pairs, of rows of finer(): of lines of one length, the one of the lower hash as index is enough, and lines whose signatures are too far apart do not meet."""
    cool = rows.where("own").join(common.small(hot), F.col("key") == F.col("hot"), "left_anti").select("key", F.col("lh").alias("a"), F.col("sign").alias("sign_a"))
    probe = rows.where("not own").select("key", F.col("lh").alias("b"), F.col("sign").alias("sign_b"), "less", "edits")
    met = cool.join(probe, "key").where(F.expr("a < b or less > 0 and a != b") & may_be_near(F.col("sign_a"), F.col("sign_b"), F.col("edits")))
    return met.select("a", "b").distinct()


def without(text: Column, start: Column, size: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), start), F.substring(text, start + size + 1, F.length(text)))


def finer(rows: DataFrame, ladder: Ladder) -> DataFrame:
    """What remains of each row, by the keys of its segments, without that segment. rows: key, lh, first, edits, less, own, rest, line, sign."""
    rest, size = F.col("rest"), F.length("rest")
    found = F.lit(None)
    for edits in sorted({k for _, _, k in steps(ladder)}):
        here = F.col("edits") == edits
        found = F.when(here & F.col("own"), spots(rest, size, edits, 0, True, F.col("key"))).otherwise(found)
        for less in range(edits + 1):
            found = F.when(here & ~F.col("own") & (F.col("less") == less), spots(rest, size, edits, less, False, F.col("key"))).otherwise(found)
    each = rows.select("lh", "first", "edits", "less", "own", "rest", "line", "sign", F.explode(found).alias("s"))
    return each.select(F.col("s.key").alias("key"), "lh", "first", "edits", "less", "own", without(rest, F.col("s.start"), F.col("s.size")).alias("rest"), "line", "sign")


def later_of(met: DataFrame) -> DataFrame:
    return met.select(F.when(order() > order("_c"), F.col("lh")).otherwise(F.col("lh_c")).alias("lh")).distinct()


def centered(rows: DataFrame, ladder: Ladder) -> DataFrame:
    """(lh) of lines near the earliest line that their key indexes, or probes with greater length, if that is earlier; and of that line if it is the later one. Written."""
    held = ("first", "lh", "line", "sign")
    first = lambda df, *by: df.groupBy(*by).agg(F.min(F.struct(*held)).alias("c")).select(*[F.col(k).alias(f"{k}_c") for k in by], *[F.col(f"c.{c}").alias(f"{c}_c") for c in held])
    index, probe = rows.where("own"), rows.where("not own")
    one = common.small(common.written(first(index, "key"), "centers"))
    two = common.small(common.written(first(probe.where("less > 0"), "key", "less").drop("less_c"), "centers"))
    same = (F.col("key") == F.col("key_c")) & (F.col("lh") != F.col("lh_c"))
    signs = F.col("sign"), F.col("sign_c")
    up = probe.join(one, same).where(near(F.col("line_c"), F.col("line"), signs, F.col("edits"), ladder))
    down = index.join(two, same).where(near(F.col("line"), F.col("line_c"), signs, F.col("edits"), ladder))
    return common.written(later_of(up).unionByName(later_of(down)).distinct(), "near-lines")


def undecided(rows: DataFrame, late: DataFrame) -> DataFrame:
    """The rows of each key that may still show that a line of it is late: such a line has earlier ones on the other side."""
    flagged = rows.join(common.small(late.select(F.col("lh").alias("late"))), F.col("lh") == F.col("late"), "left")
    least = lambda own: F.min(F.when(F.col("own") == own, order()))
    starts = common.written(rows.groupBy("key").agg(least(True).alias("index_first"), least(False).alias("probe_first")).withColumnRenamed("key", "k"), "key-starts")
    before = F.when(F.col("own"), F.col("probe_first")).otherwise(F.col("index_first"))
    flagged = flagged.join(common.small(starts), F.col("key") == F.col("k")).withColumn("open", F.col("late").isNull() & F.coalesce(before < order(), F.lit(False)))
    flagged = common.written(flagged.select(*rows.columns, "open"), "flagged-rows")
    sides = flagged.where("open").groupBy(F.col("key").alias("k")).agg(F.max("own").alias("index_open"), F.max(~F.col("own")).alias("probe_open"))
    kept = flagged.join(common.small(common.written(sides, "open-keys")), F.col("key") == F.col("k"))
    return kept.where(F.col("open") | F.when(F.col("own"), F.col("probe_open")).otherwise(F.col("index_open"))).select(*rows.columns)


def in_blocks(rows: DataFrame, ladder: Ladder) -> DataFrame:
    """(lh) of the later line of each near pair of a key, compared block by block."""
    counts = common.written(rows.groupBy(F.col("key").alias("k")).agg(F.greatest(F.count_if("own"), F.count_if(~F.col("own"))).alias("n")), "key-sizes")
    dealt = rows.join(common.small(counts), F.col("key") == F.col("k")).withColumn("block", F.pmod(F.xxhash64("lh"), F.ceil(F.col("n") / BLOCK)))
    held = F.collect_set(F.struct("first", "lh", "line", "sign"))
    index = dealt.where("own").groupBy("key", "edits", "block").agg(held.alias("xs")).select("key", "edits", "xs")
    probe = dealt.where("not own").groupBy(F.col("key").alias("k"), "block").agg(held.alias("ys")).select("k", "ys")
    met = index.join(probe, F.col("key") == F.col("k"))
    lies = lambda x, y: (x["lh"] != y["lh"]) & near(x["line"], y["line"], (x["sign"], y["sign"]), F.col("edits"), ladder)
    when = lambda x: F.struct(x["first"], x["lh"])
    late = F.concat(
        F.filter("ys", lambda y: F.exists("xs", lambda x: (when(x) < when(y)) & lies(x, y))),
        F.filter("xs", lambda x: F.exists("ys", lambda y: (when(y) < when(x)) & lies(x, y))))
    return met.select(F.explode(F.transform(late, lambda z: z["lh"])).alias("lh")).distinct()


def near_lines(docs: DataFrame, lines: DataFrame, ladder: Ladder) -> DataFrame:
    """(lh) of the lines that are near an earlier one; written. lines: (lh, first, k: index keys, p: probe keys that are not among them)."""
    side = lambda c, own: lines.select("lh", F.explode(c).alias("key")).withColumn("own", F.lit(own))
    keys = side("k", True).unionByName(side("p", False))
    least, line, size = ladder[0][0], F.col("line"), F.col("size")
    hot = hot_keys(keys)
    pairs, late = [common.written(cool_pairs(keys, hot), "line-pairs")], []
    if hot.limit(1).count():
        warm = common.written(keys.join(common.small(hot), F.col("key") == F.col("hot"), "left_semi").select(F.col("lh").alias("w")).distinct(), "hot-lines")
        each = texts_of(docs, warm, least).join(lines.select("lh", "first"), "lh").withColumn("sign", signature(line))
        each = each.select("lh", "first", "line", "sign", F.explode(F.concat(line_spots(line, size, ladder, True), line_spots(line, size, ladder, False))).alias("s"))
        rows = each.join(common.small(hot), F.col("s.key") == F.col("hot"), "left_semi")
        rows = rows.select("s.key", "lh", "first", "s.edits", "s.less", "s.own", without(line, F.col("s.start"), F.col("s.size")).alias("rest"), "line", "sign")
        rows = common.written(rows, "hot-segment-rows")
        for _ in range(LEVELS):
            late.append(centered(rows, ladder))
            rows = common.written(finer(undecided(rows, late[-1]), ladder), "finer-segments")
            hot = hot_keys(rows)
            pairs.append(common.written(cool_rest_pairs(rows, hot), "line-pairs"))
            if not hot.limit(1).count():
                break
            rows = common.written(rows.join(common.small(hot), F.col("key") == F.col("hot"), "left_semi"), "hot-segment-rows")
        else:
            late.append(centered(rows, ladder))
            late.append(common.written(in_blocks(undecided(rows, late[-1]), ladder), "near-lines"))
    met = reduce(DataFrame.unionByName, pairs).distinct()
    wanted = common.written(met.select(F.explode(F.array("a", "b")).alias("w")).distinct(), "wanted-lines")
    texts = texts_of(docs, wanted, least).join(lines.select("lh", "first"), "lh")
    texts = common.written(texts.select("lh", "first", "line", signature(line).alias("sign")), "line-texts")
    a = texts.select(F.col("lh").alias("a"), "lh", "first", "line", "sign")
    b = texts.select(F.col("lh").alias("b"), *[F.col(c).alias(f"{c}_c") for c in ("lh", "first", "line", "sign")])
    longer = F.length("line_c") - F.length("line")
    both = met.join(a, "a").join(b, "b").where((longer > 0) | (longer == 0) & (F.col("a") < F.col("b")))
    edits = allowed(F.length("line"), ladder)
    late.append(later_of(both.where(near(line, F.col("line_c"), (F.col("sign"), F.col("sign_c")), edits, ladder))))
    return common.written(reduce(DataFrame.unionByName, late).distinct(), "near-lines")


def removed_lines(docs: DataFrame, ladder: Ladder = LADDER) -> DataFrame:
    """(doc_id, th, gone): the line numbers that go, of the documents that lose any; written."""
    found = occurrences(docs)
    place = F.struct("doc_id", "pos")
    lines = found.select("lh", place.alias("place"), "line").groupBy("lh").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.first("line").alias("line"))
    lines = common.written(with_keys(lines.withColumn("size", F.length("line")), ladder).select("lh", "first", "last", "k", F.array_except("p", "k").alias("p")), "lines")
    later = near_lines(docs, lines, ladder).withColumn("late", F.lit(True))
    listed = lines.join(later, "lh", "left").where("late or first != last").select(F.col("lh").alias("bad"), "first", F.coalesce("late", F.lit(False)).alias("late"))
    listed = common.written(listed, "repeated-lines")
    spots = found.select("doc_id", "th", "pos", "lh", place.alias("place")).join(common.small(listed), F.col("lh") == F.col("bad"))
    gone = spots.where(F.col("late") | (F.col("place") != F.col("first")) | F.col("doc_id").isNull() & ~F.col("place").eqNullSafe(F.col("first")))
    gone = gone.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))
    return common.written(gone.withColumnsRenamed({"doc_id": "k_id", "th": "k_th"}), "removed-lines")


def cleaned(text: Column, gone: Column) -> Column:
    """text without the lines numbered in gone (null: all stay): the runs of lines between those that go, in one pass however many go."""

    def kept(s: Column) -> Column:
        run = lambda end, i: F.slice(s["lines"], F.element_at(s["ends"], i + 1) + 2, end - F.element_at(s["ends"], i + 1) - 1)
        return F.array_join(F.flatten(F.transform(F.slice(s["ends"], F.lit(2), F.size(s["ends"]) - 1), run)), "\n")

    lines = F.split(text, "\n")
    ends = common.let(lines, lambda held: F.struct(held.alias("lines"), F.concat(F.array(F.lit(-1)), F.array_sort(gone), F.array(F.size(held))).alias("ends")))
    return F.when(gone.isNull(), text).otherwise(common.let(ends, kept))


def line_dedup(docs: DataFrame, ladder: Ladder = LADDER) -> DataFrame:
    """docs with cleaned texts, and n_chars counted anew if there is such a column."""
    gone = removed_lines(docs, ladder).hint("merge")
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")).join(gone, F.col("_doc.doc_id").eqNullSafe(F.col("k_id")) & (F.xxhash64(F.col("_doc.text")) == F.col("k_th")), "left")
    both = both.select("_doc", cleaned(F.col("_doc.text"), F.col("gone")).alias("_new"))
    kinds = dict(docs.dtypes)
    new = {"text": F.col("_new"), "n_chars": F.length("_new").cast(kinds.get("n_chars", "long"))}
    return both.select(*[new[c].alias(c) if c in new else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def line_dedup_report(docs: DataFrame, ladder: Ladder = LADDER) -> DataFrame:
    """doc_id, n_lines, n_removed, text_sha256 (of the cleaned text; null text: of the empty one)."""
    gone = removed_lines(docs, ladder).hint("merge")
    both = docs.select("doc_id", "text").join(gone, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.xxhash64("text") == F.col("k_th")), "left")
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    text = F.coalesce(cleaned(F.col("text"), F.col("gone")), F.lit(""))
    return both.select("doc_id", n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(text, 256).alias("text_sha256"))
