"""Values joined with tables of ranges, by prefixes of their bits.

A range of integers is cut into the fewest aligned blocks, each of which is all values with the same bits above
some level (at most two a level). A value looks up its prefix at each level that some block has. So both sides
meet by equality, and any number of overlapping ranges is an ordinary join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values lie in 0 .. 2 ** BITS - 1; what of a range lies outside is left out.
BITS = 32


def blocks(ranges: DataFrame, low: str, high: str) -> DataFrame:
    """ranges with level and prefix, a row for each block; a range that is null or reversed has none."""
    # the blocks of a level that a range holds are first .. upto - 1; those of them that no block above holds are kept, at the ends
    cut = """
        transform(sequence(0, {bits}), k -> named_struct('k', k, 'first', shiftright(_low + shiftleft(1L, k) - 1, k), 'upto', shiftright(_high + 1, k),
            'first_above', shiftright(_low + shiftleft(2L, k) - 1, k + 1), 'upto_above', shiftright(_high + 1, k + 1)))"""
    kept = """
        flatten(transform(_cut, c -> transform(
            if(c.first >= c.upto, array(),
                if(c.k = {bits} or c.first_above >= c.upto_above, sequence(c.first, c.upto - 1),
                    concat(if(c.first < 2 * c.first_above, array(c.first), array()), if(2 * c.upto_above < c.upto, array(c.upto - 1), array())))),
            p -> named_struct('level', c.k, 'prefix', p))))"""
    most = (1 << BITS) - 1
    named = ranges.withColumns({"_low": F.greatest(F.col(low).cast("long"), F.lit(0).cast("long")), "_high": F.least(F.col(high).cast("long"), F.lit(most).cast("long"))})
    named = named.where(f"`{low}` is not null and `{high}` is not null and _low <= _high")
    found = named.withColumn("_cut", F.expr(cut.format(bits=BITS))).withColumn("_block", F.explode(F.expr(kept.format(bits=BITS))))
    return found.select(*ranges.columns, F.col("_block.level").alias("level"), F.col("_block.prefix").alias("prefix"))


def in_ranges(rows: DataFrame, value: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Each row with each range, low and high included, that holds its value. Columns of the two must have different names."""
    cut = blocks(ranges, low, high)
    levels = sorted(r.level for r in cut.select("level").distinct().collect())  # BITS + 1 at most
    spot = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(F.col(value).cast("long"), n).alias("prefix")) for n in levels]).cast("array<struct<level:int,prefix:bigint>>")
    return rows.withColumn("_p", F.explode(spot)).select(*rows.columns, "_p.*").join(cut, ["level", "prefix"]).drop("level", "prefix")


def in_any(rows: DataFrame, key: str, value: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """(key) of the rows whose value some range holds, once."""
    return in_ranges(rows.select(key, value), value, ranges.select(low, high), low, high).select(key).distinct()
