"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, in which only oversized buckets split.

Bytes are summed once per prefix of `bits` hash bits. A prefix belongs to the bucket of the fewest
bits that fits the limit: wider ones are split on one bit more, others are left alone. `bits` grows
with the volume, so the directory has some entries a shard; documents of prefixes that are still too
large are looked at again with all 32 bits, and only those. What cannot be told apart even then
(identical rows, or one document over the limit) goes into overflow pages, counted in each input
partition by itself, so that no group meets in one task.

Defined results: null text has 0 bytes and a null id hashes as empty. The hash covers id and text, so
rows that share an id still spread. Identical rows share a shard until it is full. Empty texts go
with their hash. An empty table gives an empty one; extra columns are ignored. Every page fits the
limit, except that a single document over it has a page to itself (`oversize`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD_BYTES = 64 << 20
HASH_BITS = 32
#: Bits of the first directory beyond those that shards of just the limit would need.
SPARE_BITS = 6


def row_hash(key: Column, text: Column) -> Column:
    """32 bits of the MD5 of id and text."""
    told = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(told), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(h: Column, bits: Column | int) -> Column:
    by = (F.lit(HASH_BITS) - bits).cast("int") if isinstance(bits, Column) else F.lit(HASH_BITS - bits)
    return F.call_function("shiftright", h, by)


def directory(sizes: DataFrame, least: int, bits: int, limit: int) -> DataFrame:
    """(entry, depth): the bits of the bucket that holds each prefix; null depth: still too large. sizes: (h, bytes) of any rows."""
    entries = sizes.groupBy(prefix(F.col("h"), bits).alias("entry")).agg(F.sum("bytes").alias("bytes"))
    depths = F.explode(F.sequence(F.lit(least), F.lit(bits))).alias("depth")
    levels = entries.select("entry", "bytes", depths).withColumn("bucket", F.expr(f"shiftright(entry, {bits} - depth)"))
    buckets = levels.groupBy("depth", "bucket").agg(F.sum("bytes").alias("held"))
    fits = F.when(F.col("held") <= limit, F.col("depth"))
    return levels.join(buckets, ["depth", "bucket"]).groupBy("entry").agg(F.min(fits).alias("depth"))


def bit_string(h: Column, depth: Column) -> Column:
    return F.substring(F.lpad(F.bin(h), HASH_BITS, "0"), F.lit(1), depth)


def shard(docs: DataFrame, limit: int = SHARD_BYTES, carry: bool = False) -> DataFrame:
    """doc_id, bytes, depth, shard (the bucket's hash prefix in bits; `*` is the undivided table; overflow pages add partition and page), oversize.

    With carry, also `_doc`: the whole row, which no id has to find again."""
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")] if carry else []
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = common.written(docs.select("doc_id", row_hash(F.col("doc_id"), F.col("text")).alias("h"), size.alias("bytes"), F.spark_partition_id().alias("part"), *whole), "shard-rows")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    first = common.written(directory(rows, 0, bits, limit), "shard-directory")
    placed = rows.withColumn("entry", prefix(F.col("h"), bits)).join(common.small(first), "entry").drop("entry")
    done = placed.where(F.col("depth").isNotNull()).withColumn("page", F.lit(None).cast("string"))
    rest = placed.where(F.col("depth").isNull()).drop("depth")
    if first.where(F.col("depth").isNull()).limit(1).count():
        second = common.written(directory(rest, min(bits + 1, HASH_BITS), HASH_BITS, limit), "shard-directory")
        deep = rest.join(common.small(second), rest["h"] == second["entry"]).drop("entry")
        done = done.unionByName(deep.where(F.col("depth").isNotNull()).withColumn("page", F.lit(None).cast("string")))
        alike = Window.partitionBy("h", "part")
        per = F.greatest(F.lit(1), F.lit(limit) / F.max("bytes").over(alike)).cast("long")
        page = F.floor((F.row_number().over(alike.orderBy("doc_id")) - 1) / per)
        over = deep.where(F.col("depth").isNull()).withColumns({"depth": F.lit(HASH_BITS), "page": F.concat(F.lit("-"), F.col("part"), F.lit("-"), page)})
        done = done.unionByName(over)
    name = F.when(F.col("depth") == 0, F.lit("*")).otherwise(bit_string(F.col("h"), F.col("depth")))
    return done.select("doc_id", "bytes", "depth", F.concat(name, F.coalesce("page", F.lit(""))).alias("shard"), (F.col("bytes") > limit).alias("oversize"), *["_doc"] * carry)


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> str:
    """Every row of docs once under path/<column>=.../, one task a shard; null and repeated ids too.

    Returns the column: `shard`, with as many `_` behind it as it takes to be no column of docs."""
    taken, column = {c.lower() for c in docs.columns}, "shard"
    while column in taken:
        column += "_"
    rows = shard(docs, limit, carry=True).select("_doc.*", F.col("shard").alias(column))
    rows.repartition(F.col(column)).write.partitionBy(column).parquet(path)
    return column
