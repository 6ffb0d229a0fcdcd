"""Conversation prefix tries: every prefix of turns that conversations share, with rollups over the subtree below it.

A turn is a 128-bit digest of its role and text, and a prefix is the digest chain of its turns, made in
one pass over the turns of a conversation in order, so a conversation is never held whole. The trie is
cut in two. Prefixes with many members (HEAVY_LEAST, or one in HEAVY_SHARE of all turns, whichever is
more) are the upper levels: as the members of all prefixes sum to the number of turns, there are fewer
than HEAVY_SHARE of them, so they fit one task and a broadcast however large the table is. Each
subtree below them goes whole to a shard, and a shard holds many subtrees. Shards and upper levels are
built alike with numpy, as level-order tries: a LOUDS bitvector (a 1 for each child, then a 0, in
breadth-first order), label arrays beside it, parents by rank and select on the bits, and rollups by
add.at in reverse breadth-first order. Shards hand the sums of their tops to the upper levels.

Defined results: turns are ordered by number (null first), then role, then the digest of role and text,
so ties have an order; repeated rows are repeated turns. Null role or text counts as empty. Rows with a
null id belong to no conversation. A conversation all of whose turns are skipped has none and is a
member of the root alone. An empty table has no nodes. Extra columns are ignored. A conversation's
digests (about 60 bytes a turn) and the members of a light prefix fit one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A prefix with more members than this, and than one in HEAVY_SHARE of all turns, is of the upper levels.
HEAVY_LEAST = 64
HEAVY_SHARE = 100_000
#: Turns that a shard holds about.
SHARD_TURNS = 200_000
#: Conversations take their first turns from the one whose id is theirs without the rest by GROUP, SHARED - 1 at most.
GROUP = 100
SHARED = 6
ROOT = bytes(16)
TURNS = "conv_id long, pos long, digest binary, chars long, own boolean"
CHAIN = "node binary, parent binary, first binary, depth long, conv_id long, chars long, ends boolean"
NODES = "node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def digest(role: Column, text: Column) -> Column:
    """16 bytes that tell a turn from all others."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, n, digest, chars): the turns of each conversation in order, n from 1; written."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest(role, text).alias("digest"), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return common.written(rows.select("conv_id", F.row_number().over(order).cast("long").alias("n"), "digest", "chars"), "turns")


def plain(own: DataFrame) -> DataFrame:
    """Conversations as they are, as TURNS."""
    return own.select("conv_id", F.col("n").alias("pos"), "digest", "chars", F.lit(True).alias("own"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversations that begin with the first turns of their group's first one, as TURNS; pos 0 stands for the conversation itself."""
    ids = own.groupBy("conv_id").agg(F.max("n").alias("n_own")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED)
    base = own.where((F.col("conv_id") % GROUP == 0) & (F.col("n") < SHARED)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("n", "digest", "chars"))).alias("head"))  # SHARED - 1 turns at most
    group = F.col("conv_id") - F.col("conv_id") % GROUP
    headed = ids.join(base, group == base["base"], "left").select("conv_id", F.expr("slice(head, 1, int(h))").alias("head"))
    marks = headed.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("chars"), F.lit(False).alias("own"))
    heads = headed.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.n").alias("pos"), F.col("t.digest").alias("digest"), F.col("t.chars").alias("chars"), F.lit(False).alias("own"))
    rest = plain(own).where(F.col("pos") > F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED)
    return marks.unionByName(heads).unionByName(rest)


def chained(turns: DataFrame) -> DataFrame:
    """TURNS as CHAIN: the node that each turn leads to, its parent, and the node of the conversation's first turn."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # the last row, until it is known whether the conversation goes on
        for batch in batches:
            out: list[list] = []
            for conv, mark, key, chars in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3)), strict=True):
                if held and held[4] == conv:
                    if mark == 0:
                        continue
                    out.append([*held[:6], False])
                    node = hashlib.blake2b(held[0] + key, digest_size=16).digest()
                    held = [node, held[0], held[2] or node, held[3] + 1, conv, chars, True]
                    continue
                if held:
                    out.append(held)
                held = [ROOT, b"", b"", 0, conv, 0, True]
                if mark:
                    out.append([*held[:6], False])
                    node = hashlib.blake2b(ROOT + key, digest_size=16).digest()
                    held = [node, ROOT, node, 1, conv, chars, True]
            if out:
                yield table(out)
        if held:
            yield table([held])

    def table(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["node", "parent", "first", "depth", "conv_id", "chars", "ends"])

    # a mark (pos 0) comes first, then what was taken over, then the conversation's own turns
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "own", "pos")
    return ordered.select("conv_id", F.when(F.col("own"), F.col("pos") + SHARED).otherwise(F.col("pos")).alias("pos"), "digest", "chars").mapInArrow(rows, CHAIN)


def louds(parent: np.ndarray) -> np.ndarray:
    """The bitvector of a trie whose nodes stand in breadth-first order, the children of a node together. parent: of each node, -1 for the tops, which hang below one more root."""
    children = np.bincount(parent + 1, minlength=len(parent) + 1)
    ones = np.zeros(int(children.sum()) + len(children), bool)
    ones[np.arange(len(parent)) + parent + 1] = True  # node i comes after i ones, and after a zero for each node before its parent
    return ones


def parents(bits: np.ndarray) -> np.ndarray:
    """For each node, in breadth-first order: its parent (-1: a top), as the zeros before its 1."""
    return np.flatnonzero(bits) - np.arange(int(bits.sum())) - 1


def levels(parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The steps from each node up to the top of its subtree; parents lie one depth above."""
    out = np.zeros(len(parent), np.int64)
    for level in np.split(by := np.argsort(depth, kind="stable"), np.flatnonzero(np.diff(depth[by])) + 1):
        out[level] = np.where(parent[level] >= 0, out[parent[level]] + 1, 0)
    return out


def rollup(parent: np.ndarray, level: np.ndarray, *sums: np.ndarray) -> None:
    """Adds to each node what its children have, level by level from below; nodes in breadth-first order."""
    edges = [0, *(np.flatnonzero(np.diff(level)) + 1).tolist(), len(level)]
    for a, b in reversed(list(zip(edges, edges[1:], strict=False))):
        inner = np.arange(a, b)[parent[a:b] >= 0]
        for total in sums:
            np.add.at(total, parent[inner], total[inner])


def breadth_first(parent: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, parent's place in the order or -1): nodes level by level, the children of a node together."""
    place = np.full(len(parent), -1)
    order, above, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for nodes in np.split(by := np.argsort(level, kind="stable"), np.flatnonzero(np.diff(level[by])) + 1):
        up = np.where(parent[nodes] >= 0, place[parent[nodes]], -1)
        turn = np.argsort(up, kind="stable")
        place[nodes[turn]] = at + np.arange(len(nodes))
        order.append(nodes[turn])
        above.append(up[turn])
        at += len(nodes)
    return np.concatenate(order), np.concatenate(above)


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def level_order(shard: pa.Table) -> pa.Table:
    """NODES of a shard's CHAIN rows: one row a distinct node. Tops have a null parent_conv_id."""
    conv = _longs(shard["conv_id"].combine_chunks())
    raw = shard["node"].combine_chunks().to_pylist()
    code: dict[bytes, int] = {}
    of = np.fromiter((code.setdefault(x, len(code)) for x in raw), np.int64, len(raw))
    n = len(code)
    firsts = np.full(n, -1)
    firsts[of[::-1]] = np.arange(len(of))[::-1]
    up = shard["parent"].combine_chunks().to_pylist()
    parent_code = np.array([code.get(up[i], -1) for i in firsts], np.int64)
    depth, chars = _longs(shard["depth"].combine_chunks())[firsts], _longs(shard["chars"].combine_chunks())[firsts]
    members = np.bincount(of, minlength=n)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, of, conv)
    ended = shard["ends"].combine_chunks().to_numpy(zero_copy_only=False)
    ends, who = of[ended], conv[ended]
    turn = np.lexsort((who, ends))
    ends, who = ends[turn], who[turn]
    cuts = np.searchsorted(ends, np.arange(n + 1))
    hashes = [hashlib.sha256(",".join(map(str, who[a:b].tolist())).encode()).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]
    level = levels(parent_code, depth)
    order, above = breadth_first(parent_code, level)
    names = list(code)
    zero = np.zeros(n, np.int64)
    counted = _totals(above, level[order], zero, zero, ((members - 1) * chars)[order])
    return _table([names[i] for i in order], [up[firsts[i]] for i in order], above, depth[order], least[order], members[order], *counted, [hashes[i] for i in order])


def _totals(above: np.ndarray, level: np.ndarray, children: np.ndarray, leaves: np.ndarray, saved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n_children, n_leaves, saved_tokens), through the trie's bits; children and leaves: what hangs below nodes besides."""
    up = parents(louds(above))
    children = children + np.bincount(up[up >= 0], minlength=len(up))
    leaves = np.where(children == 0, 1, leaves)
    saved = saved.astype(np.int64)
    rollup(up, level, leaves, saved)
    return children, leaves, saved


def _table(names, ups, above, depth, least, members, children, leaves, saved, hashes) -> pa.Table:
    up_conv = np.where(above >= 0, least[np.maximum(above, 0)], 0) if len(least) else least
    return pa.table({
        "node": pa.array(names, pa.binary()), "parent": pa.array(ups, pa.binary()), "depth": pa.array(depth, pa.int64()), "conv_id": pa.array(least, pa.int64()), "parent_conv_id": pa.array(up_conv, pa.int64(), mask=above < 0),
        "n_convs": pa.array(members, pa.int64()), "n_children": pa.array(children, pa.int64()), "n_leaves": pa.array(leaves, pa.int64()), "saved_tokens": pa.array(saved, pa.int64()), "ends_sha256": pa.array(hashes, pa.string())})


def upper_levels(top: pa.Table) -> pa.Table:
    """NODES of the upper levels, whose rows have the sums of the shards' tops below them (`children`, `leaves`, `saved`)."""
    names, ups = top["node"].to_pylist(), top["parent"].to_pylist()
    code = {x: i for i, x in enumerate(names)}
    depth, least, members, chars = (_longs(top[c].combine_chunks()) for c in ("depth", "conv_id", "n_convs", "chars"))
    parent_code = np.array([code.get(x, -1) for x in ups], np.int64)
    order, above = breadth_first(parent_code, depth)
    hung = [_longs(top[c].combine_chunks())[order] for c in ("children", "leaves", "saved")]
    counted = _totals(above, depth[order], hung[0], hung[1], hung[2] + ((members - 1) * chars)[order])
    hashes = top["ends_sha256"].to_pylist()
    return _table([names[i] for i in order], [ups[i] for i in order], above, depth[order], least[order], members[order], *counted, [hashes[i] for i in order])


def ends_of(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) over (node, conv_id): ids are sorted and joined in ranges first, so no task sorts or holds those of a hot node one by one."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, int, list[str]] | None = None
        for batch in batches:
            out = []
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and held[0] == node and len(held[2]) < 100_000:
                    held[2].append(str(conv))
                    continue
                if held:
                    out.append((held[0], held[1], ",".join(held[2])))
                held = (node, conv, [str(conv)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["node", "least", "ids"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.binary()), pa.array([held[1]], pa.int64()), pa.array([",".join(held[2])])], names=["node", "least", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, total = None, hashlib.sha256()
        for batch in batches:
            out = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key == node:
                    total.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((node, total.hexdigest()))
                node, total = key, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([total.hexdigest()])], names=["node", "ends_sha256"])

    chunks = rows.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(joined, "node binary, least long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "least").select("node", "ids").mapInArrow(hashed, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """NODES without digests, over conversations given as TURNS."""
    spark = turns.sparkSession
    common.importable(spark)
    chain = common.written(chained(turns), "turn-chains")
    n = chain.count()
    limit = max(HEAVY_LEAST, n // HEAVY_SHARE)
    # fewer than HEAVY_SHARE nodes have more members than n // HEAVY_SHARE
    stats = chain.groupBy("node").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"))
    heavy = common.written(stats.where((F.col("n_convs") > limit) | (F.col("node") == F.lit(ROOT))), "upper-levels")
    marked = F.broadcast(heavy.select("node", F.lit(True).alias("heavy")))
    rows = chain.join(marked, "node", "left")
    upper_ends = rows.where("heavy and ends").select("node", "conv_id")
    light = rows.where("heavy is null").drop("heavy")
    # whose first turn is light lies whole below the root; the others go by the first light node on their way
    first_heavy = F.broadcast(heavy.select(F.col("node").alias("first"), F.lit(True).alias("hot")))
    split = light.join(first_heavy, "first", "left")
    way = Window.partitionBy("conv_id")
    deep = split.where("hot").withColumn("top", F.min_by("node", "depth").over(way))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_TURNS))
    sharded = split.where("hot is null").withColumn("top", F.col("first")).unionByName(deep).withColumn("shard", F.pmod(F.xxhash64("top"), F.lit(shards)))
    below = common.written(sharded.select("shard", "node", "parent", "depth", "conv_id", "chars", "ends").groupBy("shard").applyInArrow(level_order, NODES), "trie-shards")
    tops = below.where("parent_conv_id is null")
    sums = tops.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    none = F.sha2(F.lit(""), 256)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    upper = heavy.join(sums, "node", "left").join(ends_of(upper_ends), "node", "left").select("node", "parent", "depth", "conv_id", "n_convs", "chars", zero("children"), zero("leaves"), zero("saved"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
    above = common.written(upper.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: upper_levels(t), NODES), "trie-top")
    ids = F.broadcast(above.select(F.col("node").alias("parent"), F.col("conv_id").alias("upper_conv_id")))
    out = below.join(ids, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "upper_conv_id")).drop("upper_conv_id").unionByName(above)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_report(turns: DataFrame) -> DataFrame:
    """prefix_trie() of the rebuilt conversations."""
    return prefix_trie(rebuilt(numbered(turns)))
