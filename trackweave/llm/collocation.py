"""Phrase collocations: runs of two or three words that occur together more often than their parts do.

Each task grows count tries of its own share of the texts, one level a pass: words, then pairs, then
triples. A node of the next level is grown only where its prefix and its suffix (the node that its
suffix link leads to) occur LEAST times in the whole corpus, for else it can't either. A trie is
serialised as rows sorted by its path, in the shared folder; the tries of all tasks are dealt by ranges
of the path and merged there, equal paths adding up. Left parts of a phrase are found on the way down
the trie (its prefixes), right parts by its suffix links.

Words are 64-bit hashes of language and word on the way; the words of the result come from the table
of words. What occurs LEAST times is told to the tasks as a bitmap of at most BITS bits: a wrong 1
only costs work, and counts are never taken from it.

Defined results: null or empty texts have no words; a null language is `und`. Repeated rows count
again, so repeated ids do. Ties of cuts and of ranks are those of the contract: the smaller cut; more
occurrences, then the phrase by its UTF-8 bytes. Empty tables have no phrases. Extra columns are
ignored. A text or a word of any length goes whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, ragged

LEAST = 10
#: Of a shorter phrase that a longer one has in it, in percent.
COVERED = 50
UNIT = 1_000_000
TOP = 2000
#: Bytes of text of one language whose words are counted at once; words that a trie holds before it is serialised.
TEXT_BYTES = 4 << 20
TRIE_WORDS = 2_000_000
#: Bits of a bitmap at most (64 MB); a smaller one has 32 for each node.
BITS = 1 << 29

BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORDS = ~BREAKS
WORDS[[0x20, 0x09]] = False
WORD = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+")


def salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "replace"), digest_size=8).digest(), "little"))


class Pieces:
    """Words of texts of one language, in order: hashes, and the number of the piece that each lies in."""

    def __init__(self) -> None:
        self.texts: list[bytes] = []
        self.size = 0

    def add(self, text: str | None) -> None:
        if text:
            data = text.encode("utf-8", "replace").lower()  # bytes.lower() changes A-Z alone
            self.texts.append(data)
            self.size += len(data) + 1

    def take(self, lang: str) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, np.ndarray]]]:
        """(hash, piece) of all words, and blocks (bytes, starts of words). Clears what was added."""
        data = b"\n".join(self.texts)
        self.texts, self.size = [], 0
        hashes, pieces, blocks, before = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], 0
        for part in ragged._cuts(data, WORDS):
            found, starts = ragged._block(part, WORDS)
            breaks = np.cumsum(BREAKS[np.frombuffer(part, np.uint8)])
            hashes.append(ragged.mix(found + salt(lang)))
            pieces.append(breaks[starts] + before)
            blocks.append((part, starts))
            before += int(breaks[-1]) if len(breaks) else 0
        return np.concatenate(hashes), np.concatenate(pieces), blocks


def shares(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, Pieces]]:
    """The texts of a task by language, a language each time that it has `size` bytes, and what is left at the end."""
    held: dict[str, Pieces] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = held.setdefault(lang, Pieces())
            own.add(text)
            if own.size >= size:
                yield lang, own
        if len(held) > 1000:  # many languages: none is held for long
            yield from held.items()
            held = {}
    yield from held.items()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, w, f): the first level of the trie, written."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own in shares(batches, TEXT_BYTES):
            hashes, _, blocks = own.take(lang)
            if not len(hashes):
                continue
            keys, first, counts = np.unique(hashes, return_index=True, return_counts=True)
            block = np.searchsorted(ends := np.cumsum([len(s) for _, s in blocks]), first, side="right")
            begin = np.r_[0, ends[:-1]]
            words = [WORD.match(blocks[b][0], int(blocks[b][1][i - begin[b]]))[0].decode("utf-8", "replace") for b, i in zip(block, first, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "word", "w", "f"])

    found = docs.mapInArrow(rows, "lang string, word string, w long, f long")
    return common.written(found.groupBy("lang", "word", "w").agg(F.sum("f").alias("f")), "trie-words")


def alive(nodes: DataFrame, bit: Column) -> np.ndarray:
    """A bitmap of nodes by `bit` (spread evenly over 64 bits), of a size that fits their number, up to BITS."""
    n = nodes.count()
    bits = 1 << 16
    while bits < min(32 * n, BITS):
        bits *= 2
    at = nodes.select(bit.bitwiseAND(F.lit(bits - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    for batch in words.toArrow().to_batches():  # BITS / 64 rows at most
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def has(bitmap: np.ndarray, spot: np.ndarray) -> np.ndarray:
    spot = spot & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap.view(np.uint64)[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1


def pair_spot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << np.uint64(1)) ^ (b >> np.uint64(3))


def pair_bit() -> Column:
    """pair_spot() of the columns w1 and w2."""
    return F.shiftleft("w1", 1).bitwiseXOR(F.shiftrightunsigned("w2", 3))


def grown(words: np.ndarray, pieces: np.ndarray, level: int, word_bits: np.ndarray, pair_bits: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted paths of a trie's nodes of `level` (2 or 3) and their counts, from words in order."""
    keys, code = np.unique(words, return_inverse=True)
    living = has(word_bits, keys)[code]
    pair = (pieces[1:] == pieces[:-1]) & living[1:] & living[:-1]
    if level == 2:
        at = np.flatnonzero(pair)
        node, n = np.unique(code[at] * len(keys) + code[at + 1], return_counts=True)
        return [keys[node // len(keys)], keys[node % len(keys)]], n
    pair[pair] = has(pair_bits, pair_spot(words[:-1][pair], words[1:][pair]))
    at = np.flatnonzero(pair[1:] & pair[:-1])
    used, code = np.unique(np.concatenate([code[at], code[at + 1], code[at + 2]]), return_inverse=True)
    first, second, third = np.split(code.reshape(-1), 3)
    size = max(1, len(used))  # of TRIE_WORDS words, so that a path of three fits 63 bits while under 2^21 are different
    if size >= 1 << 21:
        path, n = np.unique(np.stack([first, second, third], 1), axis=0, return_counts=True)
        return [keys[used[path[:, k]]] for k in range(3)], n
    node, n = np.unique((first * size + second) * size + third, return_counts=True)
    return [keys[used[node // size // size]], keys[used[node // size % size]], keys[used[node % size]]], n


def merged_level(docs: DataFrame, level: int, word_bits: np.ndarray, pair_bits: np.ndarray | None = None) -> DataFrame:
    """(w1, .., w<level>, f): nodes of a level that occur LEAST times, over the tries of all tasks; written."""
    context = docs.sparkSession.sparkContext
    told_words, told_pairs = context.broadcast(word_bits), context.broadcast(pair_bits)
    names = [f"w{k + 1}" for k in range(level)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = last = 0

        def serialised() -> pa.RecordBatch:
            path, n = grown(np.concatenate([w for w, _ in held]), np.concatenate([p for _, p in held]), level, told_words.value, told_pairs.value)
            return pa.RecordBatch.from_arrays([*(pa.array(w.view(np.int64)) for w in path), pa.array(n, pa.int64())], names=[*names, "n"])

        for lang, own in shares(batches, TEXT_BYTES):
            words, pieces, _ = own.take(lang)
            if len(words):
                held.append((words, pieces + last))
                last += int(pieces[-1]) + 1
                size += len(words)
            if size >= TRIE_WORDS:
                yield serialised()
                held, size = [], 0
        if held:
            yield serialised()

    tries = common.written(docs.mapInArrow(rows, ", ".join(f"{c} long" for c in [*names, "n"])), f"tries-{level}")
    ranges = tries.repartitionByRange(*names)
    return common.written(ranges.groupBy(*names).agg(F.sum("n").alias("f")).where(f"f >= {LEAST}"), f"trie-level-{level}")


def score(a: str, left: str, right: str) -> Column:
    """floor(UNIT * a * a / (left * right)) in decimals, which hold more than 64 bits."""
    d = lambda c: f"cast({c} as decimal(15, 0))"
    return F.expr(f"(cast({d(a)} * {d(a)} as decimal(31, 0)) * {UNIT}BD) div ({d(left)} * {d(right)})")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases."""
    spark = docs.sparkSession
    common.importable(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    words = word_counts(texts)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = common.written(words.where(f"f >= {LEAST}"), "frequent-words")
    word_bits = alive(frequent, F.col("w"))
    pairs = merged_level(texts, 2, word_bits)
    pair_bits = alive(pairs, pair_bit())
    triples = merged_level(texts, 3, word_bits, pair_bits)

    # a word that no phrase has isn't looked up
    used = reduce(DataFrame.unionByName, [pairs.select(F.col(c).alias("w")) for c in ("w1", "w2")]).distinct()
    known = common.written(frequent.join(used, "w", "left_semi"), "phrase-words")
    word = lambda k: common.small(known.select(F.col("w").alias(f"w{k}"), F.col("lang").alias(f"lang{k}"), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}")))
    part = lambda a, b: common.small(pairs.select(F.col("w1").alias(f"w{a}"), F.col("w2").alias(f"w{b}"), F.col("f").alias(f"f{a}{b}")))

    covered = triples.select(F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "f").groupBy("p.w1", "p.w2").agg(F.max("f").alias("longest"))
    two = pairs.withColumnRenamed("f", "a").join(covered, ["w1", "w2"], "left").where(f"longest is null or 100 * longest < {COVERED} * a")
    two = two.join(word(1), "w1").join(word(2), "w2").select("lang1", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
    two = two.withColumn("score", score("a", "l", "r"))
    three = triples.withColumnRenamed("f", "a").join(part(1, 2), ["w1", "w2"]).join(part(2, 3), ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    three = three.select("lang1", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", score("a", "f1", "f23").alias("s1"), score("a", "f12", "f3").alias("s2"), "f1", "f23", "f12", "f3")
    late = F.col("s2") < F.col("s1")
    three = three.select("lang1", "phrase", "a", F.when(late, F.col("f12")).otherwise(F.col("f1")).alias("l"), F.when(late, F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("s1", "s2").alias("score"))
    order = (F.desc("score"), F.desc("a"), "phrase")
    # first among a share of the language's phrases, then among those: the last step gets `top` rows of each share at most
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = two.unionByName(three).withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang1", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang1").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(common.small(totals), ranked["lang1"] == totals["lang"]).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
