"""Benchmark decontamination by winnowing.

Both sides keep, in each run of WINDOW hashes of GRAM words, the least one. Any span of SPAN = GRAM +
WINDOW - 1 shared words has the same least hash on both sides, so joining fingerprints misses no
shared window of SPAN words. Items of fewer words are one window; for the few lengths that they have,
documents give all grams of that length. Each joined fingerprint names an alignment of a document to
an item; alignments are extended over the whole item, and runs of equal words at least as long as the
item's window are hits.

Texts are not shuffled but for documents with a joined fingerprint. The benchmark's fingerprints are
broadcast only if a bounded count shows that they are few; otherwise both sides are shuffled, and
adaptive execution splits hot fingerprints.

Defined results: null or empty texts have no words and no hits. Rows are told apart by id and text, so
repeated rows and ids get the same or their own results. Benchmark rows that share an id count as one
item; a null id is named by the empty string. Empty tables: no documents, or no hits. Extra columns
are ignored by the report and kept by the filter. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ragged

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1
#: Splits a text into the words that ragged.PLAIN gives, without lower-casing first.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def winnow(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position in the text) of the fingerprints of texts of SPAN words or more; the rightmost of equal minima."""
    g = ragged.grams(hashes, GRAM)
    spots, owner = ragged.gram_starts(counts, SPAN)  # each window of SPAN words
    if not len(spots):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, at = g[spots], spots
    for j in range(1, WINDOW):
        new = g[spots + j]
        better = new <= least
        least, at = np.where(better, new, least), np.where(better, spots + j, at)
    first = np.r_[True, at[1:] != at[:-1]]
    first_word = np.cumsum(np.r_[0, counts])[:-1]
    return least[first], owner[first], at[first] - first_word[owner[first]]


def fingerprints(texts: list[str | None], short: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """winnow(), and all grams of the short lengths."""
    hashes, counts = ragged.words(texts, ragged.PLAIN)
    found = [winnow(hashes, counts)]
    first_word = np.cumsum(np.r_[0, counts])[:-1]
    for n in short:
        spots, owner = ragged.gram_starts(counts, n)
        found.append((ragged.mix(ragged.grams(hashes, n)[spots] + np.uint64(n)), owner, spots - first_word[owner]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def benchmark_index(benchmark: DataFrame) -> DataFrame:
    """(item, words, fp, at): the fingerprints of each item, with its word hashes."""
    common.importable(benchmark.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes, counts = ragged.words([text], ragged.PLAIN)
                n = int(counts[0])
                fp, _, at = fingerprints([text], [n] if 0 < n < SPAN else [])
                if n:
                    out.append((item, hashes.view(np.int64), fp.view(np.int64), at))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.list_(pa.int64())) for c in columns[1:])], names=["item", "words", "fps", "ats"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").distinct()
    return items.mapInArrow(rows, "item string, words array<long>, fps array<long>, ats array<long>")


def alignments(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, th, item, words, shifts): where fingerprints align documents (by id and text hash) to items."""
    short = [r[0] for r in index.select(F.size("words").alias("n")).where(f"n < {SPAN}").distinct().collect()]  # SPAN - 1 rows at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, owner, at = fingerprints(batch.column(2).to_pylist(), short)
            owner = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(fp.view(np.int64)), pa.array(at, pa.int64())], names=["doc_id", "th", "fp", "at"])

    kind = dict(docs.dtypes)["doc_id"]
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(rows, f"doc_id {kind}, th long, fp long, at long")
    theirs = common.written(index.select("item", F.xxhash64("words").alias("ih"), F.explode(F.arrays_zip("fps", "ats")).alias("f")).select("item", "ih", F.col("f.fps").alias("fp"), F.col("f.ats").alias("item_at")), "benchmark-fingerprints")
    hits = own.join(common.small(theirs), "fp").select("doc_id", "th", "item", "ih", (F.col("at") - F.col("item_at")).alias("shift"))
    each = hits.groupBy("doc_id", "th", "item", "ih").agg(F.collect_set("shift").alias("shifts"))
    return common.written(each, "alignments")


def extended(docs: DataFrame, found: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, th, n_hit, n_items, items_sha256) of each document with a hit."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (text, items) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own = ragged.words([text], ragged.PLAIN)[0].view(np.int64)
                hit, names = np.zeros(len(own), bool), set()
                for item in items:
                    theirs = np.array(item["words"], np.int64)
                    least = min(SPAN, len(theirs))
                    for shift in item["shifts"]:
                        start, end = max(0, shift), min(len(own), shift + len(theirs))
                        same = own[start:end] == theirs[start - shift : end - shift]
                        edges = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
                        for a, b in zip(edges[::2], edges[1::2], strict=True):
                            if b - a >= least:
                                hit[start + a : start + b] = True
                                names.add(item["item"])
                if names:
                    out.append((i, int(hit.sum()), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
            at, *columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "th", "n_hit", "n_items", "items_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    keys = common.written(found.select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th")).distinct(), "aligned-keys")
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    own = own.join(common.small(keys), own["doc_id"].eqNullSafe(keys["k_id"]) & (own["th"] == keys["k_th"]), "left_semi").dropDuplicates(["doc_id", "th"])
    named = index.select("item", F.xxhash64("words").alias("ih"), "words")
    items = found.join(named, ["item", "ih"]).groupBy(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th")).agg(F.collect_list(F.struct("item", "words", "shifts")).alias("items"))
    both = own.join(items, own["doc_id"].eqNullSafe(items["k_id"]) & (own["th"] == items["k_th"])).select("doc_id", "th", "text", "items")
    return both.mapInArrow(rows, f"doc_id {kind}, th long, n_hit long, n_items long, items_sha256 string")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(k_id, k_th, n_hit, n_items, items_sha256) of the documents with hits, by id and text hash; written."""
    index = common.written(benchmark_index(benchmark), "benchmark-index")
    found = extended(docs, alignments(docs, index), index)
    return common.written(found.withColumnsRenamed({"doc_id": "k_id", "th": "k_th"}), "contamination")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without hits, with their own columns."""
    bad = contamination(docs, benchmark)
    return docs.join(common.small(bad), docs["doc_id"].eqNullSafe(bad["k_id"]) & (F.xxhash64(docs["text"]) == bad["k_th"]), "left_anti")


def decontam_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    bad = contamination(docs, benchmark)
    n = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), GAPS), "")).cast("long")
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), n.alias("n_words"))
    both = own.join(common.small(bad), own["doc_id"].eqNullSafe(bad["k_id"]) & (own["th"] == bad["k_th"]), "left")
    none = F.sha2(F.lit(""), 256)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return both.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))
