"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. run() writes each
result to the shared folder and reads it again, so a lost executor costs at most the stage in work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackweave.llm import bpe, common, decontam, linededup, neardup, quality


#: Rows of the encoder's tables. Its workers share an executor with what the earlier stages left in memory.
ENCODE_ROWS = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.quality_rules(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts."""
    return linededup.line_dedup(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return neardup.near_dedup(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip, ids."""
    return bpe.bpe_encode(docs, table_rows=ENCODE_ROWS)


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("near-duplicates", near_dup_stage), ("decontamination", decontam_stage), ("byte-level BPE", encode_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the encoding; no test compares run() with a brute-force version yet.
ORACLE_SQL = None
