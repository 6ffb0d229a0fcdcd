"""Sharding: what is written is every row once, in shards within the limit."""

from collections import Counter

from trackweave.llm import sharding

from .conftest import prose


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(k, prose(k, 20), "en") for k in range(60)] + [(7, prose(70 + k, 20), f"l{k}") for k in range(10)]
    rows += [(None, prose(90 + k, 20), None) for k in range(10)] + [(8, "same text " * 10, "en")] * 30 + [(None, None, "en")] * 3 + [(9, "x" * 3000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    sharding.write_shards(docs, str(tmp_path / "out"), 1000)
    found = spark.read.schema("doc_id long, text string, lang string, shard string").parquet(str(tmp_path / "out")).collect()
    assert Counter(tuple(r)[:3] for r in found) == Counter(rows)
    held, of = Counter(), Counter()
    for r in found:
        held[r.shard] += len((r.text or "").encode())
        of[r.shard] += 1
    assert len(held) > 10 and all(n <= 1000 or of[s] == 1 for s, n in held.items())


def test_shard_edges(spark, tmp_path):
    rows = [(k, prose(k, 20), "mine", 1, "p") for k in range(40)] + [(None, None, None, None, None), (3, "", "mine", 2, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Shard string, bytes long, page string").repartition(3)
    placed = sharding.shard(docs, 1000).collect()
    assert Counter(r.doc_id for r in placed) == Counter(r[0] for r in rows)
    assert all(r.bytes == len((dict((x[0], x[1]) for x in rows[:40]).get(r.doc_id) or "").encode()) or r.bytes == 0 for r in placed)
    column = sharding.write_shards(docs, str(tmp_path / "out"), 1000)
    found = spark.read.schema(f"doc_id long, text string, Shard string, bytes long, page string, {column} string").parquet(str(tmp_path / "out"))
    assert column == "shard_" and Counter(tuple(r)[:5] for r in found.collect()) == Counter(rows)
    assert found.select(column).distinct().count() > 4
    assert sharding.shard(docs.where("false"), 1000).count() == 0
