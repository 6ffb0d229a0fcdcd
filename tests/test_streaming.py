"""Streams over files against the batch operators."""

import time

import pytest
from pyspark.sql import functions as F

from trackweave.operators import fusion, gates, history
from trackweave.plans.observations import UNIT_US, observations
from trackweave.streaming import live

SF = "/root/testdata/sf0.001"
COLUMNS = ["identity", "source", "local_rf", "observed_us", "received_us", "ord", "altitude_m", "emergency"]


@pytest.fixture(scope="module")
def obs(spark):
    return observations(spark, SF).select(*COLUMNS).orderBy("observed_us", "ord").limit(400).cache()


@pytest.fixture
def stream(spark, obs, tmp_path):
    """Three files in order of observation, a file a batch."""
    rows = obs.toPandas()
    for k in range(3):
        spark.createDataFrame(rows[k * 134 : (k + 1) * 134], obs.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def emitted(spark, rows, mode, tmp_path, name):
    query = rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
    deadline = time.time() + 60  # timers keep a stream busy for ever, so it is stopped once it has read all
    while sum(p["numInputRows"] for p in query.recentProgress) < 400 and time.time() < deadline and query.isActive:
        time.sleep(0.2)
    query.stop()
    return spark.table(name)


def test_latest(spark, obs, stream, tmp_path):
    out = emitted(spark, live.latest_stream(stream), "update", tmp_path, "latest_rows")
    got = fusion.latest(out.where("op = 'upsert'"), ["altitude_m"]).select("identity", "source", "ord").collect()
    want = fusion.latest(obs, ["altitude_m"]).select("identity", "source", "ord").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_gate(spark, obs, stream, tmp_path):
    gap = 40 * UNIT_US
    out = emitted(spark, live.gate_stream(stream, ["identity"], "observed_us", gap, "emergency"), "append", tmp_path, "gated_rows")
    want = gates.greedy(obs, ["identity"], "observed_us", ["ord"], F.lit(gap), F.col("emergency"))
    assert sorted(r.ord for r in out.collect()) == sorted(r.ord for r in want.collect())


def test_history_sink(spark, obs, stream, tmp_path):
    live.to_history(stream, f"{tmp_path}/history", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    back = spark.read.parquet(f"{tmp_path}/history")
    assert back.count() == 400 and "obs_date" in back.columns
    assert history.older_than(back, 0).count() == 0


def test_windows_need_the_watermark(spark, stream, tmp_path):
    out = emitted(spark, live.rate_per_window(stream, "1 day"), "append", tmp_path, "window_rows")
    assert 0 < out.agg(F.sum("n")).first()[0] <= 400
