"""Live state: the batch form by hand and against brute force, the stream against the batch form."""

import random
import time

import pytest
from pyspark.sql import functions as F

from trackweave.operators import fusion, live
from trackweave.plans.observations import UNIT_US, observations
from trackweave.streaming import live as streaming

KIND = "identity string, source string, local_rf boolean, observed_us long, received_us long, ord long, altitude_m double, label string"
WINDOWS = {"local": (5.0, 60.0), "net": (15.0, 120.0)}
COLUMNS = ["identity", "at_us", "ord", "op", "source", "locally_received", "fused_count", "altitude_m", "altitude_m_source", "label", "label_source"]


def changes(spark, rows, until=10**6):
    return live.live_changes(spark.createDataFrame(rows, KIND), ["altitude_m"], ["label"], until, 1, WINDOWS, (15.0, 100.0))


def by_hand(rows, until):
    """One event after the other over all contributors."""
    out, windows = [], WINDOWS
    rows = sorted((r for r in rows if r[0] is not None and r[3] is not None and r[3] <= until), key=lambda r: r[3:6])
    for identity in {r[0] for r in rows}:
        held = {}
        own = [r for r in rows if r[0] == identity]

        def told(t, o, contributors=held, identity=identity):
            held = {s: r for s, r in contributors.items() if r[3] + int(windows.get(s, (15.0, 100.0))[1]) > t}

            def tier(s):
                stale = t - held[s][3] >= windows.get(s, (15.0, 100.0))[0]
                return (2 if stale else 0) if held[s][2] else (3 if stale else 1)

            order = sorted(held, key=lambda s: (tier(s), -held[s][3], s))
            heard = sorted(held, key=lambda s: (-held[s][3], s))
            alt = next((s for s in order if held[s][6] is not None), None)
            label = next((s for s in heard if held[s][7] is not None), None)
            op = "upsert" if o is not None else "handover" if held else "remove"
            out.append((identity, t, o, op, order[0] if order else None, any(bool(r[2]) for r in held.values()), len(held), held[alt][6] if alt else None, alt, held[label][7] if label else None, label))

        def expire(before, inclusive, held=held, told=told):
            end = lambda s: held[s][3] + int(windows.get(s, (15.0, 100.0))[1])
            while due := [end(s) for s in held if end(s) < before or inclusive and end(s) == before]:
                first = min(due)
                for s in [s for s in held if end(s) == first]:
                    held.pop(s)
                told(first, None)

        for r in own:
            expire(r[3], False)
            held[r[1]] = r
            told(r[3], r[5])
        expire(until, True)
    return sorted(out, key=str)


def test_hand_over_and_removal(spark):
    rows = [("a", "local", True, 0, 0, 1, 100.0, None), ("a", "net", False, 10, 10, 2, 90.0, "N"), ("a", "local", True, 20, 20, 3, None, "L")]
    found = [tuple(r)[1:] for r in changes(spark, rows).orderBy("at_us").collect()]
    assert found == [
        (0, 1, "upsert", "local", True, 1, 100.0, "local", None, None),
        (10, 2, "upsert", "net", True, 2, 90.0, "net", "N", "net"),  # local is stale by now
        (20, 3, "upsert", "local", True, 2, 90.0, "net", "L", "local"),
        (80, None, "handover", "net", False, 1, 90.0, "net", "N", "net"),
        (130, None, "remove", None, False, 0, None, None, None, None)]
    at = lambda t: [r.op for r in live.state_at(changes(spark, rows), t).collect()]
    assert at(79) == ["upsert"] and at(80) == ["handover"] and at(129) == ["handover"] and at(130) == [] and at(-1) == []
    assert [r.op for r in changes(spark, rows, 100).orderBy("at_us").collect()] == ["upsert"] * 3 + ["handover"]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    """Ties, gaps of all lengths, an unknown source, nulls; a dense identity over many slices of time."""
    pick = random.Random(seed)
    rows = [(pick.choice("aaab"), pick.choice(["local", "net", "other"]), pick.random() < 0.5, t := pick.randint(0, 3000) // 5 * 5, t + k % 3, k, pick.choice([None, 1.0 * k]), pick.choice([None, f"L{k}"])) for k in range(120)]
    rows += [("dense", pick.choice(["local", "net"]), True, t, t, 1000 + t, 1.0 * t, None) for t in range(0, 1500, 3)]
    rows += [(None, "net", True, 5, 5, 5000, 1.0, "x"), ("c", "net", None, None, 5, 5001, 1.0, "x"), ("c", "net", None, 7, 7, 5002, None, None)]
    found = changes(spark, rows, 2500)
    assert found.columns == COLUMNS and sorted(map(tuple, found.collect()), key=str) == by_hand(rows, 2500)


def test_no_observations(spark):
    assert changes(spark, []).collect() == []


def test_alive_as_in_fusion(spark):
    """Who contributes at an instant is what fusion of all observations finds."""
    obs = observations(spark, "/root/testdata/sf0.001")
    as_of = obs.agg(F.max("observed_us")).first()[0] - 100 * UNIT_US
    state = live.state_at(live.live_changes(obs, ["altitude_m"], ["label"], as_of, UNIT_US), as_of)
    fused = fusion.fuse(fusion.contributors(obs.withColumn("position", F.when(F.col("lon").isNotNull(), F.array("lon", "lat"))), ["position", "altitude_m", "label", "track_type"], as_of, UNIT_US), ["position", "altitude_m"], ["label"], UNIT_US)
    pick = lambda df: sorted((r.identity, r.fused_count, r.locally_received) for r in df.collect())
    assert pick(state) == pick(fused)


def test_stream_gives_the_batch_rows(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaming.STATE_STORE)
    pick = random.Random(3)
    rows = sorted(((pick.choice("abcd"), pick.choice(["local", "net", "other"]), pick.random() < 0.5, t := (k + 1) * 7_000_000, t, k, pick.choice([None, 1.0 * k]), pick.choice([None, f"L{k}"])) for k in range(240)), key=lambda r: r[3])
    end = ("zz", "net", True, 10**10, 10**10, 999, 1.0, None)  # moves the watermark past all others
    for part in (rows[:90], rows[90:91], rows[91:], [end], [(*end[:3], 2 * 10**10, 2 * 10**10, 1000, 1.0, None)]):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = streaming.fused_stream(source, ["altitude_m"], ["label"], 1_000_000, "0 seconds", WINDOWS, (15.0, 100.0))
    query = out.writeStream.format("memory").queryName("fused_rows").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(150)
    found = spark.table("fused_rows").where("identity <> 'zz'")
    want = live.live_changes(spark.createDataFrame(rows, KIND), ["altitude_m"], ["label"], 10**10, 1_000_000, WINDOWS, (15.0, 100.0))
    assert {r.op for r in want.select("op").distinct().collect()} == {"upsert", "handover", "remove"}
    assert sorted((tuple(r) for r in found.select(COLUMNS).collect()), key=str) == sorted((tuple(r) for r in want.collect()), key=str)


def test_crossings(spark):
    """The first sweep takes none, a feature is taken once, those that ended or came in later are not."""
    features = spark.createDataFrame([("early", "s", 0, 5, None), ("due", "s", 0, 15, None), ("on the sweep", "s", 0, 20, None), ("ended", "s", 0, 12, 20), ("late", "s", 25, 15, None), ("never", "s", 0, None, None), ("elsewhere", "t", 0, 15, None), ("after", "s", 0, 31, None)], "id string, k string, seen_us long, valid_from_us long, valid_until_us long")
    sweeps = spark.createDataFrame([("s", 10), ("s", 20), ("s", 20), ("s", 30), ("t", 15)], "k string, at_us long")
    for width in (1, 7, 1000):
        found = live.valid_from_crossings(features, sweeps, ["k"], width)
        assert sorted((r.id, r.swept_us) for r in found.collect()) == [("due", 20), ("on the sweep", 20)]
        assert found.columns == [*features.columns, "swept_us"]
