"""The greedy gate and the firing of rules against a fold tick by tick."""

import random
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trackweave.operators import alerts, gates


def admitted(rows, gap_of):
    last, out = {}, []
    for k, t, o, free in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        if k not in last or free or t - last[k] >= gap_of(k):
            last[k] = t
            out.append((k, t, o))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_rows", [1, 20, 400, 10**6])
@pytest.mark.parametrize("gap", [None, 0, 7, 500])
def test_gate_brute_force(spark, slice_rows, gap):
    pick = random.Random(slice_rows)
    # one key holds most rows, with ties, bypasses, null keys and null times
    rows = [(pick.choice(["hot"] * 6 + ["a", "b", None]), None if pick.random() < 0.02 else pick.randint(0, 2000), k, pick.random() < 0.03) for k in range(1500)]
    df = spark.createDataFrame(rows, "k string, t long, o long, free boolean").repartition(5)
    found = gates.greedy(df, ["k"], "t", ["o"], F.lit(gap), F.col("free"), slice_rows=slice_rows)
    assert found.columns == ["k", "t", "o"]
    assert sorted(map(tuple, found.collect()), key=str) == admitted(rows, lambda _: gap or 0)


def test_gap_a_key(spark):
    rows = [("a" if k % 2 else "b", k, k, False) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, o long, free boolean")
    gap = F.when(F.col("k") == "a", 50).otherwise(3)
    for slice_rows in (10, 10**6):
        assert sorted(map(tuple, gates.greedy(df, ["k"], "t", ["o"], gap, slice_rows=slice_rows).collect()), key=str) == admitted(rows, {"a": 50, "b": 3}.get)
    assert gates.greedy(df.limit(0), ["k"], "t", ["o"], gap).collect() == []


def test_gate_needs_no_package_on_workers(tmp_path):
    """Started from another folder, workers can't import the package."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from trackweave.operators import gates
df = spark.range(100).selectExpr("id % 2 as k", "id as t", "id as o")
print("rows", *[gates.greedy(df, ["k"], "t", ["o"], F.lit(10), slice_rows=n).count() for n in (5, 1000)])
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "rows 20 20" in done.stdout, done.stderr[-2000:]


def folded(rows, transition, cooldown, shared, gate=lambda t: True):
    """(subject, t, ord, action), one tick after the other; rows: (subject, t, ord, level, discrete, removed)."""
    state, out = defaultdict(lambda: {"level": False, "open": False, "last": None}), []
    for subject, t, o, level, discrete, removed in sorted(rows, key=lambda r: (r[1], r[2])):
        key = "group" if shared else subject
        s = state[key]
        ready = gate(t) and (s["last"] is None or t - s["last"] >= cooldown)
        before = s["level"]
        if removed:
            if s["open"] and transition == "enter":
                out.append((key, t, o, "resolve"))
                s["open"] = False
            elif transition == "exit" and before and ready:
                out.append((key, t, o, "fire"))
                s["last"] = t
            s["level"] = False
            if not shared:
                del state[key]
            continue
        s["level"] = level
        if discrete or transition == "change":
            if (level if discrete else before != level) and ready:
                out.append((key, t, o, "fire"))
                s["last"] = t
            continue
        onset, resolve = (before and not level, level and not before) if transition == "exit" else (level and not before, before and not level)
        if onset and ready and not s["open"]:
            out.append((key, t, o, "fire"))
            s["last"], s["open"] = t, True
        elif resolve and s["open"]:
            out.append((key, t, o, "resolve"))
            s["open"] = False
    return sorted(out)


@pytest.mark.parametrize("transition", ["enter", "exit", "change"])
@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("discrete", [False, True])
def test_firing_brute_force(spark, transition, shared, discrete):
    pick = random.Random(f"{transition}{shared}{discrete}")
    rows = [(pick.choice("aaab"), pick.randint(0, 400), k, pick.random() < 0.5, discrete, pick.random() < 0.1) for k in range(500)]
    rows = [(s, t, k, level and not gone, d, gone) for s, t, k, level, d, gone in rows]
    df = spark.createDataFrame([(*r, 0) for r in rows], "subject string, t long, ord long, level boolean, discrete boolean, removed boolean, epoch long")
    from pyspark.sql import Window

    lives = Window.partitionBy("subject").orderBy("t", "ord").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("epoch", F.coalesce(F.sum(F.col("removed").cast("int")).over(lives), F.lit(0)))
    rule = alerts.Rule("r", ("x",), (), transition, cooldown_us=9, dedup_key="group" if shared else None)
    found = alerts.fire(df, rule, F.col("t") % 10 < 8, slice_us=25)
    assert sorted(map(tuple, found.collect())) == folded(rows, transition, 9, shared, lambda t: t % 10 < 8)


def test_a_removed_subject_starts_anew(spark):
    """After a removal neither the value before a change, nor counts, nor the cooldown are known any more."""
    kind = "subject string, t long, ord long, subject_type string, x double"
    ticks = spark.createDataFrame([("s", k, k, "track", x) for k, x in ((1, 5.0), (2, 7.0), (4, 7.0), (5, 5.0), (6, 7.0))], kind)
    removals = spark.createDataFrame([("s", 3, 3), ("never seen", 9, 9)], "subject string, t long, ord long")
    level = lambda *conditions: [(r.t, r.level) for r in alerts.evaluate(ticks, alerts.Rule("r", ("track",), conditions), removals=removals).where("not removed").orderBy("t").collect()]
    c = alerts.Condition
    assert level(c("x", "changed_to", 7.0)) == [(1, False), (2, True), (4, False), (5, False), (6, True)]
    assert level(c("id", "count_within_window", threshold=2, window_us=50)) == [(1, False), (2, True), (4, False), (5, True), (6, True)]
    rule = alerts.Rule("r", ("track",), (c("x", "equals", 7.0),), cooldown_us=1000)
    fired = alerts.fire(alerts.evaluate(ticks, rule, removals=removals), rule).orderBy("t", "action").collect()
    assert [(r.t, r.action) for r in fired] == [(2, "fire"), (3, "resolve"), (4, "fire"), (5, "resolve")]


def test_event_records_are_discrete(spark):
    ticks = spark.createDataFrame([("s", k, k, kind, 7.0) for k, kind in ((1, "event"), (2, "event"), (3, "track"))], "subject string, t long, ord long, subject_type string, x double")
    rule = alerts.Rule("r", ("event", "track"), (alerts.Condition("x", "equals", 7.0),))
    assert [r.discrete for r in alerts.evaluate(ticks, rule).orderBy("t").collect()] == [True, True, False]
