"""Structured Streaming forms of the keyed operators; over a whole stream they give the batch operators' rows.

State is one small row a key: what the newest rows of its sources are, or when a row was last let through.
It goes when a key has been silent for the TTL, so state grows with the keys that are alive."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..operators import fusion

# what runs in the workers travels with the query, so that they need not find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The state store that fused_stream() needs: spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = StructType([StructField("held", StringType())])


def latest_stream(rows: DataFrame, ttl_ms: int = 7_200_000) -> DataFrame:
    """Changes of the newest row of each (identity, source): op upsert, or remove of the whole identity after ttl_ms of silence.

    rows need identity, source, observed_us, received_us, ord; later columns ride along. Of rows that are equally new, the last to arrive stays; older ones are dropped."""
    schema = StructType([*rows.schema.fields, StructField("op", StringType())])

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([{"identity": key[0], "op": "remove"}], columns=schema.names)
            return
        held = json.loads(state.get[0]) if state.exists else {}
        changed = {}
        for batch in batches:
            order = batch.sort_values(["observed_us", "received_us", "ord"], kind="stable").drop_duplicates("source", keep="last")
            for row in order.to_dict("records"):
                rank = [int(row[c]) for c in ("observed_us", "received_us", "ord")]
                if rank >= held.get(row["source"], rank):
                    held[row["source"]], changed[row["source"]] = rank, row
        state.update((json.dumps(held),))
        state.setTimeoutDuration(ttl_ms)
        if changed:
            yield pd.DataFrame(changed.values()).assign(op="upsert")[schema.names]

    return rows.where("identity is not null").groupBy("identity").applyInPandasWithState(fold, schema, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


class Fusion(StatefulProcessor):
    """State of an identity: its contributors by source, typed, and a timer for each time at which one expires."""

    def __init__(self, held: StructType, dynamic: list[str], metadata: list[str], windows: dict, other: tuple, skew_s: float, unit_us: int) -> None:
        self.held_type, self.dynamic, self.metadata = held, dynamic, metadata
        self.windows, self.other, self.skew_s, self.unit_us = windows, other, skew_s, unit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("contributors", StructType([StructField("source", StringType())]), self.held_type)

    def contributors(self) -> dict[str, Row]:
        named = Row(*self.held_type.names)
        return {k[0]: named(*v) for k, v in self.held.iterator()}

    def tier(self, source: str, row: Row, t: int) -> int:
        age = (t - row.observed_us) / self.unit_us
        age = 0.0 if -self.skew_s <= age < 0 else abs(age)
        stale = age >= self.windows.get(source, self.other)[0]
        return (2 if stale else 0) if row.local_rf else (3 if stale else 1)

    def change(self, identity: str, t: int, order: int | None, contributors: dict[str, Row]) -> Row:
        held = {s: r for s, r in contributors.items() if r.expire_us > t}
        ranked = sorted((self.tier(s, r, t), -r.observed_us, s) for s, r in held.items())
        heard = sorted((-r.observed_us, s) for s, r in held.items())
        out: list = []
        place = None
        for name in [*self.dynamic, *self.metadata]:
            wins = next((x[-1] for x in (ranked if name in self.dynamic else heard) if held[x[-1]][name] is not None), None)
            place = wins if name == "position" else place
            out += [held[wins][name] if wins else None, wins]
        op = "upsert" if order is not None else "handover" if held else "remove"
        names = [x for f in [*self.dynamic, *self.metadata] for x in (f, f"{f}_source")]
        head = Row("identity", "at_us", "ord", "op", "source", "locally_received", "fused_count", *names)
        return head(identity, t, order, op, place or (ranked[0][-1] if ranked else None), any(bool(r.local_rf) for r in held.values()), len(held), *out)

    def expired(self, identity: str, held: dict[str, Row], upto: int, inclusive: bool) -> Iterator[Row]:
        """The changes of contributors that expire by upto, instant by instant; held and the state lose them."""
        while due := [r.expire_us for r in held.values() if r.expire_us < upto or inclusive and r.expire_us == upto]:
            t = min(due)
            for source in [s for s, r in held.items() if r.expire_us == t]:
                self.held.removeKey((source,))
                held.pop(source)
            self.handle.deleteTimer(-(-t // 1000))
            yield self.change(identity, t, None, held)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        held = self.contributors()
        for row in sorted(rows, key=lambda r: (r.observed_us, r.received_us, r.ord)):
            yield from self.expired(key[0], held, row.observed_us, False)
            old = held.get(row.source)
            if old is not None and (old.observed_us, old.received_us, old.ord) > (row.observed_us, row.received_us, row.ord):
                continue
            expire = row.observed_us + int(self.windows.get(row.source, self.other)[1] * self.unit_us)
            new = Row(*self.held_type.names)(*[expire if c == "expire_us" else row[c] for c in self.held_type.names])
            held[row.source] = new
            self.held.updateValue((row.source,), tuple(new))
            if old is not None and not any(r.expire_us == old.expire_us for r in held.values()):
                self.handle.deleteTimer(-(-old.expire_us // 1000))
            self.handle.registerTimer(-(-expire // 1000))
            yield self.change(key[0], row.observed_us, row.ord, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        yield from self.expired(key[0], self.contributors(), expiredTimerInfo.getExpiryTimeInMs() * 1000, True)

    def close(self) -> None:
        pass


def fused_stream(rows: DataFrame, dynamic: list[str], metadata: list[str], unit_us: int = 1_000_000, late: str = "10 minutes", windows=fusion.WINDOWS, other=fusion.OTHER) -> DataFrame:
    """The stream of operators.live.live_changes(): observations, hand-overs and removals, each with the fused row.

    rows need identity, source, local_rf, observed_us, received_us, ord and the fields. A contributor expires by a timer of its
    own on event time, once the watermark has passed, or sooner if its identity is heard of again. Rows later than `late` are
    dropped; rows that come out of order change the state if they are the newest of their source. The session needs STATE_STORE."""
    fields = [*dynamic, *metadata]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    held = StructType([StructField(c, kinds.get(c, LongType())) for c in ("local_rf", "observed_us", "received_us", "ord", "expire_us", *fields)])
    out = StructType([
        StructField("identity", kinds["identity"]), StructField("at_us", LongType()), StructField("ord", kinds["ord"]), StructField("op", StringType()), StructField("source", StringType()),
        StructField("locally_received", BooleanType()), StructField("fused_count", LongType()), *[x for f in fields for x in (StructField(f, kinds[f]), StructField(f"{f}_source", StringType()))]])
    timed = rows.where("identity is not null and observed_us is not null").withColumn("_at", F.timestamp_micros("observed_us")).withWatermark("_at", late)
    return timed.groupBy("identity").transformWithState(Fusion(held, dynamic, metadata, dict(windows), other, fusion.SKEW_S, unit_us), out, "Append", "EventTime")


def gate_stream(rows: DataFrame, keys: list[str], at: str, gap_us: int, bypass: str | None = None, ttl_ms: int = 86_400_000) -> DataFrame:
    """Rows at least gap_us after the last one let through of their key, or with bypass set; in order of `at` within a batch."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = int(state.get[0]) if state.exists else None
        all_rows = pd.concat(list(batches)).sort_values([at], kind="stable")
        free = all_rows[bypass] if bypass else [False] * len(all_rows)
        admit = []
        for t, through in zip(all_rows[at], free, strict=True):
            admit.append(bool(last is None or through or t - last >= gap_us))
            last = int(t) if admit[-1] else last
        state.update((str(last),))
        state.setTimeoutDuration(ttl_ms)
        yield all_rows[admit]

    return rows.groupBy(*keys).applyInPandasWithState(fold, rows.schema, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def rate_per_window(rows: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per source and tumbling window of event time; a window is emitted once the watermark has passed it."""
    timed = rows.withColumn("at", F.timestamp_micros("observed_us")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "source").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "source", "n")


def to_history(rows: DataFrame, path: str, checkpoint: str):
    """A query that appends rows to the day-partitioned history; no row is dropped when it falls behind."""
    from ..operators.history import write_history

    return rows.writeStream.foreachBatch(lambda batch, _: write_history(batch, path)).option("checkpointLocation", checkpoint)
