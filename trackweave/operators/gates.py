"""Gates and dedupes that depend on what was let through before.

Whether a greedy gate lets a row through depends on the last row that it let through, and so on all of a
key's history. Keys of up to SLICE_ROWS rows are dealt out and sorted, and each task reads its rows in order
once, holding a key's last admitted time. Longer histories are cut into slices of time. Each slice works out
in parallel what time was last let through at its end, for whatever time was last let through before it: a
short list of steps. The steps of a key are chained in order, which tells each slice where it starts, and the
slices then admit their rows in parallel. So no task gets a key that holds a third of all rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# the helpers below travel with the jobs that use them, so that workers need not find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a key that one task reads in order; a key with more is cut into slices of a quarter as many, if its rows lie evenly in time.
SLICE_ROWS = 2_000_000
#: Stands for the time of the last admitted row of a key that has none yet.
NEVER = -(2**62)


def next_admitted(t: np.ndarray, gap: int, free: np.ndarray) -> np.ndarray:
    """For sorted times, the row that is let through next after each row; len(t) for none."""
    n = len(t)
    own = np.arange(1, n + 1)
    due = np.maximum(np.searchsorted(t, t + gap), own)
    frees = np.append(np.flatnonzero(free), n)
    return np.minimum(due, frees[np.searchsorted(frees, own)])


def slice_steps(t: np.ndarray, gap: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upto, last): after a row admitted at upto[k] at the latest, and later than upto[k - 1], the slice ends with last[k]; after a later one, with that itself."""
    n = len(t)
    end = np.append(next_admitted(t, gap, free), n)
    while (end[end[:n]] != n).any():
        end[:n] = np.where(end[end[:n]] == n, end[:n], end[end[:n]])
    last = t[np.where(end[:n] == n, np.arange(n), end[:n])]
    upto = np.where(np.maximum.accumulate(free), t[0], np.minimum(t - gap, t[0]))
    new = np.append(upto[:-1] != upto[1:], True)  # of rows that admit for the same entries, the first counts
    first = np.append(0, np.flatnonzero(new)[:-1] + 1)
    upto, last = upto[first], last[first]
    differs = np.append(last[:-1] != last[1:], True)
    return upto[differs], last[differs]


def greedy(rows: DataFrame, keys: list[str], at: str, order: list[str], gap_us: Column, bypass: Column | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The admitted rows, as (keys, at, order): at least gap_us after the last admitted one of the key, or bypassing, which restarts the clock.

    gap_us is the same for all rows of a key. Rows with a null time are never admitted; a null gap is none; null keys are a key.
    Finding the long keys counts all keys at once, before the result is asked for."""
    gap = F.greatest(F.coalesce(gap_us, F.lit(0)), F.lit(0)).cast("long")
    by, told = [f"_k{i}" for i in range(len(keys))], [f"_o{i}" for i in range(len(order))]
    named = rows.where(F.col(at).isNotNull()).select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], F.col(at).cast("long").alias("_t"), *[F.col(o).alias(b) for o, b in zip(order, told, strict=True)], gap.alias("_gap"), F.coalesce(F.lit(False) if bypass is None else bypass, F.lit(False)).alias("_free"))
    sizes = named.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_t").alias("_from"), F.max("_t").alias("_to"))
    long = sizes.where(F.col("_n") > slice_rows)
    if long.isEmpty():
        kept = read_in_order(named, by, told)
    else:
        hot = long.select(*[F.col(b).alias(f"{b}_") for b in by], "_from", F.greatest(F.lit(1.0), (F.col("_to") - F.col("_from") + 1) / (4 * F.ceil(F.col("_n") / slice_rows))).alias("_width"))
        hot = F.broadcast(hot)  # rows / slice_rows at most
        same = [F.col(b).eqNullSafe(F.col(f"{b}_")) for b in by]
        cut = named.join(hot, same).withColumn("_slice", F.floor((F.col("_t") - F.col("_from")) / F.col("_width"))).select(*named.columns, "_slice")
        kept = read_in_order(named.join(hot, same, "left_anti"), by, told).unionByName(in_slices(cut, by, told))
    return kept.select(*[F.col(b).alias(k) for k, b in zip(keys, by, strict=True)], F.col("_t").alias(at), *[F.col(b).alias(o) for o, b in zip(order, told, strict=True)])


def read_in_order(named: DataFrame, by: list[str], told: list[str]) -> DataFrame:
    """The admitted rows of keys that go whole to a task, which holds one time of one key."""
    kinds = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    out = [*by, "_t", *told]

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            taken = []
            columns = [batch.column(c).to_pylist() for c in range(len(by))] or [[0] * batch.num_rows]
            times, gaps, frees = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_t", "_gap", "_free"))
            for i, (k, t, gap, free) in enumerate(zip(zip(*columns, strict=True), times, gaps, frees, strict=True)):
                if k != key:
                    key, last = k, None
                if last is None or free or t - last >= gap:
                    taken.append(i)
                    last = t
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).take(pa.array(taken, pa.int64())) for c in out], names=out)

    dealt = named.repartition(*by) if by else named.coalesce(1)
    return dealt.sortWithinPartitions(*by, "_t", *told).mapInArrow(admit, ", ".join(f"{c} {kinds[c]}" for c in out))


def in_slices(cut: DataFrame, by: list[str], told: list[str]) -> DataFrame:
    """The admitted rows of keys that are cut by _slice."""
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    head = "".join(f"{k} {kinds[k]}, " for k in by)

    def sorted_times(table: pa.Table) -> tuple[pa.Table, np.ndarray, int, np.ndarray]:
        table = table.sort_by([("_t", "ascending"), *[(c, "ascending") for c in told]])
        return table, table.column("_t").to_numpy(), table.column("_gap")[0].as_py(), table.column("_free").to_numpy()

    def steps(table: pa.Table) -> pa.Table:
        table, t, gap, free = sorted_times(table)
        upto, last = slice_steps(t, gap, free)
        lists = {name: pa.array([x], pa.list_(pa.int64())) for name, x in (("upto", upto), ("last", last))}
        return pa.table({**{c: table.column(c).slice(0, 1) for c in (*by, "_slice")}, **lists})

    def chain(slices: pd.DataFrame) -> pd.DataFrame:
        slices, found, last = slices.sort_values("_slice"), [], NEVER
        for upto, end in zip(slices["upto"], slices["last"], strict=True):
            found.append(last)
            k = int(np.searchsorted(upto, last))
            last = int(end[k]) if k < len(upto) else last
        return slices[[*by, "_slice"]].assign(_entry=found)

    def admit(left: pa.Table, entry: pa.Table) -> pa.Table:
        left, t, gap, free = sorted_times(left)
        last, following, taken = entry.column("_entry")[0].as_py(), next_admitted(t, gap, free), []
        frees = np.append(np.flatnonzero(free), len(t))
        row = int(min(np.searchsorted(t, last + gap) if last != NEVER else 0, frees[0]))
        while row < len(t):
            taken.append(row)
            row = int(following[row])
        return left.take(pa.array(taken, pa.int64())).select([*by, "_t", *told])

    found = cut.groupBy(*by, "_slice").applyInArrow(steps, f"{head}_slice long, upto array<long>, last array<long>")
    entries = found.groupBy(*by).applyInPandas(chain, f"{head}_slice long, _entry long")
    out = ", ".join(f"{c} {kinds[c]}" for c in (*by, "_t", *told))
    return cut.groupBy(*by, "_slice").cogroup(entries.groupBy(*by, "_slice")).applyInArrow(admit, out)


def onset(rows: DataFrame, keys: list[str], order: list[str], level: Column) -> DataFrame:
    """rows with `onset`: level is true and was not in the key's row before."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("onset", level & ~F.coalesce(F.lag(level).over(by), F.lit(False)))


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def revised(rows: DataFrame, keys: list[str], poll: str, token: str) -> DataFrame:
    """Rows whose token differs from the key's token in the poll before; a key absent from it is new again. Polls are numbered without gaps."""
    by = Window.partitionBy(*keys).orderBy(poll)
    known = (F.lag(poll).over(by) == F.col(poll) - 1) & F.lag(token).over(by).eqNullSafe(F.col(token))
    return rows.withColumn("_same", F.coalesce(known, F.lit(False))).where("not _same").drop("_same")


def changed(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The first row of each key, and those whose value differs from the row before."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_new", F.row_number().over(by).eqNullSafe(F.lit(1)) | ~F.lag(value).over(by).eqNullSafe(F.col(value))).where("_new").drop("_new")


def with_static(rows: DataFrame, keys: list[str], at: str, order: list[str], static: list[str], is_static: Column, ttl_us: int) -> DataFrame:
    """Dynamic rows with the latest earlier value of each static field; a key not heard of for ttl_us is forgotten."""
    by = Window.partitionBy(*keys).orderBy(at, *order)
    quiet = (F.col(at) - F.lag(at).over(by) > ttl_us).cast("int")
    spans = rows.withColumn("_span", F.sum(F.coalesce(quiet, F.lit(0))).over(by))
    inside = Window.partitionBy(*keys, "_span").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0)
    known = {f: F.last(F.when(is_static, F.col(f)), ignorenulls=True).over(inside) for f in static}
    return spans.withColumn("_static", is_static).withColumns({f"last_{f}": c for f, c in known.items()}).where("not _static").drop("_span", "_static")
