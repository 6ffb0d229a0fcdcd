"""Live fused state over time: what each observation, and each silence, changes.

A contributor (the newest observation of a source) counts from its observation until a newer one or until
its source's expiry window has passed. When it passes, its identity is fused again from those that are left,
a hand-over such as from a local receiver to a network feed, or removed if there are none. Both need no
observation: they are due at the instant that the last one expires.

The state at an instant depends only on the longest expiry window before it. So time is cut into slices of
that width, each of which also reads the slice before it, and an identity with a third of all rows is worked
on in as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fusion

LATE = 2**62


def losses(rows: DataFrame, until_us: int) -> DataFrame:
    """(identity, t): when contributors expire with no newer observation of their source by then."""
    by = Window.partitionBy("identity", "source").orderBy("observed_us", "received_us", "ord")
    due = rows.withColumn("_next", F.lead("observed_us").over(by)).where("_next is null or _next > expire_us")
    return due.where(F.col("expire_us") <= until_us).select("identity", F.col("expire_us").alias("t")).distinct()


def best(alive: Column, field: str | None, dynamic: bool = True) -> Column:
    """(v, source) of the contributor that wins a field, among those that have it; null if none has. field None: of all, by tier."""
    having = F.filter(alive, lambda x: x[field].isNotNull()) if field else alive
    rank = lambda x: [x["tier"], -x["observed_us"], x["source"]] if dynamic else [-x["observed_us"], x["source"]]
    value = lambda x: [x[field].alias("v")] if field else [x["source"].alias("v")]
    ranked = F.transform(having, lambda x: F.struct(F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank(x))]).alias("rank"), x["source"].alias("source"), F.struct(*value(x)).alias("w")))
    return F.array_min(F.transform(ranked, lambda x: F.struct(x["rank"], x["source"], x["w"]["v"].alias("v"))))


def live_changes(observations: DataFrame, dynamic: list[str], metadata: list[str], until_us: int, unit_us: int = 1_000_000, windows=fusion.WINDOWS, other=fusion.OTHER, sources: list[str] | None = None) -> DataFrame:
    """identity, at_us, ord, op, source, locally_received, fused_count, and each field with its source.

    op is upsert (an observation; ord is its own), handover (some contributor expired) or remove (the last one did). Each
    observation up to until_us is one change, as is each instant at which contributors of an identity expire. Rows without
    identity or time change nothing; a field that no contributor has is null. At equal times observations come first, by
    received_us and ord; what expires at that time no longer counts in them. sources: the feeds there are; None: those that occur, which is a query of its own."""
    reach = int(max(w[1] for w in [*windows.values(), other]) * unit_us)
    fields = [*dynamic, *metadata]
    rows = observations.where("identity is not null and observed_us is not null").where(F.col("observed_us") <= until_us)
    rows = rows.withColumn("expire_us", F.col("observed_us") + (fusion.window_s(F.col("source"), 1, windows, other) * unit_us).cast("long")).select("identity", "source", "local_rf", "observed_us", "received_us", "ord", "expire_us", *fields)
    if sources is None:
        sources = [r.source for r in rows.select("source").distinct().collect()]  # the feeds, a handful
    seen = rows.withColumn("t", F.col("observed_us")).withColumn("_kind", F.lit(0))
    gone = losses(rows, until_us).withColumns({"_kind": F.lit(1), "received_us": F.lit(LATE), "ord": F.lit(LATE)})
    events = seen.unionByName(gone, allowMissingColumns=True).withColumn("_own", F.floor(F.col("t") / reach))
    # an observation also stands in the next slice, whose first instants may still depend on it
    copies = events.withColumn("_slice", F.explode(F.when(F.col("_kind") == 0, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    by = Window.partitionBy("identity", "_slice").orderBy("t", "_kind", "received_us", "ord").rowsBetween(Window.unboundedPreceding, 0)
    told = F.struct("source", "local_rf", "observed_us", "expire_us", *fields)
    newest = [F.last(F.when((F.col("_kind") == 0) & F.col("source").eqNullSafe(F.lit(s)), told), ignorenulls=True).over(by) for s in sources]
    state = copies.withColumn("_all", F.array(*newest) if newest else F.array(told)).where("_slice = _own")
    alive = F.filter("_all", lambda x: x.isNotNull() & (x["expire_us"] > F.col("t")))

    def aged(x: Column) -> Column:
        fresh = fusion.freshness(x["source"], fusion.age_s(x["observed_us"], F.col("t"), unit_us), windows, other)
        return F.struct(x["source"].alias("source"), x["local_rf"].alias("local_rf"), x["observed_us"].alias("observed_us"), fusion.tier(fresh, x["local_rf"]).alias("tier"), *[x[f].alias(f) for f in fields])

    state = state.withColumn("_alive", F.transform(alive, aged))
    size = F.size("_alive")
    picks = {f"_p_{f}": best(F.col("_alive"), f, f in dynamic) for f in fields} | {"_head": best(F.col("_alive"), None)}
    place = F.col("_p_position.source") if "position" in fields else F.lit(None).cast("string")
    op = F.when(F.col("_kind") == 0, "upsert").when(size > 0, "handover").otherwise("remove")
    values = [c for f in fields for c in (F.col(f"_p_{f}.v").alias(f), F.col(f"_p_{f}.source").alias(f"{f}_source"))]
    return state.withColumns(picks).select(
        "identity", F.col("t").alias("at_us"), F.when(F.col("_kind") == 0, F.col("ord")).alias("ord"), op.alias("op"), F.coalesce(place, F.col("_head.source")).alias("source"),
        F.exists("_alive", lambda x: F.coalesce(x["local_rf"], F.lit(False))).alias("locally_received"), size.alias("fused_count"), *values)


def state_at(changes: DataFrame, as_of_us: int) -> DataFrame:
    """The last change of each identity up to an instant, without those that are removed."""
    order = F.struct("at_us", (F.col("op") != "upsert").alias("k"), F.coalesce("ord", F.lit(LATE)).alias("o"))
    rest = [c for c in changes.columns if c != "identity"]
    last = changes.where(F.col("at_us") <= as_of_us).groupBy("identity").agg(F.max_by(F.struct(*rest), order).alias("c"))
    return last.select("identity", "c.*").where("op <> 'remove'")


def valid_from_crossings(features: DataFrame, sweeps: DataFrame, keys: list[str], slice_us: int = 3_600_000_000) -> DataFrame:
    """features with swept_us: those that a sweep finds to have become valid since the sweep before it.

    features: keys, seen_us (when they came in), valid_from_us, valid_until_us (null: no end); sweeps: keys, at_us. A sweep takes
    what became valid after the sweep before and up to itself, came in by then and has not ended; the first sweep takes none.
    Intervals between sweeps are laid over slices of time and joined by slice."""
    order = Window.partitionBy(*keys).orderBy("at_us")
    spans = sweeps.select(*keys, "at_us").distinct().withColumn("_before", F.lag("at_us").over(order)).where("_before is not null")
    cut = lambda c: F.floor(F.col(c) / slice_us)
    spans = spans.withColumn("_slice", F.explode(F.sequence(cut("_before"), cut("at_us")))).select(*[F.col(k).alias(f"_s{k}") for k in keys], "_before", F.col("at_us").alias("swept_us"), "_slice")
    own = features.where("valid_from_us is not null").withColumn("_own", cut("valid_from_us"))
    same = [F.col("_own") == F.col("_slice"), *[F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys]]
    found = own.join(spans, same).where("valid_from_us > _before and valid_from_us <= swept_us and seen_us <= swept_us and (valid_until_us is null or valid_until_us > swept_us)")
    return found.select(*features.columns, "swept_us")
