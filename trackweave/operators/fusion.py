"""Fusion of same-identity observations at an instant.

Observations are rows of identity, source, local_rf, observed_us, received_us, ord (arrival order, which
breaks ties) and fields. Of each identity and source the newest counts; each field is then taken by
itself from the best contributor that has it. All of it is two aggregations on keys that share a prefix,
with partial aggregation before each shuffle; no side is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds to which a source's observation is live, and from which it is expired.
WINDOWS = {
    "local_adsb": (5.0, 60.0), "network_adsb": (15.0, 120.0),
    "local_aprs": (300.0, 7200.0), "aprs_is": (300.0, 7200.0), "ais": (60.0, 1800.0),
}
OTHER = (15.0, 120.0)
SKEW_S = 5.0
DYNAMIC = ("position", "altitude_m", "speed_mps", "heading_deg", "vertical_rate_mps")
#: A difference beyond which two sources disagree; positions by squared degrees.
TOLERANCE = {"altitude_m": 30.0, "speed_mps": 5.0, "heading_deg": 5.0, "vertical_rate_mps": 1.0}
POSITION_TOLERANCE = 0.0005**2


def window_s(source: Column, which: int, windows=WINDOWS, other=OTHER) -> Column:
    out = F.lit(other[which])
    for name, limits in windows.items():
        out = F.when(source == name, F.lit(limits[which])).otherwise(out)
    return out


def age_s(observed_us: Column, as_of_us: int | Column, unit_us: int = 1_000_000) -> Column:
    """Age in units; up to SKEW_S ahead is 0, further ahead counts by its magnitude."""
    delta = (F.lit(as_of_us) - observed_us) / unit_us
    return F.when((delta < 0) & (delta >= -SKEW_S), F.lit(0.0)).otherwise(F.abs(delta))


def freshness(source: Column, age: Column, windows=WINDOWS, other=OTHER) -> Column:
    """live, stale or expired; each range takes its lower bound."""
    return F.when(age < window_s(source, 0, windows, other), "live").when(age < window_s(source, 1, windows, other), "stale").otherwise("expired")


def tier(fresh: Column, local_rf: Column) -> Column:
    return F.when(fresh == "expired", 4).when(local_rf, F.when(fresh == "live", 0).otherwise(2)).otherwise(F.when(fresh == "live", 1).otherwise(3))


def latest(observations: DataFrame, fields: list[str], as_of_us: int | None = None) -> DataFrame:
    """The newest observation of each identity and source (of equal ones the last to arrive), first_ord of the pair, and last_local_us."""
    rows = observations if as_of_us is None else observations.where(F.col("observed_us") <= as_of_us)
    order = F.struct("observed_us", "received_us", "ord")
    picked = F.max_by(F.struct("local_rf", "observed_us", "received_us", "ord", *fields), order).alias("r")
    local = F.max(F.when(F.col("local_rf"), F.col("observed_us"))).alias("last_local_us")
    out = rows.where("identity is not null").groupBy("identity", "source").agg(picked, F.min("ord").alias("first_ord"), local)
    return out.select("identity", "source", "first_ord", "last_local_us", "r.*")


def contributors(observations: DataFrame, fields: list[str], as_of_us: int, unit_us: int = 1_000_000, windows=WINDOWS, other=OTHER, prune: bool = True) -> DataFrame:
    """latest() with age, fresh and tier; pruned, without the expired ones."""
    rows = latest(observations, fields, as_of_us).withColumn("age", age_s(F.col("observed_us"), as_of_us, unit_us))
    rows = rows.withColumn("fresh", freshness(F.col("source"), F.col("age"), windows, other))
    rows = rows.withColumn("tier", tier(F.col("fresh"), F.col("local_rf"))).withColumn("expire", window_s(F.col("source"), 1, windows, other))
    return rows.where("fresh <> 'expired'") if prune else rows


def pick(field: str, dynamic: bool = True) -> Column:
    """(v, source, fresh) of the contributor that wins a field among those that have it: by tier, then newest, then source; metadata by newest, then source, without the expired."""
    rank = "struct(tier, -observed_us, source)" if dynamic else "struct(-observed_us, source)"
    alive = "" if dynamic else " and fresh <> 'expired'"
    return F.expr(f"min_by(struct({field} as v, source, fresh), {rank}) filter (where {field} is not null{alive})")


def fuse(contribs: DataFrame, dynamic: list[str], metadata: list[str], unit_us: int = 1_000_000) -> DataFrame:
    """One row an identity: each field's value, source and freshness; headline source, its track type; newest times; validity; local reception; count."""
    head = F.min_by("source", "first_ord").alias("first_source")
    first_type = F.min_by("track_type", "first_ord").alias("first_type")
    place = F.expr("min_by(struct(source, track_type), struct(tier, -observed_us, source)) filter (where position is not null)").alias("place")
    rows = contribs.groupBy("identity").agg(
        *[pick(f).alias(f"p_{f}") for f in dynamic], *[pick(f, False).alias(f"p_{f}") for f in metadata], head, first_type, place,
        F.max("observed_us").alias("observed_us"), F.max("received_us").alias("received_us"), F.max("expire").alias("expire"),
        F.max((F.col("local_rf") & (F.col("fresh") != "expired")).cast("int")).alias("local"), F.max("last_local_us").alias("last_local_us"), F.count("*").alias("fused_count"))
    values = [c for f in [*dynamic, *metadata] for c in (F.col(f"p_{f}.v").alias(f), F.col(f"p_{f}.source").alias(f"{f}_source"), F.col(f"p_{f}.fresh").alias(f"{f}_fresh"))]
    return rows.select(
        "identity", F.coalesce("place.source", "first_source").alias("source"), F.coalesce("place.track_type", "first_type").alias("track_type"), *values,
        "observed_us", "received_us", (F.col("observed_us") + (F.col("expire") * unit_us).cast("long")).alias("valid_until_us"), (F.col("local") == 1).alias("locally_received"), "last_local_us", "fused_count")


def merged_tags(contribs: DataFrame) -> DataFrame:
    """(identity, tags): sorted distinct."""
    return contribs.groupBy("identity").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))


def merged_attributes(contribs: DataFrame) -> DataFrame:
    """(identity, key, value): of each attribute, the contributor received last; the first of equals yields to later ones; `fusion` is dropped."""
    each = contribs.select("identity", "received_us", "first_ord", F.explode("attributes").alias("key", "value")).where("key <> 'fusion'")
    return each.groupBy("identity", "key").agg(F.max_by("value", F.struct("received_us", "first_ord")).alias("value"))


def merged_provenance(contribs: DataFrame) -> DataFrame:
    """(identity, provenance): one entry a source, sorted by it."""
    entry = F.struct("source", "observed_us", "received_us", "local_rf", "fresh")
    return contribs.groupBy("identity").agg(F.array_sort(F.collect_list(entry)).alias("provenance"))


def conflicts(contribs: DataFrame, fields: list[str]) -> DataFrame:
    """(identity, field, winner, source): a contributor not expired whose value is off the winner's, itself not expired, by more than the tolerance. Headings differ linearly.

    Winners and others come from one aggregation; nothing is joined back."""
    entry = F.struct("source", "fresh", *fields)
    rows = contribs.groupBy("identity").agg(*[pick(f).alias(f"p_{f}") for f in fields], F.collect_list(entry).alias("all"))
    parts = []
    for f in fields:
        if f == "position":
            off = lambda c, f=f: F.pow(c[f][0] - F.col(f"p_{f}.v")[0], F.lit(2)) + F.pow(c[f][1] - F.col(f"p_{f}.v")[1], F.lit(2)) > POSITION_TOLERANCE
        else:
            off = lambda c, f=f: F.abs(c[f] - F.col(f"p_{f}.v")) > TOLERANCE.get(f, 0.0)
        winner = F.col(f"p_{f}.source")
        others = F.filter("all", lambda c: (c["fresh"] != "expired") & (c["source"] != winner) & F.coalesce(off(c), F.lit(False)))  # noqa: B023
        alive = F.col(f"p_{f}.fresh") != "expired"
        parts.append(F.when(alive, F.transform(others, lambda c: F.struct(F.lit(f).alias("field"), winner.alias("winner"), c["source"].alias("source")))))  # noqa: B023
    told = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<struct<field:string,winner:string,source:string>>")) for p in parts]))
    return rows.select("identity", F.explode(told).alias("c")).select("identity", "c.*")
