"""History, replay, retention and changelogs of observation logs."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def track_history(rows: DataFrame, identity: str, start_us: int, end_us: int, limit: int) -> DataFrame:
    """The newest `limit` rows of an identity in [start, end), oldest first."""
    found = rows.where((F.col("identity") == identity) & (F.col("observed_us") >= start_us) & (F.col("observed_us") < end_us))
    return found.orderBy(F.desc("observed_us"), F.desc("obs_id")).limit(limit).orderBy("observed_us", "obs_id")


def replay_window(rows: DataFrame, start_us: int, end_us: int, limit: int, sources: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The earliest `limit` rows in [start, end), and one row `truncated`."""
    found = rows.where((F.col("observed_us") >= start_us) & (F.col("observed_us") < end_us))
    found = found if sources is None else found.where(F.col("source").isin(*sources)) if sources else found.where(F.lit(False))
    more = found.orderBy("observed_us", "obs_id").limit(limit + 1)
    return more.orderBy("observed_us", "obs_id").limit(limit), more.agg((F.count("*") > limit).alias("truncated"))


def visible_at(rows: DataFrame, cursor_us: int, expire_us: Column) -> DataFrame:
    """The last row of each identity at or before the cursor whose age is expire_us at most; the age is tested first."""
    fit = rows.where((F.col("observed_us") <= cursor_us) & (F.lit(cursor_us) - F.col("observed_us") <= expire_us))
    best = F.max_by(F.struct(*[c for c in rows.columns if c != "identity"]), F.struct("observed_us", "ord")).alias("r")
    return fit.groupBy("identity").agg(best).select("identity", "r.*")


def older_than(rows: DataFrame, cutoff_us: int) -> DataFrame:
    return rows.where(F.col("observed_us") < cutoff_us)


def downsampled(rows: DataFrame, cutoff_us: int, gap_us: int) -> DataFrame:
    """Rows younger than the cutoff, and of the others the lowest id of each identity and bucket."""
    old = F.col("observed_us") < cutoff_us
    bucket = F.floor(F.col("observed_us") / gap_us)
    keep = rows.where(old).groupBy("identity", bucket.alias("bucket")).agg(F.min("obs_id").alias("obs_id")).select("obs_id")
    return rows.where(~old).unionByName(rows.where(old).join(keep, "obs_id", "left_semi").select(*rows.columns))


def without_oldest(rows: DataFrame, n: int) -> DataFrame:
    """rows without the n oldest; ties go by id.

    The rows of each second are counted first: seconds that go whole take no sort, and only the rows of the second
    in which the n-th lies are put in order. The second is found from slices of a day, then from those of its seconds."""
    if n <= 0:
        return rows
    cut, left = None, n
    for span in (86_400_000_000, 1_000_000):
        within = rows if cut is None else rows.where((F.col("observed_us") >= cut) & (F.col("observed_us") < cut + 86_400_000_000))
        counts = within.where("observed_us is not null").groupBy(F.floor(F.col("observed_us") / span).alias("at")).agg(F.count("*").alias("n"))
        upto = counts.select("at", "n", F.sum("n").over(Window.orderBy("at")).alias("upto")).where(F.col("upto") >= left).orderBy("at").first()
        if upto is None:  # fewer rows than n
            return rows.where("observed_us is null")
        cut, left = upto["at"] * span, left - (upto["upto"] - upto["n"])
    border = (F.col("observed_us") >= cut) & (F.col("observed_us") < cut + 1_000_000)
    oldest = rows.where(border).select("obs_id", "observed_us").orderBy("observed_us", "obs_id").limit(left).select("obs_id")
    later = rows.where((F.col("observed_us") >= cut + 1_000_000) | F.col("observed_us").isNull())
    return later.unionByName(rows.where(border).join(oldest, "obs_id", "left_anti").select(*rows.columns))


@dataclass(frozen=True)
class Retention:
    """max_bytes 0: no budget; min_free 0: no floor of free disk. row_bytes: what a stored row takes."""

    days: int
    max_bytes: int
    row_bytes: int
    min_free: int = 0
    least_rows: int = 5_000
    high: float = 0.85
    critical: float = 0.95

    def pressure(self, size: int, free: int | None) -> str:
        """critical, high or none."""
        if self.min_free and free is not None and free <= self.min_free or self.max_bytes and size >= self.max_bytes * self.critical:
            return "critical"
        return "high" if self.max_bytes and size >= self.max_bytes * self.high else "none"


DAY_US, ATTEMPTS, THIN_AFTER_DAYS, THIN_US = 86_400_000_000, 4, 1, 30_000_000


def retention_ladder(rows: DataFrame, now_us: int, policy: Retention, free: int | None = None) -> tuple[DataFrame, dict]:
    """What one sweep keeps, and its report: pressure, rows before and after, how many each step took, effective days.

    Rows older than the window always go. Under pressure, told by the size before the sweep, rows older than a day are
    thinned to one in 30 s of an identity. Then, at most four times and until there is no pressure: the oldest go down to
    the high mark if the size is above it; else the window is halved, down to a day; else the oldest `least_rows` go.
    Free disk grows by what goes. Rows are filtered and never numbered as a whole; the driver sees counts alone."""
    before = kept = rows.count()
    out, took, days = older_kept(rows, now_us - policy.days * DAY_US), {"expired": 0, "thinned": 0, "oldest": 0}, policy.days

    def settle(step: str) -> None:
        nonlocal kept
        n = out.count()
        took[step], kept = took[step] + kept - n, n

    settle("expired")
    free_now = lambda: None if free is None else free + (before - kept) * policy.row_bytes
    pressure = policy.pressure(before * policy.row_bytes, free)
    if pressure != "none":
        out = downsampled(out, now_us - THIN_AFTER_DAYS * DAY_US, THIN_US)
        settle("thinned")
        for _ in range(ATTEMPTS):
            size, mark = kept * policy.row_bytes, policy.max_bytes * policy.high
            if policy.pressure(size, free_now()) == "none" or not kept:
                break
            if policy.max_bytes and size > mark:
                out = without_oldest(out, min(kept, max(policy.least_rows, math.ceil((size - mark) / policy.row_bytes))))
                settle("oldest")
            elif days > 1:
                days = max(1, days // 2)
                out = older_kept(out, now_us - days * DAY_US)
                settle("expired")
            else:
                out = without_oldest(out, policy.least_rows)
                settle("oldest")
    return out, {"pressure": pressure, "rows_before": before, "rows_after": kept, **took, "days": days}


def pressure_records(report: dict, now_us: int) -> list[dict]:
    """The status and the event that a sweep under pressure gives; none without pressure."""
    if report["pressure"] == "none":
        return []
    told = f"{report['pressure']} pressure: {report['rows_before']} rows before, {report['rows_after']} after; {report['expired']} expired, {report['thinned']} thinned, {report['oldest']} oldest; {report['days']} days"
    common = {"source": "retention", "observed_us": now_us, "code": "storage_pressure", "summary": told}
    severity = "critical" if report["pressure"] == "critical" else "warning"
    return [{"kind": "source_status", "status": "degraded", "severity": None, **common}, {"kind": "event", "status": None, "severity": severity, **common}]


def older_kept(rows: DataFrame, cutoff_us: int) -> DataFrame:
    """rows but those before the cutoff; such without a time stay."""
    return rows.where(F.coalesce(F.col("observed_us") >= cutoff_us, F.lit(True)))


def pressure(size: int, limit: int, free: int, floor: int) -> str:
    """critical, high or ok."""
    if free <= floor or size >= limit * 0.95:
        return "critical"
    return "high" if size >= limit * 0.85 else "ok"


def write_history(rows: DataFrame, path: str) -> None:
    """Append, partitioned by UTC day; rows of a day go to as many tasks as adaptive execution finds fit."""
    day = F.to_date(F.timestamp_micros("observed_us"))
    rows.withColumn("obs_date", day).hint("rebalance", "obs_date").write.mode("append").partitionBy("obs_date").parquet(path)


#: Columns of a stored observation beside its payload.
STORED = ("record_id", "correlation_key", "kind", "track_type", "source", "lon", "lat", "altitude_m", "observed_us", "received_us")


def flattened(tracks: DataFrame, persisted_us: Column) -> DataFrame:
    """Tracks as rows of the store: STORED (null where a track has no such column), persisted_us, and the whole track as JSON in payload.

    Rows of other kinds, if there is a column `kind`, are not stored."""
    own = tracks.where("kind = 'track'") if "kind" in tracks.columns else tracks.withColumn("kind", F.lit("track"))
    kinds = dict.fromkeys(("lon", "lat", "altitude_m"), "double") | dict.fromkeys(("observed_us", "received_us"), "long")
    held = [F.col(c) if c in own.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in STORED]
    return own.select(*held, persisted_us.alias("persisted_us"), F.to_json(F.struct(*own.columns)).alias("payload"))


def reconstructed(rows: DataFrame, schema: str, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(tracks, skipped rows) of stored payloads read as `schema`. A payload that is no such JSON, or lacks a needed field, is skipped; the rest of its window is not."""
    read = rows.withColumn("_r", F.from_json("payload", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    whole = F.col("_r").isNotNull() & F.col("_r._bad").isNull()
    for c in needed:
        whole = whole & F.col(f"_r.{c}").isNotNull()
    return read.where(whole).select("_r.*").drop("_bad"), read.where(~whole).select(*rows.columns)


def merged(*feeds: DataFrame) -> DataFrame:
    """Rows of several feeds as one; a column that a feed doesn't have is null in its rows."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with rows replaced by key; of several changes of a key, that of the highest seq."""
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in table.columns if c != key]), "seq").alias("r")).select(key, "r.*").select(*table.columns)
    return table.join(newest.select(key), key, "left_anti").select(*table.columns).unionByName(newest)


def insert_ignore(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.unionByName(rows.join(table.select(key), key, "left_anti").select(*table.columns))


def patch(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Null in a change means unchanged; changes hold one row a key."""
    own = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in table.columns if c != key])
    both = table.join(own, table[key] == own["_k"], "left")
    return both.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in table.columns if c != key])


def numbered(changes: DataFrame, order: list[str], key: str, member: Column) -> DataFrame:
    """Per key (a connection), the changes that its filter lets through with cseq from 1; a removal only of what was sent and is not yet removed."""
    sent = F.when(member & (F.col("op") == "upsert"), F.lit(1))
    by = Window.partitionBy(key, "record").orderBy(*order)
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op") == "remove", F.lit(0)).when(sent.isNotNull(), F.lit(1)), ignorenulls=True).over(earlier)
    passed = changes.withColumn("_pass", F.when(F.col("op") == "remove", F.coalesce(last, F.lit(0)) == 1).otherwise(member)).where("_pass").drop("_pass")
    return passed.withColumn("cseq", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def gaps(frames: DataFrame, key: str, order: list[str]) -> DataFrame:
    """frames with `arrival`: duplicate (cseq not beyond the highest so far), gap (beyond the next), or next."""
    before = F.max("cseq").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    arrival = F.when(F.col("cseq") <= before, "duplicate").when(F.col("cseq") != before + 1, "gap").otherwise("next")
    return frames.withColumn("arrival", arrival)


def routed(records: DataFrame) -> DataFrame:
    """records with topic, qos and retain: statuses are retained on a topic of their own, tracks may be lost."""
    status = F.col("kind") == "source_status"
    topic = F.concat(F.lit("status/"), F.col("source"))
    return records.withColumns({"topic": F.when(status, topic).otherwise(F.concat(F.lit("records/"), F.col("source"))), "qos": F.when(F.col("kind") == "track", 0).otherwise(1), "retain": status})
