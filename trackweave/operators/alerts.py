"""Alert rules over ordered ticks: 24 condition operators, evaluability, and the firing fold.

A rule is an AND of conditions. Each gives (level, evaluable): a tick that is not evaluable does nothing.
Ticks are rows of subject, t (microseconds), ord, subject_type and the fields that conditions name. A null
field counts as missing. Windows run per subject, and anew after each removal of it. Firing is a greedy
gate over the edges of a level, since an alert is open exactly from an edge that fired to the next one:
no subject's or group's edges are collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import gates

# fixed values: the names of the operators
STATELESS = ("equals", "not_equals", "in", "not_in", "greater_than", "less_than", "exists", "not_exists", "classification_basis", "local_rf", "source_stale", "source_offline")
CONTEXTUAL = ("changed_to", "changed_from", "entered_geofence", "exited_geofence", "geofence_intersects", "became_active", "culmination_reached", "count_within_window", "distance_below", "distance_above", "elevation_crossed", "watchlist")
DISCRETE = ("changed_to", "changed_from")


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: Any = None
    threshold: float | None = None
    window_us: int | None = None


@dataclass(frozen=True)
class Fence:
    """A circle (center and radius_m) or a polygon (rings of (lon, lat)), with an altitude band."""

    center: tuple[float, float] | None = None
    radius_m: float | None = None
    rings: tuple[tuple[tuple[float, float], ...], ...] | None = None
    low_m: float | None = None
    high_m: float | None = None

    def rings_column(self) -> Column:
        return F.array(*[F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ring]) for ring in self.rings or ()])

    def holds(self, lon: Column, lat: Column, alt: Column) -> Column:
        bound = lambda v: F.lit(v).cast("double")
        flat = geo.point_in_circle(lon, lat, *self.center, self.radius_m) if self.center else geo.point_in_polygon(lon, lat, self.rings_column())
        return flat & geo.in_altitude_band(alt, bound(self.low_m), bound(self.high_m))

    def meets(self, rings: Column) -> Column:
        """Whether any of some exterior rings overlaps the fence."""
        if self.center:
            return F.exists(rings, lambda r: geo.ring_intersects_circle(r, *self.center, self.radius_m))
        own = self.rings_column()[0]
        return F.exists(rings, lambda r: geo.rings_intersect(r, own))

    def reference(self) -> Column:
        return F.array(*map(F.lit, self.center)) if self.center else geo.vertex_mean(self.rings_column()[0])


@dataclass(frozen=True)
class Rule:
    id: str
    subject_types: tuple[str, ...]
    conditions: tuple[Condition, ...]
    transition: str = "enter"
    fence: Fence | None = None
    cooldown_us: int = 900_000_000
    enabled: bool = True
    severity: str = "medium"
    dedup_key: str | None = None


@dataclass(frozen=True)
class Context:
    """station: (lon, lat, altitude_m), None if not set; watchlist: keys of watched subjects."""

    station: tuple[float, float, float] | None = None
    watchlist: tuple[str, ...] = ()
    columns: dict = field(default_factory=dict)


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def stateless(c: Condition) -> Column:
    f = F.col(c.field) if c.operator not in ("source_stale", "source_offline") else F.col("status")
    wanted = c.value if isinstance(c.value, (list, tuple)) else [c.value]
    return {
        "equals": lambda: _yes(f == c.value), "classification_basis": lambda: _yes(f == c.value), "not_equals": lambda: ~_yes(f == c.value),
        "in": lambda: _yes(f.isin(*wanted)), "not_in": lambda: ~_yes(f.isin(*wanted)),
        "greater_than": lambda: _yes(f > F.lit(c.value)), "less_than": lambda: _yes(f < F.lit(c.value)),
        "exists": lambda: f.isNotNull(), "not_exists": lambda: f.isNull(), "local_rf": lambda: _yes(f) == F.lit(True if c.value is None else bool(c.value)),
        "source_stale": lambda: _yes(f == "stale"), "source_offline": lambda: _yes(f == "offline"),
    }[c.operator]()


def contextual(c: Condition, rule: Rule, ctx: Context, keys: tuple[str, ...] = ("subject",)) -> tuple[Column, Column]:
    """(level, evaluable), without count_within_window. The point of a tick is lon, lat and altitude_m; areas are in rings."""
    by = Window.partitionBy(*keys).orderBy("t", "ord")
    lon, lat, alt, fence = F.col("lon"), F.col("lat"), F.col("altitude_m"), rule.fence
    point = lon.isNotNull() & lat.isNotNull()
    if c.operator in DISCRETE:
        now, before, seen = F.col(c.field), F.lag(c.field).over(by), F.lag(F.lit(1)).over(by).isNotNull()
        return seen & ~before.eqNullSafe(now) & _yes((now if c.operator == "changed_to" else before) == c.value), F.lit(True)
    if c.operator in ("entered_geofence", "exited_geofence"):
        inside = _yes(fence.holds(lon, lat, alt)) if fence else F.lit(False)
        return inside if c.operator == "entered_geofence" else ~inside, point & F.lit(fence is not None)
    if c.operator == "geofence_intersects":
        return (_yes(fence.meets(F.col("rings"))) if fence else F.lit(False)), F.col("rings").isNotNull() & F.lit(fence is not None)
    if c.operator == "became_active":
        return _yes(F.col("valid_from_us") <= F.col("t")), F.col("valid_from_us").isNotNull()
    if c.operator == "culmination_reached":
        due = F.unix_micros(F.try_to_timestamp(F.col(c.field)))
        return _yes(F.col("t") >= due), due.isNotNull()
    if c.operator == "watchlist":
        listed = F.col("subject").isin(*ctx.watchlist) if ctx.watchlist else F.lit(False)
        return _yes(listed) == F.lit(True if c.value is None else bool(c.value)), F.lit(True)
    if c.operator in ("distance_below", "distance_above"):
        at = fence.reference() if fence else F.array(*map(F.lit, ctx.station[:2])) if ctx.station else None
        if at is None:
            return F.lit(False), F.lit(False)
        far = geo.haversine_m(lon, lat, at[0], at[1])
        return _yes(far < c.threshold if c.operator == "distance_below" else far > c.threshold), point
    if c.operator == "elevation_crossed":
        if not ctx.station:
            return F.lit(False), F.lit(False)
        angle = geo.elevation_deg(geo.haversine_m(lon, lat, *ctx.station[:2]), alt, ctx.station[2])
        return _yes(angle >= c.threshold), point & alt.isNotNull()
    raise ValueError(c.operator)


def counted(c: Condition, keys: tuple[str, ...] = ("subject",)) -> Column:
    """count_within_window over evaluable ticks with _level, the other conditions' level: the ticks up to this one on which they hold."""
    holds = F.col("_level").cast("int")
    near = F.sum(holds).over(Window.partitionBy(*keys).orderBy("t").rangeBetween(-(c.window_us or 0), 0))
    later = F.sum(holds).over(Window.partitionBy(*keys, "t").orderBy("ord").rowsBetween(1, Window.unboundedFollowing))
    return near - F.coalesce(later, F.lit(0)) >= F.lit(c.threshold or 0)


def evaluate(ticks: DataFrame, rule: Rule, ctx: Context = Context(), removals: DataFrame | None = None) -> DataFrame:
    """subject, t, ord, level and discrete of the evaluable ticks of the rule's subject types.

    Ticks that are not evaluable leave no trace: neither the last value of changed_to and changed_from
    nor the counts of count_within_window see them. Ticks of subject type `event`, and rules with changed_to
    or changed_from, are discrete. removals (subject, t, ord): where a subject went; its ticks after that
    know nothing of those before. They are in the result, with `removed`, and `epoch` numbers the lives."""
    out = ticks.where(F.col("subject_type").isin(*rule.subject_types)) if rule.enabled else ticks.where(F.lit(False))
    keys: tuple[str, ...] = ("subject",)
    gone = F.lit(False)
    if removals is not None:
        gone, keys = F.col("removed"), ("subject", "epoch")
        out = out.withColumn("removed", F.lit(False)).unionByName(removals.select("subject", "t", "ord", F.lit(True).alias("removed")), allowMissingColumns=True)
        before = Window.partitionBy("subject").orderBy("t", "ord").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("epoch", F.coalesce(F.sum(F.col("removed").cast("int")).over(before), F.lit(0)))
    counts = [c for c in rule.conditions if c.operator == "count_within_window"]
    rest = [c for c in rule.conditions if c.operator != "count_within_window"]
    leaves = [(stateless(c), F.lit(True)) if c.operator in STATELESS else contextual(c, rule, ctx, keys) for c in rest]
    level, fit = reduce(and_, [x for x, _ in leaves], F.lit(True)), reduce(and_, [x for _, x in leaves], F.lit(True))
    discrete = F.coalesce(F.col("subject_type") == "event", F.lit(False)) | F.lit(any(c.operator in DISCRETE for c in rule.conditions))
    # a removal is a life's last row, so the windows of other rows don't see it
    out = out.where(fit | gone).withColumn("_level", level & ~gone)
    if counts:
        out = out.withColumn("_level", F.col("_level") & reduce(and_, [counted(c, keys) for c in counts]))
    more = ["removed", "epoch"] if removals is not None else []
    return out.select("subject", "t", "ord", F.col("_level").alias("level"), discrete.alias("discrete"), *more)


#: Of a group that many subjects share, the rows of a slice of time are ordered in one task.
GROUP_SLICE_US = 86_400_000_000


def neighbour(rows: DataFrame, keys: list[str], value: Column, ahead: bool = False, slice_us: int | None = None) -> DataFrame:
    """rows with `_near`: value of the row before (or after) in order of t and ord, null at the ends.

    With slice_us the order is found slice by slice: a slice's first row gets what the slices before it end with, so a key of
    any number of rows is spread over the slices of its time."""
    shift = F.lead if ahead else F.lag
    if slice_us is None:
        return rows.withColumn("_near", shift(F.struct(value.alias("v"))).over(Window.partitionBy(*keys).orderBy("t", "ord"))["v"])
    cut = rows.withColumn("_s", F.floor(F.col("t") / slice_us))
    inside = cut.withColumn("_in", shift(F.struct(value.alias("v"))).over(Window.partitionBy(*keys, "_s").orderBy("t", "ord")))
    end = F.min_by if ahead else F.max_by
    ends = cut.groupBy(*keys, "_s").agg(end(F.struct(value.alias("v")), F.struct("t", "ord")).alias("_end"))  # a row a slice
    ends = ends.select(*[F.col(k).alias(f"_r{k}") for k in keys], F.col("_s").alias("_rs"), shift("_end").over(Window.partitionBy(*keys).orderBy("_s")).alias("_far"))
    same = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]
    both = inside.join(ends, [F.col("_s") == F.col("_rs"), *same], "left")
    return both.withColumn("_near", F.coalesce("_in", "_far")["v"]).select(*rows.columns, "_near")


def edges(levels: DataFrame, rule: Rule, keys: list[str], slice_us: int | None = None) -> DataFrame:
    """levels with `kind`: point (may fire, opens nothing), onset (may fire and open) or resolve; other ticks go."""
    rows = levels if "removed" in levels.columns else levels.withColumn("removed", F.lit(False))
    rows = neighbour(rows, keys, F.col("level"), slice_us=slice_us)
    now, before, gone = F.col("level"), F.coalesce("_near", F.lit(False)), F.col("removed")
    rise, fall = now & ~before, before & ~now
    discrete = F.when(now, "point")
    if rule.transition == "change":
        lasting = F.when((rise | fall) & ~gone, "point")
    elif rule.transition == "exit":
        lasting = F.when(fall, F.when(gone, "point").otherwise("onset")).when(rise, "resolve")
    else:
        lasting = F.when(rise, "onset").when(fall, "resolve")
    # a removal is an end of the level also where the ticks before it were lasting
    return rows.withColumn("kind", F.when(F.col("discrete") & ~gone, discrete).otherwise(lasting)).where("kind is not null").drop("_near")


def fire(levels: DataFrame, rule: Rule, gate: Column | None = None, slice_us: int = GROUP_SLICE_US) -> DataFrame:
    """(subject, t, ord, action): fired and resolved alerts in order. gate (of t): whether schedule and quiet hours let an alert fire.

    A level is remembered even where its alert was held back, so a held-back edge never fires later. A removal resolves the
    open alert of an enter rule; under an exit rule it fires once if the level held; then the subject starts anew. Subjects of
    a rule with a dedup_key are one group with one state, and stand under that key in the result; there a removal ends the
    level, and the group goes on. A group's ticks are taken in slices of time. Lasting and discrete ticks don't mix in a
    subject or group."""
    shared = rule.dedup_key is not None
    levels = levels.withColumn("subject", F.lit(rule.dedup_key)) if shared else levels
    keys = ["subject", "epoch"] if "epoch" in levels.columns and not shared else ["subject"]
    cut = slice_us if shared else None
    found = edges(levels, rule, keys, cut)
    following = F.struct("kind", "t", "ord")
    found = neighbour(found, keys, following, ahead=True, slice_us=cut)
    closes = F.when((F.col("kind") == "onset") & (F.col("_near.kind") == "resolve"), F.struct(F.col("_near.t").alias("t"), F.col("_near.ord").alias("ord")))
    may = found.where((F.col("kind") != "resolve") & (F.lit(True) if gate is None else gate)).select(*keys, "t", F.col("ord").cast("long").alias("ord"), closes["t"].alias("end_t"), closes["ord"].cast("long").alias("end_ord"))
    fired = gates.greedy(may, keys, "t", ["ord", "end_t", "end_ord"], F.lit(rule.cooldown_us))
    told = F.array(F.struct("t", "ord", F.lit("fire").alias("action")), F.struct(F.col("end_t").alias("t"), F.col("end_ord").alias("ord"), F.lit("resolve").alias("action")))
    return fired.select("subject", F.explode(told).alias("a")).select("subject", "a.*").where("t is not null")


def preview(ticks: DataFrame, rule: Rule, ctx: Context = Context()) -> DataFrame:
    """(evaluated, matched) over the newest tick of each subject; matched is null where nothing is evaluable."""
    found = evaluate(ticks, rule, ctx).groupBy("subject").agg(F.max_by("level", F.struct("t", "ord")).alias("level"))
    n = F.count("*")
    return found.agg(n.alias("evaluated"), F.when(n > 0, F.count_if("level")).alias("matched"))


def settle(alerts: DataFrame, thresholds: dict[str, str], drivers: tuple[str, ...]) -> DataFrame:
    """alert_id, channel, status of each pending channel (alerts: alert_id, severity, delivery map)."""
    from .filters import severity_meets

    each = alerts.select("alert_id", "severity", F.explode("delivery").alias("channel", "status")).where("status = 'pending'")
    meets = F.lit(True)
    for channel, least in thresholds.items():
        meets = F.when(F.col("channel") == channel, severity_meets(F.col("severity"), least)).otherwise(meets)
    out = F.when(F.col("channel") == "dashboard", "delivered").when(~meets, "suppressed").when(F.col("channel") == "browser", "delivered").when(F.col("channel").isin(*drivers), "delivered").otherwise("unconfigured")
    return each.select("alert_id", "channel", out.alias("status"))


def lifecycle(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """alert_id, state, acknowledged_us, resolved_us: the first acknowledgement is kept, the last resolution stamps. log: alert_id, action, at_us."""
    times = log.groupBy("alert_id").agg(F.min(F.when(F.col("action") == "ack", F.col("at_us"))).alias("acknowledged_us"), F.max(F.when(F.col("action") == "resolve", F.col("at_us"))).alias("resolved_us"))
    state = F.when(F.col("resolved_us").isNotNull(), "resolved").when(F.col("acknowledged_us").isNotNull(), "acknowledged").otherwise("active")
    return alerts.select("alert_id").join(times, "alert_id", "left").select("alert_id", state.alias("state"), "acknowledged_us", "resolved_us")
