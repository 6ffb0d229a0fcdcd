"""Quality rules with thresholds that adapt to each language and source.

Counts per document are array expressions over its own words, so nothing is shuffled for them.
Thresholds come from mergeable quantile sketches: a non-negative integer metric falls into a
logarithmic bucket (its 7 leading bits: relative error under 1/64), a sketch is the bucket counts,
and sketches merge by adding counts, whatever the order. They are kept per (lang, source). To each, the
sketch of its language is merged with the weight of PRIOR documents, and to that the sketch of all
documents likewise, so that small groups lean on wider ones without a switch. A metric's upper limit is
an upper quantile of the group's sketch, its distance from the median beyond, and a small slack; the
quantile leaves room for the share of documents that may be bad by that metric. Partial aggregation
runs before the shuffle, so a source that holds a third of all rows costs one row a bucket and task.

Defined results: null text counts as empty (0 words, base_failed). Null lang or source is a group
of its own. Repeated rows are judged alike, each in its own row. An empty table gives an empty one.
Extra columns of any name stay untouched in filtered documents and are ignored by the query.
Two different 5-word windows are taken as equal if their 64-bit hashes meet (about n^2 / 2^65).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
#: The weight in documents of the next wider sketch, and the unit of weights.
PRIOR, UNIT = 20, 10**12
#: Metric -> (upper quantile in per cent, slack in per mille or hundredths, whether low values are outliers too).
METRICS = {"symbol_pm": (90, 20, False), "repeat_pm": (99, 20, False), "dup_line_pm": (99, 50, False), "word_len_c": (95, 50, True)}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column) -> Column:
    """How many words lie in 5-word windows found twice or more."""

    def covered(windows: Column) -> Column:
        def flagged(s: Column) -> Column:
            near = lambda i: F.get(s, i)["h"]
            at = F.transform(s, lambda x, i: F.when((x["h"] == near(i - 1)) | (x["h"] == near(i + 1)), x["i"]))
            return F.sort_array(F.filter(at, lambda x: x.isNotNull()))

        spots = common.let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), flagged)
        zero = F.struct(F.lit(-5).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda a, x: F.struct((x + 5).alias("end"), (a["n"] + 5 - F.greatest(F.lit(0), a["end"] - x)).alias("n"))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.aggregate(spots, zero, step)["n"]).otherwise(F.lit(0).cast("long"))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))
    return F.when(F.size(words) > 5, common.let(common.let(hashed, windows), covered)).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The columns in keep, and one struct `_q` of the counts and metrics of each document."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, "[ \\t-\\r]+"), "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))

    def counts(w: Column) -> Column:
        n = F.size(w).cast("long")
        chars = F.length(F.array_join(w, "")).cast("long")
        symbols = F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")).cast("long")
        return F.struct(n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), _repeat_words(w).alias("n_repeat_words"))

    of_lines = common.let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    q = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(lang).alias("_lang"), F.col(source).alias("_source"), common.let(words, counts).alias("_c"), of_lines.alias("_l"))
    n, chars = F.col("_c.n_words"), F.col("_c.word_chars")
    per = lambda a, b: F.coalesce(F.expr(f"({a}) div nullif({b}, 0)"), F.lit(0)).cast("long")
    fields = [F.col(f"_l.{c}" if c == "n_dup_lines" else f"_c.{c}").alias(c) for c in BASE]
    fields += [((n < MIN_WORDS) | (100 * F.col("_c.n_repeat_words") > REPEAT_PERCENT * n)).alias("base_failed")]
    fields += [per("1000 * _c.n_symbols", "_c.word_chars").alias("symbol_pm"), per("1000 * _c.n_repeat_words", "_c.n_words").alias("repeat_pm")]
    fields += [per("1000 * _l.n_dup_lines", "_l.n_lines").alias("dup_line_pm"), per("100 * _c.word_chars", "_c.n_words").alias("word_len_c")]
    return q.select(*keep, "_lang", "_source", F.struct(*fields).alias("_q"))


def bucket(v: Column) -> Column:
    """The lower bound of v's bucket: its 7 leading bits."""
    drop = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) over the documents that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(f"_q.{m}")).alias("bucket")) for m in METRICS]))
    rows = measured.where(~F.col("_q.base_failed")).select(F.col("_lang").alias("lang"), F.col("_source").alias("source"), each.alias("e"))
    return rows.groupBy("lang", "source", "e.metric", "e.bucket").agg(F.count("*").alias("n"))


def weighted(sketch: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, w): the sketch of each group with its language's and everything's merged in, in whole weights."""
    big = lambda c: c.cast("decimal(38,0)")
    groups = common.written(sketch.where(F.col("metric") == next(iter(METRICS))).groupBy("lang", "source").agg(F.sum("n").alias("n_group")), "quality-groups")
    langs = groups.groupBy(F.col("lang").alias("l")).agg(F.sum("n_group").alias("n_lang"))
    total = groups.agg(F.sum("n_group")).first()[0] or 1
    share = groups.join(langs, F.col("lang").eqNullSafe(F.col("l"))).select("lang", "source", F.expr(f"cast({PRIOR} * {UNIT} div (n_lang + {PRIOR}) as bigint)").alias("w_lang"))
    share = share.select("*", F.expr(f"cast(w_lang * {PRIOR} div {total} as bigint)").alias("w_all"))
    own = sketch.select("lang", "source", "metric", "bucket", (big(F.col("n")) * F.lit(UNIT)).alias("w"))
    merged = lambda *by: sketch.groupBy(*by).agg(F.sum("n").alias("n"))
    of_lang = merged(F.col("lang").alias("l"), "metric", "bucket").join(share, F.col("lang").eqNullSafe(F.col("l"))).select("lang", "source", "metric", "bucket", (big(F.col("n")) * F.col("w_lang")).alias("w"))
    # at most a few hundred buckets a metric, however many documents
    of_all = share.withColumn("m", F.explode(F.array(*map(F.lit, METRICS)))).join(F.broadcast(merged("metric", "bucket")), F.col("m") == F.col("metric"))
    of_all = of_all.select("lang", "source", "metric", "bucket", (big(F.col("n")) * F.col("w_all")).alias("w"))
    return own.unionByName(of_lang).unionByName(of_all).groupBy("lang", "source", "metric", "bucket").agg(big(F.sum("w")).alias("w"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(t_lang, t_source, t): low and high of every metric."""
    keys = ["lang", "source", "metric"]
    by = Window.partitionBy(*keys)
    run = weighted(sketch).withColumns({"upto": F.sum("w").over(by.orderBy("bucket")), "total": F.sum("w").over(by)})
    at = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bucket")))
    per_metric = lambda of: F.element_at(F.create_map(*[F.lit(x) for m, v in METRICS.items() for x in (m, of(v))]), F.col("metric"))
    found = run.groupBy(*keys).agg(at(per_metric(lambda v: v[0])).alias("top"), at(50).alias("mid"), at(100 - per_metric(lambda v: v[0])).alias("bottom"))
    slack, both = per_metric(lambda v: v[1]), per_metric(lambda v: v[2])
    limits = found.select(*keys, (2 * F.col("top") - F.col("mid") + slack).alias("high"), F.when(both, 2 * F.col("bottom") - F.col("mid") - slack).alias("low"))
    ends = [F.max(F.when(F.col("metric") == m, F.col(end))).alias(f"{end}_{m}") for end in ("high", "low") for m in METRICS]
    row = limits.groupBy("lang", "source").agg(*ends)
    return row.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), F.struct(*[F.col(f"{end}_{m}") for end in ("high", "low") for m in METRICS]).alias("t"))


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured with `_kept`: within the base rules and all fences of its group. Groups without a sketch have no document that passes the base rules."""
    bad = F.lit(False)
    for m, (_, _, both) in METRICS.items():
        v = F.col(f"_q.{m}")
        bad = bad | (v > F.col(f"t.high_{m}"))
        if both:
            bad = bad | (v < F.col(f"t.low_{m}"))
    on = measured["_lang"].eqNullSafe(limits["t_lang"]) & measured["_source"].eqNullSafe(limits["t_source"])
    return measured.join(common.small(limits), on, "left").withColumn("_kept", ~F.col("_q.base_failed") & ~F.coalesce(bad, F.lit(False)))


def limits_of(measured: DataFrame) -> DataFrame:
    return common.written(thresholds(sketches(measured)), "quality-limits")


def quality_rules(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. Measured once: the rows are written with their measures, of which alone the sketches read."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("_text"), F.col("lang").alias("_dl"), F.col("source").alias("_ds"))
    measured = common.written(measures(held, ["_doc"], "_text", "_dl", "_ds"), "quality-measures")
    return judged(measured, limits_of(measured)).where("_kept").select("_doc.*")


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the metrics."""
    measured = common.written(measures(docs, ["doc_id"]), "quality-measures")
    q = [F.col(f"_q.{c}") for c in (*BASE, "base_failed")]
    return judged(measured, limits_of(measured)).select("doc_id", *q, F.col("_kept").alias("kept"), *[F.col(f"_q.{m}") for m in METRICS])
