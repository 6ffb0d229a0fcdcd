"""URL filter: rules first, then a ratio of two character language models.

URLs that a rule decides are the labelled ones: those it allows train the model of accepted URLs, those
it blocks that of rejected ones. Each is a variable-order Markov model over the bytes of the whole URL
after its scheme: lower-cased host, path, query and fragment. A context is in the model if it came
EVIDENCE times, however long it is, so contexts lengthen with the input; orders grow by halves until none
has that. Each order is smoothed with the one before by its number of distinct successors (Witten-Bell).
The score is the difference of the two log-likelihoods, divided by the length. One fifth of the labelled
URLs, by hash, is held out of training; the threshold is the middle of the gap in their scores that parts
accepted from rejected ones best, drawn towards 0 while few are held out (see `threshold`).

A log-likelihood is a sum over orders: of log P(byte | context) less that of the order before, which is
one weight a context for all bytes not seen after it, and one more a gram seen. So the model is a table
of (key, weight), kept by Spark and joined with the keys of each distinct URL; a table counted to have at
most TABLE_ROWS rows is looked up in place instead. Weights are whole micro-nats, so that sums do not depend on their order. Contexts
and grams are told apart by 64-bit hashes.

Defined results: a null url or one without `://` has an empty host and path, fits no rule and is blocked.
Where no labelled URL is held out of either class, the threshold is 0; where one class has none at all,
everything undecided is allowed. Ties go to allow. Repeated rows and null ids are judged row by row; an empty table gives an
empty one; extra columns are ignored by the report and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed rules of the registered query: verdict, then host and path prefix.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: A context of fewer labelled occurrences is left to shorter ones.
EVIDENCE = 4
#: Bytes, and what begins and ends a URL.
START, END, SIZE = 256, 257, 258
TABLE_ROWS = 200_000
FOLDS = 5
MICRO = 1_000_000
#: Width of the bins of scores that calibration looks at, and the weight, in URLs, of a threshold of 0.
BIN, LEAN = 1000, 20

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def host_of(url: Column) -> Column:
    return common.ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def best_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as a struct of its length, itself and its verdict; null if none does."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name, []).append((slash + rest, rule, verdict))
    if not by_host:
        return F.lit(None).cast("struct<n: int, rule: string, verdict: string>")
    table = F.create_map(*[x for name, told in by_host.items() for x in (F.lit(name), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for p, r, v in told]))])
    labels = F.split(host, "\\.")
    names = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(names, lambda n: table[n]), lambda x: x.isNotNull()))
    fits = F.filter(found, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def text_of(url: Column) -> Column:
    """What both models read: the lower-cased host and all that follows it."""
    return F.concat(host_of(url), F.regexp_extract(_rest(url), "(?s)^[^/?#]*(.*)", 1))


def next_order(order: int) -> int:
    return order + max(1, 1 << order.bit_length() >> 2)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Hashes of the contexts, and of the contexts with what follows, of each byte of each text and of its end."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
        stream = np.empty(sizes.sum(), np.uint64)
        starts = np.cumsum(sizes) - sizes
        inner = np.ones(len(stream), bool)
        inner[starts] = inner[starts + sizes - 1] = False
        stream[starts], stream[starts + sizes - 1] = START, END
        stream[inner] = np.frombuffer(b"".join(texts), np.uint8)
        powers = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(len(stream), base, np.uint64)])
        self.sums = np.r_[np.uint64(0), np.cumsum((stream + np.uint64(1)) * powers(_BASE)[:-1])]
        self.unshift = powers(_INVERSE)
        self.stream = stream
        self.at = np.delete(np.arange(len(stream)), starts)  # what is predicted: all but the starts
        self.text = np.repeat(np.arange(len(texts)), sizes - 1)
        self.before = self.at - starts[self.text]

    def keys(self, order: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, gram, number of the text), where `least` (by default `order`) symbols precede."""
        use = self.before >= (order if least is None else least)
        at = self.at[use]
        context = _mixed((self.sums[at] - self.sums[at - order]) * self.unshift[at - order] + np.uint64(order))
        gram = _mixed(context + (self.stream[at] + np.uint64(1)) * np.uint64(_BASE))
        return context.view(np.int64), gram.view(np.int64), self.text[use]


def gram_counts(urls: DataFrame, order: int, shorter: int) -> DataFrame:
    """(context, gram, up, yes, no) of labelled urls (_lm, accepted); up: the same gram in the order `shorter`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Grams(batch.column(0).to_pylist())
            context, gram, text = found.keys(order)
            up = found.keys(shorter, order)[1]
            label = np.array(batch.column(1).to_pylist(), bool)[text]
            _, first, which = np.unique(gram, return_index=True, return_inverse=True)
            counts = [np.bincount(which[label == flag], minlength=len(first)) for flag in (True, False)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (context[first], gram[first], up[first], *counts)], names=["context", "gram", "up", "yes", "no"])

    found = urls.select(F.col("_lm").cast("binary"), "accepted").mapInArrow(rows, "context long, gram long, up long, yes long, no long")
    return found.groupBy("context", "gram", "up").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def weights(urls: DataFrame) -> tuple[DataFrame, list[int]] | None:
    """(key, weight): micro-nats by which a context or gram speaks for acceptance, and the orders; None if labelled urls are of one class."""
    if urls.select("accepted").distinct().count() < 2:
        return None
    tables, orders, order, before = [], [], 0, None
    while True:
        grams = common.written(gram_counts(urls, order, orders[-1] if orders else 0), "url-grams")
        kinds = [F.sum((F.col(c) > 0).cast("long")).alias(f"kinds_{c}") for c in ("yes", "no")]
        contexts = grams.groupBy("context").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"), *kinds).where(F.col("all_yes") + F.col("all_no") >= (EVIDENCE if orders else 1))
        both = grams.join(contexts, "context")
        if before is None:
            both = both.withColumns({"up_yes": F.lit(1 / SIZE), "up_no": F.lit(1 / SIZE)})
        else:
            both = both.join(before.select(F.col("gram").alias("up"), F.col("p_yes").alias("up_yes"), F.col("p_no").alias("up_no")), "up")
        p = {c: F.when(F.col(f"all_{c}") > 0, (F.col(c) + F.col(f"kinds_{c}") * F.col(f"up_{c}")) / (F.col(f"all_{c}") + F.col(f"kinds_{c}"))).otherwise(F.col(f"up_{c}")) for c in ("yes", "no")}
        unseen = {c: F.when(F.col(f"all_{c}") > 0, F.log(F.col(f"kinds_{c}") / (F.col(f"all_{c}") + F.col(f"kinds_{c}")))).otherwise(0.0) for c in ("yes", "no")}
        both = both.withColumns({"p_yes": p["yes"], "p_no": p["no"], "unseen": F.round((unseen["yes"] - unseen["no"]) * MICRO).cast("long")})
        seen = F.round((F.log(F.col("p_yes") / F.col("up_yes")) - F.log(F.col("p_no") / F.col("up_no"))) * MICRO).cast("long")
        before = common.written(both.select("context", "gram", "p_yes", "p_no", "unseen", (seen - F.col("unseen")).alias("more")), "url-orders")
        if before.isEmpty():
            break
        tables += [before.select(F.col("gram").alias("key"), F.col("more").alias("weight")), before.select(F.col("context").alias("key"), F.col("unseen").alias("weight")).distinct()]
        orders.append(order)
        order = next_order(order)
    return common.written(reduce(DataFrame.unionByName, tables).where("weight <> 0"), "url-weights"), orders


def scores(urls: DataFrame, model: tuple[DataFrame, list[int]]) -> DataFrame:
    """(lm_hash, score) of each distinct `_lm`: micro-nats a byte; written."""
    table, orders = model

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, own = Grams(batch.column(1).to_pylist()), batch.column(0).to_numpy()
            for order in orders:
                context, gram, text = found.keys(order)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(own[text], 2)), pa.array(np.r_[context, gram])], names=["lm_hash", "key"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = held.value
        for batch in batches:
            found, total = Grams(batch.column(1).to_pylist()), np.zeros(batch.num_rows, np.int64)
            for order in orders:
                context, gram, text = found.keys(order)
                for key in (context, gram):
                    at = np.searchsorted(known, key)
                    value = np.where(known[at] == key, weight[at], 0)
                    total += np.bincount(text, value, batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total)], names=["lm_hash", "total"])

    each = urls.select(F.xxhash64("_lm").alias("lm_hash"), F.col("_lm").cast("binary").alias("_lm")).dropDuplicates(["lm_hash"])
    each = common.written(each, "url-texts")
    if table.limit(TABLE_ROWS + 1).count() <= TABLE_ROWS:  # looked up in place, which saves a row a key
        small = table.orderBy("key").toArrow()
        last = np.iinfo(np.int64).max
        held = urls.sparkSession.sparkContext.broadcast((np.r_[small.column("key").to_numpy(), last], np.r_[small.column("weight").to_numpy(), 0]))
        found = each.mapInArrow(totals, "lm_hash long, total long")
    else:
        found = each.mapInArrow(keys, "lm_hash long, key long").join(table, "key").groupBy("lm_hash").agg(F.sum("weight").alias("total"))
    score = F.floor(F.coalesce("total", F.lit(0)) / (F.octet_length("_lm") + 1)).cast("long")
    return common.written(each.join(found, "lm_hash", "left").select("lm_hash", score.alias("score")), "url-scores")


def threshold(held_out: DataFrame) -> int:
    """The score that parts held-out urls (accepted, score) best.

    Among the gaps between neighbouring bins that hold urls, it is the middle of the one whose error
    (share of accepted urls below plus share of rejected ones above) is least; of equal ones the widest,
    then the lowest. While few are held out that middle says little, so it is drawn towards 0, where the
    two models find a url equally likely, with the weight of LEAN urls against those of the rarer class.
    It is 0 if a class is missing or no gap is better than none.
    """
    of_class = lambda flag: F.count_if(F.col("accepted") == flag)
    bins = held_out.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(of_class(True).alias("yes"), of_class(False).alias("no")).orderBy("bin").collect()
    n_yes, n_no = sum(r.yes for r in bins), sum(r.no for r in bins)
    if not n_yes or not n_no:
        return 0
    best, lost, caught = (1.0, 0, 0), 0, 0
    for left, right in zip(bins, bins[1:]):
        lost, caught = lost + left.yes, caught + left.no
        error = lost / n_yes + 1 - caught / n_no
        if error < 1:
            best = min(best, (error, left.bin + 1 - right.bin, (left.bin + 1 + right.bin) * BIN // 2))
    few = min(n_yes, n_no)
    return int(best[2] * few // (few + LEAN))


def judged(pages: DataFrame, keep: list[str], rules=RULES) -> DataFrame:
    """The columns in keep, with host, path, rule, verdict, score."""
    common.importable(pages.sparkSession)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    own = pages.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"), F.xxhash64(text_of(F.col("url"))).alias("lm_hash"), (F.concat(host, path) == "").alias("_empty"))
    own = own.withColumn("_rule", best_rule(F.col("host"), F.col("path"), rules))
    told = pages.select(text_of(F.col("url")).alias("_lm"), best_rule(host, path, rules).alias("_rule"))
    labelled = told.where("_rule is not null").select("_lm", (F.col("_rule.verdict") == "allow").alias("accepted"), F.xxhash64("_lm").alias("lm_hash"))
    labelled = common.written(labelled.withColumn("fold", F.pmod("lm_hash", F.lit(FOLDS))), "url-labels")
    model = weights(labelled.where("fold > 0"))
    if model is None:
        scored, part = own.withColumn("score", F.lit(None).cast("long")), 0
    else:
        found = scores(told, model)
        part = threshold(labelled.where("fold = 0").join(common.small(found), "lm_hash"))
        scored = own.join(common.small(found), "lm_hash", "left")
    fine = F.when(F.col("_empty"), F.lit(False)).otherwise(F.coalesce(F.col("score") >= part, F.lit(True)))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(fine, F.lit("allow")).otherwise(F.lit("block")))
    return scored.select(*keep, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")


def url_report(pages: DataFrame, rules=RULES) -> DataFrame:
    return judged(pages, ["page_id"], rules)


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """The pages that are allowed, with their own columns."""
    held = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_page"), "url")
    return judged(held, ["_page"], rules).where("verdict = 'allow'").select("_page.*")
