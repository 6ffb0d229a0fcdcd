"""The URL filter; its models against brute force."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from trackweave.llm import urlfilter

RULES = (("block", "bad.com/"), ("allow", "good.com/"))


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)


def site_urls(n):
    """Labelled URLs of two sites that differ in their queries only, and others."""
    pick = random.Random(2)
    urls = [f"https://good.com/p{pick.randrange(9)}?article={pick.randrange(10**6)}" for _ in range(n)]
    urls += [f"https://bad.com/p{pick.randrange(9)}?casino=x{pick.randrange(10**6)}&\u00e9;({pick.randrange(99)})" for _ in range(n)]
    return urls


def brute_weights(labelled):
    """log P(accepted's) - log P(rejected's) of a text, by interpolated counts of every order."""
    orders, of = [], {}
    order = 0
    while True:
        counts = {flag: defaultdict(Counter) for flag in (True, False)}
        for text, flag in labelled:
            stream = [256, *text, 257]
            for at in range(max(1, order), len(stream)):
                counts[flag][tuple(stream[at - order : at])][stream[at]] += 1
        known = {c for flag in counts for c in counts[flag] if order == 0 or sum(sum(counts[f].get(c, {}).values()) for f in counts) >= urlfilter.EVIDENCE}
        if not known:
            break
        orders.append(order)
        of[order] = {flag: {c: counts[flag].get(c, Counter()) for c in known} for flag in counts}
        order = urlfilter.next_order(order)

    def log_p(text, flag):
        stream, total = [256, *text, 257], 0.0
        for at in range(1, len(stream)):
            p = 1 / urlfilter.SIZE
            for k in orders:
                after = of[k][flag].get(tuple(stream[at - k : at])) if k <= at else None
                if after:
                    p = (after[stream[at]] + len(after) * p) / (sum(after.values()) + len(after))
            total += math.log(p)
        return total

    return orders, lambda text: (log_p(text, True) - log_p(text, False)) / (len(text) + 1)


def test_model_brute_force(spark, monkeypatch):
    labelled = [(u.split("://")[1], "good" in u) for u in site_urls(40)]
    table = spark.createDataFrame(labelled, "_lm string, accepted boolean").repartition(3)
    texts = [t for t, _ in labelled[::7]] + ["", "good.com", "x" * 50, "other.org/p1?casino=x9", "other.org/p1?article=9", "\u00fc@"]
    orders, brute = brute_weights([(t.encode(), flag) for t, flag in labelled])
    urlfilter.common.importable(spark)
    model = urlfilter.weights(table)
    assert model[1] == orders and max(orders) > 8
    asked = spark.createDataFrame([(t,) for t in texts], "_lm string")
    by_hash = {r.h: r._lm for r in asked.select("_lm", F.xxhash64("_lm").alias("h")).collect()}
    told = {}
    for rows in (urlfilter.TABLE_ROWS, 0):
        monkeypatch.setattr(urlfilter, "TABLE_ROWS", rows)
        told[rows] = {by_hash[r.lm_hash]: r.score for r in urlfilter.scores(asked, model).collect()}
        assert set(told[rows]) == set(texts)
        assert all(abs(told[rows][t] / urlfilter.MICRO - brute(t.encode())) < 1e-4 for t in texts)
    assert told[0] == told[rows]


def test_query_and_fragment_count(spark):
    asked = ["https://other.org/p1?article=1234", "https://other.org/p1?casino=x1234&\u00e9;(12)", "https://other.org/p1#casino=x1234&\u00e9;(12)"]
    rows = urlfilter.url_report(pages(spark, site_urls(100) + asked), RULES).collect()
    good, bad, fragment = (next(r for r in rows if r.page_id == 200 + k) for k in range(3))
    assert good.host == bad.host == fragment.host and good.path == bad.path
    assert good.score > bad.score and good.score > fragment.score


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", *site_urls(30), "http://u.org/a", "http://u.org/a"]
    rows = sorted(urlfilter.url_report(pages(spark, urls), RULES).collect())
    assert len(rows) == len(urls) and [r.verdict for r in rows[:4]] == ["block"] * 4
    assert [r.verdict for r in rows[4:64]] == ["allow"] * 30 + ["block"] * 30
    assert rows[-1][1:] == rows[-2][1:]
    lone = urlfilter.url_report(pages(spark, ["http://good.com/x", "http://u.org/a", None]), RULES).collect()
    assert {r.page_id: (r.verdict, r.score) for r in lone} == {0: ("allow", None), 1: ("allow", None), 2: ("block", None)}
    assert urlfilter.url_report(pages(spark, urls).where("false"), RULES).count() == 0
    kept = urlfilter.url_filter(pages(spark, urls), RULES)
    assert kept.columns == ["page_id", "url"] and kept.where("url is null").isEmpty()


def held_out(spark, yes, no):
    return spark.createDataFrame([(True, s) for s in yes] + [(False, s) for s in no], "accepted boolean, score long").repartition(3)


def brute_threshold(yes, no):
    """The middle of the widest of the gaps between bins that part the classes best, drawn towards 0."""
    bins = sorted({s // urlfilter.BIN for s in [*yes, *no]})
    best = []
    for left, right in zip(bins, bins[1:]):
        cut = right * urlfilter.BIN
        error = sum(s < cut for s in yes) / len(yes) + sum(s >= cut for s in no) / len(no)
        best.append((error, left + 1 - right, (left + 1 + right) * urlfilter.BIN // 2))
    error, _, middle = min(best, default=(1, 0, 0))
    few = min(len(yes), len(no))
    return middle * few // (few + urlfilter.LEAN) if error < 1 else 0


def test_threshold_brute_force(spark):
    pick = random.Random(4)
    cases = [([1_101_000], [-107_297, -400_000]), ([5_000], [5_000]), ([-9_000], [9_000]), ([178_000, 300_500, 250_000] * 15, [-213_934] * 100 + [-900_000] * 6)]
    cases += [([pick.randrange(-40_000, 90_000) for _ in range(n)], [pick.randrange(-90_000, 40_000) for _ in range(m)]) for n, m in ((1, 30), (30, 1), (40, 60))]
    for yes, no in cases:
        assert urlfilter.threshold(held_out(spark, yes, no)) == brute_threshold(yes, no)
    assert urlfilter.threshold(held_out(spark, [7], [])) == urlfilter.threshold(held_out(spark, [], [7])) == 0


def test_threshold_lies_in_the_gap(spark):
    """One held-out URL doesn't carry the threshold to its own score; many take it to the middle of their gap."""
    lone = urlfilter.threshold(held_out(spark, [1_101_000], [-107_297] * 9))
    assert 0 < lone < 100_000
    many = urlfilter.threshold(held_out(spark, [800_000] * 2_000, [200_000] * 2_000))
    assert 480_000 < many < 510_000


def plain_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end : min([rest.index(c, end) for c in "?#" if c in rest[end:]], default=len(rest))]
    fits = [r for _, r in rules if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    rule = max(fits, key=len, default=None)
    return host, path, rule, next((v for v, r in rules if r == rule), None)


def test_rules_and_verdicts_against_plain_python(spark):
    urls = [f"https://{a}{h}{p}" for a in ("", "www.", "a.B.") for h in ("example.com", "Example.NET", "x.org", "com", "notexample.com", "de") for p in ("", "/", "/en/", "/en/7", "/en/71?x=/de/8", "/de/8#a", "/de/81", "/es/", "?/en/", "#/es/", "/EN/7")]
    urls += [None, "", "://", "x://y://z.com/en/", "http://u:p@b.com:80/en/", "http://a.com\n/en/", "http://\u00dc.com/en/", "http://com/en/" + "a" * 20_000, *site_urls(20)]
    rows = {r.page_id: r for r in urlfilter.url_report(pages(spark, urls).selectExpr("*", "'x' as host", "1 as score")).collect()}
    assert len(rows) == len(urls)
    for k, url in enumerate(urls):
        host, path, rule, verdict = plain_rule(url, urlfilter.RULES)
        r = rows[k]
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == (verdict or r.verdict) and (host + path or r.verdict == "block")
    undecided = {(r.host + r.path, r.score): set() for r in rows.values() if r.rule is None}
    for r in rows.values():
        if r.rule is None:
            undecided[r.host + r.path, r.score].add(r.verdict)
    assert all(len(v) == 1 for v in undecided.values())
    told = [(r.score, r.verdict) for r in rows.values() if r.rule is None and r.host + r.path]
    assert max((s for s, v in told if v == "block"), default=-1e18) < min((s for s, v in told if v == "allow"), default=1e18)
