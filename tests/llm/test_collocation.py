"""Collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from trackweave.llm import collocation

from .conftest import edge_rows, prose

KIND = "doc_id long, text string, lang string, n long, f long, w long, word string, rank string, score double"


def brute(docs, top=collocation.TOP):
    f, out = defaultdict(Counter), []
    for text, lang in docs:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, count in f.items():
        n = sum(c for g, c in count.items() if len(g) == 1)
        rows = []
        for g, a in count.items():
            if len(g) == 1 or a < 10:
                continue
            if len(g) == 2 and any(100 * c >= 50 * a for h, c in count.items() if len(h) == 3 and c >= 10 and g in (h[:2], h[1:])):
                continue
            s, _, left, right = min((10**6 * a * a // (count[g[:k]] * count[g[k:]]), k, count[g[:k]], count[g[k:]]) for k in range(1, len(g)))
            rows.append((-s, -a, " ".join(g).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def repeated_phrases():
    pick = random.Random(4)
    phrases = ["new york city", "Big Data", "é ü", "the the the the", "a\x0bb c", "one, two", "tab\tbed now", "x" * 3000 + " long"]
    rows = []
    for k in range(120):
        text = " ".join(pick.choice([*phrases, prose(k, 3, 30), "of the", "\n", ". "]) for _ in range(pick.randint(0, 40)))
        rows.append((k, text, pick.choice(["en", "fr", None, "und"]), 1, 2, 3, "w", "r", 0.5))
    return [*rows, rows[3], rows[3], (None, None, None, None, None, None, None, None, None), (5, "", "", 1, 1, 1, "", "", 0.0)]


def found(df, **more):
    rows = collocation.collocations(df, **more)
    assert rows.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in rows.collect())


def test_brute_force(spark):
    rows = repeated_phrases()
    df = spark.createDataFrame(rows, KIND).repartition(3)
    want = brute([(r[1], r[2]) for r in rows])
    assert len(want) > 50 and found(df) == want
    assert found(df, top=7) == brute([(r[1], r[2]) for r in rows], 7)


def test_many_small_tries_and_full_bitmaps(spark):
    """Tries of a few words, and bitmaps that let everything pass, change nothing."""
    rows = [(r[1], r[2]) for r in repeated_phrases()]
    full = np.full(1024, -1, np.int64)
    words, pieces = [], []
    for text, _ in rows:
        own = collocation.Pieces()
        own.add(text)
        w, p, _ = own.take("en")
        words.append(w)
        pieces.append(p + (pieces[-1][-1] + 1 if pieces and len(pieces[-1]) else 10**6 * len(pieces)))
    whole, _ = collocation.grown(np.concatenate(words), np.concatenate(pieces), 3, full, full)
    parts = [collocation.grown(w, p, 3, full, full)[0] for w, p in zip(words, pieces, strict=True) if len(w)]
    as_set = lambda path: set(zip(*(x.tolist() for x in path), strict=True))
    assert as_set(whole) == set().union(*map(as_set, parts))
    assert all((np.diff(x[0].astype(object)) >= 0).all() for x in parts)


def test_edges(spark, docs, no_docs):
    assert found(docs) == brute([(r[1], r[2]) for r in edge_rows()])
    assert found(no_docs) == []


def test_bitmaps_miss_nothing(spark):
    nodes = spark.range(5000).selectExpr("xxhash64(id) as w1", "xxhash64(id, 7) as w2", "id")
    bits = collocation.alive(nodes.where("id % 2 = 0"), collocation.pair_bit())
    rows = nodes.toPandas()
    hit = collocation.has(bits, collocation.pair_spot(rows.w1.to_numpy().view(np.uint64), rows.w2.to_numpy().view(np.uint64)))
    assert hit[rows.id % 2 == 0].all() and hit[rows.id % 2 == 1].mean() < 0.2


def test_products_pass_64_bits(spark):
    row = spark.sql("select 9000000000000L as a, 9000000000001L as l, 9500000000000L as r").select(collocation.score("a", "l", "r").alias("s")).first()
    assert row.s == 10**6 * 9000000000000**2 // (9000000000001 * 9500000000000)
