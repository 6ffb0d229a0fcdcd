"""Operators that compare documents: near-duplicates, decontamination, line dedup; against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackweave.llm import decontam, linededup, neardup, ragged

from .conftest import edge_rows, prose

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k is None, k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)) if rows else []


def near_corpus():
    """Chains of edits, a star of copies whose copies are not all alike, and unrelated texts that share a passage."""
    pick, rows = random.Random(5), []
    for g in range(6):
        words = prose(100 + g, 120).split(" ")
        for _ in range(8):
            rows.append(" ".join(words))
            words = list(words)
            words[pick.randrange(len(words))] = f"e{pick.random()}"
    base = prose(300, 200).split(" ")
    for _ in range(40):
        words = list(base)
        for _ in range(4):
            words[pick.randrange(200)] = f"x{pick.random()}"
        rows.append(" ".join(words))
    shared = prose(400, 60)
    rows += [f"{prose(500 + k, 60)} {shared}" for k in range(30)]
    return [(k * 3 + 1, t) for k, t in enumerate(rows)]


def test_near_duplicates_brute_force(spark):
    rows = near_corpus()
    got = neardup.near_dup_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edges(docs, no_docs):
    rows = [(r[0], r[1]) for r in edge_rows()]
    got = neardup.near_dup_report(docs).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    mine = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key)
    want = sorted((r[1:] for r in [(k is None, k, n, c) for _, k, n, c in brute(rows)]), key=key)
    assert mine == want
    assert neardup.near_dup_report(no_docs).count() == 0
    kept = neardup.near_dedup(docs)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert left.count(8) == 1 and 9 not in left and 10 not in left and {0, 1, 2} <= set(left)


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            old, new = group[a], group[b]
            group = [new if g == old else g for g in group]
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((None, k, len(sets[i]), (min(ids) if ids else None) if sets[i] else k))
    return out


def test_sketches_fill_and_estimate():
    texts = [prose(1, 3), prose(2, 30), prose(3, 900)]
    owner, found, sizes = neardup.shingle_sets([*texts, None])
    coordinates = neardup.sketch(owner, found, 4)
    assert (coordinates[:3] != neardup.EMPTY).all() and (coordinates[3] == neardup.EMPTY).all()
    words = prose(9, 1000).split(" ")
    a, b = " ".join(words[:900]), " ".join(words[100:])
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    owner, found, _ = neardup.shingle_sets([a, b])
    one, two = neardup.sketch(owner, found, 2)
    assert abs((one == two).mean() - true) < 0.1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aBc é\n\t.9", max_size=30), max_size=6))
def test_ragged_words(texts):
    for table, pattern in ((ragged.SPACED, r"[^\x20\x09-\x0D]+"), (ragged.PLAIN, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        want = [re.findall(pattern, t.translate(UP)) for t in texts]
        hashes, counts = ragged.words(texts, table)
        assert counts.tolist() == [len(w) for w in want]
        flat = [w for ws in want for w in ws]
        assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def test_ragged_words_cut_long_texts(monkeypatch):
    text = prose(4, 500)
    whole = ragged.words([text, "x"], ragged.SPACED)
    monkeypatch.setattr(ragged, "BLOCK", 50)
    cut = ragged.words([text, "x"], ragged.SPACED)
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])
    assert ragged.words(["a" * 500 + " b"], ragged.SPACED)[1].tolist() == [2]


def brute_leaks(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))

    windows = {}
    for item, text in items:
        ws = words(text)
        n = min(10, len(ws))
        for i in range(len(ws) - n + 1) if n else ():
            windows.setdefault(tuple(ws[i : i + n]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for k, text in docs:
        ws, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[w]
        out.append((k, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_brute_force(spark, docs, no_docs):
    pick = random.Random(8)
    bench = [(k, prose(900 + k, pick.randint(11, 40))) for k in range(8)] + [(8, "Only three words"), (9, "one"), (10, None), (11, ""), (12, prose(900, 12)), (12, prose(950, 12)), (None, prose(960, 15)), (13, prose(970, 10))]
    items = spark.createDataFrame([(*b, 1) for b in bench], "item_id long, text string, node long")
    rows = [(r[0], r[1]) for r in edge_rows()]
    for k in range(40):
        words = prose(700 + k, 80).split(" ")
        source = bench[pick.choice([0, 1, 2, 3, 12, 13, 14, 15])][1].replace("a", "A").split(" ")
        n = pick.randint(8, 14)
        at = pick.randrange(max(1, len(source) - n + 1))
        words[30:30] = source[at : at + n]
        rows.append((100 + k, ", ".join(words)))
    rows += [(200, "say only THREE words, only three words"), (201, f"{bench[0][1]} {bench[0][1]} {bench[1][1]}")]
    own = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple((v is None, v) for v in r)
    got = sorted((tuple(r) for r in decontam.decontam_report(own, items).collect()), key=key)
    want = sorted(brute_leaks(rows, bench), key=key)
    assert got == want and sum(r[5] for r in want) > 20
    assert decontam.decontam_report(no_docs, items).count() == 0
    none = decontam.decontam_report(docs, items.limit(0)).collect()
    assert len(none) == len(edge_rows()) and not any(r.contaminated for r in none)
    clean = decontam.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r[5] for r in brute_leaks([(r[0], r[1]) for r in edge_rows()], bench))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_banded_distance(spark):
    pick = random.Random(2)
    pairs = []
    for _ in range(400):
        a = [pick.choice("abé") for _ in range(pick.randint(1, 14))]
        b = list(a)
        for _ in range(pick.randint(0, 4)):
            at = pick.randrange(len(b) + 1)
            b[at : at + pick.randint(0, 1)] = [pick.choice("abé")] * pick.randint(0, 1)
        pairs.append(("".join(a), "".join(b)))
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    for edits in (1, 2, 3):
        near = [(a, b) for a, b in pairs if len(b) - len(a) <= edits]
        got = spark.createDataFrame(near, "a string, b string").select("a", "b", linededup.within(F.col("a"), F.col("b"), edits).alias("w")).collect()
        assert [(r.a, r.b, r.w) for r in got] == [(a, b, distance(a, b) <= edits) for a, b in near]


def brute_lines(docs, ladder):
    found = sorted({(k, p, x) for k, t in docs if t is not None for p, x in enumerate(t.split("\n")) if re.search(r"[^ \t-\r]", x)}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    first, rank = {}, []
    for k, p, x in found:
        if x not in first:
            first[x] = (k, p)
            rank.append(x)
    edits = lambda n: max((e for low, e in ladder if n >= low), default=0)
    near = lambda x, y: abs(len(x) - len(y)) <= edits(min(len(x), len(y))) and distance(x, y) <= edits(min(len(x), len(y)))
    late = {x for j, x in enumerate(rank) if any(near(x, y) for y in rank[:j])}
    out = []
    for k, t in docs:
        lines = (t or "").split("\n")
        kept = [x for p, x in enumerate(lines) if x not in first or (first[x] == (k, p) and x not in late)]
        out.append((k, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def line_corpus():
    pick, rows = random.Random(4), []
    pool = [prose(600 + k, 12) for k in range(12)] + ["short", ""]
    for k in range(40):
        lines = []
        for _ in range(pick.randint(1, 5)):
            line = list(pick.choice(pool))
            for _ in range(pick.choice([0, 0, 1, 2, 3])):
                at = pick.randrange(len(line) + 1)
                line[at : at + pick.randint(0, 1)] = ["z"] * pick.randint(0, 1)
            lines.append("".join(line))
        rows.append((k, "\n".join(lines)))
    return rows


def test_line_dedup_brute_force(spark):
    rows = line_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for ladder in (linededup.LADDER, ((40, 2),), ((0, 1), (20, 3))):
        got = linededup.line_dedup_report(docs, ladder).collect()
        assert sorted(map(tuple, got)) == brute_lines(rows, ladder)
        assert sum(r.n_removed for r in got) > 10


def test_line_dedup_edges(docs, no_docs):
    rows = [(r[0], r[1]) for r in edge_rows() if r[0] != 11 and r[0] != 12]
    key = lambda r: tuple((v is None, v) for v in r)
    got = sorted((tuple(r) for r in linededup.line_dedup_report(docs.where("doc_id is null or doc_id not in (11, 12)")).collect()), key=key)
    assert got == sorted(brute_lines(rows, linededup.LADDER), key=key)
    out = linededup.line_dedup(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(r.text is None or r.n_chars == len(r.text) for r in out.collect())
    assert linededup.line_dedup(no_docs).count() == linededup.line_dedup_report(no_docs).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """All buckets are large, and blocks small: the result is the same."""
    monkeypatch.setattr(neardup, "SMALL", 1)
    monkeypatch.setattr(neardup, "BLOCK_NODES", 3)
    rows = near_corpus()
    got = neardup.near_dup_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_shared_counts():
    sets = [{1, 2, 3}, {2, 3, 4}, set(), {9}]
    owner = np.array([i for i, s in enumerate(sets) for _ in s])
    found = np.array([x for s in sets for x in sorted(s)])
    want = [[len(a & b) for b in sets] for a in sets]
    got = neardup.shared_counts(owner, found, 4)
    assert all(got[i][j] == want[i][j] for i in range(4) for j in range(4) if i != j)


def families():
    """Lines that share most of their segments: numbers in a template, at one place or at two, and templates with ends of their own."""
    pick, whole = random.Random(6), prose(1, 12)
    lines = [f"{whole} {k * 37 % 500:03d} {whole[::-1]}" for k in range(70)]
    lines += [f"{pick.randrange(30):02d} {whole} {pick.randrange(30):02d}{pick.choice('ab')}" for _ in range(60)]
    lines += [f"{whole} {prose(50 + k, 6)}" for k in range(30)] + [f"{whole[:-k]} 004 {whole[::-1]}" for k in range(1, 4)] + ["short"] * 3
    pick.shuffle(lines)
    return [(k, f"{x}\n{lines[(k * 7) % len(lines)]}") for k, x in enumerate(lines)]


def test_line_dedup_with_hot_segments(spark, monkeypatch):
    """Lines that share segments meet by what remains, and in the end in blocks: the same lines go."""
    rows = families()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for ladder, hot, levels, block in ((((40, 1),), 16, 3, 64), (((40, 2),), 4, 3, 64), (linededup.LADDER, 1, 2, 5), (((40, 3),), 8, 1, 16)):
        monkeypatch.setattr(linededup, "HOT", hot)
        monkeypatch.setattr(linededup, "LEVELS", levels)
        monkeypatch.setattr(linededup, "BLOCK", block)
        got = linededup.line_dedup_report(docs, ladder).collect()
        assert sorted(map(tuple, got)) == brute_lines(rows, ladder)


def test_pairs_of_a_key_are_made_once(spark):
    """Lines that one key indexes meet in one direction, rests of lines whose signatures are far apart do not meet; no key is hot here."""
    hot = spark.createDataFrame([], "hot long")
    keys = spark.createDataFrame([(1, n, True) for n in range(10)] + [(1, 50, False), (2, 60, False)], "key long, lh long, own boolean")
    got = sorted(map(tuple, linededup.cool_pairs(keys, hot).collect()))
    assert got == sorted([(a, b) for a in range(10) for b in range(a + 1, 10)] + [(a, 50) for a in range(10)])
    rows = [(1, n, own, 0, 2, 0b11111 * (n % 2)) for n in range(10) for own in (True, False)] + [(1, 4, False, 1, 2, 0), (1, 50, False, 1, 2, 0b1111)]
    rests = spark.createDataFrame(rows, "key long, lh long, own boolean, less int, edits int, sign long")
    got = sorted(map(tuple, linededup.cool_rest_pairs(rests, hot).collect()))
    equal = {(a, b) for a in range(10) for b in range(a + 1, 10) if a % 2 == b % 2}
    assert got == sorted(equal | {(a, 4) for a in range(0, 10, 2) if a != 4} | {(a, 50) for a in range(10)})


def test_near_lines_share_a_key(spark):
    """An index key of the shorter of two near lines is a probe key of the longer, and with_keys agrees with line_spots."""
    rng, ladder = random.Random(5), ((8, 1), (14, 2), (20, 3))
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abcd é") for _ in range(rng.randint(8, 30)))
        b, edits = a, max(k for low, k in ladder if len(a) >= low)
        for _ in range(rng.randint(0, edits)):
            i, kind = rng.randrange(len(b)), rng.choice("ird")
            b = b[:i] + ("" if kind == "d" else rng.choice("abcdx")) + b[i + (kind != "i"):]
        if len(b) >= len(a):
            pairs.append((len(pairs), a, b))
    rows = spark.createDataFrame(pairs, "n int, a string, b string")
    line, size = F.col("line"), F.col("size")

    def keyed(name):
        each = linededup.with_keys(rows.select("n", F.col(name).alias("line"), F.length(name).alias("size")), ladder)
        spots = {own: F.transform(linededup.line_spots(line, size, ladder, own), lambda s: s["key"]) for own in (True, False)}
        return each.select("n", "k", "p", (F.col("k") == spots[True]).alias("same_k"), (F.col("p") == spots[False]).alias("same_p")).collect()

    short, long = {r.n: r for r in keyed("a")}, {r.n: r for r in keyed("b")}
    assert len(pairs) > 200 and all(r.same_k and r.same_p for r in [*short.values(), *long.values()])
    assert [n for n, _, _ in pairs if not set(short[n].k) & set(long[n].p)] == []


def test_cleaned_texts(spark):
    cases = [(None, [0]), ("a\nb\nc", None), ("a\nb\nc", [2, 0]), ("a\nb\nc", [0, 1, 2]), ("a\n\nb\n", [0]), ("a", [0]), ("\n", [1]), ("a\nb\nc\nd", [1, 2])]
    rows = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(cases)], "n int, text string, gone array<int>")
    got = [r.c for r in rows.select("n", linededup.cleaned(F.col("text"), F.col("gone")).alias("c")).orderBy("n").collect()]
    brute = lambda t, g: t if g is None or t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g)
    assert got == [brute(t, g) for t, g in cases]
