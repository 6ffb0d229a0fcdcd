"""Conversation tries against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackweave.llm import convtrie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
KIND = "conv_id long, turn long, role string, text string, node string, depth int, n_convs int"


def rebuilt_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
    return {c: turns.get(c - c % 100, [])[: h[c]] + x[h[c] :] for c, x in turns.items()}


def brute(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    out = []
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        parent = min(members[node[:-1]]) if node else None
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((min(who), len(node), parent, len(who), len(children), len(leaves), saved, hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return sorted(out, key=str)


def shared_turns():
    """Conversations that share first turns, some of them whole copies, with nulls, ties, repeated rows and long ones."""
    rows = []
    for c in range(0, 260):
        for t in range(1 + c % 7):
            text = None if (c + t) % 23 == 0 else "same" * (t + 1) if c % 3 or t < 2 else f"own {c % 40} {t}" * (1 + c % 3)
            rows.append((c, None if t == 3 and c % 5 == 0 else t // 2 if c % 11 == 0 else t, None if c % 29 == 0 else ("user", "assistant")[t % 2], text, "x", 1, 2))
    rows += [(700, t, "user", "é" * (t % 5), "x", 1, 2) for t in range(300)]
    return [*rows, rows[5], rows[5], (None, 0, "user", "nobody's", "x", 1, 2), (5000, None, None, None, None, None, None)]


@pytest.mark.parametrize(("least", "share"), [(64, 100_000), (3, 100_000), (0, 100_000)])
def test_trie_brute_force(spark, monkeypatch, least, share):
    monkeypatch.setattr(convtrie, "HEAVY_LEAST", least)
    monkeypatch.setattr(convtrie, "HEAVY_SHARE", share)
    rows = shared_turns()
    found = convtrie.trie_report(spark.createDataFrame(rows, KIND).repartition(3))
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rebuilt_by_hand(rows))


def test_plain_conversations(spark):
    rows = [(c, t, "u", x, "", 1, 1) for c, path in {1: "ab", 2: "ab", 3: "a", 4: "b", 900: "abc"}.items() for t, x in enumerate(path)]
    found = convtrie.prefix_trie(convtrie.plain(convtrie.numbered(spark.createDataFrame(rows, KIND)))).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute({1: [("u", "a"), ("u", "b")], 2: [("u", "a"), ("u", "b")], 3: [("u", "a")], 4: [("u", "b")], 900: [("u", "a"), ("u", "b"), ("u", "c")]})


def test_no_conversations(spark):
    assert convtrie.trie_report(spark.createDataFrame([], KIND)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-1, 8), max_size=30))
def test_bits_hold_the_tree(picks):
    """Parents read back from the bitvector are those it was made from, and rollups count whole subtrees."""
    parent = np.array([min(p, i - 1) for i, p in enumerate(picks)], np.int64)
    depth = np.zeros(len(parent), np.int64)
    for i, p in enumerate(parent):
        depth[i] = depth[p] + 1 if p >= 0 else 0
    order, above = convtrie.breadth_first(parent, convtrie.levels(parent, depth))
    assert sorted(order.tolist()) == list(range(len(parent))) and (np.diff(above) >= 0).all()
    assert all((above[i] < 0 and parent[x] < 0) or order[above[i]] == parent[x] for i, x in enumerate(order))
    bits = convtrie.louds(above)
    assert convtrie.parents(bits).tolist() == above.tolist() and len(bits) == 2 * len(parent) + 1
    size = np.ones(len(parent), np.int64)
    convtrie.rollup(above, depth[order], size)

    def chain(i):
        return [i, *chain(parent[i])] if i >= 0 else []

    want = [sum(x in chain(y) for y in range(len(parent))) for x in order]
    assert size.tolist() == want
