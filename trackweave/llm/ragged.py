"""Word and shingle hashes of many texts at once, as flat numpy arrays with counts per text."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once; a longer text is cut between words.
BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: Word bytes after lower-casing A-Z. SPACED: all but white space. PLAIN: digits, a-z and whatever is not ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
PLAIN = np.zeros(256, bool)
PLAIN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def _block(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of data."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = table[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts


def _cuts(text: bytes, table: np.ndarray) -> list[bytes]:
    parts = []
    while len(text) > BLOCK:
        gaps = np.flatnonzero(~table[np.frombuffer(text, np.uint8, BLOCK)])
        if not len(gaps):  # one word of more than a block
            rest = np.flatnonzero(~table[np.frombuffer(text, np.uint8)])
            gaps = rest[:1] if len(rest) else np.array([len(text) - 1])
        parts.append(text[: gaps[-1] + 1])
        text = text[gaps[-1] + 1 :]
    return [*parts, text]


def words(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and how many words each text has."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    parts: list[bytes] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if parts:
            found, starts = _block(b" ".join(parts), table)
            begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
            np.add.at(counts, owners, np.diff(np.searchsorted(starts, begin)))
            hashes.append(found)
            parts.clear()
            owners.clear()
            held = 0

    for i, text in enumerate(texts):
        for part in _cuts((text or "").encode("utf-8", "replace").lower(), table):
            if held + len(part) > BLOCK:
                flush()
            parts.append(part)
            owners.append(i)
            held += len(part) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k neighbours; sequences are not told apart."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = (out + hashes[j : j + n]) * BASE
        out ^= out >> np.uint64(29)
    return mix(out)


def gram_starts(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions at which a k-gram lies within one text, and the text of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    spots = np.flatnonzero(owner[: max(0, len(owner) - k + 1)] == owner[k - 1 :]) if len(owner) >= k else np.zeros(0, np.int64)
    return spots, owner[spots]
