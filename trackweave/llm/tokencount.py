"""Token counts by rank-synchronous merging of ragged arrays.

Texts are normalised and cut as the tokenizer's file says (NFC, lower case, one pre-token a match).
The new pre-tokens of a batch lie end to end in one numpy array of symbols; each round finds every
sequence's lowest-ranked pair, joins all its occurrences in all sequences at once (every other one
in a run of overlaps), and looks up only the pairs that changed. What is left of a sequence when no
pair has a rank is its count. Counts of short pre-tokens are kept in a bounded table.

Defined results: null text counts as empty (0 bytes, 0 tokens). The special strings count one token
each where they stand, as the library does by default. Repeated rows and null ids are counted row by
row; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
TABLE_ROWS = 1_000_000
REMEMBER_CHARS = 32
#: Symbols in one ragged array at most, unless one pre-token has more.
ARRAY_SYMBOLS = 2_000_000
NONE = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """Byte -> the character that stands for it in byte-level vocabularies: itself if printable, else the next from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class RaggedMerger:
    """Counts the symbols that BPE leaves of each of many byte strings."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int32)
        self.size = np.int64(len(vocab))
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], NONE), self.made[at]

    def counts(self, words: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        symbols[ends[lengths > 0] - 1] = self.final[raw[ends[lengths > 0] - 1]]
        seq = np.repeat(np.arange(len(words)), lengths)
        out = lengths.copy()
        rank, made = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int32)  # of the pair that starts here
        todo = np.flatnonzero(seq[:-1] == seq[1:]) if len(seq) else seq
        while True:
            if len(todo):
                rank[todo], made[todo] = self._lookup(symbols[todo].astype(np.int64), symbols[todo + 1])
            if not len(seq):
                return out
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(seq)])
            over = best == NONE
            if over.any():  # these sequences are done
                out[seq[first[over]]] = sizes[over]
                stay = np.repeat(~over, sizes)
                symbols, seq, rank, made = symbols[stay], seq[stay], rank[stay], made[stay]
                best, sizes = best[~over], sizes[~over]
                if not len(seq):
                    return out
            hit = rank == np.repeat(best, sizes)
            spot = np.flatnonzero(hit)
            run = np.r_[True, np.diff(spot) != 1]  # where a run of neighbouring hits starts
            since = spot - spot[np.maximum.accumulate(np.where(run, np.arange(len(spot)), 0))]
            spot = spot[since % 2 == 0]
            symbols[spot] = made[spot]
            stay = np.ones(len(seq), bool)
            stay[spot + 1] = False
            place = np.cumsum(stay) - 1
            at = place[spot]
            symbols, seq, rank, made = symbols[stay], seq[stay], rank[stay], made[stay]
            todo = np.unique(np.r_[at, at[at > 0] - 1])
            rank[todo] = NONE
            todo = todo[todo + 1 < len(seq)]
            todo = todo[seq[todo] == seq[todo + 1]]


class Counter:
    """counts(texts) for a word-level BPE file: NFC, lower case, byte alphabet, end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merger = RaggedMerger(model["vocab"], merges, model["end_of_word_suffix"])
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.table: dict[str, int] = {}

    def cut(self, text: str) -> tuple[int, list[str]]:
        """Special strings in a text, and its pre-tokens."""
        parts = self.special.split(text) if "<|" in text else [text]
        found: list[str] = []
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("\N{GREEK CAPITAL LETTER SIGMA}", "\N{GREEK SMALL LETTER SIGMA}")
            found += self.pieces.findall(part.lower())
        return len(parts) - 1, found

    def _learn(self, words: list[str]) -> dict[str, int]:
        known: dict[str, int] = {}
        part: list[bytes] = []
        names: list[str] = []
        held = 0
        for word in [*words, None]:
            if word is None or held > ARRAY_SYMBOLS:
                known.update(zip(names, self.merger.counts(part).tolist(), strict=True))
                part, names, held = [], [], 0
            if word is not None:
                part.append(data := word.encode("utf-8", "replace"))
                names.append(word)
                held += len(data)
        return known

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.cut(t) for t in texts]
        if len(self.table) > TABLE_ROWS:
            self.table.clear()
        fresh = self._learn(list({w for _, words in cut for w in words if w not in self.table}))
        long = {w: n for w, n in fresh.items() if len(w) > REMEMBER_CHARS}
        self.table.update((w, n) for w, n in fresh.items() if w not in long)
        known = self.table if not long else self.table | long
        return [n + sum(map(known.__getitem__, words)) for n, words in cut]


@functools.lru_cache(2)
def counter(path: str | None) -> Counter:
    import public_tokenizers as public

    return Counter(path or public.path(VOCABULARY))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. path: a tokenizer file that every executor has."""
    common.importable(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).counts
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [x for at in range(0, len(texts), 200) for x in count(texts[at : at + 200])]
            size = [len(t.encode("utf-8", "replace")) for t in texts]
            over = [x > limit for x in n]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(over, pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
