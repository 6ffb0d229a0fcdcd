"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding by a UTF-8 state machine.

Encoding. A sequence of tokens is the BPE of its bytes exactly if each two neighbours are the BPE of
their joint bytes. So the last token of every prefix follows from the last tokens of shorter
prefixes, byte by byte. A continuation can only start a token at a place where the bytes since are the
beginning of some token. A state of the transducer is the list of those places, each as the node of
its bytes in the tree of all tokens, and the tokens up to there that are not yet emitted; after each
byte, the tokens that all places share are emitted. So at most the longest token's bytes are held back,
and words that differ in what matters no more meet in one state. States and transitions are made when
first met and kept in a bounded table, which starts anew when full; results are the same.

Decoding. States are the bytes of an unfinished character (at most three); a token moves from state
to state and emits characters. Malformed input gives one U+FFFD for each maximal broken part.

Defined results: null text counts as empty (0 tokens). Ties, repeated rows and null ids need no
care: each row is encoded by itself. An empty table gives an empty one. Extra columns are ignored.
Texts are read in blocks of pre-tokens, so a very long text needs little more than its tokens.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import struct
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Entries of the transition table, of the table of neighbours that fit, and of the tables of pre-tokens, each.
TABLE_ROWS = 500_000
#: Pre-tokens longer than this are run through the transducer each time.
REMEMBER_CHARS = 32
BLOCK = 50_000
REPLACEMENT = "\N{REPLACEMENT CHARACTER}"
#: Stands for what is left of a pre-token, or for an emitted token that matters no more.
START = -1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_by_rank(ranks: dict[bytes, int], data: bytes, below: int | None = None) -> list[bytes]:
    """Plain BPE of short data: the lowest-ranked joint of neighbours first, leftmost among equals; with joints of ranks below a limit only."""
    parts = [data[i : i + 1] for i in range(len(data))]
    none = max(ranks.values()) + 1 if below is None else below
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
        if rank >= none:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def pack(ids: tuple[int, ...]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def packed_state(places: list[tuple[int, tuple[int, ...]]]) -> bytes:
    return array("i", [x for node, chain in places for x in (node, len(chain), *chain)]).tobytes()


def unpacked_state(state: bytes) -> list[tuple[int, tuple[int, ...]]]:
    flat, places, at = memoryview(state).cast("i").tolist(), [], 0
    while at < len(flat):
        end = at + 2 + flat[at + 1]
        places.append((flat[at], tuple(flat[at + 2 : end])))
        at = end
    return places


class Transducer:
    """encode(piece): the token ids of one pre-token as little-endian 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], table_rows: int = TABLE_ROWS):
        self.ranks, self.table_rows = ranks, table_rows
        self.tokens = {i: t for t, i in ranks.items()}
        self.span = max(self.tokens) + 1
        self.halves: dict[int, tuple[int, ...]] = {}
        self.fitting: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        self._grow_tree()
        self._clear()

    def _grow_tree(self) -> None:
        """The tokens as a tree of bytes: node 0 is empty; children by node and byte; a node's token, or -1; the nodes that some token goes on from."""
        self.children: dict[int, int] = {}
        self.token_at = [-1]
        self.inner = {0}
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                self.inner.add(node)
                node = self.children.setdefault(node << 8 | byte, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
            self.token_at[node] = rank

    def _clear(self) -> None:
        """A state lists the places where a token may start, first to last: (node of the bytes since, tokens up to there).

        The tokens begin with the last emitted one, or START; the last place is the end of what was read.
        States are kept as packed bytes, and a move as the number of its state, or the complement of that if emits has what it emits."""
        start = packed_state([(0, (START,))])
        self.ids = {start: 0}
        self.states = [start]
        self.moves: dict[int, int] = {}
        self.emits: dict[int, bytes] = {}
        self.ends: dict[int, bytes] = {}

    def _halves(self, token: int) -> tuple[int, ...]:
        found = self.halves.get(token)
        if found is None:
            found = self.halves[token] = tuple(self.ranks[part] for part in merge_by_rank(self.ranks, self.tokens[token], token))
        return found

    def _fits(self, a: int, b: int) -> bool:
        """Whether the BPE of a + b is a, b: going back merge by merge on the later-made side, no pair across may join before."""
        tokens, ranks, limit = self.tokens, self.ranks, self.span
        while True:
            if ranks.get(tokens[a] + tokens[b], self.span) < limit:
                return False
            if len(tokens[a]) > 1 and (len(tokens[b]) == 1 or a > b):
                limit = a
                a = self._halves(a)[-1]
            elif len(tokens[b]) > 1:
                limit = b + 1  # of equal ranks, the leftmost joint comes first
                b = self._halves(b)[0]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        key = a * self.span + b
        found = self.fitting.get(key)
        if found is None:
            if len(self.fitting) > self.table_rows:
                self.fitting.clear()
            found = self.fitting[key] = self._fits(a, b)
        return found

    def _step(self, state: int, byte: int) -> tuple[tuple[int, ...], list[tuple[int, tuple[int, ...]]]]:
        """With one byte more: the tokens up to the end, of which exactly one candidate fits what stands left of it; and the places still open."""
        children, token_at, inner = self.children, self.token_at, self.inner
        last, places = None, []
        for node, chain in unpacked_state(self.states[state]):
            after = children.get(node << 8 | byte)
            if after is None:
                continue
            if last is None:
                token, left = token_at[after], chain[-1]
                if token >= 0 and (left == START or self.fits(left, token)):
                    last = (*chain, token)
            if after in inner:
                places.append((after, chain))
        if last is None:
            raise ValueError("the vocabulary lacks a byte, or has a token that its own merges cannot make")
        return last, places

    def _move(self, state: int, byte: int) -> int:
        last, places = self._step(state, byte)
        places.append((0, last))
        first = places[0][1]
        shared = least = len(first)
        for _, chain in places[1:]:
            n = len(chain)
            least, shared = min(least, n), min(shared, n)
            for k in range(1, shared):
                if chain[k] != first[k]:
                    shared = k
                    break
        if least > shared:  # what stands left of the tokens held back matters no more
            places = [(node, (START, *chain[shared:])) for node, chain in places]
        elif shared > 1:
            places = [(node, chain[shared - 1 :]) for node, chain in places]
        key = packed_state(places)
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
        if shared > 1:
            self.emits[state << 8 | byte] = pack(first[1:shared])
            return ~found
        return found

    def run(self, data: bytes) -> bytes:
        if len(self.moves) + len(self.ends) > self.table_rows:
            self._clear()
        if not data:
            return b""
        state, out, moves, emits = 0, [], self.moves, self.emits
        for byte in data[:-1]:
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                move = moves[key] = self._move(state, byte)
            if move < 0:
                out.append(emits[key])
                move = ~move
            state = move
        key = state << 8 | data[-1]
        end = self.ends.get(key)
        if end is None:
            end = self.ends[key] = pack(self._step(state, data[-1])[0][1:])
        out.append(end)
        return b"".join(out)

    def encode(self, piece: str) -> bytes:
        """Known pieces are kept in two tables: when the newer is full, it becomes the older, so that frequent pieces stay."""
        found = self.pieces.get(piece)
        if found is None:
            found = self.older_pieces.get(piece)
            if found is None:
                found = self.run(piece.encode("utf-8", "replace"))
            if len(piece) <= REMEMBER_CHARS:
                if len(self.pieces) > self.table_rows // 2:
                    self.older_pieces, self.pieces = self.pieces, {}
                self.pieces[piece] = found
        return found


def encode_text(machine: Transducer, pattern: regex.Pattern, text: str) -> bytes:
    """The ids of a whole text, packed; pre-tokens are taken in blocks."""
    known, encode = machine.pieces.get, machine.encode
    if len(text) < 16 * BLOCK:
        return b"".join([known(p) or encode(p) for p in pattern.findall(text)])
    found, out = pattern.finditer(text), []
    while block := [m[0] for m in islice(found, BLOCK)]:
        out.append(b"".join([known(p) or encode(p) for p in block]))
    return b"".join(out)


class Utf8Machine:
    """Feeds on bytes; holds at most three bytes of an unfinished character."""

    #: First byte -> (bytes that follow, lowest and highest second byte).
    LEAD = {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)} | {b: (2, 0x80, 0xBF) for b in range(0xE0, 0xF0)} | {b: (3, 0x80, 0xBF) for b in range(0xF0, 0xF5)} | {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}

    @classmethod
    def feed(cls, held: bytes, data: bytes) -> tuple[bytes, str]:
        out = []
        for b in data:
            if held:
                more, low, high = cls.LEAD[held[0]]
                if len(held) > 1:
                    low, high = 0x80, 0xBF
                if low <= b <= high:
                    held += bytes([b])
                    if len(held) > more:
                        out.append(held.decode("utf-8"))
                        held = b""
                    continue
                out.append(REPLACEMENT)
                held = b""
            if b < 0x80:
                out.append(chr(b))
            elif b in cls.LEAD:
                held = bytes([b])
            else:
                out.append(REPLACEMENT)
        return held, "".join(out)


class Decoder:
    """Streaming decoder of ids; transitions of tokens that start or end inside a character are made when first met."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: t for t, i in ranks.items()}
        whole = {i: Utf8Machine.feed(b"", t) for i, t in self.tokens.items()}
        self.whole = [None] * (max(self.tokens) + 1)
        for i, (held, text) in whole.items():
            if not held:
                self.whole[i] = text
        self.moves: dict[tuple[bytes, int], tuple[bytes, str]] = {}

    def feed(self, held: bytes, ids: list[int]) -> tuple[bytes, str]:
        """The new state and the characters that ids complete."""
        out, whole = [], self.whole
        for i in ids:
            text = None if held else whole[i]
            if text is None:
                move = self.moves.get((held, i))
                if move is None:
                    move = self.moves[held, i] = Utf8Machine.feed(held, self.tokens[i])
                held, text = move
            out.append(text)
        return held, "".join(out)

    def decode(self, packed: bytes) -> str:
        held, parts = b"", []
        for at in range(0, len(packed), 4 * BLOCK):
            held, text = self.feed(held, np.frombuffer(packed[at : at + 4 * BLOCK], "<u4").tolist())
            parts.append(text)
        return "".join(parts) + REPLACEMENT * bool(held)


@functools.lru_cache(2)
def machines(path: str | None, pattern: str | None, table_rows: int = TABLE_ROWS) -> tuple[Transducer, Decoder, regex.Pattern]:
    """One of each a worker process."""
    import public_tokenizers as public

    ranks = load_ranks(path or public.path(VOCABULARY))
    return Transducer(ranks, table_rows), Decoder(ranks), regex.compile(pattern or public.PATTERN)


def bpe_encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, ids: bool = True, table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip, and the ids themselves (array of int) if asked for.

    path: a file of ranks that every executor has; the installed vocabulary by default. table_rows: of each table of a worker;
    fewer take less memory and more time, with the same result."""
    common.importable(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, decoder, pieces = machines(path, pattern, table_rows)
        gc.disable()  # the tables hold a million small tuples and no cycles; walking them again and again costs a tenth of the time
        try:
            yield from encoded(machine, decoder, pieces, batches)
        finally:
            gc.enable()

    def encoded(machine: Transducer, decoder: Decoder, pieces: regex.Pattern, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, digests, decoded, same = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                one = encode_text(machine, pieces, text)
                back = decoder.decode(one)
                packed.append(one if ids else len(one) // 4)
                digests.append(hashlib.sha256(one).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text)
            n = [len(x) // 4 for x in packed] if ids else packed
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())]
            if ids:
                flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * ids
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"] + ["ids"] * ids
    return docs.select("doc_id", "text").mapInArrow(rows, schema)
