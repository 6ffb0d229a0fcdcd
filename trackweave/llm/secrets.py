"""Secret scans: fixed patterns, and random strings found by how badly a public vocabulary packs them.

Language packs into few tokens; a random string needs a token for each one or two characters. A run
of key-like characters is taken as random if it is long and has under MAX_RATIO characters a token,
whatever characters it is made of. Known digests (whole hex runs of a digest's length), UUIDs and
identifiers (runs that separators cut into numbers, words that the vocabulary packs well, and stubs of
up to STUB characters) are excluded; so is what overlaps a span that a fixed pattern found. Those spans
always stay.

Defined results: null text counts as empty (no spans). Spans of one kind never overlap. Offsets are
code points, ends exclusive. Rows are scanned one by one, so ties, repeated rows and null ids need no
care; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

VOCABULARY = "byte_bpe_50k.tiktoken"
KINDS = ["assign", "access", "hex", "random"]
MIN_RUN = 16
MAX_RATIO = 2.0
#: Letters of one case shape make a word if they have this many characters a token; words hold at least WORDY per cent of a part's letters.
WORD_RATIO, WORD_CHARS, WORDY = 2.5, 3, 60
#: Parts of up to this many characters tell nothing.
STUB = 3
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
#: Greedy classes take whole runs, so a minimum length in the pattern drops just the short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@functools.lru_cache(2)
def vocabulary(path: str | None):
    import public_tokenizers as public
    import tiktoken

    from .bpe import load_ranks

    return tiktoken.Encoding("public", pat_str=public.PATTERN, mergeable_ranks=load_ranks(path or public.path(VOCABULARY)), special_tokens={})


def wordy(part: str, tokens) -> bool:
    """Whether words hold most of its letters; numbers and stubs pass."""
    letters = sum(c.isalpha() for c in part)
    words = [w for w in WORD.findall(part) if len(w) >= WORD_CHARS and len(w) >= WORD_RATIO * len(tokens(w))]
    return len(part) <= STUB or 100 * sum(map(len, words)) >= WORDY * letters


def identifier(run: str, tokens) -> bool:
    """Whether separators cut it into words, numbers and stubs only."""
    return all(wordy(p, tokens) for p in re.split(r"[+/_=-]+", run) if p)


def random_run(run: str, tokens) -> bool:
    if UUID.fullmatch(run) or (ALL_HEX.fullmatch(run) and len(run) in DIGEST_LENGTHS):
        return False
    return len(run) < MAX_RATIO * len(tokens(run)) and not identifier(run, tokens)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind as listed."""
    low = text.lower()
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(w in low for w in ASSIGN_WORDS) else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, base: list[tuple[int, int, int]], tokens) -> list[tuple[int, int, int]]:
    spans, at, reach = [], 0, 0
    for m in RUN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and random_run(m[0], tokens):
            spans.append((m.start(), 3, m.end()))
    return spans


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_scan(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random. path: a file of ranks that every executor has."""
    common.importable(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).encode_ordinary
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = random_spans(text, base, tokens)
                n = [sum(s[1] == k for s in base) for k in range(3)]
                out.append((*n, hashlib.sha256(shown(base).encode()).hexdigest(), shown(sorted(base + more)), len(more)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
