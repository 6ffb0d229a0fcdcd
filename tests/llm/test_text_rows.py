"""Operators that judge each text by itself: quality, BPE, token counts, secrets."""

import hashlib
import random
import re
import sys
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackweave.llm import bpe, quality, secrets, tokencount

from .conftest import edge_rows, prose


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)} if len(words) < 3000 else None
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), None if repeated is None else len(repeated)


def test_quality_counts(docs):
    found = quality.quality_report(docs).collect()
    assert len(found) == len(edge_rows())
    texts = {r[0]: r[1] for r in edge_rows() if r[0] is not None}
    for r in found:
        if r.doc_id is None:
            continue
        n, chars, symbols, lines, repeated = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n, chars, symbols, lines)
        if repeated is not None:
            assert r.n_repeat_words == repeated
        assert r.base_failed == (n < 10 or 100 * r.n_repeat_words > 20 * n)
        assert not (r.kept and r.base_failed)


def test_quality_judges_by_group(spark):
    good = [(k, " ".join(f"w{k}x{j}" for j in range(30)), "en", "a") for k in range(300)]
    odd = [(1000 + k, " ".join(f"w{k}x{j}###" for j in range(30)), "en", "a") for k in range(20)]
    usual = [(2000 + k, " ".join(f"v{k}x{j}###" for j in range(30)), "en", "b") for k in range(300)]
    kept = {r.doc_id for r in quality.quality_rules(spark.createDataFrame(good + odd + usual, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == {r[0] for r in good + usual}


def test_quality_filter_keeps_columns(docs, no_docs):
    kept = quality.quality_rules(docs)
    assert kept.columns == docs.columns and kept.count() > 0
    assert quality.quality_rules(no_docs).count() == quality.quality_report(no_docs).count() == 0


def test_sketch_buckets(spark):
    from pyspark.sql import functions as F

    values = [0, 1, 127, 128, 129, 1000, 12345, 10**9]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality.bucket(F.col("v")).alias("b")).collect()]
    assert got == [(v >> max(0, v.bit_length() - 7)) << max(0, v.bit_length() - 7) for v in values]


@pytest.fixture(scope="module")
def tools():
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    machine, decoder, pattern = bpe.machines(None, None)
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=machine.ranks, special_tokens={})
    return machine, decoder, pattern, library, Tokenizer.from_file(public.path(tokencount.VOCABULARY))


TEXTS = st.text(alphabet=st.sampled_from("abcdeABCéñüß日本😀ΣςİﬁⅨ 0123456789'\n\t\r\x85\xa0.-_=+#\\<|>endoftxsa"), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encoding_is_the_librarys(tools, text):
    machine, decoder, pattern, library, words = tools
    packed = bpe.encode_text(machine, pattern, text)
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
    assert decoder.decode(packed) == text
    assert tokencount.counter(None).counts([text]) == [len(words.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=5), max_size=8))
def test_utf8_machine_is_incremental(parts):
    held, out = b"", ""
    for part in parts:
        held, text = bpe.Utf8Machine.feed(held, part)
        out += text
        assert len(held) <= 3
    assert out + "\N{REPLACEMENT CHARACTER}" * bool(held) == b"".join(parts).decode("utf-8", "replace")


def test_small_tables_change_nothing(tools):
    machine, _, pattern, library, _ = tools
    tight = bpe.Transducer(machine.ranks, table_rows=50)
    for row in edge_rows():
        assert np.frombuffer(bpe.encode_text(tight, pattern, row[1] or ""), "<u4").tolist() == library.encode_ordinary(row[1] or "")


def test_bpe_memory(tools):
    """What the tables of one worker take: states are packed, and moves are plain numbers. The result of a small table is the same."""
    machine, _, pattern = bpe.machines(None, None)
    texts = [prose(900 + k, 300, 5000) for k in range(20)]
    full, tight = bpe.Transducer(machine.ranks), bpe.Transducer(machine.ranks, table_rows=1000)
    tracemalloc.start()
    want = [bpe.encode_text(full, pattern, t) for t in texts]
    used = tracemalloc.get_traced_memory()[0] - sum(map(sys.getsizeof, want))
    tracemalloc.stop()
    assert used < 400 * (len(full.moves) + len(full.ends))
    assert [bpe.encode_text(tight, pattern, t) for t in texts] == want


def test_bpe_query(docs, no_docs, tools):
    texts = {r[0]: r[1] or "" for r in edge_rows() if r[0] is not None}
    rows = bpe.bpe_encode(docs).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert r.round_trip
        if r.doc_id is not None:
            ids = tools[3].encode_ordinary(texts[r.doc_id])
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.bpe_encode(no_docs).count() == 0


def test_token_counts(docs, no_docs, tools):
    texts = {r[0]: r[1] or "" for r in edge_rows() if r[0] is not None}
    rows = tokencount.token_counts(docs).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        if r.doc_id is not None:
            n = len(tools[4].encode(texts[r.doc_id], add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)
    assert tokencount.token_counts(no_docs).count() == 0


def test_token_counts_special_and_long(tools):
    odd = ["<|startoftext|>a<|endoftext|>B<|endoftext|>", "a" * 5000, "ab" * 4000, "ΑΣ ΑΣΑ", "e\N{COMBINING ACUTE ACCENT}"]
    assert tokencount.counter(None).counts(odd) == [len(e.ids) for e in tools[4].encode_batch(odd, add_special_tokens=False)]


def slow_base(text):
    spans = []
    for kind, pattern, flags, fits in (
        (0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I, lambda m: len(m[2]) >= 6),
        (1, r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        (2, r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    ):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if fits(m)]
    return sorted(spans)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "TOKEN", "api_key", "apikey", "password", "=", ": ", '"', "AKIA", "ABCDEFGH12345678", "AKIAABCD", "0123456789abcdef01234567", "abc", "é", "\n", " ", "deadbeef", "x", "ſecret", "x" * 7]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert secrets.base_spans(text) == slow_base(text)


def test_random_strings():
    tokens = secrets.vocabulary(None).encode_ordinary
    pick = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(pick.choice(alphabet) for _ in range(32)) for _ in range(200)]
    assert sum(secrets.random_run(k, tokens) for k in keys) >= 190
    for plain in ("user_account_id_2024_final", "getUserAccountById2", "550e8400-e29b-41d4-a716-446655440000", "d41d8cd98f00b204e9800998ecf8427e", "internationalization", "4111111111111111"):
        assert not secrets.random_run(plain, tokens)
    text = f"é see {keys[0]} and token={keys[1]}"
    base = secrets.base_spans(text)
    assert [text[a:b] for a, _, b in secrets.random_spans(text, base, tokens)] == [keys[0]]


def test_random_strings_of_any_alphabet():
    tokens = secrets.vocabulary(None).encode_ordinary
    pick = random.Random(8)
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    both = small.upper() + small
    for alphabet in (both + digits, both + digits + "+/", both + digits + "-_", small.upper() + "234567", both):
        for n in (16, 20, 24, 32, 44):
            keys = ["".join(pick.choice(alphabet) for _ in range(n)) for _ in range(200)]
            assert sum(secrets.random_run(k, tokens) for k in keys) >= 197
    for plain in ("a/b/c/d/e/f/g/h/i/j", "2024-01-02-03-04-05", "img/2020/01/02/a1", "x1/y2/z3/img/thumb_04", "SECTION_TITLE_NUMBER_4", "-=-=-=-+/+/__-=-="):
        assert not secrets.random_run(plain, tokens)


def test_secret_query(docs, no_docs):
    texts = {r[0]: r[1] or "" for r in edge_rows() if r[0] is not None}
    rows = secrets.secret_scan(docs).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        if r.doc_id is not None:
            base = slow_base(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(secrets.shown(base).encode()).hexdigest()
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
    assert secrets.secret_scan(no_docs).count() == 0
