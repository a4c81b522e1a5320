"""BPE replay and packing against the libraries and plain versions."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievemill.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def test_fast_split_agrees_on_every_character_it_is_used_for():
    special, plain, split = re.compile(bpe.SPECIAL), re.compile(bpe.PLAIN), regex.compile(public_tokenizers.PATTERN)
    usable = [chr(c) for c in range(0x250) if not special.search(chr(c))]
    assert len(usable) > 500
    for a in usable:
        for text in (f"x{a}y", f"1{a}2", f" {a} ", f"{a}{a}!", f"\n{a}x"):
            assert plain.findall(text) == split.findall(text), repr(text)
    for a in "\x1c²½٣":
        assert special.search(a)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80) | st.text("ab ", max_size=200) | st.text("aaaa\n '!s1", max_size=120), max_size=6))
def test_replay_equals_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    own = tiktoken_encoding()
    got = [x.tolist() for x in ENCODER.encode(texts)]
    assert got == [own.encode_ordinary(t) for t in texts]
    assert [ENCODER.decode(x) for x in got] == [t.encode() for t in texts]


ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def tiktoken_encoding():
    if not hasattr(tiktoken_encoding, "made"):
        tiktoken_encoding.made = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENCODER.merges.ranks, special_tokens={})
    return tiktoken_encoding.made


def test_one_long_piece(encoder, library):
    texts = ["a" * 5_000, "ab" * 3_000, "🙂" * 400, " " * 1_000 + "x"]
    assert [x.tolist() for x in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_forgetting_changes_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(["one two three four five"])] == [library.encode_ordinary("one two three four five")]


def test_documents_round_trip(documents, library):
    rows = {r["doc_id"]: r for r in bpe.encode_documents(documents).collect()}
    given_rows = documents.select("doc_id", "text").collect()
    assert len(rows) == len({r["doc_id"] for r in given_rows})
    for r in given_rows:
        ids = library.encode_ordinary(r["text"] or "")
        got = rows[r["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_odd_documents(odd_documents):
    got = bpe.encode_documents(odd_documents, with_ids=True).collect()
    assert len(got) == odd_documents.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got if r["doc_id"] in (1, 2)} == {(0, empty, empty)}
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)
    assert bpe.encode_documents(odd_documents.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("abC.,'s 12éà…\n\x0b\x1c\x85\xa0", max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", "<|ENDofTEXT|>", "<|startoftext|>", "x", " ", ".", "<|"]), max_size=6).map("".join), max_size=5))
def test_words_equal_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    if not hasattr(test_words_equal_library, "made"):
        test_words_equal_library.made = packing.WordIds(WORDS)
    untouched = Tokenizer.from_file(WORDS)
    want = [[*e.ids, packing.END] for e in untouched.encode_batch(texts, add_special_tokens=False)]
    whole = pa.array(["Before à", *texts, "after"], pa.string())
    ids, ends = test_words_equal_library.made.encode(whole.slice(1, len(texts)))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == (want or [[]])


def test_forgotten_words_are_learned_again(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "KEPT_WORDS", 2)
    words = packing.WordIds(WORDS)
    for text in ("one two. two, three", "two, two. four", "one two. two, three"):
        assert words.encode(pa.array([text]))[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END]


def test_slices_are_whole_texts_in_order():
    column = pa.array(["ab", None, "cdefgh", "", "i", "j"])
    parts = list(packing.slices(column, 3))
    assert [first for first, _ in parts] == [0, 2, 3] and sum((p.to_pylist() for _, p in parts), []) == column.to_pylist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_plan_uses_every_piece_once_and_fits(lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1)
    used = np.zeros_like(counts)
    patterns = packing.plan(counts, capacity)
    for held, times in patterns:
        assert times > 0 and sum(n * k for n, k in held) <= capacity
        for n, k in held:
            used[n] += k * times
    assert (used == counts).all()
    total = sum(times for _, times in patterns)
    assert total <= len(first_fit_decreasing(lengths, capacity)) + 1


def first_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        for i, b in enumerate(bins):
            if b + n <= capacity:
                bins[i] += n
                break
        else:
            bins.append(n)
    return bins


def test_exact_complements_leave_no_gap():
    counts = np.zeros(101, dtype=np.int64)
    counts[[60, 40]] = 7  # one
    counts[[70, 20, 10]] = 5  # two
    counts[[55, 25, 15, 5]] = 3  # three
    assert sum(times for _, times in packing.plan(counts, 100)) == 7 + 5 + 3


def check_packed(rows, docs, tokenizer, capacity):
    ids = {}
    for r in docs:
        ids.setdefault(r["doc_id"], []).append([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0])
    want = sorted((str(d), k, s, min(capacity, len(i) - s), zlib.crc32(np.array(i[s : s + capacity], "<u4").tobytes())) for d, lists in ids.items() for i in lists for k, s in enumerate(range(0, len(i), capacity)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    return len(sequences), -(-total // capacity)


def test_documents_are_packed(documents, tokenizer):
    used, least = check_packed(packing.pack_documents(documents).collect(), documents.collect(), tokenizer, 2048)
    assert used <= least * 1.02 + 1


def test_odd_documents_are_packed(odd_documents, tokenizer):
    rows = packing.pack_documents(odd_documents, capacity=64).collect()
    check_packed(rows, odd_documents.collect(), tokenizer, 64)
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert packing.pack_documents(odd_documents.limit(0)).count() == 0
