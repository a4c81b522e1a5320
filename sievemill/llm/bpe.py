"""Byte-level BPE by merge replay over whole blocks of text.

A block's texts are split into pieces once; its distinct new pieces form one long line of tokens.  An inverted
index leads from a merge's rank to the places where its pair stands.  Merges are taken in rank order over all
pieces at once, and each looks anew only at the pairs to the left and right of what it joined.  Nothing is
shuffled: pieces that a worker has met before are kept, up to a bound, between its blocks and tasks.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import worker_store

#: text gathered before one replay, and distinct pieces a worker keeps
BLOCK_BYTES, KEPT_PIECES = 12 << 20, 400_000
NONE = np.int32(2**31 - 1)

#: the same split as public_tokenizers.PATTERN for texts in which SPECIAL finds nothing, in the faster of the two libraries
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
#: beyond Latin, separators that only one library takes for white space, and digits that only one takes for digits
SPECIAL = "[^\x00-\x1b\x20-ɏ]|[²³¹¼-¾]"


class Merges:
    """Ranks of a rank file as arrays: bytes of each id, ids of single bytes, and the sorted pairs that can be joined."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        get = self.ranks.get
        pairs = [(get(t[:i]), get(t[i:]), r) for t, r in self.ranks.items() for i in range(1, len(t))]
        kept = np.array([p for p in pairs if p[0] is not None and p[1] is not None], dtype=np.int64)
        keys = kept[:, 0] << 32 | kept[:, 1]
        order = np.argsort(keys)
        self.keys, self.values = keys[order], kept[order, 2].astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's union, NONE where the file has none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], NONE)


def replay(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after another, and how many each piece has."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    tok = merges.single[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(tok)
    last = np.cumsum(lengths) - 1
    nxt = np.arange(1, n + 1)
    prv = np.arange(-1, n - 1)
    nxt[last[lengths > 0]] = -1
    prv[(last - lengths + 1)[lengths > 0]] = -1
    alive = np.ones(n, dtype=bool)
    pair = np.full(n, NONE, dtype=np.int32)  # rank of the pair that starts here
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(places: np.ndarray) -> None:
        """Look up the pairs that start at ``places`` and index those that can be joined."""
        right = nxt[places]
        with_right = right >= 0
        pair[places[~with_right]] = NONE
        places, right = places[with_right], right[with_right]
        found = merges.rank(tok[places], tok[right])
        pair[places] = found
        places, found = places[found != NONE], found[found != NONE]
        if not len(places):
            return
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        cuts = np.flatnonzero(np.diff(found)) + 1
        for r, group in zip(found[np.r_[0, cuts]].tolist(), np.split(places, cuts) if len(cuts) else [places]):
            if r in index:
                index[r].append(group)
            else:
                index[r] = [group]
                heapq.heappush(queue, r)

    enter(np.arange(n))
    while queue:
        r = heapq.heappop(queue)
        held = index.pop(r)
        at = held[0] if len(held) == 1 else np.concatenate(held)
        at = at[alive[at] & (pair[at] == r)]
        if len(held) > 1:
            at = np.unique(at)
        if not len(at):
            continue
        # of pairs that overlap in a row every second one is joined, from the left
        chained = np.zeros(len(at), dtype=bool)
        chained[1:] = nxt[at[:-1]] == at[1:]
        if chained.any():
            place = np.arange(len(at))
            run = np.maximum.accumulate(np.where(chained, 0, place))
            at = at[(place - run) % 2 == 0]
        right = nxt[at]
        after = nxt[right]
        tok[at] = r
        alive[right] = False
        nxt[at] = after
        prv[after[after >= 0]] = at[after >= 0]
        before = prv[at]
        enter(np.unique(np.concatenate([at, before[before >= 0]])))
    owner = np.repeat(np.arange(len(pieces)), lengths)
    return tok[alive], np.bincount(owner[alive], minlength=len(pieces))


class Encoder:
    """Encodes blocks of texts; keeps the ids of pieces it has met, up to KEPT_PIECES."""

    def __init__(self, path: str, pattern: str):
        self.merges = Merges(path)
        self.split = regex.compile(pattern).findall
        self.plain = re.compile(PLAIN).findall if pattern == public_tokenizers.PATTERN else None
        self.special = re.compile(SPECIAL).search
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.flat, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def learn(self) -> None:
        """Ids of the pieces that were added to ``known`` since the last call."""
        new = [p.encode() for p in list(self.known)[len(self.counts):]]
        if not new:
            return
        whole = np.array([self.merges.ranks.get(p, -1) for p in new], dtype=np.int32)
        parts, n = replay([b"" if w >= 0 else p for p, w in zip(new, whole)], self.merges)
        counts = np.where(whole >= 0, 1, n)
        flat = np.empty(int(counts.sum()), dtype=np.int32)
        is_whole = np.repeat(whole >= 0, counts)
        flat[is_whole], flat[~is_whole] = whole[whole >= 0], parts
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > KEPT_PIECES:
            self.forget()
        number, lines = self.known.__getitem__, []
        for text in texts:
            pieces = (self.split if self.plain is None or self.special(text) else self.plain)(text)
            lines.append(np.fromiter(map(number, pieces), np.int32, len(pieces)))
        self.learn()
        starts = np.cumsum(self.counts) - self.counts
        for line in lines:
            counts = self.counts[line]
            shift = starts[line] - (np.cumsum(counts) - counts)
            yield self.flat[np.repeat(shift, counts) + np.arange(int(counts.sum()))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.merges.bytes.__getitem__, ids))


def worker_encoder(path: str, pattern: str) -> Encoder:
    kept = worker_store()
    if ("bpe", path, pattern) not in kept:
        kept["bpe", path, pattern] = Encoder(path, pattern)
    return kept["bpe", path, pattern]


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again: id, n_tokens, ids_sha256, decoded_sha256 (and ``ids``).

    A null or empty text has no tokens; both digests are those of no bytes.  Null ids, repeated rows and further
    columns of any name do no harm: one row comes out per row, further columns are left out.  A long text is one
    line of the block it is in.  ``path`` names a rank file that every executor can open.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, pattern)
        decimal = encoder.merges.decimal.__getitem__
        for held in gather(batches, BLOCK_BYTES):
            ids_of = encoder.encode(["" if t is None else t for t in held.column("text").to_pylist()])
            counts, first, second, lists = [], [], [], []
            for ids in ids_of:
                plain = ids.tolist()
                counts.append(len(plain))
                first.append(hashlib.sha256(" ".join(map(decimal, plain)).encode()).hexdigest())
                second.append(hashlib.sha256(encoder.decode(plain)).hexdigest())
                if with_ids:
                    lists.append(plain)
            columns = {"doc_id": held.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()),
                       "ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(lists, pa.list_(pa.int32()))
            yield from pa.table(columns).to_batches()

    return narrow.mapInArrow(run, schema)


def gather(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Batches put together, and cut, to tables of about ``limit`` bytes; each has one row at least."""
    held, size = [], 0
    for batch in batches:
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, limit // per_row)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            size += per_row * part.num_rows
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
