"""Best-fit packing of tokenized documents into sequences of fixed capacity by exact-complement hashing.

Packing depends on lengths alone, and there are at most ``capacity`` of them.  So the plan is made on the histogram of
lengths, whose size has nothing to do with the number of documents: it says how many sequences hold which lengths.
Every piece then finds its place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.llm.common import stored, tidy, worker_store
from sievemill.llm.features import SPACE

CAPACITY = 2048
#: id that ends each document
END = 0
#: distinct words a worker keeps, and pieces that share one rank group of a length
KEPT_WORDS, GROUP_PIECES = 400_000, 100_000
#: bytes of text encoded at once; a step's arrays take some forty times as much
WORD_STEP = 1 << 20


def _words(column: pa.Array, special: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of a string column, as bytes and told apart, and how many each text has; only ASCII white space parts them.

    ASCII letters come in lower case, unless that would make one of the ``special`` strings: these stand for themselves only as
    they are written.
    """
    texts = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if ends[-1] > ends[0] else b""
    low = data.lower()
    data = np.frombuffer(data if any(t in low for t in special) else low, np.uint8)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = (ends[:-1] - ends[0])[np.diff(ends) > 0]
    first[begins] = inside[begins]  # a word ends with its text
    # a full stop or comma that ends a word, after an ASCII letter, is a word of its own: tokenizers split there
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    marks = np.flatnonzero(last & ~first & ((data == ord(".")) | (data == ord(","))))
    first[marks[(data[marks - 1] >= ord("a")) & (data[marks - 1] <= ord("z"))]] = True
    starts = np.flatnonzero(first)
    letters = np.cumsum(inside, dtype=np.int32 if len(inside) < 1 << 31 else np.int64)
    offsets = np.append(letters[starts] - 1, letters[-1] if len(letters) else 0).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words.dictionary_encode(), np.diff(np.searchsorted(starts, ends - ends[0]))


class WordIds:
    """Ids of texts by a tokenizer that never joins across ASCII white space and lower-cases: each distinct word is encoded once.

    Strings of special tokens are encoded as the tokenizer encodes them, wherever in a word they stand.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(count.sum())), count

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encode`` for words of letters only, many in one call: each of them ends with an id that ends a word, and has no other."""
        ids, _ = self._encode([" ".join(words[i : i + 200]) for i in range(0, len(words), 200)])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            return self._encode(words)
        return ids, np.diff(last, prepend=-1).astype(np.int32)

    def _learn(self, words: list[bytes]) -> None:
        """Give each new word a slot: a run of ids in ``flat``."""
        texts = [w.decode() for w in words]
        plain = [t.isalpha() for t in texts]
        other = [not p for p in plain]
        ids, count = self._together(list(compress(texts, plain)))
        more, counts = self._encode(list(compress(texts, other)))
        self._keep([*compress(words, plain), *compress(words, other)], np.concatenate([ids, more]), np.concatenate([count, counts]))

    def _keep(self, words: list[bytes], ids: np.ndarray, count: np.ndarray) -> None:
        self.slot.update(zip(words, range(len(self.slot), len(self.slot) + len(words))))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count, dtype=np.int32) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, ids])

    def _forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.flat, self.first, self.count = np.zeros(0, "<u4"), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self._keep([b" "], np.array([END], "<u4"), np.ones(1, np.int32))  # slot 0 ends a document; no word is a space

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each followed by END, and where each text's end.

        Words are split in numpy and told apart in Arrow; Python meets each different word of the step once, and the ids of all
        occurrences are taken by index.
        """
        if len(self.slot) > KEPT_WORDS:
            self._forget()
        told, held = _words(texts, self.special)
        words = told.dictionary.to_pylist()
        fresh = [w for w in words if w not in self.slot]
        if fresh:
            self._learn(fresh)
        slots = np.fromiter(map(self.slot.__getitem__, words), np.int32, len(words))
        last = np.cumsum(held + 1) - 1
        inside = np.ones(len(told) + len(texts), dtype=bool)
        inside[last] = False
        at = np.zeros(len(inside), dtype=np.int32)
        at[inside] = slots[told.indices.to_numpy(zero_copy_only=False)]
        count = self.count[at]
        total = np.cumsum(count, dtype=np.int64)
        take = np.repeat((self.first[at] - (total - count)).astype(np.int32), count)
        take += np.arange(len(take), dtype=np.int32)
        return self.flat[take], total[last]


def slices(column: pa.Array, limit: int = WORD_STEP) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of a string column, about ``limit`` bytes each, with the first one's index; a longer text is a part of its own."""
    size = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(column):
        before = size[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield first, column.slice(first, stop - first)
        first = stop


def worker_words(path: str) -> WordIds:
    kept = worker_store()
    if ("words", path) not in kept:
        kept["words", path] = WordIds(path)
    return kept["words", path]


def cut_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize whole texts and cut those longer than ``capacity``: doc_id, piece, start, length, ids_crc32."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(path)
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                owner, piece, start, length, crc = [], [], [], [], []
                ids, ends = words.encode(texts)
                ids, low = memoryview(np.ascontiguousarray(ids)).cast("B"), 0
                for i, high in enumerate(ends.tolist()):
                    for k, s in enumerate(range(low, high, capacity)):
                        stop = min(s + capacity, high)
                        owner.append(first + i)
                        piece.append(k)
                        start.append(s - low)
                        length.append(stop - s)
                        crc.append(zlib.crc32(ids[4 * s : 4 * stop]))
                    low = high
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return narrow.mapInArrow(tidy(run, "words"), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


Pattern = tuple[tuple[tuple[int, int], ...], int]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """How to fill sequences: (((length, how many), ...), number of such sequences); ``counts[n]`` pieces have length n.

    From the longest length down, its gap is looked up among single lengths, then sums of two, then sums of three, and the
    combination is consumed as often as its scarcest length allows.  With several at hand, the one with the longest
    pieces goes first, as short pieces fit elsewhere.  What has no exact complement is placed best-fit, longest first.
    """
    left = np.array(counts, dtype=np.int64)
    out: list[Pattern] = []

    def consume(lengths: list[int]) -> None:
        each = {n: lengths.count(n) for n in sorted(set(lengths), reverse=True)}
        times = min(int(left[n]) // k for n, k in each.items())
        for n, k in each.items():
            left[n] -= times * k
        out.append((tuple(each.items()), times))

    if left[capacity]:
        consume([capacity])
    for longest in range(capacity - 1, 0, -1):
        while left[longest]:
            gap = capacity - longest
            others = _complement(left, longest, gap)
            if others is None:
                break
            consume([longest, *others])
    out.extend(_best_fit(left, capacity))
    return out


def _complement(left: np.ndarray, longest: int, gap: int) -> list[int] | None:
    """One, two or three available lengths, none over ``longest``, that sum up to ``gap``; ``longest`` itself is used once already."""
    have = left.copy()
    have[longest] -= 1
    if gap <= longest and have[gap]:
        return [gap]
    top = min(gap - 1, longest)
    if top < 1:
        return None
    here = have[: gap + 1] > 0
    here[longest + 1 :] = False
    here[0] = False
    twice = have[: gap + 1] > 1
    # sums of two: n and gap - n, or one length twice
    pair = here & here[::-1]
    if gap % 2 == 0:
        pair[gap // 2] = twice[gap // 2] and here[gap // 2]
    found = np.flatnonzero(pair)
    if len(found):
        return [int(found[-1]), gap - int(found[-1])]
    # sums of three: an available length, and a rest that some two lengths sum up to
    size = 1 << (2 * gap + 1).bit_length()
    spectrum = np.fft.rfft(here.astype(float), size)
    sums = np.fft.irfft(spectrum * spectrum, size)[: gap + 1] > 0.5
    for a in np.flatnonzero(here & sums[::-1])[::-1].tolist():
        rest, have[a] = gap - a, have[a] - 1
        b = np.arange(rest // 2, rest)
        b = b[(b >= 1) & (b <= longest)]
        ok = (have[b] > 0) & (have[rest - b] > 0) & ((2 * b != rest) | (have[b] > 1))
        if ok.any():
            most = int(b[ok][-1])
            return [a, most, rest - most]
        have[a] += 1
    return None


def _best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: sequences that hold the same are one entry."""
    gaps: list[int] = []  # sorted gaps that some open sequence has
    held: dict[int, list[Pattern]] = {}

    def put(gap: int, lengths: tuple, times: int) -> None:
        if times and gap not in held:
            bisect.insort(gaps, gap)
            held[gap] = []
        if times:
            held[gap].append((lengths, times))

    for n in range(capacity, 0, -1):
        rest = int(left[n])
        while rest:
            at = bisect.bisect_left(gaps, n)
            gap, (lengths, times) = (gaps[at], held[gaps[at]].pop()) if at < len(gaps) else (capacity, ((), rest))
            if at < len(gaps) and not held[gap]:
                del held[gap], gaps[at]
            fits = gap // n
            full = min(times, rest // fits)
            put(gap - fits * n, (*lengths, (n, fits)), full)
            rest -= full * fits
            opened = times - full
            if rest and opened and rest < fits:
                put(gap - rest * n, (*lengths, (n, rest)), 1)
                rest, opened = 0, opened - 1
            if lengths:
                put(gap, lengths, opened)
    return [entry for group in held.values() for entry in group]


def slots(patterns: list[Pattern]) -> pd.DataFrame:
    """For each length, runs of ranks: piece ``first + i`` goes to sequence ``base + i // each``, at ``offset + i % each * length``."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, times in patterns:
        offset = 0
        for n, each in lengths:
            first = used.get(n, 0)
            rows.append((n, first, base, each, offset))
            used[n] = first + times * each
            offset += n * each
        base += times
    table = pd.DataFrame(rows, columns=["length", "first", "base", "each", "offset"], dtype="int64")
    return table.sort_values(["length", "first"], ignore_index=True)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row per piece.

    A null or empty text is a document of the end id alone.  Repeated rows and repeated or null ids are documents of their
    own; equal pieces may change places.  An empty table gives no rows; further columns are left out.  Pieces of one
    length are ranked in groups by a hash of their id, so that a length that very many share is no single task's.
    """
    pieces = stored(cut_pieces(docs, path, capacity, id_col, text_col))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # capacity rows at most
        histogram[r["length"]] = r["count"]
    table = slots(plan(histogram, capacity))
    groups = max(64, int(histogram.sum()) // GROUP_PIECES)
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = grouped.groupBy("length", "_group").count()  # capacity x groups rows at most
    sizes = sizes.select("length", "_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")
    ranked = grouped.withColumn("_rank", F.row_number().over(within) - 1).join(sizes, ["length", "_group"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))
    shared = docs.sparkSession.sparkContext.broadcast({c: table[c].to_numpy() for c in table})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        order = runs["length"] << 48 | runs["first"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(order, length << 48 | rank, side="right") - 1
            i = rank - runs["first"][at]
            sequence = runs["base"][at] + i // runs["each"][at]
            offset = runs["offset"][at] + i % runs["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
