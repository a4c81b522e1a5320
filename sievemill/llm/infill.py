"""Fill-in-the-middle texts by secondary-sort assembly.

A document is cut into prefix, middle and suffix, and these into chunks.  Every chunk is a piece of its own, keyed by the
document and its place in the output; ``repartitionAndSortWithinPartitions`` brings the pieces into output order, where
they stream into a text or an incremental digest.  To restore, the stream is taken apart at its markers, pieces are keyed
by their place in the text and sorted again, in the same partitions.  No task needs a document in one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.llm.common import annotate

#: code points in one piece, and bytes of text in one partition of the sort, about
CHUNK, PART_BYTES = 1 << 14, 64 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: markers of each form in output order, and the place of what follows each in the text
MARKS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE), "plain": ()}
SECTION = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: place of the record that opens a document
HEAD = -1


def choose(doc_id, text: str, seed: int = 1, transformed: int = 90, suffix_first: int = 20) -> tuple[str, int, int]:
    """Form, end of the prefix and end of the middle, by a hash of the seed and the id (a null id counts as no digits)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    first, second = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(mark in text for mark in SECTION) or h3 % 100 >= transformed:
        return "plain", first, second
    return ("spm" if h4 % 100 < suffix_first else "psm"), first, second


def pieces_of(text: str, form: str, first: int, second: int, chunk: int = CHUNK) -> Iterator[tuple[int, str]]:
    """(place in the output, piece); a marker leads the first piece of its section."""
    ends = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, len(text))}
    at = 0
    for mark, (low, high) in [(m, ends[m]) for m in MARKS[form]] or [("", (0, len(text)))]:
        for start in range(low, max(high, low + 1), chunk):
            piece = (mark if start == low else "") + text[start : min(start + chunk, high)]
            if piece:
                yield at, piece
            at += len(piece)


def sections(form: str, pieces: Iterator[str]) -> Iterator[tuple[int, int, str]]:
    """(section, place in the section, part) of an output that comes in pieces cut anywhere; markers are found in the stream."""
    wanted, section, at, held = list(MARKS[form]), 0, 0, ""
    for piece in pieces:
        held += piece
        while wanted and (found := held.find(wanted[0])) >= 0:
            if found:
                yield section, at, held[:found]
            held = held[found + len(wanted[0]) :]
            section, at = SECTION[wanted.pop(0)], 0
        # the beginning of a marker may still wait for its end
        ready = len(held) - (len(wanted[0]) - 1 if wanted else 0)
        if ready > 0:
            yield section, at, held[:ready]
            at, held = at + ready, held[ready:]
    if held:
        yield section, at, held


def _home(key: tuple) -> int:
    return int.from_bytes(key[0][:7], "little") + 0x9E3779B1 * key[1]


def assemble(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, transformed: int = 90, suffix_first: int = 20, chunk: int = CHUNK) -> RDD:
    """Pieces of all documents in output order, as sorted partitions of ((document, input partition, place), piece).

    A document is known by a digest of its id and text.  Equal rows of one input partition have the same key and are told
    apart by the number of their head records alone, so their order never matters when a lost task runs again, and copies
    of a row are dealt over as many partitions as they come from.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)

    def emit(part: int, rows: Iterator) -> Iterator[tuple]:
        for doc_id, text in rows:
            text = text or ""
            key = hashlib.blake2b(f"{doc_id!r}:".encode() + text.encode("utf-8", "replace"), digest_size=16).digest()
            form, first, second = choose(doc_id, text, seed, transformed, suffix_first)
            yield (key, part, HEAD), (doc_id, len(text), form, *((None, None) if form == "plain" else (first, second - first)))
            for at, piece in pieces_of(text, form, first, second, chunk):
                yield (key, part, at), piece

    return narrow.rdd.mapPartitionsWithIndex(emit).repartitionAndSortWithinPartitions(n, _home)


def _documents(records: Iterator[tuple]) -> Iterator[tuple[tuple, int, tuple, Iterator[str]]]:
    """(key, number of equal rows, head, pieces in order) of each document; the pieces are read as they come."""
    for key, group in groupby(records, key=lambda r: r[0][:2]):
        copies, head, opened = 0, None, []
        for place, value in group:
            if place[2] != HEAD:
                opened = [(place, value)]
                break
            copies, head = copies + 1, value

        def once(rest=chain(opened, group)) -> Iterator[str]:
            last = None
            for place, piece in rest:
                if place[2:] != last:
                    yield piece
                last = place[2:]

        yield key, copies, head, once()


def _frame(docs: DataFrame, rows: RDD, id_col: str, *fields: T.StructField) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), *fields])
    return docs.sparkSession.createDataFrame(rows, schema, verifySchema=False)


def transform(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output.

    ``n`` counts code points; prefix and middle are null for plain texts, whose output is the text.  A null text is empty, an
    empty one plain, as is one that contains a marker.  Repeated rows and ids stay rows of their own; further columns are
    left out; an empty table gives no rows.  Very long texts travel in pieces.
    """
    def join(records):
        for _, copies, head, pieces in _documents(records):
            row = (*head, "".join(pieces))
            yield from [row] * copies

    return _frame(docs, assemble(docs, id_col, **options).mapPartitions(join), id_col, T.StructField("output", T.StringType()))


def restore(outputs: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """``outputs`` with the column ``restored``: the text that form and output came from (null where either is null or the form unknown)."""
    def make(columns):
        found = []
        for form, output in zip(*(c.to_pylist() for c in columns)):
            known = output is not None and form in MARKS
            found.append("".join(part for _, _, part in sorted(sections(form, iter([output])))) if known else None)
        return [found]

    return annotate(outputs, [form_col, output_col], [T.StructField("restored", T.StringType())], make)


def digests(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """As ``transform``, with SHA-256 of the output and of the text restored from it instead of the output itself.

    Both are fed piece by piece, so a text of any length takes no more memory than its sort may hold before it spills.
    """
    assembled = assemble(docs, id_col, **options)

    def take_apart(records):
        for key, copies, head, pieces in _documents(records):
            output = hashlib.sha256()

            def heard(pieces=pieces, output=output):
                for piece in pieces:
                    output.update(piece.encode("utf-8", "replace"))
                    yield piece

            for section, at, part in sections(head[2], heard()):
                yield (*key, section, at), part
            yield (*key, HEAD, 0), (head, copies, output.hexdigest())

    def put_together(records):
        for _, group in groupby(records, key=lambda r: r[0][:2]):
            _, (head, copies, output) = next(group)
            text = hashlib.sha256()
            for _, part in group:
                text.update(part.encode("utf-8", "replace"))
            yield from [(*head, output, text.hexdigest())] * copies

    # keys keep their first two fields, so the partitions stay and only the order in them is new
    apart = assembled.mapPartitions(take_apart, preservesPartitioning=True)
    restored = apart.repartitionAndSortWithinPartitions(assembled.getNumPartitions(), _home).mapPartitions(put_together)
    return _frame(docs, restored, id_col, T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType()))


#: the same in SQL, on code points, with the text rebuilt from the output
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
y AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
o AS (SELECT *, CASE form WHEN 'plain' THEN t
  WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
  ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS out FROM y),
p AS (SELECT *, strpos(out, '<P>') AS p, strpos(out, '<S>') AS s, strpos(out, '<M>') AS m FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars, sha256(out) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN out WHEN 'psm' THEN substr(out, 4, s - 4) || substr(out, m + 3) || substr(out, s + 3, m - s - 3)
    ELSE substr(out, p + 3, m - p - 3) || substr(out, m + 3) || substr(out, 4, p - 4) END) AS restored_sha256
FROM p"""
