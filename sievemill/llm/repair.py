"""Conversation structure repair by depth-first branch and bound.

Rows of a conversation are kept, given another role, deleted, or preceded by inserted turns until their roles read
``(system? (user assistant)+)?``.  The search walks an explicit stack in ASCII order of the edits; lower bounds on what the
rest of the rows must cost cut branches, a table per (row, place in the grammar) cuts prefixes that are no better than an
earlier one, and the incumbent (cost, audit) is proved optimal when the stack is empty.

A conversation may be as long as the table.  Rows are sorted over all partitions, and a conversation may cross them: each
partition then says of its part what it costs to come from any place in the grammar to any other, the driver joins these
4 x 4 tables from partition to partition, and each partition searches between the places that are chosen for it.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import stored
from sievemill.session import cut

#: rows of one partition of the sort, about; a task holds the rows of one conversation in one partition at once
PART_ROWS = 50_000
RETAG, DELETE, INSERT, MEND = 3, 4, 3, 3
#: places in the grammar: nothing yet, after system, after user, after assistant; the first and the last may end it
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (EMPTY, ASSISTANT)
#: the role that may be given or inserted at each place; after it the place is the same as the role's
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
FAR = 1 << 60

#: one row to the search: (initial of its role, whether it is truncated), or (None, how many rows must be deleted here)
Item = tuple[str | None, int]


def kept_at(place: int, initial: str) -> int | None:
    """Place after a row that is kept, or None where its role can't stand."""
    if initial == "s":
        return SYSTEM if place == EMPTY else None
    if initial == "u":
        return USER if place != USER else None
    return ASSISTANT if initial == "a" and place == USER else None


def branches(item: Item, place: int) -> list[tuple[str, int, int]]:
    """(edit, cost, place after it) of the edits that use up a row, in ASCII order."""
    initial, mark = item
    if initial is None:
        return [("D" * mark, DELETE * mark, place)]
    out, mend = [("D", DELETE, place)], MEND * mark
    after = kept_at(place, initial)
    if after is not None:
        out.append(("K", mend, after))
    out.append(("R", RETAG + mend, NEXT[place]))
    return out


def bounds(items: list[Item], leave: int | None = None) -> list[list[int]]:
    """Least cost from each place before each row to the place ``leave`` after the last (None: any end of the grammar)."""

    def with_inserts(cost: list[int]) -> list[int]:
        for _ in range(3):  # three inserts in a row lead back to where they began
            cost = [min(cost[g], INSERT + cost[NEXT[g]]) for g in range(4)]
        return cost

    out = [with_inserts([0 if (g in ENDS if leave is None else g == leave) else FAR for g in range(4)])]
    for item in reversed(items):
        rest = out[-1]
        out.append(with_inserts([min(cost + rest[g2] for _, cost, g2 in branches(item, g)) for g in range(4)]))
    out.reverse()
    return out


def search(items: list[Item], enter: int = EMPTY, leave: int | None = None, lower: list[list[int]] | None = None) -> tuple[int, list[str]] | None:
    """(cost, edits) of the cheapest repair, the ASCII-least of equally cheap ones; None where there is no way.

    Branches are tried in ASCII order, so among prefixes of equal cost the first to reach a row and place is the least, and
    among complete repairs of equal cost the first is.
    """
    lower = lower or bounds(items, leave)
    n = len(items)
    incumbent: tuple[int, tuple | None] = (lower[0][enter], None)
    if incumbent[0] >= FAR:
        return None
    seen = [[FAR] * 4 for _ in range(n + 1)]
    stack: list[tuple[int, int, int, tuple | None]] = [(0, enter, 0, None)]  # row, place, cost, edits as a linked list
    while stack:
        i, g, cost, path = stack.pop()
        if cost + lower[i][g] > incumbent[0] or (incumbent[1] is not None and cost + lower[i][g] == incumbent[0]) or seen[i][g] <= cost:
            continue
        seen[i][g] = cost
        if i == n and (g in ENDS if leave is None else g == leave):
            incumbent = (cost, (path,))
            continue
        ways = [("I", INSERT, NEXT[g])] if i == n else branches(items[i], g) + [("I", INSERT, NEXT[g])]
        for edit, more, after in sorted(ways, reverse=True):
            step = i + (edit != "I")
            if cost + more + lower[step][after] <= incumbent[0]:
                stack.append((step, after, cost + more, (edit, path)))
    edits, path = [], incumbent[1][0]
    while path is not None:
        edits.append(path[0])
        path = path[1]
    return incumbent[0], edits[::-1]


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n): rows as the contract damages them, ``n`` times each; 0 for a row that is dropped.

    A null conv_id or turn stands as one space in the key of the damage and stays null; a null role or text becomes one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.encode(F.concat(said(conv_col), F.lit(":"), said(turn_col)), "UTF-8")) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.translate(said(text_col), ".!?", "")).otherwise(said(text_col))
    return conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.when(harm == 4, "user").otherwise(said(role_col)).alias("role"), text.alias("text"),
        F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).cast("bigint").alias("n"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Different rows in the order of their conversations, with how often each occurs and whether its words came in an earlier turn.

    Equal rows are one with a count, so that a row that very many share is no single task's.  Of dropped rows one per conversation
    stays (n = 0, all else null), for conversations that lose everything.
    """
    gone = F.col("n") == 0
    rows = rows.select("conv_id", *[F.when(~gone, F.col(c)).alias(c) for c in ("turn", "role", "text")], "n")
    rows = stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("words", F.md5(F.encode("text", "UTF-8"))))
    when = F.struct(F.col("turn").isNotNull(), "turn")  # a null turn comes first
    first = stored(rows.where("n > 0").groupBy("conv_id", "role", "words").agg(F.min(when).alias("first")))
    same = rows["conv_id"].eqNullSafe(first["conv_id"]) & (rows["role"] == first["role"]) & (rows["words"] == first["words"])
    joined = rows.join(first, same, "left").select(
        rows["conv_id"], "turn", rows["role"], "text", "n", rows["words"], F.coalesce(F.col("first") < when, F.lit(False)).alias("again"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"))
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // PART_ROWS + 1)
    order = ["conv_id", "turn", "role", "words"]
    return cut(joined.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("words"))


#: the same in SQL: CRC-32 over the few characters of the key, then the least (cost, audit) per row and place, row by row
SQL = """
WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i,
  list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(k, ''), lambda x: CAST(unicode(x) AS BIGINT)),
  lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS h FROM k, t),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM h, range(CASE WHEN h = 3 THEN 2 ELSE 1 END) WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, substr(role, 1, 1) AS c,
  NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
  NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open FROM d),
f AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM o),
g AS (SELECT *, blank OR again AS gone, CASE WHEN open AND NOT blank AND NOT again THEN 3 ELSE 0 END AS mend FROM f),
place(g, u) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
edit(e) AS (VALUES ('D'), ('K'), ('R')), extra(n) AS (VALUES (0), (1), (2)),
path(conv_id, i, g, cost, audit, texts) AS (
  SELECT conv_id, 0, s.g, s.cost, s.audit, s.texts FROM (SELECT DISTINCT conv_id FROM conversations),
    (VALUES (0, 0, '', []::VARCHAR[]), (2, 3, 'I', ['user:']), (3, 6, 'II', ['user:', 'assistant:'])) s(g, cost, audit, texts)
  UNION ALL
  SELECT conv_id, i, g, cost, audit, texts FROM (
    SELECT conv_id, i, CASE n WHEN 0 THEN g WHEN 1 THEN u ELSE 5 - u END AS g, cost + 3 * n AS cost, audit || repeat('I', n) AS audit,
      texts || CASE n WHEN 0 THEN [] WHEN 1 THEN [CASE u WHEN 2 THEN 'user:' ELSE 'assistant:' END]
                      ELSE [CASE u WHEN 2 THEN 'user:' ELSE 'assistant:' END, CASE u WHEN 2 THEN 'assistant:' ELSE 'user:' END] END AS texts
    FROM (SELECT q.*, w.u FROM (
      SELECT b.conv_id, CAST(b.i AS INTEGER) AS i, CASE e WHEN 'D' THEN a.g WHEN 'R' THEN l.u ELSE CASE b.c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS g,
        a.cost + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 + mend ELSE mend END AS cost, a.audit || e AS audit,
        a.texts || CASE e WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE l.u WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] END AS texts
      FROM path a JOIN g b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = a.i + 1 JOIN place l ON l.g = a.g, edit
      WHERE e = 'D' OR NOT gone AND (e = 'R' OR (b.c = 's' AND a.g = 0) OR (b.c = 'u' AND a.g <> 2) OR (b.c = 'a' AND a.g = 2))) q
      JOIN place w ON w.g = q.g), extra)
  QUALIFY row_number() OVER (PARTITION BY conv_id, g ORDER BY cost, audit) = 1),
facts AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (again) AS duplicate, count(*) FILTER (mend > 0) AS truncated,
  count(*) FILTER (p IS NOT NULL AND p || c NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
ends AS (SELECT c.conv_id, coalesce(f.n, 0) AS n, gaps, blank, duplicate, truncated, illegal FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(array_to_string(texts, chr(10))) AS repaired_sha256
FROM ends c JOIN path a ON a.conv_id IS NOT DISTINCT FROM c.conv_id AND a.i = c.n WHERE a.g IN (0, 3)
QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY cost, audit) = 1"""


class Run:
    """The rows of one conversation in one partition."""

    def __init__(self, conv):
        self.conv, self.rows, self.items = conv, [], []  # rows: (role, text) of the items that are no deletion
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.low, self.high = 0, None, None
        self.first = self.last = None  # initials
        self.first_turn = self.last_turn = None

    def add(self, turn, role: str, text: str, n: int, again: bool, blank: bool, unended: bool) -> None:
        if n == 0:
            return
        initial = role[:1]
        if self.last is None:
            self.first, self.first_turn = initial, turn
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += (n - 1) * (initial * 2 not in LEGAL)
        self.last = initial
        if turn is not None:
            self.turns += turn != self.last_turn
            self.low, self.high = turn if self.low is None else self.low, turn
        self.last_turn = turn
        if blank:
            self.blank += n
            gone = n
        else:
            gone = n if again else n - 1
            self.duplicate += gone
            if not again:
                self.truncated += unended
                self.items.append((initial, int(unended)))
                self.rows.append((role, text))
        if gone:
            if self.items and self.items[-1][0] is None:
                gone += self.items.pop()[1]
            self.items.append((None, gone))

    def lines(self, edits: list[str], place: int) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that remain, beginning at a place in the grammar."""
        at, rows = 0, iter(self.rows)
        for edit in edits:
            if edit == "I":
                place = NEXT[place]
                yield edit, NAMES[place], ""
                continue
            if self.items[at][0] is not None:
                role, text = next(rows)
                if edit == "K":
                    place = kept_at(place, role[:1])
                    yield edit, role, text
                elif edit == "R":
                    place = NEXT[place]
                    yield edit, NAMES[place], text
            at += 1

    def table(self) -> list[tuple[int, int, int, int]]:
        """(place before, place after, cost, rank of its audit among the places after) of all ways through this part."""
        out = []
        lower = [bounds(self.items, leave) for leave in range(4)]
        for enter in range(4):
            found = [search(self.items, enter, leave, lower[leave]) for leave in range(4)]
            order = sorted(("".join(f[1]), leave) for leave, f in enumerate(found) if f)
            out.extend((enter, leave, found[leave][0], rank) for rank, (_, leave) in enumerate(order))
        return out

    def facts(self) -> dict:
        names = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last", "first_turn", "last_turn")
        return {k: getattr(self, k) for k in names}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "again", "blank", "open")))

    for conv, group in groupby(rows(), key=lambda r: r[0]):
        run = Run(conv)
        for r in group:
            run.add(*r[1:])
        yield run


def _joined(facts: list[dict]) -> dict:
    """Counts of a conversation from those of its parts, in order."""
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    turns, low, high, last, last_turn = 0, None, None, None, None
    for f in facts:
        for k in total:
            total[k] += f[k]
        if f["first"] is None:
            continue
        if last is not None:
            total["illegal"] += last + f["first"] not in LEGAL
        turns += f["turns"] - (f["first_turn"] is not None and f["first_turn"] == last_turn)
        if f["low"] is not None:
            low, high = f["low"] if low is None else low, f["high"]
        last, last_turn = f["last"], f["last_turn"]
    return {"gaps": 0 if low is None else high - low + 1 - turns, **total}


def _chosen(tables: list[list[tuple]]) -> list[tuple[int, int]]:
    """Places before and after each part of a conversation on its cheapest, then ASCII-least repair.

    Where two ways cost the same, the audits decide in the first part that they differ in: one of them can't begin with the
    other but for inserts at its end, and there the shorter is no worse, as what follows may insert the same.
    """
    ahead = [0 if g in ENDS else FAR for g in range(4)]
    picks = []
    for table in reversed(tables):
        best = [(FAR, 0, 0)] * 4
        for enter, leave, cost, rank in table:
            best[enter] = min(best[enter], (cost + ahead[leave], rank, leave))
        picks.append([leave for _, _, leave in best])
        ahead = [cost for cost, _, _ in best]
    out, place = [], EMPTY
    for pick in reversed(picks):
        out.append((place, pick[place]))
        place = pick[place]
    return out


def _crossings(ordered: DataFrame) -> dict[tuple[int, int], tuple]:
    """(partition, 0 for its first and -1 for its last conversation) -> (places before and after, counts, part number) for the
    conversations that cross partitions; at most two entries per partition."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, count = None, None, 0
        for run in _runs(batches):
            first, last, count = first or run, run, count + 1
        if count:
            ends = [first] if count == 1 else [first, last]
            for k, run in enumerate(ends):
                said = {**run.facts(), "table": run.table(), "alone": count == 1}
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([-k], pa.int32()), pa.array([repr(run.conv)]), pa.array([repr(said)])], names=["part", "end", "conv", "said"])

    rows = sorted(ordered.mapInArrow(sum_up, "part int, end int, conv string, said string").collect(), key=lambda r: (r["part"], -r["end"]))
    out: dict[tuple[int, int], tuple] = {}
    for _, group in groupby(rows, key=lambda r: r["conv"]):
        group = list(group)
        if len(group) > 1:
            said = [ast.literal_eval(r["said"]) for r in group]
            total = _joined(said)
            for k, (r, places) in enumerate(zip(group, _chosen([s["table"] for s in said]))):
                for end in (0, -1) if said[k]["alone"] else (r["end"],):
                    out[r["part"], end] = (places, total if k == 0 else None, k)
    return out


def _solved(batches: Iterator[pa.RecordBatch], crossings: dict) -> Iterator[tuple[Run, int, list[str], int, dict | None, int | None]]:
    """(run, cost, edits, place before it, counts, part number) in order; the number is null where a conversation is whole."""
    part, held, first = TaskContext.get().partitionId(), None, True

    def solve(run: Run, end: int | None) -> tuple:
        if end is not None and (part, end) in crossings:
            (enter, leave), total, k = crossings[part, end]
            cost, edits = search(run.items, enter, leave)
            return run, cost, edits, enter, total, k
        cost, edits = search(run.items)
        return run, cost, edits, EMPTY, _joined([run.facts()]), None

    for run in _runs(batches):
        if held is not None:
            yield solve(held, 0 if first else None)
            first = False
        held = run
    if held is not None:
        yield solve(held, -1)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, part, place, edit (K, R or I), role, text; ordered by part and place.

    ``rows`` are (conv_id, turn, role, text, n) as ``damage`` returns them.  Null roles and texts are not allowed.
    """
    ordered = _ordered(rows)
    shared = rows.sparkSession.sparkContext.broadcast(_crossings(ordered))
    conv, schema = rows.schema["conv_id"].dataType.simpleString(), ordered.schema

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def known(batches):
            nonlocal kind
            for b in batches:
                kind = b.schema.field("conv_id").type
                yield b

        for run, _, edits, place, _, part in _solved(known(batches), shared.value):
            found = list(zip(*run.lines(edits, place))) or [(), (), ()]
            n = len(found[0])
            yield pa.RecordBatch.from_arrays([pa.array([run.conv] * n, kind), pa.array([part or 0] * n, pa.int32()), pa.array(range(n), pa.int64()), *(pa.array(x, pa.string()) for x in found)], names=["conv_id", "part", "place", "edit", "role", "text"])

    return ordered.mapInArrow(turns, f"conv_id {conv}, part int, place bigint, edit string, role string, text string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` are (conv_id, turn, role, text, n) as ``damage`` returns them: each stands for ``n`` equal rows, those with 0 only keep
    their conversation in the result.  Rows of a turn are in the order of role and of the text's MD5, a null turn comes first, a
    null conv_id is a conversation.  Equal rows count one by one.  An empty table gives no rows; further columns are left out.

    A conversation within one partition is done there.  The parts of a crossing one come together in order in one stream, which
    holds its audit but not its texts: a digest can't be joined from parts.
    """
    ordered = _ordered(rows)
    shared = rows.sparkSession.sparkContext.broadcast(_crossings(ordered))
    conv = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256", "part", "texts"]
    types = [None, *[pa.int64()] * len(COUNTS), pa.large_string(), pa.string(), pa.int32(), pa.large_binary()]
    schema = f"conv_id {conv}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string, part int, texts binary"

    def batch(made: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        out = [pa.array(c, t or kind) for c, t in zip(zip(*made), types)]
        out[names.index("audit")] = out[names.index("audit")].cast(pa.string())
        out[names.index("texts")] = out[names.index("texts")].cast(pa.binary())
        return pa.RecordBatch.from_arrays(out, names=names)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, kind = [], None

        def known(batches):
            nonlocal kind
            for b in batches:
                kind = b.schema.field("conv_id").type
                yield b

        for run, cost, edits, place, counts, part in _solved(known(batches), shared.value):
            texts = [f"{role}:{text}" for _, role, text in run.lines(edits, place)]
            counts = counts or dict.fromkeys(COUNTS, 0)
            digest = hashlib.sha256("\n".join(texts).encode()).hexdigest() if part is None else None
            made.append((run.conv, *[cost if c == "cost" else counts[c] for c in COUNTS], "".join(edits), digest, part, None if part is None or not texts else "\n".join(texts).encode()))
            if len(made) >= 1000:
                yield batch(made, kind)
                made = []
        if made:
            yield batch(made, kind)

    solved = stored(ordered.mapInArrow(solve, schema))
    final = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows():
            nonlocal kind
            for b in batches:
                kind = b.schema.field("conv_id").type
                for i in range(b.num_rows):
                    yield tuple(b.column(c)[i].as_py() for c in names)

        for conv, group in groupby(rows(), key=lambda r: r[0]):
            total, audit, digest, empty = [0] * len(COUNTS), [], hashlib.sha256(), True
            for r in group:
                total = [a + b for a, b in zip(total, r[1:])]
                audit.append(r[names.index("audit")])
                if r[-1] is not None:
                    digest.update(r[-1] if empty else b"\n" + r[-1])
                    empty = False
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), *(pa.array([n], pa.int64()) for n in total), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=final)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crossing = solved.where("part is not null").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part")
    return solved.where("part is null").select(*final).unionByName(crossing.mapInArrow(stream, ", ".join(schema.split(", ")[:-2])))
