"""Chat formatting: a hidden Markov model over lines recovers who speaks, then turns are rendered in one form.

States are roles.  A line is seen as its speaker marker ("User:", "### Assistant", "<|system|>"), its length, whether it
asks, and whether it opens a row.  Rows of a conversation, in order, are one chain; the best roles come from Viterbi.

A chain may be as long as the table.  So rows are sorted over all partitions, and a chain may cross them: each partition
sums up its part of a crossing chain as best scores from state to state, the driver joins these small tables from
partition to partition, and each partition then decodes its rows with what comes before and after it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sievemill.session import cut

#: roles that every model has, and the words that name them
SPEAKERS = {
    "assistant": "assistant ai bot chatbot gpt model agent answer response a",
    "system": "system sys instruction instructions context",
    "user": "user human customer client question prompt me q",
    "tool": "tool function observation",
}
NAMED = {word: role for role, words in SPEAKERS.items() for word in words.split()}
_WORDS = "|".join(sorted(NAMED, key=len, reverse=True))
#: a marker at the start of a line: a name between brackets or signs, or before a colon
MARKER = re.compile(rf"^\s*(?:<\|(?:im_start\|>)?\s*({_WORDS})\b\s*(?:\|>)?|[\[({{]\s*({_WORDS})\s*[\])}}]\s*:?|(?:\#+|\*+|>+|-)?\s*({_WORDS})\s*\**\s*(?::|>|\s-\s)\**|\#+\s*({_WORDS})\s*$)\s*", re.I)
#: log-chances of a line with the marker of its own role, of another role, and with none
OWN, OTHER, PLAIN = np.log(0.3), np.log(1e-9), np.log(0.6)
#: chance of a change of role inside a row, at a line without and with a marker
CHANGES = (1e-6, 1e-2)
LENGTHS = 14
#: given roles that become states, at most; a step of the chain costs the square of their number
ROLES = 256
BEGIN, END = "<|{}|>\n", "<|end|>\n"


def observe(text: str) -> list[tuple[str, str | None, int, int]]:
    """Each line without its marker, the role it names, its length class and whether it asks."""
    out = []
    for line in text.split("\n"):
        found = MARKER.match(line)
        role = NAMED[next(g for g in found.groups() if g).lower()] if found else None
        rest = line[found.end() :] if found else line
        out.append((rest, role, min(len(rest).bit_length(), LENGTHS - 1), int("?" in rest)))
    return out


def _held_out(conv) -> bool:
    return conv is not None and zlib.crc32(str(conv).encode()) % 5 == 0


class Counts:
    """What training counts: first roles, roles after roles, and looks of opening and of further lines by role."""

    def __init__(self, roles: list[str]):
        n = len(roles)
        self.roles, self.at = roles, {r: i for i, r in enumerate(roles)}
        self.first, self.after = np.zeros(n), np.zeros((n, n))
        self.length, self.asks = np.zeros((2, n, LENGTHS)), np.zeros((2, n, 2))

    def arrays(self) -> list[np.ndarray]:
        return [self.first, self.after, self.length, self.asks]

    def pack(self) -> bytes:
        return np.concatenate([a.ravel() for a in self.arrays()]).tobytes()

    def add(self, packed: bytes) -> None:
        flat, at = np.frombuffer(packed), 0
        for a in self.arrays():
            a += flat[at : at + a.size].reshape(a.shape)
            at += a.size

    def logs(self) -> dict:
        share = lambda a, plus: np.log((a + plus) / (a + plus).sum(axis=-1, keepdims=True))
        return {"roles": self.roles, "first": share(self.first, 0.5), "after": share(self.after, 0.5), "length": share(self.length, 0.5), "asks": share(self.asks, 0.5)}


def _emissions(lines, model: dict) -> np.ndarray:
    """Log-chance of each line in each role."""
    roles = model["roles"]
    out = np.empty((len(lines), len(roles)))
    for i, (_, marker, length, asks) in enumerate(lines):
        opening = 0 if i == 0 else 1
        mark = PLAIN if marker is None else np.array([OWN if r == marker else OTHER for r in roles])
        out[i] = model["length"][opening, :, length] + model["asks"][opening, :, asks] + mark
    return out


def _inside(n: int) -> list[np.ndarray]:
    """Log-chances from role to role inside a row, at a line without and with a marker."""
    shares = [min(change, 0.5 / max(n - 1, 1)) for change in CHANGES]  # to each other role
    return [np.log(np.where(np.eye(n) > 0, 1 - (n - 1) * share, share)) for share in shares]


def _forward(score: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best scores after one step; ``score`` has states last, any number of starting points before."""
    return (score[..., :, None] + step).max(axis=-2)


def _row_scores(score: np.ndarray | None, lines, model: dict) -> np.ndarray:
    """Scores at the end of a row; ``score`` None begins a chain."""
    emit, inside = _emissions(lines, model), _inside(len(model["roles"]))
    score = (model["first"] if score is None else _forward(score, model["after"])) + emit[0]
    for (_, marker, _, _), e in zip(lines[1:], emit[1:]):
        score = _forward(score, inside[marker is not None]) + e
    return score


def _decode(rows: list, model: dict, before: np.ndarray | None, after: np.ndarray) -> list[list[int]]:
    """Best roles of all lines of a chain's rows, given the scores before its first row and the best still to come."""
    inside, score, back, sizes = _inside(len(model["roles"])), before, [], []
    for lines in rows:
        emit = _emissions(lines, model)
        sizes.append(len(lines))
        for i, e in enumerate(emit):
            if score is None:
                score = model["first"] + e
                back.append(None)
                continue
            reach = score[:, None] + (model["after"] if i == 0 else inside[lines[i][1] is not None])
            back.append(reach.argmax(axis=0))
            score = reach.max(axis=0) + e
            score -= score.max()
    state = int((score + after).argmax())
    path = []
    for pointer in reversed(back):
        path.append(state)
        if pointer is not None:
            state = int(pointer[state])
    path.reverse()
    out, at = [], 0
    for n in sizes:
        out.append(path[at : at + n])
        at += n
    return out


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Consecutive rows of one conversation: (conv, [(turn, role, text), ...]); a row without a conversation stands alone."""
    def rows():
        alone = 0
        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                alone += conv is None
                yield (conv, alone if conv is None else 0), turn, role, text

    for (conv, _), group in groupby(rows(), key=lambda r: r[0]):
        yield conv, ((turn, role, text) for _, turn, role, text in group)


def render(lines, roles: list[str]) -> str:
    """Canonical turns: each run of lines of one role between its opening and the end mark."""
    out = []
    for role, group in groupby(zip(roles, lines), key=lambda x: x[0]):
        out.append(BEGIN.format(role) + "\n".join(line[0] for _, line in group).strip() + "\n" + END)
    return "".join(out)


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", max_roles: int = ROLES) -> DataFrame:
    """One row per row: conv_id, turn, held_out, role_pred, n_lines, line_roles, rendered.

    Rows of a conversation are one chain in the order of turn (null first; ties by text).  ``role_pred`` is the role of a
    row's first line, ``line_roles`` the runs of roles in it ("user*2,assistant*1"), ``rendered`` its canonical turns,
    without speaker markers.  Given roles are learned from where crc32 of conv_id modulo 5 is not 0 and are never looked at
    when a row is decoded.  States are the ``max_roles`` most frequent given roles (ties by name) and assistant, system and user;
    rows of rarer roles teach nothing, and each gets the likeliest of the states.  Equal rows are chains' rows like others.  Very long
    texts are read line by line, one conversation of one partition at a time.  A null or empty text is one empty line.  Rows without a conversation are chains of their
    own.  An empty table gives no rows; further columns are left out.
    """
    spark = conversations.sparkSession
    narrow = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = narrow.withColumn("_h", F.xxhash64("text"))
    order = ["conv_id", "turn", "_h", "role"]
    # a checkpoint keeps the partitions and the order in them
    ordered = cut(hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_h"))
    counted = narrow.where("role is not null").groupBy("role").count().orderBy(F.desc("count"), "role")
    roles = sorted({*[r["role"] for r in counted.limit(max_roles).collect()], "assistant", "system", "user"})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, opening, last = Counts(roles), None, None
        for conv, rows in _chains(batches):
            before = None
            for k, (_, role, text) in enumerate(rows):
                last = (conv, role)
                opening = opening or last
                if _held_out(conv) or role not in counts.at:
                    before = None
                    continue
                r = counts.at[role]
                if k == 0:  # the driver takes it back where the chain goes on from the partition before
                    counts.first[r] += 1
                if before is not None:
                    counts.after[before, r] += 1
                for i, (_, _, length, asks) in enumerate(observe(text or "")):
                    counts.length[min(i, 1), r, length] += 1
                    counts.asks[min(i, 1), r, asks] += 1
                before = r
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([counts.pack()], pa.binary()), *(pa.array([str(x[0]) if x[0] is not None else None], pa.string()) for x in (opening, last)), *(pa.array([x[1]], pa.string()) for x in (opening, last))],
                                              names=["part", "counts", "first_conv", "last_conv", "first_role", "last_role"])

    total, previous = Counts(roles), None
    schema = "part int, counts binary, first_conv string, last_conv string, first_role string, last_role string"
    for r in sorted(ordered.mapInArrow(count, schema).collect(), key=lambda r: r["part"]):  # one small row per partition
        total.add(r["counts"])
        if previous is not None and r["first_conv"] is not None and previous["last_conv"] == r["first_conv"] and not _held_out(r["first_conv"]):
            a, b = total.at.get(previous["last_role"]), total.at.get(r["first_role"])
            if b is not None:
                total.first[b] -= 1
            if a is not None and b is not None:
                total.after[a, b] += 1
        previous = r
    model = total.logs()
    shared = spark.sparkContext.broadcast(model)
    n = len(roles)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition's first chain the best scores from each state before it, of its last chain those from its beginning."""
        first, first_conv, last, conv, chains = None, None, None, None, 0
        for conv, rows in _chains(batches):
            chains += 1
            table = np.where(np.eye(n) > 0, 0.0, -np.inf) if chains == 1 else None
            score = None
            for _, _, text in rows:
                lines = observe(text or "")
                if table is not None:
                    table = _row_scores(table, lines, shared.value)
                score = _row_scores(score, lines, shared.value)
            if chains == 1:
                first, first_conv = table, conv
            last = score
        if chains:
            name = lambda c: pa.array([None if c is None else str(c)], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([chains], pa.int64()), name(first_conv), name(conv), pa.array([first.tobytes()], pa.binary()), pa.array([last.tobytes()], pa.binary())],
                                              names=["part", "chains", "first_conv", "last_conv", "first", "last"])

    summed = sorted(ordered.mapInArrow(sum_up, "part int, chains bigint, first_conv string, last_conv string, first binary, last binary").collect(), key=lambda r: r["part"])
    before: dict[int, np.ndarray] = {}
    after: dict[int, np.ndarray] = {}
    score, name = None, None
    for r in summed:
        table, own = np.frombuffer(r["first"]).reshape(n, n), np.frombuffer(r["last"])
        goes_on = name is not None and r["first_conv"] == name
        if goes_on:
            before[r["part"]] = score - score.max()
        score = (before[r["part"]][:, None] + table).max(axis=0) if goes_on and r["chains"] == 1 else own
        name = r["last_conv"]
    ahead, name = np.zeros(n), None
    for k in range(len(summed) - 1, -1, -1):
        r = summed[k]
        goes_on = name is not None and r["last_conv"] == name
        after[r["part"]] = ahead - ahead.max() if goes_on else np.zeros(n)
        table = np.frombuffer(r["first"]).reshape(n, n)
        ahead = (table + (after[r["part"]] if r["chains"] == 1 else 0)).max(axis=1)
        name = r["first_conv"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        out: list[tuple] = []

        def finish(chain: tuple, first: bool, last: bool) -> None:
            conv, turns, rows = chain
            found = _decode(rows, shared.value, before.get(part) if first else None, after.get(part, np.zeros(n)) if last else np.zeros(n))
            for turn, lines, states in zip(turns, rows, found):
                named = [roles[s] for s in states]
                runs = ",".join(f"{r}*{len(list(g))}" for r, g in groupby(named))
                out.append((conv, turn, _held_out(conv), named[0], len(lines), runs, render(lines, named)))

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow)], names=labels)
            out.clear()
            return made

        first = True
        for conv, rows in _chains(batches):
            if held is not None:
                finish(held, first, False)
                first = False
                if len(out) >= 2000:
                    yield batch()
            turns, seen = [], []
            for turn, _, text in rows:
                turns.append(turn)
                seen.append(observe(text or ""))
            held = (conv, turns, seen)
        if held is not None:
            finish(held, first, True)
            yield batch()

    labels = ["conv_id", "turn", "held_out", "role_pred", "n_lines", "line_roles", "rendered"]
    given = {f.name: to_arrow_type(f.dataType) for f in narrow.schema}
    arrow = [given["conv_id"], given["turn"], pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.string()]
    return ordered.mapInArrow(decode, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, held_out boolean, role_pred string, n_lines int, line_roles string, rendered string")
