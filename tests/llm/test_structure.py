"""Fill-in-the-middle, sharding and conversation repair against plain versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievemill.llm import infill, repair, sharding


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fill in the middle


def plain_infill(doc_id, text):
    text = text or ""
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(text) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, len(text), "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, len(text), "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(text), "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


TRICKY = ["<", "<P", "P>", "<<", "S><", "<S>", "x<M>y", "<M", ">", "a<b>c", "\n", " "]


@pytest.fixture
def texts(spark, odd_documents):
    rows = [(100 + i, t * k) for i, t in enumerate(TRICKY) for k in (1, 2, 9)] + [(7, "same")] * 40 + [(i, "z" * i) for i in range(200, 260)]
    more = spark.createDataFrame(rows, "doc_id bigint, text string")
    return more.unionByName(odd_documents.select("doc_id", "text"))


@pytest.mark.parametrize("chunk", [1, 5, 1 << 14])
def test_infill_equals_plain(spark, texts, chunk):
    if chunk == 1:
        texts = texts.where("coalesce(length(text), 0) < 1000")
    plain = [plain_infill(*r) for r in texts.collect()]
    assert {x[2] for x in plain} == {"plain", "psm", "spm"}
    assert rows_of(infill.transform(texts, chunk=chunk)) == Counter(plain)
    want = Counter((*x[:5], sha(x[5]), sha(y or "")) for x, (_, y) in zip(plain, texts.collect()))
    assert rows_of(infill.digests(texts, chunk=chunk)) == want


def test_infill_of_clashing_columns_and_of_nothing(odd_documents):
    assert rows_of(infill.digests(odd_documents)) == rows_of(infill.digests(odd_documents.select("doc_id", "text")))
    assert infill.digests(odd_documents.limit(0)).collect() == [] and infill.transform(odd_documents.limit(0)).collect() == []


def test_infill_comes_back(documents):
    out = infill.transform(documents)
    back = infill.restore(out).select("doc_id", "restored")
    assert rows_of(back) == rows_of(documents.selectExpr("doc_id", "coalesce(text, '')"))


@settings(max_examples=300, deadline=None)
@given(st.text("<PSM>a", max_size=30), st.integers(0, 30), st.integers(0, 30), st.sampled_from(["psm", "spm", "plain"]), st.integers(1, 9), st.integers(1, 9))
def test_sections_are_found_in_any_pieces(text, a, b, form, chunk, piece):
    if re.search("<[PSM]>", text):
        form = "plain"
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    output = "".join(p for _, p in infill.pieces_of(text, form, a, b, chunk))
    places = [at for at, _ in infill.pieces_of(text, form, a, b, chunk)]
    assert places == sorted(set(places))
    parts = infill.sections(form, iter([output[i : i + piece] for i in range(0, len(output), piece)]))
    assert "".join(p for _, _, p in sorted(parts)) == text


# sharding


def plain_shards(rows, shards, nodes, slack=0.0):
    """(row, shard, slot) of rows (key, ...), walking one row at a time."""
    place = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    bits = max(16, (8 * shards * nodes - 1).bit_length())
    points = sorted((place(f"shard#{s}#{n}"), s) for s in range(shards) for n in range(nodes))
    owner = {}
    for at, s in points:
        owner.setdefault(at >> (32 - bits), s)
    owner[1 << bits] = owner[min(owner)]  # beyond the last node
    arcs = sorted(owner)
    key = lambda r: ("" if r[0] is None else str(r[0]))
    caught = {a: [] for a in arcs}
    for r in sorted(rows, key=lambda r: (place(key(r)), r[0] is not None, r)):
        cell = place(key(r)) >> (32 - bits)
        caught[next(a for a in arcs if a >= cell)].append(r)
    n = len(rows)
    bound = [n // shards + (s < n % shards) if slack == 0 else -(-n * (1 + slack) // shards) for s in range(shards)]
    held = [[] for _ in range(shards)]
    late = {}
    for a in arcs:
        s = owner[a]
        for r in caught[a]:
            if len(held[s]) < bound[s]:
                held[s].append(r)
            else:
                late.setdefault(a, []).append(r)
    queue = deque()
    for turn in (0, 1):
        for a in arcs:
            queue.extend(late.get(a, []) if turn == 0 else [])
            s = owner[a]
            while queue and len(held[s]) < bound[s]:
                held[s].append(queue.popleft())
    return Counter((*r, s, i) for s in range(shards) for i, r in enumerate(held[s]))


def assert_balanced(found, shards):
    counts = Counter(r["shard"] for r in found)
    assert max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(counts[s]))


def test_documents_are_dealt_as_row_by_row(documents):
    found = sharding.shard_documents(documents).collect()
    assert_balanced(found, 40)
    rows = [(r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 16) for r in documents.collect()]
    assert Counter((r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in found) == plain_shards(rows, 40, sharding.NODES)
    assert {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)}


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_a_key_of_a_third_of_the_rows_is_dealt_over_shards(spark, slack):
    rows = [(5, i % 3) for i in range(300)] + [(i, 0) for i in range(600)] + [(None, 1)] * 3
    df = spark.createDataFrame(rows, "id bigint, x bigint").repartition(5)
    found = sharding.assign(df, "id", 7, 16, slack, ("x",)).collect()
    assert Counter(map(tuple, found)) == plain_shards(rows, 7, 16, slack)
    if slack == 0:
        assert_balanced(found, 7)
    assert max(Counter(r["shard"] for r in found).values()) <= -(-903 * (1 + slack) // 7)


def test_few_rows_move_when_a_shard_is_added(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc")
    old, new = ({r["doc"]: r["shard"] for r in sharding.assign(df, "doc", n).collect()} for n in (40, 41))
    moved = sum(old[k] != new[k] for k in old) / len(old)
    assert 1 / 41 <= moved < 0.2  # a plain modulo moves 0.98 of them


def test_sharding_of_odd_rows(odd_documents):
    found = sharding.shard_documents(odd_documents).collect()
    assert_balanced(found, 40)
    assert len(found) == 11 and sharding.shard_documents(odd_documents.limit(0)).collect() == []
    kept = sharding.assign(odd_documents.withColumnsRenamed({"_key": "shard", "kept": "slot", "_owner": "_part"}), "doc_id", 3)
    assert kept.columns[-2:] == ["shard_", "slot_"] and kept.count() == 11


# conversation repair


def plain_repair(rows):
    """Cheapest (cost, audit, lines) of (role, text, fault) rows: uniform-cost search in the order of (cost, audit), nothing cut."""
    heap = [(0, "", 0, "", [])]
    while heap:
        cost, audit, i, grammar, lines = heapq.heappop(heap)
        if i == len(rows) and (grammar == "" or grammar[-1] == "a"):
            return cost, audit, lines
        fits = lambda c: re.fullmatch("s?(ua)*u?", grammar + c) is not None
        if cost < 4 * len(rows) + 1:
            for c, name in (("u", "user"), ("a", "assistant")):
                if fits(c):
                    heapq.heappush(heap, (cost + 3, audit + "I", i, grammar + c, [*lines, f"{name}:"]))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, grammar, lines))
            if fault in ("blank", "duplicate"):
                continue
            mend = 3 * (fault == "truncated")
            if role[:1] in ("s", "u", "a") and fits(role[0]):
                heapq.heappush(heap, (cost + mend, audit + "K", i + 1, grammar + role[0], [*lines, f"{role}:{text}"]))
            for c, name in (("u", "user"), ("a", "assistant")):
                if fits(c):
                    heapq.heappush(heap, (cost + 3 + mend, audit + "R", i + 1, grammar + c, [*lines, f"{name}:{text}"]))


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else x
        harm = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = "user" if harm == 4 else said(role), "" if harm == 1 else said(text)
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        out.extend([(conv, turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1))
    return out


def plain_report(rows, damaged):
    out = Counter()
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, faults, count = set(), [], Counter()
        for _, _, role, text in own:
            words = text.strip(" \t\n\v\f\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated"
            seen.add((role, text))
            count[fault] += 1
            faults.append((role, text, fault))
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = plain_repair(faults)
        out[conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(lines))] += 1
    return out


CHAT = "conv_id bigint, turn bigint, role string, text string"


def chats(seed, convs, longest):
    gen = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(gen.randint(1, longest)):
            role = gen.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = gen.choice(["Yes.", "No?", "so\n", " \t", "", None, f"word {t}!", f"cut {t}", "é…", "Wait. . "])
            rows.append((c if c % 9 else None, gen.choice([t, t, t, t + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("rows_per_part", [50_000, 1])
def test_repair_equals_plain(spark, monkeypatch, rows_per_part):
    monkeypatch.setattr(repair, "PART_ROWS", rows_per_part)
    rows = chats(3, 25, 6)
    rows += rows[:4]
    df = spark.createDataFrame([(*r, "clash", 0, 1) for r in rows], CHAT + ", audit string, n int, part int")
    assert rows_of(repair.report(repair.damage(df))) == plain_report(rows, plain_damage(rows))


def test_a_conversation_over_many_partitions_is_as_one(spark, monkeypatch):
    gen = random.Random(5)
    rows = [(1, t, gen.choice(["user", "assistant", "system", "tool"]), gen.choice(["Yes.", f"a {t}.", f"b {t}", ""])) for t in range(120)]
    rows += [(2, 0, "user", "Hi."), (0, 0, "user", "Ho.")] + [(3, 7, "user", "Same.")] * 200
    whole = rows_of(repair.report(repair.damage(spark.createDataFrame(rows, CHAT))))
    monkeypatch.setattr(repair, "PART_ROWS", 5)
    df = repair.damage(spark.createDataFrame(rows, CHAT))
    split = repair.report(df)
    assert rows_of(split) == whole
    turns = sorted(repair.repaired_turns(df).collect(), key=lambda r: (r["conv_id"], r["part"], r["place"]))
    assert len({r["part"] for r in turns}) > 5
    for r in split.collect():
        lines = [f"{t['role']}:{t['text']}" for t in turns if t["conv_id"] == r["conv_id"]]
        assert sha("\n".join(lines)) == r["repaired_sha256"]
        initials = "".join(t["role"][0] for t in turns if t["conv_id"] == r["conv_id"])
        assert re.fullmatch("(s?(ua)+)?", initials)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "x", ""]), st.just("t"), st.sampled_from(["", "truncated", "blank"])), max_size=6), st.integers(0, 6))
def test_search_and_its_parts(rows, cut):
    def run(part):
        r = repair.Run(0)
        for role, text, fault in part:
            r.add(0, role, text, 1, False, fault == "blank", fault == "truncated")
        return r

    cost, audit, lines = plain_repair(rows)
    got = repair.search(run(rows).items)
    assert (got[0], "".join(got[1])) == (cost, audit)
    assert [f"{r}:{t}" for _, r, t in run(rows).lines(got[1], repair.EMPTY)] == lines
    parts = [run(rows[:cut]), run(rows[cut:])]
    chosen = repair._chosen([p.table() for p in parts])
    both = [repair.search(p.items, *places) for p, places in zip(parts, chosen)]
    assert (sum(b[0] for b in both), "".join(x for b in both for x in b[1])) == (cost, audit)


def test_a_long_conversation_is_searched_in_one_pass():
    gen = random.Random(1)
    items = [(gen.choice("sua?"), gen.randint(0, 1)) for _ in range(50_000)]
    cost, edits = repair.search(items)
    assert len(edits) >= 50_000 and cost == repair.bounds(items)[0][repair.EMPTY]


def test_repair_of_given_conversations_and_of_nothing(spark):
    from tests.conftest import DATA

    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(repair.report(repair.damage(df))) == plain_report(rows, plain_damage(rows))
    assert repair.report(repair.damage(df.limit(0))).collect() == []
