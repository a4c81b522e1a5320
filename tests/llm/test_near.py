"""SimHash, embedding and substring de-duplication against brute force."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sievemill.llm import chunks, embeddings, simhash
from sievemill.llm.common import components
from tests.conftest import DATA


def smallest_reached(n, pairs, names):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        r = find(i)
        least[r] = min(least.get(r, names[i]), names[i])
    return [least[find(i)] for i in range(n)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text("ab \t\n\x0b\x1c\x85\xa0Zé", max_size=60))
def test_fingerprint(text):
    text = text.encode("utf-8", "ignore").decode()
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_golay_code_is_perfect():
    patterns = simhash.golay_patterns()
    assert sorted((patterns >= 0).sum(axis=1).tolist()) == [1] * 277 + [6] * 1771
    words = np.arange(1 << 23, dtype=np.int64)[::997]
    found = patterns[simhash._syndromes(words)]
    assert (simhash._syndromes(words ^ found[:, 0]) == 0).all()


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 63), st.integers(0, 63))
def test_two_bits_share_a_key(fp, i, j):
    patterns = KEPT_PATTERNS
    other = fp ^ (1 << i) ^ (1 << j if i != j else 0)
    rows, keys = simhash.golay_keys(np.array([fp, other], dtype=np.uint64).view(np.int64), patterns)
    assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


KEPT_PATTERNS = simhash.golay_patterns()


def check_components(spark, fps, docs_ids):
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint").distinct()
    edges = simhash.linked_fingerprints(df)
    got = {r["id"]: r["root"] for r in components(edges).collect()}
    values = sorted({int(np.uint64(f).view(np.int64)) for f in fps})
    pairs = [(a, b) for a in range(len(values)) for b in range(a) if ((values[a] ^ values[b]) & (2**64 - 1)).bit_count() <= 2]
    want = smallest_reached(len(values), pairs, values)
    for v, w in zip(values, want):
        assert got.get(v, v) == w


@pytest.mark.parametrize("joined", [64, 2])
def test_links_below_and_beyond_the_joined_size(spark, monkeypatch, joined):
    monkeypatch.setattr(simhash, "JOINED", joined)
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**64, 40, dtype=np.uint64)
    near = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for s in np.repeat(seeds, 6)]
    hub = [seeds[0] ^ np.uint64(1 << b) for b in range(64)]
    check_components(spark, [*seeds, *near, *hub], None)


def test_documents_by_simhash(documents):
    rows = simhash.near_duplicates(documents).collect()
    given_rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    ids = sorted(given_rows)
    fps = [plain_fingerprint(given_rows[i]) for i in ids]
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = dict(zip(ids, smallest_reached(len(ids), pairs, ids)))
    assert len(rows) == len(ids)
    for r in rows:
        assert r["fingerprint"] == f"{fps[ids.index(r['doc_id'])]:016x}"
        assert r["component_id"] == want[r["doc_id"]]
    kept = simhash.one_per_group(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(want.values()))


def test_odd_documents_by_simhash(odd_documents):
    rows = simhash.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    blank = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in blank} >= {1, 2, 3} and {r["component_id"] for r in blank} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    assert [r["component_id"] for r in rows if r["doc_id"] is None and r["fingerprint"] != "0" * 16] == [None]
    kept = simhash.one_per_group(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len({(r["component_id"], r["component_id"] is None) for r in rows}) and ids.count(4) == 1
    assert simhash.near_duplicates(odd_documents.limit(0)).count() == 0
    assert simhash.one_per_group(odd_documents.limit(0)).count() == 0


def test_components_of_paths_hubs_and_loops(spark):
    path = [(i, i + 1) for i in range(1, 60)]
    hub = [(1000, 2000 + i) for i in range(300)]
    edges = spark.createDataFrame([*path, *hub, (7, 7), (5000, 5000), (-5, -3), (-3, 9000)], "a bigint, b bigint")
    got = {r["id"]: r["root"] for r in components(edges).collect()}
    want = {**{i: 1 for i in range(1, 61)}, **{i: 1000 for i in [1000, *range(2000, 2300)]}, -5: -5, -3: -5, 9000: -5}
    assert got == want
    assert components(edges.limit(0)).count() == 0


def plain_links(rows):
    """rows: (id, vector or None) -> (n_links, component) per row."""
    good = [i for i, (name, v) in enumerate(rows) if name is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in good}
    pairs = [(a, b) for a in good for b in good if b < a and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    links = [0] * len(rows)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    names = [float("inf") if name is None else name for name, _ in rows]
    return links, smallest_reached(len(rows), pairs, names)


def check_vectors(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(n, v, n, "x") for n, v in rows], f"vec_id bigint, embedding array<{kind}>, rep bigint, root string")
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df, **options).collect() if r["vec_id"] is not None}
    links, roots = plain_links([(n, v if v is None or kind == "double" else [x if x is None else float(np.float32(x)) for x in v]) for n, v in rows])
    found = total = 0
    for (name, _), n, root in zip(rows, links, roots):
        if name is None:
            continue
        found += got[name]["n_links"]
        total += n
        assert got[name]["n_links"] <= n and got[name]["kept"] == (got[name]["component_id"] == name)
        assert got[name]["component_id"] >= root
    assert found >= 0.99 * total
    return got


def test_vectors_in_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(120)]
    center = rng.standard_normal(16)
    rows += [(200 + i, (center + 0.1 * rng.standard_normal(16)).tolist()) for i in range(150)]
    rows += [(400 + i, rows[5][1]) for i in range(70)] + [(500, [2 * x for x in rows[6][1]])]
    check_vectors(spark, rows, "double")


def test_members_beyond_one_product(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MEMBERS", 20)
    rng = np.random.default_rng(2)
    center = rng.standard_normal(8)
    rows = [(i, (center + 0.08 * rng.standard_normal(8)).tolist()) for i in range(90)] + [(100 + i, rng.standard_normal(8).tolist()) for i in range(30)]
    check_vectors(spark, rows, "double")


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [1.0, 1.0, 0.0]), (10, [1e-30, 1e-30]), (11, [-1.0, -1.0]), (None, [1.0, 1.0])]
    got = check_vectors(spark, rows, "double")
    assert {i: got[i]["n_links"] for i in range(1, 12)} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 2, 8: 2, 9: 0, 10: 2, 11: 0}
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embeddings.near_vectors(empty).count() == 0


def test_passes_grow_with_rows():
    assert [embeddings.passes_for(n, 0.95, 64, 12) for n in (1, 64, 10**4)] == [12, 12, 12]
    for n in (10**6, 10**7, 10**8):
        met = 0.899 ** np.log2(n / 64)
        assert 1 - (1 - met) ** embeddings.passes_for(n, 0.95, 64, 12) >= 0.998


def test_pairs_in_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(8)
    way = rng.standard_normal(64)
    way *= 2.4 * 8 / np.linalg.norm(way)
    one, noise = rng.standard_normal((2, 700, 64))
    rows = [*rng.standard_normal((500, 64)), *(way + one), *(way + 0.8 * one + 0.6 * noise)]
    check_vectors(spark, [(i, v.tolist()) for i, v in enumerate(rows)], "double", window=8)


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))


def test_rolling_hash_looks_back_sixteen_bytes():
    data = np.random.default_rng(0).integers(0, 256, 300, dtype=np.uint8)
    want = [sum(int(chunks.GEAR[data[i - k]]) << k for k in range(min(16, i + 1))) % 2**32 for i in range(300)]
    assert chunks.rolling(data).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.text("ab c\n\té", max_size=300))
def test_chunks_cover_all_words(text):
    cuts, digests = chunks.chunk(text.encode())
    assert cuts[-1] == len(text.encode().split()) and len(digests) == len(cuts) - 1
    assert (np.diff(cuts) > 0).all()


def test_passages_go_from_all_but_the_first(spark):
    shared = [passage(i, 60) for i in range(12)]
    rows = [(100 * k + i, f"{passage(1000 + 100 * k + i, 30)}\n{shared[i]}\n{passage(5000 + 100 * k + i, 20 + k)}") for k in range(4) for i in range(12)]
    clean = [(900 + i, passage(9000 + i, 200)) for i in range(20)]
    line = passage(77, 13)
    framed = [(950 + i, f"{passage(9500 + i, 40)}\n{line}\n{passage(9700 + i, 40)}") for i in range(20)]
    df = spark.createDataFrame([*rows, *clean, *framed], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in chunks.drop_repeats(df).collect()}
    for i, text in [*clean, *framed, *rows[:12]]:
        assert got[i]["text"] == text and got[i]["n_removed"] == 0, i
    for i, text in rows[12:]:
        assert got[i]["n_removed"] >= 14 and shared[i % 100] not in got[i]["text"]
        assert got[i]["text"].split()[:25] == text.split()[:25]
        assert len(got[i]["text"].split()) == got[i]["n_words"] - got[i]["n_removed"]


@pytest.mark.parametrize("n", [150, 600])
def test_clean_documents_of_common_words_lose_nothing(spark, n):
    rng = np.random.default_rng(4)
    vocabulary = passage(3, 300).split()
    share = 1 / np.arange(1, 301)
    rows = [(i, " ".join(vocabulary[w] for w in rng.choice(300, 300, p=share / share.sum()))) for i in range(n)]
    got = chunks.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"]: r["removed"] for r in got.where("n_removed > 0").collect()} == {}


def test_what_goes_stands_in_an_earlier_text_or_before():
    rng = np.random.default_rng(5)
    for _ in range(200):
        words = passage(6, 40).split()
        text = " ".join(words[w] for w in np.concatenate([rng.integers(0, 40, rng.integers(0, 30)), *[np.arange(25)] * 3, rng.integers(0, 40, 20)]))
        cuts, digests = chunks.chunk(text.encode(), 8)
        first, last, found = chunks.passages(cuts, digests)
        for a, b in zip(first, last):
            assert cuts[b] - cuts[a] >= 14 and (cuts[b] - cuts[a + 1] < 14 or cuts[b - 1] - cuts[a] < 14)
        known = {}
        for a in range(len(digests)):
            for b in range(a + 1, len(digests) + 1):
                if cuts[b] - cuts[a] >= 14:
                    known.setdefault(tuple(digests[a:b]), []).append((a, b))
        want = np.zeros(len(digests), dtype=bool)
        for spans in known.values():
            for a, b in spans[1:]:
                if a >= spans[0][1]:
                    want[a:b] = True
        again = chunks._earlier(first, last, found)
        got = chunks._covered(len(digests), first[again], last[again])
        assert (got == want).all()


def test_insertions_do_not_move_later_chunks():
    text = passage(1, 400)
    a, b = chunks.chunk(text.encode())[1], chunks.chunk(("some new words " + text).encode())[1]
    assert len(set(a.tolist()) - set(b.tolist())) <= 2


def test_odd_documents_by_chunks(odd_documents):
    rows = chunks.drop_repeats(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by = {(r["doc_id"], r["n_words"]): r for r in rows}
    assert by[1, 0]["text"] is None and by[2, 0]["text"] == "" and by[3, 0]["text"] == " \t\n "
    assert by[5, 60_000]["n_removed"] < 60_000 and by[6, 60_000]["n_removed"] == 60_000 and by[6, 60_000]["text"] == ""
    assert all(r["score"] == 0.25 and r["_key"] == -1 and r["offset"] == "x" for r in rows)
    assert chunks.drop_repeats(odd_documents.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_given_vectors_by_passes_alone(spark, monkeypatch, sf):
    """The given vectors and a copy of each, from equal to just below the limit."""
    def never(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(embeddings, "_all_pairs", never)
    given = spark.read.parquet(DATA.replace("0.001", sf) + "/embeddings.parquet").select("vec_id", "embedding").collect()
    rng = np.random.default_rng(7)
    rows = [(r["vec_id"], np.array(r["embedding"], np.float32)) for r in given]
    rows += [(10**6 + i, (v + rng.normal(size=len(v)) * np.linalg.norm(v) / np.sqrt(len(v)) * 0.35 * rng.random()).astype(np.float32)) for i, v in rows]
    unit = np.stack([v.astype(float) / np.sqrt((v.astype(float) ** 2).sum()) for _, v in rows])
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    names = [i for i, _ in rows]
    root = smallest_reached(len(rows), list(zip(*map(list, np.nonzero(near)))), names)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect()}
    assert got == {i: (int(n), c) for i, n, c in zip(names, near.sum(axis=1), root)}
    assert len(given) < near.sum() < 2 * len(given)
