"""Caps, ties, markup that lost text, and plain versions of whole operators."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from sievemill.llm import chat, chunks, dom, features, langid, quality
from tests.conftest import DATA


def said(source):
    return re.sub(r"\s+", " ", "".join(t for _, t in dom.parse(source).texts)).strip()


@pytest.mark.parametrize("source, text", [
    ("<p title=it's>One two. Three <b>don't</b> four</p>", "One two. Three don't four"),
    ('<p title=a"b>One</p><p>Two "three"</p>', 'One Two "three"'),
    ("<p>E = <math><mi>m</mi><mo>+</mo><annotation>m+</annotation></math> end</p>", "E = m+ end"),
    ("<p>see <object data=x>fall back</object> and <map><area>a map</map>.</p>", "see fall back and a map."),
    ('<p>a <a href="x>link</a> more</p>', "a link more"),
    ('<p class = "a > b">c</p>', "c"),
    ("<svg><title>no</title><text>label</text></svg>", "label"),
])
def test_markup_loses_no_text(source, text):
    assert said(source) == text


@pytest.mark.parametrize("source", ["<b><p>" * 100_000, "<span></q>" * 100_000, "<b>" * 100_000 + "<p>" * 100_000, "<div>x</b>" * 50_000, "<li><i>" * 100_000])
def test_elements_left_open_cost_no_square(source):
    start = time.process_time()
    dom.parse(source + "end")
    assert time.process_time() - start < 20


def test_a_hundred_given_roles(spark):
    rows = [(c, t, f"r{c:02d}" if t else "opener", "why?" if t else "Once upon a time.") for c in range(100) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string".replace("conv_id string", "conv_id bigint"))
    got = chat.format_chats(df).collect()
    assert len(got) == 200 and {r["role_pred"] for r in got if r["turn"] == 0} == {"opener"}
    few = chat.format_chats(df.selectExpr("cast(conv_id as string) conv_id", "turn", "role", "text"), max_roles=2).collect()
    assert {r["role_pred"] for r in few} <= {"opener", "r00", "assistant", "system", "user"}


def test_many_roles_leave_chances(spark):
    for n in (1, 2, 51, 101, 256):
        for step in chat._inside(n):
            assert np.isfinite(step).all() or n == 1
            assert np.exp(step).sum(axis=1) == pytest.approx(np.ones(n))


def test_an_id_with_many_texts_crowds_out_no_other(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(10_000)] + [(i, f"other {i}") for i in range(2, 40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id bigint, quality int")
    x, y, crc = features.labelled_sample(docs, labels, 10, None, 0)
    assert len(x) == 20 and Counter(y.tolist()) == {0.0: 10, 1.0: 10} and len(set(crc.tolist())) == 20
    x2, y2, _ = features.labelled_sample(docs.repartition(7), labels, 10, None, 0)
    assert (x == x2).all() and (y == y2).all()


def test_equal_neighbours_are_taken_by_id():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 5)).astype(np.float32)
    vectors = quality._unit(base[np.arange(60) % 6])  # ten copies of each
    labels = (np.arange(60) < 24).astype(float)
    model = {"vectors": vectors, "labels": labels, "project": np.eye(5, dtype=np.float32), "share": 0.4}
    counts = base[rng.integers(0, 6, 300)] * rng.uniform(1, 3, (300, 1)).astype(np.float32)
    together = quality._score(counts, model, 3)
    assert (together == 1.0).all()  # the three first copies have label 1
    assert np.array_equal(together, np.concatenate([quality._score(counts[i : i + 7], model, 3) for i in range(0, 300, 7)]))


def test_languages_equal_plain_naive_bayes(documents):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]

    def grams(text):
        return Counter(langid.ngrams([text])[0].tolist()) if any(c.isalpha() for c in text or "") else Counter()

    counts, texts = {}, Counter()
    for doc, text, lang in rows:
        if zlib.crc32(str(doc).encode()) % 5 and lang is not None and (found := grams(text)):
            counts.setdefault(lang, Counter()).update(found)
            texts[lang] += 1
    size = 1 << langid.BUCKET_BITS
    got = {r["doc_id"]: r for r in langid.predict(documents, langid.train(documents)).collect()}
    for doc, text, _ in rows:
        found = grams(text)
        if not found:
            assert (got[doc]["lang_pred"], got[doc]["score"]) == (langid.UNKNOWN, 0.0)
            continue
        logs = {}
        for lang, own in counts.items():
            total = math.log(sum(own.values()) + langid.SMOOTHING * size)
            logs[lang] = math.log(texts[lang] / sum(texts.values())) + sum(n * (math.log(own[b] + langid.SMOOTHING) - total) for b, n in found.items())
        best = max(sorted(logs), key=logs.get)
        assert got[doc]["lang_pred"] == best
        assert got[doc]["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-9)


def test_nothing_unique_is_cut_from_documents(spark):
    """Against a plain version over all documents: whatever goes stands in a run of 14 words that an earlier document has."""
    docs = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    cut = {r["doc_id"]: r["text"] or "" for r in chunks.drop_repeats(docs.select("doc_id", "text")).collect()}
    words = {i: t.split() for i, t in texts.items()}
    n, seen, gone, kept, repeated = 14, set(), 0, 0, 0
    for i in sorted(texts):
        own = words[i]
        runs = [tuple(own[k : k + n]) for k in range(len(own) - n + 1)]
        covered = np.zeros(len(own), dtype=bool)
        inside = set()
        for k, run in enumerate(runs):
            if run in seen or run in inside:
                covered[k : k + n] = True
            inside.add(run)
        seen.update(inside)
        lost = Counter(own) - Counter(cut[i].split())
        allowed = Counter(w for w, c in zip(own, covered) if c)
        assert not lost - allowed, (i, lost - allowed)
        gone += sum(lost.values())
        repeated += int(covered.sum())
    assert gone > 0.6 * repeated
