"""Language, quality, rules, pages and chats: held-out accuracy, plain versions and odd rows."""

import html as html_module
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievemill.llm import boost, chat, dom, features, langid, pages, quality, rules
from tests.conftest import DATA


def test_languages_of_held_out_documents(documents):
    rows = langid.predict(documents, langid.train(documents)).collect()
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_ngrams_by_hand():
    for texts in (["Ab c", "", "12 é!!x"], ["a"], ["", ""]):
        together, lengths, letters = langid.ngrams(texts)
        at = 0
        for text, n, letter in zip(texts, lengths, letters):
            alone = langid.ngrams([text])[0]
            assert n == len(alone) and sorted(together[at : at + n].tolist()) == sorted(alone.tolist())
            assert letter == any(c.isalpha() for c in text)
            plain = " " + re.sub(r"[^a-zé]+", " ", text.lower()).strip() + " " if letter else " "
            # grams of every size that fit into the text with its ends
            assert n == sum(max(0, len(plain) - k + 1) for k in langid.SIZES) or not letter
            at += n


def test_languages_of_odd_documents(odd_documents):
    rows = langid.predict(odd_documents, langid.train(odd_documents)).collect()
    assert len(rows) == odd_documents.count()
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (1, 2, 3, 8)} == {("und", 0.0)}
    none = odd_documents.limit(0)
    assert langid.predict(none, langid.train(none)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd_documents, langid.train(none)).collect()} == {"und"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB1 é\n!", max_size=40), min_size=1, max_size=6))
def test_features_do_not_hang_on_the_batch(texts):
    texts = [t.encode() for t in texts]
    together = features.dense(texts)
    for t, row in zip(texts, together):
        assert np.allclose(features.dense([t])[0], row)


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(DATA.replace("0.001", "0.1") + "/documents.parquet"), spark.read.parquet(DATA.replace("0.001", "0.1") + "/labels.parquet")
    rows = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [i for i in good if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i]["held_out"] for i in held)
    assert sum(rows[i]["held_out"] for i in rows) == sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in rows)
    for y in (0, 1):
        mine = [i for i in held if good[i] == y]
        assert sum(rows[i]["predicted"] == y for i in mine) >= 0.95 * len(mine)
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in rows.values())


def test_votes_equal_brute_force():
    rng = np.random.default_rng(4)
    counts = rng.random((7, features.DIMS), dtype=np.float32)
    model = {"project": rng.standard_normal((features.DIMS, 5)).astype(np.float32), "vectors": quality._unit(rng.standard_normal((40, 5)).astype(np.float32)), "labels": rng.integers(0, 2, 40).astype(float), "share": 0.5}
    for x, got in zip(counts, quality._score(counts, model, 9)):
        v = x @ model["project"]
        cosine = model["vectors"] @ (v / np.linalg.norm(v))
        near = np.argsort(-cosine)[:9]
        weight = np.maximum(cosine[near], 0).astype(float) ** quality.SHARPNESS
        assert got == pytest.approx((weight * model["labels"][near]).sum() / weight.sum(), rel=1e-4)


def test_labels_outside_the_sample_do_not_matter(spark, documents, labels):
    from pyspark.sql import functions as F

    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in quality.score_documents(documents, x).collect()) for x in (labels, turned))
    assert a == b


def test_quality_of_odd_documents(odd_documents, documents, labels):
    model = quality.train(documents, labels)
    rows = quality.score(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(r["score"] == 0.25 and 0 <= r["score_"] <= 1 for r in rows)
    assert {r["score_"] for r in rows if r["doc_id"] in (1, 2)} == {model["share"]}
    assert quality.keep_good(odd_documents, model).columns == odd_documents.columns
    none = quality.train(documents.limit(0), labels.limit(0))
    assert {r["score_"] for r in quality.score(odd_documents, none).collect()} == {0.5}
    assert quality.score_documents(odd_documents.limit(0), labels.limit(0)).count() == 0


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab \n", max_size=200) | st.text("a# \né\x1c\xa0", max_size=120))
def test_base_counts(text):
    text = text.encode("utf-8", "ignore").decode()
    assert rules.base_counts(text.encode()) == plain_counts(text)


def test_rules_keep_the_good_and_drop_the_bad(documents, labels):
    rows = {r["doc_id"]: r for r in rules.judge_documents(documents, labels).collect()}
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    for i, r in rows.items():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(text[i] or "")
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["probability"] >= 0.5)
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    passing = [i for i in good if not rows[i]["base_failed"]]
    assert sum(rows[i]["kept"] == (good[i] == 1) for i in passing) >= 0.97 * len(passing)


def test_rules_on_odd_documents(odd_documents, documents, labels):
    rows = rules.apply_rules(odd_documents, rules.train(documents, labels)).collect()
    assert len(rows) == odd_documents.count() and all(r["kept"] is True and r["kept_"] in (True, False) for r in rows)
    assert {(r["n_words"], r["base_failed"], r["kept_"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(0, True, False)}
    none = rules.train(documents.limit(0), labels.limit(0))
    assert {r["probability"] for r in rules.apply_rules(odd_documents, none).collect()} == {1 / (1 + np.exp(-40))}
    assert rules.keep_passing(odd_documents, none).columns == odd_documents.columns
    assert rules.judge_documents(odd_documents.limit(0), labels.limit(0)).count() == 0


def test_calibration_follows_the_shares():
    rng = np.random.default_rng(0)
    margin = rng.standard_normal(4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * margin - 1)))).astype(float)
    slope, shift = rules._calibrate(margin, y)
    assert abs(slope - 2) < 0.25 and abs(shift + 1) < 0.25


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>My site</h1><ul class="menu"><li><a href=/a>Home</a><li><a href=/b>News</a></ul></header>
<div class="cookie-notice"><p>We use cookies to make this site work for you.</p></div>
<div class="content"><h1>A  title &amp; more</h1>
<p>First paragraph of the story, with <b>bold</b>  and
 <a href=x>a link</a>. It goes on for a while, so that it is long enough.<p>Second paragraph, unclosed, with caf&eacute; and a line<br>break in the middle of it, as it happens.
<ul><li>One thing that matters in this story</li><li>Another thing that matters just as much</li></ul>
<div class="ad">Buy the best things now! Only today.</div>
<blockquote><p>A quotation that belongs to the article, and is not short either.</p></blockquote></div>
<aside><h3>Related</h3><ul><li><a href=1>Other story one</a></li><li><a href=2>Other story two</a></li></ul></aside>
<form action=/s><label>Search here</label><input name=q><button>Go</button></form>
<section id="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>I do not agree with this article at all, sorry.</p></div></section>
<footer>&copy; 2020 My site. All rights reserved.</footer><script>var x = "<p>no</p>";</script></body></html>"""


@pytest.fixture(scope="module")
def page_model(spark):
    return pages.train(spark.read.parquet(f"{DATA}/pages.parquet"))


def test_article_of_an_unseen_layout(page_model):
    assert pages.main_texts([PAGE], page_model)[0].split("\n") == [
        "A title & more",
        "First paragraph of the story, with bold and a link. It goes on for a while, so that it is long enough.",
        "Second paragraph, unclosed, with café and a line break in the middle of it, as it happens.",
        "One thing that matters in this story", "Another thing that matters just as much",
        "A quotation that belongs to the article, and is not short either.",
    ]


def test_given_pages(spark, page_model):
    for r in pages.extract(spark.read.parquet(f"{DATA}/pages.parquet"), page_model).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html_module.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?p>|</?h1>", article)]
        assert r["text"] == "\n".join(p for p in parts if p), r["page_id"]
        assert r["n_chars"] == len(r["text"])


def test_drawn_pages_that_were_not_learned(page_model):
    right = total = 0
    for seed in range(50_000, 50_080):
        x, y = pages.drawn_rows(seed)
        right += ((boost.probability(x, page_model) > 0.5) == y).sum()
        total += len(y)
    assert right >= 0.98 * total


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_decoding_is_the_best_choice_without_contradictions(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 8))
    page = dom.Page(tag=["x"] * n, parent=[-1, *[int(rng.integers(0, e)) for e in range(1, n)]])
    chance = rng.random(n)
    kept = pages.decode(page, chance)
    score = lambda k: sum(np.log(c) if y else np.log(1 - c) for c, y in zip(chance[1:], k[1:]))
    allowed = [k for k in (tuple(bool(m >> e & 1) for e in range(n)) for m in range(1 << n)) if k[0] and all(not k[e] or k[page.parent[e]] for e in range(1, n))]
    assert tuple(kept.tolist()) in allowed
    assert score(kept) >= max(map(score, allowed)) - 1e-9


@settings(max_examples=150, deadline=None)
@given(st.text("<>/pdiv b=\"'!-a&;\n", max_size=120) | st.lists(st.sampled_from("<p> </p> <div> </div> <li> <ul> </ul> <b> </b> x <!-- --> <td> <tr> <table> </table> <br> &am <script> <".split()), max_size=30).map("".join))
def test_any_markup_is_read(page_model, source):
    page = dom.parse(source)
    assert all(0 <= p < e for e, p in enumerate(page.parent) if e)
    assert dom.describe(page).shape == (len(page.tag), len(dom.FEATURES))
    pages.main_texts([source], page_model)


def test_odd_pages(spark, page_model):
    deep = "<div>" * 5_000 + "deep" + "</div>" * 5_000
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain words only"), (3, "u", "<p>a"), (3, "u", "<p>a"), (4, "u", deep), (5, "u", "<article>" + "<p>long words here. " * 20_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = pages.extract(df, page_model).collect()
    assert len(got) == len(rows) and {(r["text"], r["n_chars"]) for r in got if r["page_id"] in (1, 2)} == {("", 0)}
    assert [r["text"] for r in got if r["page_id"] is None] == ["plain words only"]
    assert pages.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("start", ["<body><p>", "<p>", "<h1>x</h1>", "", "<img src=a>", "<div>"])
def test_head_without_end_tag(start):
    head = "<html><head>\n<meta charset=utf-8><title>T</title><script>a < b</script><style>p {}</style><link href=x>"
    open_head, closed = dom.parse(f"{head}{start}Some text."), dom.parse(f"{head}</head>{start}Some text.")
    said = [t.strip() for _, t in open_head.texts if t.strip()]
    assert said[-1] == "Some text." and "T" not in said
    assert said == [t.strip() for _, t in closed.texts if t.strip()]
    assert open_head.tag == closed.tag and open_head.parent == closed.parent


@pytest.mark.parametrize("gap", ["\n", "&#10;"])
def test_line_feed_between_inline_elements_ends_no_block(page_model, gap):
    html = PAGE.replace("First paragraph of the story", f"<b>First</b>{gap}<i>paragraph of the story</i>")
    assert html != PAGE
    assert pages.main_texts([html], page_model) == pages.main_texts([PAGE], page_model)


def test_text_of_a_page_whose_head_is_open(page_model):
    assert "</head>" in PAGE
    assert pages.main_texts([PAGE.replace("</head>", "")], page_model) == pages.main_texts([PAGE], page_model) != [""]


def test_roles_of_held_out_conversations(spark):
    table = spark.read.parquet(DATA.replace("0.001", "0.1") + "/conversations.parquet")
    rows = {(r["conv_id"], r["turn"]): r for r in chat.format_chats(table).collect()}
    given_rows = table.collect()
    assert len(rows) == len(given_rows)
    held = [r for r in given_rows if rows[r["conv_id"], r["turn"]]["held_out"]]
    assert sum(rows[r["conv_id"], r["turn"]]["role_pred"] == r["role"] for r in held) >= 0.93 * len(held)


def test_markers_decide(spark):
    rows = [(1, 0, None, "User: hi there\nhow are you?\nAssistant: fine\nthanks"), (2, 0, None, "### System\nBe kind.\n**Human:** what is 2+2?\n<|assistant|> 4")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert got[1]["line_roles"] == "user*2,assistant*2"
    assert got[1]["rendered"] == "<|user|>\nhi there\nhow are you?\n<|end|>\n<|assistant|>\nfine\nthanks\n<|end|>\n"
    assert got[2]["line_roles"] == "system*2,user*1,assistant*1"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["hello", "User: a", "what?", "Bot: " + "x " * 40, ""]), min_size=1, max_size=3), min_size=1, max_size=4), st.integers(0, 9))
def test_viterbi_is_the_best_path(texts, seed):
    counts = chat.Counts(["assistant", "user"])
    rng = np.random.default_rng(seed)
    for a in counts.arrays():
        a += rng.integers(0, 9, a.shape)
    model = counts.logs()
    rows = [chat.observe("\n".join(t)) for t in texts]
    got = [s for states in chat._decode(rows, model, None, np.zeros(2)) for s in states]
    inside = chat._inside(2)
    flat = [(model["after"] if i == 0 else inside[lines[i][1] is not None], e) for lines in rows for i, e in enumerate(chat._emissions(lines, model))]

    def score(path):
        total = model["first"][path[0]] + flat[0][1][path[0]]
        for (step, e), a, b in zip(flat[1:], path, path[1:]):
            total += step[a, b] + e[b]
        return total

    n = len(flat)
    assert score(got) == pytest.approx(max(score([m >> k & 1 for k in range(n)]) for m in range(1 << n)))


def test_long_conversation_crosses_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [(1, i, ("user", "assistant")[i % 2], "why? " * int(rng.integers(1, 4)) if i % 2 == 0 else "words " * int(rng.integers(30, 60))) for i in range(400)] + [(c, i, "user", "hm?") for c in range(2, 30) for i in range(2)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            results.append(sorted((r["conv_id"], r["turn"], r["role_pred"]) for r in chat.format_chats(df).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
    assert sum(r == ("user", "assistant")[t % 2] for c, t, r in results[0] if c == 1) >= 0.95 * 400


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (3, None, "user", ""), (3, 1, "user", "a"), (3, 1, "user", "a"), (4, 0, "narrator", "Once upon a time" * 500)]
    df = spark.createDataFrame([(*r, True, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, held_out boolean, rendered string")
    got = chat.format_chats(df).collect()
    assert len(got) == len(rows) and all(r["n_lines"] == 1 for r in got)
    assert chat.format_chats(df.limit(0)).count() == 0
