"""Main text of web pages: boosted trees over the elements of a page, decoded along the tree.

The trees say for each element how likely it is to hold main text.  An element may be kept only with all that it is part of;
of all such choices the likeliest one is taken.  What trains the trees is drawn by rule: pages of many layouts whose
parts are known, and a bounded sample of the given pages that mark their article themselves.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm import boost
from sievemill.llm.dom import KINDS, Page, describe, parse

#: drawn pages, and given pages at most, that the trees learn from
DRAWN, GIVEN = 320, 160
#: pages whose elements are scored at once
TOGETHER = 200
#: private character that marks main text in drawn pages
MARK = ""
#: elements that weak labels never count to the article
OUTSIDE = frozenset("nav footer aside form header".split())
OUTSIDE_KINDS = frozenset(i for i, k in enumerate(KINDS) if k in ("menu", "sidebar", "advert", "notice", "form", "comment", "share", "hidden"))


def draw_page(seed: int) -> str:
    """A page of a random layout; main text carries MARK."""
    r = random.Random(seed)
    letters = "aaabcdeeeefghiiklmnnoooprrsstttuvwz" if r.random() < 0.8 else "абвгдеёжзийклмнопрстуфхцчшыьэюя"

    def words(n: int, capital: bool = True) -> str:
        out = " ".join("".join(r.choices(letters, k=r.randint(1, 10))) for _ in range(n))
        return out.capitalize() if capital else out

    def prose(least: int, most: int) -> str:
        return " ".join(words(r.randint(3, 22)) + r.choice("......!?") for _ in range(r.randint(least, most)))

    def links(least: int, most: int, long: bool = False) -> str:
        items = [f'<a href="/{words(1, False)}">{words(r.randint(3, 10) if long else r.randint(1, 3))}</a>' for _ in range(r.randint(least, most))]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return r.choice([" | ", " ", "<br>"]).join(items)

    def wrap(tags: list[str], names: list[str], inner: str, named: float = 0.85) -> str:
        tag = r.choice(tags)
        name = r.choice(names)
        attribute = f' {r.choice(["class", "class", "id"])}="{name}"' if r.random() < named or tag == "div" and r.random() < 0.6 else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def menu() -> str:
        return wrap(["nav", "nav", "div", "ul"], ["menu", "main-nav", "navbar", "breadcrumb", "navigation", "top-menu"], links(3, 9))

    def header() -> str:
        return wrap(["header", "header", "div"], ["header", "masthead", "site-header", "topbar", "banner"], r.choice(["", f"<h1>{words(2)}</h1>", f'<a href="/">{words(2)}</a>']) + r.choice(["", f"<p>{words(5)}</p>"]) + r.choice(["", menu()]))

    def footer() -> str:
        text = r.choice(["&copy; ", "Copyright ", ""]) + str(r.randint(1990, 2030)) + " " + words(r.randint(2, 9)) + r.choice(["", ". ", " &middot; "]) + r.choice(["", words(6), prose(1, 2), prose(1, 5)])
        return wrap(["footer", "footer", "div"], ["footer", "site-footer", "colophon", "copyright"], r.choice([text, f"<p>{text}</p>"]) + r.choice(["", links(2, 6)]))

    def sidebar() -> str:
        return wrap(["aside", "aside", "div", "section"], ["sidebar", "widget", "related", "recommended-posts", "right-rail", "popular"], f"<h3>{words(2)}</h3>" + r.choice([links(3, 8, True), f"<p>{prose(1, 3)}</p>", links(2, 5) + f"<p>{words(12)}</p>"]))

    def advert() -> str:
        return wrap(["div", "div", "aside", "section"], ["ad", "ads", "advert", "sponsored", "promo-box", "ad-slot", "banner-ad"], r.choice([prose(1, 2), f"<p>{prose(1, 3)}</p>", f'<a href="http://ad.example">{words(6)}</a>']), 1)

    def notice() -> str:
        return wrap(["div", "section", "p"], ["cookie-notice", "consent", "alert", "notice", "gdpr-banner", "modal-overlay"], r.choice([f"<p>{prose(1, 3)}</p><button>OK</button>", prose(1, 2)]), 1)

    def form() -> str:
        return "<form action='/x'>" + r.choice(["", f"<p>{prose(1, 2)}</p>", f"<label>{words(2)}</label>"]) + "<input name=q>" + r.choice(["", f"<label>{words(3)}</label><textarea></textarea>"]) + f"<button>{words(1)}</button></form>"

    def comments() -> str:
        one = lambda: wrap(["div", "li", "article"], ["comment", "reply", "comment-body"], r.choice([f"<b>{words(2)}</b>", f"<span>{words(2)} {r.randint(1, 28)}.{r.randint(1, 12)}.</span>"]) + f"<p>{prose(1, 6)}</p>" + r.choice(["", '<a href="#">Reply</a>']), 0.9)
        return wrap(["section", "div", "ol"], ["comments", "discussion", "responses", "comment-list"], f"<h3>{words(2)}</h3>" + "".join(one() for _ in range(r.randint(1, 6))), 0.95)

    def share() -> str:
        return wrap(["div", "ul", "p"], ["share", "social-links", "share-buttons", "follow-us"], links(2, 5), 1)

    def paragraph() -> str:
        text = prose(1, 9)
        if r.random() < 0.25:
            text += f' <a href="/y">{words(2)}</a> {prose(1, 2)}'
        if r.random() < 0.2:
            text = f"<b>{words(2)}</b> {text}" if r.random() < 0.5 else f"<em>{text}</em>"
        if r.random() < 0.12:
            text += "<br>" + prose(1, 2)
        return f"<p>{text}{MARK}" + "</p>" * (r.random() < 0.85)

    def block() -> str:
        return r.choices([
            paragraph, lambda: f"<h{r.randint(2, 4)}>{words(r.randint(1, 8))}{MARK}</h2>", lambda: "<ul>" + "".join(f"<li>{words(r.randint(2, 14))}{MARK}</li>" for _ in range(r.randint(2, 6))) + "</ul>",
            lambda: f"<blockquote><p>{prose(1, 3)}{MARK}</p></blockquote>", lambda: f"<pre>{words(9)}{MARK}</pre>", lambda: f"<figure><img src=x><figcaption>{words(8)}{MARK}</figcaption></figure>",
            lambda: "<table>" + "".join("<tr>" + "".join(f"<td>{words(2)}{MARK}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>",
            lambda: f"<div>{prose(1, 5)}{MARK}</div>",
        ], [12, 3, 1.5, 1, 0.5, 0.5, 0.7, 0.8])[0]()

    def article() -> str:
        title = f"<h1>{words(r.randint(2, 9))}{MARK}</h1>"
        title = r.choice([title, title, title, f"<header>{title}</header>", ""])
        body = [block() for _ in range(r.randint(1, 14))] if r.random() < 0.8 else [f"<p>{words(r.randint(1, 12))}{r.choice(['.', ''])}{MARK}</p>"]
        for extra in (advert, share, sidebar, notice, form):
            if r.random() < 0.12:
                body.insert(r.randint(0, len(body)), extra())
        inner = title + "".join(body)
        if r.random() < 0.2:
            inner = f"<div>{inner}</div>"
        kind = r.random()
        if kind < 0.45:
            return f"<article{r.choice(['', ' class=post'])}>{inner}</article>"
        if kind < 0.6:
            return f"<main>{inner}</main>"
        if kind < 0.9:
            return wrap(["div", "section", "td", "div"], ["content", "main", "post-content", "entry", "article-body", "story", "page", "text"], inner, 0.8)
        return inner

    above = [f() for f in (menu, header, notice, advert, form, share) if r.random() < 0.4]
    below = [f() for f in (comments, sidebar, share, advert, form, notice, menu) if r.random() < 0.3]
    r.shuffle(above)
    r.shuffle(below)
    beside = [sidebar()] if r.random() < 0.3 else []
    middle = article()
    row = "".join(beside + [middle] if r.random() < 0.4 else [middle] + beside)
    if r.random() < 0.3:
        row = wrap(["div", "section"], ["container", "wrapper", "layout", "row", "site"], row)
    return f"<html><head><title>{words(4)}</title><script>x()</script></head><body>{''.join(above)}{row}{''.join(below)}{footer() if r.random() < 0.8 else ''}</body></html>"


def _up(page: Page, marked: np.ndarray) -> np.ndarray:
    """Elements that hold a marked element."""
    for e in range(len(page.tag) - 1, 0, -1):
        marked[page.parent[e]] |= marked[e]
    return marked


def _with_text(page: Page, choose=lambda text: bool(text.strip())) -> np.ndarray:
    found = np.zeros(len(page.tag), dtype=bool)
    for e, text in page.texts:
        found[e] |= choose(text)
    return _up(page, found)


def drawn_rows(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the elements with text of a drawn page."""
    page = parse(draw_page(seed))
    label = _with_text(page, lambda text: MARK in text)
    page.texts = [(e, text.replace(MARK, "")) for e, text in page.texts]
    rows = np.flatnonzero(_with_text(page))
    return describe(page)[rows], label[rows]


def weak_rows(source: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a given page that marks its article by an element of that name; none otherwise."""
    page = parse(source)
    if not {"article", "main"} & set(page.tag):
        return np.zeros((0, 0), np.float32), np.zeros(0, bool)
    inside = np.zeros(len(page.tag), dtype=bool)
    for e in range(1, len(page.tag)):
        inside[e] = inside[page.parent[e]] or page.tag[e] in ("article", "main")
        if page.tag[e] in OUTSIDE or page.kinds[e] & OUTSIDE_KINDS:
            inside[e] = False
    own = np.zeros(len(page.tag), dtype=bool)
    for e, text in page.texts:
        own[e] |= bool(text.strip())
    rows = np.flatnonzero(_up(page, own.copy()))
    return describe(page)[rows], _up(page, own & inside)[rows]


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", drawn: int = DRAWN, given: int = GIVEN) -> dict:
    """The trees, from ``drawn`` drawn pages and ``given`` of the given ones, chosen by a hash of id and html, where they mark an article."""
    sample = pages.where(F.col(html_col).isNotNull()).select(F.col(html_col).cast("string").alias("html"), F.xxhash64(F.col(id_col).cast("string"), F.col(html_col)).alias("h"))
    kept = sample.orderBy("h").limit(given)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [weak_rows(v.as_py()) for v in batch.column("html")]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes() for x, _ in found], pa.binary()), pa.array([y.tobytes() for _, y in found], pa.binary()), batch.column("h")], names=["x", "y", "h"])

    parts = [drawn_rows(seed) for seed in range(drawn)]
    columns = parts[0][0].shape[1]
    for r in kept.mapInArrow(compute, "x binary, y binary, h bigint").orderBy("h").collect():
        if r["x"]:
            parts.append((np.frombuffer(r["x"], np.float32).reshape(-1, columns), np.frombuffer(r["y"], bool)))
    x, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(float)
    weight = np.concatenate([np.full(len(p[1]), 1 / np.sqrt(max(len(p[1]), 1))) for p in parts])  # long pages don't outvote the others
    return boost.fit(x, y, weight / weight.mean())


def decode(page: Page, chance: np.ndarray) -> np.ndarray:
    """The likeliest choice of elements in which whatever is kept stands in kept elements only; the page itself is kept."""
    chance = np.clip(chance, 1e-6, 1 - 1e-6)
    keep, drop = np.log(chance), np.log(1 - chance)
    best = keep.copy()  # of the subtree, if its top is kept
    for e in range(len(page.tag) - 1, 0, -1):
        p = page.parent[e]
        best[p] += max(best[e], drop[e])
        drop[p] += drop[e]
    kept = np.ones(len(page.tag), dtype=bool)
    for e in range(1, len(page.tag)):
        kept[e] = kept[page.parent[e]] and best[e] >= drop[e]
    return kept


def main_texts(sources: list[str], model: dict) -> list[str]:
    """For each page its blocks of main text in page order, joined by line feeds, with single spaces inside."""
    pages = [parse(source) for source in sources]
    if not pages:
        return []
    chances = boost.probability(np.concatenate([describe(page) for page in pages]), model)
    out, at = [], 0
    for page in pages:
        kept = decode(page, chances[at : at + len(page.tag)])
        at += len(page.tag)
        blocks, parts = [], []
        for e, text in [*page.texts, (0, "\n")]:
            if text != "\n":
                if kept[e]:
                    parts.append(text)
                continue
            block = " ".join("".join(parts).split())
            if block:
                blocks.append(block)
            parts = []
        out.append("\n".join(blocks))
    return out


def extract(pages: DataFrame, model: dict | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty html, and a page without text, give an empty text.  Cut-off or wrongly nested markup is read as
    far as it goes.  Repeated rows and null ids give a row each; an empty table gives none; further columns are left out.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(pages, id_col, html_col))
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = [v.as_py() or "" for v in batch.column("html")]
            texts = [t for at in range(0, len(sources), TOGETHER) for t in main_texts(sources[at : at + TOGETHER], shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return narrow.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
