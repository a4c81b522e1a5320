"""A tolerant tree of a page: elements in page order, with their texts, and numbers that describe each of them."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: elements without content
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is no text of the page
HIDDEN = frozenset("script style noscript template iframe canvas head title desc metadata textarea select button datalist annotation annotation-xml audio video".split())
#: elements whose content is not parsed
RAW = frozenset("script style textarea title xmp iframe noscript".split())
#: elements that can stand in a head; anything else ends it, as does text
IN_HEAD = frozenset("head html base basefont bgsound link meta title noscript noframes script style template".split())
#: elements that run inside a line of text
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark object q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr "
    "g tspan math maction menclose merror mfrac mfenced mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
#: start tags that end an open element, up to the nearest element of the last set
CLOSES = {
    **dict.fromkeys("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ({"p"}, set())),
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"table", "tr"}),
    "th": ({"td", "th", "p"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: elements that an inner start tag of CLOSES never reaches across
BARRIERS = frozenset("body html table td th li ul ol dl div section article main aside nav header footer form blockquote figure".split())
#: the different rules of CLOSES
RULES = [rule for k, rule in enumerate(CLOSES.values()) if rule not in list(CLOSES.values())[:k]]
RULE = {tag: RULES.index(rule) for tag, rule in CLOSES.items()}


@lru_cache(4096)
def _stopped(tag: str) -> tuple[int, ...]:
    """The rules that reach no further than an open element of this tag."""
    if tag in INLINE:
        return ()
    return tuple(k for k, (ended, barrier) in enumerate(RULES) if tag not in ended and (not barrier or tag in barrier or tag in BARRIERS))


#: quotes count only where a value begins; one that is never closed is a character like others
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
DIGITS, CAPITALS = re.compile("[0-9]"), re.compile("[A-Z]")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: words in class, id and role that speak for a kind of block
KINDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs toc pager pagination topbar tabs skip sitemap",
    "header": "header masthead banner top logo branding hero site",
    "footer": "footer foot bottom copyright legal colophon contentinfo",
    "sidebar": "sidebar side aside rail widget widgets related recommended recommendations popular trending more complementary teaser teasers links archive tags categories tagcloud",
    "advert": "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion promoted dfp commercial banner outbrain taboola affiliate",
    "notice": "cookie cookies consent gdpr notice alert alerts popup modal overlay banner dialog toast warning announcement paywall disclaimer privacy message",
    "form": "form search login signin signup register subscribe subscription newsletter contact feedback input poll survey captcha",
    "comment": "comment comments commentlist reply replies respond disqus discussion thread reactions responses guestbook review reviews",
    "share": "share sharing social follow like likes tweet facebook twitter print email tools toolbar meta byline author rating votes",
    "hidden": "hidden hide invisible offscreen sr screenreader print noprint display none",
    "main": "article content main post entry story body text page articlebody bodytext prose copy maincontent paragraph paragraphs lead chapter document",
}
TOKEN_KIND: dict[str, list[int]] = {}
for _number, (_kind, _words) in enumerate(KINDS.items()):
    for _word in _words.split():
        TOKEN_KIND.setdefault(_word, []).append(_number)
#: tags that have a feature of their own; all others share one
TAGS = "article main section div p h1 h2 h3 ul ol li dl table tr td blockquote pre figure nav header footer aside form fieldset details body a span".split()


@dataclass
class Page:
    """Elements in page order.  Element 0 is the page; ``parent`` comes before its children."""

    tag: list[str] = field(default_factory=lambda: ["#page"])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    kinds: list[set[int]] = field(default_factory=lambda: [set()])
    texts: list[tuple[int, str]] = field(default_factory=list)  # (element, text) in page order; "\n" alone ends a block
    linked: list[bool] = field(default_factory=list)  # for each text: inside a link


def _attributes(source: str) -> tuple[set[int], bool]:
    """Kinds that class, id and role speak for, and whether the element is declared hidden."""
    kinds, hidden = set(), False
    for name, value in ATTRIBUTE.findall(source):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop"):
            for word in SPLIT.split(CAMEL.sub(" ", value).lower()):
                kinds.update(TOKEN_KIND.get(word, ()))
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
    return kinds, hidden


def parse(source: str) -> Page:
    """The page's tree.  Markup may be cut off, unclosed or wrongly nested; nothing is an error.

    An inline element without telling attributes is no element of its own: its text belongs to the block around it.

    What an end tag or a start tag closes is looked up among the places of open elements by tag, so that the work grows with
    the page and not with the number of elements left open.
    """
    page = Page()
    open_tags: list[tuple[str, int, bool]] = [("#page", 0, False)]  # tag, element, hidden
    places: dict[str, list[int]] = {}  # of open elements by tag
    blocks: list[int] = []  # places of open elements that are not inline
    stops: list[list[int]] = [[0] for _ in RULES]  # for each rule, places that it doesn't reach across
    at, links = 0, 0

    def say(text: str) -> None:
        if text and not open_tags[-1][2]:
            said = html.unescape(text)
            page.texts.append((open_tags[-1][1], " " if said == "\n" else said))  # a line feed alone is a block's end
            page.linked.append(links > 0)

    def end_block() -> None:
        if page.texts and page.texts[-1][1] != "\n":
            page.texts.append((0, "\n"))
            page.linked.append(False)

    def close() -> None:
        nonlocal links
        tag, _, _ = open_tags.pop()
        links -= tag == "a"
        places[tag].pop()
        for rule in _stopped(tag):
            stops[rule].pop()
        if tag not in INLINE:
            blocks.pop()
            end_block()

    def end_head() -> None:
        if open_tags[-1][0] == "head":  # its end tag may be left out
            close()

    while at < len(source):
        token = TOKEN.search(source, at)
        text = source[at : token.start() if token else len(source)]
        if text.strip(" \t\n\r\f"):
            end_head()
        say(text)
        if token is None:
            break
        at = token.end()
        if token[2] is None:
            if token[0].startswith("<![CDATA["):
                say(token[0][9:].removesuffix("]]>"))
            continue
        tag, rest = token[2].lower(), token[3]
        if token[1]:
            if tag in ("br", "p") and not places.get(tag):
                end_block() if tag == "p" else say(" ")
            # an inline end tag doesn't end the block around it
            if places.get(tag) and not (tag in INLINE and blocks and blocks[-1] > places[tag][-1]):
                k = places[tag][-1]
                while len(open_tags) > k:
                    close()
            continue
        if tag not in IN_HEAD:
            end_head()
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                end_block()
            continue
        if tag in CLOSES:
            reach = stops[RULE[tag]][-1]
            inner = [at for t in CLOSES[tag][0] for at in places.get(t, ())[bisect_right(places.get(t, ()), reach) :][:1]]
            while inner and len(open_tags) > min(inner):
                close()
        kinds, declared = _attributes(rest) if rest.strip(" /") else (set(), False)
        hidden = open_tags[-1][2] or tag in HIDDEN or declared
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if rest.endswith("/") and tag not in INLINE:
            continue
        if tag not in INLINE:
            end_block()
        if (tag in INLINE and not kinds) or hidden:
            element = open_tags[-1][1]
        else:
            element = len(page.tag)
            above = open_tags[-1][1]
            page.tag.append(tag)
            page.parent.append(above)
            page.depth.append(page.depth[above] + 1)
            page.kinds.append(kinds)
        links += tag == "a"
        places.setdefault(tag, []).append(len(open_tags))
        for rule in _stopped(tag):
            stops[rule].append(len(open_tags))
        if tag not in INLINE:
            blocks.append(len(open_tags))
        open_tags.append((tag, element, hidden))
    return page


#: names of the columns of ``describe``
FEATURES = [
    "depth", "children", "place", "siblings", "alike", "chars", "own_chars", "elements", "density", "density_to_parent", "link_share", "words", "word_length", "stops", "commas",
    "share_of_parent", "share_of_page", "before", "chars_before", "chars_after", "blocks", "long_blocks", "digits", "upper", "forms",
    *[f"tag_{t}" for t in TAGS], "tag_other", *[f"own_{k}" for k in KINDS], *[f"above_{k}" for k in KINDS], *[f"below_{k}" for k in KINDS],
    *[f"above_tag_{t}" for t in ("nav", "header", "footer", "aside", "form", "article", "main")],
]


def describe(page: Page) -> np.ndarray:
    """One row of FEATURES per element: subtree density, attribute words, depth and siblings."""
    n = len(page.tag)
    parent = page.parent
    own = np.zeros((n, 9))  # chars, linked chars, words, stops, commas, digits, capitals, texts, long texts
    first = np.full(n, -1, dtype=np.int64)
    seen = 0
    for (element, text), linked in zip(page.texts, page.linked):
        if text == "\n":
            continue
        size = len(text) - text.count(" ")
        if not size:
            continue
        words = text.count(" ") + 1
        stops = text.count(". ") + text.count("! ") + text.count("? ") + text.endswith((".", "!", "?"))
        own[element] += (size, size * linked, words, stops, text.count(","), len(DIGITS.findall(text)), len(CAPITALS.findall(text)), 1, size > 80)
        if first[element] < 0:
            first[element] = seen
        seen += size
    total = own.copy()
    elements, children = np.ones(n), np.zeros(n)
    below = np.zeros((n, len(KINDS)))
    kind = np.zeros((n, len(KINDS)))
    for e, kinds in enumerate(page.kinds):
        kind[e, list(kinds)] = 1
    forms = np.array([float(t in ("form", "fieldset", "label")) for t in page.tag])
    for e in range(n - 1, 0, -1):
        p = parent[e]
        total[p] += total[e]
        elements[p] += elements[e]
        children[p] += 1
        below[p] = np.maximum(below[p], np.maximum(below[e], kind[e]))
        forms[p] += forms[e]
        if first[e] >= 0 and (first[p] < 0 or first[e] < first[p]):
            first[p] = first[e]
    place, alike = np.zeros(n), np.zeros(n)
    before, after = np.zeros(n), np.zeros(n)
    last: dict[int, int] = {}
    tags: dict[tuple[int, str], int] = {}
    for e in range(1, n):
        p = parent[e]
        if p in last:
            place[e] = place[last[p]] + 1
            before[e] = total[last[p], 0]
            after[last[p]] = total[e, 0]
        last[p] = e
        tags[p, page.tag[e]] = tags.get((p, page.tag[e]), 0) + 1
    out = np.zeros((n, len(FEATURES)), dtype=np.float32)
    up = np.maximum(np.array(parent), 0)
    siblings = children[up]
    alike[1:] = [tags[parent[e], page.tag[e]] / max(children[parent[e]], 1) for e in range(1, n)]
    chars = total[:, 0]
    density = chars / elements
    page_chars = max(chars[0], 1)
    out[:, :25] = np.column_stack([
        page.depth, children, place, siblings, alike, np.log1p(chars), np.log1p(own[:, 0]), np.log1p(elements), np.log1p(density), density / np.maximum(density[up], 1),
        total[:, 1] / np.maximum(chars, 1), np.log1p(total[:, 2]), chars / np.maximum(total[:, 2], 1), total[:, 3] / np.maximum(total[:, 2], 1), total[:, 4] / np.maximum(total[:, 2], 1),
        chars / np.maximum(chars[up], 1), chars / page_chars, np.maximum(first, 0) / page_chars, np.log1p(before), np.log1p(after), np.log1p(total[:, 7]), total[:, 8] / np.maximum(total[:, 7], 1),
        total[:, 5] / np.maximum(chars, 1), total[:, 6] / np.maximum(chars, 1), forms,
    ])
    at = 25
    for e, tag in enumerate(page.tag):
        out[e, at + (TAGS.index(tag) if tag in TAGS else len(TAGS))] = 1
    at += len(TAGS) + 1
    k = len(KINDS)
    out[:, at : at + k] = kind
    above_tags = ("nav", "header", "footer", "aside", "form", "article", "main")
    above, above_tag = np.zeros((n, k)), np.zeros((n, len(above_tags)))
    for e in range(1, n):
        p = parent[e]
        above[e] = np.maximum(above[p], kind[p])
        above_tag[e] = above_tag[p]
        if page.tag[p] in above_tags:
            above_tag[e, above_tags.index(page.tag[p])] = 1
    out[:, at + k : at + 2 * k] = above
    out[:, at + 2 * k : at + 3 * k] = below
    out[:, at + 3 * k :] = above_tag
    return out
