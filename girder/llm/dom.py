"""Blocks of an HTML page: a forgiving parser and the features of its block elements.

Only block elements are nodes. Inline markup is seen through; links count as link text of the node
around them. Nothing recurses, so depth is no limit. Each pass is linear in the page, whatever its
markup: open elements are found by their tag, and no part of a tag that never ends is read twice.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: What may end a tag, or begin a value that may hold a ">".
_STOP = re.compile(r""">|=\s*(["'])""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
#: Ends of the names of attributes that are read; those of others aren't, whatever their values hold.
_READ = ("class", "id", "role", "itemprop", "aria-label", "style", "hidden")
#: Longest attribute string that is remembered; longer ones are read anew.
_REMEMBERED = 2000
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SENTENCE = re.compile(r"[.!?;:…。]")

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose content isn't markup; that of xmp is text, that of the others no text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "title", "xmp", "noembed", "noframes"}
_END_OF = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}
#: The head, parts of forms, and what a player shows only where it can't play.
SKIPPED = {"head", "select", "button", "datalist", "canvas", "audio", "video"}
BLOCKS = HEADINGS | {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: A start tag ends an open element of these, up to one of those around it.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_NO_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "figcaption"} | {"hr"}

#: Words of attributes by what they say of an element.
TOKENS: list[set[str]] = [
    {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", "toc", "skip", "topbar", "links", "categories", "tags", "archive"},
    {"header", "head", "masthead", "banner", "logo", "branding", "top"},
    {"footer", "foot", "bottom", "copyright", "legal", "credits", "colophon"},
    {"sidebar", "side", "aside", "widget", "rail", "complementary", "column"},
    {"ad", "ads", "advert", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "promoted", "outbrain", "taboola", "affiliate"},
    {"comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "feedback", "reader", "readers", "responses"},
    {"form", "search", "subscribe", "newsletter", "signup", "login", "register", "contact", "share", "sharing", "social", "follow"},
    {"cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "banner", "toast", "message", "paywall", "warning", "disclaimer", "notification"},
    {"related", "recommended", "recommendations", "more", "trending", "popular", "latest", "teaser", "card", "list"},
    {"article", "content", "post", "entry", "story", "main", "body", "text", "blog", "page", "prose", "single", "articlebody"},
]
_GROUPS = [{"p"}, HEADINGS, {"li", "dd", "dt"}, {"td", "th", "tr", "tbody", "table"}, {"div", "section", "center", "body", "html"}, {"article", "main"}, {"nav", "menu", "ul", "ol", "dl"}, {"header", "hgroup"}, {"footer", "address"}, {"aside", "details", "dialog"}, {"form", "fieldset", "legend"}, {"blockquote", "pre", "figure", "figcaption"}]
_AROUND = [{"nav", "menu"}, {"header"}, {"footer"}, {"aside", "dialog"}, {"form", "fieldset"}, {"article"}, {"main"}, {"li"}, {"table"}]


@lru_cache(maxsize=4096)
def _said(attributes: str) -> tuple[int, bool]:
    """Bit set of TOKENS that class, id and the like hold, and whether the element is hidden."""
    bits, hidden = 0, False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if not name.endswith(_READ):
            continue
        if name.endswith("hidden"):
            hidden = True
        elif name.endswith("style"):
            hidden = hidden or "display:none" in value.replace(" ", "").lower()
        else:
            words = {w.lower() for w in _WORD.findall(value)}
            bits |= sum(1 << i for i, group in enumerate(TOKENS) if words & group)
    return bits, hidden


_GROUP_OF = {tag: i for i, group in enumerate(_GROUPS) for tag in group}
_AROUND_OF = {tag: 1 << i for i, group in enumerate(_AROUND) for tag in group}


class _Tags:
    """Tags of a page from left to right: (start, end, name, attributes); no name for comments and the like."""

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in ">\"'"}
        #: Places of values that a tag without an end has been read through.
        self.dead: set[int] = set()

    def _end(self, at: int) -> int:
        """Place of the ">" that ends a tag whose name ends at ``at``: one outside of quoted values,
        or the first of all if there is none. There is one somewhere."""
        i, seen = at, []
        while i <= self.last[">"] and (m := _STOP.search(self.html, i)):
            if not m[1]:
                return m.start()
            if m.start() in self.dead or m.end() > self.last[m[1]]:
                break
            seen.append(m.start())
            i = self.html.index(m[1], m.end()) + 1
        self.dead.update(seen)
        return self.html.index(">", at)

    def __iter__(self) -> Iterator[tuple[int, int, str, str]]:
        html, self.at = self.html, 0
        while (start := html.find("<", self.at)) >= 0:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                self.at = len(html) if end < 0 else end + 3
                yield start, self.at, "", ""
            elif start > self.last[">"]:
                return
            elif m := _NAME.match(html, start + 1):
                end = self._end(m.end())
                self.at = end + 1
                yield start, end + 1, m[0].lower(), html[m.end() : end]
            elif html.startswith(("<!", "<?", "</"), start):
                self.at = html.index(">", start) + 1
                yield start, self.at, "", ""
            else:
                # A lone "<" is text, so what is before it isn't cut from what follows.
                self.at = start + 1


class Page:
    """Block elements in document order, and the texts that stand directly in them."""

    def __init__(self, html: str):
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.bits: list[int] = []
        self.hidden: list[bool] = []
        #: Text blocks in page order: node, text, characters of it in links.
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(html)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        said = _said if len(attributes) < _REMEMBERED else _said.__wrapped__
        bits, hidden = said(attributes) if attributes else (0, False)
        self.tag.append(tag)
        self.parent.append(parent)
        self.bits.append(bits)
        self.hidden.append(hidden)
        return len(self.tag) - 1

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("", self._open("html", "", -1))]
        #: Places in the stack of the open elements of each tag, and how many of them are skipped.
        places: dict[str, list[int]] = defaultdict(list)
        held: list[str] = []
        linked = skipped = 0

        def flush() -> None:
            nonlocal linked
            if held:
                text = " ".join(("".join(held)).split())
                if text:
                    self.blocks.append((stack[-1][1], text, min(linked, len(text))))
                held.clear()
            linked = 0

        def close(to: int) -> None:
            """Ends all open elements from place ``to`` of the stack up."""
            nonlocal skipped
            if any(t in BLOCKS for t, _ in stack[to:]):
                flush()
            for t, _ in stack[to:]:
                places[t].pop()
                skipped -= t in SKIPPED
            del stack[to:]

        def last(tags: set[str], but: set[str] = frozenset()) -> int:
            """Place of the last open element of ``tags``, if none of ``but`` is open in it; else 0."""
            at = max((places[t][-1] for t in tags if places[t]), default=0)
            return at if all(not places[t] or places[t][-1] < at for t in but) else 0

        def say(text: str) -> None:
            nonlocal linked
            held.append(text)
            if places["a"]:
                linked += len(text.strip())

        at = 0
        tags = _Tags(html)
        for start, end, tag, attributes in tags:
            if start > at and not skipped:
                text = html[at:start]
                say(unescape(text) if "&" in text else text)
            at = end
            if not tag:
                continue
            if tag[0] == "/":
                tag = tag[1:]
                if i := last({tag}):
                    close(i)
                elif tag in BLOCKS:
                    flush()
                continue
            if tag in RAW:  # up to its end tag nothing is markup
                found = _END_OF[tag].search(html, at)
                at = tags.at = found.start() if found else len(html)
                if tag == "xmp" and not skipped:
                    flush()
                    say(html[end:at])
                    flush()
                continue
            if tag in _NO_P and (i := last({"p"})):
                close(i)
            if tag in _ENDS and (i := last(*_ENDS[tag])):
                close(i)
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag in ("br", "wbr", "img"):
                    held.append(" " if tag != "wbr" else "")
                continue
            if tag == "body" and skipped:  # a head that was not closed
                while skipped:
                    close(len(stack) - 1)
            node = stack[-1][1]
            if tag in BLOCKS:
                flush()
                if not skipped:
                    node = self._open(tag, attributes, node)
            skipped += tag in SKIPPED
            places[tag].append(len(stack))
            stack.append((tag, node))
        if at < len(html) and not skipped:
            held.append(unescape(html[at:]))
        flush()

    def own_chars(self) -> np.ndarray:
        out = np.zeros(len(self.tag))
        for node, text, _ in self.blocks:
            out[node] += len(text)
        return out


def features(pages: list[Page]) -> np.ndarray:
    """One row for each node of each page: densities, attribute words, depth, siblings, places.

    Columns: text of the subtree and of the node, share of links, text for each tag, sentence marks,
    word length, depth, place among siblings, number of siblings and of those alike, their mean
    text, shares of the page and place in it, children; then the element's group, what its
    attributes say, what those around it say, and the elements it stands in.
    """
    starts_at = np.cumsum([0, *(len(p.tag) for p in pages)])
    n = int(starts_at[-1])
    own, link, words, stops, first = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [-1.0] * n
    parent = [0] * n
    depth, index, kids, around, said, alike = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    tag: list[str] = []
    bits: list[int] = []
    for base, page in zip(starts_at.tolist(), pages, strict=False):
        place = 0
        for node, text, linked in page.blocks:
            i = base + node
            own[i] += len(text)
            link[i] += linked
            words[i] += text.count(" ") + 1
            stops[i] += len(_SENTENCE.findall(text))
            if first[i] < 0:
                first[i] = place
            place += len(text)
        tag += page.tag
        bits += page.bits
        parent[base] = base
        count: dict[tuple[int, str], int] = {}
        for k in range(1, len(page.tag)):
            i, p = base + k, base + page.parent[k]
            parent[i] = p
            depth[i] = depth[p] + 1
            index[i] = kids[p]
            kids[p] += 1
            around[i] = around[p] | _AROUND_OF.get(tag[p], 0)
            said[i] = said[p] | bits[p]
            count[p, tag[i]] = count.get((p, tag[i]), 0) + 1
        for k in range(1, len(page.tag)):
            alike[base + k] = count[parent[base + k], tag[base + k]]
    sub, sub_link, sub_words, sub_stops, tags = own.copy(), link.copy(), words.copy(), stops.copy(), [1] * n
    for base, page in zip(starts_at.tolist(), pages, strict=False):
        for i in range(base + len(page.tag) - 1, base, -1):
            p = parent[i]
            sub[p] += sub[i]
            sub_link[p] += sub_link[i]
            sub_words[p] += sub_words[i]
            sub_stops[p] += sub_stops[i]
            tags[p] += tags[i]
            if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
                first[p] = first[i]
    up, root = np.array(parent), np.repeat(starts_at[:-1], np.diff(starts_at))
    chars, mine, linked, of_words, of_stops, of_tags, start, children = map(np.array, (sub, own, sub_link, sub_words, sub_stops, tags, first, kids))
    total = np.maximum(1, chars[root])
    siblings = np.maximum(children[up], 1)
    group = np.array([_GROUP_OF.get(t, 4) for t in tag])
    columns = [np.log1p(chars), np.log1p(mine), linked / np.maximum(chars, 1), np.log1p(chars / of_tags), of_stops / np.maximum(of_words, 1), np.minimum(of_stops, 20), chars / np.maximum(of_words, 1), np.minimum(depth, 30), np.array(index) / siblings, np.minimum(siblings, 50), np.minimum(alike, 50), np.log1p(chars[up] / siblings), chars / total, np.maximum(start, 0) / total, chars[up] / total, np.minimum(children, 50)]
    columns += [group == g for g in range(len(_GROUPS))]
    for flags, k in ((bits, len(TOKENS)), (said, len(TOKENS)), (around, len(_AROUND))):
        columns += [np.array(flags) >> g & 1 for g in range(k)]
    return np.stack([np.asarray(c, np.float32) for c in columns], 1)


def decode(page: Page, logit: np.ndarray) -> list[bool]:
    """Which nodes to keep: the best choice in which whatever is kept has its ancestors kept.

    A node counts its log-odds, weighted by the logarithm of the text that stands directly in it.
    A subtree is dropped as a whole unless it is worth keeping as a whole, so no node is kept in a
    dropped one; hidden elements are dropped.
    """
    weight = logit * (0.3 + np.log1p(page.own_chars()))
    value = weight.tolist()
    for i in range(len(value) - 1, 0, -1):
        if page.hidden[i]:
            value[i] = -math.inf
        if value[i] > 0:
            value[page.parent[i]] += value[i]
    keep = [True] * len(value)  # the root holds the page
    for i in range(1, len(value)):
        keep[i] = keep[page.parent[i]] and value[i] > 0
    return keep


def main_text(page: Page, logit: np.ndarray) -> str:
    keep = decode(page, logit)
    return "\n".join(text for node, text, _ in page.blocks if keep[node] and (node or logit[0] > 0))
