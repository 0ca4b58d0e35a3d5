"""Made-up pages with known main text, to fit and to hold out: many layouts, random words.

A page is put together from parts as sites have them (menus, headers, notices, adverts, forms,
sidebars, comments, footers), with or without telling tags and attributes, around an article.
"""

from __future__ import annotations

import random

_SYLLABLES = "an the re on ti er in de la que ment eu sch ung ción lo ra be ver th ou st no mi ka".split()


class _Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.out: list[str] = []
        self.labels: list[int] = []
        self.main: list[str] = []
        self.style = rng.choice(["plain"] * 7 + ["symbols", "upper", "pipes"])

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def text(self, low: int, high: int) -> str:
        r = self.rng
        words = [self.word() for _ in range(r.randint(low, high))]
        for i in range(0, len(words), r.randint(6, 18)):
            words[i] = words[i].capitalize()
            if i:
                words[i - 1] += "."
        if self.style == "symbols":
            words = [w + r.choice(["***", "$$$", "&amp;&amp;", "%%%", ""]) for w in words]
        elif self.style == "upper":
            words = [w.upper() + r.choice(["!!", ""]) for w in words]
        return (" | " if self.style == "pipes" else " ").join(words) + r.choice([".", ".", ".", ""])

    def start(self, tag: str, label: int, attributes: str = "") -> None:
        self.out.append(f"<{tag}{' ' + attributes if attributes else ''}>")
        self.labels.append(label)

    def end(self, tag: str) -> None:
        self.out.append(f"</{tag}>" + self.rng.choice(["", "", "\n"]))

    def block(self, tag: str, text: str, label: int, attributes: str = "", markup: bool = True) -> None:
        r = self.rng
        self.start(tag, label, attributes)
        if label:
            self.main.append(text)
        if markup and " " in text and r.random() < 0.3:
            cut = text.index(" ", r.randrange(text.rindex(" ") + 1))
            inline = r.choice(["b", "em", "a href='/x'", "span class='x'", "strong"])
            text = f"{text[:cut]} <{inline}>{text[cut + 1 :]}</{inline.split()[0]}>"
        elif r.random() < 0.1:
            text += "<br>"
        self.out.append(text)
        if tag != "p" or r.random() > 0.15:
            self.end(tag)

    def name(self, *names: str, other: float = 0.25) -> str:
        """An attribute that tells, one with noise around it, or none."""
        r = self.rng
        if r.random() < other:
            return r.choice(["", "", f'class="c{r.randrange(99)}"', f'class="{self.word()}"', f'style="margin:{r.randrange(9)}px"'])
        name = r.choice(names)
        name = r.choice([name, name, name.upper() if r.random() < 0.1 else name, f"{self.word()}-{name}", f"{name}-{r.choice(['wrap', 'box', 'inner', 'area', '1'])}", f"{name} {self.word()}"])
        return f'{r.choice(["class", "class", "id"])}="{name}"'

    def links(self, low: int, high: int, label: int = 0) -> None:
        r = self.rng
        kind = r.choice(["ul", "ul", "ul", "ol", "div", "p"])
        self.start(kind, label, r.choice(["", self.name("menu", "links", "list", "nav", other=0.6)]))
        for _ in range(r.randint(low, high)):
            text = f'<a href="/{self.word()}">{self.text(1, r.choice([2, 2, 8])).rstrip(".")}</a>'
            if kind in ("ul", "ol"):
                self.start("li", label)
                self.out.append(text)
                if r.random() > 0.1:
                    self.end("li")
            else:
                self.out.append(text + r.choice([" ", " | ", " &middot; "]))
        self.end(kind)

    def menu(self) -> None:
        tag, attributes = self.rng.choice([("nav", ""), ("nav", self.name("navbar")), ("div", self.name("menu", "nav", "navigation", "breadcrumbs")), ("div", self.name("topbar", "menu"))])
        self.start(tag, 0, attributes)
        self.links(2, 9)
        self.end(tag)

    def header(self) -> None:
        tag, attributes = self.rng.choice([("header", ""), ("header", self.name("site", "top")), ("div", self.name("header", "masthead", "banner"))])
        self.start(tag, 0, attributes)
        self.block(self.rng.choice(["div", "p", "h1", "h2"]), self.text(1, 6), 0, self.name("logo", "title", "tagline"))
        if self.rng.random() < 0.5:
            self.menu()
        self.end(tag)

    def notice(self) -> None:
        tag = self.rng.choice(["div", "div", "section", "dialog", "aside"])
        self.start(tag, 0, self.name("cookie", "consent", "notice", "alert", "gdpr", "popup", "paywall", other=0))
        self.block(self.rng.choice(["p", "div", "p"]), self.text(6, 45), 0)
        if self.rng.random() < 0.4:
            self.out.append("<button>" + self.word() + "</button>")
        self.end(tag)

    def advert(self) -> None:
        tag = self.rng.choice(["div", "div", "div", "aside", "section"])
        self.out.append(self.rng.choice(["", "", f"<!-- ad {self.rng.randrange(99)} -->"]))
        attributes = self.name("ad", "ads", "advert", "advertisement", "sponsor", "promo", "sponsored", other=0)
        if self.rng.random() < 0.6:
            self.block(tag, self.text(3, 30), 0, attributes)
        else:
            self.start(tag, 0, attributes)
            self.block("p", self.text(3, 40), 0)
            self.end(tag)

    def form(self) -> None:
        self.start("form", 0, self.name("search", "newsletter", "subscribe", "login", "contact", other=0.4))
        if self.rng.random() < 0.8:
            self.block(self.rng.choice(["p", "div", "legend", "h3"]), self.text(2, 20), 0)
        self.out.append("<label>" + self.word() + "</label><input name=q><textarea>" + self.text(0, 5) + "</textarea><button>" + self.word() + "</button>")
        self.end("form")

    def share(self) -> None:
        self.start("div", 0, self.name("share", "social", "follow", "tags", other=0.1))
        self.links(2, 5)
        self.end("div")

    def related(self) -> None:
        tag = self.rng.choice(["div", "section", "aside"])
        self.start(tag, 0, self.name("related", "recommended", "trending", "popular", "teaser", other=0.02))
        self.block(self.rng.choice(["h2", "h3", "h4", "p"]), self.text(1, 4), 0)
        self.links(2, 6)
        self.end(tag)

    def sidebar(self) -> None:
        tag = self.rng.choice(["aside", "aside", "div", "section"])
        self.start(tag, 0, self.name("sidebar", "widget", "side", "rail", "complementary", other=0 if tag != "aside" else 0.5))
        for _ in range(self.rng.randint(1, 3)):
            if self.rng.random() < 0.6:
                self.block(self.rng.choice(["h2", "h3", "h4"]), self.text(1, 4), 0)
            if self.rng.random() < 0.5:
                self.links(2, 7)
            else:
                self.block("p", self.text(4, 70), 0)
        self.end(tag)

    def comments(self) -> None:
        tag = self.rng.choice(["section", "div", "div", "ol"])
        item = "li" if tag == "ol" else self.rng.choice(["div", "article", "p", "div"])
        self.start(tag, 0, self.name("comments", "comment-list", "reader-comments", "discussion", "responses", "replies", other=0))
        if item != "li" and self.rng.random() < 0.7:
            self.block(self.rng.choice(["h2", "h3"]), self.text(1, 3), 0)
        for _ in range(self.rng.randint(1, 6)):
            if item == "p":
                self.block("p", self.text(3, 80), 0, self.name("comment", other=0.5))
                continue
            self.start(item, 0, self.name("comment", "reply", other=0.3))
            if self.rng.random() < 0.6:
                self.block(self.rng.choice(["div", "p", "header", "footer"]), self.text(1, 5), 0, self.name("author", "meta", "date"))
            for _ in range(self.rng.randint(1, 3)):
                self.block("p", self.text(3, 80), 0)
            self.end(item)
        if item != "li" and self.rng.random() < 0.4:
            self.form()
        self.end(tag)

    def footer(self) -> None:
        tag, attributes = self.rng.choice([("footer", ""), ("footer", self.name("site")), ("div", self.name("footer", "copyright", "colophon", other=0.02))])
        self.start(tag, 0, attributes)
        if self.rng.random() < 0.4:
            self.links(2, 6)
        if self.rng.random() < 0.5:
            self.out.append("&copy; " + self.word() + ".example &middot; " + self.text(2, 30))
        else:
            self.block(self.rng.choice(["p", "div"]), "&copy; " + self.text(2, 20), 0)
        self.end(tag)

    def article(self) -> None:
        r = self.rng
        wraps = r.choice([["article"], ["article"], ["article"], ["main"], ["main", "article"], ["div"], ["div"], ["section"], ["article", "div"], ["td"]])
        attributes = [self.name("content", "post", "entry", "article", "story", "main", "body", other=0.5 if w in ("article", "main") else 0.15) for w in wraps]
        if wraps == ["td"]:
            for t in ("table", "tbody", "tr"):
                self.start(t, 1)
        for w, a in zip(wraps, attributes, strict=True):
            self.start(w, 1, a)
        if r.random() < 0.9:
            inside = r.random() < 0.15
            if inside:
                self.start("header", 1, r.choice(["", 'class="entry-header"']))
            self.block(r.choice(["h1", "h1", "h1", "h2"]), self.text(2, 14).rstrip("."), 1)
            if inside:
                self.end("header")
        typical = r.choice([3, 6, 15, 40, 90, 250])
        for _ in range(r.choice([1, 1, 1, 2, 3, 5, 8, 15])):
            x = r.random()
            if x < 0.72:
                self.block("p", self.text(1, r.choice([2, 8, typical, typical, typical * 2])), 1, r.choice(["", "", "", "", f'class="{self.word()}"']))
            elif x < 0.80:
                self.block(r.choice(["h2", "h3"]), self.text(1, 8).rstrip("."), 1)
            elif x < 0.85:
                self.start(kind := r.choice(["ul", "ol"]), 1)
                for _ in range(r.randint(2, 6)):
                    self.block("li", self.text(2, 25), 1)
                self.end(kind)
            elif x < 0.88:
                self.block(r.choice(["blockquote", "pre", "figcaption"]), self.text(4, 40), 1)
            elif x < 0.90:
                self.block("div", self.text(10, 60), 1, self.name("paragraph", "text", other=0.5))
            else:
                r.choice([self.advert, self.advert, self.share, self.related, self.form, self.sidebar])()
        if r.random() < 0.12:
            self.comments()
        for w in reversed(wraps):
            self.end(w)
        if wraps == ["td"]:
            for t in ("tr", "tbody", "table"):
                self.end(t)

    def page(self) -> str:
        r = self.rng
        self.labels.append(1)  # the root
        self.out.append(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{self.text(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>")
        self.labels.append(1)
        self.start("body", 1)
        for part, p in ((self.header, 0.45), (self.menu, 0.6), (self.notice, 0.25), (self.advert, 0.5), (self.form, 0.15)):
            if r.random() < p:
                part()
        wraps = r.choice([0, 0, 1, 1, 2, 3])
        for _ in range(wraps):
            self.start("div", 1, self.name("container", "wrap", "row", "page", "site", "layout", other=0.4))
        before = r.random() < 0.2
        if before and r.random() < 0.6:
            self.sidebar()
        self.article()
        if not before and r.random() < 0.35:
            self.sidebar()
        for part, p in ((self.share, 0.15), (self.related, 0.25), (self.comments, 0.25), (self.advert, 0.2)):
            if r.random() < p:
                part()
        for _ in range(wraps):
            self.end("div")
        for part, p in ((self.notice, 0.1), (self.form, 0.1), (self.footer, 0.85)):
            if r.random() < p:
                part()
        self.out.append("</body></html>")
        return "".join(self.out)


def sample_pages(count: int, seed: int) -> list[tuple[str, list[int], list[str]]]:
    """``count`` pages: HTML, a label for each block element in order, and the main text's blocks."""
    made = []
    for i in range(count):
        maker = _Maker(random.Random(seed * 1_000_003 + i))
        made.append((maker.page(), maker.labels, maker.main))
    return made
