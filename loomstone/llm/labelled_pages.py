"""Labelled web pages to learn main text from: layouts as sites build them, with ``data-main`` on what is article and what is not.

The pages are drawn from a grammar by a seeded generator: navigation, banners, notices, adverts, sidebars, forms, comments and
footers stand around an article, under the usual element names, classes and ids, under meaningless ones, or under none. Words
are made up, as no feature reads them.
"""

from __future__ import annotations

import random

# Class and id names in common use, by what they stand on.
NAMES = {
    "article": "article post entry content story main body text news page single blog hentry article-body post-content entry-content main-content story-body page-content article__content richtext prose",
    "wrapper": "wrapper container page site row layout outer inner wrap columns grid app root col site-content content-area primary",
    "nav": "nav navigation menu navbar topnav main-menu primary-nav breadcrumbs breadcrumb menubar site-nav tabs pagination pager links toc-nav language-switcher skip-links",
    "header": "header site-header masthead top topbar banner branding logo page-header head-bar toolbar search-bar",
    "footer": "footer site-footer bottom copyright colophon legal footer-links footer-widgets imprint credits page-footer",
    "sidebar": "sidebar aside side widget widgets rail right-column left-column secondary related related-posts recommended popular trending most-read more-stories teaser tag-cloud archive author-box about-author infobox-links",
    "ad": "ad ads advert advertisement sponsored sponsor promo banner-ad adsbox dfp google-ad promotion commercial affiliate partner",
    "notice": "notice cookie cookies cookie-notice consent gdpr alert message popup modal overlay warning subscribe-notice paywall privacy-banner toast announcement disclaimer",
    "form": "form newsletter signup subscribe login search search-form contact-form feedback poll survey register comment-form",
    "comments": "comments comment comment-list comments-area responses discussion replies reply disqus respond thread reader-comments user-comments",
    "meta": "meta byline author date published timestamp share sharing social share-buttons tags post-meta entry-meta categories print reading-time posted-on info kicker-links",
}
NAMES = {k: v.split() for k, v in NAMES.items()}


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.plain = self.r.random() < 0.12  # a site whose names mean nothing

    def word(self) -> str:
        r = self.r
        end = r.choice(["", "", "", "", "", "", "###", "&amp;&amp;", "%%", "***", "$"]) if r.random() < 0.05 else ""
        return "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ü", "ción", "é", "ou", "st"]) for _ in range(r.choice([1, 1, 2, 2, 3, 4]))) + end

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, high: int = 16) -> str:
        return self.words(2, high).capitalize() + self.r.choice([".", ".", ".", ".", "!", "?"])

    def prose(self, sentences: int) -> str:
        if self.r.random() < 0.08:  # what stands in texts besides sentences
            return self.pick(" | ".join(self.words(1, 2) for _ in range(self.r.randint(2, 9))), f"&copy; 2019 {self.words(1, 5)}. {self.sentence(8)}", f"{self.word()}@{self.word()}.org", f"https://{self.word()}.org/{self.r.randint(1, 999)}", "".join(self.r.choice("#*-=~ 0123456789&gt;".split(" ")) for _ in range(self.r.randint(1, 40))), f"{self.word()}_{self.word()}({self.r.randint(0, 99)});", self.word().upper(), self.words(1, 3))
        out = []
        for _ in range(self.r.randint(1, sentences)):
            s = self.sentence()
            if self.r.random() < 0.12:
                s = f'<a href="/{self.r.randint(1, 99)}">{s}</a>' if self.r.random() < 0.3 else f'{s} <a href="/x">{self.words(1, 4)}</a> {self.sentence()}'
            elif self.r.random() < 0.12:
                s = f"<{(t := self.r.choice(['b', 'i', 'em', 'strong', 'span', 'code']))}>{s}</{t}>"
            out.append(s)
        return self.r.choice([" ", " ", "\n"]).join(out)

    def named(self, kind: str, strength: float = 0.85) -> str:
        r = self.r
        if self.plain:
            return f' class="{r.choice("bcdfgjkmqxz")}{r.randint(10, 999)}"' if r.random() < 0.7 else ""
        if r.random() > strength:
            return ""
        name = r.choice(NAMES[kind])
        name = r.choice([name, name, name, f"{name}-{r.choice(['wrapper', 'inner', 'block', 'box', 'area', 'section', 'container'])}", f"{r.choice(['site', 'page', 'block', 'c', 'js', 'main'])}-{name}", name + " " + r.choice(NAMES[kind]), name + f" col-{r.randint(1, 12)}"])
        return f' {r.choice(["class", "class", "class", "id"])}="{name}"'

    def maybe(self, p: float, make, *args) -> str:
        return make(*args) if self.r.random() < p else ""

    def pick(self, *choices) -> str:
        return self.r.choice(choices)

    def links(self, n: int) -> str:
        r, tag = self.r, self.pick("li", "li", "li", "", "div")
        items = [f'<a href="/{i}">{self.words(1, 5)}</a>' for i in range(r.randint(2, n))]
        if tag == "li":
            close = "" if r.random() < 0.1 else "</li>"
            return f"<{(t := self.pick('ul', 'ul', 'ol'))}>" + "".join(f"<li>{x}{close}" for x in items) + f"</{t}>"
        return "".join(f"<div>{x}</div>" for x in items) if tag else self.pick(" | ", " ", " · ", " &raquo; ").join(items)

    # what is not article
    def off(self, tag: str, kind: str, body: str, strength: float = 0.85) -> str:
        return f'<{tag} data-main="0"{self.named(kind, strength)}>{body}</{tag}>'

    def nav(self) -> str:
        return self.off("nav", "nav", self.links(9), 0.5) if self.r.random() < 0.6 else self.off("div", "nav", self.links(9), 0.95)

    def header(self) -> str:
        body = self.pick(f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 3)}</div>", f"<p>{self.words(2, 6)}</p>", f'<a href="/">{self.words(1, 2)}</a>')
        body += self.maybe(0.4, self.sentence, 8) + self.maybe(0.5, self.nav) + self.maybe(0.3, self.form)
        return self.off("header", "header", body, 0.5) if self.r.random() < 0.6 else self.off("div", "header", body, 0.95)

    def footer(self) -> str:
        body = self.pick(f"&copy; {self.words(1, 3)} &middot; {self.sentence()}", f"<p>&copy; 2020 {self.words(1, 4)}. {self.sentence()}</p>", f"<p>{self.prose(3)}</p>", self.sentence(20)) + self.maybe(0.5, self.links, 6)
        return self.off("footer", "footer", body, 0.4) if self.r.random() < 0.65 else self.off("div", "footer", body, 0.97)

    def ad(self) -> str:
        body = self.pick(self.prose(3), self.words(2, 10), f"<p>{self.prose(2)}</p>", f'<a href="http://x">{self.sentence()}</a>', f"<h4>{self.words(1, 4)}</h4><p>{self.sentence()}</p>")
        return self.off(self.pick("div", "div", "div", "aside", "section"), "ad", body, 0.97)

    def notice(self) -> str:
        body = self.pick(f"<p>{self.prose(2)}</p>", self.sentence(24), f"<p>{self.prose(2)}</p><button>{self.word()}</button>", f'{self.sentence(20)} <a href="/p">{self.words(1, 2)}</a>')
        return self.off(self.pick("div", "div", "section", "aside", "dialog"), "notice", body, 0.97)

    def form(self) -> str:
        body = f"<label>{self.words(1, 5)}</label><input name=q>" + self.maybe(0.5, lambda: f"<p>{self.sentence(20)}</p>") + self.maybe(0.4, lambda: f"<select><option>{self.word()}<option>{self.word()}</select>") + self.maybe(0.6, lambda: f"<button>{self.word()}</button>")
        form = f"<form{self.named('form', 0.4)}>{body}</form>"
        return self.off("div", "form", self.maybe(0.6, lambda: f"<h3>{self.words(1, 5)}</h3>") + form, 0.7) if self.r.random() < 0.5 else form.replace("<form", '<form data-main="0"', 1)

    def sidebar(self) -> str:
        box = lambda: self.pick("", f"<h3>{self.words(1, 3)}</h3>") + self.pick(self.links(7), f"<p>{self.prose(2)}</p>", self.links(6), f'<p>{self.sentence()}</p><a href="/m">{self.words(1, 3)}</a>')
        body = "".join(self.pick(box(), f"<div{self.named('sidebar', 0.6)}>{box()}</div>", self.ad()) for _ in range(self.r.randint(1, 4)))
        return self.off("aside", "sidebar", body, 0.5) if self.r.random() < 0.55 else self.off(self.pick("div", "section"), "sidebar", body, 0.97)

    def comments(self) -> str:
        one = lambda: f"<{(t := self.pick('div', 'li', 'div', 'li', 'div', 'div', 'div', 'article'))}{self.named('comments', 0.7)}>{self.maybe(0.7, lambda: f'<div{self.named("meta", 0.6)}>{self.words(1, 3)}</div>')}{self.pick(f'<p>{self.prose(4)}</p>', self.prose(3))}{self.maybe(0.3, lambda: '<a href=#>' + self.word() + '</a>')}</{t}>"
        body = self.maybe(0.7, lambda: f"<h3>{self.words(1, 3)}</h3>") + "".join(one() for _ in range(self.r.randint(1, 6))) + self.maybe(0.4, self.form)
        return self.off(self.pick("section", "div", "div", "ol", "aside"), "comments", body, 0.97)

    def meta(self) -> str:
        body = self.pick(self.words(1, 4), f'<a href="/a">{self.words(1, 2)}</a> <time>{self.words(1, 3)}</time>', self.links(4), f"<span>{self.words(1, 3)}</span>")
        return self.off(self.pick("div", "div", "ul", "p"), "meta", body, 0.97)

    # what is
    def block(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.72:
            return f"<p>{self.maybe(0.06, lambda: '<b>')}{self.prose(r.choice([1, 2, 4, 8, 8, 30]))}" + self.pick("</p>", "</p>", "</p>", "</p>", "</p>", "<br>", "")
        if kind < 0.80:
            return f"<h{(n := r.randint(2, 4))}>{self.words(1, 8)}</h{n}>"
        if kind < 0.86:
            item = lambda: self.pick(self.words(1, 6), self.sentence(), f"<p>{self.prose(2)}</p>", f'<a href="/l">{self.words(1, 5)}</a>', f'<a href="/l">{self.words(1, 3)}</a> {self.sentence()}')
            return f"<{(t := self.pick('ul', 'ol'))}>" + "".join(f"<li>{item()}</li>" for _ in range(r.randint(1, 6))) + f"</{t}>"
        if kind < 0.89:
            return f"<blockquote>{self.pick(self.prose(3), f'<p>{self.prose(3)}</p>')}</blockquote>"
        if kind < 0.92:
            return "<table>" + "".join("<tr>" + "".join(f"<{(t := self.pick('td', 'td', 'th'))}>{self.words(1, 4)}</{t}>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if kind < 0.94:
            return f"<figure><img src=a><figcaption>{self.sentence()}</figcaption></figure>"
        if kind < 0.96:
            return f"<pre>{self.words(3, 12)}</pre>"
        return f"<div>{self.pick(self.prose(4), f'<p>{self.prose(4)}</p><p>{self.prose(3)}</p>')}</div>"

    def article(self) -> str:
        r = self.r
        title = f"<h{(n := r.choice([1, 1, 1, 2]))}>{self.words(1, 10)}</h{n}>"
        head = self.pick(title, title, title, "", f"<header>{title}{self.maybe(0.5, self.meta)}</header>") + self.maybe(0.35, self.meta)
        blocks = [self.block() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20]))]
        for extra in (self.ad, self.meta, self.sidebar, self.form, self.notice):
            if r.random() < 0.08:
                blocks.insert(r.randint(0, len(blocks)), extra())
        body = head + "".join(blocks)
        if r.random() < 0.2:
            body = head + f"<div{self.named('article', 0.7)}>{''.join(blocks)}</div>"
        tag = r.random()
        if tag < 0.35:
            return f'<article data-main="1"{self.named("article", 0.4)}>{body}</article>'
        if tag < 0.5:
            return f'<main data-main="1"{self.named("article", 0.4)}>{body}</main>'
        if tag < 0.58:
            return f"<main{self.named('wrapper', 0.3)}>{self.maybe(0.3, self.nav)}" + f'<article data-main="1">{body}</article>{self.maybe(0.3, self.comments)}</main>'
        name = self.named("article", 0.92) + self.maybe(0.05, lambda: ' role="main"')
        return f'<{(t := self.pick("div", "div", "div", "section", "td"))} data-main="1"{name}>{body}</{t}>' if tag < 0.95 else f'<div data-main="1">{body}</div>'

    def page(self) -> str:
        r = self.r
        bare = r.random() < 0.06  # an article alone
        before = [m for m, p in ((self.notice, 0.2), (self.header, 0.55), (self.nav, 0.6), (self.ad, 0.3), (self.form, 0.1), (self.notice, 0.1)) if r.random() < p and not bare]
        after = [m for m, p in ((self.meta, 0.15), (self.sidebar, 0.2), (self.comments, 0.35), (self.form, 0.15), (self.ad, 0.15), (self.nav, 0.1), (self.footer, 0.8), (self.notice, 0.15)) if r.random() < p and not bare]
        if r.random() < 0.3:
            r.shuffle(before)
        middle = self.maybe(0.2, self.sidebar) + self.article() + self.maybe(0.3, self.sidebar)
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            middle = f"<{(t := self.pick('div', 'div', 'section'))}{self.named('wrapper')}>{middle}</{t}>"
        body = "".join(m() for m in before) + f"<!-- {self.word()} -->" * (r.random() < 0.3) + middle + "".join(m() for m in after)
        for _ in range(r.choice([0, 0, 1])):
            body = f"<div{self.named('wrapper')}>{body}</div>"
        if r.random() < 0.05:
            body = f"<form action=/>{body}</form>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><script>var t='</p>';</script></head><body{self.pick('', '', ' class="home page single"')}>{body}</body></html>"


def page(number: int) -> str:
    """Labelled page of a number; the same at every call."""
    return _Writer(number).page()
