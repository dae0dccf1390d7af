"""Labelled pages for the main-text field: made from a seed, with the layouts that public web pages commonly have."""

from __future__ import annotations

import random

from .crf import Block, blocks

_SYLLABLES = "the er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ä ö ü é è ñ ó".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.main, self.seen = rng, set(), set()

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self, low: int, high: int, stop: bool = True) -> str:
        """Words that stand in no other block of the page."""
        while True:
            words = [self.word() for _ in range(self.rng.randint(low, high))]
            for i in range(len(words) - 1):
                if self.rng.random() < 0.1:
                    words[i] += self.rng.choice((",", ",", ".", " &amp;", "&quot;"))
            text = " ".join(words).capitalize() + (self.rng.choice(("." if self.rng.random() < 0.9 else "!", "?", ".")) if stop else "")
            if text not in self.seen:
                self.seen.add(text)
                return text

    def own(self, low: int = 2, high: int = 120, stop: bool | None = None) -> str:
        text = self.sentence(low, high, self.rng.random() < 0.9 if stop is None else stop)
        odd = self.rng.random()
        if odd < 0.06:
            text = text.replace(" ", " | ")
        elif odd < 0.09:
            text = text.upper().replace(" ", "!! ").replace("&AMP;", "&amp;").replace("&QUOT;", "&quot;")
        elif odd < 0.13:
            text = text.replace(" ", self.pick("### ", "%%% ", "&amp;&amp;&amp; ", "*** ", " @ ", " http://x.y/ ", " &copy; "))
        self.main.add(text)
        return text

    def pick(self, *xs):
        return self.rng.choice(xs)

    def boxed(self, names: tuple[str, ...], inner: str, tags: tuple[str, ...] = ("div", "div", "section", "aside")) -> str:
        name, tag = self.pick(*names), self.pick(*tags)
        if self.rng.random() < 0.3:
            name = name + self.pick("-wrapper", "-box", "-inner", "_area", " clearfix", "-1", "-container", " block")
        kind = self.pick("class", "class", "class", "id")
        return f'<{tag} {kind}="{name}">{inner}</{tag}>'

    def links(self, n: int) -> str:
        made = [f'<a href="/{i}">{self.sentence(1, 3, False)}</a>' for i in range(n)]
        return self.pick("<ul>" + "".join(f"<li>{a}</li>" for a in made) + "</ul>", " | ".join(made), "".join(f"<div>{a}</div>" for a in made), "<p>" + " ".join(made) + "</p>")

    def blurb(self) -> str:
        return self.pick("", f"<h3>{self.sentence(1, 5, False)}</h3>", f"<h4>{self.sentence(1, 4, False)}</h4>") + self.pick(f"<p>{self.sentence(3, 40)}</p>", self.sentence(3, 40), f"<p>{self.sentence(3, 25)}</p><p>{self.sentence(3, 25)}</p>")

    def nav(self) -> str:
        inner = self.links(self.rng.randint(2, 8))
        return self.pick(f"<nav>{inner}</nav>", f"<nav>{inner}</nav>", f'<div role="navigation">{inner}</div>', self.boxed(("menu", "nav", "navbar", "navigation", "main-menu", "breadcrumb", "breadcrumbs", "topnav", "menu-items", "pagination", "pager"), inner, ("div", "ul", "div", "section")))

    def top(self) -> str:
        inner = self.pick(f"<h1>{self.sentence(1, 4, False)}</h1>", f"<p>{self.sentence(2, 8)}</p>", self.sentence(1, 4, False), f"<h2>{self.sentence(1, 5, False)}</h2><p>{self.sentence(2, 12)}</p>") + self.pick("", self.nav())
        return self.pick(f"<header>{inner}</header>", f"<header>{inner}</header>", f'<div role="banner">{inner}</div>', self.boxed(("header", "site-header", "masthead", "topbar", "top-bar", "page-header", "branding", "banner", "logo"), inner))

    def foot(self) -> str:
        inner = self.pick(f"&copy; {self.sentence(1, 12)}", f"<p>&copy; 2020 {self.sentence(1, 5)}</p>", self.blurb(), self.links(4), f"&copy; {self.word()}.example.net &middot; {self.sentence(3, 14)}") + self.pick("", "", self.links(3))
        return self.pick(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f'<div role="contentinfo">{inner}</div>', self.boxed(("footer", "site-footer", "page-footer", "bottom", "copyright", "legal", "colophon"), inner, ("div", "div", "section")))

    def advert(self) -> str:
        inner = self.pick(self.sentence(2, 30), self.blurb(), f'<a href="/x">{self.sentence(2, 9)}</a>')
        return self.boxed(("ad", "ad", "ads", "advert", "adverts", "advertisement", "sponsored", "sponsor", "promo", "promotion", "ad-slot", "banner-ad", "google-ads", "adsbox", "commercial"), inner, ("div", "div", "aside", "section", "p"))

    def notice(self) -> str:
        inner = self.pick(self.sentence(3, 30), self.blurb() + "<button>" + self.sentence(1, 2, False) + "</button>", f"<p>{self.sentence(3, 30)}</p>")
        return self.pick(f'<div role="{self.pick("alert", "dialog", "alertdialog", "status")}">{inner}</div>', f"<noscript>{self.sentence(3, 12)}</noscript>", self.boxed(("cookie", "cookies", "cookie-banner", "cookie-notice", "consent", "gdpr", "notice", "alert", "warning", "message", "popup", "modal", "overlay", "privacy-notice", "notification", "disclaimer", "paywall", "toast"), inner, ("div", "div", "aside", "section", "p", "dialog")))

    def side(self) -> str:
        inner = self.pick(self.blurb(), self.links(self.rng.randint(2, 6)), self.blurb() + self.links(3))
        return self.pick(f"<aside>{inner}</aside>", f"<aside>{inner}</aside>", f'<div role="complementary">{inner}</div>', self.boxed(("sidebar", "side", "side-bar", "widget", "widgets", "right-col", "sidecol", "related", "related-posts", "recommended", "more-stories", "popular", "trending", "share", "social", "social-links", "tags", "author-box", "rail"), inner))

    def form(self) -> str:
        inner = self.pick(f"<label>{self.sentence(1, 4, False)}</label><input name=q><button>{self.sentence(1, 2, False)}</button>", f"<p>{self.sentence(3, 14)}</p><input><button type=submit>{self.sentence(1, 2, False)}</button>", f"<select><option>{self.sentence(1, 2, False)}</option><option>{self.sentence(1, 2, False)}</option></select>", f"{self.sentence(2, 8)} <input><textarea>{self.sentence(1, 6)}</textarea>", f"<fieldset><legend>{self.sentence(1, 4, False)}</legend>{self.sentence(2, 9)}</fieldset>")
        made = f'<form action="/{self.word()}"{self.pick("", " class=search", " id=newsletter")}>{inner}</form>'
        return self.pick(made, made, self.boxed(("newsletter", "subscribe", "signup", "login", "search", "search-form", "contact-form", "poll"), self.pick(made, inner)))

    def comments(self) -> str:
        n = self.rng.randint(1, 6)
        one = lambda: self.pick(f"<p>{self.sentence(2, 60)}</p>", self.sentence(2, 60), f"<h4>{self.sentence(1, 2, False)}</h4><p>{self.sentence(2, 70)}</p><p>{self.sentence(2, 30)}</p>", f"<b>{self.word()}</b> <blockquote>{self.sentence(2, 40)}</blockquote>")
        each = self.pick(*[(f"<{t}{c}>", f"</{t}>") for t in ("div", "li", "article") for c in (' class="comment"', ' class="reply"', ' class="comment-body"')], ("<li>", "</li>"), ("<div>", "</div>"))
        inner = self.pick("", f"<h3>{self.sentence(1, 4, False)}</h3>", f"<h2>{n} {self.sentence(1, 2, False)}</h2>") + "".join(each[0] + one() + each[1] for _ in range(n))
        return self.boxed(("comments", "comments", "comment-list", "commentlist", "comment-section", "reader-comments", "disqus_thread", "responses", "discussion", "replies", "user-comments", "feedback"), inner, ("div", "section", "section", "ol", "aside"))

    def paragraph(self) -> str:
        r = self.rng.random()
        p = self.pick(("<p>", "</p>"), ("<p>", "</p>"), ("<p>", "</p>"), ("<p>", ""))
        if r < 0.62:
            return p[0] + self.own(1, self.pick(6, 30, 130)) + p[1]
        if r < 0.68:
            return f"<p><b>{self.own(1, 60)}<br>"
        if r < 0.74:
            return self.pick("<h2>{}</h2>", "<h3>{}</h3>", "<h4>{}</h4>").format(self.own(1, 8, False))
        if r < 0.80:
            return self.pick("<ul>{}</ul>", "<ol>{}</ol>").format("".join(f"<li>{self.own(1, 20)}</li>" for _ in range(self.rng.randint(1, 4))))
        if r < 0.84:
            return self.pick("<blockquote>{}</blockquote>", "<pre>{}</pre>", "<blockquote><p>{}</p></blockquote>", "<figure><figcaption>{}</figcaption></figure>").format(self.own(2, 30))
        if r < 0.87:
            return "<table><tr>" + "".join(f"<td>{self.own(1, 8)}</td>" for _ in range(3)) + "</tr></table>"
        if r < 0.93:
            return f"<div>{self.own(1, 50)}</div>"
        text = self.own(8, 40)
        a, b, c = text.partition(" ")
        return f'<p>{a}{b}<a href="/y">{c[:9]}</a>{c[9:]}</p>'

    def body(self) -> str:
        inner = [self.pick("<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "{}").format(self.own(1, 14, None))] if self.rng.random() < 0.85 else []
        for _ in range(self.rng.randint(1, 14)):
            inner.append("<p>" * (not inner or inner[-1][:1] != "<") + self.paragraph() if not inner or inner[-1].startswith("<") else f"<p>{self.own(2, 60)}</p>")
            if self.rng.random() < 0.07:
                inner.append(self.pick(self.advert, self.form, self.side, self.notice)())
        if self.rng.random() < 0.15:
            inner.append(self.pick(self.comments, self.side, self.nav)())
        text = "".join(inner)
        name = self.pick("content", "post", "post-content", "entry", "entry-content", "article", "article-body", "story", "story-body", "text", "main-content", "page-content", "body-text", "post-body", "article-text")
        return self.pick(f"<article>{text}</article>", f"<article>{text}</article>", f"<main>{text}</main>", f"<main><article>{text}</article></main>", f'<article class="{name}">{text}</article>', f'<div class="{name}">{text}</div>', f'<div id="{name}">{text}</div>', f'<section class="{name}">{text}</section>', f'<div id="main"><div class="{name}">{text}</div></div>', f"<main><div>{text}</div></main>", f'<div role="main">{text}</div>', f"<div>{text}</div>", f"<section>{text}</section>", f'<article><div class="{name}">{text}</div></article>')

    def html(self) -> str:
        r = self.rng
        head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{self.sentence(1, 12, False)}</title>{self.pick('', '<style>p{margin:0}</style>')}<script>var t='</p>';</script></head><body>"
        before = [f() for f in (self.top, self.nav, self.advert, self.notice, self.side, self.form) if r.random() < 0.45]
        after = [f() for f in (self.comments, self.side, self.advert, self.nav, self.form, self.notice) if r.random() < 0.4]
        r.shuffle(before), r.shuffle(after)
        middle = self.body()
        if r.random() < 0.3:
            middle = f'<div class="{self.pick("container", "wrapper", "page", "row", "site", "layout", "content-wrapper", "main")}">{"".join(before)}{middle}{"".join(after)}</div>'
        else:
            middle = "".join(before) + middle + "".join(after)
        page = head + middle + (self.foot() if r.random() < 0.85 else "") + "</body></html>"
        return page if r.random() < 0.9 else page.removesuffix("</body></html>")


def labelled_pages(n: int = 1600, seed: int = 3) -> list[tuple[str, list[Block], list[int]]]:
    """(html, blocks, labels: 1 for main) of n pages."""
    import html as entities

    out = []
    for i in range(n):
        page = _Page(random.Random(seed * 1_000_003 + i))
        text = page.html()
        main = {" ".join(entities.unescape(t).split()) for t in page.main}
        found = blocks(text)
        out.append((text, found, [int(b.text in main) for b in found]))
    return out
