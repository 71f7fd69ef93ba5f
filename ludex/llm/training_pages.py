"""A grammar of web pages with known parts, to train the extraction of main text.

Pages are drawn with many spellings of the same parts: semantic or plain elements, class names of
several habits or none, closed and unclosed paragraphs, boxes inside and around the article.  An
element on which the part changes carries it in an attribute: c (article text), b (anything else).
"""

from __future__ import annotations

import random
from html import escape

from .dom import MARK

_SYLLABLES = "an ber co da el fi gu ha in jo ka lo mi no or pa qui ra se tu un ver wi xa yo zen".split()
_GOOD = ["content", "post-content", "entry", "entry-content", "article-body", "story", "post", "main-text", "page-content", "body-text", "articleBody"]
_MENU = ["nav", "menu", "main-nav", "navbar", "site-nav", "navigation", "topmenu"]
_AD = ["ad", "ads", "advert", "ad-top", "sponsored", "promo", "banner-ad", "advertisement", "adsbygoogle"]
_SIDE = ["sidebar", "side", "widget", "right-rail", "related", "recommended", "popular", "more-stories", "trending"]
_FOOT = ["footer", "site-footer", "foot", "bottom", "copyright", "legal"]
_HEAD = ["header", "site-header", "masthead", "topbar", "branding", "page-header"]
_NOTICE = ["cookie-notice", "notice", "gdpr", "consent", "alert", "newsletter", "subscribe", "popup", "modal-overlay", "paywall"]
_TALK = ["comments", "comment-list", "responses", "discussion", "disqus_thread", "reader-comments", "replies"]
_TOOL = ["share", "social", "search-form", "login", "signup", "post-meta", "tags", "share-buttons"]


class Grammar:
    """Draws pages; ``words`` give the text."""

    def __init__(self, words: list[str], seed: int = 1):
        self.r, self.vocabulary = random.Random(seed), words or [a + b for a in _SYLLABLES for b in _SYLLABLES[:9]]

    def words(self, n: int) -> str:
        return escape(" ".join(self.r.choices(self.vocabulary, k=max(1, n))), quote=False)

    def prose(self, low: int, high: int) -> str:
        n, out = self.r.randint(low, high), []
        while n > 0:
            k = min(n, self.r.randint(3, 24))
            out.append(self.words(k).capitalize() + self.r.choice([".", ".", ".", "", "!", "?"]))
            n -= k
        return " ".join(out)

    def odds(self, p: float) -> bool:
        return self.r.random() < p

    def named(self, names: list[str], p: float = 0.8) -> str:
        """A class, id, role or no attribute."""
        if not self.odds(p):
            return ""
        kind = self.r.choice(["class", "class", "id"])
        return f' {kind}="{self.r.choice(names)}"'

    def link(self, n: int = 0) -> str:
        text = self.words(n or self.r.randint(1, 3))
        return f'<a href="/{self.r.choice(self.vocabulary)[:12] if self.odds(0.5) else "x"}">{text}</a>'

    def part(self, tag: str, names: list[str], inner: str, part: str = "b", p: float = 0.8) -> str:
        return f'<{tag} {MARK}="{part}"{self.named(names, p)}>{inner}</{tag}>'

    def links(self, low: int = 2, high: int = 9, n: int = 0) -> str:
        items = [self.link(n) for _ in range(self.r.randint(low, high))]
        shape = self.r.randrange(4)
        if shape < 2:
            return "<ul>" + "".join(f"<li>{i}</li>" if self.odds(0.9) else f"<li>{i}" for i in items) + "</ul>"
        return (" | " if shape == 2 else " ").join(items)

    # boilerplate -----------------------------------------------------------------------------
    def menu(self):
        return self.part(*(("nav", _MENU, self.links(), "b", 0.4) if self.odds(0.6) else
                           (self.r.choice(["div", "ul", "section"]), _MENU, self.links(), "b", 0.9)))

    def head(self):
        inner = self.r.choice([f"<p>{self.words(self.r.randint(1, 6))}</p>", f"<h1>{self.link()}</h1>", self.words(2), f"<h2>{self.words(2)}</h2>"])
        inner += self.menu() if self.odds(0.4) else ""
        return self.part(*(("header", _HEAD, inner, "b", 0.4) if self.odds(0.6) else ("div", _HEAD, inner, "b", 1.0)))

    def advert(self):
        text = self.prose(3, 30)
        inner = self.r.choice([text, f"<p>{text}</p>", f'<a href="/x">{text}</a>', f"<h4>{self.words(3)}</h4><p>{text}</p>"])
        return self.part(self.r.choice(["div", "div", "div", "aside", "section", "span", "ins"]), _AD, inner, "b", 1.0)

    def notice(self):
        text = self.prose(4, 40)
        inner = self.r.choice([text, f"<p>{text}</p>", f"<p>{text}</p><button>{self.words(1)}</button>", f"<p>{text} {self.link(1)}</p>"])
        return self.part(self.r.choice(["div", "section", "aside", "dialog"]), _NOTICE, inner, "b", 1.0)

    def form(self):
        inner = "".join(f"<label>{self.words(2)}</label><input name='q'>" for _ in range(self.r.randint(1, 4)))
        inner += f"<button>{self.words(1)}</button>" if self.odds(0.7) else "<input type='submit'>"
        inner = (f"<p>{self.prose(3, 15)}</p>" if self.odds(0.5) else "") + inner
        return self.part(*(("form", _TOOL, inner, "b", 0.5) if self.odds(0.8) else ("div", _TOOL + _NOTICE, f"<form>{inner}</form>", "b", 1.0)))

    def tools(self):
        return self.part(self.r.choice(["div", "ul", "p", "section"]), _TOOL, self.links(2, 5, 1), "b", 1.0)

    def side(self):
        inner = "".join(self.r.choice([
            lambda: f"<h3>{self.words(2)}</h3>{self.links(3, 8, 5)}", lambda: f"<p>{self.prose(5, 40)}</p>",
            lambda: f"<div class='widget'><h4>{self.words(2)}</h4><p>{self.prose(4, 30)}</p></div>"])() for _ in range(self.r.randint(1, 4)))
        return self.part(*(("aside", _SIDE, inner, "b", 0.5) if self.odds(0.6) else (self.r.choice(["div", "section"]), _SIDE, inner, "b", 1.0)))

    def talk(self):
        tag = self.r.choice(["div", "li", "article"])
        one = lambda: f"<{tag} class='comment'><p>{self.words(2)}</p><p>{self.prose(3, 60)}</p></{tag}>" if self.odds(0.7) else f"<{tag}><b>{self.words(1)}</b> {self.prose(3, 50)}</{tag}>"  # noqa: E731,E501
        inner = (f"<h3>{self.words(2)}</h3>" if self.odds(0.7) else "") + "".join(one() for _ in range(self.r.randint(1, 8)))
        inner += self.form() if self.odds(0.3) else ""
        return self.part("ol" if tag == "li" else self.r.choice(["div", "section", "aside"]), _TALK, inner, "b", 1.0)

    def foot(self):
        inner = self.r.choice([f"&copy; {self.words(2)} &middot; {self.prose(3, 15)}", f"<p>&copy; {self.words(3)}</p>{self.links()}",
                               f"{self.links()}<p>{self.prose(3, 30)}</p>", self.prose(3, 20)])
        return self.part(*(("footer", _FOOT, inner, "b", 0.3) if self.odds(0.75) else ("div", _FOOT, inner, "b", 1.0)))

    # the article -------------------------------------------------------------------------------
    def paragraph(self, tag: str) -> str:
        low, high = self.r.choice([(1, 4), (3, 20), (10, 60), (30, 150), (80, 300)])
        text = self.prose(low, high)
        if self.odds(0.2):
            text = text + " " + self.link() + " " + self.prose(2, 20)
        if self.odds(0.12):
            text = f"<b>{text}<br>"
        elif self.odds(0.1):
            text = f"<em>{self.words(2)}</em> {text}"
        return f"<{tag}>{text}" + ("" if tag == "p" and (text.startswith("<b>") or self.odds(0.06)) else f"</{tag}>")

    def article(self) -> str:
        tag = "div" if self.odds(0.12) else "p"
        out = []
        if self.odds(0.85):
            title = f"<h{self.r.choice('1112')}>{self.words(self.r.randint(2, 12))}</h1>"
            out.append(f"<header>{title}</header>" if self.odds(0.1) else title)
        boxes = self.r.choice([0, 0, 0, 1, 2])
        for i in range(self.r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            out.append(self.paragraph(tag))
            x = self.r.random()
            if x < 0.08:
                out.append(f"<h{self.r.choice('23')}>{self.words(4)}</h3>")
            elif x < 0.12:
                out.append("<ul>" + "".join(f"<li>{self.prose(2, 25)}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>")
            elif x < 0.15:
                out.append(f"<blockquote><p>{self.prose(5, 40)}</p></blockquote>")
            elif x < 0.17:
                out.append(f"<pre>{self.words(12)}</pre>")
            elif x < 0.19:
                out.append(f"<table><tr><th>{self.words(1)}<th>{self.words(1)}</tr><tr><td>{self.words(2)}<td>{self.words(3)}</table>")
            elif x < 0.21:
                out.append(f"<figure><img src='x'><figcaption>{self.prose(3, 12)}</figcaption></figure>")
            if boxes and self.odds(0.3):
                boxes -= 1
                out.append(self.r.choice([self.advert, self.notice, self.tools, self.side, self.form])())
        if self.odds(0.15):
            k = self.r.randint(0, len(out))
            out = [*out[:k], f"<section>{''.join(out[k:])}</section>" if self.odds(0.5) else f"<div>{''.join(out[k:])}</div>"]
        if self.odds(0.1):
            out.append(self.r.choice([self.tools, self.foot, self.talk])())
        return "".join(out)

    def bare(self) -> str:
        """An article alone: plain text or its blocks, without any element around them."""
        return self.prose(1, 120) if self.odds(0.5) else self.article()

    def page(self) -> str:
        style = self.r.random()
        body = self.article()
        if style < 0.4:
            core = self.part("article", _GOOD, body, "c", 0.3)
        elif style < 0.5:
            core = self.part("main", _GOOD, body, "c", 0.3)
        elif style < 0.8:
            core = self.part(self.r.choice(["div", "div", "section"]), _GOOD, body, "c", 0.85)
        elif style < 0.85:
            core = f"<table><tr>{self.part('td', _SIDE, self.links()) if self.odds(0.5) else ''}{self.part('td', _GOOD, body, 'c', 0.5)}</tr></table>"
        elif style < 0.95:
            core = None  # the article's blocks are the body's own
        else:
            core = ""  # no article
        before = [f() for f in (self.head, self.menu, self.notice, self.advert, self.form) if self.odds(0.45)]
        after = [f() for f in (self.side, self.talk, self.notice, self.advert, self.tools, self.form) if self.odds(0.3)]
        self.r.shuffle(before)
        self.r.shuffle(after)
        last = self.foot() if self.odds(0.8) else ""
        top = ""
        if core is None:
            top, core = f' {MARK}="c"', body
        elif core and self.odds(0.3):
            inside = [core] + ([after.pop()] if after else [])
            if self.odds(0.3):
                inside.reverse()
            core = f"<{self.r.choice(['main', 'div', 'div'])}{self.named(['container', 'wrapper', 'main', 'content', 'row'], 0.6)}>{''.join(inside)}</div>"
        inner = "".join([*before, core, *after, last])
        if self.odds(0.15) and not top:
            inner = f"<div id='page'>{inner}</div>"
        start = "<!DOCTYPE html><html><head><title>x</title><script>var a = '</p>';</script></head>" if self.odds(0.8) else ""
        return f"{start}<body{top}>{inner}" + ("</body></html>" if self.odds(0.9) else "")
