"""Web pages as trees of nodes with counts, from tolerant parsing, and their text in blocks."""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

#: Elements that start a block of text.
BLOCKS = frozenset(
    "html body div section article main nav header footer aside p blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 hgroup "
    "ul ol menu li dl dt dd table caption thead tbody tfoot tr td th form fieldset legend details summary dialog address hr "
    "center search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame keygen".split())
#: Elements whose text is never text of the page.
SILENT = frozenset("script style template noscript noembed noframes iframe object svg math canvas audio video head title select "
                   "textarea option optgroup datalist button applet".split())
#: Open elements that a start tag closes, up to the first element of the second set.
_ITEM = frozenset(("ul", "ol", "menu", "table"))
_CLOSES = {
    "li": (frozenset(("li",)), _ITEM), "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))), "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    **{t: (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))) for t in ("thead", "tbody", "tfoot")},
}
_P, _P_STOP = frozenset(("p",)), frozenset(("td", "th", "caption", "table", "html", "object", "button"))
_NO_BREAK = re.compile(r"[.,;:!?…。、]")

#: Words in class, id and role that tell what an element is for.
_TOKENS = {
    "good": "content article post entry story main body text prose page blog",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs toolbar pagination pager tabs toc skip sitemap",
    "ad": "ad ads advert adverts advertisement adsbygoogle sponsor sponsored sponsors promo promoted promotion banner dfp outbrain taboola",
    "side": "sidebar side aside complementary widget widgets rail related recommended recommendations more popular trending teaser latest",
    "foot": "footer foot contentinfo copyright legal colophon bottom disclaimer",
    "head": "header head masthead logo branding topbar top site",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription paywall signup message",
    "talk": "comment comments commentlist reply replies respond disqus discussion responses reviews thread",
    "tool": "share social sharing form login search signin tags meta byline author buttons follow actions tools",
}
_KINDS = list(_TOKENS)
_KIND_OF = {w: k for k, ws in _TOKENS.items() for w in ws.split()}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=20000)
def kinds(attrs: str) -> tuple[int, ...]:
    """Which kinds of words an element's class, id and role hold."""
    found = {_KIND_OF.get(w.lower()) for w in _WORD.findall(attrs)}
    return tuple(int(k in found) for k in _KINDS)


class Page(HTMLParser):
    """A page's nodes: block elements, and inline ones with a class, id or role.

    Per node, lists hold its tag, parent, attribute text, hidden flag and own counts (chars,
    words, chars in links, marks, links, inputs).  ``runs`` is the text in page order: (node,
    text), and None where a block starts or ends.  Nodes are in page order, so parents come first.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.attrs, self.hidden, self.given = ["#page"], [-1], [""], [0], [None]
        self.own = [[0, 0, 0, 0, 0, 0]]
        self.stack: list[tuple[str, int]] = [("#page", 0)]
        self.runs: list = []
        self.silent, self.links = 0, 0
        self.feed(html)
        self.close()

    def _pop(self, to: int) -> None:
        """Close the elements from place ``to`` of the stack on."""
        for tag, _ in self.stack[to:]:
            self.silent -= tag in SILENT
            self.links -= tag == "a"
            if tag in BLOCKS:
                self.runs.append(None)
        del self.stack[to:]

    def _close(self, tags: frozenset, stop: frozenset) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i][0]
            if tag in tags:
                self._pop(i)
                return
            if tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS
        if block and len(self.stack) > 1:
            self._close(_P, _P_STOP)
            if tag in _CLOSES:
                self._close(*_CLOSES[tag])
        node = self.stack[-1][1]
        if tag in ("input", "button", "select", "textarea"):
            self.own[node][5] += 1
        if tag in VOID:
            if block:
                self.runs.append(None)
            elif tag == "br":
                self.runs.append((node, " "))
            return
        if self.silent:
            self.silent += tag in SILENT
            self.links += tag == "a"
            self.stack.append((tag, node))
            return
        if tag == "a":
            self.links += 1
            self.own[node][4] += 1
        said, hidden, given = "", 0, None
        for name, value in attrs:
            if name in ("class", "id", "role"):
                said += " " + (value or "")
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (
                    name == "style" and value and "display:none" in value.replace(" ", "").lower()):
                hidden = 1
            elif name == MARK:
                given = value
        if block or said or hidden:
            self.parent.append(node)
            node = len(self.tag)
            self.tag.append(tag)
            self.attrs.append(said)
            self.hidden.append(hidden)
            self.given.append(given)
            self.own.append([0, 0, 0, 0, 0, 0])
        if block:
            self.runs.append(None)
        self.silent += tag in SILENT
        self.stack.append((tag, node))

    def handle_startendtag(self, tag, attrs):
        # as browsers do: a slash closes void elements and drawings only
        if not self.silent and tag not in ("svg", "math"):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            open_ = self.stack[i][0]
            if open_ == tag:
                self._pop(i)
                return
            if tag not in BLOCKS and open_ in BLOCKS:
                return  # an inline end tag doesn't close the blocks it crosses

    def handle_data(self, data):
        if self.silent:
            return
        node = self.stack[-1][1]
        self.runs.append((node, data))
        n = len(data)
        own = self.own[node]
        if data.isspace():
            return
        own[0] += n
        own[1] += data.count(" ") + 1
        own[3] += len(_NO_BREAK.findall(data))
        if self.links > 0:
            own[2] += n


#: Attribute that names a training page's labels.
MARK = "data-part"


def blocks(runs: list, keep) -> str:
    """The kept nodes' text: white space to one space within a block, blocks by two line ends."""
    out, held = [], []
    for run in runs:
        if run is None:
            if held:
                text = " ".join("".join(held).split())
                if text:
                    out.append(text)
                held = []
        elif keep[run[0]]:
            held.append(run[1])
    text = " ".join("".join(held).split())
    if text:
        out.append(text)
    return "\n\n".join(out)
