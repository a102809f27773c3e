"""A small HTML tree builder: elements, and runs of text with the block that each belongs to."""

from __future__ import annotations

import re
from html import unescape

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: The rest of a tag, quoted values whole; atomic, so it never goes back.
_REST = re.compile(r"(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+")
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br button".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
P_SCOPE = frozenset("div article section li td th table button main body".split())
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}


class Tree:
    """Elements in page order: tag, parent (-1: none), depth, attribute words; and the texts: (element, block, text)."""

    __slots__ = ("tag", "parent", "depth", "words", "texts")

    def __init__(self, html: str | None):
        self.tag, self.parent, self.depth, self.words, self.texts = ["#page"], [-1], [0], [()], []
        self._build(html or "")

    def _build(self, html: str) -> None:
        """One pass: every character is read a fixed number of times, whatever the markup.

        A tag ends at the first > outside quotes.  Where quotes don't close, that tag and all later ones end at the
        first >; what follows the last > of the page is text.
        """
        tags, parents, depths, words, texts = self.tag, self.parent, self.depth, self.words, self.texts
        stack = [0]
        where: dict[str, list[int]] = {}  # places in the stack by name
        quoted = True
        block, at, n = 0, 0, len(html)

        def cut(k: int) -> None:
            for e in stack[k:]:
                where[tags[e]].pop()
            del stack[k:]

        def last(names) -> int:
            return max((where[x][-1] for x in names if where.get(x)), default=0)

        while at < n:
            start = html.find("<", at)
            if start != at:
                texts.append((stack[-1], block, unescape(html[at:start] if start >= 0 else html[at:])))
                if start < 0:
                    return
                at = start
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                at = end + 3 if end >= 0 else n
                continue
            m = _NAME.match(html, at)
            if m is None:
                end = html.find(">", at) if html[at + 1 : at + 2] in ("!", "?") else -2
                if end < 0:
                    texts.append((stack[-1], block, "<"))
                    at += 1
                    if end == -1:
                        texts.append((stack[-1], block, unescape(html[at:])))
                        return
                else:
                    at = end + 1
                continue
            end = -1
            if quoted:
                end = _REST.match(html, m.end()).end()
                if not html.startswith(">", end):
                    quoted, end = False, -1
            if end < 0:
                end = html.find(">", m.end())
                if end < 0:
                    texts.append((stack[-1], block, unescape(html[at:])))
                    return
            rest, closing, name = html[m.end() : end], html[at + 1] == "/", m.group(1).lower()
            at = end + 1
            if closing:
                if name not in INLINE:
                    block += 1
                if where.get(name):
                    cut(where[name][-1])
                continue
            if name == "br":
                texts.append((stack[-1], block, " "))
                continue
            if name in CLOSES_P and where.get("p") and where["p"][-1] > last(P_SCOPE):
                cut(where["p"][-1])
            if (rivals := SIBLINGS.get(name)) and (k := last(rivals)) > last(SCOPE[name]):
                cut(k)
            if name not in INLINE:
                block += 1
            tags.append(name)
            parents.append(stack[-1])
            depths.append(len(stack))
            words.append(tuple(w.lower() for a in _ATTRIBUTE.finditer(rest) for w in _WORD.findall(a[2] or a[3] or a[4] or "")) if rest else ())
            if name in RAW:
                found = re.compile(rf"</{re.escape(name)}(?![\w-])", re.I).search(html, at)
                end = html.find(">", found.end()) if found else -1
                at = end + 1 if end >= 0 else n
            elif name not in VOID and not rest.endswith("/"):
                where.setdefault(name, []).append(len(stack))
                stack.append(len(tags) - 1)
