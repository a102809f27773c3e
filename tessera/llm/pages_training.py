"""Invented web pages with known main text, to train and test the extraction of main text."""

from __future__ import annotations

import random
import re

WRAPPER, CONTENT, EXTRA = 0, 1, 2

_SYLLABLES = "an ba co de er fi gu ha in jo ka le mo na or pe ri sa te un vo wi th st ou la re".split()


class PageMaker:
    """A page is a list of parts (state, html); the state of an element is carried in a data-s attribute, which the extractor ignores."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        if r.random() < 0.1:
            out = [w + r.choice(["***", "###", "%%%", "&amp;&amp;", "!!"]) for w in out]
        k = 0
        while k < len(out):
            out[k] = out[k].capitalize()
            k += r.randint(3, 18)
            if k <= len(out):
                out[k - 1] += r.choice([".", ".", ",", "!", "?"])
        return " ".join(out)

    def links(self, count: int, wrap: str = "li") -> str:
        return "".join(f'<{wrap} data-s="2"><a data-s="2" href="/{self.words(1, 1)}">{self.words(1, 3)}</a></{wrap}>' for _ in range(count))

    def extra(self) -> str:
        """Something that isn't part of the article."""
        r = self.r
        kind = r.choice("nav nav menu ad ad side notice form comments share related footer header crumbs hidden plain".split())
        x = 'data-s="2"'
        if kind == "nav":
            return f"<nav {x}><ul {x}>{self.links(r.randint(2, 9))}</ul></nav>"
        if kind == "menu":
            return f'<div {x} class="{r.choice(["menu", "main-menu", "navbar", "top-nav"])}"><ul {x}>{self.links(r.randint(2, 9))}</ul></div>'
        if kind == "ad":
            return f'<div {x} class="{r.choice(["ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo"])}">{self.words(3, 40)}</div>'
        if kind == "side":
            tag, name = r.choice([("aside", ""), ("div", ' class="sidebar"'), ("div", ' id="side"'), ("aside", ' class="sidebar widget"')])
            return f"<{tag} {x}{name}><h3 {x}>{self.words(1, 4)}</h3><p {x}>{self.words(4, 50)}</p><ul {x}>{self.links(r.randint(0, 5))}</ul></{tag}>"
        if kind == "notice":
            return f'<div {x} {r.choice(["class", "id"])}="{r.choice(["cookie-notice", "notice", "cookie", "consent", "alert", "newsletter", "popup"])}"><p {x}>{self.words(5, 30)}</p><button {x}>{self.words(1, 2)}</button></div>'
        if kind == "form":
            return f'<form {x} class="{r.choice(["search", "login", "subscribe", ""])}"><label {x}>{self.words(1, 5)}</label><input type="text"><button {x}>{self.words(1, 2)}</button></form>'
        if kind == "comments":
            one = "".join(f'<{t} {x} class="comment"><p {x}>{self.words(4, 60)}</p></{t}>' for t in r.choices(["div", "article", "li"], k=r.randint(1, 5)))
            return f'<{(t := r.choice(["section", "div"]))} {x} {r.choice(["class", "id"])}="{r.choice(["comments", "comment-list", "discussion", "replies"])}"><h2 {x}>{self.words(1, 3)}</h2>{one}</{t}>'
        if kind == "share":
            return f'<div {x} class="{r.choice(["share", "social", "tags", "author-bio", "breadcrumb"])}">{self.links(r.randint(1, 5), "span")}</div>'
        if kind == "related":
            return f'<{(t := r.choice(["section", "div"]))} {x} class="{r.choice(["related", "recommended", "more-stories"])}"><h3 {x}>{self.words(1, 4)}</h3><ul {x}>{self.links(r.randint(2, 6))}</ul></{t}>'
        if kind == "footer":
            return f'<footer {x}>&copy; {self.words(1, 2)} &middot; {self.words(2, 25)}</footer>' if r.random() < 0.6 else f'<div {x} class="footer">{self.words(2, 25)}</div>'
        if kind == "header":
            return f'<{r.choice(["header", "div"])} {x} class="{r.choice(["header", "masthead", "site-header"])}"><p {x}>{self.words(1, 8)}</p>'.replace("</p>", "</p>") + "</header></div>"
        if kind == "plain":
            links = [f'<a {x} href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(r.randint(2, 8))]
            if r.random() < 0.5:
                return f"<div {x}>{r.choice([' ', ' | ', ' &middot; ']).join(links)}</div>"
            return f"<table {x}><tr {x}>" + "".join(f"<td {x}>{a}</td>" for a in links) + "</tr></table>"
        if kind == "crumbs":
            return f'<ol {x} class="breadcrumb">{self.links(r.randint(2, 4))}</ol>'
        return f"<script>var a = '{self.words(2, 9)}';</script><style>p{{margin:0}}</style>"

    def article(self, whole: bool) -> str:
        """The main text; whole: nothing else in between."""
        r, c = self.r, 'data-s="1"'
        out = [f"<h1 {c}>{self.words(3, 12)}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.72:
                inner = self.words(1, 110)
                if r.random() < 0.15:
                    inner += f' <a {c} href="/x">{self.words(1, 3)}</a> {self.words(1, 12)}'
                out.append(f"<p {c}>{inner}</p>")
            elif kind < 0.82:
                out.append(f"<p {c}><b {c}>{self.words(2, 12)}<br>")
            elif kind < 0.88:
                out.append(f"<h2 {c}>{self.words(1, 7)}</h2>")
            elif kind < 0.92:
                out.append(f"<ul {c}>" + "".join(f"<li {c}>{self.words(2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.95:
                out.append(f"<blockquote {c}><p {c}>{self.words(5, 40)}</p></blockquote>")
            elif kind < 0.97:
                out.append(f"<table {c}><tr {c}><td {c}>{self.words(1, 5)}</td><td {c}>{self.words(1, 5)}</td></tr></table>")
            elif not whole:
                out.append(self.extra())
        return "".join(out)

    def bare(self, html: str) -> str:
        """The page without telling names: no classes or ids, and mostly divs."""
        html = re.sub(r' (?:class|id)="[^"]*"', "", html)
        if self.r.random() < 0.7:
            html = re.sub(r"(</?)(?:nav|header|footer|aside|article|main|section)\b", r"\1div", html)
        return html

    def page(self) -> str:
        html = self.named_page()
        return self.bare(html) if self.r.random() < 0.2 else html

    def named_page(self) -> str:
        r, w, c = self.r, 'data-s="0"', 'data-s="1"'
        head = f'<!DOCTYPE html><html lang="en" {w}><head data-s="2"><meta charset="utf-8"><title>{self.words(3, 12)}</title><style>p{{}}</style></head><body {w}>'
        before, after = ("".join(self.extra() for _ in range(r.randint(0, 4))) for _ in range(2))
        shape = r.random()
        body = self.article(whole=r.random() < 0.7)
        if shape < 0.6:
            main = f"<article {c}>{body}</article>"
        elif shape < 0.8:
            main = f'<div {c} {r.choice(["class", "id"])}="{r.choice(["content", "post", "entry-content", "article-body", "story", "main-text"])}">{body}</div>'
        elif shape < 0.9:
            main = f"<main {c}>{body}</main>"
        else:
            main = body
        if r.random() < 0.35:
            inner = before + main + after
            tag, name = r.choice([("div", ' class="wrapper"'), ("div", ' id="page"'), ("main", ""), ("div", ""), ("section", ' class="container"')])
            return f"{head}<{tag} {w}{name}>{inner}</{tag}></body></html>"
        return f"{head}{before}{main}{after}" + ("</body></html>" if r.random() < 0.8 else "")


def training_pages(count: int, seed: int = 7) -> list[str]:
    return [PageMaker(seed * 100_003 + k).page() for k in range(count)]
