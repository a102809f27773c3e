"""Main text of web pages: boosted trees over element features, decoded along the tree.

Every element is a wrapper (outside the article, may hold it), content or extra.  Boosted trees give each
element the log-probabilities of the three from its tag, attribute words, the text, links and elements of its
subtree, its depth and its siblings.  The best labelling of the whole tree is found by dynamic programming under
the rule that below extra all is extra and below content nothing is a wrapper, so ancestors and descendants
never contradict each other.  Text whose element is content is kept, block by block.

The trees are fitted on invented pages with known main text (pages_training.py), whose number is fixed.

Defined results: null, empty and tagless texts without content give an empty string; nothing is cut off long
pages; broken markup is closed as browsers do; rows with the same id are extracted one by one; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.boosting import BoostedTrees
from tessera.llm.html_tree import Tree
from tessera.llm.pages_training import CONTENT, EXTRA, WRAPPER, training_pages

TRAINING_PAGES = 700
#: Elements labelled in one vectorised step.
STEP_ELEMENTS = 20_000

# Fixed lists of what markup says about an element.
TAGS = "html body div section article main p h1 h2 h3 ul ol li a b span nav header footer aside form button label table tr td blockquote head title script style".split()
FOR = frozenset("article content post entry story main body text page".split())
AGAINST = frozenset(
    "ad ads advert banner sponsored promo nav menu navbar sidebar side widget cookie consent notice alert newsletter popup modal search login subscribe signup form "
    "comment comments discussion replies reply share social tags breadcrumb crumbs related recommended more stories footer header masthead site author bio copyright toolbar pagination".split()
)
REMARKS = frozenset("comment comments discussion replies reply".split())
APART = frozenset("nav header footer aside form head script style noscript iframe svg button select title".split())
_TAG = {t: k for k, t in enumerate(TAGS)}
N_FEATURES = 29


def features(tree: Tree) -> np.ndarray:
    """A row for each element."""
    n = len(tree.tag)
    chars, links, stops, runs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    anchor = [False] * n
    for k in range(1, n):
        anchor[k] = tree.tag[k] == "a" or anchor[tree.parent[k]]
    for k, _, text in tree.texts:
        size = len(text.strip())
        if size:
            chars[k] += size
            runs[k] += 1
            stops[k] += text.count(".") + text.count(",")
            if anchor[k]:
                links[k] += size
    own = chars.copy()
    elements = np.ones(n)
    parent = tree.parent
    tag, words = tree.tag, tree.words
    for k in range(n - 1, 0, -1):
        p = parent[k]
        chars[p] += chars[k]
        links[p] += links[k]
        stops[p] += stops[k]
        runs[p] += runs[k]
        elements[p] += elements[k]
    out = np.zeros((n, N_FEATURES))
    children: list[int] = [0] * n
    paragraphs = [0] * n
    good, bad, apart, remarks = [0] * n, [0] * n, [0] * n, [0] * n
    inside = [0] * n
    place = [0] * n
    for k in range(1, n):
        p = parent[k]
        place[k] = children[p]
        children[p] += 1
        paragraphs[p] += tag[k] == "p"
        mine = words[k]
        g = sum(w in FOR for w in mine) if mine else 0
        b = sum(w in AGAINST for w in mine) if mine else 0
        out[k, 0], out[k, 1] = g, b
        good[k], bad[k] = good[p] + g, bad[p] + b
        apart[k] = apart[p] + (tag[k] in APART)
        inside[k] = inside[p] + (tag[k] in ("article", "main"))
        remarks[k] = remarks[p] + (any(w in REMARKS for w in mine) if mine else 0)
    up = np.array(parent)
    up[0] = 0
    count, paras = np.array(children), np.array(paragraphs)
    page = max(chars[0], 1)
    density = links / np.maximum(chars, 1)
    out[:, 2] = [_TAG.get(t, -1) for t in tag]
    out[:, 3] = out[up, 2]
    out[:, 4], out[:, 5], out[:, 6], out[:, 7], out[:, 8] = good, bad, apart, inside, remarks
    out[:, 9] = tree.depth
    out[:, 10] = np.log1p(chars)
    out[:, 11] = np.log1p(own)
    out[:, 12] = density
    out[:, 13] = chars / page
    out[:, 14] = chars / np.maximum(chars[up], 1)
    out[:, 15] = np.log1p(elements)
    out[:, 16] = chars / elements
    out[:, 17] = chars / np.maximum(runs, 1)
    out[:, 18] = stops / np.maximum(chars, 1)
    out[:, 19] = count
    out[:, 20] = paras
    out[:, 21] = count[up]
    out[:, 22] = paras[up]
    out[:, 23] = place
    out[:, 24] = np.array(place) / np.maximum(count[up], 1)
    out[:, 25] = density[up]
    out[:, 26] = [t in APART for t in tag]
    out[:, 27] = [t in ("article", "main") for t in tag]
    # text of sibling paragraphs by the whole of the parent
    by = np.zeros(n)
    is_p = np.array([t == "p" for t in tag])
    np.add.at(by, up[is_p], chars[is_p])
    out[:, 28] = by[up] / np.maximum(chars[up], 1)
    return out


def decode(parent: list[int], score: np.ndarray) -> list[int]:
    """The labelling of greatest total score in which a wrapper may hold all, content all but wrappers, extra only extra."""
    n = len(parent)
    total = score.tolist()
    for k in range(n - 1, 0, -1):
        w, c, x = total[k]
        up = total[parent[k]]
        both = c if c > x else x
        up[0] += w if w > both else both
        up[1] += both
        up[2] += x
    out = [WRAPPER] * n
    for k in range(1, n):
        w, c, x = total[k]
        above = out[parent[k]]
        if above == EXTRA:
            out[k] = EXTRA
        elif above == CONTENT:
            out[k] = CONTENT if c > x else EXTRA
        else:
            out[k] = WRAPPER if w >= c and w >= x else CONTENT if c > x else EXTRA
    return out


def assemble(tree: Tree, labels: list[int]) -> str:
    blocks: list[list[str]] = []
    last = None
    for k, block, text in tree.texts:
        if labels[k] == CONTENT:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
    return "\n\n".join(b for b in (" ".join("".join(b).split()) for b in blocks) if b)


def _known_labels(html: str) -> tuple[Tree, list[int]]:
    """The tree of an invented page and its elements' states, from the data-s attributes."""
    marked = Tree(html.replace('data-s="0"', 'class="stwrapper"').replace('data-s="1"', 'class="stcontent"').replace('data-s="2"', 'class="stextra"'))
    states = {"stwrapper": WRAPPER, "stcontent": CONTENT, "stextra": EXTRA}
    out = [WRAPPER]
    for k in range(1, len(marked.tag)):
        own = next((states[w] for w in marked.words[k] if w in states), None)
        above = out[marked.parent[k]]
        out.append(own if own is not None else (EXTRA if above == WRAPPER else above))
    return Tree(html), out


def known_text(html: str) -> str:
    tree, labels = _known_labels(html)
    return assemble(tree, labels)


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES) -> BoostedTrees:
    made = [_known_labels(h) for h in training_pages(pages)]
    return BoostedTrees(3).fit(np.concatenate([features(t) for t, _ in made]), np.concatenate([labels for _, labels in made]))


def extract(pages: list[str | None], model: BoostedTrees) -> list[str]:
    out, trees, rows = [], [], []

    def flush() -> None:
        if not trees:
            return
        score = model.log_proba(np.concatenate(rows))
        at = 0
        for t in trees:
            out.append(assemble(t, decode(t.parent, score[at : at + len(t.tag)])))
            at += len(t.tag)
        trees.clear()
        rows.clear()

    held = 0
    for html in pages:
        tree = Tree(html)
        trees.append(tree)
        rows.append(features(tree))
        held += len(tree.tag)
        if held >= STEP_ELEMENTS:
            flush()
            held = 0
    flush()
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for every row."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = extract(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
