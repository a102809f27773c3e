"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance.

Texts are compared lower-cased (A-Z) with white space runs as one space.  An item of n characters may
differ by floor(n * budget) edits from a passage.  It is cut into that many pieces plus one, so at least one
piece occurs unchanged in each such passage; an automaton of all pieces finds those places, and Myers'
algorithm takes the edit distance of the item to the text around each.

The benchmark is taken in blocks of bounded size, each sent to the executors once, so it may have any
number of items; documents are only scanned, never shuffled.

Defined results: null and empty texts, and items without text, match nothing; an item shorter than min_chars
matches only passages that begin and end at word boundaries; rows with the same id give a row each, rows and items without
an id are searched like all others; with ties the leftmost passage of the smallest distance counts; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET = 0.08
MIN_CHARS = 20
#: Items and bytes of text in a block, collected and sent to the executors.
BLOCK_ITEMS = 5_000
BLOCK_BYTES = 2 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def normal(text: str | None) -> str:
    return b" ".join((text or "").encode().translate(_LOWER).split()).decode()


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces that cover the item, with their offsets."""
    cut = [len(item) * j // (errors + 1) for j in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for k, c in enumerate(item):
        out[c] |= 1 << k
    return dict(out)


def distances(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> Iterator[int]:
    """Myers 1999: the edit distance of the item to the best substring that ends at each character of text.

    anchored: the substring starts where text does.
    """
    if m == 0:
        yield from (range(1, len(text) + 1) if anchored else [0] * len(text))
        return
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    low = 1 if anchored else 0
    get = peq.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) | low
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
        yield score


def best_passage(item: str, peq: dict[str, int], back: dict[str, int], text: str, a: int, b: int, errors: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the nearest passage that ends in text[a:b], leftmost first; None above errors."""
    best, end = errors + 1, 0
    for k, d in enumerate(distances(peq, len(item), text[a:b])):
        if d < best:
            best, end = d, a + k + 1
    if best > errors:
        return None
    lowest, start = best + 1, end
    for k, d in enumerate(distances(back, len(item), text[max(a, end - len(item) - best) : end][::-1], anchored=True)):
        if d < lowest:
            lowest, start = d, end - k - 1
    return best, start, end


def at_edge(text: str, k: int) -> bool:
    """No word of letters and digits goes on across place k."""
    return not 0 < k < len(text) or not (text[k - 1].isalnum() and text[k].isalnum())


def best_words(item: str, peq: dict[str, int], text: str, starts: list[int], errors: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the nearest passage between word edges that starts within errors of starts, leftmost first."""
    best = None
    for s in sorted({x for s in starts for x in range(max(0, s - errors), s + errors + 1)}):
        if not at_edge(text, s):
            continue
        for k, d in enumerate(distances(peq, len(item), text[s : s + len(item) + errors], anchored=True)):
            if d <= errors and (best is None or d < best[0]) and at_edge(text, s + k + 1):
                best = d, s, s + k + 1
        if best and best[0] == 0:
            break
    return best


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, str]], budget: float = BUDGET, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.items, self.min_chars = [], min_chars
        found: dict[str, list] = defaultdict(list)
        for item_id, raw in items:
            text = normal(raw)
            if not text:
                continue
            errors = int(len(text) * budget)
            for a, piece in pieces(text, errors):
                found[piece].append((len(self.items), a))
            self.items.append((item_id, text, errors, masks(text), masks(text[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def match(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best passage of each item in the text."""
        text = normal(raw)
        out = []
        places: dict[int, list[int]] = defaultdict(list)
        if len(self.automaton):
            for last, (size, where) in self.automaton.iter(text):
                for k, a in where:
                    places[k].append(last + 1 - size - a)
        for k, starts in places.items():
            item_id, item, errors, peq, back = self.items[k]
            if len(item) < self.min_chars:
                if best := best_words(item, peq, text, starts, errors):
                    out.append((item_id, *best))
                continue
            best = None
            upto = None
            for s in sorted(set(starts)):
                a, b = max(0, s - errors), min(len(text), s + len(item) + errors)
                if upto is not None and a <= upto:  # joins the stretch before
                    upto = max(upto, b)
                    continue
                if upto is not None:
                    best = self._better(best, best_passage(item, peq, back, text, begin, upto, errors))
                begin, upto = a, b
            best = self._better(best, best_passage(item, peq, back, text, begin, upto, errors))
            if best:
                out.append((item_id, *best))
        return out

    @staticmethod
    def _better(old, new):
        return new if old is None or (new is not None and new[0] < old[0]) else old


def blocks(bench: DataFrame, id_col: str, text_col: str, most: int = BLOCK_ITEMS, size: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of bounded size."""
    rows = bench.select(bench[id_col].cast("long").alias("id"), bench[text_col].cast("string").alias("text")).where("text is not null")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // most), -(-int(total) // size))
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k) if parts > 1 else rows
        yield sorted(((r.id, r.text) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", budget: float = BUDGET, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start, end (in the normalised text): the best passage of each item in each document."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance long, start long, end long"

    def scan(items: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, budget, min_chars)
            for batch in batches:
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    out += [(doc, *m) for m in matcher.match(text.as_py())]
                cols = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "distance", "start", "end"])

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.union, [scan(b) for b in blocks(bench, item_col, item_text)])


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", budget: float = BUDGET, min_chars: int = MIN_CHARS, **_: str) -> DataFrame:
    """The rows of docs in which no item is found, each judged by its own text; one scan, without a join."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    sent = [spark.sparkContext.broadcast(b) for b in blocks(bench, item_col, item_text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(x.value, budget, min_chars) for x in sent]
        for batch in batches:
            clean = [not any(m.match(text.as_py()) for m in matchers) for text in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
