"""Removal of repeated runs of consecutive sentences.

A text is cut into sentences after . ! ? and at line ends; a sentence of more than `longest` words is cut
again before words whose hash is the least of the `NEAR` words on either side, and `longest` words after a
cut, so that a passage without full stops has several, and the same ones wherever it stands.  With `grow`,
as the query runs, the shortest run of at least `run` sentences and `least` words from every sentence on, and
back from every one, is hashed (lower-cased A-Z, white space as one space; parts without words don't count).
Without it only runs of exactly `run` sentences that have `least` words are.  Of all places of a run in the
corpus the first, by document and place, stays; sentences that any other place covers go.  Runs are told apart by
128-bit hashes.

Only hashes and places are shuffled, packed by bucket.  Within an Arrow batch all places but the first are
settled at once, so a very common run sends one row for each batch.

Defined results: null and empty texts have no sentences; rows without an id stay as they are; rows with the
same id and place are one place, so repeated rows don't remove each other; texts with fewer than `run`
sentences or `least` words stay; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, stash, with_ids

RUN = 2
LEAST_WORDS = 15
LONGEST = 20
NEAR = 4
BUCKET_BYTES = 16 << 20

#: Every alternative begins with a fixed character and ends greedily, so long blanks are read once.
_BREAK = re.compile(r"((?<=[.!?])[ \t\r]+(?:\n\s*)?|\n\s*)")
_WORD = re.compile(r"\s*\S+\s*|\s+")
_MOST = np.uint64(2**64 - 1)
_FACTORS = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], np.uint64)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def sentences(text: str | None, longest: int = LONGEST) -> list[str]:
    """Parts of the text that join to it again, each a sentence with the white space after it."""
    parts = _BREAK.split(text or "")
    out = []
    for k in range(0, len(parts), 2):
        part = parts[k] + (parts[k + 1] if k + 1 < len(parts) else "")
        if not part:
            continue
        if len(part) > 2 * longest and len(part.split()) > longest:
            words = _WORD.findall(part)
            edges = cuts(words, longest)
            out += ["".join(words[a:b]) for a, b in zip(edges, edges[1:])]
        else:
            out.append(part)
    return out


def cuts(words: list[str], longest: int) -> list[int]:
    """Places between words that depend on the words near them only, and at most `longest` words apart."""
    h = np.array([xxhash.xxh3_64_intdigest(w.strip().encode().translate(_LOWER)) for w in words], np.uint64)
    pad = np.full(NEAR, _MOST)
    near = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, h, pad]), NEAR)
    least = (h < near[: len(h)].min(1)) & (h <= near[NEAR + 1 :].min(1))
    out = [0]
    for k in [*(np.flatnonzero(least[1:]) + 1).tolist(), len(words)]:
        out += range(out[-1] + longest, k, longest)
        out.append(k)
    return out


def runs(parts: list[str], run: int, least: int, grow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash (two words), first part and number of parts of each run that is to be looked up."""
    hashes, words, at = [], [], []
    for k, p in enumerate(parts):
        w = p.encode().translate(_LOWER).split()
        if w or not grow:
            at.append(k)
            words.append(len(w))
            hashes.append(xxhash.xxh3_128_digest(b" ".join(w)))
    n = len(at)
    if n < run:
        return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, place = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2), np.array(at)
    total = np.concatenate([[0], np.cumsum(words)])
    k = np.arange(n)
    if grow:
        end = np.maximum(np.searchsorted(total, total[:-1] + least), k + run)
        start = np.minimum(np.searchsorted(total, total[1:] - least, "right") - 1, k + 1 - run)
        a, b = np.concatenate([k[end <= n], start[start >= 0]]), np.concatenate([end[end <= n], k[start >= 0] + 1])
        pairs = np.unique(a * (n + 1) + b)
        a, b = pairs // (n + 1), pairs % (n + 1)
    else:
        a = np.flatnonzero(total[run:] - total[:-run] >= least)
        b = a + run
    out, size = h[a], b - a
    for j in range(1, int(size.max(initial=0))):
        x = np.flatnonzero(size > j)
        out[x] = mix(out[x] * _FACTORS + h[a[x] + j])
    return out, place[a], place[b - 1] + 1 - place[a]


def _firsts(h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """All three sorted by hash, document and place; which rows are the first of their hash; the numbers of those elsewhere than the first."""
    order = np.lexsort((place, doc, h[:, 1], h[:, 0]))
    h, doc, place = h[order], doc[order], place[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]).any(1)
    head = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    return h, doc, place, first, np.flatnonzero(~first & ((doc != doc[head]) | (place != place[head])))


def _pack(run: int, least: int, longest: int, grow: bool, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() * 7919
        for batch in batches:
            hashes, docs, places = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                h, at, size = runs(sentences(text.as_py(), longest), run, least, grow)
                hashes.append(h)
                places.append(at << 32 | size)
                docs.append(np.full(len(at), doc, np.int64))
            if not hashes:
                continue
            h, doc, place, first, later = _firsts(np.concatenate(hashes), np.concatenate(docs), np.concatenate(places))
            out = []
            if len(later):
                out.append((-1 - turn % buckets, b"", doc[later].tobytes(), place[later].tobytes()))
            x = np.flatnonzero(first)
            bucket = (h[x, 0] % np.uint64(buckets)).astype(np.int64)
            x = x[np.argsort(bucket, kind="stable")]
            edge = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edge)).tolist():
                y = x[edge[k] : edge[k + 1]]
                out.append((k, h[y].tobytes(), doc[y].tobytes(), place[y].tobytes()))
            turn += 1
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "h", "doc", "place"])

    return rows


def _later(table: pa.Table) -> pa.Table:
    """The places (first part << 32 | number of parts) of one bucket that are not the first of their run."""
    doc, place = (np.concatenate([np.frombuffer(x, t) for x in table[k].to_pylist()]) for k, t in (("doc", "<i8"), ("place", "<i8")))
    if table["bucket"][0].as_py() >= 0:
        h = np.concatenate([np.frombuffer(x, "<u8") for x in table["h"].to_pylist()]).reshape(-1, 2)
        _, doc, place, _, gone = _firsts(h, doc, place)
        doc, place = doc[gone], place[gone]
    return pa.table({"doc_id": pa.array(doc, pa.int64()), "place": pa.array(place, pa.int64())})


def _rewrite(longest: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, texts = [], []
            for text, places in zip(batch.column(1), batch.column(2)):
                text, gone = text.as_py() or "", ()
                if places.is_valid:
                    parts = sentences(text, longest)
                    gone = {k for p in places.as_py() for k in range(p >> 32, min((p >> 32) + (p & 0xFFFFFFFF), len(parts)))}
                    text = "".join(p for k, p in enumerate(parts) if k not in gone)
                removed.append(len(gone))
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_removed", "text"])

    return rows


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, least: int = LEAST_WORDS, longest: int = LONGEST, grow: bool = False) -> DataFrame:
    """doc_id, n_removed (sentences) and the text that is left, for every row."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    known = docs.where("doc_id is not null and text is not null")
    size = known.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(8, -(-int(size) // BUCKET_BYTES))
    packed = known.mapInArrow(_pack(run, least, longest, grow, buckets), "bucket int, h binary, doc binary, place binary")
    later = packed.groupBy("bucket").applyInArrow(_later, "doc_id long, place long")
    later = stash(later.groupBy("doc_id").agg(F.collect_set("place").alias("places")), "later")
    ids = later.select("doc_id")
    n = ids.count()
    # only the texts that lose something are shuffled
    cut = with_ids(docs, ids, "doc_id", "left_semi", n).join(later.hint("merge"), "doc_id").select("doc_id", "text", "places")
    cut = cut.mapInArrow(_rewrite(longest), "doc_id long, n_removed long, text string")
    rest = with_ids(docs, ids, "doc_id", "left_anti", n)
    return rest.select("doc_id", F.lit(0).cast("long").alias("n_removed"), F.coalesce("text", F.lit("")).alias("text")).unionByName(cut)
