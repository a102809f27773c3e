"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing.

Every task packs the documents of its own partition in buffers of a few thousand pieces, so
nothing is shuffled and memory is bounded whatever the number of documents.  A document's
tokens are cut into full windows and a rest; rests are partitioned by the differencing method:
partial partitions wait in a heap ordered by their imbalance (largest minus smallest window),
and the two with the largest imbalances are merged, the fullest windows of one with the emptiest
of the other.  Where the fullest window ends above the capacity, the number of windows rises and
the differencing starts again.

Defined results: a null text has only its end token; a null doc_id is kept as null; repeated rows
are packed as often as they come; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.common import _SPACE, column_bytes, steps

WINDOW = 2048
END_ID = 1
#: Pieces of at most so many tokens are differenced; smaller pieces leave less padding and cut more documents.
PIECE = 512
#: Pieces in one differencing problem.
BUFFER = 3000
#: Pieces kept by each worker's encoder, about 200 bytes each.
CACHE = 500_000
#: Bytes of text encoded at a time in a worker (the arrays beside it take some twenty times as much), and bytes of new pieces handed to the tokenizer as one text.
STEP = 1 << 20
CHUNK = 4096
#: The first two bytes of the UTF-8 blocks that hold white space (U+1680, U+2000 to U+203F, U+205F, U+3000).
_WIDE = [0xE19A, 0xE280, 0xE281, 0xE380]

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of whole columns of texts, from a tokenizer file; each distinct piece is encoded once.

    The pre-tokenizer always breaks before white space that follows something else, whatever stands around it, so
    a text's ids are those of its pieces between such places, one after the other.  Pieces are told apart in Arrow
    (by their bytes, not by a hash), and the ids of all of them are put together by one gather.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=False)
        added = {k: len(str(t.content).encode()) for k, t in self.tok.get_added_tokens_decoder().items()}
        #: how many bytes of text a token stands for; a token of the byte-level vocabulary has a character for each
        self.width = np.zeros(max([*vocab.values(), *added]) + 1, np.int64)
        self.width[list(vocab.values())] = [len(t) for t in vocab]
        self.width[list(added)] = list(added.values())
        self.limit = cache
        self._forget()

    def _forget(self) -> None:
        """Leaves one known piece, the closing id."""
        self.known: dict[bytes, int] = {}
        self.pool, self.begin, self.size = np.array([END_ID], "<u4"), np.zeros(1, np.int64), np.ones(1, np.int64)

    @staticmethod
    def cuts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where pieces begin: at rows, and at ASCII white space after anything but white space."""
        space = _SPACE[raw]
        begin = np.zeros(len(raw) + 1, bool)
        begin[1:-1] = space[1:] & ~space[:-1]
        at = np.flatnonzero(begin)
        if len(at := at[raw[at - 1] >= 0x80]):
            begin[at[_wide_space_before(raw, at)]] = False
        begin[off] = True
        return np.flatnonzero(begin[:-1])

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)]

    def _chained(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that may follow each other, and how many each has."""
        text, ends = b"".join(pieces), np.cumsum([len(p) for p in pieces])
        # chunks end with a piece
        last = np.unique(np.append(np.searchsorted(ends, np.arange(CHUNK, len(text), CHUNK)), len(ends) - 1))
        marks = [0, *ends[last].tolist()]
        parts = [x for k in range(0, len(last), 16) for x in self._ids([text[a:b] for a, b in zip(marks[k : k + 16], marks[k + 1 : k + 17])])]
        ids = np.concatenate(parts)
        stop = np.cumsum(self.width[ids])
        at = np.searchsorted(stop, ends)
        if stop[-1] == len(text) and np.array_equal(stop[at], ends):
            return ids, np.diff(at, prepend=-1)
        return self._alone(pieces)  # bytes that aren't UTF-8

    def _alone(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = self._ids(pieces)
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Adds pieces and returns their slots. A piece that begins and ends with anything else than its neighbours' cuts allow is encoded alone."""
        data = pa.array(pieces, pa.large_binary())
        raw, off = column_bytes(data)
        last = raw[off[1:] - 1]
        chain = _SPACE[raw[off[:-1]]] & ~_SPACE[last]
        at = np.flatnonzero(chain & (last >= 0x80))
        chain[at[_wide_space_before(raw, off[at + 1])]] = False
        slots = np.empty(len(pieces), np.int64)
        for some, encode in ((np.flatnonzero(chain), self._chained), (np.flatnonzero(~chain), self._alone)):
            if len(some):
                part = [pieces[k] for k in some.tolist()]
                ids, sizes = encode(part)
                slots[some] = len(self.begin) + np.arange(len(some))
                self.known.update(zip(part, range(len(self.begin), len(self.begin) + len(part))))
                self.begin = np.append(self.begin, len(self.pool) + np.cumsum(sizes) - sizes)
                self.size = np.append(self.size, sizes)
                self.pool = np.append(self.pool, ids)
        return slots

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, each with its closing id, and the n + 1 offsets of the rows."""
        begin = self.cuts(raw, off)
        spans = pa.py_buffer(np.append(begin, len(raw)).astype(np.int64))
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, spans, pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        pieces = found.dictionary.to_pylist()
        slots = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        if (missing := np.flatnonzero(slots < 0)).size:
            if len(self.known) + len(missing) > self.limit and self.known:
                self._forget()
                missing = np.arange(len(pieces))
            slots[missing] = self._learn([pieces[k] for k in missing.tolist()])
        row = np.searchsorted(begin, off)
        slot = np.insert(slots[found.indices.to_numpy(zero_copy_only=False)], row[1:], 0)
        size = self.size[slot]
        stop = np.cumsum(size)
        gather = np.repeat(self.begin[slot] - stop + size, size)
        gather += np.arange(len(gather))
        return self.pool[gather], np.append(0, stop[row[1:] + np.arange(len(off) - 1)])


def _wide_space_before(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place may be white space outside ASCII (some others in its block count too)."""
    a, b, c = (raw[np.maximum(at - k, 0)].astype(np.int64) for k in (3, 2, 1))
    return ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | np.isin(a << 8 | b, _WIDE)


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: the window of each size and the load of each window."""
    n = len(sizes)
    parent = np.arange(n)
    # a partial partition: its nonzero loads in falling order, and an item that stands for each
    heap = [(-int(s), k, np.array([s]), np.array([k])) for k, s in enumerate(sizes)] if windows > 1 else []
    if windows == 1:
        return np.zeros(n, np.int64), np.array([sizes.sum()])
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, la, na = heapq.heappop(heap)
        _, _, lb, nb = heapq.heappop(heap)
        if len(la) < len(lb):
            la, na, lb, nb = lb, nb, la, na
        both = len(la) + len(lb) - windows
        if both <= 0:
            loads, nodes = np.concatenate([la, lb]), np.concatenate([na, nb])
        else:
            loads, nodes = la.copy(), na
            tail = slice(windows - len(lb), len(la))
            loads[tail] += lb[::-1][:both]
            parent[nb[::-1][:both]] = na[tail]
            if len(lb) > both:
                loads, nodes = np.concatenate([loads, lb[: len(lb) - both]]), np.concatenate([nodes, nb[: len(lb) - both]])
        order = np.argsort(-loads, kind="stable")
        loads, nodes = loads[order], nodes[order]
        low = int(loads[-1]) if len(loads) == windows else 0
        heapq.heappush(heap, (low - int(loads[0]), tie, loads, nodes))
        tie += 1
    _, _, loads, nodes = heap[0]
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            break
        parent = up
    place = np.zeros(n, np.int64)
    place[nodes] = np.arange(len(nodes))
    return place[parent], loads


def pack(sizes: np.ndarray, capacity: int = WINDOW) -> tuple[np.ndarray, int]:
    """The window of each size, none of them fuller than capacity, and the number of windows."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, loads = difference(sizes, windows)
        if loads.max(initial=0) <= capacity:
            return window, windows
        windows += max(1, windows // 200)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process: later tasks find the pieces that earlier ones learnt."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces_of(sizes: np.ndarray, window: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document, start and length of every piece: full windows, then pieces of a rest."""
    full = sizes // window
    count = full - (-(sizes - full * window) // piece)
    doc = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = np.where(k < full[doc], k * window, full[doc] * window + (k - full[doc]) * piece)
    return doc, start, np.minimum(np.where(k < full[doc], window, piece), sizes[doc] - start)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, piece: int = PIECE, buffer: int = BUFFER) -> DataFrame:
    """A row for each piece: where it lies in its document and in which sequence, at which offset."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        first = TaskContext.get().partitionId() << 32
        count = 0
        waiting: list[list[pa.Array | np.ndarray]] = []

        def emit(cols: list) -> pa.RecordBatch:
            """Places the pieces of one differencing problem."""
            nonlocal count
            length = cols[2]
            place, offset = np.empty(len(length), np.int64), np.zeros(len(length), np.int64)
            whole = length == window
            place[whole] = np.arange(whole.sum())
            n = int(whole.sum())
            if len(rest := np.flatnonzero(~whole)):
                where, windows = pack(length[rest], window)
                order = np.argsort(where, kind="stable")
                ends = np.cumsum(length[rest][order])
                before = np.append(0, ends)[np.searchsorted(where[order], where[order])]
                offset[rest[order]] = ends - length[rest][order] - before
                place[rest] = n + where
                n += windows
            out = pa.RecordBatch.from_arrays([cols[0], *(pa.array(x, pa.int64()) for x in (*cols[1:], first + count + place, offset))], names=names)
            count += n
            return out

        def joined() -> list:
            cols = [pa.concat_arrays([x[0] for x in waiting]), *(np.concatenate(x) for x in list(zip(*waiting))[1:])]
            waiting.clear()
            return cols

        for batch in batches:
            raw, off = column_bytes(batch.column(1))
            for a, b in steps(off, STEP):
                ids, ends = encoder.encode(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                sizes = np.diff(ends)
                doc, start, length = pieces_of(sizes, window, piece)
                view, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), 4 * (ends[doc] + start)
                crc = np.fromiter(map(zlib.crc32, map(view.__getitem__, map(slice, at.tolist(), (at + 4 * length).tolist()))), np.int64, len(doc))
                waiting.append([batch.column(0).take(pa.array(a + doc)), start, length, crc, sizes[doc]])
                if sum(len(x[1]) for x in waiting) >= buffer:
                    cols = joined()
                    whole = len(cols[1]) // buffer * buffer
                    for k in range(0, whole, buffer):
                        yield emit([x[k : k + buffer] for x in cols])
                    waiting.append([x[whole:] for x in cols])
        if waiting and len((cols := joined())[1]):
            yield emit(cols)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
