"""An interpolated modified Kneser-Ney trigram model, counted in Spark and scored from memory-mapped arrays.

Words are 64-bit hashes of lower-cased (A-Z) runs of non-space; every text ends with an end token, and before its first
token stand two start marks.

1. Words are counted by ranges of their hash.  Each range becomes a sorted array of hashes with counts.  Words are
   numbered by falling power of two of their count, so frequent words have small numbers.
2. Trigrams (u, v, w) are summed in the workers and dealt out by their middle word v, in ranges of numbers of about
   equal counts.  One task so has all u and w around a v: it counts distinct trigrams, the totals of every context
   (u, v), and how many distinct u stand before each (v, w), and writes sorted arrays of hashes with them.
   A v of more than LIMIT tokens is dealt over shards by u (and by w where u is as frequent); what such shards
   share, the u before (v, w) and the totals of split contexts, is summed by a second shuffle of those alone.
3. How many distinct v stand before each w follows by a shuffle of sums by w.
4. Discounts come from the counts of counts of each order.  p(w | u v) = (c(uvw) - D) / c(uv) + g(uv) p(w | v), where p(w | v)
   and p(w) are built alike from the counts of distinct words before, and p(w) gives unknown words a share.
5. Workers map the arrays of the shared folder into memory, some files at a time, and look up batches sorted by file.

All counts cover all training documents, in 64 bits; the arrays grow with the corpus and never pass the driver, which
sees the sizes of ranges, totals, and the few words above LIMIT.  Tasks write a file under a name that their key
fixes, by an atomic rename, so a task that runs again leaves the same file; a file that is missing later is an error.
Keys of n-grams are 48 bits of a hash inside a file of about LIMIT entries: a lookup errs with a chance of 4e-9.

Defined results: a null or empty text is one end token; rows without an id are scored and held out; repeated
rows count as often as they come; without training text every token is unknown with the share 1 / (V + 1) = 1;
other columns are ignored; more than 2^32 - 1 distinct words are refused.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column_bytes, lower_ascii, mix, stash, steps, word_hashes, work_path

#: Bytes of text counted and scored at a time in a worker; trigrams are summed within it before the shuffle.
STEP = 12 << 20
SCORE_STEP = 6 << 20
#: Tokens around the middle words of one task, and from which on a word's are dealt over shards.
LIMIT = 1 << 20
WORD_RANGES = 1024
CLASSES = 64
#: Model files that a worker keeps mapped.
OPEN_FILES = 16
END = np.uint64(0x9C1E5A70D4B3F268)
_A, _B, _C = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


# ------------------------------------------------------------------ files in the shared folder


def _local(uri: str) -> str | None:
    return uri[7:] if uri.startswith("file://") else uri[5:] if uri.startswith("file:") else uri if uri.startswith("/") else None


def put_arrays(uri: str, name: str, arrays: list[np.ndarray]) -> None:
    """One file of several arrays: their number, their kinds and lengths, then each from a multiple of 8 bytes on."""
    head = [len(arrays)]
    for a in arrays:
        head += [{"u1": 1, "u4": 4, "u8": 8}[a.dtype.str[1:]], len(a)]
    blobs = [np.array(head, "<i8").tobytes(), *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)]
    part = f"{name}.{uuid.uuid4().hex}"
    if path := _local(uri):
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{part}", "wb") as f:
            f.writelines(blobs)
        os.replace(f"{path}/{part}", f"{path}/{name}")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{part}") as f:
            for b in blobs:
                f.write(b)
        store.move(f"{path}/{part}", f"{path}/{name}")


class Files:
    """The arrays of files, mapped into memory; the least recently used file is closed when there are too many."""

    def __init__(self, uri: str, most: int = OPEN_FILES):
        self.uri, self.most, self.held = uri, most, OrderedDict()

    def get(self, name: str) -> list[np.ndarray]:
        if name in self.held:
            self.held.move_to_end(name)
            return self.held[name]
        while len(self.held) >= self.most:
            self.held.popitem(last=False)
        raw = self._map(name)
        n = int(raw[:8].view("<i8")[0])
        head = raw[8 : 8 + 16 * n].view("<i8")
        at, out = 8 + 16 * n, []
        for size, length in head.reshape(-1, 2).tolist():
            out.append(raw[at : at + size * length].view(f"<u{size}"))
            at += size * length + -(size * length) % 8
        self.held[name] = out
        return out

    def _map(self, name: str) -> np.ndarray:
        if (path := _local(self.uri)) is not None:
            return np.asarray(np.memmap(f"{path}/{name}", np.uint8, "r"))
        from pyarrow import fs

        store, there = fs.FileSystem.from_uri(self.uri)
        with tempfile.NamedTemporaryFile(prefix="tessera-model-") as f:  # gone from the folder once mapped
            with store.open_input_stream(f"{there}/{name}") as source:
                shutil.copyfileobj(source, f, 8 << 20)
            f.flush()
            return np.asarray(np.memmap(f.name, np.uint8, "r"))


def pack_counts(c: np.ndarray) -> list[np.ndarray]:
    """One byte for each count; those of 255 or more with their places beside."""
    big = np.flatnonzero(c >= 255)
    return [np.minimum(c, 255).astype("<u1"), big.astype("<u4"), c[big].astype("<u8")]


def counts_at(packed: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    out = packed[0][at].astype(np.int64)
    if len(packed[1]):
        big = np.flatnonzero(out == 255)
        out[big] = packed[2][np.searchsorted(packed[1], at[big])]
    return out


#: Totals up to which one byte tells how many counts make them up.
SMALL = 5


def pack_stats(parts: list[np.ndarray]) -> list[np.ndarray]:
    """total, and how many counts are 1, 2 and more: a byte where the total is small (the last number then follows), else beside."""
    total, n1, n2, _ = parts
    big = np.flatnonzero(total > SMALL)
    code = np.where(total > SMALL, 255, total * 36 + n1 * 6 + n2).astype("<u1")
    return [code, big.astype("<u4"), *(x for p in parts for x in pack_counts(p[big]))]


def stats_at(packed: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    code = packed[0][at].astype(np.int64)
    total, n1, n2 = code // 36, code // 6 % 6, code % 6
    out = np.stack([total, n1, n2, (total > n1 + 2 * n2).astype(np.int64)])
    if len(big := np.flatnonzero(code == 255)):
        place = np.searchsorted(packed[1], at[big])
        for x, k in zip(out, range(2, 14, 3)):
            x[big] = counts_at(packed[k : k + 3], place)
    return out


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def swell(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def pack_keys(sorted_hashes: np.ndarray) -> list[np.ndarray]:
    """48 bits of each sorted hash: where each value of the first 16 begins, and the other 32."""
    key = sorted_hashes >> np.uint64(16)
    return [np.searchsorted(key >> np.uint64(32), np.arange(65537, dtype=np.uint64)).astype("<u4"), (key & np.uint64(0xFFFFFFFF)).astype("<u4")]


def find_keys(packed: list[np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of hashes and whether they are there."""
    first, low = packed
    if not len(low):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    key = hashes >> np.uint64(16)
    top, want = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype("<u4")
    lo, end = first[top].astype(np.int64), first[top + 1].astype(np.int64)
    hi = end.copy()
    while (go := lo < hi).any():
        mid = (lo + hi) >> 1
        less = go & (low[np.minimum(mid, len(low) - 1)] < want)
        lo, hi = np.where(less, mid + 1, lo), np.where(go & ~less, mid, hi)
    at = np.minimum(lo, len(low) - 1)
    return at, (lo < end) & (low[at] == want)


# ------------------------------------------------------------------ tokens and words


def token_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, an end after each row, and the n + 1 offsets of the rows."""
    n = len(off) - 1
    parts = [word_hashes(lower_ascii(raw[off[a] : off[b]]), off[a : b + 1] - off[a]) for a, b in steps(off)]
    words = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
    woff = np.r_[0, np.cumsum(np.concatenate([np.diff(w) for _, w in parts]))] if parts else np.zeros(1, np.int64)
    ends = woff[1:] + np.arange(n)
    out = np.empty(len(words) + n, np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = words
    out[ends] = END
    return out, woff + np.arange(n + 1)


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _class_of(count: np.ndarray) -> np.ndarray:
    """The power of two of each count."""
    return np.frexp(count.astype(np.float64))[1].astype(np.int64) - 1


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sums of their counts, and a place of each key."""
    if not len(keys):
        return keys, counts, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(counts[order], first), order[first]


def _blobs(table: pa.Table, name: str, dtype: str) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in table[name].to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


class Words:
    """The sorted word hashes of all ranges, with counts and numbers. base: the first number of each (range, class)."""

    def __init__(self, files: Files, base: np.ndarray, filled: np.ndarray):
        self.files, self.base, self.filled, self.ranges = files, base, filled, len(base)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of sorted hashes."""
        number, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        edge = np.searchsorted(_range_of(h, self.ranges), np.arange(self.ranges + 1))
        for k in np.flatnonzero((np.diff(edge) > 0) & self.filled).tolist():
            part = slice(edge[k], edge[k + 1])
            keys, place, *counts = self.files.get(f"word-{k}")
            at = np.minimum(np.searchsorted(keys, h[part]), len(keys) - 1)
            hit = keys[at] == h[part]
            c = counts_at(counts, at)
            number[part] = np.where(hit, self.base[k][_class_of(c)] + place[at], -1)
            count[part] = np.where(hit, c, 0)
        return number, count


def count_words(train: DataFrame, uri: str, ranges: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Writes the word files; returns how many words and how many tokens each (range, class) has, and the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for batch in batches:
            raw, off = column_bytes(batch.column(0))
            rows += batch.num_rows
            for a, b in steps(off, STEP):
                tokens, _ = token_hashes(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                h, c = np.unique(tokens, return_counts=True)
                edge = np.searchsorted(_range_of(h, ranges), np.arange(ranges + 1))
                some = np.flatnonzero(np.diff(edge)).tolist()
                cols = [[h[edge[k] : edge[k + 1]].tobytes() for k in some], [_narrow(c[edge[k] : edge[k + 1]], 4) for k in some]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in cols)], names=["bucket", "h", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([np.array([rows], "<u8").tobytes()], pa.binary())], names=["bucket", "h", "c"])

    def merge(table: pa.Table) -> pa.Table:
        k = table["bucket"][0].as_py()
        if k < 0:
            n = [int(_blobs(table, "c", "<u8").sum())] + [0] * (CLASSES - 1)
            return pa.table({"bucket": pa.array([k], pa.int32()), "words": pa.array([n], pa.list_(pa.int64())), "tokens": pa.array([n], pa.list_(pa.int64()))})
        h, c, _ = _summed(_blobs(table, "h", "<u8"), np.concatenate([_wide(x, 4) for x in table["c"].to_pylist()]).astype(np.int64))
        kind = _class_of(c)
        order = np.argsort(kind, kind="stable")
        place = np.empty(len(h), np.int64)
        place[order] = np.arange(len(h)) - np.searchsorted(kind[order], kind[order])
        put_arrays(uri, f"word-{k}", [h, place.astype("<u4"), *pack_counts(c)])
        words, tokens = np.bincount(kind, minlength=CLASSES), np.bincount(kind, c, CLASSES).astype(np.int64)
        return pa.table({"bucket": pa.array([k], pa.int32()), "words": pa.array([words.tolist()], pa.list_(pa.int64())), "tokens": pa.array([tokens.tolist()], pa.list_(pa.int64()))})

    rows = train.mapInArrow(count, "bucket int, h binary, c binary").groupBy("bucket").applyInArrow(merge, "bucket int, words array<long>, tokens array<long>").collect()  # at most WORD_RANGES + 1 rows
    words, tokens, texts = np.zeros((ranges, CLASSES), np.int64), np.zeros((ranges, CLASSES), np.int64), 0
    for r in rows:
        if r.bucket < 0:
            texts = r.words[0]
        else:
            words[r.bucket], tokens[r.bucket] = r.words, r.tokens
    return words, tokens, texts


class Deal:
    """Which task has which n-gram.

    Numbers below `hot` belong to words of LIMIT tokens or more.  Plain tasks hold ranges of middle words; each hot one has
    shards, and so has the start mark, whose number is the last.
    """

    def __init__(self, words: np.ndarray, tokens: np.ndarray, texts: int, limit: int):
        n, t = words.sum(0)[::-1], tokens.sum(0)[::-1]  # classes by falling count
        self.total = int(n.sum())
        least = 1 << np.arange(CLASSES - 1)[::-1].astype(object)
        is_hot = np.array([False, *(x >= limit for x in least)])
        self.hot = int(n[is_hot].sum())
        shards = [1 + 2 * (1 << (CLASSES - 1 - k)) // limit for k in range(CLASSES)]
        per_word = np.repeat([s for s, h in zip(shards, is_hot) if h], n[is_hot]).astype(np.int64) if self.hot else np.zeros(0, np.int64)
        # ranges of the other words, of about `limit` tokens
        edges, held, number = [self.hot], 0.0, self.hot
        for size, count, h in zip(n.tolist(), t.tolist(), is_hot.tolist()):
            if h or not size:
                continue
            each, left = count / size, size
            while left:
                take = min(left, max(1, int((limit - held) // each)))
                number, left, held = number + take, left - take, held + take * each
                if held + each > limit:
                    edges.append(number)
                    held = 0.0
        if edges[-1] != number:
            edges.append(number)
        self.edges = np.array(edges, np.int64)
        self.plain = len(edges) - 1
        self.start_shards = max(1, -(-texts // limit))
        self.shards = np.append(per_word, self.start_shards)
        self.first = self.plain + np.r_[0, np.cumsum(self.shards)]  # the first task of each hot word, the start mark last
        self.tasks = int(self.first[-1])

    def place(self, v: np.ndarray) -> np.ndarray:
        """The place among the hot words, -1 for others."""
        return np.where(v < self.hot, v, np.where(v == self.total, self.hot, -1))

    def middle(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The task of trigrams."""
        h = self.place(v)
        out = np.searchsorted(self.edges, v, "right") - 1
        x = np.flatnonzero(h >= 0)
        key = mix(u[x].astype(np.uint64) * _A + np.where(self.place(u[x]) >= 0, w[x] + 1, 0).astype(np.uint64))
        out[x] = self.first[h[x]] + (key % self.shards[h[x]].astype(np.uint64)).astype(np.int64)
        return out

    def pair(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The task of the words before (v, w)."""
        h = self.place(v)
        out = np.searchsorted(self.edges, v, "right") - 1
        x = np.flatnonzero(h >= 0)
        out[x] = self.first[h[x]] + (mix(w[x].astype(np.uint64) * _B) % self.shards[h[x]].astype(np.uint64)).astype(np.int64)
        return out

    def split(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether a context is spread over shards."""
        return (self.place(u) >= 0) & (self.place(v) >= 0)

    def split_task(self, h2: np.ndarray) -> np.ndarray:
        return (mix(h2 ^ _C) % np.uint64(max(1, self.tasks - self.plain))).astype(np.int64)


def _h2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.astype(np.uint64) * _A + _C) + b.astype(np.uint64) * _B)


def _h3(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(_h2(u, v) * _B + w.astype(np.uint64) * _C + _A)


def _contexts(number: np.ndarray, toff: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers two places and one place before each token, start marks before the first of a row."""
    v, u = np.empty_like(number), np.empty_like(number)
    v[1:], u[2:] = number[:-1], number[:-2]
    first = toff[:-1]
    v[first] = u[first] = start
    second = first[np.diff(toff) > 1] + 1
    u[second] = start
    return u, v


# ------------------------------------------------------------------ counting


def _narrow(x: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, byte by byte, packed: frequent words have small numbers, so the high bytes are mostly 0."""
    return squeeze(np.ascontiguousarray(x.astype("<u4").view("u1").reshape(-1, 4)[:, :width].T).tobytes())


def _wide(raw: bytes, width: int) -> np.ndarray:
    part = np.frombuffer(swell(raw), "u1").reshape(width, -1)
    out = np.zeros((part.shape[1], 4), "u1")
    out[:, :width] = part.T
    return out.view("<u4").ravel()


def _stats(c: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    return np.array([(c == j).sum() for j in (1, 2, 3, 4)], "<i8")


def _grouped(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys with the total of the counts and how many are 1, 2 and more."""
    order = np.argsort(key, kind="stable")
    k, c = key[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], [np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64) for x in (c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64))]


SCHEMA = "kind int, task int, a binary, b binary"


def _row(kind: int, task: int, *blobs: np.ndarray) -> tuple:
    return kind, task, blobs[0].tobytes(), blobs[1].tobytes() if len(blobs) > 1 else b""


def _rows_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.table({"kind": pa.array(cols[0], pa.int32()), "task": pa.array(cols[1], pa.int32()), "a": pa.array(cols[2], pa.binary()), "b": pa.array(cols[3], pa.binary())})


#: Kinds of rows between the shuffles.
AFTER, BEFORE_PAIR, SPLIT, SEEN, MIDDLE, TRI, PAIR = range(7)


def _by_word(w: np.ndarray, n: np.ndarray, per: int, ranges: int) -> list[tuple]:
    """Sums by word, in rows by range of numbers."""
    w, n, _ = _summed(w, n)
    edge = np.searchsorted(w, np.arange(ranges + 1) * per)
    return [_row(AFTER, k, (w[edge[k] : edge[k + 1]] - k * per).astype("<u4"), n[edge[k] : edge[k + 1]].astype("<u8")) for k in np.flatnonzero(np.diff(edge)).tolist()]


def count_trigrams(train: DataFrame, uri: str, base: np.ndarray, filled: np.ndarray, deal: Deal, ranges: int) -> DataFrame:
    """Writes the arrays; returns rows of totals: kind (SEEN: task is the order; MIDDLE: task is the hot word's place; else a file's task) with numbers in a."""
    per = -(-(deal.total + 1) // ranges)
    width = 3 if deal.total + 1 < 1 << 24 else 4

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(Files(uri), base, filled)
        for batch in batches:
            raw, off = column_bytes(batch.column(0))
            for a, b in steps(off, STEP):
                tokens, toff = token_hashes(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                h, index = np.unique(tokens, return_inverse=True)
                w = words.find(h)[0][index]
                u, v = _contexts(w, toff, deal.total)
                _, c, at = _summed(_h3(u, v, w), np.ones(len(w), np.int64))
                u, v, w = u[at], v[at], w[at]
                task = deal.middle(u, v, w)
                order = np.lexsort((v, task))
                u, v, w, c, task = u[order], v[order], w[order], c[order], task[order]
                edge = np.r_[np.flatnonzero(np.r_[True, task[1:] != task[:-1]]), len(task)] if len(task) else np.zeros(1, np.int64)
                out: list[list] = [[], [], [], [], [], []]
                for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    first = np.r_[0, np.flatnonzero(np.diff(v[s:e])) + 1]
                    cols = (_narrow(u[s:e], width), _narrow(w[s:e], width), c[s:e].astype("<u4"), v[s:e][first].astype("<u4"), np.diff(np.r_[first, e - s]).astype("<u4"))
                    for x, y in zip(out, (int(task[s]), cols[0], cols[1], _narrow(cols[2], 4), _narrow(cols[3], 4), _narrow(cols[4], 4))):
                        x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["task", "u", "w", "c", "v", "runs"])

    def merge(table: pa.Table) -> pa.Table:
        task = table["task"][0].as_py()
        rows = [[_wide(x, width) for x in table[n].to_pylist()] for n in ("u", "w")] + [[_wide(x, 4) for x in table[n].to_pylist()] for n in ("c", "v", "runs")]
        u, w, c = (np.concatenate(x).astype(np.int64) for x in rows[:3])
        v = np.concatenate([np.repeat(x, n) for x, n in zip(rows[3], rows[4])]).astype(np.int64)
        key, c, at = _summed(_h3(u, v, w), c)
        u, v, w = u[at], v[at], w[at]
        out = [_row(SEEN, 3, _stats(c)), _row(TRI, task, np.zeros(0))]
        whole = ~deal.split(u, v)
        contexts, sums = _grouped(_h2(u, v)[whole], c[whole])
        arrays = [*pack_keys(key), *pack_counts(c), *pack_keys(contexts), *pack_stats(sums)]
        if not whole.all():
            h = _h2(u, v)[~whole]
            split, parts = _grouped(h, c[~whole])
            where = deal.split_task(split)
            for k in np.unique(where).tolist():
                some = where == k
                out.append(_row(SPLIT, k, split[some], np.stack([p[some] for p in parts]).astype("<i8")))
        if task < deal.plain:
            pairs, n, at = _summed(_h2(v, w), np.ones(len(v), np.int64))
            v, w = v[at], w[at]
            low, size = int(deal.edges[task]), int(deal.edges[task + 1] - deal.edges[task])
            middle = [np.bincount(v - low, n, size), *(np.bincount((v - low)[hit], minlength=size) for hit in (n == 1, n == 2, n > 2))]
            arrays += [*pack_keys(pairs), *pack_counts(n), *pack_stats([m.astype(np.int64) for m in middle])]
            out += [_row(SEEN, 2, _stats(n)), *_by_word(w, np.ones(len(w), np.int64), per, ranges)]
        else:
            pairs, n, at = _summed(_h2(v, w), np.ones(len(v), np.int64))
            where = deal.pair(v[at], w[at])
            for k in np.unique(where).tolist():
                some = where == k
                out.append(_row(BEFORE_PAIR, k, w[at][some].astype("<u4"), n[some].astype("<u8")))
        put_arrays(uri, f"tri-{task}", arrays)
        return _rows_table(out)

    def shared(table: pa.Table) -> pa.Table:
        """What shards share: the words before (v, w) of a hot v, and the totals of split contexts."""
        kind, task = table["kind"][0].as_py(), table["task"][0].as_py()
        if kind == SPLIT:
            key = _blobs(table, "a", "<u8")
            parts = np.concatenate([np.frombuffer(x, "<i8").reshape(4, -1) for x in table["b"].to_pylist()], axis=1)
            order = np.argsort(key, kind="stable")
            k = key[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            put_arrays(uri, f"split-{task}", [*pack_keys(k[first]), *pack_stats([np.add.reduceat(p[order], first) for p in parts])])
            return _rows_table([_row(SPLIT, task, np.zeros(0))])
        place = int(np.searchsorted(deal.first, task, "right") - 1)
        v = deal.total if place == deal.hot else place
        w, n, _ = _summed(_blobs(table, "a", "<u4").astype(np.int64), _blobs(table, "b", "<u8").astype(np.int64))
        h = _h2(np.full(len(w), v), w)
        order = np.argsort(h)
        put_arrays(uri, f"pair-{task}", [*pack_keys(h[order]), *pack_counts(n[order])])
        middle = np.array([n.sum(), (n == 1).sum(), (n == 2).sum(), (n > 2).sum()], "<i8")
        return _rows_table([_row(MIDDLE, place, middle), _row(PAIR, task, np.zeros(0)), _row(SEEN, 2, _stats(n)), *_by_word(w, np.ones(len(w), np.int64), per, ranges)])

    def before(table: pa.Table) -> pa.Table:
        k = table["task"][0].as_py()
        n = np.bincount(_blobs(table, "a", "<u4").astype(np.int64), _blobs(table, "b", "<u8").astype(np.float64), per).astype(np.int64)
        put_arrays(uri, f"before-{k}", pack_counts(n))
        return _rows_table([_row(SEEN, 1, np.r_[_stats(n), (n > 2).sum(), n.sum()].astype("<i8")), _row(AFTER, k, np.zeros(0))])

    tri = stash(train.mapInArrow(count, "task int, u binary, w binary, c binary, v binary, runs binary").groupBy("task").applyInArrow(merge, SCHEMA), "trigrams")
    both = stash(tri.where(F.col("kind").isin(BEFORE_PAIR, SPLIT)).groupBy("kind", "task").applyInArrow(shared, SCHEMA), "shared")
    after = tri.where(F.col("kind") == AFTER).union(both.where(F.col("kind") == AFTER))
    last = after.groupBy("task").applyInArrow(before, SCHEMA)
    return tri.where(F.col("kind").isin(SEEN, TRI)).union(both.where(F.col("kind").isin(SEEN, MIDDLE, SPLIT, PAIR))).union(last)


def totals(rows: DataFrame) -> DataFrame:
    """kind, task and the sums of the numbers of all their rows: a few rows, and one for each hot word, split file and range."""

    def add(table: pa.Table) -> pa.Table:
        a = [np.frombuffer(x, "<i8") for x in table["a"].to_pylist()]
        return pa.table({"kind": table["kind"][:1], "task": table["task"][:1], "n": pa.array([sum(a).tolist()], pa.list_(pa.int64()))})

    return rows.groupBy("kind", "task").applyInArrow(add, "kind int, task int, n array<long>")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of Chen and Goodman; 0.5, 1 and 1.5 where the counts of counts don't tell."""
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return min(max(d1, 0.0), 1.0), min(max(d2, 0.0), 2.0), min(max(d3, 0.0), 3.0)


def _discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(n - np.select([n == 1, n == 2, n > 2], d, 0.0), 0)


def _left(parts: list[np.ndarray], d: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """The total (1 where there is none) and the share that the discounts leave to the lower order (all where there is none)."""
    total, n1, n2, n3 = parts
    safe = np.where(total > 0, total, 1)
    return safe, np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / safe, 1.0)


def _tasks(task: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every task with the places that belong to it."""
    order = np.argsort(task, kind="stable")
    edge = np.r_[np.flatnonzero(np.r_[True, np.diff(task[order]) != 0]), len(order)] if len(order) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(task[order[a]]), order[a:b]


class Model:
    """What a worker needs to score: mapped arrays and the few totals."""

    def __init__(self, uri: str, base: np.ndarray, filled: np.ndarray, deal: Deal, ranges: int, train: int, d: list[tuple], left: float, pairs: int, middle: dict[int, list[int]], splits: list[int], befores: list[int], tri: list[int], shared: list[int]):
        self.files = Files(uri)
        self.words, self.deal, self.train = Words(self.files, base, filled), deal, train
        self.per, self.d, self.left, self.pairs = -(-(deal.total + 1) // ranges), d, left, pairs
        self.middle = np.zeros((4, deal.hot + 1), np.int64)
        for k, n in middle.items():
            self.middle[:, k] = n
        # files that exist; an n-gram of any other task was never seen
        self.splits, self.befores, self.tri, self.shared = set(splits), set(befores), set(tri), set(shared)

    def unigram(self, number: np.ndarray) -> np.ndarray:
        """p(w) of distinct numbers, -1 for unknown."""
        out = np.full(len(number), self.left / (self.deal.total + 1))
        known = np.flatnonzero(number >= 0)
        if self.pairs:
            for k, some in _tasks(number[known] // self.per):
                if k in self.befores:
                    at = known[some]
                    out[at] += _discounted(counts_at(self.files.get(f"before-{k}"), number[at] - k * self.per), self.d[0]) / self.pairs
        return out

    def bigram(self, v: np.ndarray, w: np.ndarray, low: np.ndarray) -> np.ndarray:
        """p(w | v) of distinct pairs; low: p(w)."""
        c, parts = np.zeros(len(v), np.int64), np.zeros((4, len(v)), np.int64)
        known = np.flatnonzero(v >= 0)
        hot = self.deal.place(v[known])
        parts[:, known[hot >= 0]] = self.middle[:, hot[hot >= 0]]
        for task, some in _tasks(self.deal.pair(v[known], w[known])):
            at = known[some]
            if task < self.deal.plain:
                if task not in self.tri:
                    continue
                arrays = self.files.get(f"tri-{task}")
                keys, counts = arrays[21:23], arrays[23:26]
                parts[:, at] = stats_at(arrays[26:40], v[at] - int(self.deal.edges[task]))
            elif task in self.shared:
                arrays = self.files.get(f"pair-{task}")
                keys, counts = arrays[:2], arrays[2:5]
            else:
                continue
            place, hit = find_keys(keys, _h2(v[at], w[at]))
            hit &= w[at] >= 0
            c[at[hit]] = counts_at(counts, place[hit])
        total, left = _left(list(parts), self.d[1])
        return _discounted(c, self.d[1]) / total + left * low

    def trigram(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, low: np.ndarray) -> np.ndarray:
        """p(w | u v) of distinct trigrams; low: p(w | v)."""
        c, parts = np.zeros(len(v), np.int64), np.zeros((4, len(v)), np.int64)
        known = np.flatnonzero((u >= 0) & (v >= 0))
        split = self.deal.split(u[known], v[known])
        for task, some in _tasks(self.deal.middle(u[known], v[known], w[known])):
            if task not in self.tri:
                continue
            at = known[some]
            arrays = self.files.get(f"tri-{task}")
            place, hit = find_keys(arrays[:2], _h3(u[at], v[at], w[at]))
            hit &= w[at] >= 0
            c[at[hit]] = counts_at(arrays[2:5], place[hit])
            at = at[~split[some]]
            place, hit = find_keys(arrays[5:7], _h2(u[at], v[at]))
            parts[:, at[hit]] = stats_at(arrays[7:21], place[hit])
        spread = known[split]
        h = _h2(u[spread], v[spread])
        for task, some in _tasks(self.deal.split_task(h)):
            if task in self.splits:
                arrays = self.files.get(f"split-{task}")
                place, hit = find_keys(arrays[:2], h[some])
                parts[:, spread[some[hit]]] = stats_at(arrays[2:16], place[hit])
        total, left = _left(list(parts), self.d[2])
        return _discounted(c, self.d[2]) / total + left * low

    def score(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of every row."""
        tokens, toff = token_hashes(raw, off)
        h, index = np.unique(tokens, return_inverse=True)
        number, count = self.words.find(h)
        base = np.log10((count + 0.1) / (self.train + 0.1 * (self.deal.total + 1)))
        ranked, inverse = np.unique(number, return_inverse=True)
        one = self.unigram(ranked)[inverse]
        w = number[index]
        u, v = _contexts(w, toff, self.deal.total)
        # each distinct trigram, and each distinct pair, is looked up once; unknown words are -1 and alike
        _, at, back = np.unique(_h3(u + 1, v + 1, w + 1), return_index=True, return_inverse=True)
        u, v, w, low = u[at], v[at], w[at], one[index[at]]
        _, at, two = np.unique(_h2(v + 1, w + 1), return_index=True, return_inverse=True)
        p = self.trigram(u, v, w, self.bigram(v[at], w[at], low[at])[two])[back]
        rows = toff[:-1]
        return np.diff(toff), np.add.reduceat((count > 0)[index].astype(np.int64), rows), np.add.reduceat(base[index], rows), np.add.reduceat(np.log10(p), rows)


def fit(train: DataFrame, uri: str, limit: int = LIMIT) -> dict:
    """Counts the one text column of train and writes the arrays; returns the arguments of Model."""
    text_bytes = train.agg(F.sum(F.octet_length(train.columns[0]).cast("long"))).first()[0] or 0
    ranges = min(WORD_RANGES, max(4, -(-int(text_bytes) // (8 << 20))))
    words, tokens, texts = count_words(train, uri, ranges)
    if words.sum() >= (1 << 32) - 1:
        raise ValueError("2^32 - 1 distinct words or more: numbers have 32 bits")
    deal = Deal(words, tokens, texts, limit)
    # numbers run by falling class, then range
    sizes = words[:, ::-1].T
    base = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(sizes.shape).T[:, ::-1].copy()
    out = {"uri": uri, "base": base, "filled": words.sum(1) > 0, "deal": deal, "ranges": ranges, "train": int(tokens.sum())}
    rows = totals(count_trigrams(train, uri, base, out["filled"], deal, ranges)).collect() if texts else []  # a row for each hot word and file
    seen = {r.task: r.n for r in rows if r.kind == SEEN}
    d = [discounts(*seen.get(k, [0] * 4)[:4]) for k in (1, 2, 3)]
    n1, n2, _, _, more, pairs = seen.get(1, [0] * 6)
    left = (d[0][0] * n1 + d[0][1] * n2 + d[0][2] * more) / pairs if pairs else 1.0
    middle = {r.task: r.n for r in rows if r.kind == MIDDLE}
    files = {n: [r.task for r in rows if r.kind == k] for n, k in (("splits", SPLIT), ("befores", AFTER), ("tri", TRI), ("shared", PAIR))}
    return out | files | {"d": d, "left": left, "pairs": pairs, "middle": middle}


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, limit: int = LIMIT) -> DataFrame:
    """Learns from the rows whose crc32(id) mod folds isn't 0 and scores every row."""
    uri = work_path(docs.sparkSession, "kneser-ney")
    left = F.crc32(docs[id_col].cast("long").cast("string").cast("binary")) % folds == 0
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.coalesce(left, F.lit(True)).alias("held_out"))
    arguments = fit(rows.where("not held_out").select("text"), uri, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**arguments)
        for batch in batches:
            raw, off = column_bytes(batch.column(1))
            parts = [model.score(raw[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in steps(off, SCORE_STEP)]
            if not parts:
                continue
            n, known, base, score = (np.concatenate(x) for x in zip(*parts))
            cols = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.train), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
