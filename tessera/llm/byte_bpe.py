"""Byte-level BPE: every distinct word of the corpus is encoded once, texts are put together again by position.

Texts are cut into pre-tokens.  A block of some megabytes of text keeps its distinct pre-tokens, dealt into buckets by
hash, and the places of all occurrences in order.  One shuffle brings the words of all blocks together by bucket; there
each distinct word is encoded once and its ids are joined back to the blocks that have it.  A second shuffle brings the
ids of a block's words to its places.  Decoding joins the table of token bytes: the distinct tokens of some documents
and then the documents go through a broadcast join in order, so nothing is shuffled.

A bucket has one row for each block, and rows are streamed; a task holds the distinct words of one bucket.

Defined results: a null text counts as empty and has no ids; a null id is kept; repeated rows are encoded as often as
they come; bytes that aren't UTF-8 read as U+FFFD; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import STEP_BYTES, column_bytes, span_hashes, stash_by, steps
from tessera.llm.packing import Encoder

#: A block ends with the step of text in which it gets so many distinct pre-tokens or bytes.
BLOCK_WORDS, BLOCK_BYTES = 1 << 18, 32 << 20
#: Parts of the words by hash, and the distinct words of a part that a task remembers; beyond it starts to forget.
BUCKETS, REMEMBER = 2048, 2_000_000
#: Words whose ids are packed by block before the second shuffle.
PACK = 1 << 18
#: Largest vocabulary, which every executor holds.
MOST_TOKENS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ids of the tokens of a vocabulary file (base64 and rank on every line)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    if len(ranks) > MOST_TOKENS:
        raise ValueError(f"more than {MOST_TOKENS} tokens")
    return ranks


def token_bytes(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """The token-byte table: token, bytes."""
    return spark.createDataFrame([(v, bytearray(k)) for k, v in ranks.items()], "token int, bytes binary").coalesce(1)


# ---------------------------------------------------------------- pre-tokens


class Splitter:
    """The matches of the pattern, with the character classes of the library that encodes.

    The two regex engines know different versions of Unicode.  A character is looked up in the other engine once: it
    is in the class of a letter (or a digit) if both together are one match.  Where the engines differ, a character
    of the right class stands in for it while the text is split.
    """

    #: prefix, and a character of the same class; what is in neither class is like the last
    PROBES = (("a", "a"), ("1", "1"))
    OTHER = "†"

    def __init__(self, pattern: str):
        import regex

        self.pattern = pattern
        self.find = regex.compile(pattern)
        self.safe: set[str] = set()
        self.stand_in: dict[int, str] = {}

    def _pieces(self, text: str) -> int:
        return sum(1 for _ in self.find.finditer(text))

    def learn(self, chars: set[str]) -> None:
        import tiktoken

        new = sorted(chars - self.safe)
        if not new:
            return
        kind = {}
        for prefix, same in self.PROBES:
            texts = [(prefix + c).encode() for c in new]
            ranks = {bytes([k]): k for k in range(256)}
            for t in texts:
                for k in range(2, len(t) + 1):
                    ranks.setdefault(t[:k], len(ranks))
            probe = tiktoken.Encoding("probe", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            for c in new:
                one = len(probe.encode_ordinary(prefix + c)) == 1
                if one != (self._pieces(prefix + c) == 1):
                    kind[c] = same if one else kind.get(c, self.OTHER)
        self.stand_in.update({ord(c): s for c, s in kind.items()})
        self.safe |= chars

    def split(self, chunks: list[bytes]) -> list[list[bytes]]:
        """The pieces of every chunk."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        wide = [t for t in texts if not t.isascii()]
        if wide:
            self.learn({c for c in set().union(*wide) if c > "\x7f"})
        out = []
        for t in texts:
            if self.stand_in and not t.isascii() and (other := t.translate(self.stand_in)) != t:
                out.append([t[m.start() : m.end()].encode() for m in self.find.finditer(other)])
            else:
                out.append([p.encode() for p in self.find.findall(t)])
        return out


def squeeze(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, compressed: all low bytes, then all bytes above them, as far as there are any."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    used = int(np.flatnonzero(planes.any(axis=1)).max(initial=-1)) + 1
    return len(x).to_bytes(8, "little") + bytes([used]) + pa.Codec("zstd", compression_level=3).compress(planes[:used].tobytes(), asbytes=True)


def expand(data: bytes) -> np.ndarray:
    n, used = int.from_bytes(data[:8], "little"), data[8]
    planes = np.zeros((n, 4), np.uint8)
    if n * used:
        planes[:, :used] = np.frombuffer(pa.decompress(data[9:], n * used, "zstd", asbytes=True), np.uint8).reshape(used, n).T
    return planes.view("<u4").ravel()


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of every range, one after the other."""
    stop = np.cumsum(size)
    out = np.repeat(start - stop + size, size)
    out += np.arange(len(out))
    return out


def _positions(raw: np.ndarray, off: np.ndarray, splitter: Splitter, places: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The place of every pre-token of some texts, and how many each text has; places learns the new ones."""
    begin = Encoder.cuts(raw, off)
    spans = pa.py_buffer(np.append(begin, len(raw)).astype(np.int64))
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, spans, pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    pieces = splitter.split(found.dictionary.to_pylist())
    pool = np.array([places.setdefault(p, len(places)) for chunk in pieces for p in chunk], np.int64)
    size = np.array([len(chunk) for chunk in pieces], np.int64)
    codes = found.indices.to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(size[codes]))[np.searchsorted(begin, off)]
    return pool[_gather((np.cumsum(size) - size)[codes], size[codes])], np.diff(ends)


_BLOCKS = "block long, bucket int, numbers binary, letters binary, doc_ids array<long>, sizes binary, places binary"


def word_blocks(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text", words: int = BLOCK_WORDS, size: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents: rows with the distinct pre-tokens of a bucket (lengths and steps between their places; letters), and rows with documents, their lengths and all places."""
    names = [x.split()[0] for x in _BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(pattern)
        block, done, known = TaskContext.get().partitionId() << 32, 0, {}
        held: list[tuple] = []  # documents of the open block: ids, numbers of words, places

        def rows(n: int, **columns) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            columns["block"] = np.full(n, block)
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)

        def close() -> Iterator[pa.RecordBatch]:
            """The open block, with places by falling frequency: small numbers compress best."""
            nonlocal block, done, known, held
            counts = np.zeros(len(known), np.int64)
            for _, _, places in held:
                counts += np.bincount(places, minlength=len(known))
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            for ids, sizes, places in held:
                yield rows(1, doc_ids=[ids], sizes=[squeeze(sizes)], places=[squeeze(rank[places])])
            words = list(known)
            words = [words[k] for k in order.tolist()]
            size = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(size)
            bucket = (span_hashes(np.frombuffer(b"".join(words), np.uint8), end - size, end) % np.uint64(BUCKETS)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            at = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order)).tolist()
            parts = [order[i:j] for i, j in zip(at, at[1:])]
            numbers = [squeeze(np.append(size[p], np.diff(p, prepend=0))) for p in parts]
            letters = [pa.compress(b"".join([words[k] for k in p.tolist()]), "zstd", asbytes=True) for p in parts]
            yield rows(len(parts), bucket=bucket[[p[0] for p in parts]] if parts else [], numbers=numbers, letters=letters)
            block, done, known, held = block + 1, 0, {}, []

        for batch in batches:
            raw, off = column_bytes(batch.column(1))
            for a, b in steps(off):
                places, sizes = _positions(raw[off[a] : off[b]], off[a : b + 1] - off[a], splitter, known)
                held.append((batch.column(0)[a:b].to_pylist(), sizes, places.astype(np.uint32)))
                done += int(off[b] - off[a])
                if len(known) >= words or done >= size:
                    yield from close()
        yield from close()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, _BLOCKS)


# ---------------------------------------------------------------- encoding


_encodings: dict[tuple, object] = {}


def _encoding(ranks: Broadcast, pattern: str, mark: str):
    """One for each worker process; mark is a digest of the vocabulary."""
    key = (mark, pattern)
    if key not in _encodings:
        import tiktoken

        _encodings.clear()
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
    return _encodings[key]


_PACKED = "block long, places binary, sizes binary, ids binary"


def encode_words(words: DataFrame, ranks: dict[bytes, int], pattern: str, pack: int = PACK, remember: int = REMEMBER) -> DataFrame:
    """The ids of the words of every block, packed; each distinct word is encoded once, in the task that has its bucket."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)
    mark = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()

    def packed(waiting: list[tuple]) -> pa.RecordBatch:
        """A row for each block: steps between places, numbers of ids, ids."""
        block, place, size, pool = (np.concatenate(x) for x in zip(*waiting))
        order = np.lexsort((place, block))
        start = (np.cumsum(size) - size)[order]
        block, place, size = block[order], place[order], size[order]
        at = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block)).tolist()
        out = [(int(block[i]), squeeze(np.diff(place[i:j], prepend=0)), squeeze(size[i:j]), squeeze(pool[_gather(start[i:j], size[i:j])])) for i, j in zip(at, at[1:])]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["block", "places", "sizes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared, pattern, mark)._encode_single_piece
        bucket, known = None, {}  # word -> ids
        waiting, rows = [], 0
        for batch in batches:
            for b, block, numbers, letters in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket or len(known) > remember:
                    bucket, known = b, {}
                both = expand(numbers).astype(np.int64)
                n = len(both) // 2
                ends = [0, *np.cumsum(both[:n]).tolist()]
                text = pa.decompress(letters, ends[-1], "zstd", asbytes=True)
                found = [text[i:j] for i, j in zip(ends, ends[1:])]
                ids = list(map(known.get, found))
                for k, x in enumerate(ids):
                    if x is None:
                        ids[k] = known[found[k]] = np.array(encode(found[k]), "<u4").tobytes()
                size = np.fromiter(map(len, ids), np.int64, n) // 4
                waiting.append((np.full(n, block), np.cumsum(both[n:]), size, np.frombuffer(b"".join(ids), "<u4")))
                rows += n
                if rows >= pack:
                    yield packed(waiting)
                    waiting, rows = [], 0
        if rows:
            yield packed(waiting)

    dealt = words.select("bucket", "block", "numbers", "letters").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, _PACKED)


def _assemble(docs: pa.Table, words: pa.Table) -> pa.Table:
    """doc_id and ids of the documents of one block."""
    place, size, pool = ([expand(x) for x in words[c].to_pylist()] for c in ("places", "sizes", "ids"))
    place = np.concatenate([np.cumsum(x.astype(np.int64)) for x in place] or [np.zeros(0, np.int64)])
    size, pool = (np.concatenate([*x, np.zeros(0, np.uint32)]) for x in (size, pool))
    sizes, starts = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    sizes[place], starts[place] = size, np.cumsum(size, dtype=np.int64) - size
    out = []
    for ids, lengths, places in zip(docs["doc_ids"].combine_chunks(), docs["sizes"].to_pylist(), docs["places"].to_pylist()):
        at = expand(places)
        stop = np.append(0, np.cumsum(sizes[at]))[np.append(0, np.cumsum(expand(lengths), dtype=np.int64))]
        data = pa.py_buffer(pool[_gather(starts[at], sizes[at])])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stop) - 1, [None, pa.py_buffer(4 * stop), data])
        out.append(pa.table([ids.values, coded.cast(pa.binary())], names=["doc_id", "ids"]))
    return pa.concat_tables(out)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", pack: int = PACK, **limits: int) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every text, without special tokens."""
    blocks = stash_by(word_blocks(docs, pattern, id_col, text_col, **limits), "blocks", "block")
    found = encode_words(blocks.where("bucket is not null"), ranks, pattern, pack).withColumnRenamed("block", "of")
    held = blocks.where("bucket is null").select("block", "doc_ids", "sizes", "places")
    return held.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_assemble, "doc_id long, ids binary")


# ---------------------------------------------------------------- decoding


def decode(encoded: DataFrame, tokens: DataFrame, keep: list[str] | None = None, size: int = STEP_BYTES) -> DataFrame:
    """The columns of keep (all but ids if none are named) and `decoded`, the bytes that the ids stand for.

    tokens is the token-byte table.  Null ids count as none; an id that the table lacks is an error.
    """
    if tokens.count() > MOST_TOKENS:
        raise ValueError(f"more than {MOST_TOKENS} tokens")
    keep = [c for c in encoded.columns if c != "ids"] if keep is None else keep
    kept = [f"k{i}" for i in range(len(keep))]
    fields = [encoded.schema[c] for c in keep]
    columns = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(kept, fields))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = column_bytes(batch.column(len(kept)))
            for a, b in steps(off, size):
                ids = np.frombuffer(raw[off[a] : off[b]].tobytes(), "<u4")
                distinct, places = np.unique(ids, return_inverse=True)
                places = places.astype("<u4")
                n, m = len(distinct), b - a
                view = pa.LargeBinaryArray.from_buffers(pa.large_binary(), m, [None, pa.py_buffer(off[a : b + 1] - off[a]), pa.py_buffer(places)])
                step = pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.full(m, n, np.int32))])
                cols = [pa.concat_arrays([pa.nulls(n, batch.column(i).type), batch.column(i)[a:b]]) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(distinct.astype(np.int32)), pa.nulls(m, pa.int32())]), step, pa.concat_arrays([pa.nulls(n, pa.binary()), view.cast(pa.binary())]), *cols], names=["token", "distinct", "places", *kept])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[bytes] = []
        open_ = True  # tokens of a block are coming
        for batch in batches:
            distinct = batch.column(0)
            counts = distinct.to_numpy(zero_copy_only=False)
            at = np.flatnonzero(np.diff(np.append(-1, np.isnan(counts) if counts.dtype.kind == "f" else np.zeros(len(counts))).astype(np.int8)))
            for i, j in zip(at.tolist(), [*at[1:].tolist(), len(batch)]):
                part = batch.slice(i, j - i)
                if distinct[i].as_py() is None:
                    if not open_:
                        pieces, open_ = [], True
                    pieces += part.column(2).to_pylist()
                    continue
                if len(pieces) != distinct[i].as_py() and distinct[i].as_py():
                    raise ValueError("the tokens of a block aren't before its documents")
                if None in pieces:
                    raise ValueError("an id is not in the token-byte table")
                open_ = False
                out = [b"".join(map(pieces.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[3:], pa.array(out, pa.binary())], names=[*kept, "decoded"])

    asked = encoded.select(*[encoded[c].alias(n) for c, n in zip(keep, kept)], "ids").mapInArrow(ask, f"token int, distinct int, places binary{', ' * bool(kept)}{columns}")
    joined = asked.join(F.broadcast(tokens.select(F.col("token").alias("_token"), "bytes")), F.col("token") == F.col("_token"), "left")
    out = joined.select("distinct", "places", "bytes", *kept).mapInArrow(answer, f"{columns}{', ' * bool(kept)}decoded binary")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, kept)], "decoded")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes that they decode to."""
    coded = encode(docs, ranks, pattern)
    digests = coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    back = decode(digests, token_bytes(docs.sparkSession, ranks))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
