"""Cases that once gave wrong results or took too much: words that hash alike, rows and items without an id, very long texts, arrays beside a batch."""

import hashlib
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from fixtures import table

from tessera.llm import decontaminate as D
from tessera.llm import language_model as LM
from tessera.llm import minhash as MH
from tessera.llm import packing, suffix_dedup
from tessera.llm.common import column_bytes, span_hashes, word_hashes
from tessera.llm.queries import tokenizer_path


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096, 1 << 16])
def test_words_that_a_polynomial_confuses(n):
    a = thue_morse(n)
    data = [a.encode(), a.translate(str.maketrans("ab", "ba")).encode(), a.encode()]
    h, _ = word_hashes(np.frombuffer(b" ".join(data), np.uint8), np.array([0, n * 3 + 2]))
    assert h[0] != h[1] and h[0] == h[2]


def test_span_hashes_tell_spans_apart():
    r = np.random.default_rng(3)
    words = sorted({bytes(r.integers(97, 100, r.integers(0, 30)).astype(np.uint8)) for _ in range(4000)} | {b"a\0", b"a", b"\0", b"", b"\0\0", b"abcdefgh", b"abcdefgh\0", b"abcdefghabcdefgh"})
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    h = span_hashes(raw, ends - [len(w) for w in words], ends)
    assert len(set(h.tolist())) == len(words)
    moved = np.frombuffer(b"xyz" + b"".join(words) + b"q", np.uint8)
    assert np.array_equal(span_hashes(moved, ends - [len(w) for w in words] + 3, ends + 3), h)
    assert len(span_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_documents_of_one_long_word(spark):
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    near = {r.doc_id: (r.component_id, r.kept) for r in MH.near_duplicates(table(spark, [(1, a), (2, b)]), size=4, percent=80).collect()}
    assert near == {1: (1, True), 2: (2, True)}
    known = {r.doc_id: (r.held_out, r.n_known) for r in LM.score_texts(table(spark, [(1, a), (7, b)])).collect()}
    # whichever is held out knows the end only
    assert all(n == (1 if out else 2) for out, n in known.values())


def test_rows_and_items_without_an_id(spark):
    item = "the quick brown fox jumps over the lazy dog near the river"
    other = "a second item that has no id but must be found all the same"
    bench = spark.createDataFrame([(1, item), (None, other)], "item_id long, text string")
    rows = table(spark, [(None, f"before {item} after"), (None, "clean words only here"), (3, f"before {other} after"), (4, "clean"), (4, f"{item}")])
    found = {(r.doc_id, r.item_id) for r in D.contamination(rows, bench).collect()}
    assert found == {(None, 1), (3, None), (4, 1)}
    kept = D.decontaminate(rows, bench)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id is None, r.text) for r in kept.collect()) == [(False, "clean"), (True, "clean words only here")]


def test_texts_over_a_megabyte(spark):
    r = np.random.default_rng(1)
    words = [f"w{k}" for k in r.integers(0, 50000, 250_000)]
    text = " ".join(words)
    assert len(text) > 1 << 20
    near = " ".join([*words[:1000], "changed", *words[1001:]])
    got = {x.doc_id: x.component_id for x in MH.near_duplicates(table(spark, [(5, text), (9, near), (11, "other words are here now")]), size=4, percent=80).collect()}
    assert got == {5: 5, 9: 5, 11: 11}
    scored = {x.doc_id: x.n_tokens for x in LM.score_texts(table(spark, [(5, text), (11, "other words")])).collect()}
    assert scored == {5: 250_001, 11: 3}
    item = " ".join(words[100_000:100_030])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [x.doc_id for x in D.contamination(table(spark, [(5, text), (6, "no")]), bench).collect()] == [5]
    raw, off = column_bytes(__import__("pyarrow").array([text]))
    assert len(word_hashes(raw, off)[0]) == 250_000


def peak_mb(run) -> float:
    """MB that run has allocated at once in Python, NumPy's arrays included."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_workers_beside_their_texts(monkeypatch):
    """The arrays of packing and suffix dedup are those of a step, whatever the size of a batch or bucket."""
    task = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(packing, "TaskContext", task)
    monkeypatch.setattr(suffix_dedup, "TaskContext", task)
    texts = [b"".join(b"%x " % (x * 2654435761 % 65536) for x in range(k, k + 500)) for k in range(3000)]  # 7 MB, 65,536 words at most
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    runs = []
    frame = SimpleNamespace(select=lambda *_: frame, mapInArrow=lambda f, _: runs.append(f), cast=lambda _: frame, alias=lambda _: frame)
    packing.pack_documents(type("Docs", (), {"__getitem__": lambda *_: frame, "select": frame.select})(), tokenizer_path())
    packed = []
    assert peak_mb(lambda: packed.extend(runs[0](iter([batch])))) < 60
    assert sum(pc.sum(x["length"]).as_py() for x in packed) == sum(pc.sum(pc.if_else(pc.equal(x["start"], 0), x["doc_tokens"], 0)).as_py() for x in packed)

    strings = [hashlib.sha512(b"%d" % (k // 2)).hexdigest()[:79].encode() + b"xy"[k % 2 :][:1] for k in range(80_000)]  # two of each key, 79 bytes in common
    n = len(strings)
    bucket = pa.table({
        "bucket": pa.array(np.zeros(n, np.int32)), "key": pa.array(np.arange(n) // 2), "doc_id": pa.array(np.arange(n)),
        "places": pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), pa.array(np.zeros(n, np.int64))),
        "text": pa.array(strings, pa.binary()), "b": pa.nulls(n, pa.int64()),
    })
    got = []
    assert peak_mb(lambda: got.append(suffix_dedup._ranges(50, 20)(bucket))) < 200
    lost = got[0].to_pydict()
    assert set(lost["a"]) == {0} and set(lost["b"]) == {79} and {x % 2 for x in lost["doc_id"]} == {1}
    assert len(set(lost["doc_id"])) == len(lost["doc_id"]) > 0.9 * n / 2  # in the others the gram of the smallest hash holds the byte that differs
