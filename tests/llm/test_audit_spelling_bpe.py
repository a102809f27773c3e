"""Filter audit, spelling variants and byte-level BPE against plain Python on small tables with nulls, copies and ties."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from fixtures import corpus, empty, table
from pyspark.sql import functions as F

from tessera.llm import byte_bpe as B
from tessera.llm import filter_audit as A
from tessera.llm import spelling as S

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, [*rows, (None, "no id " * 30)], repeat=rows[:2]).cache()


# ---------------------------------------------------------------- 11


def plain_audit(rows, labels):
    """rows: (doc_id, lang, text)."""
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = defaultdict(Counter)
    for i, lang, t in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i
        }
        for order in permutations("ABCDE"):
            gone = False
            for k, f in enumerate(order):
                c = out[lang or "", "".join(order), k + 1]
                c["kept"] += not gone and not fails[f]
                c["removed"] += not gone and fails[f]
                c["redundant"] += gone and fails[f]
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["good_lost"] += not gone and fails[f] and i in good
                c["toxic_lost"] += not gone and fails[f] and i in toxic
                gone |= fails[f]
    shapley = Counter()
    for (part, order, k), c in out.items():
        shapley[part, order[k - 1]] += c["removed"]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return {(p, o, k, *[c[n] for n in names], shapley[p, o[k - 1]]) for (p, o, k), c in out.items()}


def _audited(df):
    return [tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()]


@pytest.mark.parametrize("shuffled", [False, True])
def test_filter_audit(spark, rows, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(A, "BROADCAST_IDS", 0)
    r = random.Random(1)
    full = [(i, r.choice(["en", "de", None, ""]), t) for i, t in rows] + [(None, "en", "no id"), (None, "en", "no id"), (7, "en", "no id"), (8, "de", "no id"), (8, "de", "no id"), (9, "ABC", "LOUD # " * 50)]
    full += [(1000 + k, r.choice(["en", "de"]), "copied text") for k in range(300)] + [(None, None, "copied text")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i, _, _ in full if r.random() < 0.6] + [(8, 1, 0), (8, 0, 1), (None, 1, 1), (99999, 1, 1)]
    df = spark.createDataFrame([(*x, 1, "x", 2) for x in full], "doc_id long, lang string, text string, n long, part string, mask int").repartition(5)
    got = _audited(A.filter_audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert len(got) == len(set(got)) == 600 * len({x[1] or "" for x in full})
    assert set(got) == plain_audit(full, labels)


def test_filter_audit_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert A.filter_audit(none, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, lang string, text string")
    assert set(_audited(A.filter_audit(one, labels))) == plain_audit([(1, None, None)], [])


def test_audit_of_some_orders(spark):
    cells = spark.createDataFrame([("p", 1, 5), ("p", 3, 7), ("p", 0, 2)], "part string, mask int, n long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails) for r in A.audit(cells, "XY", {}, ["XY", "Y"]).collect()}
    assert got == {("XY", 1): (2, 12, 0, 5), ("XY", 2): (2, 0, 7, 0), ("Y", 1): (7, 7, 0, 0)}


def test_text_failures_by_steps():
    texts = ["", " ", "a", "x " * 99, "x " * 100, " ".join(f"w{k}" for k in range(100)), "ABCDEFGHIJ" + "é" * 90, "ABCDEFGHIJ" + "é" * 89, "a|b", "\x0b\x0c", " ".join(f"w{k % 80}" for k in range(100)), " ".join(f"w{k % 79}" for k in range(100))]
    data = [t.encode() for t in texts]
    got = A.text_failures(np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(x) for x in data])))
    want = []
    for t in texts:
        w = WORD.findall(t)
        tests = len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t))
        want.append(sum(f << k for k, f in enumerate(tests)))
    assert got.tolist() == want


# ---------------------------------------------------------------- 12


def plain_variants(rows, slip, least_chars, least, times=5):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least_chars:
                counts[w] += 1
    v = {w: n for w, n in counts.items() if n >= least}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, out = {}, {}
    for w, n in v.items():
        others = [(-v[x], x) for x in v if near(w, x)]
        best = min(others, default=None)
        form[w] = best[1] if best and -best[0] >= times * n else None
        out[w] = (n, len(others), form[w], v[form[w]] if form[w] else None)
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (*out[w], root)
    return out


def _variants(df):
    rows = df.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("small", [True, False])
def test_spelling_variants(spark, docs, rows, monkeypatch, small):
    """Chains, ties and doubled letters; then the same by a shuffled join."""
    if not small:
        monkeypatch.setattr(S, "BROADCAST_IDS", 0)
    more = [(2000, "abcdefgh " * 700 + "abcdefg " * 125 + "abcdeg " * 25 + "abceg " * 5), (2001, "aaaaaa " * 40 + "aaaaaaa " * 5 + "aaaaa " * 40 + "ÀÉÎÕÜÿ " * 30 + "ÀÉÎÕÜ÷ " * 6), (2002, "kolora kolorb kolorc " * 30 + "kolord " * 6), (None, "ABCDEFGH Xabcdefgh " * 3), (2003, "z" * 3000 + " ")]
    extra = spark.createDataFrame([(i, t, 1, "w") for i, t in more], "doc_id long, text string, n long, word string")
    df = docs.select("doc_id", "text", "n", F.lit("w").alias("word")).unionByName(extra)
    all_rows = [*rows, (None, "no id " * 30), *rows[:2], *more]
    assert _variants(S.spelling_variants(df, least_chars=4, least=3, slip=7)) == plain_variants(all_rows, 7, 4, 3)
    want = plain_variants(all_rows, 1 << 40, 4, 3)
    assert want["abceg"][2:] == ("abcdeg", 25, "abcdefgh")  # a chain
    assert want["kolord"][2] == "kolora"  # a tie
    assert _variants(S.spelling_variants(df, least_chars=4, least=3, slip=1 << 40)) == want
    if small:
        assert _variants(S.spelling_variants(df)) == plain_variants(all_rows, 199, 6, 5)


def test_spelling_of_nothing(spark):
    assert S.spelling_variants(empty(spark)).count() == 0
    assert S.spelling_variants(table(spark, [(1, None), (2, ""), (3, "1 2 3")])).count() == 0


def test_neighbourhoods_are_whole_and_distinct(spark):
    words = ["a", "aa", "bb", "abba", "éé", "aab", "bab", "abbaa"]
    alphabet = ["a", "b", "é"]
    rows = Counter((r.word, r._near) for r in S.neighbourhoods(spark.createDataFrame([(w,) for w in words], "word string"), alphabet).collect())
    assert set(rows.values()) == {1}
    lengths = Counter(map(len, words))
    for w in words:
        want = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in alphabet} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in alphabet}
        assert {x for v, x in rows if v == w} == {x for x in want - {w} if lengths[len(x)] - (len(x) == len(w)) > 0}


def test_very_long_words(spark):
    """Their neighbourhoods would be gigabytes; no other word has such a length, or one does."""
    long, other = "ab" * 10_000, "xy" * 600
    rows = [(k, f"{long} {other} {other[:700]}q{other[701:]} {other[:-1]}") for k in range(6)]
    got = _variants(S.spelling_variants(table(spark, rows), slip=1 << 40))
    assert got[long] == (6, 0, None, None, long) and got[other][1] == 2 and len(got) == 4


# ---------------------------------------------------------------- 13


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return B.read_ranks(public.path("byte_bpe_multi_50k.tiktoken")), public.PATTERN


HOSTILE = ["a  b", "a  b  　 c ", "x\x1c\x1dy\x85z", "!՘ a՘՘ 1\U00011de0", "don't DON'T we'll  'tis", " \n\n\t x", "\r\n", "a" * 5000, "1234567890" * 30, "***$$$", "́é ñ한국어 日本語", "퟿�", "é\x00à", "  ", "a  ", "\U00020000\U0001f600 \U0001f468‍\U0001f469"]


@pytest.mark.parametrize("small", [True, False])
def test_bpe_as_the_library(spark, docs, rows, vocabulary, small):
    import tiktoken

    ranks, pattern = vocabulary
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    all_rows = [*rows, (None, "no id " * 30), *rows[:2], *[(5000 + k, t) for k, t in enumerate(HOSTILE)]]
    hostile = spark.createDataFrame([(5000 + k, t) for k, t in enumerate(HOSTILE)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(hostile).withColumns({"ids": F.lit(1), "block": F.lit(2), "word": F.lit("x")})
    coded = B.encode(df, ranks, pattern, pack=4, words=3, size=64) if small else B.encode(df, ranks, pattern)
    got = Counter((r.doc_id, bytes(r.ids)) for r in coded.collect())
    want = Counter((i, np.array(plain.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in all_rows)
    assert got == want
    back = B.decode(coded, B.token_bytes(spark, ranks), size=64 if small else B.STEP_BYTES).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back) == Counter((i, (t or "").encode()) for i, t in all_rows)


def test_squeezed_numbers():
    for x in ([], [0], [0] * 9, [1, 255, 256, 65536, 2**32 - 1], range(1000)):
        assert B.expand(B.squeeze(np.array(x, np.int64))).tolist() == list(x)


def test_bpe_digests_and_edges(spark, vocabulary):
    ranks, pattern = vocabulary
    assert B.round_trip(empty(spark), ranks, pattern).count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    rows = B.round_trip(table(spark, [(1, None), (2, "")]), ranks, pattern).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, nothing, nothing), (2, 0, nothing, nothing)]


def test_decoding_by_the_table(spark):
    """Any table of token bytes, other columns kept, ids from elsewhere."""
    tokens = spark.createDataFrame([(0, bytearray(b"ab")), (7, bytearray(b"\xff")), (2, bytearray(b""))], "token int, bytes binary")
    ids = lambda *x: bytearray(np.array(x, "<u4").tobytes())
    rows = spark.createDataFrame([("p", ids(0, 7, 0), 1.5), ("q", None, None), (None, ids(2, 2), 2.0), ("r", ids(), 3.0)] * 40, "key string, ids binary, x double").repartition(3)
    got = Counter((r.key, r.x, bytes(r.decoded)) for r in B.decode(rows, tokens, size=16).collect())
    assert got == {("p", 1.5, b"ab\xffab"): 40, ("q", None, b""): 40, (None, 2.0, b""): 40, ("r", 3.0, b""): 40}
    assert Counter(bytes(r.decoded) for r in B.decode(rows, tokens, keep=[]).collect())[b"ab\xffab"] == 40
    with pytest.raises(Exception, match="not in the token-byte table"):
        B.decode(spark.createDataFrame([(ids(5),)], "ids binary"), tokens).collect()
