"""The corpus operators against brute force on small tables with nulls, copies, ties and clashing columns."""

import hashlib
import heapq
import os
import random
import re
import time
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from brute_lm import scores
from fixtures import corpus, empty, sentence, table, text
from pyspark.sql import functions as F

from tessera.llm import decontaminate as D
from tessera.llm import language_model as LM
from tessera.llm import licenses as LI
from tessera.llm import main_text as H
from tessera.llm import minhash as MH
from tessera.llm import packing as PK
from tessera.llm import quality as Q
from tessera.llm import quotes as QU
from tessera.llm import sentence_spans as SP
from tessera.llm import suffix_dedup as SD
from tessera.llm.common import column_bytes
from tessera.llm.components import connected_components
from tessera.llm.license_texts import RESERVED, templates
from tessera.llm.pages_training import PageMaker
from tessera.llm.queries import queries, tokenizer_path
from tessera.llm.suffix import suffix_arrays

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, [*rows, (None, "no id " * 30)], repeat=rows[:2]).cache()


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize("limit", [LM.LIMIT, 64, 5])
def test_language_model(spark, docs, rows, limit):
    """With small limits most words are dealt over shards, most contexts are split and there are hundreds of files."""
    got = LM.score_texts(docs, limit=limit).collect()
    want = scores([*rows, *rows[:2]])
    assert len(got) == len(rows) + 3
    for r in got:
        if r.doc_id is None:
            assert r.held_out
            continue
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert np.allclose([r.base_score, r.score], w[4:], rtol=1e-9, atol=1e-9)


def test_language_model_empty(spark):
    assert LM.score_texts(empty(spark)).count() == 0
    only = LM.score_texts(table(spark, [(None, "a b"), (None, None)])).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in only)


def test_model_files(tmp_path):
    uri = f"file://{tmp_path}/m"
    c = np.array([1, 255, 254, 70_000, 1 << 40, 0])
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    for k in range(200):
        LM.put_arrays(uri, f"f-{k}", [*LM.pack_counts(c + k), *LM.pack_keys(h)])
    files = LM.Files(uri, most=3)
    for k in [*range(200), 0]:
        arrays = files.get(f"f-{k}")
        assert LM.counts_at(arrays[:3], np.array([4, 1, 0, 3, 5, 2])).tolist() == (c + k)[[4, 1, 0, 3, 5, 2]].tolist()
        at, hit = LM.find_keys(arrays[3:5], np.r_[h[::7], h[::7] + np.uint64(1 << 20)])
        assert hit[: len(h[::7])].all() and (at[: len(h[::7])] == np.arange(0, 5000, 7)).all() and not hit[len(h[::7]) :].any() and len(files.held) <= 3
    with pytest.raises(FileNotFoundError):
        files.get("f-200")
    made = [Counter(min(x, 3) for x in counts) | {"t": sum(counts)} for counts in ([], [1], [1, 1, 3], [5], [2, 2, 1], [9, 1, 2, 3], [1] * 300, [1 << 40])]
    parts = [np.array([m.get(k, 0) for m in made]) for k in ("t", 1, 2, 3)]
    assert np.array_equal(LM.stats_at(LM.pack_stats(parts), np.array([7, 0, 5, 1, 2, 3, 4, 6])), np.stack(parts)[:, [7, 0, 5, 1, 2, 3, 4, 6]])


def test_model_sums_to_one():
    assert LM.discounts(0, 0, 0, 0) == (0.5, 1.0, 1.5)
    d = LM.discounts(100, 40, 20, 10)
    assert 0 <= d[0] <= 1 and 0 <= d[1] <= 2 and 0 <= d[2] <= 3


# ---------------------------------------------------------------- 2


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "bot", "> Hello there.\nFine."), (1, 2, "user", "> > Hello there.\n> Fine.\nGood"), (1, 3, "bot", ">> how  are\n>> YOU?\n> nothing\nyes"),
        (1, 4, "u", "> Hello there. How are\n> you?\nno"), (2, 0, "a", None), (2, None, "a", "x"), (2, 1, None, ">"), (None, 1, "b", "z"), (1, 1, "bot", "> Hello there.\nFine."), (3, 0, "a", "same"), (3, 1, "b", "same"), (3, 2, "a", "> same\nok"),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, m long, plain int")
    got = {(r.conv_id, r.part): r for r in QU.chat(df).collect()}
    assert got[1, 0].chat == "<|user|>\nHello there.\nHow are you?\n<|bot re:0|>\nFine.\n<|user re:1|>\nGood\n<|bot re:0|>\nyes\n<|u re:0|>\nno"
    assert got[3, 0].chat.endswith("<|a re:1|>\nok") and got[2, -1].n_messages == 1 and got[None, 0].chat == "<|b|>\nz"
    assert QU.chat(df.limit(0)).count() == 0
    plan = QU.chat(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _same_as_sql(spark_df, sql, **tables):
    import duckdb

    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    got, want = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda frame: sorted(map(repr, frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).values.tolist()))
    assert key(got) == key(want)


def test_quotes_against_sql_and_in_reply_order(spark):
    rows = [(7, 0, "a", "first words"), (7, 1, "b", "second words"), (7, 2, "c", "> first words\nthird words"), (7, 3, "d", "> second words\nfourth"), (7, 4, "e", "> third words\nfifth"), (7, 5, "f", "plain")]
    r = random.Random(13)
    for conv in range(20):
        said = []
        for turn in range(r.randint(1, 9)):
            own = sentence(r).strip()
            old = r.choice(said) if said and r.random() < 0.6 else None
            quote = "".join(f"{r.choice(['>', '> ', '>> ', ' >'])}{x}\n" for x in old.split("\n")) if old else ""
            said.append(own)
            rows.append((conv, turn, r.choice(["user", "bot"]), quote + own))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    _same_as_sql(QU.chat(df), QU.CHAT_SQL, conversations=df.toPandas())
    chat = {x.conv_id: x.chat for x in QU.chat(df.where("conv_id = 7 and role in ('a', 'b', 'c', 'd', 'e', 'f')")).collect()}[7]
    assert [x for x in chat.split("\n") if not x.startswith("<|")] == ["first words", "second words", "fourth", "third words", "fifth", "plain"]


def test_quotes_of_hostile_texts_and_crowds(spark):
    marks = [">" * 1_000_000, "> " * 500_000 + "x", (">" * 2000 + "y\n") * 200, " \t" * 500_000, "a" * 1_000_000]
    start = time.time()
    df = spark.createDataFrame([(1, k, "u", t) for k, t in enumerate(marks)], "conv_id long, turn long, role string, text string")
    (row,) = QU.chat(df).collect()
    assert row.n_messages == 5 and row.n_linked == 0 and row.chat.endswith("a" * 1_000_000) and time.time() - start < 30
    crowd = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    parts = QU.chat(crowd).collect()
    assert len(parts) == 6 and sum(p.n_messages for p in parts) == 3000 and max(p.n_messages for p in parts) < 1000


# ---------------------------------------------------------------- 3


def _edit(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_myers_against_dp():
    r = random.Random(4)
    for _ in range(60):
        item, t = ("".join(r.choice("ab c") for _ in range(r.randint(1, n))) for n in (40, 50))
        want = [min(_edit(item, t[a:b]) for a in range(b + 1)) for b in range(1, len(t) + 1)]
        assert list(D.distances(D.masks(item), len(item), t)) == want


def test_contamination(spark, rows):
    r = random.Random(8)
    items = [(k, text(r, 3)) for k in range(6)] + [(6, "tiny"), (7, None), (8, "")]
    planted = []
    for k, t in items[:6]:
        body = list(t)
        for _ in range(int(len(D.normal(t)) * D.BUDGET) // 2):
            body[r.randrange(len(body))] = r.choice("xyz")
        planted.append((2000 + k, text(r, 5) + " " + ("".join(body) if k % 2 else t.upper() if t.isascii() else t) + "\n" + text(r, 4)))
    planted.append((2100, " Tiny "))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = table(spark, [*rows, *planted])
    got = {(x.doc_id, x.item_id): x for x in D.contamination(df, bench).collect()}
    assert set(got) == {(2000 + k, k) for k in range(6)} | {(2100, 6)}
    for (doc, item), x in got.items():
        passage = D.normal(dict(planted)[doc])[x.start : x.end]
        assert _edit(D.normal(dict(items)[item]), passage) == x.distance
    kept = {x.doc_id for x in D.decontaminate(df, bench).collect()}
    assert kept == {i for i, _ in rows}
    assert D.decontaminate(df, bench.limit(0)).count() == df.count()
    assert D.contamination(empty(spark), bench).count() == 0
    assert len(list(D.blocks(bench, "item_id", "text", most=2))) == 4


def test_contamination_against_all_pairs(spark):
    """Every document with every item, by plain edit distance to the best substring."""
    r = random.Random(21)
    items = [(k, text(r, r.randint(1, 3))) for k in range(7)] + [(7, "na " * 12), (8, "ab" * 30)]
    docs = []
    for k in range(36):
        body = list(items[k % 9][1])
        for _ in range(r.choice([0, 0, 1, 2, 3, 6, 9, 14])):
            at = r.randrange(len(body))
            body[at : at + 1] = r.choice([[], [r.choice("xyz")], [body[at], r.choice("xyz")]])
        docs.append((k, text(r, r.randint(0, 2)) + " " + "".join(body) + "\n" + text(r, r.randint(0, 2))))
    docs.append((99, "na " * 400))
    want = {}
    for i, t in docs:
        for j, item in items:
            a, b = D.normal(item), D.normal(t)
            row = [0] * (len(b) + 1)
            for x in a:
                new = [row[0] + 1]
                for y, up, left in zip(b, row[1:], row):
                    new.append(min(up + 1, new[-1] + 1, left + (x != y)))
                row = new
            if min(row) <= int(len(a) * D.BUDGET):
                want[i, j] = min(row)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = D.contamination(df, bench).collect()
    assert {(x.doc_id, x.item_id): x.distance for x in found} == want and len(found) == len(want) and 5 < len(want) < 36 * 9
    for x in found:
        assert _edit(D.normal(dict(items)[x.item_id]), D.normal(dict(docs)[x.doc_id])[x.start : x.end]) == x.distance


def test_contamination_by_short_items(spark):
    bench = spark.createDataFrame([(1, "tiny art"), (2, "What is 2 + 2?"), (3, "xq")], "item_id long, text string")
    texts = ["a long text with Tiny  ART in it", "tiny artist, then tiny art.", "tiny artist", "ask: what is 2 + 3? and more", "xqs sxq", "so (xq) here", "xq", "what was 3 + 2?"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x.doc_id, x.item_id): (x.distance, D.normal(texts[x.doc_id])[x.start : x.end]) for x in D.contamination(df, bench).collect()}
    assert got == {(0, 1): (0, "tiny art"), (1, 1): (0, "tiny art"), (3, 2): (1, "what is 2 + 3?"), (5, 3): (0, "xq"), (6, 3): (0, "xq")}
    assert {x.doc_id for x in D.decontaminate(df, bench).collect()} == {2, 4, 7}


def test_short_items_against_dp():
    r = random.Random(9)
    for _ in range(300):
        item = D.normal("".join(r.choice("ab c.") for _ in range(r.randint(1, 19))))
        t = D.normal("".join(r.choice("ab c.") for _ in range(12)) + r.choice(["", " ", "a"]) + item.replace("a", r.choice("ab"), 1) + r.choice(["", " ", "a"]) + "".join(r.choice("ab c.") for _ in range(12)))
        if not item:
            continue
        e = int(len(item) * D.BUDGET)
        spans = [(_edit(item, t[a:b]), a) for a in range(len(t)) for b in range(max(a + 1, a + len(item) - e), min(len(t), a + len(item) + e) + 1) if D.at_edge(t, a) and D.at_edge(t, b)]
        want = min((x for x in spans if x[0] <= e), default=None)
        got = D.Matcher([(1, item)]).match(t)
        assert [x[1:3] for x in got] == ([want] if want else [])


# ---------------------------------------------------------------- 4


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [("a/LICENSE", apache), ("a/b/x.txt", "words " * 50), ("a/b/c/y.txt", "words\n" + mit), ("d/z.txt", "nothing here"), ("", None), (None, "n"), ("a/b/x.txt", "words " * 50), ("e/q.txt", mit), ("e/f/g.txt", "more words " * 40), ("ab/x", "other"), ("r/a", "All rights reserved."), ("r/b", "x"), ("s/a", f"All rights reserved.\n{mit}")]
    df = spark.createDataFrame([(p, t, 1, "x", 9) for p, t in rows], "path string, text string, score int, whole string, parts int")
    got = [(r.path, r.license, r.origin, r.inherited_from) for r in LI.license_scan(df).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g[1:] for g in got}
    assert by["a/LICENSE"][:2] == ("Apache-2.0", "own") and by["a/b/x.txt"] == ("Apache-2.0", "inherited", "a") and by["a/b/c/y.txt"][:2] == ("MIT", "own")
    assert by["d/z.txt"] == (None, None, None) and by["ab/x"] == (None, None, None) and by["e/f/g.txt"] == ("MIT", "inherited", "e")
    assert by["r/a"][:2] == (RESERVED, "own") and by["r/b"] == (None, None, None) and by["s/a"][:2] == ("MIT", "own")
    assert LI.license_scan(df.limit(0)).count() == 0
    one = LI.license_scan(df, texts=[("Own", "nothing to see here")])
    assert {r.license for r in one.collect()} == {None, "Own"}


def test_licenses_in_most_files(spark):
    """Every template is found as itself, in a line, in comment blocks and as a whole text, however many files hold it."""
    rows = []
    for j, (name, t) in enumerate(templates()):
        words = t.split(" ")
        lines = "\n".join("# " + " ".join(words[k : k + 9]) for k in range(0, len(words), 9))
        rows += [(f"{name}/{j}-{k}", x, name) for k, x in enumerate((f"line {j}\n{t}\nother", f"code here = {j}\n\n{lines}\n\nmore code({j})", t)) for _ in range(3)]
    got = LI.license_scan(spark.createDataFrame(rows, "path string, text string, want string"), keep=["want"]).where("origin = 'own' and license = want").count()
    assert got == len(rows)


def test_licenses_of_one_family(spark):
    gnu = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    texts = {
        gnu.format("program", "General", "2"): "GPL-2.0", gnu.format("program", "General", "3"): "GPL-3.0", gnu.format("library", "Lesser General", "2.1"): "LGPL-2.1", gnu.format("program", "Affero General", "3"): "AGPL-3.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND-4.0", "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "Licensed under CC BY 3.0": "CC-BY-3.0",
        "Licensed under the GNU General Public License, version 7.": None, "SPDX-License-Identifier: ISC": "ISC",
    }
    rows = [(f"{k}/{j}", t) for k, t in enumerate(texts) for j in range(4)] + [("z", "some other words that stand in no notice")] * 20
    got = {r.path: r.license for r in LI.license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {t: got[f"{k}/0"] for k, t in enumerate(texts)} == texts


def test_licenses_against_sql_and_every_part(spark):
    r = random.Random(3)
    notices = [t for _, t in templates()]
    words = ["the", "of", "this", "work", "licensed", "under", "Licensed,", "cc", "BY", "4.0", "mit", "free", "xyz", "nc", "\n", "\n \n", "É", "version", "2", "gnu", "license"]
    rows = []
    for k in range(150):
        t = " ".join(r.choice(words) for _ in range(r.randint(0, 40)))
        if r.random() < 0.5:
            w = r.choice(notices).split(" ")
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(words)
            t += "\n" * r.randint(0, 2) + " ".join(w) + "\n" * r.randint(0, 2) + " ".join(r.choice(words) for _ in range(r.randint(0, 9)))
        rows.append((k, t, r.choice(["a", "a/b", "c"]), r.choice(["en", "fr"])))
    rows += [(900, "", "a", "en"), (901, "Released under the MIT License.", "a", "en"), (902, " \r\n\t\n", "c", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    files = df.select("doc_id", "text", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    got = LI.license_scan(files, keep=["doc_id"])
    assert got.where("origin = 'own'").count() > 20
    _same_as_sql(got, LI.license_sql(), documents=df.toPandas())


# ---------------------------------------------------------------- 5


def _figures(t):
    w = WORD.findall(t or "")
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, covered = Counter(runs), set()
    for i, k in enumerate(runs):
        if count[k] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def brute_quality(rows, trusted, threshold=Q.THRESHOLD, buckets=Q.BUCKETS):
    """doc index -> kept, with the same hashed features."""

    def feats(t):
        h = [zlib.crc32(w.encode()) for w in WORD.findall(t or "")]
        return [x % buckets for x in h] + [(x * 40503 + y) % buckets for x, y in zip(h, [*h[1:], -1])]

    raw, good = Counter(), Counter()
    for i, t in rows:
        f = feats(t)
        raw.update(f)
        if i in trusted:
            good.update(f)
    n, m = sum(raw.values()), sum(good.values())
    ratio = lambda b: np.log((good[b] + Q.PRIOR) / (raw[b] * m / n + Q.PRIOR))
    out = []
    for _, t in rows:
        words, *_, repeated = _figures(t)
        f = feats(t)
        failed = words < 20 or 100 * repeated > 30 * words
        score = sum(ratio(b) for b in f) / max(len(f), 1)
        out.append((failed, not failed and score >= threshold, score))
    return out


def test_quality(spark, docs, rows):
    trusted = {i for i, _ in rows[:25]}
    ids = spark.createDataFrame([(i,) for i in trusted] + [(None,)], "doc_id long")
    got = {r.doc_id: r for r in Q.quality(docs, ids).collect()}
    everything = [*rows, (None, "no id " * 30), *rows[:2]]
    for (i, t), (failed, kept, score) in zip(everything, brute_quality(everything, trusted)):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _figures(t)
        assert r.base_failed == failed and r.kept == kept and abs(r.llr - score) < 1e-9
    assert Q.quality(empty(spark), ids).count() == 0
    assert {r.llr for r in Q.quality(docs, ids.limit(0)).collect()} == {0.0}
    plan = Q.quality(docs.drop("x"), ids)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- 6


def brute_near(rows, size, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, docs, rows, size):
    r = random.Random(2)
    base = text(r, 12).split(" ")
    chain = []
    for k in range(700):  # more than one block
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"z{r.randrange(9999)}"
        chain.append((5000 + k, " ".join(w)))
    everything = [*rows, *chain]
    got = {x.doc_id: x for x in MH.near_duplicates(table(spark, [*everything, (None, "a b c d e f")]), size=size).collect()}
    for (doc, _), (n, component) in zip(everything, brute_near(everything, size, 80)):
        assert (got[doc].n_shingles, got[doc].component_id, got[doc].kept) == (n, component, doc == component)
    assert got[None].kept and got[None].component_id is None
    assert MH.near_duplicates(empty(spark), size=size).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(200 + k, 201 + k) for k in range(30)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


# ---------------------------------------------------------------- 7


def test_sentence_spans(spark, docs, rows):
    every = [*rows, *rows[:2]]
    first, gone = {}, {i: set() for i, _ in rows}
    parts = {i: SP.sentences(t) for i, t in rows}
    assert all("".join(parts[i]) == (t or "") for i, t in rows)
    for i in sorted(parts):
        w = [tuple(p.translate(LOWER).encode().split()) for p in parts[i]]
        for k in range(len(w) - 1):
            if len(w[k]) + len(w[k + 1]) >= SP.LEAST_WORDS and first.setdefault((w[k], w[k + 1]), (i, k)) != (i, k):
                gone[i] |= {k, k + 1}
    got = SP.drop_repeated_spans(docs).collect()
    assert len(got) == len(every) + 1
    for r in got:
        if r.doc_id is not None:
            assert r.n_removed == len(gone[r.doc_id]) and r.text == "".join(p for k, p in enumerate(parts[r.doc_id]) if k not in gone[r.doc_id])
    assert sum(map(len, gone.values())) > 20 and SP.drop_repeated_spans(empty(spark)).count() == 0


def test_sentence_spans_of_few_words(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    own = lambda n: " ".join(word() for _ in range(n)) + ". "
    plain = lambda n: " ".join(word() for _ in range(n))
    lines = "".join(f"{word()} {word()}!\n" for _ in range(25))
    shouts = "".join(word() + "!! " for _ in range(40))
    tail = own(19) + own(16) + "The end here. "
    rows = [(10 * k + j, own(12) + p + own(12)) for k, p in enumerate((lines, shouts, tail)) for j in range(3)]
    got = {x.doc_id: x for x in SP.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), grow=True).collect()}
    for k, (p, n) in enumerate(((lines, 25), (shouts, 40), (tail, 3))):
        assert [(got[10 * k + j].n_removed, p in got[10 * k + j].text) for j in range(3)] == [(0, True), (n, False), (n, False)]
    passage = [word() for _ in range(60)]
    rows = [(j, f"{plain(30 + 7 * j)} {' '.join(passage)} {plain(41)}") for j in range(20)]
    got = {x.doc_id: x.text.split() for x in SP.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), grow=True).collect()}
    assert got[0] == rows[0][1].split()
    for j, t in rows[1:]:
        assert len(set(passage) & set(got[j])) <= 30 and set(t.split()) - set(passage) <= set(got[j])


def test_cuts_of_long_sentences():
    r = random.Random(4)
    for n in (21, 300, 2000):
        words = [f"w{r.randint(0, 500)} " for _ in range(n)]
        assert "".join(SP.sentences("".join(words))) == "".join(words)
        assert max(len(p.split()) for p in SP.sentences("".join(words))) <= SP.LONGEST
    assert {len(p.split()) for p in SP.sentences("x " * 400)} == {SP.LONGEST}


def test_sentences_of_hostile_texts():
    start = time.time()
    for t in (" " * 1_000_000, "a" + " " * 1_000_000 + "b", "\n" * 1_000_000, ". " * 500_000, " \n" * 500_000, ("x" + " " * 40_000) * 25, "word " * 200_000, "x" * 1_000_000):
        assert "".join(SP.sentences(t)) == t
    assert time.time() - start < 10


# ---------------------------------------------------------------- 8


def test_main_text(spark):
    model = H.trained(150)
    pages = H.training_pages(60, seed=31)
    assert np.mean([a == H.known_text(p) for a, p in zip(H.extract(pages, model), pages)]) >= 0.9
    odd = [None, "", "plain", "<p>", "<article><p>a&amp;b &lt; c<p>d\n e</article>", "<" * 50, "<!-- x", "<script>x</script>", "<div " + "a" * 5000]
    assert len(H.extract(odd, model)) == len(odd)
    labels = H.decode([-1, 0, 1, 1], np.log(np.array([[1, 0, 0], [0.1, 0.8, 0.1], [0.5, 0.3, 0.2], [0.1, 0.1, 0.8]]) + 1e-9))
    assert labels[1] == H.CONTENT and labels[2] == H.CONTENT and labels[3] == H.EXTRA
    df = spark.createDataFrame([(1, "u", None, 5), (1, "u", pages[0], 6), (None, None, pages[1], 7)], "page_id long, url string, html string, text long")
    got = H.main_text(df).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got) and H.main_text(df.limit(0)).count() == 0


def test_decoding_against_all_labellings():
    r = random.Random(5)
    for _ in range(60):
        parent = [-1] + [r.randrange(k) for k in range(1, r.randint(2, 7))]
        score = np.log(np.random.default_rng(r.randrange(999)).random((len(parent), 3)))
        allowed = lambda a, b: a == H.WRAPPER or (a == H.CONTENT and b != H.WRAPPER) or b == H.EXTRA
        total = lambda x: sum(score[k][v] for k, v in enumerate(x) if k)
        best = max((x for x in product(range(3), repeat=len(parent)) if x[0] == H.WRAPPER and all(allowed(x[p], x[k]) for k, p in enumerate(parent) if k)), key=total)
        assert abs(total(H.decode(parent, score.copy())) - total(best)) < 1e-9


def test_pages_without_telling_names():
    makers = [PageMaker(9000 + k) for k in range(60)]
    pages = [m.bare(m.named_page()) for m in makers]
    assert np.mean([a == H.known_text(p) for a, p in zip(H.extract(pages, H.trained()), pages)]) >= 0.9
    table = "<table><tr><td><a href=1>Home</a></td><td><a href=2>News</a></td></tr></table><div><h1>Title</h1><p>" + "Long words of text, and more. " * 20 + "</p></div>"
    (found,) = H.extract([table], H.trained())
    assert "Home" not in found and found.count("Long words") == 20


def test_hostile_pages():
    model = H.trained(150)
    pages = ["<a " * 350_000, "<div>" * 30_000 + "</span>" * 100_000, "<a '>'" * 100_000 + "'", "<!" * 400_000, "<p><button>" + "<span>" * 30_000 + "<hr>" * 30_000, "<script>" + "</script" * 100_000, "<" * 1_000_000, "<ul>" + "<li><b>" * 30_000, "<p>" + "x " * 500_000]
    for p in pages:
        start = time.time()
        assert len(H.extract([p], model)) == 1 and time.time() - start < 5, p[:20]


# ---------------------------------------------------------------- 9


def brute_cut(rows, span=50):
    data = {i: (t or "").encode() for i, t in rows}
    first = {}
    for i in sorted(data):
        for k in range(len(data[i]) - span + 1):
            first.setdefault(data[i][k : k + span], i)
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if first[b[k : k + span]] < i:
                gone[k : k + span] = b"\x01" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), kept)
    return out


def test_suffix_dedup(spark, docs, rows):
    want = brute_cut(rows)
    got = SD.remove_repeats(docs, texts=True).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
        assert r.text == kept.decode("utf-8", "ignore")
    assert sum(w[1] for w in want.values()) > 500 and SD.remove_repeats(empty(spark)).count() == 0


def test_suffix_arrays():
    r = random.Random(6)
    for _ in range(60):
        texts = [[r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(0, 50))] + [0] for _ in range(r.randint(1, 5))]
        bounds = np.cumsum([0, *map(len, texts)])
        got = suffix_arrays(np.array(sum(texts, [])), bounds)
        for k, t in enumerate(texts):
            assert (got[bounds[k] : bounds[k + 1]] - bounds[k]).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


# ---------------------------------------------------------------- 10


def test_differencing():
    window, loads = PK.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(loads.tolist()) == [14, 16] and np.bincount(window, [8, 7, 6, 5, 4]).tolist() == loads.tolist()
    r = np.random.default_rng(0)
    for _ in range(20):
        sizes = r.integers(1, 512, r.integers(1, 300))
        window, n = PK.pack(sizes)
        assert np.bincount(window, sizes, n).max() <= PK.WINDOW
    assert PK.pack(np.array([2048, 2048, 1]))[1] == 3


def _plain_differencing(sizes, windows):
    """Loads of the windows in falling order, by lists."""
    heap = [(-s, k, [s] + [0] * (windows - 1)) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        loads = sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)
        heapq.heappush(heap, (loads[-1] - loads[0], tie, loads))
        tie += 1
    return heap[0][2]


def test_differencing_against_lists():
    r = random.Random(6)
    for _ in range(60):
        sizes = [r.randint(1, r.choice([5, 40, 512])) for _ in range(r.randint(1, 60))]
        windows = r.randint(2, 12)
        window, _ = PK.difference(np.array(sizes), windows)
        assert sorted(np.bincount(window, sizes, windows).tolist(), reverse=True) == _plain_differencing(sizes, windows)


def _encoded(enc, texts):
    ids, ends = enc.encode(*column_bytes(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers"), reason="no tokenizers")
@pytest.mark.parametrize("cache", [5, 100_000])
def test_encoder_against_the_tokenizer(cache):
    enc = PK.Encoder(tokenizer_path(), cache=cache)
    r = random.Random(3)
    marks = ["a", "b", "the"] + [" "] * 3 + ["  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x00", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u205f", "\u3000", "\u200b", "\u2014", "é", "1", "23", ".", ",", "'s", "'", "$$", "中", "\U0001f600", "A", "'re", "<|endoftext|>"]
    for _ in range(60):
        texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 40))) for _ in range(50)] + [None]
        assert _encoded(enc, texts) == [[*enc.tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    long = ["word" * 300_000, " ".join(["one two"] * 200_000), " " * 1_500_000 + "x"]
    assert _encoded(enc, long) == [[*enc.tok.encode(t, add_special_tokens=False).ids, 1] for t in long]


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers"), reason="no tokenizers")
def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    odd = ["", "  ", " a", "a ", "a  b", "\n the", "x \n y", "<|endoftext|> hi", "é  b", "a 　b", "it's  we'll ", "\x1c \x1d a"]
    assert _encoded(PK.Encoder(tokenizer_path(), cache=5), odd) == [[*e.ids, 1] for e in tok.encode_batch(odd, add_special_tokens=False)]
    got = PK.pack_documents(docs, tokenizer_path(), buffer=64).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in [*rows, (None, "no id " * 30)]}
    copies = Counter([i for i, _ in rows] + [None] + [i for i, _ in rows[:2]])
    by = {}
    for p in got:
        by.setdefault(p.doc_id, Counter())[p.start, p.length] += 1
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
    for i, pieces in by.items():
        assert set(pieces.values()) == {copies[i]}
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == len(ids[i])
    assert set(by) == set(ids)
    seq = {}
    for p in got:
        seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for pieces in seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert PK.pack_documents(empty(spark), tokenizer_path()).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages but the last, and the pieces of the last, on a small corpus."""
    import corpus_pipeline as CP

    r = random.Random(11)
    items = [(k, text(r, 3)) for k in range(4)]
    rows = [(i, t) for i, t in corpus(seed=12, n=30) if t is not None] + [(3000 + k, text(r, 6) + " " + t + " " + text(r, 3)) for k, t in items]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    trusted = [i for i, _ in rows[:20]]
    spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [row for row, (_, ok, _) in zip(rows, brute_quality(rows, set(trusted))) if ok]
    kept = [row for row, (_, c) in zip(kept, brute_near(kept, 5, 80)) if row[0] == c]
    cut = brute_cut(kept)
    kept = [(i, t if not cut[i][1] else cut[i][3].decode("utf-8", "ignore")) for i, t in kept if not (cut[i][1] and cut[i][1] == cut[i][0])]
    matcher = D.Matcher(items)
    kept = [(i, t) for i, t in kept if not matcher.match(t)]
    got = CP.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    assert {(x.doc_id, x.n, x.m) for x in got} == {(i, n, n) for i, t in kept for n in [len(tok.encode(t, add_special_tokens=False).ids) + 1]}
    assert [s for s, _ in CP.STAGES] and 0 < len(kept) < len(rows)


def test_pipeline_rows_without_and_with_repeated_ids(spark, tmp_path):
    """Every row is judged by its own text, whatever its id."""
    import corpus_pipeline as CP

    r = random.Random(17)
    items = [(k, text(r, 3)) for k in range(3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good, other, passage = text(r, 9), text(r, 9), text(r, 8)
    rows = [(1, good), (1, other), (None, good), (None, text(r, 9)), (2, text(r, 4) + passage), (2, passage + text(r, 4)), (None, "x " * 90), (4, "x " * 90), (None, text(r, 5) + items[0][1]), (5, text(r, 8)), (5, text(r, 5) + " " + items[1][1]), (6, good), (7, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "xx", "s", 1, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _key long")
    stage = dict(CP.STAGES)
    texts = lambda name: sorted(((x.doc_id, x.text) for x in stage[name](spark, docs, str(tmp_path)).collect()), key=repr)
    ok = [(i, t) for i, t in rows if t is not None and not t.startswith("x x")]
    assert texts("quality rules") == sorted(ok, key=repr)
    near = texts("MinHash near-dedup")
    assert [t for _, t in near].count(good) == 1 and (1, other) in near and len(near) == len(rows) - 3
    clean = texts("benchmark decontamination")
    assert clean == sorted([(i, t) for i, t in rows if t is None or not any(D.normal(x) in D.normal(t) for _, x in items)], key=repr)
    cut = texts("suffix-array dedup")
    assert sum(passage[10:-10] in (t or "") for _, t in cut) == 1 and sum((t or "") == good for _, t in cut) == 1 and (1, other) in cut


def test_pipeline_stages_at_the_edges(spark, tmp_path, rows):
    """Empty tables, null columns, repeated rows, rows without an id and columns with the operators' own names."""
    import corpus_pipeline as CP

    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, None, None), (rows[0][0], 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    some = table(spark, [*rows[:12], *rows[-14:], (None, "no id " * 30), (None, None)], repeat=rows[:2])
    for name in ("n_bytes", "_cut", "cuts", "kept", "_left", "wants", "copy"):
        some = some.withColumn(name, F.lit(7))
    for name, stage in CP.STAGES:
        for docs in (some, some.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns, name
            assert (out.count() > 0) == (docs is some), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_run(spark, name):
    assert queries()[name](spark, SF).limit(5).count() > 0


def test_sentence_helper():
    assert sentence(random.Random(1)).strip()
