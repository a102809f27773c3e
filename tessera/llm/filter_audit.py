"""Interaction of corpus filters: what every order of the filters removes, and what would have gone anyway.

Documents are reduced to a mask, one bit for each filter that they fail, and counted by part, mask and labels.  The
few cells left are unpivoted against every step of every order; a running bit-or over the steps tells which cells an
earlier filter has removed, and conditional sums give the counts of each step.  Texts are read once and never
shuffled; copies of a text meet only as counts.

Defined results: a null text counts as empty; a null part is the empty string; a document without an id has no label
and is neither a repeat nor an original of one; of several label rows of an id, one that says yes is enough; rows with
the same id and text are no repeats of each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import BROADCAST_IDS, column_bytes, stash, steps, word_spans

#: Letters of the filters on a text by itself, and of the one on repeats.
ON_TEXT, REPEATED = "ABCD", "E"
_CAPITAL, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL[[ord(x) for x in "#$%&*|"]] = True


def text_failures(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A bit for each filter that a text fails: few words, few distinct words, many capitals, a symbol."""
    start, end, woff = word_spans(raw, off)
    n = np.diff(woff)
    distinct = np.zeros(len(n), np.int64)
    if len(start):
        # every other piece is a word; words are told apart by their bytes
        edges = np.empty(2 * len(start) + 1, np.int64)
        edges[0:-1:2], edges[1::2], edges[-1] = start, end, len(raw)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(start), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw))])
        codes = pieces.take(pa.array(np.arange(0, 2 * len(start), 2))).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pairs = np.unique(np.repeat(np.arange(len(n)), n) * (int(codes.max()) + 1) + codes)
        distinct = np.bincount(pairs // (int(codes.max()) + 1), minlength=len(n))
    within = lambda flags: np.diff(np.append(0, np.cumsum(flags))[off])
    tests = n < 100, 100 * distinct < 80 * n, 100 * within(_CAPITAL[raw]) > 10 * within((raw & 0xC0) != 0x80), within(_SYMBOL[raw]) > 0
    return sum(failed.astype(np.int32) << k for k, failed in enumerate(tests))


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = column_bytes(batch.column(2))
        view = memoryview(np.ascontiguousarray(raw))
        for a, b in steps(off):
            mask = text_failures(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            sha = [hashlib.sha256(view[i:j]).digest() for i, j in zip(off[a:b].tolist(), off[a + 1 : b + 1].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(sha, pa.binary()), pa.array(mask, pa.int32())], names=["doc_id", "part", "_sha", "mask"])


def _labelled(rows: DataFrame, labels: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """rows with a boolean for each mark of their doc_id."""
    known = stash(labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(*[F.coalesce(F.max(x), F.lit(False)).alias(m) for m, x in marks.items()]).where(" or ".join(marks)), "marks")
    n = known.count()
    yes = lambda m: F.coalesce(F.col(m), F.lit(False)).alias(m)
    if n <= BROADCAST_IDS:
        return rows.join(F.broadcast(known), F.col("doc_id") == F.col("_id"), "left").select(*rows.columns, *map(yes, marks))
    with_id = rows.where("doc_id is not null").join(known, F.col("doc_id") == F.col("_id"), "left").select(*rows.columns, *map(yes, marks))
    return with_id.unionByName(rows.where("doc_id is null").withColumns({m: F.lit(False) for m in marks}))


def mask_cells(docs: DataFrame, labels: DataFrame, part: str, marks: dict[str, Column], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """part, mask, the marks and n: documents counted by what they fail, the last bit for a repeat of a smaller id's text."""
    repeat = 1 << len(ON_TEXT)
    read = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), docs[text_col].cast("string").alias("text"))
    rows = read.mapInArrow(_masks, "doc_id long, part string, _sha binary, mask int")
    # one row for each document and text, then for each text and cell: the least id there and how often it comes
    each = _labelled(rows.groupBy("_sha", "mask", "part", "doc_id").agg(F.count(F.lit(1)).alias("n")), labels, marks)
    known = F.col("doc_id").isNotNull()
    texts = each.groupBy("_sha", "mask", "part", *marks).agg(
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("_least"), F.sum("n").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("_free")
    )
    least = F.min("_least.doc_id").over(Window.partitionBy("_sha"))  # a row for each cell of a text
    first = F.col("_free") + F.when(F.col("_least.doc_id") == F.col("_first"), F.col("_least.n")).otherwise(0)
    counted = texts.withColumn("_first", least).withColumn("_own", first).groupBy("part", "mask", *marks).agg(F.sum("_own").alias("own"), F.sum(F.col("n") - F.col("_own")).alias("again"))
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("own").alias("n")), F.struct((F.col("mask") + repeat).alias("mask"), F.col("again").alias("n"))))
    return counted.select("part", *marks, both.alias("_c")).select("part", "_c.mask", *marks, F.col("_c.n").alias("n")).where("n > 0")


def audit(cells: DataFrame, filters: str, marks: dict[str, str], orders: list[str] | None = None) -> DataFrame:
    """A row for each part, order and step.

    filters has a letter for each bit of `mask`, lowest first; marks names the count of lost documents for each mark;
    without orders all permutations are taken.
    """
    orders = orders or ["".join(p) for p in permutations(filters)]
    steps = max(map(len, orders))
    long = (
        cells.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
        .repartition("part", "filter_order")  # serves the running window and the sums
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
        .withColumn("_letter", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
        .where("_letter <> ''")
    )
    bit = F.element_at(F.create_map(*[F.lit(x) for k, f in enumerate(filters) for x in (f, 1 << k)]), F.col("_letter"))
    earlier = Window.partitionBy("part", "filter_order", "mask", *marks).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("_bit", bit).withColumn("_failed", F.col("mask").bitwiseAND(F.col("_bit")))
    long = long.withColumn("_gone", F.coalesce(F.bit_or("_failed").over(earlier), F.lit(0)) != 0)
    failed, gone = F.col("_failed") != 0, F.col("_gone")
    total = lambda which, name: F.sum(F.when(which, F.col("n")).otherwise(0)).cast("long").alias(name)
    out = long.groupBy("part", "filter_order", "step", "_letter").agg(
        total(~failed & ~gone, "kept"), total(failed & ~gone, "removed"), total(failed & gone, "redundant"), total(F.col("mask") == F.col("_bit"), "unique_fails"),
        *[total(failed & ~gone & F.col(m), name) for m, name in marks.items()],
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_letter"))).drop("_letter")


MARKS = {"_good": "good_lost", "_toxic": "toxic_lost"}


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of the five corpus filters A to E in all 120 orders."""
    cells = mask_cells(docs, labels, part, {"_good": F.col("quality") == 1, "_toxic": F.col("toxic") == 1})
    return audit(cells, ON_TEXT + REPEATED, MARKS)


AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, good, toxic, mask, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT chr(CAST(65 + k AS INTEGER)) AS l FROM range(5) r(k)),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (SELECT c.*, filter_order, step, substr(filter_order, step, 1) AS letter, (mask >> (ascii(substr(filter_order, step, 1)) - 65)) & 1 AS failed,
  len(list_filter(string_split(substr(filter_order, 1, step - 1), ''), lambda q: q <> '' AND (mask >> (ascii(q) - 65)) & 1 = 1)) > 0 AS gone FROM c, o, (SELECT CAST(step AS INTEGER) AS step FROM range(1, 6) q(step))),
g AS (SELECT part, filter_order, step, letter, count(*) AS cells, sum(n) FILTER (failed = 0 AND NOT gone) AS kept, sum(n) FILTER (failed = 1 AND NOT gone) AS removed, sum(n) FILTER (failed = 1 AND gone) AS redundant,
  sum(n) FILTER (mask = 1 << (ascii(letter) - 65)) AS unique_fails, sum(n) FILTER (failed = 1 AND NOT gone AND good) AS good_lost, sum(n) FILTER (failed = 1 AND NOT gone AND toxic) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley FROM g
"""
