"""MinHash near-duplicates from bottom-k sketches of one hash function.

1. Every document's set of word shingles gives its size, a 128-bit signature of the set and the k
   smallest hashes (the sketch).  Documents with the same set form a class; only its smallest id goes on.
2. Inverted lists: a sketch value seen in two or more classes lists them.  Of the k smallest hashes of two
   sets' union, a share that is binomial around their similarity is in both sketches, so with a similarity of
   at least 0.8 at least the share t (five deviations below, less for sets that the sketch covers) is; the
   chance to lose a pair is under 1e-6, and 0 for sets that fit in a sketch.  With values ordered by how many
   classes hold them, a class need enter only the lists of the rarest part 1 - t of its sketch.  Common passages
   so cause no lists.
3. Classes that lists connect form candidate groups, split into blocks of bounded size.  Each task takes one pair
   of blocks (or many small groups): it counts the overlaps of retained values, keeps pairs whose overlap reaches
   t, estimates their similarity from the union sketch, and verifies with the exact Jaccard similarity of the whole
   sets.  Pairs that earlier links of the task join are skipped, so a task returns a forest, never all pairs.
4. Components of the forests of large groups follow by star rounds.

Defined results: documents without words have an empty set and are linked with nothing; fewer words than
a shingle make one shingle; repeated rows have the same id and so the same verdict; rows without an id are
kept with a null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import BROADCAST_IDS, column_bytes, lower_ascii, mix, ngram_hashes, stash, steps, with_ids, word_hashes
from tessera.llm.components import Union, connected_components

SKETCH = 64
#: Deviations between the similarity and the least share of common sketch values.
DEVIATIONS = 5.0
#: Classes in a block of a large group, and bytes of sets for a task of small groups.
BLOCK = 512
TASK_BYTES = 2 << 20


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct signed hashes of its word shingles."""
    for a, b in steps(off):
        part, o = lower_ascii(raw[off[a] : off[b]]), off[a : b + 1] - off[a]
        words, woff = word_hashes(part, o)
        grams = _signed(ngram_hashes(words, size))
        for s, e in zip(woff[:-1].tolist(), woff[1:].tolist()):
            if e - s >= size:
                x = np.sort(grams[s : e - size + 1])
                keep = np.ones(len(x), bool)
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                yield x[keep]
            elif e > s:
                yield _signed(ngram_hashes(words[s:e], e - s) ^ np.uint64(e - s))
            else:
                yield np.zeros(0, np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat, pa.int64()))


def sketches(docs: DataFrame, size: int, k: int = SKETCH) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (signature of the set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = column_bytes(batch.column(1))
            n, s1, s2, low = [], [], [], []
            for x in shingle_sets(raw, off, size):
                u = x.view(np.uint64)
                n.append(len(x))
                s1.append(int(np.sum(mix(u)).view(np.int64)) if len(x) else 0)
                s2.append(int(np.sum(mix(u ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if len(x) else 0)
                low.append(x[:k].copy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), _lists(low)], names=["doc_id", "n", "s1", "s2", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sketch array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = column_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(list(shingle_sets(raw, off, size)))], names=["doc_id", "hashes"])

    return docs.mapInArrow(run, "doc_id long, hashes array<long>")


def least_share(n, k: int, percent: int, least, sqrt):
    """The least share of common values in the union sketch of sets of about n hashes."""
    j = percent / 100
    return j - DEVIATIONS * sqrt(j * (1 - j) / least(k, n) * (1 - least(1.0, k * j / n)))


def list_edges(reps: DataFrame, percent: int, k: int = SKETCH) -> DataFrame:
    """(a, b): every class of an inverted list, with the first of the list.

    Lists are counted and their first class found by sums that are combined before the shuffle, then joined; a value
    that very many classes hold is a skewed key of a join, which Spark splits, and no window holds a list.
    """
    held = reps.select("doc_id", "n", F.size("sketch").alias("len"), F.explode("sketch").alias("v"))
    sizes = held.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = held.join(sizes.hint("merge"), "v")
    of_doc = Window.partitionBy("doc_id")  # at most k rows each
    share = least_share(F.col("n"), k, percent, lambda x, y: F.least(F.lit(x), y), F.sqrt)
    need = F.greatest(F.ceil(share * F.col("len") - 1e-9), F.lit(1))
    ranked = shared.withColumn("alone", F.col("len") - F.count(F.lit(1)).over(of_doc)).withColumn("rank", F.row_number().over(of_doc.orderBy("df", "v")))
    kept = stash(ranked.where(F.col("alone") + F.col("rank") <= F.col("len") - need + 1).select("v", "doc_id"), "lists")
    first = kept.groupBy("v").agg(F.min("doc_id").alias("a"))
    return kept.join(first.hint("merge"), "v").select("a", F.col("doc_id").alias("b")).where("a < b")


def _links_of(docs: list[int], sets: list[np.ndarray], side: np.ndarray | None, percent: int, k: int) -> tuple[Union, list[tuple[int, int]]]:
    """A forest of verified links.  side: with two blocks, only pairs across them count."""
    low = [s[:k] for s in sets]
    n = np.array([len(s) for s in sets])
    share = least_share(n.astype(float), k, percent, np.minimum, np.sqrt)
    _, index, count = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(low)), [len(x) for x in low])
    column = (np.cumsum(count > 1) - 1)[index]
    both = (count > 1)[index]
    row, column = row[both], column[both]
    overlap = np.zeros((len(low), len(low)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):  # the retained values, some thousand at a time
        part = slice(*np.searchsorted(column, [a, a + 4096]))
        held = np.zeros((len(low), 4096), np.float32)
        held[row[part], column[part] - a] = 1
        overlap += held @ held.T
    need = np.ceil(np.minimum(share[:, None], share[None, :]) * np.minimum(k, np.maximum(n[:, None], n[None, :])) - 1e-6)
    fits = (overlap >= np.maximum(need, 1)) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
    fits = np.triu(fits, 1)
    if side is not None:
        fits &= side[:, None] != side[None, :]
    one, two = np.nonzero(fits)
    seen, links = Union(), []
    order = np.argsort(-overlap[one, two], kind="stable")
    for i, j in zip(one[order].tolist(), two[order].tolist()):
        if seen.find(docs[i]) == seen.find(docs[j]):
            continue
        union = np.union1d(low[i], low[j])[:k]
        common = np.intersect1d(np.intersect1d(low[i], low[j], assume_unique=True), union, assume_unique=True)
        if len(common) < np.floor(min(share[i], share[j]) * len(union)):
            continue
        c = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c) and seen.join(docs[i], docs[j]):
            links.append((docs[i], docs[j]))
    return seen, links


def group_links(percent: int, k: int):
    """For one task's rows: (a, b, whole) links; whole ones give a class and its component at once."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        docs, group = table["doc_id"].to_numpy(), table["grp"].to_numpy()
        block = table["block"].to_numpy()
        lists = table["hashes"].combine_chunks()
        values, edges = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        edges = edges - edges[0]
        pair = table["lo"][0].as_py() >= 0
        order = np.argsort(group, kind="stable")
        bounds = np.r_[0, np.flatnonzero(np.diff(group[order])) + 1, len(order)]
        a, b = [], []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            mine = order[s:e]
            ids, sets = docs[mine].tolist(), [values[edges[x] : edges[x + 1]] for x in mine.tolist()]
            side = block[mine] if pair and table["lo"][0].as_py() != table["hi"][0].as_py() else None
            seen, links = _links_of(ids, sets, side, percent, k)
            if pair:
                a += [x for x, _ in links]
                b += [y for _, y in links]
            else:
                a += [seen.find(x) for x in ids]
                b += ids
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "whole": pa.array([not pair] * len(a), pa.bool_())})

    return run


def class_components(docs: DataFrame, reps: DataFrame, size: int, percent: int, k: int = SKETCH) -> DataFrame | None:
    """(node, component) for the classes that may have links; None if there are none."""
    groups = connected_components(list_edges(reps, percent, k))
    sizes = reps.select(F.col("doc_id").alias("node"), "n")
    members = groups.join(sizes, "node").groupBy("node").agg(F.min("component").alias("grp"), F.max("n").alias("n"))
    # blocks by hash: only groups of more than one block are counted out, so no group is ordered or gathered
    large = stash(members.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "large")
    members = members.join(F.broadcast(large) if large.count() <= BROADCAST_IDS else large, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = stash(members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "members")
    total, many = members.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not many:
        return None
    tasks = max(1, -(-8 * int(total) // TASK_BYTES))
    sets = full_sets(with_ids(docs, members.select(F.col("node").alias("doc_id")), "doc_id", "left_semi", many), size).dropDuplicates(["doc_id"])
    held = sets.join(members.withColumnRenamed("node", "doc_id"), "doc_id")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = held.withColumn("other", other).select(
        "doc_id", "grp", "block", "hashes",
        F.when(F.col("other") < 0, F.pmod(F.xxhash64("grp"), F.lit(tasks))).otherwise(F.col("grp")).alias("task"),
        F.when(F.col("other") < 0, -1).otherwise(F.least("block", "other")).alias("lo"),
        F.when(F.col("other") < 0, -1).otherwise(F.greatest("block", "other")).alias("hi"),
    )
    links = stash(dealt.groupBy("task", "lo", "hi").applyInArrow(group_links(percent, k), "a long, b long, whole boolean"), "links")
    whole = links.where("whole").select(F.col("b").alias("node"), F.col("a").alias("component"))
    rest = links.where("not whole").select("a", "b")
    return whole.union(connected_components(rest)) if not rest.isEmpty() else whole


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and kept, for every row."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sets = stash(sketches(docs, size, k), "sketches")
    known = sets.where("n > 0 and doc_id is not null")
    classes = stash(known.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = known.join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2", "n"), ["doc_id", "s1", "s2", "n"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"])
    parts = class_components(docs, reps, size, percent, k)
    if parts is not None:
        classes = classes.join(stash(parts, "components").withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("c"))
    else:
        classes = classes.withColumnRenamed("rep", "c")
    out = sets.select("doc_id", "n", "s1", "s2").join(classes, ["s1", "s2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: The same rows in DuckDB, for 4 words and 80 %: all pairs that share a shingle, then the closure of the links.
NEAR_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)])
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM t),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
n AS (SELECT doc_id, len(g) AS n FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 80 * (na.n + nb.n - n_both)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT doc_id, doc_id FROM n),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, min(r.b) = n.doc_id AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
