"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Terms are lower-cased runs of ASCII letters and digits, their weights count * (log((1 + files) / (1 + files with the term)) + 1),
counted over all files.  Every line, every run of lines without a blank one, and the whole file is a part; the cosine
of a part with a template counts if the part has the template's numbers and the words that tell a family apart (MARKS)
agree.  A part has the licence of its best template, if that reaches the threshold and leads the best template of
another licence by the margin; a file has that of its best part.

1. The files with each template term, and with any term of each of BUCKETS hash buckets, are counted (fixed numbers).
2. Every part is scored in the workers.  A term is in no more files than its bucket, which bounds its weight from below
   and the cosine from above; parts below the threshold even so are done.  Nothing else is left out.
3. The other terms of the parts left are counted over all files and joined, which makes the cosines exact.

A file named like a licence, or whose whole text is one, speaks for its directory; files without a licence of their own
take that of the nearest ancestor directory that has one.  Directories are joined by path, one row for each ancestor
of a file, after one licence per directory has been chosen (the highest score, then the largest name).

Defined results: null and empty texts have no licence of their own but may inherit; a null path is the root
directory; rows with the same path are judged one by one; of equal scores the smallest name counts; a mere reservation
of rights counts only without a licence and for its own file; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_IDS, column_bytes, lower_ascii, span_hashes, stash, steps, with_ids
from tessera.llm.license_texts import MARKS, RESERVED, templates

THRESHOLD = 0.6
MARGIN = 0.02
#: Bytes of text that one vectorised step works on, and entries of parts multiplied with all templates at a time.
STEP = 1 << 20
ENTRIES = 20_000
#: Buckets of all terms, and the rows in which a task sends their counts.
BUCKETS = 1 << 18
CHUNKS = 64
NAMED = r"(?i)^(licen[cs]e|copying|unlicense|notice)([-_.].*)?$"
_TERM = re.compile(r"[a-z0-9]+")
_INK = np.zeros(256, bool)
_INK[np.r_[48:58, 65:91, 97:123]] = True


def terms(text: str) -> list[str]:
    """The terms of a template (ASCII)."""
    return _TERM.findall(text.lower())


def marking(term: str) -> bool:
    return term in MARKS or (term.isdigit() and len(term) < 3)


def vocabulary(known: list[tuple[str, str]]) -> list[str]:
    return sorted({t for _, x in known for t in terms(x)} | MARKS)


def term_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place and the hash of every term."""
    ink = np.zeros(len(raw) + 2, bool)
    ink[1:-1] = _INK[raw]
    first = ink[1:-1] & ~ink[:-2]
    last = ink[1:-1] & ~ink[2:]
    inner = off[(off > 0) & (off < len(raw))]
    first[inner] = ink[1:-1][inner]
    last[inner - 1] = ink[1:-1][inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, span_hashes(lower_ascii(raw), start, end)


def _hash_of(words: list[str]) -> np.ndarray:
    raw, off = column_bytes(pa.array(words, pa.string()))
    return term_hashes(raw, off)[1]


class Known:
    """The vocabulary by hash."""

    def __init__(self, texts: list[tuple[str, str]]):
        self.texts, self.words = texts, vocabulary(texts)
        h = _hash_of(self.words)
        self.order = np.argsort(h)
        self.sorted = h[self.order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each term in the vocabulary, -1 for others."""
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1)


def _rows_with(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and in how many rows each is; rows are in order."""
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.unique(h[new], return_counts=True)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        raw, off = column_bytes(batch.column(column))
        for a, b in steps(off, STEP):
            yield batch, a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def term_weights(files: DataFrame, text_col: str, texts: list[tuple[str, str]]) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of files, the weights of the vocabulary, and the least weight of a term of each bucket."""
    size = len(vocabulary(texts))
    schema = "chunk int, counts binary"

    def pack(chunks: list[int], counts: list[np.ndarray]) -> dict:
        return {"chunk": pa.array(chunks, pa.int32()), "counts": pa.array([c.astype("<i8").tobytes() for c in counts], pa.binary())}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(texts)
        seen, held, n = np.zeros(size, np.int64), np.zeros(BUCKETS, np.int64), 0
        for _, a, b, raw, off in _texts(batches, 0):
            start, h = term_hashes(raw, off)
            v, row = known.find(h), np.searchsorted(off, start, "right")
            some = v >= 0
            found, c = _rows_with(v[some], row[some])
            seen[found] += c
            held += np.bincount(np.unique(row[~some] * BUCKETS + _bucket(h[~some])) % BUCKETS, minlength=BUCKETS)
            n += b - a
        yield pa.RecordBatch.from_pydict(pack([*range(CHUNKS), CHUNKS], [*held.reshape(CHUNKS, -1), np.append(seen, n)]))

    def add(table: pa.Table) -> pa.Table:
        return pa.table(pack([table["chunk"][0].as_py()], [sum(np.frombuffer(x, "<i8") for x in table["counts"].to_pylist())]))

    rows = files.select(F.col(text_col).cast("string")).mapInArrow(count, schema).groupBy("chunk").applyInArrow(add, schema).collect()  # CHUNKS + 1 rows, BUCKETS numbers
    sums = {r.chunk: np.frombuffer(bytes(r.counts), "<i8") for r in rows}
    seen = sums.get(CHUNKS, np.zeros(size + 1, np.int64))
    held = np.concatenate([sums.get(k, np.zeros(BUCKETS // CHUNKS, np.int64)) for k in range(CHUNKS)])
    n = int(seen[-1])
    return n, np.log((1 + n) / (1 + seen[:-1])) + 1, (np.log((1 + n) / (1 + held)) + 1).astype(np.float32)


class Scorer:
    """Scores all parts of a step of texts against all templates."""

    def __init__(self, texts: list[tuple[str, str]], weights: np.ndarray, least: np.ndarray, threshold: float):
        self.known, self.weights, self.threshold = Known(texts), weights, threshold
        self.least = least.astype(float) ** 2 * (1 - 1e-6)
        number = {w: k for k, w in enumerate(self.known.words)}
        self.templates = np.zeros((len(number), len(texts)))
        marks = [number[w] for w in self.known.words if marking(w)]
        self.mark = np.full(len(number), -1)
        self.mark[marks] = np.arange(len(marks))
        needs, bars = np.zeros((len(marks), len(texts))), np.zeros((len(marks), len(texts)))
        for k, (_, text) in enumerate(texts):
            for w, c in Counter(terms(text)).items():
                self.templates[number[w], k] = c * weights[number[w]]
                if marking(w):
                    needs[self.mark[number[w]], k] = 1
            for w in MARKS - set(terms(text)):
                bars[self.mark[number[w]], k] = 1
        self.templates /= np.sqrt((self.templates**2).sum(0))
        self.most = self.templates.max(1)
        self.needs, self.bars, self.needed = needs, bars, needs.sum(0)

    def parts(self, unit: np.ndarray, v: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
        """(unit, sum of squares of the vocabulary, templates, dot products) of the units that may reach the threshold.  unit: of each term."""
        if not len(unit):
            return
        size = len(self.weights)
        some = v >= 0
        others = np.bincount(unit[~some], self.least[_bucket(h[~some])], int(unit.max()) + 1)
        key, c = np.unique(unit[some] * size + v[some], return_counts=True)
        u, v = key // size, key % size
        x = c * self.weights[v]
        squares = np.bincount(u, x * x, len(others))
        least = np.sqrt(squares + others)
        limit = (self.threshold - 1e-9) * least
        may = np.bincount(u, x * self.most[v], len(others)) >= np.maximum(limit, 1e-12)
        keep = may[u]
        u, v, x = u[keep], v[keep], x[keep]
        edge = np.r_[np.flatnonzero(np.r_[True, u[1:] != u[:-1]]), len(u)] if len(u) else np.zeros(1, np.int64)
        a = 0
        while a < len(edge) - 1:
            b = max(a + 1, int(np.searchsorted(edge, edge[a] + ENTRIES, "right")) - 1)
            s, e = edge[a], edge[b]
            dots = np.add.reduceat(x[s:e, None] * self.templates[v[s:e]], edge[a:b] - s, axis=0)
            have = np.zeros((b - a, len(self.needs)))
            m = self.mark[v[s:e]]
            row = np.repeat(np.arange(b - a), np.diff(edge[a : b + 1]))
            have[row[m >= 0], m[m >= 0]] = 1
            fits = (have @ self.needs == self.needed) & (have @ self.bars == 0)
            mine = u[edge[a:b]]
            for j in np.flatnonzero((fits & (dots >= limit[mine][:, None])).any(1)).tolist():
                k = np.flatnonzero(fits[j])
                yield int(mine[j]), float(squares[mine[j]]), k, dots[j, k]
            a = b

    def scan(self, raw: np.ndarray, off: np.ndarray) -> dict[int, list[tuple]]:
        """row -> (whole, squares, templates, dots, other terms, their counts) of each part that may reach the threshold."""
        start, h = term_hashes(raw, off)
        v = self.known.find(h)
        row = np.searchsorted(off, start, "right") - 1
        feeds = np.flatnonzero(raw == 10) + 1
        begin = np.unique(np.r_[off[:-1][off[:-1] < len(raw)], feeds[feeds < len(raw)]]) if len(raw) else np.zeros(0, np.int64)
        line = np.searchsorted(begin, start, "right") - 1
        if not len(begin):
            return {}
        ink = np.add.reduceat(~np.isin(raw, np.frombuffer(b" \t\r\n", np.uint8)), begin, dtype=np.int64)
        fresh = np.isin(begin, off) | (ink == 0)
        block = np.cumsum(fresh)[line]
        out: dict[int, list[tuple]] = {}
        for unit, whole in ((line, False), (block, False), (row, True)):
            order = None
            for u, squares, k, dots in self.parts(unit, v, h):
                if order is None:
                    order = np.argsort(unit, kind="stable")
                    sorted_unit = unit[order]
                mine = order[np.searchsorted(sorted_unit, u) : np.searchsorted(sorted_unit, u, "right")]
                rest, c = np.unique(h[mine[v[mine] < 0]], return_counts=True)
                out.setdefault(int(row[mine[0]]), []).append((whole, squares, k.tolist(), dots.tolist(), rest.view(np.int64).tolist(), c.tolist()))
        return out


PARTS = "array<struct<whole:boolean,squares:double,k:array<int>,dots:array<double>,other:array<long>,counts:array<int>>>"
_PARTS = pa.list_(pa.struct([("whole", pa.bool_()), ("squares", pa.float64()), ("k", pa.list_(pa.int32())), ("dots", pa.list_(pa.float64())), ("other", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))]))


def candidates(files: DataFrame, path_col: str, text_col: str, keep: list[str], texts: list[tuple[str, str]], weights: np.ndarray, least: np.ndarray, threshold: float) -> DataFrame:
    """keep, path, uid and parts (those that may reach the threshold) for every row."""
    kinds = {f.name: f.dataType.simpleString() for f in files.schema.fields}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + f"path string, uid long, parts {PARTS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, uid = Scorer(texts, weights, least, threshold), TaskContext.get().partitionId() << 40
        for batch, a, b, raw, off in _texts(batches, len(keep) + 1):
            found = scorer.scan(raw, off)
            parts = [[dict(zip(("whole", "squares", "k", "dots", "other", "counts"), p)) for p in found.get(j, ())] for j in range(b - a)]
            cols = [c.slice(a, b - a) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(range(uid, uid + b - a), pa.int64()), pa.array(parts, _PARTS)], names=[*keep, "path", "uid", "parts"])
            uid += b - a

    return files.select(*keep, F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def _counted(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["term", "n"])


def file_counts(files: DataFrame, text_col: str, needed: DataFrame) -> DataFrame:
    """(term, n): in how many files each needed term is."""
    n = needed.count()
    wanted = np.sort(np.array([r.term for r in needed.collect()], np.int64).view(np.uint64)) if n <= BROADCAST_IDS else None  # bounded by the count

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0 if wanted is None else len(wanted), np.int64)
        for _, _, _, raw, off in _texts(batches, 0):
            start, h = term_hashes(raw, off)
            row = np.searchsorted(off, start, "right")
            if wanted is None:
                yield _counted(*_rows_with(h, row))
            elif len(wanted):
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                some = wanted[at] == h
                found, c = _rows_with(at[some], row[some])
                total[found] += c
        if len(total):
            yield _counted(wanted[total > 0], total[total > 0])

    seen = files.select(F.col(text_col).cast("string")).mapInArrow(count, "term long, n long")
    return (seen if wanted is not None else with_ids(seen, needed, "term", "left_semi", n)).groupBy("term").agg(F.sum("n").alias("n"))


def _verdict(names: list[str], threshold: float, margin: float) -> Column:
    """The licence and score of a part, or null."""
    each = F.transform(F.arrays_zip("k", "dots"), lambda x: F.struct(F.round(x["dots"] / F.col("norm"), 9).alias("s"), F.get(F.array(*map(F.lit, names)), x["k"]).alias("l")))
    best = lambda x: F.array_max(x)

    def judged(x: Column) -> Column:
        top = best(x)
        second = best(F.filter(x, lambda y: y["l"] != F.array_max(x)["l"]))
        return F.when((top["s"] >= threshold) & (second.isNull() | (top["s"] - second["s"] >= margin)), top)

    return F.element_at(F.transform(F.array(each), judged), 1)


def scan(files: DataFrame, path_col: str, text_col: str, keep: list[str], threshold: float = THRESHOLD, margin: float = MARGIN, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """keep, path, license, score, whole for every row."""
    texts = texts or templates()
    n, weights, least = term_weights(files, text_col, texts)
    found = stash(candidates(files, path_col, text_col, keep, texts, weights, least, threshold), "parts")
    parts = found.where(F.size("parts") > 0).select("uid", F.posexplode("parts").alias("part", "p")).select("uid", "part", "p.*")
    others = parts.select("uid", "part", F.explode(F.arrays_zip("other", "counts")).alias("o")).select("uid", "part", F.col("o.other").alias("term"), F.col("o.counts").alias("c"))
    needed = stash(others.select("term").distinct(), "terms")
    counts = stash(file_counts(files, text_col, needed), "counts")
    few = counts.count() <= BROADCAST_IDS
    weight = F.col("c") * (F.log((1.0 + n) / (1 + F.col("n"))) + 1)
    norms = others.join(F.broadcast(counts) if few else counts, "term").groupBy("uid", "part").agg(F.sum(weight * weight).alias("rest"))
    scored = parts.join(norms, ["uid", "part"], "left").withColumn("norm", F.sqrt(F.col("squares") + F.coalesce("rest", F.lit(0.0))))
    scored = scored.select("uid", "whole", _verdict([name for name, _ in texts], threshold, margin).alias("v")).where("v is not null")
    first = F.min(F.struct(F.col("v.l") == RESERVED, -F.col("v.s"), "v.l"))
    best = scored.groupBy("uid").agg(first.alias("best"), F.max("whole").alias("whole"))
    best = best.select("uid", F.col("best.l").alias("license"), (-F.col("best.col2")).alias("score"), "whole")
    return found.drop("parts").join(best, "uid", "left").withColumn("whole", F.coalesce("whole", F.lit(False))).drop("uid")


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD, margin: float = MARGIN, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """keep, path, license, score, origin ('own', 'inherited' or null) and the directory that it is inherited from.

    texts: (licence, text) templates, such as full texts, in place of the built-in ones.
    """
    keep = list(keep or [])
    found = stash(scan(files, path_col, text_col, keep, threshold, margin, texts), "licenses")
    steps = F.split("path", "/")
    folder = F.array_join(F.slice(steps, 1, F.size(steps) - 1), "/")
    speaks = (F.col("whole") | F.element_at(steps, -1).rlike(NAMED)) & (F.col("license") != RESERVED)
    order = F.struct(F.col("score").alias("s"), F.col("license").alias("l"))
    folders = stash(found.where(speaks).groupBy(folder.alias("folder")).agg(F.max(order).alias("o")).select("folder", F.col("o.l").alias("folder_license")), "folders")
    small = folders.count() <= BROADCAST_IDS
    paths = found.where("license is null").select("path").distinct()
    depth = F.size(steps) - 1
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("folder")))).alias("a")).select("path", "a.depth", "a.folder")
    near = above.join(F.broadcast(folders) if small else folders, "folder").groupBy("path").agg(F.max(F.struct("depth", "folder", "folder_license")).alias("near")).select("path", "near.folder", "near.folder_license")
    own = F.col("license").isNotNull()
    out = found.join(near, "path", "left")
    inherited = ~own & F.col("folder_license").isNotNull()
    return out.select(*keep, "path", F.coalesce("license", "folder_license").alias("license"), F.round("score", 6).alias("score"), F.when(own, "own").when(inherited, "inherited").alias("origin"), F.when(inherited, F.col("folder")).alias("inherited_from"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def license_sql(threshold: float = THRESHOLD, margin: float = MARGIN) -> str:
    """The rows of the query over `documents` in DuckDB: all parts with all templates."""
    values = ", ".join(f"({k}, {_quoted(name)}, {_quoted(text)})" for k, (name, text) in enumerate(templates()))
    marks = ", ".join(map(_quoted, sorted(MARKS)))
    return f"""
WITH tmpl(k, license, body) AS (VALUES {values}),
files AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', coalesce(source, ''), coalesce(lang, ''), doc_id || '.txt') AS path FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM files),
blocks AS (SELECT doc_id, line, pos, sum(CASE WHEN regexp_full_match(line, '[ \\t\\r]*') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM lines),
tok AS (SELECT doc_id, pos, block, lower(unnest(regexp_extract_all(line, '[A-Za-z0-9]+'))) AS t FROM blocks),
n AS (SELECT count(*) AS n FROM files),
df AS (SELECT t, count(DISTINCT doc_id) AS df FROM tok GROUP BY t),
words AS (SELECT k, license, lower(unnest(regexp_extract_all(body, '[A-Za-z0-9]+'))) AS t FROM tmpl),
tt AS (SELECT k, license, t, count(*) * (ln((1.0 + n) / (1 + coalesce(df, 0))) + 1) AS x, ln((1.0 + n) / (1 + coalesce(df, 0))) + 1 AS w, (t IN ({marks}) OR regexp_full_match(t, '[0-9][0-9]?')) AS needed
       FROM words LEFT JOIN df USING (t), n GROUP BY k, license, t, df, n),
tn AS (SELECT k, any_value(license) AS license, sqrt(sum(x * x)) AS size, count(*) FILTER (needed) AS needed, list(t) AS have FROM tt GROUP BY k),
part AS (SELECT doc_id, 'line' AS kind, pos AS part, t, count(*) AS c FROM tok GROUP BY ALL UNION ALL SELECT doc_id, 'block', block, t, count(*) FROM tok GROUP BY ALL UNION ALL SELECT doc_id, 'file', 0, t, count(*) FROM tok GROUP BY ALL),
pn AS (SELECT doc_id, kind, part, sqrt(sum(pow(c * (ln((1.0 + n) / (1 + df)) + 1), 2))) AS size, list(t) FILTER (t IN ({marks})) AS marks FROM part JOIN df USING (t), n GROUP BY ALL),
dots AS (SELECT doc_id, kind, part, k, sum(c * w * x) AS dot, count(*) FILTER (needed) AS needed FROM part JOIN tt USING (t) GROUP BY ALL),
sims AS (SELECT d.doc_id, d.kind, d.part, tn.license, max(round(dot / (pn.size * tn.size), 9)) AS s FROM dots d JOIN pn USING (doc_id, kind, part) JOIN tn USING (k)
         WHERE d.needed = tn.needed AND NOT list_has_any(list_filter(coalesce(pn.marks, []), lambda m: NOT list_contains(tn.have, m)), [{marks}]) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER w AS place, lead(s) OVER w AS second FROM sims WINDOW w AS (PARTITION BY doc_id, kind, part ORDER BY s DESC, license)),
good AS (SELECT * FROM ranked WHERE place = 1 AND s >= {threshold} AND (second IS NULL OR s - second >= {margin})),
best AS (SELECT doc_id, arg_min(license, {{'r': license = {_quoted(RESERVED)}, 's': -s, 'l': license}}) AS license, -(min({{'r': license = {_quoted(RESERVED)}, 's': -s, 'l': license}}).s) AS score, bool_or(kind = 'file') AS whole FROM good GROUP BY doc_id),
found AS (SELECT f.doc_id, f.path, array_to_string(string_split(f.path, '/')[:-2], '/') AS folder, b.license, b.score, coalesce(b.whole, false) AS whole FROM files f LEFT JOIN best b USING (doc_id)),
folders AS (SELECT folder, max({{'s': score, 'l': license}}).l AS folder_license FROM found WHERE whole AND license <> {_quoted(RESERVED)} GROUP BY folder),
near AS (SELECT f.doc_id, arg_max(g.folder, length(g.folder)) AS folder, arg_max(g.folder_license, length(g.folder)) AS folder_license FROM found f JOIN folders g ON g.folder = '' OR starts_with(f.path, g.folder || '/') WHERE f.license IS NULL GROUP BY f.doc_id)
SELECT doc_id, path, coalesce(license, folder_license) AS license, round(score, 6) AS score, CASE WHEN license IS NOT NULL THEN 'own' WHEN folder_license IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN license IS NULL THEN near.folder END AS inherited_from
FROM found LEFT JOIN near USING (doc_id)
"""
