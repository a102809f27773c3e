"""Quality rules: a hashed n-gram log-likelihood ratio with base rules, in DataFrame functions only.

Words and pairs of neighbouring words are hashed into a fixed number of buckets.  Two multinomials
over the buckets, one of the trusted documents and one of the whole corpus, give each bucket a log
ratio; the trusted one is smoothed towards the corpus, so a bucket without evidence has a ratio near 0
and the threshold means the same at every size.  A document's score is the mean ratio of its features;
a document is kept if the score reaches the threshold and no base rule fails.  Only the bucket table (a
fixed number of rows) leaves the executors.

Defined results: a null or empty text has no words and fails the base rule; without trusted
documents every ratio is 0 and only the base rules decide; repeated rows are judged one by one;
null ids stay null and are never trusted; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import BROADCAST_IDS

BUCKETS = 1 << 16
#: Features that a bucket is taken to have seen at the corpus's rate beside the trusted documents' own.
PRIOR = 20.0
#: Clean documents score above; symbol noise, shouting and lists score below, the further the more trusted text there is.
THRESHOLD = -0.08
MIN_WORDS = 20
RUN = 8
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def checksums(w: Column) -> Column:
    return F.transform(w, lambda x: F.crc32(x.cast("binary")))


def features(checksums: Column, buckets: int) -> Column:
    """Buckets of every word, by its checksum, and of every word with its successor (the last with none)."""
    n = F.lit(buckets).cast("long")
    pair = F.transform(checksums, lambda x, i: F.pmod(x * 40503 + F.coalesce(F.get(checksums, i + 1), F.lit(-1).cast("long")), n).cast("int"))
    return F.concat(F.transform(checksums, lambda x: F.pmod(x, n).cast("int")), pair)


def repeated_words(hashes: Column, run: int = RUN) -> Column:
    """Words in windows of run words that occur twice or more."""
    n = F.size(hashes)
    windows = F.transform(F.slice(hashes, 1, F.greatest(n - (run - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, run)]))

    def covered(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.filter(F.transform(s, lambda e, i: F.when(same(e, i - 1) | same(e, i + 1), e["i"]).otherwise(-1)), lambda p: p >= 0))

        def length(p: Column) -> Column:
            each = F.transform(p, lambda e, k: F.least(F.lit(run), F.coalesce(F.get(p, k + 1) - e, F.lit(run))).cast("long"))
            return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)

        total = let(pairs, lambda s: let(marked(s), length))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(total)

    return let(windows, covered)


def bucket_ratios(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """One row: the array of the buckets' log ratios log((t + prior) / (T raw / N + prior)).  trusted: a table of ids."""
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("_id")).where("_id is not null").distinct().withColumn("_t", F.lit(1).cast("long"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    base = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text")).join(ids, "_id", "left")
    found = base.select(F.coalesce("_t", F.lit(0).cast("long")).alias("t"), F.explode(let(checksums(words(F.col("_text"))), lambda h: features(h, buckets))).alias("bucket"))
    counts = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "target"])
    whole = Window.partitionBy()
    rate = F.sum("target").over(whole) / F.greatest(F.sum("raw").over(whole), F.lit(1))
    ratio = F.log((F.col("target") + prior) / (F.col("raw") * rate + prior))
    pairs = every.select(F.struct("bucket", ratio.alias("ratio")).alias("p"))
    return pairs.agg(F.sort_array(F.collect_list("p"))["ratio"].alias("ratios"))


def figures(text: Column, ratios: Column, buckets: int, all_of_them: bool = True) -> Column:
    """A struct of the base rules' figures (or only those that the verdict needs) and the score, each text being split and hashed once."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        score = lambda f: let(ratios, lambda r: F.aggregate(f, F.lit(0.0), lambda a, b: a + F.get(r, b))) / F.greatest(F.size(f), F.lit(1))
        needed = [
            F.size(w).cast("long").alias("n_words"),
            let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: repeated_words(h)).alias("n_repeat_words"),
            let(checksums(w), lambda c: let(features(c, buckets), score)).alias("llr"),
        ]
        more = [
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ]
        return F.struct(*needed, *(more if all_of_them else []))

    return let(words(text), of_words)


def failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """A row for each row of docs: the base rules' figures, the score and the verdict."""
    ratios = bucket_ratios(docs, trusted, id_col, text_col, buckets).scalar()
    out = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"), ratios.alias("_ratios"))
    out = out.select("doc_id", figures(F.col("_text"), F.col("_ratios"), buckets).alias("f"))
    f = F.col("f")
    return out.select(
        "doc_id", "f.n_words", "f.word_chars", "f.n_symbols", "f.n_dup_lines", "f.n_repeat_words",
        failed(f).alias("base_failed"), (~failed(f) & (f["llr"] >= threshold)).alias("kept"), f["llr"].alias("llr"),
    )


def good_rows(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The rows of docs that `quality` keeps, with all their columns: each row is judged where it stands, by one expression."""
    name = next(n for n in ("_ratios", *(f"_ratios{k}" for k in range(len(docs.columns)))) if n not in docs.columns)
    held = docs.withColumn(name, bucket_ratios(docs, trusted, id_col, text_col, buckets).scalar())
    verdict = let(figures(F.col(text_col), F.col(name), buckets, all_of_them=False), lambda f: ~failed(f) & (f["llr"] >= threshold))
    return held.where(verdict).drop(name)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled as good and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")
