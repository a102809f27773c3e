"""The corpus pipeline: quality rules, near-dedup, repeat removal, decontamination and packing, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_IDS, stash, table, with_ids
from tessera.llm.decontaminate import decontaminate
from tessera.llm.minhash import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.quality import good_rows, trusted_ids
from tessera.llm.queries import tokenizer_path
from tessera.llm.suffix_dedup import remove_repeats
from tessera.session import ship_package

#: The packing and the hashed features have no counterpart in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    return next(n for n in (name, *(f"{name}{k}" for k in range(len(docs.columns)))) if n not in docs.columns)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key that is never null and the same for equal rows of (doc_id, text) only: the id where no other row has it."""
    key, mark = _free(docs, "_key"), _free(docs, "_again")
    again = stash(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias(mark)), "again")
    n = again.count()
    if not n:
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    found = again.withColumn(f"{mark}_", F.lit(True))
    both = docs.join(F.broadcast(found) if n <= BROADCAST_IDS else found, docs["doc_id"].eqNullSafe(found[mark]), "left")
    other = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 61)) + F.lit(1 << 62)
    return both.withColumn(key, F.when(F.col(f"{mark}_"), other).otherwise(F.col("doc_id").cast("long"))).drop(mark, f"{mark}_"), key


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return with_ids(docs, stash(gone.select(F.col("doc_id").alias(key)).distinct(), "dropped"), key, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return good_rows(docs, trusted_ids(table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; of rows with the same id and text, one."""
    ship_package(spark)
    rows, key = keyed(docs)
    judged = near_duplicates(rows, id_col=key, size=5, percent=80)
    kept = _without(rows, key, judged.where(~F.col("kept")))
    single = F.col(key) < (1 << 62)
    return kept.where(single).unionByName(kept.where(~single).dropDuplicates([key])).drop(key)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the bytes that a document of a smaller id holds; a document that has nothing left goes."""
    ship_package(spark)
    rows, key = keyed(docs)
    cut = _free(docs, "_cut")
    left = remove_repeats(rows, id_col=key, texts=True).where("n_removed > 0")
    changed = stash(left.select(F.col("doc_id").alias(key), F.struct("text", "n_bytes", "n_removed").alias(cut)), "left").dropDuplicates([key])
    ids = changed.select(key)
    n = ids.count()
    # the texts that were cut come from the table just written, so no text is shuffled again
    rest = with_ids(rows, ids, key, "left_semi", n).drop("text").join(changed, key).where(F.col(f"{cut}.n_bytes") > F.col(f"{cut}.n_removed"))
    text = F.col(f"{cut}.text")
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    rest = rest.select([new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
    return with_ids(rows, ids, key, "left_anti", n).select(docs.columns).unionByName(rest)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rows, key = keyed(docs)
    return decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=key).drop(key)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", benchmark_free),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, "stage")
    return docs
