"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.session import ship_package


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language_model import score_texts

    scored = score_texts(table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quotes import chat

    return chat(table(spark, sf_dir, "conversations"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import license_scan

    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan(docs.select("doc_id", "text", path.alias("path")), keep=["doc_id"])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import quality, trusted_ids

    judged = quality(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))
    return judged.withColumn("llr", F.round("llr", 6))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sentence_spans import drop_repeated_spans

    return drop_repeated_spans(table(spark, sf_dir, "documents"), grow=True)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.main_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.byte_bpe import read_ranks, round_trip

    return round_trip(table(spark, sf_dir, "documents"), read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def _shipping(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    run.__name__ = f.__name__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipping(f) for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from tessera.llm.filter_audit import AUDIT_SQL
    from tessera.llm.licenses import license_sql
    from tessera.llm.minhash import NEAR_SQL
    from tessera.llm.oracles import LANGUAGE_SQL, REPEATS_SQL, quality_sql
    from tessera.llm.quality import BUCKETS, PRIOR, RUN, THRESHOLD
    from tessera.llm.quotes import CHAT_SQL
    from tessera.llm.spelling import VARIANTS_SQL

    return {"op1_language_model": LANGUAGE_SQL, "op9_suffix_dedup": REPEATS_SQL, "op2_quotes": CHAT_SQL, "op5_quality": quality_sql(THRESHOLD, PRIOR, BUCKETS, RUN), "op4_licenses": license_sql(), "op6_minhash": NEAR_SQL, "op11_filter_audit": AUDIT_SQL, "op12_spelling": VARIANTS_SQL}
