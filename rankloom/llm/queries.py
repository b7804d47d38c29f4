"""One query an operator, over the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels

#: A folder of public vocabularies; the package of that name has its place.
TOKENIZERS = None


def vocabulary(name: str, folder: str | None = TOKENIZERS) -> str:
    import public_tokenizers

    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).filter("quality = 1").select("doc_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    groups = simhash_groups(documents(spark, sf_dir), shingle=3, radius=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    rows = dedup_lines(documents(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    rows = token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), pattern())
    return rows.withColumn("over_limit", F.col("n_tokens") > 512)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict, train

    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = train(docs.filter(~held_out & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    rows = predict(docs, model)
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), length=2048, end=0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality

    return quality(documents(spark, sf_dir), trusted(spark, sf_dir))


def op7_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import classify

    rows = classify(documents(spark, sf_dir), trusted(spark, sf_dir))
    return rows.select("doc_id", "lang", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "kept")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import with_row, written
    from .editprint import compared, near_groups

    docs = documents(spark, sf_dir)
    rows = written(compared(docs), "compared")
    return with_row(rows, near_groups(docs, rows), "inner").drop("rid")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    return dedup_substrings(documents(spark, sf_dir), window=50).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_simhash_near_dedup, op2_line_dedup, op3_token_counts, op4_language_id, op5_best_fit_packing,
            op6_quality_rules, op7_byte_level_bpe, op8_quality_classifier, op9_document_fingerprints, op10_substring_dedup,
        )
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
