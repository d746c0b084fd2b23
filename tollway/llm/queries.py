"""One query for each operator of this package, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.llm import (
    conversation_repair,
    decontamination,
    html_extraction,
    jaccard_join,
    language_id,
    lexical_search,
    line_dedup,
    mixing,
    quality_rules,
    secret_scan,
    suffix_dedup,
    token_counts,
    toxicity,
)
from tollway.llm.columns import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.scan(table(spark, sf_dir, "documents"), path_col="doc_id")
    kinds = [rule.kind for rule in secret_scan.BASE_RULES]
    base = F.filter("spans", lambda s: s["rule"].isin(kinds))

    def count(kind: str):
        n = F.size(F.filter("spans", lambda s: s["rule"] == kind))
        return n.cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id",
        *[count(kind) for kind in kinds],
        F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"),
        secret_scan.as_text(F.col("spans")).alias("spans"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = quality_rules.fails(quality_rules.BASE)
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~(base | quality_rules.fails(quality_rules.FULL))).alias("kept"),
        "failed",
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_earlier(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(language_id.remainder("doc_id") == 0, F.lit(False))
    found = language_id.predict(docs, language_id.train(docs))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_repeats(docs)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, table(spark, sf_dir, "labels")).drop("text")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's audit after some of its turns were damaged."""
    conversations = table(spark, sf_dir, "conversations")
    told = conversation_repair.audit(conversation_repair.damaged(conversations))
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    every = conversations.select(F.col("conv_id").alias("every")).distinct()
    return every.join(told, F.col("every").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("every").alias("conv_id"),
        *[F.coalesce(c, empty.get(c, F.lit(0))).alias(c) for c in told.columns if c != "conv_id"],
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.remainder("doc_id") == 2, F.lit(False))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )


def llm_queries() -> dict[str, Query]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_secret_scans": op2_secret_scans,
        "op3_quality_rules": op3_quality_rules,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_token_counts": op5_token_counts,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_language_id": op7_language_id,
        "op8_line_dedup": op8_line_dedup,
        "op9_mixing": op9_mixing,
        "op10_html_extraction": op10_html_extraction,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_lexical_search": op12_lexical_search,
        "op13_toxicity": op13_toxicity,
    }
