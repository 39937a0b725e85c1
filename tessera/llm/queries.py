"""The registered queries of the text operators and their SQL; thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_rules import fit, score_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc32_of("doc_id") % 5 != 0)
    scored = score_documents(docs, fit(docs, labels, label_col="quality"))
    return scored.select("doc_id", (crc32_of("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_line_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dups import dedup_lines

    cleaned = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.audio_features import media_features

    stored = media_features(table(spark, sf_dir, "documents").select("doc_id", "text"))
    payload = F.expr("substring(media, cast(data_offset + 1 as int), cast(data_bytes as int))")
    means = F.array_join(F.transform("mel_mean", lambda x: F.round(x * 100).cast("int").cast("string")), ",")
    return stored.select(
        "doc_id",
        "n_bytes",
        F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(media, cast(data_offset + data_bytes - 31 as int), 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", F.col("n_frames").cast("string"), F.size("segments").cast("string"), means).alias("feature"),
    )


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_items", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), F.round("coverage", 6).alias("coverage"), "contaminated"
    )


def op8_suffix_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_dups import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_simhash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_toxicity_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity_net import fit, score_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels").where(crc32_of("doc_id") % 4 != 2))
    scored = score_documents(docs, net)
    return scored.select("doc_id", (crc32_of("doc_id") % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_line_dups, op3_html_text, op4_audio_features, op5_mix_sources, op6_token_counts, op7_decontaminate, op8_suffix_dups, op9_simhash_dups, op10_toxicity_net)}


def oracle_sql() -> dict[str, str]:
    from tessera.llm.mixing import MIX_SQL

    return {"op5_mix_sources": MIX_SQL}
