"""The thin queries over whole tables: name -> f(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import importance, language_id, ngram_lm, ogg, packing, pii, prefix_trie, quality_classifier, quality_rules, revisit, secret_scan, sentencepiece_codec, simhash


def tokenizer(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.query(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.query(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.query(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.query(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisit.query(_table(spark, sf_dir, "pages"))


def op10_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.query(_table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(_table(spark, sf_dir, "documents"), pii.labelled(spark))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.query(_table(spark, sf_dir, "conversations"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_sentencepiece, op3_secret_scan, op4_simhash, op5_packing, op6_ogg_media, op7_quality_rules, op8_quality_classifier, op9_warc_revisit, op10_ngram_lm,
        op11_pii, op12_prefix_trie, op13_importance,
    )
}

#: DuckDB SQL where it can express a query.
ORACLE_SQL: dict[str, str] = {"op9_warc_revisit": revisit.ORACLE_SQL, "op13_importance": importance.ORACLE_SQL}
