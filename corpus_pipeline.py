"""A training corpus from raw documents, stage by stage.

Every stage works on all rows that the one before kept; all but the last
return the columns of documents. The quality stages drop what they reject, the
near-duplicate stage keeps the document with the smallest id of its component,
secrets are replaced in the text, and the last stage returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.llm import packing, quality_classifier, quality_rules, secret_scan, simhash
from marlspark.llm.common import materialize, pick
from marlspark.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.kept(pick(docs, *COLUMNS), labels)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a limit or are outliers go."""
    return quality_rules.kept(pick(docs, *COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: of the smallest doc_id (null after all others) the first."""
    # doc_ids may be null or repeat: stored rows have a key of their own
    rows = materialize(pick(docs, *COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = simhash.near_duplicates(rows.withColumn("doc_id", F.col("row"))).withColumnRenamed("doc_id", "row")
    found = materialize(found.join(rows.select("row", "doc_id"), "row"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    stays = found.groupBy("component_id").agg(first.alias("first")).select("first.row")
    return rows.join(stays, "row", "left_semi").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", pack),
]

#: SQL can't express the stages; a brute-force version tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each over the written rows of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
