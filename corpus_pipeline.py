"""A corpus pipeline of five stages, each one operator of tessera.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet in
the folder that all executors share and reads it again as the next stage's docs. All stages but the last
return the columns of documents; the last adds what the mix takes of each document. Every stage decides
each row; rows that share an id are told apart by their texts, a null id is an id like others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dups, mixing, shingle_dups, toxicity_net
from tessera.llm._arrow import ensure_checkpoint_dir

#: Score from which a document is rejected as toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC. The network learns from all labelled documents of the table."""
    net = toxicity_net.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_net.with_scores(docs, net, "__toxicity").where(F.col("__toxicity") < TOXIC).drop("__toxicity")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are near-copies of a line that stands before."""
    cleaned = line_dups.dedup_lines(docs)
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns]).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id: SimHash candidates, then five-word Jaccard similarity of 0.8 or more.

    A set join finds the links that SimHash leaves apart.
    """
    return shingle_dups.keep_one(docs, shingle=5, similarity=(4, 5))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't cover a benchmark item."""
    # Rows that share an id, a null one too, are told apart by a hash of their text.
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("tag")).alias("row"), "text")
    found = decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row").where("contaminated")
    dirty = found.select(F.col("row.doc_id").alias("__dirty"), F.col("row.tag").alias("__tag")).distinct()
    return docs.join(dirty, F.col("doc_id").eqNullSafe(F.col("__dirty")) & (F.xxhash64("text") == F.col("__tag")), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their size, their source's size and target, and the words the mix takes."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The network and the tiling can't be put in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
