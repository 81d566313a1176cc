"""A corpus pipeline of five training-data operators over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns documents with the columns
of the table (the last adds tokens); ``run`` writes each stage's result as
Parquet in the shared folder and hands the stored table to the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.llm import bpe, decontaminate, exact_dedup, langid, simhash
from veilgrain.workspace import Workspace, ensure_importable, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the compressors can't tell."""
    ensure_importable(spark)
    return langid.drop_rejected(docs, langid.learn(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_copies(docs, Workspace(spark, "exact"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays."""
    ensure_importable(spark)
    return simhash.drop_near_copies(docs, Workspace(spark, "near"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row (or the whole) of a benchmark item."""
    ensure_importable(spark)
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of every whole text, their number and a digest of the text decoded from them; columns of these names are replaced."""
    ensure_importable(spark)
    docs = docs.drop("ids", "n_tokens", "decoded_sha256")
    decoded = f"_decoded_{uuid.uuid4().hex}"  # a name that no column of the documents has
    done = bpe.round_trip(docs, bpe.Vocabulary.load(bpe.default_path()), decoded_col=decoded)
    return done.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decoded, 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", decontaminated),
    ("bpe_encoding", tokenised),
]

#: Compression, fingerprints and merges have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return docs
