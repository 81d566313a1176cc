"""Label-wise hash batches, their ids and descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.functions.hashing import bucket_key, hash_bucket
from veilgrain.operators.prefix import running
from veilgrain.workspace import Workspace


#: Labels whose counts are sent to every executor; more are joined by a shuffle.
MOST_LABELS = 10_000


def assign_buckets(examples: DataFrame, batch_size: int, num_batches: int | None = None) -> DataFrame:
    """``examples`` (example_id, text, label) with ``bucket``.

    A label of n rows has max(1, ceil(n / batch_size)) buckets, so one more row
    may move others; a fixed ``num_batches`` avoids that.
    """
    if num_batches is not None:
        return examples.withColumn("bucket", hash_bucket(bucket_key(F.col("label"), F.col("text")), F.lit(num_batches)))
    buckets = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / batch_size)).cast("long")
    counts = examples.groupBy(F.col("label").alias("_label")).agg(buckets.alias("_n"))
    few = counts.limit(MOST_LABELS + 1).collect()
    if len(few) <= MOST_LABELS:  # as ever with a vocabulary of labels: a row a label goes to the examples, not they to one task a label
        counts = F.broadcast(examples.sparkSession.createDataFrame(few, counts.schema))
    joined = examples.join(counts, examples["label"].eqNullSafe(counts["_label"]))
    return joined.withColumn("bucket", hash_bucket(bucket_key(F.col("label"), F.col("text")), F.col("_n"))).drop("_label", "_n")


def batch_table(bucketed: DataFrame, dataset: str) -> DataFrame:
    """(label, bucket, batch_id, batch_size): the id is the SHA-256 of dataset, label and sorted texts.

    Equal texts are counted before the shuffle and only written out for the digest.
    """
    counted = bucketed.groupBy("label", "bucket", "text").agg(F.count(F.lit(1)).cast("int").alias("n"))
    grouped = counted.groupBy("label", "bucket").agg(
        F.array_sort(F.collect_list(F.struct("text", "n"))).alias("t"), F.sum("n").cast("int").alias("batch_size")
    )
    texts = F.flatten(F.transform("t", lambda s: F.array_repeat(s["text"], s["n"])))
    key = F.concat(F.lit(f"{dataset}\n"), F.col("label").cast("string"), F.lit("\n"), F.array_join(texts, "\n"))
    return grouped.select("label", "bucket", F.sha2(key, 256).alias("batch_id"), "batch_size")


def describe_batches(batches: DataFrame, dataset: str, ws: Workspace) -> DataFrame:
    """Descriptors: batch_id, batch_index (from 1, by label and bucket), total_batches, label, label_name, batch_size."""
    from veilgrain.sources.catalog import named

    numbered = running(batches, ws, [], ["label", "bucket"], sums={"batch_index": "1"})
    total = batches.agg(F.count(F.lit(1)).cast("int").alias("total_batches"))  # one row
    joined = named(numbered, dataset).crossJoin(F.broadcast(total))
    return joined.select(
        "batch_id", F.col("batch_index").cast("int").alias("batch_index"), "total_batches", "label", "label_name", "batch_size", "bucket"
    )


def members(bucketed: DataFrame, ws: Workspace) -> DataFrame:
    """(label, bucket, ordinal, example_id): place in the batch by text, then id, from 1."""
    placed = running(bucketed, ws, ["label", "bucket"], ["text", "example_id"], sums={"ordinal": "1"})
    return placed.select("label", "bucket", F.col("ordinal").cast("int").alias("ordinal"), "example_id")


def pending(descriptors: DataFrame, commits: DataFrame) -> DataFrame:
    """Descriptors whose batch is not committed; indices are those of the whole run."""
    return descriptors.join(commits.select("batch_id").distinct(), "batch_id", "left_anti")
