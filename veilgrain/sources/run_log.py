"""Run logs: reading and writing JSON-lines checkpoints, and a committed table of batches.

A log has a ``_metadata`` header, example rows and ``_batch_complete`` markers.
Where there is any marker only batches with one count, in the order of their
markers; what follows the first broken line is not read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA = (
    "dataset string, epsilon double, delta double, batch_size int, clip_bound double, temperature double, public_temperature double, "
    "svt_threshold double, svt_noise double, top_k_vocab int, max_private_tokens int, max_total_tokens int, num_source_examples long, "
    "seed long, micro_batch_size int, output_path string, checkpoint_format int"
)
MARKER = "batch_id string, batch_index int, total_batches int, label int, label_name string, batch_size int, num_examples int"
EXAMPLE = (
    "text string, label int, label_name string, num_private_tokens int, num_public_tokens int, num_total_tokens int, "
    "batch_id string, batch_index int, total_batches int, source_batch_size int"
)
LINE = f"_metadata struct<{METADATA.replace(' ', ':').replace(',:', ',')}>, _batch_complete struct<{MARKER.replace(' ', ':').replace(',:', ',')}>, {EXAMPLE}, _broken string"
#: What two runs must share to go on with one another's batches.
COMPATIBLE = tuple(f.split()[0] for f in METADATA.split(", ") if f.split()[0] not in ("epsilon", "output_path", "checkpoint_format"))


@dataclass
class RunLog:
    """The parts of a log: header, examples that count, markers, and descriptors of every batch seen."""

    metadata: DataFrame
    examples: DataFrame
    commits: DataFrame
    descriptors: DataFrame


def read_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Parsed lines with ``pos``, their order in the file. Strict: nothing from the first broken line on; else only broken lines go.

    The order is (block, place in the block), so a file of many splits stays in order.
    """
    raw = spark.read.text(path).select(
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("at")).alias("pos"),
        F.trim("value").alias("value"),
    )
    options = {"columnNameOfCorruptRecord": "_broken", "allowNonNumericNumbers": "true"}
    parsed = raw.filter(F.col("value") != "").select("pos", F.from_json("value", LINE, options).alias("r"))
    broken = F.col("r").isNull() | F.col("r._broken").isNotNull()
    if not strict:
        return parsed.filter(~broken).select("pos", "r.*").drop("_broken")
    first = parsed.agg(F.min(F.when(broken, F.col("pos"))).alias("_first"))  # one row
    kept = parsed.crossJoin(F.broadcast(first)).filter(F.col("_first").isNull() | (F.col("pos") < F.col("_first")))
    return kept.select("pos", "r.*").drop("_broken")


def commit_join(rows: DataFrame, markers: DataFrame) -> DataFrame:
    """Example rows of committed batches, once for each marker: (marker_pos, rows' columns)."""
    marks = markers.select(F.col("batch_id"), F.col("pos").alias("marker_pos"))
    return rows.join(marks, "batch_id")


def recover_descriptors(rows: DataFrame, markers: DataFrame) -> DataFrame:
    """A descriptor for every batch seen, from its last marker or else from its rows."""
    fields = ("batch_index", "total_batches", "label", "label_name", "batch_size")
    marked = markers.groupBy("batch_id").agg(F.max_by(F.struct(*fields), "pos").alias("m"))
    seen = rows.filter("batch_id IS NOT NULL").groupBy("batch_id").agg(
        F.min_by(F.struct("batch_index", "total_batches", "label", "label_name", F.coalesce("source_batch_size", F.lit(0)).alias("batch_size")), "pos").alias("e")
    )
    both = marked.join(seen, "batch_id", "full_outer")
    return both.select("batch_id", *[F.coalesce(f"m.{f}", f"e.{f}").alias(f) for f in fields], F.col("m").isNotNull().alias("committed"))


def read_log(spark: SparkSession, path: str, strict: bool = True) -> RunLog:
    lines = read_lines(spark, path, strict)
    metadata = lines.filter("_metadata IS NOT NULL").select("pos", "_metadata.*")
    markers = lines.filter("_batch_complete IS NOT NULL").select("pos", "_batch_complete.*")
    rows = lines.filter("_metadata IS NULL AND _batch_complete IS NULL").drop("_metadata", "_batch_complete")
    if markers.limit(1).count():
        examples = commit_join(rows, markers).orderBy("marker_pos", "pos").drop("marker_pos")
    else:
        examples = rows.orderBy("pos")
    return RunLog(metadata, examples, markers, recover_descriptors(rows, markers))


def _number(value: float) -> str:
    return {float("inf"): "Infinity", float("-inf"): "-Infinity"}.get(value, json.dumps(value))


def header_line(metadata: dict) -> str:
    """The header; infinities are written as bare words, as other readers of such logs expect."""
    fields = ", ".join(f"{json.dumps(k)}: {_number(v) if isinstance(v, float) else json.dumps(v)}" for k, v in metadata.items())
    return '{"_metadata": {' + fields + "}}"


def example_lines(examples: DataFrame, with_source_size: bool = True) -> DataFrame:
    """``examples`` with ``line``."""
    names = [f.name for f in T._parse_datatype_string(EXAMPLE).fields]
    names = names if with_source_size else names[:-1]
    return examples.withColumn("line", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))


def marker_lines(descriptors: DataFrame) -> DataFrame:
    """``descriptors`` (with num_examples) with ``line``."""
    names = [f.name for f in T._parse_datatype_string(MARKER).fields]
    return descriptors.withColumn("line", F.to_json(F.struct(F.struct(*names).alias("_batch_complete"))))


def write_log(lines: DataFrame, path: str, order: list[str]) -> None:
    """One file of (order..., line), in order. A log is one file by its format; large runs use ``BatchTable``."""
    lines.repartition(1).sortWithinPartitions(*order).select("line").write.mode("errorifexists").text(path)


def compatible(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two headers agree in all that matters (nulls agree with nulls), and the fields that differ."""
    x, y = a.select(F.struct(*COMPATIBLE).alias("x")).limit(1), b.select(F.struct(*COMPATIBLE).alias("y")).limit(1)
    differ = F.array_compact(F.array(*[F.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), F.lit(c)) for c in COMPATIBLE]))
    return x.crossJoin(y).select((F.size(differ) == 0).alias("compatible"), differ.alias("differences"))


class BatchTable:
    """Examples of committed batches as a table: rows under an attempt, then the commit that names the attempt.

    A batch that is written again gets a new attempt; readers join the first
    commit of a batch, so an interrupted or repeated write never shows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, examples: DataFrame, descriptors: DataFrame, attempt: str) -> None:
        examples.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{self.path}/examples")
        done = descriptors.withColumn("attempt", F.lit(attempt)).withColumn("committed_at", F.current_timestamp())
        done.write.mode("append").parquet(f"{self.path}/commits")

    def exists(self) -> bool:
        """Whether anything has been committed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def commits(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/commits")
        first = rows.groupBy("batch_id").agg(F.min(F.struct("committed_at", "attempt")).alias("c"))
        return first.select("batch_id", F.col("c.attempt").alias("attempt"))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/examples").join(self.commits(), ["batch_id", "attempt"], "left_semi").drop("attempt")


def output_path(spark: SparkSession, folder: str, prefix: str, resume: bool, explicit: str | None = None) -> str:
    """Where a run writes: the given path; on resume the last log of that prefix by name; else a new name."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()

    def exists(p: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(conf).exists(path)

    if explicit is not None:
        if not resume and exists(explicit):
            raise FileExistsError(explicit)
        return explicit
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}*")
    found = sorted(str(s.getPath()) for s in pattern.getFileSystem(conf).globStatus(pattern) or [])
    if resume:
        if not found:
            raise FileNotFoundError(f"{folder}/{prefix}*")
        return found[-1]
    import time

    return f"{folder}/{prefix}_{time.strftime('%Y%m%d_%H%M%S')}.jsonl"
