"""Exact de-duplication over a persistent digest index (DataFrame operations only).

The index is a catalog table bucketed and sorted by SHA-256 digest. A batch of
documents is first reduced to one row per digest (map-side combine, so a group
of any size costs one row per task), then anti-joined by sort-merge against the
index, whose side is read bucket by bucket without a shuffle, and what is new
is appended with the name of the batch. Which row stays is read back from the
index by a second sort-merge join, the first batch included: nothing else says
what has been kept.

A batch that is run again under its name (after a driver has died between the
append and the result) finds its own rows in the index and gives the result it
would have given.

Defined cases: a null text counts as the empty text; equal means identical.
Of equal texts in one batch the row with the largest doc_id stays (a null id
is smallest); where that row itself is repeated, exactly one of the repeats
stays. A text that an earlier batch has brought in is dropped altogether and
``keep_id`` names the row that stayed then. An empty batch adds nothing. Extra
columns are ignored whatever their names; they never reach the index. Texts of
any length are hashed whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.llm.common import text_or_empty, without_ids
from veilgrain.workspace import Workspace, read_table

#: Rows of the index that one bucket should hold, about 60 MB.
ROWS_PER_BUCKET = 1_000_000


class DigestIndex:
    """A persistent table (digest, keep_id, batch), bucketed and sorted by digest; made empty if it is not there."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = 16):
        self.spark, self.table, self.buckets = spark, table, buckets
        columns = "digest BINARY, keep_id BIGINT, batch STRING"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def missing(self, groups: DataFrame) -> DataFrame:
        """Rows of ``groups`` whose digest is not in the index, by sort-merge."""
        return groups.join(self.read().hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the groups (digest, keep_id) whose digest is not in the index yet."""
        new = self.missing(groups).select("digest", "keep_id", F.lit(batch).alias("batch"))
        dealt = new.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, row_no) of every row; row_no tells repeated rows apart."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def deduplicate(
    docs: DataFrame, index: DigestIndex | None, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None
) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept, seen) for every row of ``docs``; new digests go to ``index``.

    Without an index a new one is made, which goes with the workspace. Texts
    are read once; from then on only 48 bytes a row move. The last join has a
    plain stored table on both sides, so that adaptive execution splits the
    partition of a digest that many rows share.
    """
    batch = batch or uuid.uuid4().hex
    rows = ws.write(digest_rows(docs, id_col, text_col), "rows")
    if index is None:
        index = DigestIndex(docs.sparkSession, ws.table("digest_index"), max(16, rows.count() // ROWS_PER_BUCKET))
    best = F.max(F.struct("doc_id", "row_no"))
    groups = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = ws.write(groups.select("digest", "group_size", F.col("best.doc_id").alias("own_id"), F.col("best.row_no").alias("keep_row")), "groups")
    index.append(groups.select("digest", F.col("own_id").alias("keep_id")), batch)
    known = groups.join(index.read().hint("merge"), "digest").withColumn("seen", F.col("batch") != batch)
    known = ws.write(known.select("digest", "group_size", "keep_id", "keep_row", "seen"), "known")
    kept = ~F.col("seen") & (F.col("row_no") == F.col("keep_row"))
    return rows.join(known, "digest").select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"), "seen")


def drop_copies(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """``docs`` without the copies (and without texts that ``index`` has already), columns unchanged.

    Rows go by id. Only where a kept id also belongs to a dropped row (repeated
    rows) are those few rows grouped by id and text to leave one of each.
    """
    fate = ws.write(deduplicate(docs, index, ws, id_col, text_col).select("doc_id", "digest", "kept"), "fate")
    lost = fate.filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    mixed = ws.write(lost.join(fate.filter("kept").select("doc_id").distinct(), "doc_id", "left_semi"), "mixed")
    plain = without_ids(docs, lost.withColumnRenamed("doc_id", id_col), id_col, ws, "lost")
    nulls = fate.filter("doc_id IS NULL").limit(1).count()
    if not mixed.limit(1).count() and not nulls:
        return plain
    # A name that no column of the documents has; the other sides are only named through themselves.
    mark = f"_digest_{uuid.uuid4().hex}"
    whole = docs.withColumn(mark, F.unhex(F.sha2(text_or_empty(text_col), 256)))
    stays = fate.filter("kept").select("doc_id", "digest").distinct()
    again = whole.join(mixed, whole[id_col].cast("long") == mixed["doc_id"], "left_semi")
    if nulls:
        again = again.unionByName(whole.filter(F.col(id_col).isNull()))
    same = again[id_col].cast("long").eqNullSafe(stays["doc_id"]) & (again[mark] == stays["digest"])
    again = again.join(stays, same, "left_semi").dropDuplicates([id_col, mark]).drop(mark)
    return plain.filter(F.col(id_col).isNotNull()).unionByName(again)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as the first batch of a new index."""
    ws = Workspace(spark, "op8")
    found = deduplicate(read_table(spark, sf_dir, "documents"), None, ws)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS keep_id,
       count(*) OVER (PARTITION BY sha256(coalesce(text, ''))) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
