"""Shared intermediate storage and worker set-up.

Intermediate tables cut lineage: they are written as Parquet below the folder
that the cluster names in ``spark.checkpoint.dir``, so a lost executor never
takes the only copy of a result with it.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session. Only a local master may fall back to a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = "file://" + tempfile.mkdtemp(prefix="veilgrain-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


class Workspace:
    """A folder of its own below the shared one, removed when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/veilgrain/{name}-{uuid.uuid4().hex[:12]}"
        self._tables: list[str] = []
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the stored table; its lineage starts at the files."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, name: str) -> str:
        """A catalog table name that is dropped with the workspace."""
        full = f"{name}_{uuid.uuid4().hex[:12]}"
        self._tables.append(full)
        return full

    def bytes_of(self, name: str) -> int:
        """Stored bytes of a table written here."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def close(self) -> None:
        atexit.unregister(self.close)
        try:
            for table in self._tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is already down; nothing more to release
            pass


#: Arrow batches of whole texts; Spark's own limits (64 MB, 10,000 rows) cost each Python worker several times that.
BATCH_BYTES, BATCH_ROWS = "8m", 2000


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package, as a submitted job does with --py-files, and keep their batches small."""
    for key, default, value in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64m"), BATCH_BYTES),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", ("10000",), BATCH_ROWS),
    ):
        if spark.conf.get(key) in default:  # a limit that somebody has set stays
            spark.conf.set(key, value)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, have)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
