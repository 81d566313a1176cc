"""A whole generation run: plan the budget, open or resume the output, generate, commit, report.

The output is a folder: ``runs`` (the header), and a ``BatchTable`` of examples
and commits. Batches are generated and committed in waves, so a run that dies
loses one wave, and a run that resumes skips what is committed.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.functions.privacy import max_private_tokens_value
from veilgrain.operators import batching, ledger, reports
from veilgrain.operators.generation import PrivateTextEngine
from veilgrain.sources import run_log
from veilgrain.workspace import Workspace


@dataclass(frozen=True)
class Outcome:
    """What a run has made: all committed examples (resumed ones too), and its numbers."""

    examples: DataFrame
    report: dict
    stats: dict | None
    realized_epsilon: float
    new_batches: int
    seconds: float


def plan_budget(engine: PrivateTextEngine, epsilon: float, delta: float | None, n: int) -> tuple[PrivateTextEngine, float]:
    """The engine with as many private tokens a batch as ``epsilon`` pays for, and the delta (1 / n where none is given)."""
    s = engine.settings
    delta = reports.resolve_delta(delta, n)
    tokens = max_private_tokens_value(epsilon, delta, s.clip, s.batch_size, s.temperature, s.svt_noise if s.gated else None)
    return engine.with_settings(max_private_tokens=tokens), delta


def _header(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/runs")
    return spark.read.parquet(f"{path}/runs") if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def run(
    engine: PrivateTextEngine, examples: DataFrame, public_texts: DataFrame | None, path: str, epsilon: float, delta: float | None = None,
    resume: bool = False, waves: int = 1,
) -> Outcome:
    """Run ``engine`` over ``examples`` (example_id, text, label) with a budget of ``epsilon``; results go below ``path``.

    A path with a run in it is refused, unless ``resume`` is set and that run's
    settings are these; where they differ the fields are named.
    """
    began = time.monotonic()
    spark, ws = examples.sparkSession, Workspace(examples.sparkSession, "run")
    n = examples.count()
    engine, delta = plan_budget(engine, epsilon, delta, n)
    header = reports.metadata_frame(spark, reports.run_metadata(engine.settings, engine.dataset, delta, n, path))
    table, before = run_log.BatchTable(spark, path), _header(spark, path)
    if before is None:
        header.write.mode("errorifexists").parquet(f"{path}/runs")
    elif not resume:
        raise FileExistsError(path)
    else:
        same = run_log.compatible(before, header).first()
        if not same["compatible"]:
            raise ValueError(f"the run in {path} has other settings: {', '.join(same['differences'])}")
    bucketed, described = engine.describe(examples, ws)
    done = table.commits() if before is not None and table.exists() else None
    todo = ws.write(described if done is None else batching.pending(described, done), "todo")
    new = todo.count()
    if new:
        model = engine.model(public_texts, ws)
        for k in range(waves):
            part = todo.filter(F.col("batch_index") % waves == k)
            table.append(engine.generate_batches(bucketed, part, model, ws, f"wave_{k}"), part, uuid.uuid4().hex)
    made = table.read() if table.exists() else spark.createDataFrame([], "batch_id string, label int, num_private_tokens int, num_public_tokens int")
    counted = made.select("label", F.col("num_private_tokens").cast("long").alias("n_priv"), F.col("num_public_tokens").cast("long").alias("n_pub"))
    stats = ledger.generation_stats(counted).first()
    report = reports.privacy_report(engine.settings, engine.settings.max_private_tokens, delta)
    realized = engine.realized_epsilon(made, delta)
    return Outcome(made, report, stats and stats.asDict(), realized, new, time.monotonic() - began)


def export_log(outcome: Outcome, header: dict, descriptors: DataFrame, path: str) -> None:
    """The committed examples as one JSON-lines log with a header and a marker after each batch."""
    counts = outcome.examples.groupBy("batch_id").agg(F.count(F.lit(1)).cast("int").alias("num_examples"))
    marks = descriptors.join(counts, "batch_id", "left").fillna(0, ["num_examples"])
    spark = outcome.examples.sparkSession
    first = spark.range(0, 1, 1, 1).select(F.lit(-1).alias("batch_index"), F.lit(0).alias("kind"), F.lit(0).alias("example_no"), F.lit(run_log.header_line(header)).alias("line"))
    rows = run_log.example_lines(outcome.examples).select("batch_index", F.lit(0).alias("kind"), "example_no", "line")
    ends = run_log.marker_lines(marks).select("batch_index", F.lit(1).alias("kind"), F.lit(0).alias("example_no"), "line")
    run_log.write_log(first.unionByName(rows).unionByName(ends), path, ["batch_index", "kind", "example_no"])
