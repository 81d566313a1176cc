"""Reports and metadata of runs, and sinks for results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.functions.privacy import epsilon_value
from veilgrain.operators.generation import Settings
from veilgrain.sources.run_log import METADATA


def resolve_delta(delta: float | None, n: int) -> float:
    """``delta``, or 1 / n where none is given; it must be positive."""
    if delta is None:
        return 1 / n
    if not 0 < delta <= 1:
        raise ValueError("delta must be in (0, 1]")
    return delta


# The keys of reports and headers, as other readers of them expect.


def privacy_report(s: Settings, tokens: int, delta: float) -> dict:
    """Costs and guarantee of ``tokens`` private tokens in the dearest batch."""
    total = tokens * s.rho
    return {
        "rho_per_token": s.rho, "total_rho": total, "epsilon": epsilon_value(total, delta), "delta": delta, "num_private_tokens": tokens,
        "clip_bound": s.clip, "batch_size": s.batch_size, "temperature": s.temperature, "svt_noise": s.svt_noise if s.gated else None,
    }


def privacy_metadata(s: Settings, delta: float) -> dict:
    """What a log's header says about privacy; noise only where the gate is on."""
    return {
        "epsilon": epsilon_value(s.max_private_tokens * s.rho, delta), "delta": delta, "batch_size": s.batch_size, "clip_bound": s.clip,
        "temperature": s.temperature, "public_temperature": s.public_temperature, "svt_threshold": s.svt_threshold,
        "svt_noise": s.svt_noise if s.gated else None, "top_k_vocab": s.top_k, "max_private_tokens": s.max_private_tokens,
    }


def run_metadata(s: Settings, dataset: str, delta: float, num_examples: int, output_path: str, micro_batch_size: int = 32) -> dict:
    """The whole header of a run."""
    return {"dataset": dataset} | privacy_metadata(s, delta) | {
        "max_total_tokens": s.max_total_tokens, "num_source_examples": num_examples, "seed": s.seed, "micro_batch_size": micro_batch_size,
        "output_path": output_path, "checkpoint_format": 1,
    }


def metadata_frame(spark: SparkSession, metadata: dict) -> DataFrame:
    """A header as the one-row ``runs`` table."""
    kinds = dict(f.split() for f in METADATA.split(", "))
    return spark.range(0, 1, 1, 1).select(*[F.lit(metadata.get(k)).cast(t).alias(k) for k, t in kinds.items()])


def evaluation_result(scored: DataFrame, mode: str, source: str, dataset: str, num_train: int, seconds: float) -> DataFrame:
    """Scores with what was evaluated, and for how long."""
    given = {"mode": mode, "source": source, "dataset": dataset, "num_train": num_train, "eval_time_seconds": seconds}
    return scored.withColumns({k: F.lit(v) for k, v in given.items()})


def save_result(result: DataFrame, path: str) -> None:
    """One JSON object below ``path``; an earlier result is not overwritten."""
    result.coalesce(1).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def percent_free(private: int, public: int) -> float:
    """Share of tokens, in percent, that cost no privacy."""
    total = private + public
    return 100 * public / total if total else math.nan
