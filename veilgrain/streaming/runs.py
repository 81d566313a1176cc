"""Streaming forms: the accountant over a stream of events, and generation batch by batch with commits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.functions.privacy import epsilon_of_rho


def accountant(events: DataFrame, delta: float, batch: str = "batch_id") -> DataFrame:
    """Streaming or static (batch_id, rho): running totals and epsilon by batch; state is one row a batch."""
    total = F.sum("rho")
    return events.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("rho") > 0).alias("n_private"),
        total.alias("total_rho"),
        epsilon_of_rho(total, F.lit(delta)).alias("epsilon"),
    )


def budget_guard(events: DataFrame, budget: float, batch: str = "batch_id") -> DataFrame:
    """Stateful (batch_id, spent, refused): rho spent by batch, and events refused once the budget would be passed."""
    kind = events.schema[batch].dataType.simpleString()

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        spent, refused = state.get if state.exists else (0.0, 0)
        for frame in frames:
            for rho in frame["rho"]:
                if spent + rho <= budget:
                    spent += float(rho)
                else:
                    refused += 1
        state.update((spent, refused))
        yield pd.DataFrame({batch: [key[0]], "spent": [spent], "refused": [refused]})

    out = f"{batch} {kind}, spent double, refused long"
    return events.select(batch, "rho").groupBy(batch).applyInPandasWithState(update, out, "spent double, refused long", "update", "NoTimeout")


def drain(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream over what is there now; ``write`` gets each micro-batch. A restart goes on from the checkpoint."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def generate_stream(batches: DataFrame, checkpoint: str, generate: Callable[[DataFrame], tuple[DataFrame, DataFrame]], table) -> None:
    """Generate for a stream of batch descriptors and commit each micro-batch to a ``BatchTable``.

    The micro-batch number names the attempt, so one that is replayed after a
    failure adds rows that no commit names, or a second commit that loses.
    """

    def write(part: DataFrame, number: int) -> None:
        part = part.persist()
        try:
            made, done = generate(part)
            table.append(made, done, f"stream-{number}")
        finally:
            part.unpersist()

    drain(batches, checkpoint, write)
