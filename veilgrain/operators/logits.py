"""Aggregation of next-token logits over the prompts of a batch."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.functions import logits as L
from veilgrain.functions.hashing import laplace, uniform


def _summed(rows: DataFrame, batch: str, values: Column, size: int, out: str) -> DataFrame:
    """Sum of an array column by batch over the expected batch size, as an array.

    Vectors are added up whole in one buffer for each batch and task, and only
    these buffers are shuffled: nothing is exploded to a row for each token.
    """
    total = rows.select(batch, array_to_vector(values).alias("_v")).groupBy(batch).agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias("_t"))
    return total.select(batch, F.transform("_t", lambda x: x / float(size)).alias(out))


def clip_and_aggregate(rows: DataFrame, batch: str, z: str, c: float, expected_size: int) -> DataFrame:
    """(batch, zbar: array by token): clipped logits over the *expected* size, whatever the batch holds."""
    return _summed(rows, batch, L.clip(F.col(z), c), expected_size, "zbar")


def mean_distribution(rows: DataFrame, batch: str, z: str, expected_size: int) -> DataFrame:
    """(batch, p: array by token): mean unclipped softmax at temperature one."""
    return _summed(rows, batch, L.softmax(F.col(z)), expected_size, "p")


def distances(rows: DataFrame, public: DataFrame, batch: str, z: str, expected_size: int) -> DataFrame:
    """(batch, distance): L1 between the mean private and the public distribution (``public``: batch, z)."""
    private = mean_distribution(rows, batch, z, expected_size)
    shown = public.select(batch, L.softmax(F.col(z)).alias("q"))
    return private.join(shown, batch).select(batch, L.l1_distance(F.col("p"), F.col("q")).alias("distance"))


def noisy_threshold(threshold: float, noise: float, *counters: Column | str | int) -> Column:
    return F.lit(float(threshold)) + laplace(uniform(*counters, "threshold"), noise)


def gate(distance: Column, noisy: Column, noise: float, *counters: Column | str | int) -> Column:
    """Whether a token must be private: the distance with twice the noise reaches the noisy threshold."""
    return distance + laplace(uniform(*counters, "query"), 2 * noise) >= noisy


def sample(z: Column, temperature: float, *counters: Column | str | int) -> Column:
    """A token drawn from softmax(z / temperature)."""
    return L.draw(L.quantised(L.softmax(z, temperature)), uniform(*counters, "token"))
