"""Toxicity: a character n-gram linear classifier scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of 4, 5, 6 and 8 characters (code points) of the
lower-cased whole text, hashed to 2 ** ``BUCKETS_LOG2`` buckets. Each is scaled by the smoothed log ratio of its
frequency in toxic and other texts, and a logistic regression is trained on the
scaled features. Training uses at most ``SAMPLE_TOXIC`` toxic and
``SAMPLE_OTHER`` other labelled texts, drawn by hash from rows that are not
held out; weights restore the labelled shares, so scores are probabilities. Of
a sampled text over ``SAMPLE_CHARS`` characters that many are learned from, cut
out at a hashed place; scoring always reads the whole text.

Defined cases: null or empty text has no features and scores the base rate of
such a text (the intercept); null labels and ids are not learned from; an id
labelled more than once is toxic if any label says so; with labels of one class
only (or none) every score is that class's share. Repeated rows are scored
alike, an empty table gives an empty one, other columns are not read. Texts are
scored whole, in pieces of ``PIECE`` characters that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.llm.common import held_out, map_texts
from veilgrain.workspace import read_table

SAMPLE_TOXIC, SAMPLE_OTHER = 2000, 4000
#: Characters of a sampled text that are learned from, which bounds what reaches the driver.
SAMPLE_CHARS = 20_000
BUCKETS_LOG2 = 20
SIZES = (4, 5, 6, 8)
SMOOTHING = 1.0
#: Features with a smaller absolute ratio, or in fewer sample texts, say nothing.
MIN_RATIO, MIN_TEXTS = 2.0, 5
RIDGE, ROUNDS = 1e-3, 150
THRESHOLD = 0.3
PIECE = 1 << 18

_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def _hashes(points: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of an array of code points, size by size."""
    wide = points.astype(np.uint64)
    gram = wide
    for n in range(2, SIZES[-1] + 1):
        if len(points) < n:
            return
        gram = gram[:-1] * _STEP + wide[n - 1 :]
        if n in SIZES:
            mixed = (gram ^ np.uint64(n << 59)) * _MIX
            yield ((mixed ^ mixed >> np.uint64(29)) * _MIX >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int32)


def features(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a text; with ``wanted`` (a flag for each bucket) only those."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4") if text else np.empty(0, "<u4")
    found = []
    for at in range(0, len(points), PIECE):
        for h in _hashes(points[at : at + PIECE + SIZES[-1] - 1]):
            found.append(h if wanted is None else h[wanted[h]])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


def fit(texts: list[str | None], toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of each bucket (ratio times coefficient) and the intercept. ``weight``: how many rows each text stands for."""
    size = 1 << BUCKETS_LOG2
    share = float((weight * toxic).sum() / max(weight.sum(), 1e-12))
    zero = np.zeros(size, np.float32)
    if len(set(toxic.tolist())) < 2:
        return zero, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    count = {c: np.zeros(size) for c in (0, 1)}
    for t, y in zip(texts, toxic, strict=True):
        count[int(y)][features(t)] += 1
    n = {c: float((toxic == c).sum()) for c in (0, 1)}
    ratio = np.log((count[1] + SMOOTHING) / (n[1] + 2 * SMOOTHING)) - np.log((count[0] + SMOOTHING) / (n[0] + 2 * SMOOTHING))
    telling = (np.abs(ratio) >= MIN_RATIO) & (count[0] + count[1] >= MIN_TEXTS)
    rows = [features(t, telling) for t in texts]  # the full rows of all texts would not fit a small driver
    starts = np.cumsum([0, *map(len, rows)])
    at = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), np.diff(starts))
    scale = ratio[at]
    coef, bias = np.zeros(size), np.log(share / (1 - share))
    # Adam on the weighted log loss; the ridge is on the coefficients
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    total = weight.sum()
    for k in range(1, ROUNDS + 1):
        margin = np.bincount(owner, weights=coef[at] * scale, minlength=len(rows)) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - toxic) / total
        grad = np.bincount(at, weights=error[owner] * scale, minlength=size) + RIDGE * coef
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.99 * vb + 0.01 * error.sum() ** 2
        step = 0.02 / (1 - 0.9**k) * np.sqrt(1 - 0.99**k)
        coef -= step * m / (np.sqrt(v) + 1e-9)
        bias -= step * mb / (np.sqrt(vb) + 1e-9)
    return np.where(telling, coef * ratio, 0).astype(np.float32), float(bias)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic"
) -> tuple[np.ndarray, float]:
    """A model from labelled rows that are not held out."""
    marked = labels.select(F.col(label_id).alias("i"), F.col(label_col).alias("y")).filter("i IS NOT NULL AND y IS NOT NULL")
    marked = marked.filter(~held_out("i")).groupBy("i").agg(F.max("y").cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    drawn = None
    for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_OTHER)):
        own = marked.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(most)
        drawn = own if drawn is None else drawn.unionByName(own)
    # At most SAMPLE_TOXIC + SAMPLE_OTHER ids, so they can be sent to the scan of the texts.
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    place = F.pmod(F.xxhash64("i", F.lit(1)), F.greatest(F.lit(1), F.length("t") - SAMPLE_CHARS + 1)).cast("int")
    cut = F.when(F.length("t") <= SAMPLE_CHARS, F.col("t")).otherwise(F.substring("t", place + 1, F.lit(SAMPLE_CHARS)))
    sample = texts.join(F.broadcast(drawn), "i").select("i", "y", cut.alias("t")).groupBy("i").agg(F.max("t").alias("t"), F.first("y").alias("y"))
    rows = sorted(sample.select("i", "t", "y").collect(), key=lambda r: r["i"])
    toxic = np.array([r["y"] for r in rows], dtype=float)
    got = {y: max(1, int((toxic == y).sum())) for y in (0, 1)}
    weight = np.array([counts[r["y"]] / got[r["y"]] for r in rows], dtype=float)
    return fit([r["t"] for r in rows], toxic, weight)


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    weights, bias = model
    at = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((at, weights[at], bias))

    def make():
        at, values, bias = shared.value
        weights = np.zeros(1 << BUCKETS_LOG2)
        weights[at] = values
        wanted = weights != 0

        def one(text):
            margin = bias + float(weights[features(text, wanted)].sum())
            return (float(1 / (1 + np.exp(-min(max(margin, -40.0), 40.0)))),)

        return one

    return map_texts(docs, id_col, text_col, make, "score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
