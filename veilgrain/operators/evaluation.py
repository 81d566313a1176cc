"""Downstream evaluation: metrics from predictions, few-shot evaluation, and a trained classifier."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.functions.text import match_label
from veilgrain.operators.prefix import running
from veilgrain.operators.prompts import balanced_prompt, balanced_shots
from veilgrain.operators.reports import evaluation_result
from veilgrain.sources.catalog import dataset
from veilgrain.sources.run_log import read_log
from veilgrain.workspace import Workspace


def classification_report(predicted: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(class, precision, recall, f1, support) over the union of true and predicted classes; what has no base is 0.

    Counts by (label, pred) combine before the shuffle; all after that is as
    small as the square of the number of classes.
    """
    cells = predicted.groupBy(F.col(label).alias("l"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(F.col("l").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("q"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("q"), F.lit(0).cast("long").alias("hit")),
    )
    per = cells.select(F.explode(sides).alias("s")).groupBy("s.class").agg(F.sum("s.t").alias("t"), F.sum("s.q").alias("q"), F.sum("s.hit").alias("hit"))
    precision, recall = (F.when(F.col(c) > 0, F.col("hit") / F.col(c)).otherwise(0.0) for c in ("q", "t"))
    f1 = F.when(F.col("t") + F.col("q") > 0, 2 * F.col("hit") / (F.col("t") + F.col("q"))).otherwise(0.0)
    return per.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), F.col("t").alias("support"))


def scores(predicted: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """One row: num_test, accuracy, macro and weighted F1, and the report by class as a map."""
    report = classification_report(predicted, label, pred)
    value = F.struct("precision", "recall", "f1", "support")
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("class").cast("string").alias("key"), value.alias("value")))))
    total = F.sum("support")
    return report.agg(
        total.alias("num_test"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"),
        entries.alias("per_class"),
    )


def running_accuracy(predicted: DataFrame, ws: Workspace, order: str, label: str = "label", pred: str = "pred", every: int = 50) -> DataFrame:
    """(n, accuracy) after each ``every`` rows in order."""
    placed = running(predicted, ws, [], [order], sums={"n": "1", "hits": f"CASE WHEN {label} = {pred} THEN 1 ELSE 0 END"})
    return placed.filter(F.col("n") % every == 0).select("n", (F.col("hits") / F.col("n")).alias("accuracy"))


def icl_evaluate(
    shots_from: DataFrame, test: DataFrame, name: str, complete: Callable[[list[str]], list[str]], num_shots: int = 4,
    max_test: int | None = None, compat: bool = False,
) -> DataFrame:
    """(example_id, label, completion, pred) of the test rows; with ``max_test`` of so many, the first by id.

    ``complete`` turns a list of prompts into completions; it runs on Arrow
    batches in the workers. Every row carries its label along, so rows that
    share an id are judged each on their own.
    """
    some = test if max_test is None else test.orderBy("example_id").limit(max_test)
    prompts = balanced_prompt(balanced_shots(shots_from, name, num_shots, compat), name, some, "example_id", "label")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[["example_id", "label"]].assign(completion=complete(rows["prompt"].tolist()))

    kinds = {c: test.schema[c].dataType.simpleString() for c in ("example_id", "label")}
    answers = prompts.mapInPandas(run, f"example_id {kinds['example_id']}, label {kinds['label']}, completion string")
    pred = match_label(F.col("completion"), dataset(name).label_names, compat)
    return answers.select("example_id", "label", "completion", pred.alias("pred"))


def train_classifier(train: DataFrame, test: DataFrame, features: int | None = None, epochs: int = 20, kind: str = "linear") -> tuple[DataFrame, list[float]]:
    """Train on (text, label), predict ``test``: (its columns, pred), and the loss after each iteration.

    ``linear`` is a logistic regression on TF-IDF, ``neural`` a network with one
    hidden layer on them (fewer features; labels must be 0, 1, ...).
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    columns = {"featuresCol": "_features", "labelCol": "label", "predictionCol": "_pred"}
    if kind == "linear":
        size = features or 1 << 14
        last = LogisticRegression(**columns, maxIter=epochs, regParam=0.01)
    elif kind == "neural":
        size = features or 1 << 9
        classes = train.agg(F.max("label")).first()[0] + 1
        last = MultilayerPerceptronClassifier(**columns, layers=[size, 32, max(2, classes)], maxIter=epochs, seed=42)
    else:
        raise ValueError(f"unknown classifier {kind!r}; choose linear or neural")
    stages = [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"\W+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="_features", minDocFreq=2),
        last,
    ]
    model = Pipeline(stages=stages).fit(train)
    out = model.transform(test).select(*test.columns, F.col("_pred").cast("int").alias("pred"))
    summary = model.stages[-1].summary
    return out, list((summary() if callable(summary) else summary).objectiveHistory)


def load_synthetic(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(text, label, label_name) of a run's log, committed batches only, and its header; a log without examples is an error."""
    log = read_log(spark, path)
    rows = log.examples.select("text", "label", "label_name")
    if not rows.limit(1).count():
        raise ValueError(f"no synthetic examples in {path}")
    return rows, log.metadata


def evaluate(
    mode: str, name: str, train: DataFrame, test: DataFrame, source: str = "synthetic", complete: Callable[[list[str]], list[str]] | None = None,
    num_shots: int = 4, max_test: int | None = None, compat: bool = False, kind: str = "linear",
) -> DataFrame:
    """One row of scores of what ``train`` teaches about ``test`` (example_id, text, label).

    ``finetune`` trains a classifier of ``kind`` on (text, label); ``icl`` takes few-shot
    examples from ``train`` and asks ``complete``. ``source`` says where the
    training rows come from: ``synthetic``, or ``real`` for the baseline.
    """
    began = time.monotonic()
    if source not in ("synthetic", "real"):
        raise ValueError(f"unknown source {source!r}; choose synthetic or real")
    if mode == "finetune":
        predicted, _ = train_classifier(train.select("text", "label"), test.select("example_id", "text", "label"), kind=kind)
    elif mode == "icl":
        if complete is None:
            raise ValueError("few-shot evaluation needs a completion function")
        # Synthetic rows have no id; the order of their texts is as good as any.
        shots = train if "example_id" in train.columns else train.withColumn("example_id", F.sha2("text", 256))
        predicted = icl_evaluate(shots, test, name, complete, num_shots, max_test, compat)
    else:
        raise ValueError(f"unknown mode {mode!r}; choose finetune or icl")
    scored = scores(predicted)
    row = scored.first()  # one row; what follows is how long it took
    done = scored.sparkSession.createDataFrame([row], scored.schema)
    return evaluation_result(done, mode, source, name, train.count(), time.monotonic() - began)
