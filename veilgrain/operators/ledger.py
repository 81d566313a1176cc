"""The token ledger: every count, cost and budget is an aggregate or a running total over it.

A ledger row is one event: batch, order in the batch, and a privacy bound's rho.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.functions.privacy import Accountant, ZcdpAccountant, epsilon_of_rho
from veilgrain.operators.prefix import running
from veilgrain.workspace import Workspace


def running_cost(events: DataFrame, ws: Workspace, batch: str = "batch_id", order: str = "seq") -> DataFrame:
    """Events with running_rho, the accountant's state after each of them."""
    return running(events, ws, [batch], [order], sums={"running_rho": "rho"})


def summary(events: DataFrame, delta: float, *keys: str, accountant: Accountant | None = None) -> DataFrame:
    """Counters of the accountant by ``keys``: events, private, public, cost (``rho``) and epsilon."""
    accountant = accountant or ZcdpAccountant()
    total = accountant.total(F.col("rho"))
    rows = events.groupBy(*keys) if keys else events.groupBy()
    return rows.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("rho") > 0).alias("n_private"),
        F.count_if(F.col("rho") <= 0).alias("n_public"),
        total.alias("total_rho"),
        accountant.guarantee(total, F.lit(delta)).alias("epsilon"),
    )


def worst_batch(events: DataFrame, batch: str, delta: float) -> DataFrame:
    """Parallel composition: disjoint batches cost what the dearest one does."""
    per = events.groupBy(batch).agg(F.count_if(F.col("rho") > 0).alias("n"), F.sum("rho").alias("rho"))
    return per.agg(F.max("n").alias("max_private_tokens"), F.max("rho").alias("rho")).select(
        "max_private_tokens", "rho", epsilon_of_rho(F.col("rho"), F.lit(delta)).alias("epsilon")
    )


def remaining_budget(examples: DataFrame, budget: int, ws: Workspace, batch: str = "batch_id", order: str = "seq") -> DataFrame:
    """Examples with ``remaining``: the budget less what the earlier ones of the batch have spent."""
    spent = running(examples, ws, [batch], [order], sums={"_spent": "n_priv"})
    return spent.withColumn("remaining", F.lit(budget) - F.col("_spent") + F.col("n_priv")).drop("_spent")


def public_runs(examples: DataFrame, ws: Workspace, batch: str = "batch_id", order: str = "seq") -> DataFrame:
    """Examples with ``run``: how many in a row, up to this one, had no private token."""
    placed = running(examples, ws, [batch], [order], sums={"_i": "1"})
    last = running(placed, Workspace(ws.spark, "runs"), [batch], [order], maxes={"_last": "CASE WHEN n_priv > 0 THEN _i ELSE 0 END"})
    return last.withColumn("run", F.col("_i") - F.col("_last")).drop("_i", "_last")


def generation_stats(examples: DataFrame, label: str = "label") -> DataFrame:
    """One row on all examples, with the label histogram as a map; no row for no examples."""
    by_label = examples.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_priv").alias("priv"), F.sum("n_pub").alias("pub"), F.max("n_priv").alias("most")
    )
    entries = F.array_sort(F.collect_list(F.struct(F.col(label), F.col("n"))))
    one = by_label.agg(
        F.sum("n").alias("num_examples"),
        F.map_from_entries(entries).alias("label_distribution"),
        F.sum(F.col("priv") + F.col("pub")).alias("total_tokens"),
        F.sum("priv").alias("total_private_tokens"),
        F.sum("pub").alias("total_public_tokens"),
        F.max("most").alias("max_private_tokens_in_example"),
    )
    return one.filter(F.col("num_examples") > 0).select(
        "num_examples", "label_distribution", "total_tokens",
        (F.col("total_tokens") / F.col("num_examples")).alias("mean_tokens_per_example"),
        "total_private_tokens", "total_public_tokens",
        public_fraction(F.col("total_private_tokens"), F.col("total_public_tokens")).alias("public_token_fraction"),
        "max_private_tokens_in_example",
    )


def public_fraction(private: Column, public: Column) -> Column:
    return public / F.greatest(F.lit(1), private + public)


def by_batch(examples: DataFrame, batch: str = "batch_id") -> DataFrame:
    totals = examples.groupBy(batch).agg(F.sum("n_priv").alias("n_private"), F.sum("n_pub").alias("n_public"))
    return totals.withColumn("public_fraction", public_fraction(F.col("n_private"), F.col("n_public")))
