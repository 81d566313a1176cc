"""Connected components of an edge table by contraction, without any driver-side graph.

Each round every node points to the smallest node among itself and its
neighbours, pointers are doubled until they end at roots, and the edges are
rewritten between roots; loops and repeats go. Rounds end when no edge is left.
All steps are hash aggregations and joins on node ids; what is read twice is
stored in the workspace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.workspace import Workspace


def _hop(pointers: DataFrame) -> DataFrame:
    """Every pointer moved on to its target's target."""
    target = pointers.select(F.col("node").alias("_at"), F.col("root").alias("_next"))
    return pointers.join(target, pointers["root"] == target["_at"]).select("node", F.col("_next").alias("root"))


def connected_components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node of its component."""

    def between(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    live = ws.write(between(edges), f"{name}_edges")
    labels = None
    step = 0
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m"))
        roots = ws.write(lowest.select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{name}_{step}_p0")
        hop = 0
        while True:
            hop += 1
            moved = ws.write(_hop(roots), f"{name}_{step}_p{hop}")
            # pointers only go down, so their sum tells whether any moved
            total = F.sum(F.col("root").cast("decimal(38,0)"))
            before, after = roots.agg(total).first()[0], moved.agg(total).first()[0]
            roots = moved
            if before == after:
                break
        for end in ("a", "b"):
            to = roots.select(F.col("node").alias("_at"), F.col("root").alias("_to"))
            live = live.join(to, live[end] == to["_at"]).drop(end, "_at").withColumnRenamed("_to", end)
        live = ws.write(between(live), f"{name}_{step}_edges")
        if labels is None:
            labels = roots
        else:
            to = roots.select(F.col("node").alias("_at"), F.col("root").alias("_to"))
            labels = labels.join(to, labels["root"] == to["_at"], "left").select("node", F.coalesce("_to", "root").alias("root"))
            labels = ws.write(labels, f"{name}_{step}_labels")
        step += 1
    return labels if labels is not None else live.select(F.col("a").alias("node"), F.col("b").alias("root"))


def merged_components(found: DataFrame, more: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, root) once the links ``more`` (a, b) are added to the components ``found`` (node, root).

    Only the components that ``more`` joins are worked on again.
    """
    ends = more
    for end in ("a", "b"):
        at = found.select(F.col("node").alias("_at"), F.col("root").alias("_to"))
        ends = ends.join(at, ends[end] == at["_at"], "left").withColumn(end, F.coalesce("_to", end)).drop("_at", "_to")
    joined = connected_components(ws.write(ends, f"{name}_ends"), ws, name)
    to = joined.select(F.col("node").alias("_at"), F.col("root").alias("_to"))
    old = found.join(to, found["root"] == to["_at"], "left").select("node", F.coalesce("_to", "root").alias("root"))
    # Nodes that had no link before stand for themselves among the ends.
    new = joined.join(found.select("node"), "node", "left_anti")
    return ws.write(old.unionByName(new), f"{name}_merged")
