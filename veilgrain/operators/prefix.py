"""Running sums and maxima over groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgrain.workspace import Workspace


def running(
    df: DataFrame, ws: Workspace, keys: list[str], order: list[str], sums: dict[str, str] | None = None, maxes: dict[str, str] | None = None
) -> DataFrame:
    """``df`` with running totals (``sums``: new column -> expression) and maxima, the row itself included.

    A window over a key would put a hot key into one task. Here the rows are
    range-partitioned by key and order, each part is scanned on its own, and
    what the parts before it add up to (one row for each key and part) is added.
    ``order`` must tell the rows of a key apart.
    """
    sums, maxes = sums or {}, maxes or {}
    parts = ws.write(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    totals = parts.groupBy(*keys, "_part").agg(
        *[F.sum(F.expr(e)).alias(f"_{c}") for c, e in sums.items()], *[F.max(F.expr(e)).alias(f"_{c}") for c, e in maxes.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_p"),
        *[F.sum(f"_{c}").over(before).alias(f"_{c}") for c in sums],
        *[F.max(f"_{c}").over(before).alias(f"_{c}") for c in maxes],
    )
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select(
        "*", *[F.sum(F.expr(e)).over(inside).alias(c) for c, e in sums.items()], *[F.max(F.expr(e)).over(inside).alias(c) for c, e in maxes.items()]
    )
    same = local["_part"] == offsets["_p"]
    for k in keys:
        same = same & local[k].eqNullSafe(offsets[f"_k_{k}"])
    joined = local.join(offsets, same, "left")
    out = [F.col(c) for c in df.columns]
    out += [(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sums]
    out += [F.greatest(F.col(c), F.col(f"_{c}")).alias(c) for c in maxes]
    return joined.select(*out)
