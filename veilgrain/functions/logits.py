"""Row-wise logit algebra on arrays; all of it stays in the JVM.

A lambda evaluates whatever it refers to once for every element, so what is the
same for all elements of a vector (its maximum, its total, the vector itself)
is bound by ``let`` first. Every function here takes time in proportion to the
vocabulary (``top_k_mask`` sorts it).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clip(z: Column, c: Column | float) -> Column:
    """Recentred so that the largest logit is c, cut below at -c."""
    bound = c if isinstance(c, Column) else F.lit(float(c))
    return let(z, lambda v: let(F.array_max(v) - bound, lambda off: F.transform(v, lambda x: F.greatest(-bound, x - off))))


def _total(v: Column, zero: Column) -> Column:
    return F.aggregate(v, zero, lambda a, x: a + x)


def softmax(z: Column, temperature: Column | float = 1.0) -> Column:
    """exp((x - max) / tau), normalised. Masked logits of -infinity get probability zero."""
    tau = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    powers = let(z, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp((x - top) / tau))))
    return let(powers, lambda v: let(_total(v, F.lit(0.0)), lambda total: F.transform(v, lambda x: x / total)))


def l1_distance(p: Column, q: Column) -> Column:
    return _total(F.zip_with(p, q, lambda a, b: F.abs(a - b)), F.lit(0.0))


def top_k_mask(z: Column, by: Column, k: int) -> Column:
    """``z`` where ``by`` is among its k largest (ties to the smaller index; k is held to the length), else -infinity."""
    if k <= 0:
        return z
    ranked = F.array_sort(F.transform(by, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    last = let(ranked, lambda r: F.element_at(r, F.least(F.lit(k), F.size(r))))
    paired = F.zip_with(z, by, lambda x, y: F.struct(x.alias("x"), (-y).alias("y")))

    def kept(x: Column, i: Column, end: Column) -> Column:
        return F.when((x["y"] < end["x"]) | ((x["y"] == end["x"]) & (i <= end["i"])), x["x"]).otherwise(F.lit(float("-inf")))

    return let(last, lambda end: F.transform(paired, lambda x, i: kept(x, i, end)))


def quantised(p: Column, bits: int = 40) -> Column:
    """Probabilities as whole numbers, so that cumulative sums are exact in any order."""
    return F.transform(p, lambda x: F.round(x * float(1 << bits)).cast("long"))


def draw(weights: Column, u: Column) -> Column:
    """Inverse-CDF draw of an index: the first whose cumulative weight exceeds u times the total."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("at"))

    def step(acc: Column, w: Column, target: Column) -> Column:
        after = acc["sum"] + w
        return F.struct(after.alias("sum"), (acc["i"] + 1).alias("i"), F.coalesce(acc["at"], F.when(after > target, acc["i"])).alias("at"))

    def drawn(w: Column, target: Column) -> Column:
        return F.aggregate(w, start, lambda acc, x: step(acc, x, target))["at"]

    return let(weights, lambda w: let(F.floor(u * _total(w, F.lit(0).cast("long"))), lambda target: drawn(w, target)))
