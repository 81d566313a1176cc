"""zCDP cost, conversion and planning formulas as column expressions and Python twins for drivers."""

from __future__ import annotations

import math
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Planned tokens where a token costs nothing.
UNLIMITED_TOKENS = 10_000


def rho_per_token(clip: Column, batch_size: Column, temperature: Column, svt_noise: Column) -> Column:
    """zCDP of one private token: exponential mechanism, plus the sparse vector where its noise is positive."""
    mechanism = 0.5 * F.pow(clip / (batch_size * temperature), F.lit(2.0))
    gate = F.when(svt_noise > 0, 2.0 / F.pow(batch_size * svt_noise, F.lit(2.0))).otherwise(0.0)
    return mechanism + gate


def epsilon_of_rho(rho: Column, delta: Column) -> Column:
    """(epsilon, delta) guarantee of a zCDP cost; nothing costs nothing."""
    return F.when(rho <= 0, 0.0).otherwise(rho + F.sqrt(4.0 * rho * F.ln(1.0 / delta)))


def max_private_tokens(epsilon: Column, delta: Column, rho_token: Column) -> Column:
    """Largest number of private tokens within the budget, one at least: the smaller root of
    x^2 - (2 eps + 4 L) x + eps^2 = 0 with L = ln(1 / delta), in tokens."""
    half = epsilon + 2.0 * F.ln(1.0 / delta)
    inside = half * half - epsilon * epsilon
    # the same root as half - sqrt(inside), without cancellation
    root = epsilon * epsilon / (half + F.sqrt(F.greatest(inside, F.lit(0.0))))
    planned = F.when((inside < 0) | (root <= 0), F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(root / rho_token).cast("int")))
    return F.when(rho_token <= 0, F.lit(UNLIMITED_TOKENS)).otherwise(planned)


def rho_token_value(clip: float, batch_size: int, temperature: float, svt_noise: float | None = None) -> float:
    gate = 2.0 / (batch_size * svt_noise) ** 2 if svt_noise else 0.0
    return 0.5 * (clip / (batch_size * temperature)) ** 2 + gate


def epsilon_value(rho: float, delta: float) -> float:
    return 0.0 if rho <= 0 else rho + math.sqrt(4 * rho * math.log(1 / delta))


def max_private_tokens_value(epsilon: float, delta: float, clip: float, batch_size: int, temperature: float, svt_noise: float | None = None) -> int:
    rho = rho_token_value(clip, batch_size, temperature, svt_noise)
    if rho <= 0:
        return UNLIMITED_TOKENS
    half = epsilon + 2 * math.log(1 / delta)
    return max(1, int(epsilon * epsilon / (half + math.sqrt(max(0.0, half * half - epsilon * epsilon))) / rho))


def bound(family: str, rho: Column | None = None, epsilon: Column | None = None, delta: Column | None = None) -> Column:
    """A checked privacy bound struct: family ``zcdp`` (rho) or ``approx_dp`` (epsilon, delta)."""

    def at_least_zero(name: str, c: Column) -> Column:
        return F.when(c < 0, F.raise_error(F.lit(f"{name} must not be negative")).cast("double")).otherwise(c.cast("double"))

    none = F.lit(None).cast("double")
    checked = none if delta is None else F.when((delta < 0) | (delta > 1), F.raise_error(F.lit("delta must be in [0, 1]")).cast("double")).otherwise(delta.cast("double"))
    return F.struct(
        F.lit(family).alias("family"),
        (none if rho is None else at_least_zero("rho", rho)).alias("rho"),
        (none if epsilon is None else at_least_zero("epsilon", epsilon)).alias("epsilon"),
        checked.alias("delta"),
    )


def is_trivial(b: Column) -> Column:
    return F.when(b["family"] == "zcdp", b["rho"] == 0).otherwise(b["epsilon"] == 0)


def rho_of(b: Column) -> Column:
    """The bound's rho; an error for a bound that is not zCDP."""
    return F.when(b["family"] == "zcdp", b["rho"]).otherwise(F.raise_error(F.concat(F.lit("no rho in a bound of family "), b["family"])).cast("double"))


def to_approx_dp(b: Column, delta: Column) -> Column:
    """A zCDP bound as (epsilon, delta); an approximate one as it is."""
    return F.when(b["family"] == "zcdp", bound("approx_dp", epsilon=epsilon_of_rho(F.coalesce(b["rho"], F.lit(0.0)), delta), delta=delta)).otherwise(b)


def compose(*bounds: Column) -> Column:
    """Sequential composition of zCDP bounds."""
    total = rho_of(bounds[0])
    for b in bounds[1:]:
        total = total + rho_of(b)
    return bound("zcdp", rho=total)


def scale(b: Column, n: Column) -> Column:
    """A zCDP bound spent ``n`` times."""
    times = F.when(n < 0, F.raise_error(F.lit("n must not be negative")).cast("long")).otherwise(n.cast("long"))
    return bound("zcdp", rho=rho_of(b) * times)


def svt_enabled(threshold: Column) -> Column:
    return threshold > F.lit(float("-inf"))


class Accountant(Protocol):
    """How costs of events add up and what they guarantee; all of it column expressions, so any grouping may use it."""

    def cost(self, b: Column) -> Column:
        """The cost of one event's bound."""

    def total(self, cost: Column) -> Column:
        """An aggregate over the costs of events."""

    def guarantee(self, total: Column, delta: Column) -> Column:
        """Epsilon at ``delta``."""


class ZcdpAccountant:
    """Sequential composition of zCDP bounds; a bound of another family is an error."""

    def cost(self, b: Column) -> Column:
        return rho_of(b)

    def total(self, cost: Column) -> Column:
        return F.sum(cost)

    def guarantee(self, total: Column, delta: Column) -> Column:
        return epsilon_of_rho(total, delta)
