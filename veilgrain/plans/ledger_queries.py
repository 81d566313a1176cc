"""Accounting queries: parameter grids, and ``events`` as a token ledger (user = batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.functions import privacy as P
from veilgrain.operators import ledger
from veilgrain.workspace import Workspace, read_table

CLIP, S, TAU, SIGMA, DELTA, BUDGET = 10.0, 255, 2.0, 0.2, 1e-5, 20
RHO = P.rho_token_value(CLIP, S, TAU, SIGMA)

# The published sweep of batch sizes, temperatures and paired gate settings.
BATCH_SIZES = (127, 255, 511, 1023, 1535, 2047)
TEMPERATURES = (1.5, 2.0, 2.25)
GATES = ((float("-inf"), None), (0.3, 0.1), (0.5, 0.2), (0.7, 0.3))
EPSILONS = (0.5, 1.0, 2.0, 3.0)


def _values(spark: SparkSession, name: str, kind: str, values) -> DataFrame:
    """Literals as a table of one partition, so that a product of such tables is one task."""
    return spark.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, values)).cast(f"array<{kind}>")).alias(name))


def _gates(spark: SparkSession) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(n).cast("double").alias("n")) for t, n in GATES])
    return spark.range(0, 1, 1, 1).select(F.explode(pairs).alias("g")).select(F.col("g.t").alias("svt_threshold"), F.col("g.n").alias("svt_noise"))


def sweep(spark: SparkSession) -> DataFrame:
    """The grid of settings: a cross product of a few literals."""
    return (
        _values(spark, "batch_size", "int", BATCH_SIZES)
        .crossJoin(_values(spark, "temperature", "double", TEMPERATURES))
        .crossJoin(_gates(spark))
        .withColumn("rho", P.rho_per_token(F.lit(CLIP), F.col("batch_size"), F.col("temperature"), F.col("svt_noise")))
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch_id, seq, label, rho, n_priv, n_pub)."""
    private = F.col("event_type").isin("purchase", "signup", "error")
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("batch_id"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("label"),
        F.when(private, RHO).otherwise(0.0).alias("rho"),
        F.when(private, 1 + F.col("event_id") % 3).otherwise(0).cast("long").alias("n_priv"),
        (F.col("event_id") % 5).cast("long").alias("n_pub"),
    )


def rho_per_token_grid(spark, sf_dir):
    return sweep(spark).select("batch_size", "temperature", "svt_noise", F.round("rho", 12).alias("rho"))


def max_private_tokens_grid(spark, sf_dir):
    grid = sweep(spark).crossJoin(_values(spark, "epsilon", "double", EPSILONS))
    r = P.max_private_tokens(F.col("epsilon"), F.lit(DELTA), F.col("rho"))
    over = P.epsilon_of_rho(r * F.col("rho"), F.lit(DELTA)) > F.col("epsilon")
    return grid.select("batch_size", "temperature", "svt_noise", "epsilon", r.alias("r"), over.alias("over_budget"))


def epsilon_grid(spark, sf_dir):
    grid = sweep(spark).crossJoin(_values(spark, "r", "int", (1, 64, 177)))
    return grid.select("batch_size", "temperature", "svt_noise", "r", F.round(P.epsilon_of_rho(F.col("r") * F.col("rho"), F.lit(DELTA)), 9).alias("epsilon"))


def svt_settings(spark, sf_dir):
    return _gates(spark).select("svt_noise", P.svt_enabled(F.col("svt_threshold")).alias("enabled"))


def privacy_report(spark, sf_dir):
    """The summary of a run with one token budget for each of the documents' count."""
    n = read_table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    delta = 1.0 / F.col("n")
    rho = P.rho_per_token(F.lit(CLIP), F.lit(S), F.lit(TAU), F.lit(SIGMA))
    return n.select(
        F.round(rho, 12).alias("rho_per_token"), F.round(rho * 64, 12).alias("total_rho"),
        F.round(P.epsilon_of_rho(rho * 64, delta), 9).alias("epsilon"), F.round(delta, 12).alias("delta"),
        F.lit(64).alias("num_private_tokens"), F.lit(CLIP).alias("clip_bound"), F.lit(S).alias("batch_size"),
        F.lit(TAU).alias("temperature"), F.lit(SIGMA).alias("svt_noise"),
    )


def accountant_running(spark, sf_dir):
    rows = ledger.running_cost(events(spark, sf_dir), Workspace(spark, "running"))
    return rows.select("batch_id", "seq", F.round("running_rho", 9).alias("running_rho"))


def accountant_summary(spark, sf_dir):
    rows = ledger.summary(events(spark, sf_dir), DELTA, "batch_id")
    return rows.withColumns({c: F.round(c, 9) for c in ("total_rho", "epsilon")})


def composite_events(spark, sf_dir):
    """Composite bounds of a batch's labels, composed again and converted."""
    parts = events(spark, sf_dir).groupBy("batch_id", "label").agg(F.sum("rho").alias("rho"), F.count(F.lit(1)).alias("n"))
    bounds = parts.select("batch_id", "n", P.bound("zcdp", rho=F.col("rho")).alias("b"))
    whole = bounds.groupBy("batch_id").agg(F.sum("n").alias("n_events"), F.sum(P.rho_of(F.col("b"))).alias("rho"), F.count_if(P.is_trivial(F.col("b"))).alias("n_trivial"))
    converted = P.to_approx_dp(P.bound("zcdp", rho=F.col("rho")), F.lit(DELTA))
    return whole.select("batch_id", "n_events", "n_trivial", F.round("rho", 9).alias("rho"), F.round(converted["epsilon"], 9).alias("epsilon"))


def worst_batch_epsilon(spark, sf_dir):
    rows = ledger.worst_batch(events(spark, sf_dir), "batch_id", DELTA)
    return rows.withColumns({c: F.round(c, 9) for c in ("rho", "epsilon")})


def remaining_budget(spark, sf_dir):
    rows = ledger.remaining_budget(events(spark, sf_dir), BUDGET, Workspace(spark, "budget"))
    return rows.select("batch_id", "seq", "remaining")


def stall_detection(spark, sf_dir):
    rows = ledger.public_runs(events(spark, sf_dir), Workspace(spark, "stall"))
    return rows.select("batch_id", "seq", "run", (F.col("run") >= 3).alias("stalled"))


def generation_stats(spark, sf_dir):
    rows = ledger.generation_stats(events(spark, sf_dir))
    return rows.drop("label_distribution").withColumns({c: F.round(c, 9) for c in ("mean_tokens_per_example", "public_token_fraction")})


def label_distribution(spark, sf_dir):
    stats = ledger.generation_stats(events(spark, sf_dir))
    return stats.select(F.explode("label_distribution").alias("label", "n"))


def public_fraction_by_batch(spark, sf_dir):
    return ledger.by_batch(events(spark, sf_dir)).withColumn("public_fraction", F.round("public_fraction", 9))


QUERIES = {
    f.__name__: f
    for f in (
        rho_per_token_grid, max_private_tokens_grid, epsilon_grid, svt_settings, privacy_report, accountant_running, accountant_summary,
        composite_events, worst_batch_epsilon, remaining_budget, stall_detection, generation_stats, label_distribution,
        public_fraction_by_batch,
    )
}

_GRID = """s(batch_size) AS (VALUES (127), (255), (511), (1023), (1535), (2047)),
t(temperature) AS (VALUES (CAST(1.5 AS DOUBLE)), (2.0), (2.25)),
g(svt_threshold, svt_noise) AS (VALUES (CAST('-Infinity' AS DOUBLE), CAST(NULL AS DOUBLE)), (0.3, 0.1), (0.5, 0.2), (0.7, 0.3)),
grid AS (SELECT *, 0.5 * pow(10.0 / (batch_size * temperature), 2) + CASE WHEN svt_noise > 0 THEN 2.0 / pow(batch_size * svt_noise, 2) ELSE 0 END AS rho
         FROM s, t, g)"""
_EPS = "CASE WHEN {rho} <= 0 THEN 0.0 ELSE {rho} + sqrt(4 * ({rho}) * ln(1 / {delta})) END"
_D = "CAST(1e-5 AS DOUBLE)"
_EVENTS = f"""ev AS (SELECT user_id AS batch_id, event_id AS seq, event_type AS label,
  CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN CAST('{RHO!r}' AS DOUBLE) ELSE 0 END AS rho,
  CAST(CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN 1 + event_id % 3 ELSE 0 END AS BIGINT) AS n_priv, event_id % 5 AS n_pub FROM events)"""

ORACLE_SQL = {
    "rho_per_token_grid": f"WITH {_GRID} SELECT batch_size, temperature, svt_noise, round(rho, 12) AS rho FROM grid",
    "max_private_tokens_grid": f"""WITH {_GRID}, e(epsilon) AS (VALUES (CAST(0.5 AS DOUBLE)), (1.0), (2.0), (3.0)), r AS (
        SELECT *, CAST(greatest(1, floor((epsilon + 2 * ln(1 / {_D}) - sqrt(pow(epsilon + 2 * ln(1 / {_D}), 2) - epsilon * epsilon)) / rho)) AS INTEGER) AS r FROM grid, e)
        SELECT batch_size, temperature, svt_noise, epsilon, r, {_EPS.format(rho='r * rho', delta=_D)} > epsilon AS over_budget FROM r""",
    "epsilon_grid": f"""WITH {_GRID}, k(r) AS (VALUES (1), (64), (177))
        SELECT batch_size, temperature, svt_noise, r, round({_EPS.format(rho='r * rho', delta=_D)}, 9) AS epsilon FROM grid, k""",
    "svt_settings": f"WITH {_GRID} SELECT svt_noise, svt_threshold > '-Infinity'::DOUBLE AS enabled FROM g",
    "privacy_report": f"""WITH p AS (SELECT 0.5 * pow(10.0 / (255 * 2.0), 2) + 2.0 / pow(255 * 0.2, 2) AS rho, 1.0 / count(*) AS delta FROM documents)
        SELECT round(rho, 12) AS rho_per_token, round(rho * 64, 12) AS total_rho, round({_EPS.format(rho='rho * 64', delta='delta')}, 9) AS epsilon,
        round(delta, 12) AS delta, 64 AS num_private_tokens, CAST(10 AS DOUBLE) AS clip_bound, 255 AS batch_size, CAST(2 AS DOUBLE) AS temperature,
        CAST(0.2 AS DOUBLE) AS svt_noise FROM p""",
    "accountant_running": f"""WITH {_EVENTS} SELECT batch_id, seq, round(sum(rho) OVER (PARTITION BY batch_id ORDER BY seq), 9) AS running_rho FROM ev""",
    "accountant_summary": f"""WITH {_EVENTS} SELECT batch_id, count(*) AS n_events, count(*) FILTER (rho > 0) AS n_private, count(*) FILTER (rho <= 0) AS n_public,
        round(sum(rho), 9) AS total_rho, round({_EPS.format(rho='sum(rho)', delta=_D)}, 9) AS epsilon FROM ev GROUP BY batch_id""",
    "composite_events": f"""WITH {_EVENTS}, parts AS (SELECT batch_id, label, sum(rho) AS r, count(*) AS n FROM ev GROUP BY ALL)
        SELECT batch_id, CAST(sum(n) AS BIGINT) AS n_events, count(*) FILTER (r = 0) AS n_trivial, round(sum(r), 9) AS rho,
        round({_EPS.format(rho='sum(r)', delta=_D)}, 9) AS epsilon FROM parts GROUP BY batch_id""",
    "worst_batch_epsilon": f"""WITH {_EVENTS}, per AS (SELECT count(*) FILTER (rho > 0) AS n, sum(rho) AS r FROM ev GROUP BY batch_id)
        SELECT max(n) AS max_private_tokens, round(max(r), 9) AS rho, round({_EPS.format(rho='max(r)', delta=_D)}, 9) AS epsilon FROM per""",
    "remaining_budget": f"""WITH {_EVENTS} SELECT batch_id, seq,
        CAST({BUDGET} - coalesce(sum(n_priv) OVER (PARTITION BY batch_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remaining FROM ev""",
    "stall_detection": f"""WITH {_EVENTS}, i AS (SELECT *, sum(CASE WHEN n_priv > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY seq) AS island FROM ev),
        r AS (SELECT batch_id, seq, CASE WHEN n_priv > 0 THEN 0 ELSE row_number() OVER (PARTITION BY batch_id, island ORDER BY seq) - CASE WHEN island > 0 THEN 1 ELSE 0 END END AS run FROM i)
        SELECT batch_id, seq, run, run >= 3 AS stalled FROM r""",
    "generation_stats": f"""WITH {_EVENTS} SELECT count(*) AS num_examples, CAST(sum(n_priv + n_pub) AS BIGINT) AS total_tokens,
        round(sum(n_priv + n_pub) / count(*), 9) AS mean_tokens_per_example, CAST(sum(n_priv) AS BIGINT) AS total_private_tokens,
        CAST(sum(n_pub) AS BIGINT) AS total_public_tokens, round(sum(n_pub) / greatest(1, sum(n_priv + n_pub)), 9) AS public_token_fraction,
        max(n_priv) AS max_private_tokens_in_example FROM ev""",
    "label_distribution": f"WITH {_EVENTS} SELECT label, count(*) AS n FROM ev GROUP BY label",
    "public_fraction_by_batch": f"""WITH {_EVENTS} SELECT batch_id, CAST(sum(n_priv) AS BIGINT) AS n_private, CAST(sum(n_pub) AS BIGINT) AS n_public,
        round(sum(n_pub) / greatest(1, sum(n_priv + n_pub)), 9) AS public_fraction FROM ev GROUP BY batch_id""",
}
