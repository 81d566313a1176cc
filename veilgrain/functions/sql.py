"""The formulas as SQL functions of a session. Their bodies are SQL, so calls are inlined into the plan.

What a lambda would evaluate for every element is bound by a transform of one element first.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "rho_per_token(clip DOUBLE, batch_size INT, temperature DOUBLE, svt_noise DOUBLE)": (
        "DOUBLE",
        "0.5D * power(clip / (batch_size * temperature), 2) + CASE WHEN svt_noise > 0 THEN 2 / power(batch_size * svt_noise, 2) ELSE 0 END",
    ),
    "epsilon_of_rho(rho DOUBLE, delta DOUBLE)": ("DOUBLE", "CASE WHEN rho <= 0 THEN 0D ELSE rho + sqrt(4 * rho * ln(1 / delta)) END"),
    "clip_logits(z ARRAY<DOUBLE>, c DOUBLE)": ("ARRAY<DOUBLE>", "element_at(transform(array(array_max(z) - c), off -> transform(z, x -> greatest(-c, x - off))), 1)"),
    "laplace(u DOUBLE, b DOUBLE)": ("DOUBLE", "-b * signum(greatest(u, power(2D, -53)) - 0.5D) * ln(1 - 2 * abs(greatest(u, power(2D, -53)) - 0.5D))"),
    "hash_bucket(key STRING, n BIGINT)": (
        "BIGINT",
        "element_at(transform(array(sha2(key, 256)), "
        "h -> aggregate(sequence(0, 7), 0L, (acc, i) -> (acc * 4294967296L + CAST(conv(substring(h, i * 8 + 1, 8), 16, 10) AS BIGINT)) % n)), 1)",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; their names."""
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [s.split("(")[0] for s in FUNCTIONS]
