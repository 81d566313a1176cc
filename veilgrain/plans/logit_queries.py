"""Queries of logit algebra on ``embeddings``: a vector is one prompt's logits, its label the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.functions import logits as L
from veilgrain.operators import logits as G
from veilgrain.workspace import read_table

SCALE, C, S, TAU, THETA, SIGMA, K, SEED = 20.0, 5.0, 50, 2.0, 0.5, 0.2, 8, 42


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * SCALE).alias("z"))


def public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vector of each label stands for the public prompt."""
    return vectors(spark, sf_dir).groupBy("label").agg(F.min_by("z", "vec_id").alias("z"))


def _long(rows: DataFrame, keys: list[str], values, name: str) -> DataFrame:
    return rows.select(*keys, F.posexplode(values).alias("token", "v")).select(*keys, "token", F.round("v", 8).alias(name))


def clip_logits(spark, sf_dir):
    return _long(vectors(spark, sf_dir), ["vec_id"], L.clip(F.col("z"), C), "clipped")


def softmax_temperature(spark, sf_dir):
    return _long(vectors(spark, sf_dir), ["vec_id"], L.softmax(F.col("z"), TAU), "p")


def _zbar(spark, sf_dir):
    return G.clip_and_aggregate(vectors(spark, sf_dir), "label", "z", C, S)


def clip_aggregate(spark, sf_dir):
    return _long(_zbar(spark, sf_dir), ["label"], F.col("zbar"), "zbar")


def _distance(spark, sf_dir):
    return G.distances(vectors(spark, sf_dir), public(spark, sf_dir), "label", "z", S)


def svt_distance(spark, sf_dir):
    return _distance(spark, sf_dir).withColumn("distance", F.round("distance", 8))


def _masked(spark, sf_dir):
    shown = public(spark, sf_dir).withColumnRenamed("z", "shown")
    return _zbar(spark, sf_dir).join(shown, "label").select("label", "shown", L.top_k_mask(F.col("zbar"), F.col("shown"), K).alias("z"))


def topk_mask(spark, sf_dir):
    return _long(_masked(spark, sf_dir), ["label"], F.col("z"), "z").filter(F.col("z") > float("-inf"))


def _threshold():
    return G.noisy_threshold(THETA, SIGMA, SEED, F.col("label"))


def laplace_threshold(spark, sf_dir):
    return public(spark, sf_dir).select("label", F.round(_threshold(), 8).alias("threshold"))


def _gated(spark, sf_dir):
    private = G.gate(F.col("distance"), _threshold(), SIGMA, SEED, F.col("label"))
    return _distance(spark, sf_dir).select("label", private.alias("is_private"))


def svt_gate(spark, sf_dir):
    return _gated(spark, sf_dir)


def categorical_sample(spark, sf_dir):
    return _zbar(spark, sf_dir).select("label", G.sample(F.col("zbar"), TAU, SEED, F.col("label")).alias("token"))


def one_step_token(spark, sf_dir):
    """One step for each batch: gate, mask, then a private or a public draw."""
    both = _masked(spark, sf_dir).join(_gated(spark, sf_dir), "label")
    shown = L.top_k_mask(F.col("shown"), F.col("shown"), K)
    private = G.sample(F.col("z"), TAU, SEED, F.col("label"))
    free = G.sample(shown, 1.5, SEED, F.col("label"))
    return both.select("label", "is_private", F.when(F.col("is_private"), private).otherwise(free).alias("token"))


def micro_batch_chunks(spark, sf_dir):
    """Sizes of chunks of 32 prompts within a label, by vec_id."""
    from veilgrain.operators.prefix import running
    from veilgrain.workspace import Workspace

    placed = running(vectors(spark, sf_dir).select("vec_id", "label"), Workspace(spark, "chunks"), ["label"], ["vec_id"], sums={"n": "1"})
    return placed.groupBy("label", F.floor((F.col("n") - 1) / 32).alias("chunk")).agg(F.count(F.lit(1)).alias("size"))


QUERIES = {
    f.__name__: f
    for f in (
        clip_logits, clip_aggregate, softmax_temperature, svt_distance, topk_mask, laplace_threshold, svt_gate, categorical_sample,
        one_step_token, micro_batch_chunks,
    )
}

_U = "(('0x' || substr(sha256('42|' || label || '|{what}'), 1, 13))::BIGINT / 4503599627370496.0)"


def _laplace(what: str, scale: float) -> str:
    centred = f"(greatest({_U.format(what=what)}, 1.1102230246251565e-16) - 0.5)"
    return f"(-{scale} * sign({centred}) * ln(1 - 2 * abs({centred})))"


_CTE = f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * {SCALE}) AS z FROM embeddings),
l AS (SELECT vec_id, label, CAST(generate_subscripts(z, 1) - 1 AS INTEGER) AS token, unnest(z) AS v, list_max(z) AS top FROM v),
clipped AS (SELECT vec_id, label, token, greatest(-{C}, v - top + {C}) AS c FROM l),
zbar AS (SELECT label, token, sum(c) / {float(S)} AS zbar FROM clipped GROUP BY ALL),
soft AS (SELECT vec_id, label, token, exp(v - top) / sum(exp(v - top)) OVER (PARTITION BY vec_id) AS p FROM l),
firsts AS (SELECT label, min(vec_id) AS vec_id FROM v GROUP BY label),
pub AS (SELECT l.label, token, v FROM l JOIN firsts USING (vec_id)),
dist AS (SELECT label, sum(abs(m.p - q.p)) AS distance FROM (SELECT label, token, sum(p) / {float(S)} AS p FROM soft GROUP BY ALL) m
         JOIN (SELECT s.label, token, p FROM soft s JOIN firsts USING (vec_id)) q USING (label, token) GROUP BY label),
kept AS (SELECT label, token, v FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY v DESC, token) AS r FROM pub) WHERE r <= {K}),
gated AS (SELECT label, distance + {_laplace('query', 2 * SIGMA)} >= {THETA} + {_laplace('threshold', SIGMA)} AS is_private FROM dist)"""


def _drawn(source: str, tau: float) -> str:
    """First token of ``source`` (label, token, z) whose cumulative weight exceeds the draw."""
    return f"""SELECT label, min(token) AS token FROM (
      SELECT label, token, sum(w) OVER (PARTITION BY label ORDER BY token) AS cum, sum(w) OVER (PARTITION BY label) AS total FROM (
        SELECT label, token, CAST(round(exp((z - top) / {tau}) / sum(exp((z - top) / {tau})) OVER (PARTITION BY label) * 1099511627776.0) AS BIGINT) AS w
        FROM (SELECT label, token, z, max(z) OVER (PARTITION BY label) AS top FROM ({source}))))
      WHERE cum > floor({_U.format(what='token')} * total) GROUP BY label"""


ORACLE_SQL = {
    "clip_logits": f"WITH {_CTE} SELECT vec_id, token, round(c, 8) AS clipped FROM clipped",
    "clip_aggregate": f"WITH {_CTE} SELECT label, token, round(zbar, 8) AS zbar FROM zbar",
    "softmax_temperature": f"""WITH {_CTE} SELECT vec_id, token,
        round(exp((v - top) / {TAU}) / sum(exp((v - top) / {TAU})) OVER (PARTITION BY vec_id), 8) AS p FROM l""",
    "svt_distance": f"WITH {_CTE} SELECT label, round(distance, 8) AS distance FROM dist",
    "topk_mask": f"WITH {_CTE} SELECT label, token, round(zbar, 8) AS z FROM zbar SEMI JOIN kept USING (label, token)",
    "laplace_threshold": f"WITH {_CTE} SELECT label, round({THETA} + {_laplace('threshold', SIGMA)}, 8) AS threshold FROM firsts",
    "svt_gate": f"WITH {_CTE} SELECT * FROM gated",
    "categorical_sample": f"WITH {_CTE} {_drawn('SELECT label, token, zbar AS z FROM zbar', TAU)}",
    "one_step_token": f"""WITH {_CTE}, a AS ({_drawn('SELECT label, token, zbar AS z FROM zbar SEMI JOIN kept USING (label, token)', TAU)}),
        b AS ({_drawn('SELECT label, token, v AS z FROM kept', 1.5)})
        SELECT g.label, is_private, CASE WHEN is_private THEN a.token ELSE b.token END AS token FROM gated g JOIN a USING (label) JOIN b USING (label)""",
    "micro_batch_chunks": """SELECT label, chunk, count(*) AS size FROM (
        SELECT label, CAST(floor((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) / 32.0) AS BIGINT) AS chunk FROM embeddings) GROUP BY ALL""",
}
