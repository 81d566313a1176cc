import hashlib
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilgrain.functions import hashing, logits, privacy, text


def one(spark, col, row=None, schema=None):
    frame = spark.createDataFrame([row], schema) if row else spark.range(1)
    return frame.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("n", [1, 3, 7, 100, 2**31 - 1])
def test_hash_bucket_is_the_digest_modulo_n(spark, n):
    texts = ["foo bar baz", "", "é漢\n", "0\nfoo", "x" * 999]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "label int, text string")
    got = rows.select(hashing.hash_bucket(hashing.bucket_key(F.col("label"), F.col("text")), F.lit(n)).alias("b")).collect()
    assert [r["b"] for r in got] == [int(hashlib.sha256(f"{k}\n{t}".encode()).hexdigest(), 16) % n for k, t in enumerate(texts)]


def test_uniform_and_laplace(spark):
    rows = spark.range(4000).select(hashing.uniform(42, F.col("id"), "t").alias("u"))
    stats = rows.agg(F.min("u"), F.max("u"), F.avg("u"), F.avg(F.abs(hashing.laplace(F.col("u"), 0.5))), F.avg(hashing.laplace(F.col("u"), 0.5))).first()
    assert 0 <= stats[0] and stats[1] < 1 and abs(stats[2] - 0.5) < 0.02 and abs(stats[3] - 0.5) < 0.03 and abs(stats[4]) < 0.04
    assert math.isfinite(one(spark, hashing.laplace(F.lit(0.0), 1.0)))
    assert 0 <= one(spark, hashing.secure_uniform()) < 1


# Epsilon, delta, batch size, clip, temperature, gate noise -> rho of a token, tokens, epsilon at these and at one more
GOLDEN = [
    (1, 1e-5, 255, 10, 2, None, 1.9223375624759708e-04, 108, 0.998560, 1.003269),
    (1, 1e-5, 255, 10, 2, 0.2, 9.6116878123798540e-04, 21, 0.984307, 1.007957),
    (2, 1e-5, 127, 10, 1.5, 0.1, 1.3777805333388442e-02, 5, 1.850028, 2.033807),
    (0.5, 1e-4, 511, 10, 2.25, 0.3, 1.2292678655527044e-04, 53, 0.496439, 0.501162),
    (3, 1e-5, 1023, 10, 2, None, 1.1944246169958024e-05, 14524, 2.999954, 3.000064),
    (3, 1 / 120000, 255, 10, 2, 0.2, 9.6116878123798540e-04, 177, 2.991244, 3.000163),
]


@pytest.mark.parametrize(("eps", "delta", "s", "c", "tau", "sigma", "rho", "r", "at", "beyond"), GOLDEN)
def test_planning(spark, eps, delta, s, c, tau, sigma, rho, r, at, beyond):
    cols = privacy.rho_per_token(F.lit(float(c)), F.lit(s), F.lit(float(tau)), F.lit(sigma).cast("double"))
    assert one(spark, cols) == pytest.approx(rho, rel=1e-14) == privacy.rho_token_value(c, s, tau, sigma)
    assert one(spark, privacy.max_private_tokens(F.lit(float(eps)), F.lit(delta), cols)) == r
    assert privacy.max_private_tokens_value(eps, delta, c, s, tau, sigma) == r
    assert one(spark, privacy.epsilon_of_rho(r * cols, F.lit(delta))) == pytest.approx(at, abs=1e-6)
    assert privacy.epsilon_value((r + 1) * rho, delta) == pytest.approx(beyond, abs=1e-6)


def test_planning_edges(spark):
    assert one(spark, privacy.max_private_tokens(F.lit(1.0), F.lit(1e-5), F.lit(0.0))) == privacy.UNLIMITED_TOKENS
    assert one(spark, privacy.max_private_tokens(F.lit(1e-9), F.lit(1e-5), F.lit(1.0))) == 1
    assert one(spark, privacy.epsilon_of_rho(F.lit(0.0), F.lit(1e-5))) == 0.0
    assert one(spark, privacy.epsilon_of_rho(F.lit(0.061515), F.lit(1e-3))) == pytest.approx(1.3652, abs=1e-4)


def test_bounds(spark):
    z, w = privacy.bound("zcdp", rho=F.lit(0.1)), privacy.bound("approx_dp", epsilon=F.lit(0.0), delta=F.lit(1e-5))
    frame = spark.range(1).select(z.alias("z"), w.alias("w"))
    assert frame.select(privacy.is_trivial(F.col("w")), privacy.is_trivial(F.col("z"))).first()[:] == (True, False)
    assert frame.select(privacy.rho_of(privacy.compose(F.col("z"), F.col("z")))).first()[0] == pytest.approx(0.2)
    assert frame.select(privacy.rho_of(privacy.scale(F.col("z"), F.lit(3)))).first()[0] == pytest.approx(0.3)
    assert frame.select(privacy.to_approx_dp(F.col("z"), F.lit(1e-5))).first()[0]["family"] == "approx_dp"
    for bad in (privacy.bound("zcdp", rho=F.col("id") - 1.0), privacy.bound("approx_dp", epsilon=F.lit(1.0), delta=F.col("id") + 2.0), privacy.rho_of(privacy.bound("approx_dp", epsilon=F.col("id") + 1.0, delta=F.lit(0.1)))):
        with pytest.raises(PySparkException):
            spark.range(1).select(bad).collect()


@pytest.mark.parametrize(("z", "c"), [([3.0, -10.0, 7.0, 1.0], 5), ([100.0, -200.0, 0.0, 50.0], 4), ([2.0, 1.0, 0.5, -0.3], 10)])
def test_clip(spark, z, c):
    got = one(spark, logits.clip(F.col("z"), c), (z,), "z array<double>")
    assert got == pytest.approx([max(-c, x - max(z) + c) for x in z])
    assert max(got) == c and min(got) >= -c
    assert one(spark, logits.clip(F.col("z"), c), (got,), "z array<double>") == pytest.approx(got)


def test_softmax_mask_and_draw(spark):
    row, schema = ([float(k) for k in range(16)], [0.0] * 16), "p array<double>, z array<double>"
    masked = one(spark, logits.top_k_mask(F.col("z"), F.col("p"), 3), row, schema)
    assert [k for k, x in enumerate(masked) if x > -math.inf] == [13, 14, 15]
    probs = one(spark, logits.softmax(logits.top_k_mask(F.col("z"), F.col("p"), 3)), row, schema)
    assert probs[:13] == [0.0] * 13 and sum(probs) == pytest.approx(1)
    assert one(spark, logits.top_k_mask(F.col("z"), F.col("p"), 99), row, schema) == row[1]
    assert [k for k, x in enumerate(one(spark, logits.top_k_mask(F.col("p"), F.col("z"), 2), row, schema)) if x > -math.inf] == [0, 1]
    for u, want in ((0.0, 13), (0.34, 14), (0.999999, 15)):
        assert one(spark, logits.draw(logits.quantised(logits.softmax(logits.top_k_mask(F.col("z"), F.col("p"), 3))), F.lit(u)), row, schema) == want


@pytest.mark.parametrize("s", ["  a b \n", " x\x85", "\x1cq\x1f", "", "　word　", "tab\t"])
def test_strip(spark, s):
    assert one(spark, text.strip(F.col("s")), (s,), "s string") == s.strip()


@pytest.mark.parametrize(
    ("answer", "want", "compat"),
    [(" World.\nmore", 0, 0), ("sports!!", 1, 1), ("it is business", 2, 2), ("sci", 3, 3), ("xyz", -1, -1), ("", -1, 0), ("  \n", -1, 0)],
)
def test_match_label(spark, answer, want, compat):
    names = {0: "World", 1: "Sports", 2: "Business", 3: "Sci/Tech"}
    assert one(spark, text.match_label(F.col("a"), names), (answer,), "a string") == want
    assert one(spark, text.match_label(F.col("a"), names, compat=True), (answer,), "a string") == compat


def test_render_leaves_braces_of_values(spark):
    assert one(spark, text.render("{label}: {example}", label=F.lit("L"), example=F.lit("{label} {x}"))) == "L: {label} {x}"
    assert one(spark, text.without_bos(F.lit("<bos><bos>x"))) == "<bos>x"


def test_sampling_is_linear_in_the_vocabulary(spark):
    """20 rows of 50,000 tokens through clip, mask, softmax and draw."""
    import time

    import numpy as np

    from veilgrain.operators.logits import sample

    rng = np.random.default_rng(3)
    z = [rng.normal(size=50_000) * 8 for _ in range(20)]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(z)], "id long, z array<double>").repartition(4).cache()
    rows.count()
    began = time.monotonic()
    got = rows.select("id", sample(logits.top_k_mask(logits.clip(F.col("z"), 9.0), F.col("z"), 500), 2.0, 42, F.col("id")).alias("t")).collect()
    assert time.monotonic() - began < 30
    for r in got:
        own = np.maximum(-9.0, z[r["id"]] - z[r["id"]].max() + 9.0)
        own[np.argsort(-z[r["id"]], kind="stable")[500:]] = -np.inf
        p = np.exp((own - own.max()) / 2.0)
        total = np.cumsum(np.rint(p / p.sum() * 2.0**40).astype(np.int64))
        u = int(hashlib.sha256(f"42|{r['id']}|token".encode()).hexdigest()[:13], 16) / 2**52
        assert r["t"] == int(np.searchsorted(total, math.floor(u * total[-1]), side="right"))
    rows.unpersist()
