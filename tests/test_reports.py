import json
import math
from functools import partial
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilgrain.functions import hashing, privacy, sql
from veilgrain.operators import evaluation, prompts, protocols, reports
from veilgrain.operators.generation import MarkovModel, PrivateTextEngine, Settings
from veilgrain.sources import run_log
from veilgrain.workspace import Workspace

RUN = Settings(clip=10.0, batch_size=255, temperature=2.0, svt_noise=0.2, max_private_tokens=177)


def test_report_and_metadata(spark, tmp_path):
    assert reports.privacy_report(RUN, 64, 1e-3)["epsilon"] == pytest.approx(1.365247, abs=1e-6)
    assert reports.resolve_delta(None, 50) == 0.02
    with pytest.raises(ValueError, match="delta"):
        reports.resolve_delta(0.0, 50)
    off = Settings(svt_threshold=-math.inf, svt_noise=0.2)
    assert reports.privacy_metadata(off, 1e-5)["svt_noise"] is None and off.rho < RUN.rho
    header = reports.run_metadata(off, "agnews", 1e-5, 1000, "x.jsonl")
    (tmp_path / "log").write_text(run_log.header_line(header))
    back = run_log.read_log(spark, str(tmp_path / "log")).metadata
    assert run_log.compatible(back, reports.metadata_frame(spark, header)).first()[:] == (True, [])
    other = reports.metadata_frame(spark, header | {"seed": 1, "epsilon": 9.0})
    assert run_log.compatible(back, other).first()[:] == (False, ["seed"])


def test_result_sink(spark, tmp_path):
    scored = evaluation.scores(spark.createDataFrame([(0, 0), (1, 0)], "label int, pred int"))
    reports.save_result(reports.evaluation_result(scored, "icl", "synthetic", "agnews", 10, 1.5), f"{tmp_path}/r")
    saved = json.loads(next(Path(tmp_path, "r").glob("*.json")).read_text())
    assert saved["accuracy"] == 0.5 and saved["per_class"]["1"]["recall"] == 0.0 and saved["mode"] == "icl"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        reports.save_result(scored, f"{tmp_path}/r")


def test_sql_functions_equal_the_columns(spark):
    assert "hash_bucket" in sql.register(spark)
    rows = spark.createDataFrame([("k1", 0.1), ("k2", 0.9), ("", 0.0)], "k string, u double")
    got = rows.selectExpr("hash_bucket(k, 7)", "laplace(u, 0.5)", "rho_per_token(10, 255, 2, 0.2)", "epsilon_of_rho(0.1, 1e-5)", "clip_logits(array(3D, -10D, 7D), 5)").collect()
    want = rows.select(
        hashing.hash_bucket(F.col("k"), F.lit(7)), hashing.laplace(F.col("u"), 0.5),
        privacy.rho_per_token(F.lit(10.0), F.lit(255), F.lit(2.0), F.lit(0.2)), privacy.epsilon_of_rho(F.lit(0.1), F.lit(1e-5)),
    ).collect()
    for a, b in zip(got, want):
        assert list(a)[:4] == pytest.approx(list(b), rel=1e-14) and a[4] == [1.0, -5.0, 5.0]


def test_extension_points(spark):
    rows = spark.createDataFrame([(k, f"text {k}", k % 2) for k in range(30)], "example_id long, text string, label int")
    policy = protocols.HashLabelBatching(5, num_batches=3)
    assert policy(rows).agg(F.max("bucket")).first()[0] < 3
    built = protocols.TemplatePrompts("imdb", prompts.chat_wrap)
    assert rows.select(built.public(F.lit("Positive"))).first()[0].startswith("<start_of_turn>user\nHere are texts with Sentiment: Positive.")
    public = spark.createDataFrame([("a few public words",)], "text string")
    engine = PrivateTextEngine("imdb", Settings(batch_size=5, max_private_tokens=3, max_total_tokens=5), partial(MarkovModel.learn, vocab_size=8), policy=policy)
    made, described = engine.generate(rows, public, Workspace(spark, "t"))
    assert described.count() <= 6 and made.count() > 0
