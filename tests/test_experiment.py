"""Whole runs, replaced parts, secure draws, and identity of examples."""

import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrain.functions import privacy
from veilgrain.operators import evaluation, experiment, generation, ledger, protocols, reports
from veilgrain.operators.generation import Batch, Draws, Example, MarkovModel, PrivateTextEngine, Settings, SystemDraws
from veilgrain.sources import catalog, run_log
from veilgrain.workspace import Workspace

SMALL = Settings(batch_size=8, clip=10.0, temperature=2.0, max_total_tokens=10, svt_noise=0.1, svt_threshold=0.2, seed=42)


@pytest.fixture(scope="module")
def public(spark):
    return spark.createDataFrame([(f"some public words number {k % 3}",) for k in range(9)], "text string")


def examples(spark, n=40):
    return spark.createDataFrame([(k, f"text words {k:03d}", k % 4) for k in range(n)], "example_id long, text string, label int")


def tokens_of(frame):
    return sorted((r["batch_id"], r["example_no"], tuple(r["token_ids"])) for r in frame.select("batch_id", "example_no", "token_ids").collect())


def test_a_run_plans_commits_and_resumes(spark, public, tmp_path):
    engine = PrivateTextEngine("agnews", SMALL)
    path = f"file://{tmp_path}/run"
    whole = experiment.run(engine, examples(spark), public, path, epsilon=50.0, delta=1e-2, waves=3)
    planned = privacy.max_private_tokens_value(50.0, 1e-2, 10.0, 8, 2.0, 0.1)
    assert whole.report["num_private_tokens"] == planned >= 1 and whole.realized_epsilon <= whole.report["epsilon"] + 1e-9
    per = [r["n"] for r in whole.examples.groupBy("batch_id").agg(F.sum("num_private_tokens").alias("n")).collect()]
    assert max(per) <= planned and whole.realized_epsilon == pytest.approx(privacy.epsilon_value(max(per) * SMALL.rho, 1e-2) if max(per) else 0)
    assert whole.stats["num_examples"] == whole.examples.count() > 0
    with pytest.raises(FileExistsError):
        experiment.run(engine, examples(spark), public, path, 50.0, 1e-2)
    again = experiment.run(engine, examples(spark), public, path, 50.0, 1e-2, resume=True)
    assert again.new_batches == 0 and tokens_of(again.examples) == tokens_of(whole.examples)
    with pytest.raises(ValueError, match="clip_bound"):
        experiment.run(engine.with_settings(clip=9.0), examples(spark), public, path, 50.0, 1e-2, resume=True)
    header = reports.run_metadata(engine.settings, "agnews", 1e-2, 40, "x")
    _, described = engine.describe(examples(spark), Workspace(spark, "t"))
    experiment.export_log(whole, header, described, f"{tmp_path}/log")
    rows, head = evaluation.load_synthetic(spark, f"{tmp_path}/log")
    assert rows.count() == whole.examples.count() and head.first()["dataset"] == "agnews"


def test_a_run_that_died_goes_on(spark, public, tmp_path):
    """Half of the batches are committed, then a write is lost before its commit."""
    engine = PrivateTextEngine("agnews", SMALL)
    whole = experiment.run(engine, examples(spark), public, f"file://{tmp_path}/a", 50.0, 1e-2)
    path = f"file://{tmp_path}/b"
    planned, delta = experiment.plan_budget(engine, 50.0, 1e-2, 40)
    reports.metadata_frame(spark, reports.run_metadata(planned.settings, "agnews", delta, 40, path)).write.parquet(f"{path}/runs")
    ws = Workspace(spark, "t")
    bucketed, described = planned.describe(examples(spark), ws)
    first = described.filter("batch_index % 2 = 0")
    run_log.BatchTable(spark, path).append(planned.generate_batches(bucketed, first, planned.model(public, ws), ws), first, "one")
    spark.read.parquet(f"{path}/examples").withColumn("attempt", F.lit("lost")).write.mode("append").parquet(f"{path}/examples")
    rest = experiment.run(engine, examples(spark), public, path, 50.0, 1e-2, resume=True, waves=2)
    assert rest.new_batches == described.count() - first.count() and tokens_of(rest.examples) == tokens_of(whole.examples)


def test_without_a_seed_nothing_can_be_drawn_again(spark, public):
    engine = PrivateTextEngine("agnews", Settings(batch_size=8, max_private_tokens=30, max_total_tokens=30, svt_threshold=-math.inf, eos=None))
    assert engine.settings.seed is None
    one, two = (tokens_of(engine.generate(examples(spark), public, Workspace(spark, "t"))[0]) for _ in range(2))
    assert one != two
    made, _ = engine.generate(examples(spark), public, Workspace(spark, "t"))
    assert tokens_of(made) == tokens_of(made)  # stored once, read often
    draws = SystemDraws()
    got = np.array([draws.laplace(0.5, 1) for _ in range(20_000)])
    assert abs(np.abs(got).mean() - 0.5) < 0.03 and abs(got.mean()) < 0.03
    shares = Counter(draws.token(np.array([0.5, 0.25, 0.25]), "same counters") for _ in range(8000))
    assert abs(shares[0] / 8000 - 0.5) < 0.03 and abs(shares[2] / 8000 - 0.25) < 0.03


class Fixed:
    """A model that needs prompts: the next token is the number of prompts, then the end."""

    needs_prompts = True

    def backend(self, batch):
        assert len(batch.prompts) == len(batch.texts) and all(t in p for t, p in zip(batch.texts, batch.prompts))
        assert not any(t in batch.public_prompt for t in batch.texts)
        return FixedBackend(len(batch.prompts))


class FixedBackend:
    def __init__(self, n):
        self.n = n

    def _row(self, prefix):
        z = np.zeros(64)
        z[0 if prefix else self.n] = 100
        return z

    def private(self, prefix):
        return np.stack([self._row(prefix)] * self.n), np.ones(self.n)

    def public(self, prefix):
        return self._row(prefix)

    def decode(self, ids):
        return ",".join(map(str, ids))


def test_backend_and_mechanism_can_be_replaced(spark, public):
    settings = Settings(batch_size=4, clip=100.0, temperature=0.1, svt_threshold=-math.inf, max_private_tokens=2, seed=1)
    made, described = PrivateTextEngine("agnews", settings, Fixed()).generate(examples(spark), None, Workspace(spark, "t"))
    sizes = {r["batch_id"]: r["batch_size"] for r in described.collect()}
    assert {r["batch_id"]: r["text"] for r in made.collect()} == {b: f"{n},0" for b, n in sizes.items()}

    def thrice(backend, draws, s, budget, number):
        return Example((7, 7, 7), min(budget, 1), 2)

    made, _ = PrivateTextEngine("agnews", settings, Fixed(), mechanism=thrice).generate(examples(spark), None, Workspace(spark, "t"))
    assert {r["text"] for r in made.collect()} == {"7,7,7"} and made.count() == 2 * len(sizes)


def test_one_batch_and_one_example(spark, public):
    engine = PrivateTextEngine("agnews", SMALL)
    model = engine.model(public, Workspace(spark, "t"))
    batch = Batch("b", ["some public words", "words words"], [2, 1])
    made = engine.one_batch(model, batch)
    assert made == engine.one_batch(model, batch) and made[0] == engine.one_example(model, batch)
    assert engine.one_example(model, batch, budget=0)[1] == Example((), 0, 0)
    backend = model.backend(batch)
    first = generation.signals(backend, [5], SMALL)
    assert generation.signals(backend, [3, 5], SMALL)[0] is first[0]  # the last token is all that counts


def test_a_model_too_large_is_refused(spark, public):
    with pytest.raises(ValueError, match="vocabulary"):
        MarkovModel.learn(public, Workspace(spark, "t"), generation.MOST_TOKENS + 1)


def test_every_row_has_an_id(spark, tmp_path):
    rows = [("same", 1)] * 3 + [("other", 0)]
    spark.createDataFrame(rows, "text string, label int").repartition(3).write.parquet(f"{tmp_path}/train")
    spark.createDataFrame(rows, "text string, label int").write.json(f"{tmp_path}/test")
    for split, kind in (("train", "parquet"), ("test", "json")):
        loaded = catalog.FileAdapter("imdb", str(tmp_path), kind).load(spark, split)
        assert loaded.count() == loaded.select("example_id").distinct().count() == 4
        assert sorted((r["text"], r["label"]) for r in loaded.collect()) == sorted(rows)
    again = catalog.load_examples(spark, "imdb", str(tmp_path))
    assert sorted(again.collect()) == sorted(catalog.load_examples(spark, "imdb", str(tmp_path)).collect())
    twice = loaded.withColumn("example_id", F.lit(5).cast("long"))
    judged = evaluation.icl_evaluate(loaded, twice, "imdb", lambda prompts: ["Positive"] * len(prompts))
    assert judged.count() == 4 and judged.filter("label = pred").count() == 3


def test_evaluate(spark, tmp_path):
    rows = examples(spark, 80).withColumn("label", F.col("label") % 2).withColumn("text", F.when(F.col("label") == 0, "red apple").otherwise("fast car"))
    tuned = evaluation.evaluate("finetune", "imdb", rows, rows, source="real").first()
    assert tuned["accuracy"] == 1.0 and (tuned["mode"], tuned["source"], tuned["num_train"], tuned["num_test"]) == ("finetune", "real", 80, 80)

    def complete(prompts):
        return [" Positive" if p.rsplit("Text: ", 1)[1].startswith("fast") else "Negative." for p in prompts]

    asked = evaluation.evaluate("icl", "imdb", rows.drop("example_id"), rows, complete=complete).first()
    assert asked["accuracy"] == 1.0 and asked["eval_time_seconds"] > 0
    for bad in ({"mode": "other"}, {"mode": "icl"}, {"mode": "finetune", "source": "elsewhere"}):
        with pytest.raises(ValueError):
            evaluation.evaluate(name="imdb", train=rows, test=rows, **bad)
    (tmp_path / "log").write_text(json.dumps({"_metadata": {"dataset": "imdb"}}))
    with pytest.raises(ValueError, match="no synthetic"):
        evaluation.load_synthetic(spark, str(tmp_path / "log"))


def test_accountants_can_be_replaced(spark):
    class Plain(privacy.ZcdpAccountant):
        def guarantee(self, total, delta):
            return total * 2

    assert protocols.Accountant
    events = spark.createDataFrame([("b", 0.25), ("b", 0.0)], "batch string, rho double")
    assert ledger.summary(events, 1e-5, "batch", accountant=Plain()).first()["epsilon"] == 0.5
    cost = spark.range(1).select(privacy.ZcdpAccountant().cost(privacy.bound("zcdp", rho=F.lit(0.3))).alias("c")).first()["c"]
    assert cost == 0.3


def test_seeded_draws_match_their_columns(spark):
    """The loop's draws and the column expressions are the same numbers."""
    from veilgrain.functions import hashing

    row = spark.range(1).select(hashing.uniform(42, "b", 3, "x").alias("u"), hashing.laplace(hashing.uniform(42, "b", 3, "x"), 0.7).alias("l")).first()
    assert row["u"] == Draws(42, "b").uniform(3, "x") and row["l"] == pytest.approx(Draws(42, "b").laplace(0.7, 3, "x"), rel=1e-12)


def test_models_are_saved_and_loaded_in_workers(spark, public, tmp_path):
    model = MarkovModel.learn(public, Workspace(spark, "t"), 12)
    model.save(spark, f"file://{tmp_path}/m")
    back = MarkovModel.load(spark, f"file://{tmp_path}/m")
    assert back.tokens == model.tokens and all(np.array_equal(back.row(k), model.row(k)) for k in range(len(model.tokens)))
    tokens, pairs = model.tokens, model.pairs
    lazy = generation.LazyModel("m", lambda: MarkovModel(tokens, pairs), needs_prompts=False)
    made, _ = PrivateTextEngine("agnews", SMALL, lazy).generate(examples(spark), None, Workspace(spark, "t"))
    same, _ = PrivateTextEngine("agnews", SMALL, model).generate(examples(spark), None, Workspace(spark, "t"))
    assert tokens_of(made) == tokens_of(same)


def test_tokens_are_of_any_script(spark, tmp_path):
    public = spark.createDataFrame([("Größe größe über das 2. Haus, слово",)], "text string")
    words = [r["token"] for r in generation.vocabulary(public, 10).collect()]
    assert {"größe", "über", "das", "haus", "слово"} <= set(words)
    model = MarkovModel.learn(public, Workspace(spark, "t"), 10)
    assert model.backend(Batch("b", ["GRÖSSE слово"], [1])).pairs[0][model.index["слово"]] == {0: 1}


def test_a_neural_classifier_learns(spark):
    rows = examples(spark, 120).withColumn("label", F.col("label") % 3)
    rows = rows.withColumn("text", F.element_at(F.array(F.lit("red apple round"), F.lit("fast blue car"), F.lit("old stone house")), F.col("label") + 1))
    predicted, losses = evaluation.train_classifier(rows, rows, kind="neural", epochs=40)
    assert evaluation.scores(predicted).first()["accuracy"] == 1.0 and losses[-1] < losses[0]
    with pytest.raises(ValueError, match="neural"):
        evaluation.train_classifier(rows, rows, kind="other")


def test_command_line(spark, tmp_path):
    from veilgrain.__main__ import main

    rows = [(f"red apple {k}", 0) for k in range(30)] + [(f"fast car {k}", 1) for k in range(30)]
    for split in ("train", "test"):
        spark.createDataFrame(rows, "text string, label int").write.parquet(f"{tmp_path}/data/{split}")
    spark.createDataFrame([("red apple fast car",)], "text string").write.parquet(f"{tmp_path}/public")
    common = ["--dataset", "imdb", "--data", f"{tmp_path}/data"]
    run = ["generate", *common, "--public", f"{tmp_path}/public", "--epsilon", "40", "--out", f"file://{tmp_path}/run", "--batch-size", "10", "--svt-noise", "0.5", "--seed", "3", "--vocabulary", "8"]
    first = main(run, spark)
    assert first["stats"]["num_examples"] > 0 and first["realized_epsilon"] <= first["report"]["epsilon"] + 1e-9
    assert main([*run, "--resume", "--waves", "2"], spark)["new_batches"] == 0
    with pytest.raises(SystemExit):
        main(["generate", *common], spark)
    found = main(["evaluate", *common, "--out", f"{tmp_path}/result"], spark)
    assert found["accuracy"] == 1.0 and found["source"] == "real"
    assert main(["generate", *common, "--no-svt", "--public", f"{tmp_path}/public", "--epsilon", "9", "--out", f"file://{tmp_path}/run2", "--batch-size", "10"], spark)["report"]["svt_noise"] is None
