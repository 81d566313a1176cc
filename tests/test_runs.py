import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilgrain.operators import batching, evaluation, generation, ledger, logits, prompts
from veilgrain.operators.generation import Draws, Example, Settings, generate_batch, generate_example
from veilgrain.operators.prefix import running
from veilgrain.sources import catalog, run_log
from veilgrain.streaming import runs
from veilgrain.workspace import Workspace


def examples(spark, n=40, labels=3):
    return spark.createDataFrame([(k, f"text {k:03d}", k % labels) for k in range(n)], "example_id long, text string, label int")


def test_batches_are_disjoint_pure_and_stable(spark):
    rows = batching.assign_buckets(examples(spark), 5).collect()
    assert len(rows) == 40 and len({r["example_id"] for r in rows}) == 40
    n = {label: max(1, math.ceil(sum(r["label"] == label for r in rows) / 5)) for label in range(3)}
    for r in rows:
        assert r["bucket"] == int(hashlib.sha256(f"{r['label']}\n{r['text']}".encode()).hexdigest(), 16) % n[r["label"]]
    fixed = batching.assign_buckets(examples(spark), 5, num_batches=7).agg(F.max("bucket")).first()[0]
    assert fixed < 7


def test_descriptors(spark):
    doubled = examples(spark).unionByName(examples(spark).filter("example_id < 5"))
    bucketed = batching.assign_buckets(doubled, 5)
    members = {}
    for r in bucketed.collect():
        members.setdefault((r["label"], r["bucket"]), []).append(r["text"])
    found = batching.describe_batches(batching.batch_table(bucketed, "agnews"), "agnews", Workspace(spark, "t")).orderBy("batch_index").collect()
    assert [r["batch_index"] for r in found] == list(range(1, len(members) + 1)) and {r["total_batches"] for r in found} == {len(members)}
    for r, (key, texts) in zip(found, sorted(members.items())):
        assert (r["label"], r["bucket"], r["batch_size"]) == (*key, len(texts))
        assert r["batch_id"] == hashlib.sha256("\n".join(["agnews", str(key[0]), *sorted(texts)]).encode()).hexdigest()
        assert r["label_name"] == catalog.DATASETS["agnews"].labels[key[0]]
    with pytest.raises(PySparkException):
        catalog.named(spark.createDataFrame([(9,)], "label int"), "agnews").collect()


def test_running_totals_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice([7, 7, 7, 7, 1, None]), k, rng.randrange(5)) for k in range(3000)]
    table = spark.createDataFrame(rows, "k long, at long, v long").repartition(6)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = {r["at"]: (r["s"], r["m"]) for r in running(table, Workspace(spark, "t"), ["k"], ["at"], {"s": "v"}, {"m": "v"}).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    total, most = {}, {}
    for k, at, v in rows:
        total[k] = total.get(k, 0) + v
        most[k] = max(most.get(k, 0), v)
        assert found[at] == (total[k], most[k])


def test_catalog(spark, tmp_path):
    assert catalog.choices() == ["agnews", "dbpedia", "imdb", "trec", "yelp"]
    with pytest.raises(ValueError, match="agnews"):
        catalog.dataset("nope")
    spark.createDataFrame([(f"c{k}", k % 14, 1) for k in range(100)], "content string, label int, extra int").write.parquet(f"{tmp_path}/train")
    whole = catalog.load_examples(spark, "dbpedia", str(tmp_path))
    assert whole.columns == ["example_id", "text", "label"] and whole.count() == 100
    some = catalog.load_examples(spark, "dbpedia", str(tmp_path), num_examples=10)
    assert some.count() == 10 and sorted(some.collect()) == sorted(catalog.load_examples(spark, "dbpedia", str(tmp_path), num_examples=10).collect())
    assert catalog.load_examples(spark, "dbpedia", str(tmp_path), num_examples=1000).count() == 100
    with pytest.raises(ValueError, match="split"):
        catalog.load_examples(spark, "dbpedia", str(tmp_path), split="dev")


def test_prompts(spark):
    rows = catalog.named(examples(spark, 4, 4), "trec")
    got = rows.select(prompts.private_prompt("trec", F.col("label_name"), F.col("text")).alias("p"), prompts.public_prompt("trec", F.col("label_name")).alias("q")).orderBy("p").first()
    assert got["p"].startswith("# [User]\nHere are questions with Answer Type: Abbreviation.\n\n```\nText: text 000\n```\n\n")
    assert got["p"].endswith("\n\n# [Assistant]\n```\nQuestion:") and "text 0" not in got["q"] and "capital of France" in got["q"]
    shots = prompts.balanced_shots(examples(spark, 12, 4), "agnews", 4)
    assert [(r["label"], r["example_id"]) for r in shots.orderBy("label").collect()] == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert prompts.balanced_shots(examples(spark), "agnews", 0).count() == 0
    assert prompts.balanced_shots(examples(spark), "agnews", 0, compat=True).count() == 1
    test = examples(spark, 2)
    assert prompts.balanced_prompt(shots, "agnews", test).orderBy("example_id").first()["prompt"].endswith("Text: text 000\nCategory:")
    simple = prompts.simple_prompt(examples(spark, 3), "agnews", test, 2).orderBy("example_id").first()["prompt"]
    assert simple == "Classify the following examples:\nText: text 000\nAnswer: World\nText: text 001\nAnswer: Sports\n\nText: text 000\nAnswer:"


def test_clip_and_aggregate_divides_by_the_expected_size(spark):
    rows = spark.createDataFrame([(1, [100.0] + [-100.0] * 19)] * 3, "batch int, z array<double>")
    (zbar,) = (r["zbar"] for r in logits.clip_and_aggregate(rows, "batch", "z", 2.0, 5).collect())
    assert zbar[0] == pytest.approx(1.2) and zbar[1] == pytest.approx(-1.2)
    public = spark.createDataFrame([(1, [0.0] * 19 + [100.0])], "batch int, z array<double>")
    assert logits.distances(rows, public, "batch", "z", 3).first()["distance"] == pytest.approx(2, abs=1e-6)


class Peaked:
    """Two prompts over 16 tokens; ``private`` peaks at one token, ``public`` at another."""

    def __init__(self, at, shown):
        self.at, self.shown = at, shown

    def _z(self, k):
        z = np.zeros(16)
        if k is not None:
            z[k] = 100
        return z

    def private(self, prefix):
        return np.stack([self._z(self.at)] * 2), np.array([3.0, 1.0])

    def public(self, prefix):
        return self._z(self.shown)

    def decode(self, ids):
        return " ".join(map(str, ids))


def small(**changes):
    return Settings(**{"batch_size": 4, "clip": 1.0, "temperature": 1.0, "svt_threshold": -math.inf, "svt_noise": 0.2, "eos": None} | changes)


def test_one_example():
    free = Peaked(None, None)
    made = generate_example(free, Draws(1, "b"), small(max_total_tokens=9), 5, 0)
    assert (made.n_private, made.n_public, len(made.ids)) == (5, 0, 5)
    assert generate_example(free, Draws(1, "b"), small(), 0, 0) == Example((), 0, 0)
    assert len(generate_example(free, Draws(1, "b"), small(max_total_tokens=7), 50, 0).ids) == 7
    ended = generate_example(Peaked(5, 5), Draws(1, "b"), small(clip=50.0, eos=5), 50, 0)
    assert ended.ids == (5,) and ended.n_private == 1
    top = generate_example(Peaked(None, 9), Draws(1, "b"), small(top_k=1), 6, 0)
    assert set(top.ids) == {9}
    assert generate_example(free, Draws(1, "b"), small(max_total_tokens=9), 5, 0) == made


def test_the_gate():
    public = generate_example(Peaked(3, 3), Draws(1, "b"), small(svt_threshold=1.0, svt_noise=0.001, max_total_tokens=8), 5, 0)
    assert (public.n_private, public.n_public) == (0, 8) and set(public.ids) == {3}
    private = generate_example(Peaked(3, 7), Draws(1, "b"), small(svt_threshold=0.5, svt_noise=0.001, clip=50.0, max_total_tokens=8), 5, 0)
    assert (private.n_private, private.n_public) == (5, 0) and set(private.ids) == {3}
    assert generate_example(Peaked(3, 3), Draws(1, "b"), small(svt_threshold=-999.0, svt_noise=0.001), 2, 0).n_private == 2
    assert generate_example(Peaked(3, 7), Draws(1, "b"), small(svt_threshold=999.0, svt_noise=0.001, max_total_tokens=4), 2, 0).n_public == 4


@pytest.mark.parametrize(
    ("script", "r", "kept", "budgets"),
    [
        ([(5, 0), (5, 0)], 10, 2, [10, 5]), ([(0, 3), (0, 2), (0, 1), (0, 1)], 10, 3, [10] * 3),
        ([(0, 1), (0, 1), (1, 0), (0, 1), (0, 1), (0, 1)], 10, 6, [10, 10, 10, 9, 9, 9]), ([(0, 0)], 10, 0, [10]), ([], 0, 0, []), ([(4, 1), (6, 0)], 10, 2, [10, 6]),
    ],
)
def test_a_batch_stops(script, r, kept, budgets):
    asked = []

    def one(backend, draws, s, budget, number):
        asked.append(budget)
        a, b = script[number]
        return Example(tuple(range(a + b)), a, b)

    assert len(generate_batch(None, None, small(max_private_tokens=r), one)) == kept and asked == budgets


def test_markov_backend_walk(spark):
    public = spark.createDataFrame([("the cat sat on the mat",), ("the dog sat",)], "text string")
    vocab = generation.vocabulary(public, 6)
    words = [r["token"] for r in vocab.orderBy("token_id").collect()]
    assert words[:4] == ["<eos>", "<unk>", "the", "sat"]
    table = generation.public_logits(generation.bigrams(public, vocab), 6, 0.5)
    z = np.array([r["logit"] for r in table.orderBy("prev", "token").collect()]).reshape(6, 6)
    assert np.allclose(np.exp(z).sum(axis=1), 1)
    model = generation.MarkovModel.learn(public, Workspace(spark, "t"), 6, 0.5, 2.0)
    assert all(np.allclose(model.row(k), z[k]) for k in range(6))
    backend = model.backend(generation.Batch("b", ["the the", None], [2, 1]))
    rows, weight = backend.private([2])
    assert rows[0][2] == pytest.approx(z[2][2] + 2 * math.log(2)) and np.allclose(rows[1], z[2]) and weight.tolist() == [2, 1]


def small_model(public, ws):
    return generation.MarkovModel.learn(public, ws, 12)


def test_generation_is_reproducible_and_resumes(spark):
    public = spark.createDataFrame([(f"some public words number {k % 3}",) for k in range(9)], "text string")
    engine = generation.PrivateTextEngine("agnews", Settings(batch_size=8, max_private_tokens=6, max_total_tokens=10, svt_noise=0.1, svt_threshold=0.2, seed=42), small_model)
    made, described = engine.generate(examples(spark), public, Workspace(spark, "t"))
    again, _ = engine.generate(examples(spark), public, Workspace(spark, "t2"))
    key = lambda rows: sorted((r["batch_id"], r["example_no"], tuple(r["token_ids"])) for r in rows.collect())
    assert key(made) == key(again) and made.count() > 0
    per = made.groupBy("batch_id").agg(F.sum("num_private_tokens").alias("n")).collect()
    assert all(r["n"] <= 6 for r in per)
    assert all(r["num_private_tokens"] + r["num_public_tokens"] == r["num_total_tokens"] == len(r["token_ids"]) for r in made.collect())
    done = described.filter("batch_index <= 2").select("batch_id")
    rest, _ = engine.generate(examples(spark), public, Workspace(spark, "t3"), done)
    assert key(rest) == [k for k in key(made) if k[0] not in {r["batch_id"] for r in done.collect()}]
    worst = max(r["n"] for r in per)
    assert engine.realized_epsilon(made, 1e-5) == pytest.approx(worst and generation.epsilon_value(worst * engine.settings.rho, 1e-5))


def lines(*records):
    return [r if isinstance(r, str) else json.dumps(r) for r in records]


def marker(batch, index, n=1):
    return {"_batch_complete": {"batch_id": batch, "batch_index": index, "total_batches": 3, "label": 0, "label_name": "World", "batch_size": 5, "num_examples": n}}


def row(batch, text, **more):
    return {"text": text, "label": 0, "label_name": "World", "num_private_tokens": 1, "num_public_tokens": 2, "num_total_tokens": 3, "batch_id": batch, "batch_index": 1, "total_batches": 3} | more


def read(spark, tmp_path, records, **options):
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(records))
    return run_log.read_log(spark, str(path), **options)


def test_log_recovery(spark, tmp_path):
    header = '{"_metadata": {"dataset": "agnews", "svt_threshold": -Infinity, "seed": 42}}'
    log = read(spark, tmp_path, lines(header, row("b1", "x"), "", marker("b1", 1), row("b2", "y", source_batch_size=9), marker("b3", 3), row("b3", "z"), {"text": "loose"}))
    assert [r["text"] for r in log.examples.collect()] == ["x", "z"]  # a marker may come before its rows
    assert log.metadata.first()["svt_threshold"] == -math.inf and log.metadata.first()["seed"] == 42
    described = {r["batch_id"]: (r["batch_size"], r["committed"]) for r in log.descriptors.collect()}
    assert described == {"b1": (5, True), "b2": (9, False), "b3": (5, True)}


def test_log_stops_at_the_first_broken_line(spark, tmp_path):
    records = lines(row("b1", "x"), marker("b1", 1), '{"text": "to', row("b2", "y"), marker("b2", 2))
    assert [r["text"] for r in read(spark, tmp_path, records).examples.collect()] == ["x"]
    assert [r["text"] for r in read(spark, tmp_path, records, strict=False).examples.collect()] == ["x", "y"]


def test_simple_and_empty_logs(spark, tmp_path):
    assert [r["text"] for r in read(spark, tmp_path, lines(row("b1", "x"), {"text": "loose"})).examples.collect()] == ["x", "loose"]
    assert read(spark, tmp_path, []).examples.count() == 0


def test_batch_table_ignores_lost_attempts(spark, tmp_path):
    table = run_log.BatchTable(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([("b1", "x")], "batch_id string, text string")
    rows.withColumn("attempt", F.lit("lost")).write.parquet(f"file://{tmp_path}/t/examples")
    table.append(rows, rows.select("batch_id"), "a1")
    table.append(rows, rows.select("batch_id"), "a2")
    assert [r["text"] for r in table.read().collect()] == ["x"]


def test_output_path(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        run_log.output_path(spark, str(tmp_path), "run", resume=True)
    for name in ("run_1.jsonl", "run_2.jsonl", "other_9.jsonl"):
        (tmp_path / name).write_text("")
    assert run_log.output_path(spark, str(tmp_path), "run", resume=True).endswith("run_2.jsonl")
    with pytest.raises(FileExistsError):
        run_log.output_path(spark, str(tmp_path), "run", False, f"{tmp_path}/run_1.jsonl")
    assert run_log.output_path(spark, str(tmp_path), "run", resume=False).startswith(f"{tmp_path}/run_2")


def test_report_counts_the_union_of_classes(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (1, -1), (2, 2), (2, 2)]
    found = {r["class"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in evaluation.classification_report(spark.createDataFrame(pairs, "label int, pred int")).collect()}
    assert found == {0: (1.0, 0.5, pytest.approx(2 / 3), 2), 1: (0.5, 0.5, 0.5, 2), 2: (1.0, 1.0, 1.0, 2), -1: (0.0, 0.0, 0.0, 0)}
    one = evaluation.scores(spark.createDataFrame(pairs, "label int, pred int")).first()
    assert one["accuracy"] == pytest.approx(4 / 6) and one["macro_f1"] == pytest.approx((2 / 3 + 0.5 + 1 + 0) / 4)


def test_classifier_learns(spark):
    rows = examples(spark, 200, 2).withColumn("text", F.when(F.col("label") == 0, "red apple round").otherwise("fast blue car"))
    predicted, losses = evaluation.train_classifier(rows.filter("example_id < 150"), rows.filter("example_id >= 150"))
    assert evaluation.scores(predicted).first()["accuracy"] == 1.0 and losses[-1] < losses[0]


def test_stats_of_nothing(spark):
    none = spark.createDataFrame([], "label int, n_priv long, n_pub long")
    assert ledger.generation_stats(none).count() == 0
    some = spark.createDataFrame([(0, 0, 4), (0, 4, 0)], "label int, n_priv long, n_pub long")
    got = ledger.generation_stats(some).first()
    assert got["public_token_fraction"] == 0.5 and got["label_distribution"] == {0: 2} and got["mean_tokens_per_example"] == 4


def test_streams_go_on_from_their_checkpoint(spark, tmp_path):
    schema = "batch_id long, rho double"
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    write = lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(out)
    for part in ([(1, 0.5), (2, 0.1)], [(1, 0.25), (1, 0.5)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        runs.drain(runs.budget_guard(stream, 0.8), mark, write, "update")
    last = spark.read.parquet(out).groupBy("batch_id").agg(F.max_by(F.struct("spent", "refused"), "n").alias("s"))
    assert {r["batch_id"]: (round(r["s"]["spent"], 6), r["s"]["refused"]) for r in last.collect()} == {1: (0.75, 1), 2: (0.1, 0)}


def test_generation_stream_commits(spark, tmp_path):
    table = run_log.BatchTable(spark, f"file://{tmp_path}/t")
    source = f"{tmp_path}/batches"
    for ids in (["a", "b"], ["b", "c"]):  # a batch that comes again is generated again, and its first commit stays
        spark.createDataFrame([(i,) for i in ids], "batch_id string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("batch_id string").parquet(source)
        runs.generate_stream(stream, f"{tmp_path}/mark", lambda part: (part.withColumn("text", F.lit("x")), part), table)
    assert sorted(r["batch_id"] for r in table.read().collect()) == ["a", "b", "c"]
