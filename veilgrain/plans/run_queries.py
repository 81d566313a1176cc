"""Queries on run logs, evaluation, generation and streams."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.functions.text import match_label
from veilgrain.operators import batching, evaluation, generation, ledger
from veilgrain.plans import batch_queries, ledger_queries
from veilgrain.plans.batch_queries import BATCHES_CTE, EXAMPLES_CTE, NAME, S, examples
from veilgrain.sources import run_log
from veilgrain.streaming import runs
from veilgrain.workspace import Workspace, read_table

VOCABULARY, ALPHA = 64, 0.5
SETTINGS = generation.Settings(batch_size=S, clip=4.0, temperature=1.0, svt_threshold=0.3, svt_noise=0.05, max_private_tokens=12, max_total_tokens=24, seed=42)


def _log(spark: SparkSession, sf_dir: str, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Example rows and markers as a run over the documents would have logged them; every third batch is not committed."""
    bucketed = ws.write(batching.assign_buckets(examples(spark, sf_dir), S), "bucketed")
    described = batching.describe_batches(batching.batch_table(bucketed, NAME), NAME, ws)
    described = ws.write(described, "descriptors")
    joined = bucketed.join(described.withColumnRenamed("batch_size", "source_batch_size"), ["label", "bucket"])
    rows = joined.select(
        "example_id", "text", "label", "label_name", F.lit(1).alias("num_private_tokens"), (F.length("text") - 1).alias("num_public_tokens"),
        F.length("text").alias("num_total_tokens"), "batch_id", "batch_index", "total_batches", "source_batch_size",
        F.col("example_id").alias("pos"),
    )
    markers = described.filter("batch_index % 3 <> 0").withColumn("num_examples", F.col("batch_size"))
    return rows, markers.withColumn("pos", F.col("batch_index").cast("long"))


def checkpoint_commit_join(spark, sf_dir):
    """Rows of committed batches in marker order; every fifth batch has two markers, and its rows come twice."""
    rows, markers = _log(spark, sf_dir, Workspace(spark, "commits"))
    twice = markers.unionByName(markers.filter("batch_index % 5 = 0").withColumn("pos", F.col("pos") + 1000))
    return run_log.commit_join(rows, twice).select("batch_id", "marker_pos", "example_id", "label")


def descriptor_recovery(spark, sf_dir):
    """Markers of committed batches, rows of the others; every seventh marker has lost its rows."""
    rows, markers = _log(spark, sf_dir, Workspace(spark, "recovery"))
    return run_log.recover_descriptors(rows.filter("batch_index % 7 <> 1"), markers)


def union_resumed(spark, sf_dir):
    rows, markers = _log(spark, sf_dir, Workspace(spark, "resumed"))
    resumed = rows.join(markers.select("batch_id"), "batch_id", "left_semi")
    fresh = rows.join(markers.select("batch_id"), "batch_id", "left_anti")
    both = resumed.withColumn("origin", F.lit("resumed")).unionByName(fresh.withColumn("origin", F.lit("new")))
    return both.groupBy("origin", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("num_total_tokens").alias("tokens"))


def _metadata(spark: SparkSession, sf_dir: str, **changes) -> DataFrame:
    n = read_table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("num_source_examples"))
    given = {
        "dataset": NAME, "epsilon": 1.0, "delta": 1e-5, "batch_size": S, "clip_bound": 10.0, "temperature": 2.0, "public_temperature": 1.5,
        "svt_threshold": float("-inf"), "svt_noise": None, "top_k_vocab": 0, "max_private_tokens": 100, "max_total_tokens": 256, "seed": 42,
        "micro_batch_size": 32, "output_path": "a.jsonl", "checkpoint_format": 1,
    } | changes
    return n.select(*[F.lit(v).alias(k) for k, v in given.items()], "num_source_examples")


def metadata_compat(spark, sf_dir):
    base = _metadata(spark, sf_dir)
    cases = {"same": {}, "other_path": {"output_path": "b.jsonl", "epsilon": 2.0}, "other_seed": {"seed": 7, "top_k_vocab": 5}, "gate": {"svt_noise": 0.2}}
    out = None
    for name, changes in cases.items():
        one = run_log.compatible(base, _metadata(spark, sf_dir, **changes)).select(F.lit(name).alias("case"), "compatible", F.array_join("differences", ",").alias("differences"))
        out = one if out is None else out.unionByName(one)
    return out


def jsonl_roundtrip(spark, sf_dir):
    """Write a log with an uncommitted third of the batches and a torn last line, read it back."""
    ws = Workspace(spark, "jsonl")
    rows, markers = _log(spark, sf_dir, ws)
    order = ["batch_index", "kind", "example_id"]
    lines = run_log.example_lines(rows).select("batch_index", F.lit(0).alias("kind"), "example_id", "line")
    lines = lines.unionByName(run_log.marker_lines(markers).select("batch_index", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("example_id"), "line"))
    header = run_log.header_line({"dataset": NAME, "epsilon": 1.0, "svt_threshold": float("-inf"), "checkpoint_format": 1})
    ends = spark.range(0, 2, 1, 1).select(
        F.when(F.col("id") == 0, -1).otherwise(1 << 30).cast("int").alias("batch_index"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("example_id"),
        F.when(F.col("id") == 0, header).otherwise('{"text": "torn').alias("line"),
    )
    path = f"{ws.path}/log"
    run_log.write_log(lines.unionByName(ends), path, order)
    return run_log.read_log(spark, path).examples.select("batch_id", "batch_index", "label", "text", "num_total_tokens", "source_batch_size")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality as the truth, toxicity as the prediction."""
    return read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("pred"))


def accuracy(spark, sf_dir):
    return evaluation.scores(_judged(spark, sf_dir)).select("num_test", F.round("accuracy", 9).alias("accuracy"))


def classification_report(spark, sf_dir):
    rows = evaluation.classification_report(_judged(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def macro_weighted_f1(spark, sf_dir):
    return evaluation.scores(_judged(spark, sf_dir)).select(*[F.round(c, 9).alias(c) for c in ("macro_f1", "weighted_f1")])


def running_accuracy(spark, sf_dir):
    rows = evaluation.running_accuracy(_judged(spark, sf_dir), Workspace(spark, "accuracy"), "doc_id")
    return rows.withColumn("accuracy", F.round("accuracy", 9))


def label_match(spark, sf_dir):
    names = {0: "user", 1: "The", 2: "Der", 3: "is"}
    return read_table(spark, sf_dir, "documents").select("doc_id", match_label(F.col("text"), names).alias("pred"))


def icl_eval(spark, sf_dir):
    """Few-shot evaluation with a stand-in model: the length of the prompt picks the answer."""
    rows = examples(spark, sf_dir)

    def complete(prompts: list[str]) -> list[str]:
        return [f" {('World', 'Sports', 'Business', 'Sci/Tech')[len(p) % 4]}.\nmore" for p in prompts]

    return evaluation.icl_evaluate(rows, rows, NAME, complete).select("example_id", "label", "pred")


def finetune_eval(spark, sf_dir):
    """Train on four fifths of the documents, test on the rest."""
    rows = examples(spark, sf_dir)
    predicted, _ = evaluation.train_classifier(rows.filter("example_id % 5 <> 0"), rows.filter("example_id % 5 = 0"))
    return evaluation.scores(predicted).select("num_test", "accuracy", "macro_f1", "weighted_f1")


def _public(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark")


def vocab_build(spark, sf_dir):
    return generation.vocabulary(_public(spark, sf_dir), VOCABULARY)


def bigram_counts(spark, sf_dir):
    return generation.bigrams(_public(spark, sf_dir), vocab_build(spark, sf_dir))


def markov_logits(spark, sf_dir):
    rows = generation.public_logits(bigram_counts(spark, sf_dir), VOCABULARY, ALPHA)
    return rows.withColumn("logit", F.round("logit", 9))


def _engine() -> generation.PrivateTextEngine:
    return generation.PrivateTextEngine(NAME, SETTINGS, partial(generation.MarkovModel.learn, vocab_size=VOCABULARY, alpha=ALPHA))


def generate_dataset(spark, sf_dir):
    """Every batch's examples; token ids as one string."""
    made, _ = _engine().generate(examples(spark, sf_dir), _public(spark, sf_dir), Workspace(spark, "generate"))
    return made.withColumn("token_ids", F.array_join(F.col("token_ids").cast("array<string>"), ","))


def generate_resumed(spark, sf_dir):
    """Only batches that are not committed (every third) are generated."""
    ws = Workspace(spark, "generate_resumed")
    commits = batch_queries._descriptors(spark, sf_dir).filter("batch_index % 3 <> 0").select("batch_id")
    made, _ = _engine().generate(examples(spark, sf_dir), _public(spark, sf_dir), ws, ws.write(commits, "commits"))
    return made.groupBy("batch_index").agg(F.count(F.lit(1)).alias("n_examples"), F.sum("num_private_tokens").alias("n_private"))


def generated_stats(spark, sf_dir):
    made = generate_dataset(spark, sf_dir)
    rows = made.select("label", F.col("num_private_tokens").cast("long").alias("n_priv"), F.col("num_public_tokens").cast("long").alias("n_pub"))
    return ledger.generation_stats(rows).drop("label_distribution")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    private = F.col("event_type").isin("purchase", "signup", "error")
    return rows.select(F.col("user_id").alias("batch_id"), F.when(private, ledger_queries.RHO).otherwise(0.0).alias("rho"))


def streaming_accountant(spark, sf_dir):
    ws = Workspace(spark, "stream")
    out = f"{ws.path}/totals"
    totals = runs.accountant(_event_stream(spark, sf_dir), ledger_queries.DELTA)
    runs.drain(totals, f"{ws.path}/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(out), "complete")
    return spark.read.parquet(out).withColumns({c: F.round(c, 9) for c in ("total_rho", "epsilon")})


def streaming_budget_guard(spark, sf_dir):
    ws = Workspace(spark, "guard")
    out = f"{ws.path}/state"
    guarded = runs.budget_guard(_event_stream(spark, sf_dir), 10 * ledger_queries.RHO + 1e-9)
    runs.drain(guarded, f"{ws.path}/checkpoint", lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(out), "update")
    rows = spark.read.parquet(out).groupBy("batch_id").agg(F.max_by(F.struct("spent", "refused"), "n").alias("s"))
    return rows.select("batch_id", F.round("s.spent", 9).alias("spent"), F.col("s.refused").alias("refused"))


QUERIES = {
    f.__name__: f
    for f in (
        checkpoint_commit_join, descriptor_recovery, union_resumed, metadata_compat, jsonl_roundtrip, accuracy, classification_report,
        macro_weighted_f1, running_accuracy, label_match, icl_eval, finetune_eval, vocab_build, bigram_counts, markov_logits,
        generate_dataset, generate_resumed, generated_stats, streaming_accountant, streaming_budget_guard,
    )
}

_J = "j AS (SELECT doc_id, quality AS label, toxic AS pred FROM labels)"
_REPORT = f"""{_J}, c AS (SELECT label AS class FROM j UNION SELECT pred FROM j),
k AS (SELECT class, count(*) FILTER (label = class AND pred = class) AS hit, count(*) FILTER (label = class) AS t, count(*) FILTER (pred = class) AS q
      FROM c, j GROUP BY class),
r AS (SELECT class, CASE WHEN q > 0 THEN hit / q ELSE 0.0 END AS precision, CASE WHEN t > 0 THEN hit / t ELSE 0.0 END AS recall,
      CASE WHEN t + q > 0 THEN 2 * hit / (t + q) ELSE 0.0 END AS f1, t AS support FROM k)"""
TOKEN = generation.TOKEN
_VOCAB = f"""words AS (SELECT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token FROM benchmark),
top AS (SELECT token, count(*) AS n FROM words GROUP BY token ORDER BY n DESC, token LIMIT {VOCABULARY - 2}),
vocab AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS token_id, token, n FROM top
          UNION ALL SELECT 0, '<eos>', 0 UNION ALL SELECT 1, '<unk>', 0)"""
_BIGRAMS = f"""{_VOCAB}, framed AS (SELECT list_concat(list_concat(['<eos>'], regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}')), ['<eos>']) AS w FROM benchmark),
pairs AS (SELECT unnest(w[1:len(w) - 1]) AS a, unnest(w[2:len(w)]) AS b FROM framed),
grams AS (SELECT coalesce(x.token_id, 1) AS prev, coalesce(y.token_id, 1) AS token, count(*) AS n
          FROM pairs LEFT JOIN vocab x ON x.token = a LEFT JOIN vocab y ON y.token = b GROUP BY ALL)"""


def _draw(number: str, at: str, what: str) -> str:
    """The uniform of one counter of a batch."""
    return f"(('0x' || substr(sha256('{SETTINGS.seed}|' || batch_id || '|' || {number} || '|' || {at} || '|{what}'), 1, 13))::BIGINT / 4503599627370496.0)"


def _noise(scale: float, number: str, at: str, what: str) -> str:
    centred = f"(greatest({_draw(number, at, what)}, 1.1102230246251565e-16) - 0.5)"
    return f"(-{scale!r} * sign({centred}) * ln(1 - 2 * abs({centred})))"


def walk_sql(budget: int = SETTINGS.max_private_tokens) -> str:
    """CTEs that generate every batch token by token; ``made`` has a row for each example.

    ``steps`` holds, for each batch and previous token, the distance and the cumulative
    weights of the private and of the public draw; ``walk`` goes through them.
    """
    s = SETTINGS

    def cums(z: str, tau: float) -> str:
        weight = f"CAST(round(exp(({z} - top) / {tau!r}) / sum(exp(({z} - top) / {tau!r})) OVER part * 1099511627776.0) AS BIGINT)"
        return f"SELECT *, {weight} AS w FROM (SELECT *, max({z}) OVER part AS top FROM {{source}} WINDOW part AS (PARTITION BY {{keys}})) WINDOW part AS (PARTITION BY {{keys}})"

    def lists(z: str, tau: float, source: str, keys: str) -> str:
        inner = cums(z, tau).format(source=source, keys=keys)
        summed = f"SELECT {keys}, token, CAST(sum(w) OVER (PARTITION BY {keys} ORDER BY token) AS BIGINT) AS c FROM ({inner})"
        return f"SELECT {keys}, list(c ORDER BY token) AS cums, max(c) AS total FROM ({summed}) GROUP BY {keys}"

    bar = f"{s.svt_threshold!r} + {_noise(s.svt_noise, '{n}', '{at}', 'threshold')}"
    return f"""{BATCHES_CTE}, {_BIGRAMS},
totals AS (SELECT prev, sum(n) AS total FROM grams GROUP BY prev),
pub AS MATERIALIZED (SELECT a.token_id AS prev, b.token_id AS token, ln((coalesce(g.n, 0) + {ALPHA}) / (coalesce(total, 0) + {ALPHA} * (SELECT count(*) FROM vocab))) AS z
  FROM vocab a CROSS JOIN vocab b LEFT JOIN grams g ON g.prev = a.token_id AND g.token = b.token_id LEFT JOIN totals t ON t.prev = a.token_id),
own_words AS (SELECT example_id, list_concat(list_concat(['<eos>'], regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}')), ['<eos>']) AS w FROM ex),
own_pairs AS (SELECT example_id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:len(w)]) AS b FROM own_words),
own AS (SELECT example_id, coalesce(x.token_id, 1) AS prev, coalesce(y.token_id, 1) AS token, count(*) AS n
  FROM own_pairs LEFT JOIN vocab x ON x.token = a LEFT JOIN vocab y ON y.token = b GROUP BY ALL),
of AS (SELECT example_id, batch_id FROM bucketed b JOIN grouped USING (label, bucket)),
raised AS (SELECT of.batch_id, of.example_id, p.prev, p.token, p.z + 2.0 * ln(1 + coalesce(o.n, 0)) AS z FROM of CROSS JOIN pub p LEFT JOIN own o USING (example_id, prev, token)),
topped AS (SELECT *, max(z) OVER (PARTITION BY example_id, prev) AS top FROM raised),
parts AS (SELECT *, greatest(-{s.clip!r}, z - top + {s.clip!r}) AS clipped, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY example_id, prev) AS p FROM topped),
zbar AS MATERIALIZED (SELECT batch_id, prev, token, sum(clipped) / {s.batch_size}.0 AS z, sum(p) / {s.batch_size}.0 AS p FROM parts GROUP BY ALL),
shown AS (SELECT prev, token, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY prev) AS q FROM (SELECT *, max(z) OVER (PARTITION BY prev) AS top FROM pub)),
far AS (SELECT batch_id, prev, sum(abs(p - q)) AS distance FROM zbar JOIN shown USING (prev, token) GROUP BY ALL),
steps AS MATERIALIZED (SELECT f.batch_id, f.prev, distance, a.cums AS acums, a.total AS atotal, b.cums AS bcums, b.total AS btotal FROM far f
  JOIN ({lists('z', s.temperature, 'zbar', 'batch_id, prev')}) a ON a.batch_id = f.batch_id AND a.prev = f.prev JOIN ({lists('z', s.public_temperature, 'pub', 'prev')}) b ON b.prev = f.prev),
walk AS (
  SELECT batch_id, 0 AS number, 0 AS spot, 0 AS prev, {bar.format(n="0", at="0")} AS bar, 0 AS spent, 0 AS private, 0 AS idle, -1 AS token, false AS cost, false AS ended, -1 AS example FROM grouped
  UNION ALL
  SELECT batch_id, CASE WHEN ends THEN number + 1 ELSE number END, CASE WHEN ends THEN 0 ELSE spot + 1 END, CASE WHEN ends THEN 0 ELSE picked END,
    CASE WHEN ends THEN {bar.format(n="(number + 1)", at="0")} WHEN pays THEN {bar.format(n="number", at="(spot + 1)")} ELSE bar END,
    CASE WHEN ends THEN spent + paid ELSE spent END, CASE WHEN ends THEN 0 ELSE paid END,
    CASE WHEN NOT ends THEN idle WHEN paid > 0 THEN 0 ELSE idle + 1 END, picked, pays,
    ends AND (spent + paid >= {budget} OR number + 1 >= {max(budget, 10)} OR (paid = 0 AND idle = 2)), number
  FROM (SELECT *, private + CASE WHEN pays THEN 1 ELSE 0 END AS paid, picked = 0 OR spot + 1 = {s.max_total_tokens} OR private + CASE WHEN pays THEN 1 ELSE 0 END >= {budget} - spent AS ends
    FROM (SELECT *, CAST(CASE WHEN pays THEN len(list_filter(acums, lambda c: c <= floor(u * atotal))) ELSE len(list_filter(bcums, lambda c: c <= floor(u * btotal))) END AS INTEGER) AS picked
      FROM (SELECT w.* EXCLUDE (token, cost, ended, example), x.* EXCLUDE (batch_id, prev), distance + {_noise(2 * s.svt_noise, 'number', 'spot', 'query').replace('batch_id', 'w.batch_id')} >= bar AS pays,
          {_draw('number', 'spot', 'token').replace('batch_id', 'w.batch_id')} AS u
        FROM walk w JOIN steps x ON x.batch_id = w.batch_id AND x.prev = w.prev WHERE NOT ended)))
),
tokens AS (SELECT batch_id, example, row_number() OVER (PARTITION BY batch_id, example ORDER BY place) AS i, token, cost
  FROM (SELECT *, CASE WHEN number > example THEN 1000000 ELSE spot END AS place FROM walk WHERE example >= 0)),
made AS (SELECT batch_id, example AS example_no, string_agg(CAST(t.token AS VARCHAR), ',' ORDER BY i) AS token_ids,
    coalesce(string_agg(v.token, ' ' ORDER BY i) FILTER (t.token > 1), '') AS text, CAST(count(*) FILTER (cost) AS INTEGER) AS num_private_tokens,
    CAST(count(*) FILTER (NOT cost) AS INTEGER) AS num_public_tokens, CAST(count(*) AS INTEGER) AS num_total_tokens
  FROM tokens t JOIN vocab v ON v.token_id = t.token GROUP BY ALL)"""


_FIELDS = "batch_id, batch_index, total_batches, label, label_name, batch_size"

ORACLE_SQL = {
    "checkpoint_commit_join": f"""WITH {BATCHES_CTE}, m AS (SELECT batch_id, CAST(batch_index AS BIGINT) AS p FROM described WHERE batch_index % 3 <> 0
        UNION ALL SELECT batch_id, batch_index + 1000 FROM described WHERE batch_index % 3 <> 0 AND batch_index % 5 = 0)
        SELECT batch_id, p AS marker_pos, example_id, b.label FROM bucketed b JOIN grouped USING (label, bucket) JOIN m USING (batch_id)""",
    "descriptor_recovery": f"WITH {BATCHES_CTE} SELECT {_FIELDS}, batch_index % 3 <> 0 AS committed FROM described WHERE batch_index % 3 <> 0 OR batch_index % 7 <> 1",
    "union_resumed": f"""WITH {BATCHES_CTE} SELECT CASE WHEN batch_index % 3 <> 0 THEN 'resumed' ELSE 'new' END AS origin, b.label, count(*) AS n,
        CAST(sum(length(text)) AS BIGINT) AS tokens FROM bucketed b JOIN grouped g USING (label, bucket) JOIN described d USING (batch_id) GROUP BY ALL""",
    "metadata_compat": """SELECT "case", d = '' AS compatible, d AS differences FROM (SELECT "case", concat_ws(',', CASE WHEN noise IS DISTINCT FROM NULL THEN 'svt_noise' END,
        CASE WHEN k IS DISTINCT FROM 0 THEN 'top_k_vocab' END, CASE WHEN seed IS DISTINCT FROM 42 THEN 'seed' END) AS d
        FROM (VALUES ('same', NULL, 0, 42), ('other_path', NULL, 0, 42), ('other_seed', NULL, 5, 7), ('gate', 0.2, 0, 42)) t("case", noise, k, seed))""",
    "jsonl_roundtrip": f"""WITH {BATCHES_CTE} SELECT batch_id, batch_index, b.label, text, CAST(length(text) AS INTEGER) AS num_total_tokens, d.batch_size AS source_batch_size
        FROM bucketed b JOIN grouped g USING (label, bucket) JOIN described d USING (batch_id) WHERE batch_index % 3 <> 0""",
    "accuracy": f"WITH {_J} SELECT count(*) AS num_test, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0 END), 9) AS accuracy FROM j",
    "classification_report": f"WITH {_REPORT} SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM r",
    "macro_weighted_f1": f"WITH {_REPORT} SELECT round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM r",
    "running_accuracy": f"""WITH {_J}, o AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, sum(CASE WHEN label = pred THEN 1 ELSE 0 END) OVER (ORDER BY doc_id) AS h FROM j)
        SELECT n, round(h / n, 9) AS accuracy FROM o WHERE n % 50 = 0""",
    "label_match": r"""WITH w AS (SELECT doc_id, lower(regexp_replace(trim(split_part(trim(text, chr(10) || ' '), chr(10), 1)), '[.,;:!?]+$', '')) AS w FROM documents)
        SELECT doc_id, CASE WHEN w = '' THEN -1 WHEN contains(w, 'user') OR contains('user', w) THEN 0 WHEN contains(w, 'the') OR contains('the', w) THEN 1
        WHEN contains(w, 'der') OR contains('der', w) THEN 2 WHEN contains(w, 'is') OR contains('is', w) THEN 3 ELSE -1 END AS pred FROM w""",
    "icl_eval": "WITH p AS ("
    + batch_queries.ORACLE_SQL["icl_prompt_balanced"]
    + f"), e AS (WITH {EXAMPLES_CTE} SELECT example_id, label FROM ex) SELECT example_id, label, CAST(length(prompt) % 4 AS INTEGER) AS pred FROM p JOIN e USING (example_id)",
    "vocab_build": f"WITH {_VOCAB} SELECT token_id, token, n FROM vocab",
    "bigram_counts": f"WITH {_BIGRAMS} SELECT prev, token, n FROM grams",
    "markov_logits": f"""WITH {_BIGRAMS}, g AS (SELECT CAST(a.range AS INTEGER) AS prev, CAST(b.range AS INTEGER) AS token FROM range({VOCABULARY}) a, range({VOCABULARY}) b),
        t AS (SELECT prev, sum(n) AS total FROM grams GROUP BY prev)
        SELECT prev, token, round(ln((coalesce(n, 0) + {ALPHA}) / (coalesce(total, 0) + {ALPHA * VOCABULARY})), 9) AS logit
        FROM g LEFT JOIN grams USING (prev, token) LEFT JOIN t USING (prev)""",
    "generate_dataset": f"""WITH RECURSIVE {walk_sql()} SELECT batch_id, example_no, text, token_ids, num_private_tokens, num_public_tokens, num_total_tokens,
        batch_index, total_batches, label, label_name, batch_size AS source_batch_size FROM made JOIN described USING (batch_id)""",
    "generate_resumed": f"""WITH RECURSIVE {walk_sql()} SELECT batch_index, count(*) AS n_examples, CAST(sum(num_private_tokens) AS BIGINT) AS n_private
        FROM made JOIN described USING (batch_id) WHERE batch_index % 3 = 0 GROUP BY batch_index""",
    "generated_stats": f"""WITH RECURSIVE {walk_sql()} SELECT count(*) AS num_examples, CAST(sum(num_total_tokens) AS BIGINT) AS total_tokens,
        sum(num_total_tokens) / count(*) AS mean_tokens_per_example, CAST(sum(num_private_tokens) AS BIGINT) AS total_private_tokens,
        CAST(sum(num_public_tokens) AS BIGINT) AS total_public_tokens, sum(num_public_tokens) / greatest(1, sum(num_total_tokens)) AS public_token_fraction,
        CAST(max(num_private_tokens) AS BIGINT) AS max_private_tokens_in_example FROM made""",
    "streaming_accountant": ledger_queries.ORACLE_SQL["accountant_summary"].replace("count(*) FILTER (rho <= 0) AS n_public,", ""),
    "streaming_budget_guard": f"""SELECT user_id AS batch_id, round(least(p, 10) * CAST('{ledger_queries.RHO!r}' AS DOUBLE), 9) AS spent, greatest(p - 10, 0) AS refused
        FROM (SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'signup', 'error')) AS p FROM events GROUP BY user_id)""",
}
