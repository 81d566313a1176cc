"""Queries on loading, committing, reporting and whole runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.functions import privacy as P
from veilgrain.operators import evaluation, experiment, reports
from veilgrain.operators.protocols import HashLabelBatching, TemplatePrompts
from veilgrain.plans import batch_queries, ledger_queries, run_queries
from veilgrain.plans.batch_queries import BATCHES_CTE, EXAMPLES_CTE, NAME, S, examples
from veilgrain.plans.run_queries import SETTINGS
from veilgrain.sources import catalog, run_log
from veilgrain.streaming import runs
from veilgrain.workspace import Workspace, read_table

DELTA = 1e-5
#: Pays for the private tokens of the settings and for hardly more.
EPSILON = P.epsilon_value(SETTINGS.max_private_tokens * SETTINGS.rho, DELTA) * (1 + 1e-9)


def load_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored in the shape of a dataset with other column names, each twice over, and loaded: every row has an id."""
    ws = Workspace(spark, "load")
    rows = examples(spark, sf_dir).select(F.col("text").alias("content"), "label", F.lit(1).alias("extra"))
    ws.write(rows.unionByName(rows), "train")
    loaded = catalog.FileAdapter("dbpedia", ws.path).load(spark, "train")
    return loaded.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("example_id").alias("n_ids"), F.countDistinct("text").alias("n_texts"))


def batch_commit(spark, sf_dir):
    """Even batches are committed, odd ones written but never committed, every third batch written and committed once more."""
    ws = Workspace(spark, "commit")
    rows, _ = run_queries._log(spark, sf_dir, ws)
    rows = ws.write(rows.select("example_id", "text", "batch_id", "batch_index"), "rows")
    table = run_log.BatchTable(spark, f"{ws.path}/table")
    table.append(rows.filter("batch_index % 2 = 0"), rows.filter("batch_index % 2 = 0").select("batch_id").distinct(), "first")
    rows.filter("batch_index % 2 = 1").withColumn("attempt", F.lit("lost")).write.mode("append").parquet(f"{table.path}/examples")
    table.append(rows.filter("batch_index % 3 = 0"), rows.filter("batch_index % 3 = 0").select("batch_id").distinct(), "second")
    return table.read().groupBy("batch_index").agg(F.count(F.lit(1)).alias("n"), F.sum("example_id").alias("ids"))


def run_header(spark, sf_dir):
    """The header of a run over the documents, delta by their number."""
    n = read_table(spark, sf_dir, "documents").count()
    header = reports.run_metadata(SETTINGS, NAME, reports.resolve_delta(None, n), n, "out")
    return reports.metadata_frame(spark, header).withColumns({c: F.round(c, 9) for c in ("epsilon", "delta")})


def eval_result(spark, sf_dir):
    """Scores written as one JSON object and read again."""
    ws = Workspace(spark, "result")
    scored = evaluation.scores(run_queries._judged(spark, sf_dir))
    reports.save_result(reports.evaluation_result(scored, "icl", "synthetic", NAME, 7, 1.5), f"{ws.path}/result")
    kinds = "mode string, source string, dataset string, num_train long, num_test long, accuracy double, macro_f1 double, eval_time_seconds double"
    found = spark.read.schema(kinds).json(f"{ws.path}/result")
    return found.withColumns({c: F.round(c, 9) for c in ("accuracy", "macro_f1")})


def latest_log(spark, sf_dir):
    """Where a run resumes among logs named after the regions, and where its label says."""
    ws = Workspace(spark, "latest")
    regions = read_table(spark, sf_dir, "region").select(F.trim("r_name").alias("r_name"))
    lines = regions.withColumn("line", F.lit("{}"))
    for r in regions.orderBy("r_name").collect():  # five names
        run_log.write_log(lines.filter(F.col("r_name") == r["r_name"]), f"{ws.path}/run_{r['r_name']}.jsonl", ["r_name"])
    found = run_log.output_path(spark, ws.path, "run_", resume=True)
    return spark.range(0, 1, 1, 1).select(F.lit(found.rsplit("/", 1)[-1]).alias("name"))


def prompt_builder(spark, sf_dir):
    """Private and public prompts by a builder, batches by a policy."""
    built, policy = TemplatePrompts(NAME), HashLabelBatching(S, num_batches=7)
    rows = catalog.named(policy(examples(spark, sf_dir)), NAME)
    return rows.select("example_id", "bucket", built.private(F.col("label_name"), F.col("text")).alias("prompt"), built.public(F.col("label_name")).alias("public_prompt"))


def bound_algebra(spark, sf_dir):
    """Bounds of events: scaled, composed, converted, and told apart."""
    rows = ledger_queries.events(spark, sf_dir).select("seq", P.bound("zcdp", rho=F.col("rho")).alias("b"), F.col("n_pub").alias("n"))
    both = rows.select("seq", "b", P.scale(F.col("b"), F.col("n")).alias("s")).select("seq", "b", "s", P.compose(F.col("b"), F.col("s")).alias("c"))
    spent = P.to_approx_dp(F.col("c"), F.lit(DELTA))
    return both.select(
        "seq", F.round(P.rho_of(F.col("s")), 12).alias("scaled"), F.round(P.rho_of(F.col("c")), 12).alias("composed"),
        F.round(spent["epsilon"], 9).alias("epsilon"), spent["family"].alias("family"), P.is_trivial(F.col("c")).alias("trivial"),
    )


def streaming_commit(spark, sf_dir):
    """Descriptors come as a stream, some twice; each micro-batch is generated and committed, and a restart adds nothing."""
    ws = Workspace(spark, "stream_commit")
    described = ws.write(batch_queries._descriptors(spark, sf_dir).select("batch_id", "batch_index", "batch_size"), "described")
    source, table = f"{ws.path}/in", run_log.BatchTable(spark, f"{ws.path}/table")
    for k, part in enumerate((described.filter("batch_index % 2 = 0"), described.filter("batch_index % 2 = 1 OR batch_index % 3 = 0"))):
        part.write.mode("append").parquet(source)
        for _ in range(1 + k):
            stream = spark.readStream.schema(described.schema).parquet(source)
            runs.generate_stream(stream, f"{ws.path}/mark", lambda rows: (rows, rows.select("batch_id")), table)
    return table.read().select("batch_index", "batch_size")


def experiment_run(spark, sf_dir):
    """A whole run in three waves, resumed once more when it is done."""
    ws = Workspace(spark, "experiment")
    rows, public, path = examples(spark, sf_dir), run_queries._public(spark, sf_dir), f"{ws.path}/run"
    experiment.run(run_queries._engine(), rows, public, path, EPSILON, DELTA, waves=3)
    done = experiment.run(run_queries._engine(), rows, public, path, EPSILON, DELTA, resume=True)
    made = done.examples.agg(F.count(F.lit(1)).alias("n_examples"), F.sum("num_private_tokens").alias("n_private"), F.sum("num_public_tokens").alias("n_public"))
    return made.withColumns({"budget": F.lit(done.report["num_private_tokens"]), "epsilon": F.round(F.lit(done.realized_epsilon), 9), "new_batches": F.lit(done.new_batches)})


QUERIES = {
    f.__name__: f
    for f in (load_examples, batch_commit, run_header, eval_result, latest_log, prompt_builder, bound_algebra, streaming_commit, experiment_run)
}

_LEDGER = f"""SELECT event_id AS seq, CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN CAST('{ledger_queries.RHO!r}' AS DOUBLE) ELSE 0.0 END AS rho,
  event_id % 5 AS n FROM events"""
_SPENT = f"CASE WHEN c <= 0 THEN 0.0 ELSE c + sqrt(4 * c * ln(1 / CAST('{DELTA!r}' AS DOUBLE))) END"
_RHO = f"CAST('{SETTINGS.rho!r}' AS DOUBLE)"

ORACLE_SQL = {
    "load_examples": f"WITH {EXAMPLES_CTE} SELECT label, 2 * count(*) AS n_rows, 2 * count(*) AS n_ids, count(DISTINCT text) AS n_texts FROM ex GROUP BY label",
    "batch_commit": f"""WITH {BATCHES_CTE} SELECT batch_index, count(*) AS n, CAST(sum(example_id) AS BIGINT) AS ids
        FROM bucketed b JOIN grouped USING (label, bucket) JOIN described USING (batch_id) WHERE batch_index % 2 = 0 OR batch_index % 3 = 0 GROUP BY batch_index""",
    "run_header": f"""SELECT '{NAME}' AS dataset, round({SETTINGS.max_private_tokens} * {_RHO} + sqrt(4 * {SETTINGS.max_private_tokens} * {_RHO} * ln(n)), 9) AS epsilon,
        round(1.0 / n, 9) AS delta, {SETTINGS.batch_size} AS batch_size, CAST({SETTINGS.clip} AS DOUBLE) AS clip_bound, CAST({SETTINGS.temperature} AS DOUBLE) AS temperature,
        CAST({SETTINGS.public_temperature} AS DOUBLE) AS public_temperature, CAST({SETTINGS.svt_threshold} AS DOUBLE) AS svt_threshold,
        CAST({SETTINGS.svt_noise} AS DOUBLE) AS svt_noise, {SETTINGS.top_k} AS top_k_vocab, {SETTINGS.max_private_tokens} AS max_private_tokens,
        {SETTINGS.max_total_tokens} AS max_total_tokens, n AS num_source_examples, CAST({SETTINGS.seed} AS BIGINT) AS seed, 32 AS micro_batch_size,
        'out' AS output_path, 1 AS checkpoint_format FROM (SELECT count(*) AS n FROM documents)""",
    "eval_result": f"""WITH {run_queries._REPORT} SELECT 'icl' AS mode, 'synthetic' AS source, '{NAME}' AS dataset, CAST(7 AS BIGINT) AS num_train,
        CAST(sum(support) AS BIGINT) AS num_test, round(sum(recall * support) / sum(support), 9) AS accuracy, round(avg(f1), 9) AS macro_f1,
        CAST(1.5 AS DOUBLE) AS eval_time_seconds FROM r""",
    "latest_log": "SELECT max('run_' || trim(r_name) || '.jsonl') AS name FROM region",
    "prompt_builder": f"""WITH {EXAMPLES_CTE} SELECT example_id, {batch_queries._FOLD.format(n=7)} AS bucket,
        {batch_queries._USER.format(user=batch_queries._MESSAGE.format(text='text'))} AS prompt,
        {batch_queries._USER.format(user=batch_queries._MESSAGE.format(text="'Officials announced new policy changes effective immediately.'"))} AS public_prompt
        FROM ex JOIN dim USING (label)""",
    "bound_algebra": f"""SELECT seq, round(s, 12) AS scaled, round(c, 12) AS composed, round({_SPENT}, 9) AS epsilon, 'approx_dp' AS family, c = 0 AS trivial
        FROM (SELECT seq, rho * n AS s, rho + rho * n AS c FROM ({_LEDGER}))""",
    "streaming_commit": f"WITH {BATCHES_CTE} SELECT batch_index, batch_size FROM described",
    "experiment_run": f"""WITH RECURSIVE {run_queries.walk_sql()}, spent AS (SELECT batch_id, sum(num_private_tokens) * {_RHO} AS c FROM made GROUP BY batch_id)
        SELECT count(*) AS n_examples, CAST(sum(num_private_tokens) AS BIGINT) AS n_private, CAST(sum(num_public_tokens) AS BIGINT) AS n_public,
        {SETTINGS.max_private_tokens} AS budget, round((SELECT {_SPENT} FROM (SELECT max(c) AS c FROM spent)), 9) AS epsilon, 0 AS new_batches FROM made""",
}
