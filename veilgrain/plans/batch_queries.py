"""Queries on examples, batches and prompts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.functions.hashing import bucket_key, hash_bucket
from veilgrain.operators import batching, prompts
from veilgrain.sources import catalog
from veilgrain.workspace import Workspace, read_table

NAME, S = "agnews", 16


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled examples; the label is the rank of the language. Languages are a vocabulary of a few names."""
    docs = read_table(spark, sf_dir, "documents")
    names = F.array_sort(F.collect_set("lang"))
    ranks = docs.agg(names.alias("names"))
    label = (F.array_position("names", F.col("lang")) - 1).cast("int")
    return docs.crossJoin(F.broadcast(ranks)).select(F.col("doc_id").alias("example_id"), "text", label.alias("label"))


def _descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = batching.batch_table(batching.assign_buckets(examples(spark, sf_dir), S), NAME)
    return batching.describe_batches(batches, NAME, Workspace(spark, "batches"))


def examples_normalized(spark, sf_dir):
    return examples(spark, sf_dir)


def label_dim_join(spark, sf_dir):
    return catalog.named(examples(spark, sf_dir), NAME).groupBy("label", "label_name").agg(F.count(F.lit(1)).alias("n"))


def label_count(spark, sf_dir):
    return examples(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("n_labels"))


def dataset_registry(spark, sf_dir):
    return catalog.labels_dim(spark).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_labels")).orderBy("dataset")


def subsample_seeded(spark, sf_dir):
    return catalog.subsample(examples(spark, sf_dir), 100, 42).select("example_id", "label")


def hash_buckets(spark, sf_dir):
    bucket = hash_bucket(bucket_key(F.col("label"), F.col("text")), F.lit(7))
    return examples(spark, sf_dir).select("example_id", bucket.alias("bucket"))


def partition_sizes(spark, sf_dir):
    rows = batching.assign_buckets(examples(spark, sf_dir), S)
    return rows.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n"))


def batch_descriptors(spark, sf_dir):
    return _descriptors(spark, sf_dir).drop("bucket")


def batch_members_sorted(spark, sf_dir):
    return batching.members(batching.assign_buckets(examples(spark, sf_dir), S), Workspace(spark, "members"))


def resume_antijoin(spark, sf_dir):
    found = Workspace(spark, "resume").write(_descriptors(spark, sf_dir), "descriptors")
    commits = found.filter("batch_index % 3 = 0").select("batch_id")
    return batching.pending(found, commits).select("batch_id", "batch_index", "label")


def prompts_private(spark, sf_dir):
    named = catalog.named(examples(spark, sf_dir), NAME)
    return named.select("example_id", prompts.private_prompt(NAME, F.col("label_name"), F.col("text")).alias("prompt"))


def prompts_public(spark, sf_dir):
    rows = _descriptors(spark, sf_dir)
    return rows.select("batch_id", prompts.public_prompt(NAME, F.col("label_name")).alias("prompt"))


def chat_template(spark, sf_dir):
    return prompts.chat_history(read_table(spark, sf_dir, "conversations"))


def chat_prompts(spark, sf_dir):
    named = catalog.named(examples(spark, sf_dir), NAME)
    return named.select("example_id", prompts.private_prompt(NAME, F.col("label_name"), F.col("text"), prompts.chat_wrap).alias("prompt"))


def icl_shots_balanced(spark, sf_dir):
    return prompts.balanced_shots(examples(spark, sf_dir), NAME, 8)


def icl_prompt_balanced(spark, sf_dir):
    rows = examples(spark, sf_dir)
    return prompts.balanced_prompt(prompts.balanced_shots(rows, NAME, 4), NAME, rows)


def icl_prompt_simple(spark, sf_dir):
    rows = examples(spark, sf_dir)
    return prompts.simple_prompt(rows, NAME, rows)


QUERIES = {
    f.__name__: f
    for f in (
        examples_normalized, label_dim_join, label_count, dataset_registry, subsample_seeded, hash_buckets, partition_sizes,
        batch_descriptors, batch_members_sorted, resume_antijoin, prompts_private, prompts_public, chat_template, chat_prompts,
        icl_shots_balanced, icl_prompt_balanced, icl_prompt_simple,
    )
}

EXAMPLES_CTE = """ex AS (
  SELECT doc_id AS example_id, text, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label FROM documents
), dim(label, label_name) AS (VALUES (0, 'World'), (1, 'Sports'), (2, 'Business'), (3, 'Sci/Tech'))"""

_FOLD = """list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform([0, 1, 2, 3, 4, 5, 6, 7],
    lambda i: ('0x' || substr(sha256(label || chr(10) || text), i * 8 + 1, 8))::BIGINT)),
    lambda acc, w: (acc * 4294967296 + w) % {n})"""

BATCHES_CTE = f"""{EXAMPLES_CTE}, sized AS (
  SELECT *, greatest(1, CAST(ceil(count(*) OVER (PARTITION BY label) / {S}.0) AS BIGINT)) AS nb FROM ex
), bucketed AS (
  SELECT example_id, text, label, {_FOLD.format(n='nb')} AS bucket FROM sized
), grouped AS (
  SELECT label, bucket, CAST(count(*) AS INTEGER) AS batch_size,
         sha256('{NAME}' || chr(10) || label || chr(10) || string_agg(text, chr(10) ORDER BY text)) AS batch_id
  FROM bucketed GROUP BY label, bucket
), described AS (
  SELECT batch_id, CAST(row_number() OVER (ORDER BY label, bucket) AS INTEGER) AS batch_index,
         CAST(count(*) OVER () AS INTEGER) AS total_batches, label, label_name, batch_size
  FROM grouped JOIN dim USING (label)
)"""

_USER = "'# [User]' || chr(10) || {user} || chr(10) || chr(10) || '# [Assistant]' || chr(10) || 'Text:'"
_MESSAGE = (
    "'Here are texts with News Type: ' || label_name || '.' || chr(10) || chr(10) || 'Text: ' || {text} || chr(10) || chr(10)"
    " || 'Please give me another one.'"
)
_SHOTS = """{cte}, ranked AS (
  SELECT label, example_id, text, row_number() OVER (PARTITION BY label ORDER BY example_id) AS r FROM ex
), shots AS (
  SELECT label, example_id, text FROM ranked WHERE r <= {per} ORDER BY label, example_id LIMIT {n}
)"""

ORACLE_SQL = {
    "examples_normalized": f"WITH {EXAMPLES_CTE} SELECT * FROM ex",
    "label_dim_join": f"WITH {EXAMPLES_CTE} SELECT label, label_name, count(*) AS n FROM ex JOIN dim USING (label) GROUP BY ALL",
    "label_count": f"WITH {EXAMPLES_CTE} SELECT count(*) AS n, count(DISTINCT label) AS n_labels FROM ex",
    "dataset_registry": "SELECT * FROM (VALUES ('agnews', CAST(4 AS BIGINT)), ('dbpedia', 14), ('imdb', 2), ('trec', 6), ('yelp', 2)) t(dataset, n_labels)",
    "subsample_seeded": f"WITH {EXAMPLES_CTE} SELECT example_id, label FROM ex ORDER BY sha256('42|' || example_id), example_id LIMIT 100",
    "hash_buckets": f"WITH {EXAMPLES_CTE} SELECT example_id, {_FOLD.format(n=7)} AS bucket FROM ex",
    "partition_sizes": f"WITH {BATCHES_CTE} SELECT label, bucket, count(*) AS n FROM bucketed GROUP BY ALL",
    "batch_descriptors": f"WITH {BATCHES_CTE} SELECT * FROM described",
    "batch_members_sorted": f"""WITH {BATCHES_CTE} SELECT label, bucket, example_id,
        CAST(row_number() OVER (PARTITION BY label, bucket ORDER BY text, example_id) AS INTEGER) AS ordinal FROM bucketed""",
    "resume_antijoin": f"WITH {BATCHES_CTE} SELECT batch_id, batch_index, label FROM described WHERE batch_index % 3 <> 0",
    "prompts_private": f"WITH {EXAMPLES_CTE} SELECT example_id, {_USER.format(user=_MESSAGE.format(text='text'))} AS prompt FROM ex JOIN dim USING (label)",
    "prompts_public": f"""WITH {BATCHES_CTE} SELECT batch_id,
        {_USER.format(user=_MESSAGE.format(text="'Officials announced new policy changes effective immediately.'"))} AS prompt FROM described""",
    "chat_template": """SELECT conv_id, string_agg('<start_of_turn>' || role || chr(10) || coalesce(text, '') || '<end_of_turn>' || chr(10), '' ORDER BY turn)
        || '<start_of_turn>model' || chr(10) AS prompt FROM conversations GROUP BY conv_id""",
    "chat_prompts": f"""WITH {EXAMPLES_CTE} SELECT example_id, '<start_of_turn>user' || chr(10) || {_MESSAGE.format(text='text')}
        || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) || 'Text:' AS prompt FROM ex JOIN dim USING (label)""",
    "icl_shots_balanced": f"WITH {_SHOTS.format(cte=EXAMPLES_CTE, per=2, n=8)} SELECT * FROM shots",
    "icl_prompt_balanced": f"""WITH {_SHOTS.format(cte=EXAMPLES_CTE, per=1, n=4)} SELECT e.example_id,
        'Classify the following text into one of these categories: World, Sports, Business, Sci/Tech.' || chr(10) || chr(10)
        || (SELECT string_agg('Text: ' || text || chr(10) || 'Category: ' || label_name || chr(10) || chr(10), '' ORDER BY label, example_id) FROM shots JOIN dim USING (label))
        || 'Text: ' || e.text || chr(10) || 'Category:' AS prompt FROM ex e""",
    "icl_prompt_simple": f"""WITH {EXAMPLES_CTE}, shots AS (SELECT * FROM ex ORDER BY example_id LIMIT 4) SELECT e.example_id,
        'Classify the following examples:' || chr(10)
        || (SELECT string_agg('Text: ' || text || chr(10) || 'Answer: ' || label_name || chr(10), '' ORDER BY example_id) FROM shots JOIN dim USING (label))
        || chr(10) || 'Text: ' || e.text || chr(10) || 'Answer:' AS prompt FROM ex e""",
}
