"""Datasets, their label vocabularies and prompt templates."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Dataset:
    """Source columns, labels and prompt texts of one dataset."""

    name: str
    text_column: str
    label_column: str
    labels: tuple[str, ...]
    user_message: str
    response_prefix: str
    public_seed: str

    @property
    def label_names(self) -> dict[int, str]:
        return dict(enumerate(self.labels))


# Names, columns, labels and prompt texts.
DATASETS = {
    d.name: d
    for d in (
        Dataset(
            "agnews", "text", "label", ("World", "Sports", "Business", "Sci/Tech"),
            "Here are texts with News Type: {label}.\n\nText: {example}\n\nPlease give me another one.", "Text:",
            "Officials announced new policy changes effective immediately.",
        ),
        Dataset(
            "trec", "text", "coarse_label", ("Abbreviation", "Entity", "Description", "Human", "Location", "Number"),
            "Here are questions with Answer Type: {label}.\n\n```\nText: {example}\n```\n\nPlease give me another one.", "```\nQuestion:",
            "What is the capital of France?",
        ),
        Dataset(
            "dbpedia", "content", "label",
            ("Company", "School", "Artist", "Athlete", "Politician", "Transportation", "Building", "Nature", "Village", "Animal", "Plant", "Album", "Film", "Book"),
            "Here are entries of Category: {label}.\n\nEntry: {example}\n\nPlease give me another one.", "Entry:",
            "The Springfield Institute is a research organization founded in 1952 and based in the United States.",
        ),
        Dataset(
            "imdb", "text", "label", ("Negative", "Positive"),
            "Here are texts with Sentiment: {label}.\n\nText: {example}\n\nPlease give me another one.", "Text:",
            "This film was a solid effort with strong performances from the entire cast.",
        ),
        Dataset(
            "yelp", "text", "label", ("Negative", "Positive"),
            "Here are texts with Sentiment: {label}.\n\nText: {example}\n\nPlease give me another one.", "Text:",
            "The service was prompt and the food arrived fresh.",
        ),
    )
}

EXAMPLE = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])


def choices() -> list[str]:
    return sorted(DATASETS)


def dataset(name: str) -> Dataset:
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; choose from {', '.join(choices())}")
    return DATASETS[name]


def labels_dim(spark: SparkSession) -> DataFrame:
    """(dataset, label, label_name); a fixed table of a few dozen rows."""
    rows = [(d.name, k, n) for d in DATASETS.values() for k, n in enumerate(d.labels)]
    return spark.createDataFrame(rows, "dataset string, label int, label_name string")


def load_examples(
    spark: SparkSession, name: str, path: str, split: str = "train", num_examples: int | None = None, seed: int = 42, format: str = "parquet"
) -> DataFrame:
    """(example_id, text, label) of ``<path>/<split>``, columns renamed to the fixed ones.

    Every row has an id of its own, equal rows too. In Parquet it is the number
    of its file, in order of names, and its place there (2 ** 40 rows a file):
    the same whenever these files are read. Other formats number rows as they
    are read. With ``num_examples`` below the row count, that many are drawn in
    the order of a keyed hash.
    """
    if split not in ("train", "test"):
        raise ValueError(f"unknown split {split!r}; choose train or test")
    d = dataset(name)
    source = T.StructType([T.StructField(d.text_column, T.StringType()), T.StructField(d.label_column, T.IntegerType())])
    reader = spark.read.format(format)
    if format in ("json", "csv"):
        reader = reader.schema(source).option("header", format == "csv")
    raw = reader.load(f"{path}/{split}")
    fields = F.col(d.text_column).cast("string").alias("text"), F.col(d.label_column).cast("int").alias("label")
    if format == "parquet":
        files = sorted(raw.inputFiles())
        numbers = spark.createDataFrame(list(enumerate(f.rsplit("/", 1)[-1] for f in files)), "file_no long, file string")
        if numbers.select("file").distinct().count() < len(files):
            raise ValueError(f"files of one name in different folders below {path}/{split}")
        placed = raw.select(*fields, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
        # A row for each file, as the driver lists them anyway.
        rows = placed.join(F.broadcast(numbers), "file").select((F.shiftleft("file_no", 40) + F.col("at")).alias("example_id"), "text", "label")
    else:
        rows = raw.select(F.monotonically_increasing_id().alias("example_id"), *fields)
    return rows if num_examples is None else subsample(rows, num_examples, seed)


class DatasetAdapter(Protocol):
    """Where examples come from: a name, its labels, and a load of one split as (example_id, text, label)."""

    name: str
    label_names: dict[int, str]

    def load(self, spark: SparkSession, split: str, num_examples: int | None = None) -> DataFrame: ...


@dataclass(frozen=True)
class FileAdapter:
    """A dataset of the catalog in files below a folder."""

    name: str
    path: str
    format: str = "parquet"
    seed: int = 42

    @property
    def label_names(self) -> dict[int, str]:
        return dataset(self.name).label_names

    def load(self, spark: SparkSession, split: str, num_examples: int | None = None) -> DataFrame:
        return load_examples(spark, self.name, self.path, split, num_examples, self.seed, self.format)


def subsample(rows: DataFrame, n: int, seed: int, id_col: str = "example_id") -> DataFrame:
    """``n`` rows in the order of a hash keyed by ``seed``, ties by id; all rows if there are no more (a top-n, no full sort)."""
    return rows.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")), 256), id_col).limit(n)


def named(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with label_name; a label outside the vocabulary is an error."""
    names = F.create_map(*[F.lit(x) for pair in dataset(name).label_names.items() for x in pair])
    found = names[F.col("label")]
    error = F.raise_error(F.concat(F.lit(f"no label of {name}: "), F.coalesce(F.col("label").cast("string"), F.lit("null"))))
    return rows.withColumn("label_name", F.when(found.isNull(), error.cast("string")).otherwise(found))
