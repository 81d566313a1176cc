"""Prompts for generation and few-shot evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrain.functions.text import render, without_bos
from veilgrain.sources.catalog import dataset


def plain_wrap(user: Column, prefix: str) -> Column:
    return F.concat(F.lit("# [User]\n"), user, F.lit("\n\n# [Assistant]\n"), F.lit(prefix))


def chat_wrap(user: Column, prefix: str, user_turn: str = "<bos><start_of_turn>user\n{user}<end_of_turn>\n", answer: str = "<start_of_turn>model\n") -> Column:
    """One user turn of a chat format and the opening of the answer, without a leading <bos>."""
    return F.concat(without_bos(F.concat(render(user_turn, user=user), F.lit(answer))), F.lit(prefix))


def private_prompt(name: str, label_name: Column, text: Column, wrap=plain_wrap) -> Column:
    d = dataset(name)
    return wrap(render(d.user_message, label=label_name, example=text), d.response_prefix)


def public_prompt(name: str, label_name: Column, wrap=plain_wrap) -> Column:
    """The same prompt around the public seed: it reads no example."""
    return private_prompt(name, label_name, F.lit(dataset(name).public_seed), wrap)


def chat_history(turns: DataFrame) -> DataFrame:
    """(conv_id, prompt): all turns in order, then the opening of the answer."""
    piece = F.concat(F.lit("<start_of_turn>"), F.col("role"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<end_of_turn>\n"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", piece.alias("piece"))))
    grouped = turns.groupBy("conv_id").agg(ordered.alias("t"))
    return grouped.select("conv_id", F.concat(F.array_join(F.col("t.piece"), ""), F.lit("<start_of_turn>model\n")).alias("prompt"))


def balanced_shots(examples: DataFrame, name: str, num_shots: int, compat: bool = False) -> DataFrame:
    """Shots (position, label, text): max(1, shots // labels) of each label by example_id, labels ascending, ``num_shots`` in all.

    No shots asked gives none; with ``compat`` it gives one.
    """
    per_label = max(1, num_shots // len(dataset(name).labels))
    by_label = Window.partitionBy("label").orderBy("example_id")
    some = examples.select("label", "example_id", "text").withColumn("_r", F.row_number().over(by_label)).filter(F.col("_r") <= per_label)
    return some.orderBy("label", "example_id").limit(max(num_shots, 1 if compat else 0)).drop("_r")


def balanced_prompt(shots: DataFrame, name: str, test: DataFrame, *keep: str) -> DataFrame:
    """(``keep`` columns, example_id if none is named, prompt): the shots, rendered once, before every test text."""
    d = dataset(name)
    names = F.create_map(*[F.lit(x) for pair in d.label_names.items() for x in pair])
    shot = F.concat(F.lit("Text: "), F.col("text"), F.lit("\nCategory: "), names[F.col("label")], F.lit("\n\n"))
    ordered = F.array_sort(F.collect_list(F.struct("label", "example_id", shot.alias("s"))))
    one = shots.agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "").alias("_shots"))  # one row of a few shots
    head = "Classify the following text into one of these categories: " + ", ".join(d.labels) + ".\n\n"
    body = F.concat(F.lit(head), F.col("_shots"), F.lit("Text: "), F.col("text"), F.lit("\nCategory:"))
    return test.crossJoin(F.broadcast(one)).select(*(keep or ("example_id",)), body.alias("prompt"))


def simple_prompt(examples: DataFrame, name: str, test: DataFrame, num_shots: int = 4, id_col: str = "example_id") -> DataFrame:
    """(id, prompt): the first ``num_shots`` examples by id with their label names before every test text."""
    names = F.create_map(*[F.lit(x) for pair in dataset(name).label_names.items() for x in pair])
    shot = F.concat(F.lit("Text: "), F.col("text"), F.lit("\nAnswer: "), names[F.col("label")], F.lit("\n"))
    first = examples.orderBy("example_id").limit(num_shots)
    one = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example_id", shot.alias("s")))), lambda x: x["s"]), "").alias("_shots"))
    body = F.concat(F.lit("Classify the following examples:\n"), F.col("_shots"), F.lit("\nText: "), F.col("text"), F.lit("\nAnswer:"))
    return test.crossJoin(F.broadcast(one)).select(id_col, body.alias("prompt"))
