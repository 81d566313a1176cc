"""What can be replaced: each extension point is a small protocol over DataFrames or columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame

from veilgrain.functions.privacy import Accountant
from veilgrain.operators import batching, prompts
from veilgrain.operators.generation import Draws, Example, LogitBackend, Model, Settings
from veilgrain.sources.catalog import DatasetAdapter

__all__ = [
    "Accountant", "BatchingPolicy", "CompletionFunction", "DatasetAdapter", "HashLabelBatching", "LogitBackend", "Mechanism", "Model", "PromptBuilder",
    "TemplatePrompts",
]

#: Prompts in, completions out; runs in the workers.
CompletionFunction = Callable[[list[str]], list[str]]


class BatchingPolicy(Protocol):
    def __call__(self, examples: DataFrame) -> DataFrame:
        """``examples`` (example_id, text, label) with ``bucket``; disjoint, of one label each."""


class PromptBuilder(Protocol):
    def private(self, label_name: Column, text: Column) -> Column: ...

    def public(self, label_name: Column) -> Column:
        """Must not depend on any example."""


class Mechanism(Protocol):
    def __call__(self, backend: LogitBackend, draws: Draws, settings: Settings, budget: int, number: int) -> Example: ...


class HashLabelBatching:
    """The default policy; a fixed ``num_batches`` keeps records where they are when others come."""

    def __init__(self, batch_size: int, num_batches: int | None = None):
        self.batch_size, self.num_batches = batch_size, num_batches

    def __call__(self, examples: DataFrame) -> DataFrame:
        return batching.assign_buckets(examples, self.batch_size, self.num_batches)


class TemplatePrompts:
    """The catalog's templates of one dataset, plain or in a chat format."""

    def __init__(self, dataset: str, wrap: Callable[[Column, str], Column] = prompts.plain_wrap):
        self.dataset, self.wrap = dataset, wrap

    def private(self, label_name: Column, text: Column) -> Column:
        return prompts.private_prompt(self.dataset, label_name, text, self.wrap)

    def public(self, label_name: Column) -> Column:
        return prompts.public_prompt(self.dataset, label_name, self.wrap)
