"""Private text generation: backends, the token loop and the batch loop.

Every batch is one group of a grouped map. Equal texts are counted before the
shuffle, so a batch holds distinct texts with multiplicities. What a token is
decided by (the clipped aggregate, the public logits and their distance) is
remembered by the state a backend names for a prefix; the Markov backend names
the last token, so its loop walks a table that fills as it goes.

Without a seed all noise and all tokens are drawn from the operating system, as
a run that must protect somebody needs. With a seed every draw is a hash of its
counters: a batch gives the same tokens whenever and wherever it runs, and its
noise protects nobody who knows the seed.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.functions.privacy import epsilon_value, rho_token_value

#: A public model goes to every worker: its vocabulary and the pairs it has seen are held to these.
MOST_TOKENS, MOST_PAIRS = 1 << 16, 5_000_000

EOS, UNKNOWN = "<eos>", "<unk>"
#: A token is a run of letters of any script, in lower case.
TOKEN = r"\p{L}+"
_TOKEN = regex.compile(TOKEN)


@dataclass(frozen=True)
class Settings:
    """Mechanism and run settings; an infinite negative threshold switches the gate off, no seed means secure draws."""

    batch_size: int = 255
    clip: float = 10.0
    temperature: float = 2.0
    public_temperature: float = 1.5
    svt_threshold: float = 0.5
    svt_noise: float | None = 0.2
    top_k: int = 0
    max_private_tokens: int = 100
    max_total_tokens: int = 256
    eos: int | None = 0
    seed: int | None = None

    @property
    def gated(self) -> bool:
        return self.svt_threshold != -math.inf

    @property
    def rho(self) -> float:
        return rho_token_value(self.clip, self.batch_size, self.temperature, self.svt_noise if self.gated else None)


@dataclass(frozen=True)
class Batch:
    """One batch as a model gets it: distinct texts, how many examples each stands for, and prompts if it asks for them."""

    batch_id: str
    texts: list[str]
    counts: list[int]
    prompts: list[str] = field(default_factory=list)
    public_prompt: str = ""


class LogitBackend(Protocol):
    """Next-token logits of a batch's prompts after a shared prefix. A method ``state(prefix)`` may name what they depend on."""

    def private(self, prefix: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Logits (prompts, vocabulary) and how many prompts each row stands for."""

    def public(self, prefix: list[int]) -> np.ndarray: ...

    def decode(self, ids: list[int]) -> str: ...


class Model(Protocol):
    """What is sent to every worker, once, and makes the backend of each batch there."""

    #: Whether batches come with rendered prompts.
    needs_prompts: bool

    def backend(self, batch: Batch) -> LogitBackend: ...


def vocabulary(public_texts: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """(token_id, token, n) of the ``size`` - 2 most frequent public tokens after <eos> and <unk>; private rows never shape it."""
    tokens = public_texts.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(TOKEN), F.lit(0))).alias("token"))
    top = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(size - 2)
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("token"), F.col("n")))).alias("t"))
    numbered = listed.select(F.posexplode("t").alias("at", "s")).select((F.col("at") + 2).cast("int").alias("token_id"), "s.token", "s.n")
    none = F.lit(0).cast("long").alias("n")
    spark = public_texts.sparkSession
    special = spark.range(0, 2, 1, 1).select(F.col("id").cast("int").alias("token_id"), F.when(F.col("id") == 0, EOS).otherwise(UNKNOWN).alias("token"), none)
    return special.unionByName(numbered)


def bigrams(texts: DataFrame, vocab: DataFrame, text_col: str = "text") -> DataFrame:
    """(prev, token, n) over all texts, each between two <eos>; unknown tokens are <unk>."""
    words = texts.select(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(TOKEN), F.lit(0)).alias("w"))
    framed = words.select(F.concat(F.array(F.lit(EOS)), "w", F.array(F.lit(EOS))).alias("w"))
    pairs = framed.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("p"))
    counts = pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    for column, out in (("a", "prev"), ("b", "token")):
        ids = vocab.select(F.col("token").alias(column), F.col("token_id").alias(out))
        counts = counts.join(F.broadcast(ids), column, "left").drop(column).fillna(1, [out])  # the vocabulary is of a set size
    return counts.groupBy("prev", "token").agg(F.sum("n").alias("n"))


def public_logits(counts: DataFrame, size: int, alpha: float) -> DataFrame:
    """(prev, token, logit) for all pairs: ln((n + alpha) / (n of prev + alpha * size)). Generation keeps the counts sparse instead."""
    grid = counts.sparkSession.range(0, size * size).select((F.col("id") / size).cast("int").alias("prev"), (F.col("id") % size).cast("int").alias("token"))
    totals = counts.groupBy("prev").agg(F.sum("n").alias("total"))
    both = grid.join(counts, ["prev", "token"], "left").join(totals, "prev", "left").fillna(0, ["n", "total"])
    return both.select("prev", "token", F.ln((F.col("n") + alpha) / (F.col("total") + alpha * size)).alias("logit"))


class MarkovModel:
    """A public bigram model; only the pairs that occur are held."""

    needs_prompts = False

    def __init__(self, tokens: list[str], pairs: dict[int, tuple[np.ndarray, np.ndarray]], alpha: float = 0.5, beta: float = 2.0):
        """``pairs``: previous token -> (next tokens, their counts)."""
        self.tokens, self.pairs, self.alpha, self.beta = tokens, pairs, alpha, beta
        self.index = {t: k for k, t in enumerate(tokens)}

    @classmethod
    def learn(cls, public_texts: DataFrame, ws, vocab_size: int = 64, alpha: float = 0.5, beta: float = 2.0) -> MarkovModel:
        """From public texts only. The size of the vocabulary is set, and what it has seen is counted, before anything is fetched."""
        if vocab_size > MOST_TOKENS:
            raise ValueError(f"a vocabulary of {vocab_size} is over {MOST_TOKENS}")
        vocab = ws.write(vocabulary(public_texts, vocab_size), "vocabulary")
        counts = ws.write(bigrams(public_texts, vocab), "bigrams")
        return cls._held(vocab, counts, alpha, beta)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model below ``path`` as two tables; an earlier one is not overwritten."""
        tokens = spark.createDataFrame(list(enumerate(self.tokens)), "token_id int, token string")
        tokens.coalesce(1).write.mode("errorifexists").parquet(f"{path}/tokens")
        rows = [(prev, int(t), int(n)) for prev, (at, counts) in self.pairs.items() for t, n in zip(at, counts, strict=True)]
        spark.createDataFrame(rows, "prev int, token int, n long").write.mode("errorifexists").parquet(f"{path}/pairs")

    @classmethod
    def load(cls, spark: SparkSession, path: str, alpha: float = 0.5, beta: float = 2.0) -> MarkovModel:
        """A model that was saved; its size is checked before anything is fetched."""
        tokens, pairs = spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/pairs")
        return cls._held(tokens, pairs, alpha, beta)

    @classmethod
    def _held(cls, vocab: DataFrame, counts: DataFrame, alpha: float, beta: float) -> MarkovModel:
        if vocab.count() > MOST_TOKENS or counts.count() > MOST_PAIRS:
            raise ValueError(f"over {MOST_TOKENS} tokens or {MOST_PAIRS} pairs; take a smaller vocabulary")
        pairs: dict[int, list] = {}
        for r in counts.orderBy("prev", "token").collect():
            pairs.setdefault(r["prev"], []).append((r["token"], r["n"]))
        held = {prev: tuple(np.array(c) for c in zip(*own, strict=True)) for prev, own in pairs.items()}
        return cls([r["token"] for r in vocab.orderBy("token_id").collect()], held, alpha, beta)

    def row(self, prev: int) -> np.ndarray:
        """Public logits after ``prev``."""
        counts = np.zeros(len(self.tokens))
        if prev in self.pairs:
            at, n = self.pairs[prev]
            counts[at] = n
        return np.log((counts + self.alpha) / (counts.sum() + self.alpha * len(counts)))

    def backend(self, batch: Batch) -> MarkovBackend:
        return MarkovBackend(self, batch.texts, batch.counts)


_loaded: dict[str, Model] = {}


class LazyModel:
    """A model too large to send: every worker loads it once, from a place that all of them reach, and keeps it.

    ``load`` is a function without arguments, such as one that opens weights in
    a shared folder; ``name`` tells models of one worker apart.
    """

    def __init__(self, name: str, load: Callable[[], Model], needs_prompts: bool = True):
        self.name, self.load, self.needs_prompts = name, load, needs_prompts

    def backend(self, batch: Batch) -> LogitBackend:
        if self.name not in _loaded:
            _loaded[self.name] = self.load()
        return _loaded[self.name].backend(batch)


class MarkovBackend:
    """Public bigram logits, raised for each private text by beta * ln(1 + its own bigram count)."""

    def __init__(self, model: MarkovModel, texts: list[str], counts: list[int]):
        self.model = model
        self.multiplicity = np.array(counts, dtype=float)
        self.pairs: list[dict[int, dict[int, int]]] = []
        for text in texts:
            ids = [0, *(model.index.get(w, 1) for w in _TOKEN.findall((text or "").lower())), 0]
            own: dict[int, dict[int, int]] = {}
            for a, b in zip(ids, ids[1:], strict=False):
                row = own.setdefault(a, {})
                row[b] = row.get(b, 0) + 1
            self.pairs.append(own)

    def state(self, prefix: list[int]) -> int:
        return prefix[-1] if prefix else 0

    def private(self, prefix: list[int]) -> tuple[np.ndarray, np.ndarray]:
        last = self.state(prefix)
        rows = np.repeat(self.model.row(last)[None, :], len(self.pairs), axis=0)
        for row, own in zip(rows, self.pairs, strict=True):
            for token, n in own.get(last, {}).items():
                row[token] += self.model.beta * math.log1p(n)
        return rows, self.multiplicity

    def public(self, prefix: list[int]) -> np.ndarray:
        return self.model.row(self.state(prefix))

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.model.tokens[i] for i in ids if self.model.tokens[i] not in (EOS, UNKNOWN)).strip()


def softmax(z: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    e = np.exp((z - z.max(axis=-1, keepdims=True)) / temperature)
    return e / e.sum(axis=-1, keepdims=True)


def clipped_mean(z: np.ndarray, weight: np.ndarray, clip: float, size: int) -> np.ndarray:
    """Sum of the recentred, clipped rows over the expected size."""
    return (np.maximum(-clip, z - z.max(axis=1, keepdims=True) + clip) * weight[:, None]).sum(axis=0) / size


def keep_top(z: np.ndarray, by: np.ndarray, k: int) -> np.ndarray:
    """``z`` at the k largest of ``by`` (ties to the smaller index), -infinity elsewhere; all of it for k = 0."""
    if k <= 0 or k >= len(z):
        return z
    out = np.full_like(z, -np.inf)
    kept = np.argsort(-by, kind="stable")[:k]
    out[kept] = z[kept]
    return out


class Draws:
    """Counter-based uniforms of one batch."""

    def __init__(self, seed: int, batch: str):
        self.prefix = f"{seed}|{batch}"

    def uniform(self, *counters) -> float:
        key = "|".join([self.prefix, *map(str, counters)])
        return int(hashlib.sha256(key.encode()).hexdigest()[:13], 16) / 2**52

    def laplace(self, scale: float, *counters) -> float:
        u = max(self.uniform(*counters), 2.0**-53) - 0.5
        return -scale * math.copysign(1, u) * math.log1p(-2 * abs(u)) if u else 0.0

    def token(self, p: np.ndarray, *counters) -> int:
        weights = np.rint(p * 2.0**40).astype(np.int64)
        total = np.cumsum(weights)
        return int(np.searchsorted(total, math.floor(self.uniform(*counters) * total[-1]), side="right"))


class SystemDraws(Draws):
    """Uniforms from the operating system; what they were drawn for does not matter, and nobody can draw them again."""

    def __init__(self):
        self.source = secrets.SystemRandom()

    def uniform(self, *counters) -> float:
        return self.source.random()


def draws_of(s: Settings, batch: str) -> Draws:
    return SystemDraws() if s.seed is None else Draws(s.seed, batch)


@dataclass(frozen=True)
class Example:
    ids: tuple[int, ...]
    n_private: int
    n_public: int


def signals(backend: LogitBackend, prefix: list[int], s: Settings) -> tuple[np.ndarray, np.ndarray | None, float]:
    """Clipped aggregate, public logits and private-public distance after a prefix, remembered by the backend's state."""
    state = backend.state(prefix) if hasattr(backend, "state") else None
    memory = backend.__dict__.setdefault("_signals", {}) if state is not None else {}
    if (state, s) not in memory:
        rows, weight = backend.private(prefix)
        shown = backend.public(prefix) if s.gated or s.top_k > 0 else None
        distance = math.inf
        if s.gated:
            mean = (softmax(rows) * weight[:, None]).sum(axis=0) / s.batch_size
            distance = float(np.abs(mean - softmax(shown)).sum())
        memory[state, s] = clipped_mean(rows, weight, s.clip, s.batch_size), shown, distance
    return memory[state, s]


def generate_example(backend: LogitBackend, draws: Draws, s: Settings, budget: int, number: int) -> Example:
    """Tokens until <eos> (which counts), the length limit, or the private budget is spent.

    With the gate on, a token is public while the distance between the private
    and public next-token distributions, plus noise, stays under a noisy
    threshold; the threshold is drawn at the start and after each private token.
    """
    ids: list[int] = []
    private = 0

    def threshold() -> float:
        return s.svt_threshold + draws.laplace(s.svt_noise or 0.0, number, len(ids), "threshold")

    bar = threshold() if s.gated else 0.0
    while private < budget and len(ids) < s.max_total_tokens:
        z, shown, distance = signals(backend, ids, s)
        spend, tau = True, s.temperature
        if s.gated:
            spend = distance + draws.laplace(2 * (s.svt_noise or 0.0), number, len(ids), "query") >= bar
        if not spend:
            z, tau = shown, s.public_temperature
        if s.top_k > 0:
            z = keep_top(z, shown, s.top_k)
        ids.append(draws.token(softmax(z, tau), number, len(ids), "token"))
        if spend:
            private += 1
            bar = threshold() if s.gated else bar
        if s.eos is not None and ids[-1] == s.eos:
            break
    return Example(tuple(ids), private, len(ids) - private)


def generate_batch(backend: LogitBackend, draws: Draws, s: Settings, one=generate_example) -> list[Example]:
    """Examples that share the batch's budget; ends with the budget, at max(budget, 10) examples, at an empty
    example, or after three in a row without a private token."""
    kept: list[Example] = []
    spent = idle = number = 0
    while spent < s.max_private_tokens and len(kept) < max(s.max_private_tokens, 10):
        found = one(backend, draws, s, s.max_private_tokens - spent, number)
        number += 1
        spent += found.n_private
        if found.ids:
            kept.append(found)
        if found.n_private == 0 and found.n_public == 0:
            break
        idle = 0 if found.n_private else idle + 1
        if idle == 3:
            break
    return kept


SYNTHETIC = "batch_id string, example_no int, text string, token_ids array<int>, num_private_tokens int, num_public_tokens int, num_total_tokens int"


def generate_dataset(bucketed: DataFrame, descriptors: DataFrame, model: Model, s: Settings, mechanism=generate_example, prompts=None) -> DataFrame:
    """Synthetic examples of the batches in ``descriptors`` (label, label_name, bucket, batch_id), from ``bucketed`` texts.

    ``prompts``: a ``PromptBuilder``, rendered here if the model needs prompts.
    The model goes to every worker; a batch is as large as its distinct texts.
    """
    counted = bucketed.groupBy("label", "bucket", "text").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.join(descriptors.select("label", "label_name", "bucket", "batch_id"), ["label", "bucket"])
    columns = ["batch_id", "text", "n"]
    if model.needs_prompts:
        name = F.col("label_name")
        rows = rows.withColumn("prompt", prompts.private(name, F.col("text"))).withColumn("public_prompt", prompts.public(name))
        columns += ["prompt", "public_prompt"]
    if isinstance(model, LazyModel):
        held = lambda: model  # noqa: E731  a function and a name, which go along with the tasks
    else:
        shared = bucketed.sparkSession.sparkContext.broadcast(model)
        held = lambda: shared.value

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("text")
        of = group["batch_id"].iloc[0]
        texts = group["text"].tolist(), group["n"].tolist()
        batch = Batch(of, *texts, group["prompt"].tolist(), group["public_prompt"].iloc[0]) if "prompt" in group else Batch(of, *texts)
        backend = held().backend(batch)
        out = [
            (of, k, backend.decode(list(e.ids)), list(e.ids), e.n_private, e.n_public, len(e.ids))
            for k, e in enumerate(generate_batch(backend, draws_of(s, of), s, mechanism))
        ]
        return pd.DataFrame(out, columns=[f.split()[0] for f in SYNTHETIC.split(", ")])

    return rows.select(*columns).groupBy("batch_id").applyInPandas(run, SYNTHETIC)


class PrivateTextEngine:
    """Facade: examples in, synthetic examples and their guarantee out.

    ``backend`` makes the model from the public texts and a workspace, or is a
    model already; ``mechanism`` makes one example; ``policy`` deals examples
    into batches; ``prompts`` renders them. All have defaults.
    """

    def __init__(self, dataset: str, settings: Settings, backend: Model | Callable | None = None, mechanism=generate_example, policy=None, prompts=None):
        self.dataset, self.settings, self.mechanism, self.policy, self.prompts = dataset, settings, mechanism, policy, prompts
        self.backend = backend or MarkovModel.learn

    def model(self, public_texts: DataFrame | None, ws) -> Model:
        return self.backend if hasattr(self.backend, "backend") else self.backend(public_texts, ws)

    def describe(self, examples: DataFrame, ws) -> tuple[DataFrame, DataFrame]:
        """(examples with buckets, stored descriptors of all batches)."""
        from veilgrain.operators import batching

        bucketed = self.policy(examples) if self.policy else batching.assign_buckets(examples, self.settings.batch_size)
        described = batching.describe_batches(batching.batch_table(bucketed, self.dataset), self.dataset, ws)
        return bucketed, ws.write(described, "descriptors")

    def generate(self, examples: DataFrame, public_texts: DataFrame | None, ws, commits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(stored synthetic examples, descriptors); committed batches are skipped, indices stay those of the whole run."""
        from veilgrain.operators import batching

        bucketed, described = self.describe(examples, ws)
        todo = described if commits is None else batching.pending(described, commits)
        return self.generate_batches(bucketed, todo, self.model(public_texts, ws), ws), described

    def generate_batches(self, bucketed: DataFrame, todo: DataFrame, model: Model, ws, name: str = "synthetic") -> DataFrame:
        """Stored synthetic examples of the batches in ``todo``, with the fields of their descriptors.

        They are stored at once: secure draws are never drawn again, so a plan that ran twice would spend twice.
        """
        from veilgrain.operators.protocols import TemplatePrompts

        made = generate_dataset(bucketed, todo, model, self.settings, self.mechanism, self.prompts or TemplatePrompts(self.dataset))
        fields = ["batch_id", "batch_index", "total_batches", "label", "label_name", F.col("batch_size").alias("source_batch_size")]
        return ws.write(made, name).join(todo.select(*fields), "batch_id")

    def one_batch(self, model: Model, batch: Batch) -> list[tuple[str, Example]]:
        """Texts and tokens that one batch gives, on the driver."""
        backend = model.backend(batch)
        return [(backend.decode(list(e.ids)), e) for e in generate_batch(backend, draws_of(self.settings, batch.batch_id), self.settings, self.mechanism)]

    def one_example(self, model: Model, batch: Batch, budget: int | None = None, number: int = 0) -> tuple[str, Example]:
        """One example of a batch within a budget, that of the settings if none is given."""
        backend, s = model.backend(batch), self.settings
        made = self.mechanism(backend, draws_of(s, batch.batch_id), s, s.max_private_tokens if budget is None else budget, number)
        return backend.decode(list(made.ids)), made

    def realized_epsilon(self, synthetic: DataFrame, delta: float) -> float:
        """Of the dearest batch, over all rows given: pass resumed and new ones together."""
        worst = synthetic.groupBy("batch_id").agg(F.sum("num_private_tokens").alias("n")).agg(F.max("n")).first()[0] or 0
        return epsilon_value(worst * self.settings.rho, delta)

    def with_settings(self, **changes) -> PrivateTextEngine:
        return PrivateTextEngine(self.dataset, replace(self.settings, **changes), self.backend, self.mechanism, self.policy, self.prompts)
