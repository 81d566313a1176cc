"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A text is cut into special tokens and words by the published pattern of
byte-level BPE. The distinct words of a batch of texts that are not cached are
laid out in one flat array of symbols. Each round finds all adjacent pairs'
ranks by binary search over the sorted pair keys, takes the lowest rank of
every word (a segmented minimum), merges its non-overlapping occurrences from
left to right and compacts the array; words without a known pair leave it.
The ids are those of the ``tokenizers`` library for the same file.

Defined cases: a null text counts as empty and gives no ids; decoding no ids
(or null) gives the empty text; bytes that are not UTF-8 decode to U+FFFD. Texts are
never cut. Words over ``LONG_WORD`` characters are encoded but not cached. An
empty table gives an empty one, repeated rows a row each, other columns stay.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from veilgrain.workspace import read_table

#: Words that a Python worker keeps encoded, and the longest one it keeps.
CACHED_WORDS = 300_000
LONG_WORD = 64
#: Characters of text that go through the merge rounds together.
CHUNK_CHARS = 1_000_000

# The word pattern of byte-level BPE.
WORD = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

# The same words in texts of ASCII and Latin-1 letters only, for which the plain engine is faster.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_LATIN_WORD = re.compile(
    rf" ?[{_LATIN}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^ \t-\r0-9{_LATIN}]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
)
_BEYOND_LATIN = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """The tables of one tokenizer file, small enough (a few MB) to be sent to every executor."""

    tokens: list[bytes]
    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, ids = spec["model"], spec["model"]["vocab"]
        pre = spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        added = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("special tokens that take in their surroundings are not supported")
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        size = 1 + max([*ids.values(), *(t["id"] for t in added)])
        tokens = [b""] * size
        for token, i in ids.items():
            tokens[i] = bytes(byte_of[c] for c in token)
        for t in added:
            tokens[t["id"]] = t["content"].encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * size + ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        return cls(
            tokens,
            np.array([ids[s] for s in symbols], dtype=np.int64),
            keys[order],
            order.astype(np.int64),
            np.array([ids[a + b] for a, b in merges], dtype=np.int64)[order],
            {t["content"]: t["id"] for t in added},
        )

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of non-empty words, all merged together, each as little-endian 32-bit numbers."""
        out = [b""] * len(words)
        symbol = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        none = np.iinfo(np.int64).max
        while len(word):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            keys = symbol[:-1] * len(self.tokens) + symbol[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            known = (self.pair_keys[at] == keys) & (word[1:] == word[:-1])
            rank = np.append(np.where(known, self.pair_ranks[at], none), none)
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(word)))
            if (done := lowest == none).any():
                raw = symbol.astype("<i4").tobytes()
                for w, s, n in zip(word[starts[done]].tolist(), starts[done].tolist(), sizes[done].tolist(), strict=True):
                    out[w] = raw[4 * s : 4 * (s + n)]
            stay = np.repeat(~done, sizes)
            chosen = np.flatnonzero((rank == np.repeat(lowest, sizes)) & stay)
            # Of overlapping occurrences (a run of one symbol), every other one counts.
            fresh = np.r_[True, np.diff(chosen) != 1][: len(chosen)]
            place = np.arange(len(chosen))
            chosen = chosen[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            symbol[chosen] = self.pair_ids[at[chosen]]
            stay[chosen + 1] = False
            symbol, word = symbol[stay], word[stay]
        return out


class Encoder:
    """Encodes texts with a bounded cache of words; one in each task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.cache: dict[str, bytes] = {}

    @cached_property
    def _patterns(self):
        import regex

        special = sorted(self.vocabulary.special, key=len, reverse=True)
        whole = regex.compile(WORD)
        return lambda t: (whole if _BEYOND_LATIN.search(t) else _LATIN_WORD).findall(t), regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def _words(self, text: str) -> list[str]:
        word, special = self._patterns
        if not special or not any(s in text for s in self.vocabulary.special):
            return word(text)
        parts = special.split(text)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else word(part))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [self._words(t) for t in texts]
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        if not self.cache:
            self.cache.update({s: i.to_bytes(4, "little") for s, i in self.vocabulary.special.items()})
        new = [w for w in set(chain.from_iterable(words)) if w not in self.cache]
        self.cache.update(zip(new, self.vocabulary.merge([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
        ids = [np.frombuffer(b"".join(map(self.cache.__getitem__, own)), dtype="<i4") for own in words]
        for w in new:
            if len(w) > LONG_WORD:
                del self.cache[w]
        return ids


def _chunks(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of a batch and their texts (column ``at``), about ``CHUNK_CHARS`` characters at a time."""
    texts, size, start = [], 0, 0
    for k, value in enumerate(batch.column(at)):
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= CHUNK_CHARS or k == batch.num_rows - 1:
            yield batch.slice(start, len(texts)), texts
            texts, size, start = [], 0, k + 1


def _encoder(shared, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with a last column of the ids of the texts in column ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for rows, texts in _chunks(batch, at):
                ids = encoder.encode(texts)
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*rows.columns, column], names=[*(f"c{k}" for k in range(rows.num_columns)), "ids"])

    return run


def _decoder(shared, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with a last column of the texts of the ids in column ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.tokens.__getitem__
        for batch in batches:
            texts = []
            for ids in batch.column(at):
                found = ids.values.to_numpy().tolist() if ids.is_valid else ()
                texts.append(b"".join(map(token, found)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*(f"c{k}" for k in range(batch.num_columns)), "text"])

    return run


def _mapped(frame: DataFrame, out: StructType, *steps: Callable) -> DataFrame:
    """``steps`` one after the other in one Python worker, the columns named as ``out`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, names=out.names)

    return frame.mapInArrow(run, out)


def _ids_field(name: str) -> StructField:
    return StructField(name, ArrayType(IntegerType(), False))


def encode_beside(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with a column of ids; all other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return _mapped(docs, StructType([*docs.schema.fields, _ids_field(ids_col)]), _encoder(shared, docs.columns.index(text_col)))


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row."""
    return encode_beside(docs.select(id_col, text_col), vocabulary, text_col).select(id_col, "ids")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; all other columns stay."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    out = StructType([*encoded.schema.fields, StructField(text_col, StringType())])
    return _mapped(encoded, out, _decoder(shared, encoded.columns.index(ids_col)))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with the ids of every text and the text decoded from these ids, in one pass through one worker a core."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    out = StructType([*docs.schema.fields, _ids_field(ids_col), StructField(decoded_col, StringType())])
    return _mapped(docs, out, _encoder(shared, docs.columns.index(text_col)), _decoder(shared, len(docs.columns)))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    vocabulary = Vocabulary.load(tokenizer_path or default_path())
    done = round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
