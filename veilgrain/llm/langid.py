"""Language identification by compression.

Each learned language has a zstandard raw-content dictionary of its own text.
A text is normalised (lower case, only letters, one blank between words), cut
into blocks of ``BLOCK`` bytes so that a long text cannot serve as its own
dictionary, and every block of the whole text is compressed with each
dictionary. The language with the smallest total wins; where the runner-up is
within ``MIN_MARGIN`` of it, the text is rejected.

Training uses a bounded sample of labelled rows: about ``SAMPLE_DOCS`` a
language, chosen by hash, each giving one slice of at most ``SLICE`` bytes, cut
on the executors at a hashed place (long texts are sampled like any other).
Provisional dictionaries from a part of them weed out slices whose label the
most common languages (``RIVALS``) contradict before the final ones are filled.
Any number of languages can be learned; all dictionaries together take about
``TABLE_BYTES`` in a worker, so beyond 512 languages each gets a smaller one.

A text is rejected where its margin is one at which pieces of training slices
are more often misjudged than not, and below ``MIN_MARGIN``.

Defined cases: null text or no letter gives ``und``, score 0, rejected; ties go
to the language with more labelled rows, then by name, and are rejected; with
nothing learned every text is ``und``, as in an empty table. Rows with a null
label or a held-out id are never learned from. Repeated rows count once in a
dictionary. Very long texts are compressed whole, block by block. Other columns
are neither read nor renamed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.llm.common import filter_texts, held_out, map_texts
from veilgrain.workspace import read_table

SAMPLE_DOCS = 400
SLICE = 1024
#: Characters that are cut out of a labelled text, enough for a slice when blanks and signs are gone.
SLICE_CHARS = 1200
#: Largest dictionary, as a power of two, and what those of all languages may take in one worker.
MOST_LOG, LEAST_LOG, TABLE_BYTES = 16, 8, 256 << 20
#: Largest languages that a slice is held against before it goes into a dictionary.
RIVALS = 32
#: Slices by which margins are judged, and the bytes of their pieces.
JUDGED, SHORT = 2000, (32, 128)
BLOCK = 1024
#: Goes before each block: it compresses well, so that even a block of a few
#: bytes is not stored raw, where all languages would tie.
PAD = bytes(64)
#: Smaller margins are ties in all but name: a byte or two in a thousand.
MIN_MARGIN = 0.002

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 97 <= c <= 122 else 32 for c in range(256))


def normalise(text: str) -> bytes:
    words = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    return b" " + b" ".join(words) + b" " if words else b""


@dataclass(frozen=True)
class Learned:
    """Dictionaries by language, and the margin below which a text is rejected."""

    dictionaries: dict[str, bytes]
    min_margin: float


def log_size(languages: int) -> int:
    """Power of two of a dictionary's bytes and of its two tables of four bytes an entry."""
    return min(MOST_LOG, max(LEAST_LOG, (TABLE_BYTES // 8 // max(1, languages)).bit_length() - 1))


class Compressors:
    """One prepared compressor a language; built once in each task."""

    def __init__(self, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN):
        import zstandard as zs

        log, self.min_margin = log_size(len(dictionaries)), min_margin
        how = zs.ZstdCompressionParameters(
            window_log=17, chain_log=log, hash_log=log, search_log=4, min_match=4, target_length=16,
            strategy=zs.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        self.by_language = []
        for language, content in dictionaries.items():
            prepared = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            prepared.precompute_compress(compression_params=how)
            self.by_language.append((language, zs.ZstdCompressor(compression_params=how, dict_data=prepared).compress))

    def sizes(self, normal: bytes, some: list[int] | None = None) -> list[tuple[int, int]]:
        """(bytes, rank of the language), smallest first; of all languages or ``some``."""
        blocks = [PAD + normal[i : i + BLOCK] for i in range(0, len(normal), BLOCK)]
        asked = range(len(self.by_language)) if some is None else some
        return sorted((sum(len(self.by_language[k][1](b)) for b in blocks), k) for k in asked)

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score (0 to 1), relative margin, rejected."""
        if not text or not self.by_language or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0, True
        sizes = self.sizes(normalise(text))
        best = sizes[0][0]
        score = 1 / sum(2.0 ** max(best - s, -60) for s, _ in sizes)
        margin = 1 - best / sizes[1][0] if len(sizes) > 1 else 1.0
        return self.by_language[sizes[0][1]][0], score, margin, margin < self.min_margin


def _slice(text: str) -> bytes:
    normal = normalise(text)
    start = zlib.crc32(normal) % max(1, len(normal) - SLICE)
    return normal[start : start + SLICE]


def narrow_margin(judge: Compressors, slices: dict[str, list[bytes]]) -> float:
    """The margin below which pieces of slices are more often misjudged than not.

    Only slices the judge has not seen, and takes as a whole for what their label says, have a say: their pieces'
    language is then known beyond doubt.
    """
    ranks = {language: k for k, (language, _) in enumerate(judge.by_language)}
    if len(ranks) < 2:
        return MIN_MARGIN
    few, seen = max(1, JUDGED // len(slices)), []
    for language, rank in list(ranks.items())[:JUDGED]:
        rivals = sorted({*range(min(RIVALS, len(ranks))), rank})
        for whole in slices[language][-few:]:
            if judge.sizes(whole, rivals)[0][1] == rank:
                for n in SHORT:
                    sizes = judge.sizes(whole[:n], rivals)
                    seen.append((1 - sizes[0][0] / sizes[1][0], 1 if sizes[0][1] == rank else -1))
    found, balance = MIN_MARGIN, 0
    for margin, right in sorted(seen):
        balance += right
        if balance < 0 and margin > found:
            found = margin
    return found


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Learned:
    """Dictionaries by language, in order of labelled rows, and the narrow margin; held-out ids and null labels are not read."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = rows.filter(~held_out("i") & F.col("l").isNotNull() & F.col("t").isNotNull())
    counts = rows.groupBy("l").count().orderBy(F.desc("count"), "l").collect()  # a row a language
    if not counts:
        return Learned({}, MIN_MARGIN)
    shares = docs.sparkSession.createDataFrame([(r["l"], SAMPLE_DOCS / r["count"]) for r in counts], "l string, share double")
    drawn = F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / float(1 << 30)
    place = F.pmod(F.xxhash64("i", F.lit(1)), F.greatest(F.lit(1), F.length("t") - SLICE_CHARS + 1)).cast("int")
    some = rows.join(F.broadcast(shares), "l").filter(drawn < F.col("share"))
    sample = some.select("l", F.substring("t", place + 1, F.lit(SLICE_CHARS)).alias("t")).distinct().collect()
    slices: dict[str, list[bytes]] = {r["l"]: [] for r in counts}
    for r in sorted(sample, key=lambda r: (zlib.crc32(r["t"].encode("utf-8", "surrogatepass")), r["t"])):
        if part := _slice(r["t"]):
            slices[r["l"]].append(part)
    slices = {language: list(dict.fromkeys(own)) for language, own in slices.items() if own}
    size = 1 << log_size(len(slices))
    first = {language: b"".join(own)[: size // 4] for language, own in slices.items()}
    judge, final = Compressors(first), {}
    for k, (language, own) in enumerate(slices.items()):
        rivals = sorted({*range(min(RIVALS, len(slices))), k})
        fine, filled = [], 0
        for s in reversed(own):  # the first slices are in the provisional dictionaries themselves, so they come last
            if filled < size and judge.sizes(s, rivals)[0][1] == k:
                fine.append(s)
                filled += len(s)
        final[language] = b"".join(fine or own)[:size]
    return Learned(final, narrow_margin(judge, slices))


def _predictor(docs: DataFrame, learned: Learned) -> Callable:
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    return lambda: Compressors(shared.value.dictionaries, shared.value.min_margin).predict


def identify(docs: DataFrame, learned: Learned, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, margin, rejected) of every row."""
    return map_texts(docs, id_col, text_col, _predictor(docs, learned), "lang_pred string, score double, margin double, rejected boolean")


def drop_rejected(docs: DataFrame, learned: Learned, text_col: str = "text") -> DataFrame:
    """Documents whose language is told, columns unchanged."""
    predictor = _predictor(docs, learned)

    def make():
        predict = predictor()
        return lambda text: not predict(text)[3]

    return filter_texts(docs, text_col, make)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "margin", "rejected")
