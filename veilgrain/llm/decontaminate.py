"""Benchmark decontamination with one Aho-Corasick automaton.

Test items and documents are normalised alike: A-Z in lower case, words are
runs of digits, letters and all characters beyond ASCII. Ten consecutive words
of an item are a window; an item of fewer words (but not none) is one window.
All windows form one automaton, and every document's normalised text goes
through it once. Matches are mapped back to words and, for the operator's own
results, to code points of the original text.

Defined cases: a null or wordless text has no words and no hits; an item
without words, without text or without an id is no item; items may repeat or
share windows, and each id counts once. With no items nothing is hit, and an
empty table gives an empty one. Very long texts are scanned whole, repeated rows
like any other; other columns are not read (``drop_contaminated`` keeps them).

A node of the automaton takes about 50 bytes in every Python worker and windows
have at most one node a byte, so an automaton is held to ``MAX_AUTOMATON_BYTES``
of windows (200 MB). A larger test set is cut by items as it streams by: the
driver holds one part of it at a time, the documents' texts are stored once and
scanned part by part in jobs of their own, and only hits are written.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from veilgrain.llm.common import filter_texts, map_texts
from veilgrain.workspace import Workspace, read_table

WINDOW = 10
MAX_AUTOMATON_BYTES = 4 << 20

#: One byte in, one byte out: offsets stay those of the UTF-8 text.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

_automata: dict[str, object] = {}


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows_of(text: str | None, window: int = WINDOW) -> list[str]:
    """The padded windows of one item, as one character a byte."""
    words = words_of(text)
    last = max(1, len(words) - window + 1) if words else 0
    return [(b" " + b" ".join(words[i : i + window]) + b" ").decode("latin-1") for i in range(last)]


def window_parts(benchmark: DataFrame, id_col: str, text_col: str, window: int, max_bytes: int) -> Iterator[dict[str, dict]]:
    """Windows with the ids of their items (as keys), in parts of at most ``max_bytes`` of windows each (or one item); one part at least."""
    part, size = {}, 0
    items = benchmark.select(id_col, text_col).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    for item_id, text in items.toLocalIterator(prefetchPartitions=False):
        found = dict.fromkeys(windows_of(text, window))
        more = sum(map(len, found))
        if size and size + more > max_bytes:
            yield part
            part, size = {}, 0
        size += more
        for w in found:
            part.setdefault(w, {})[item_id] = None
    yield part


def automaton_of(windows: dict[str, dict]):
    """Built once in each Python worker and kept for its later tasks."""
    key = hashlib.sha256("\0".join(sorted(windows)).encode()).hexdigest()
    if key not in _automata:
        import ahocorasick

        _automata.clear()
        machine = ahocorasick.Automaton()
        for w, ids in windows.items():
            machine.add_word(w, (len(w), w.count(" ") - 1, tuple(ids)))
        if windows:
            machine.make_automaton()
        _automata[key] = machine
    return _automata[key]


def scan(text: str | None, machine) -> tuple[int, list[tuple[int, int, object]]]:
    """Number of words, and (first word, end word, item id) of each occurrence of a window."""
    words = words_of(text)
    if not words or not len(machine):
        return len(words), []
    normal = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits = list(machine.iter(normal))
    if not hits:
        return len(words), []
    ends = list(accumulate(len(w) + 1 for w in words))  # where the blank after each word is
    found = []
    for at, (_, n, ids) in hits:
        end = bisect_right(ends, at)
        found += [(end - n, end, i) for i in ids]
    return len(words), found


def covered(found: list[tuple[int, int, object]]) -> int:
    """Words inside any occurrence."""
    total = reach = 0
    for start, end, _ in sorted(found, key=lambda f: f[:2]):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def original_spans(text: str, found: list[tuple[int, int, object]]) -> list[tuple[int, int, object]]:
    """The occurrences in code points of the original text."""
    if not found:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.translate(_FOLD)
    bounds, at = [], 0
    for w in folded.split():
        start = folded.index(w, at)
        at = start + len(w)
        bounds.append((start, at))
    point = [0, *accumulate(int((b & 0xC0) != 0x80) for b in raw)]
    return [(point[bounds[s][0]], point[bounds[e - 1][1]], i) for s, e, i in found]


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_automaton_bytes: int = MAX_AUTOMATON_BYTES,
) -> DataFrame:
    """One row per document: n_words, n_hit, item_ids and the hit passages in code points of the text."""
    item = benchmark.schema[item_col].dataType.simpleString()
    schema = f"n_words long, n_hit long, item_ids array<{item}>, passages array<struct<start:long,end:long,item_id:{item}>>"
    parts = window_parts(benchmark, item_col, item_text_col, window, max_automaton_bytes)
    first, second = next(parts), next(parts, None)
    if second is None:
        return _summed(docs, docs.sparkSession.sparkContext.broadcast(first), id_col, text_col, schema)
    ws = Workspace(docs.sparkSession, "passages")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row_no"))
    rows, hits = ws.write(rows, "rows"), None
    for k, part in enumerate(chain([first, second], parts)):
        own = ws.write(_hits(rows, docs.sparkSession.sparkContext.broadcast(part), item), f"hits_{k}")
        hits = own if hits is None else hits.unionByName(own)
    by_row = hits.groupBy("row_no").agg(F.flatten(F.collect_list("found")).alias("found"))
    joined = rows.join(by_row, "row_no", "left").select(F.struct("id", "found").alias("of"), "text")
    nothing = docs.sparkSession.sparkContext.broadcast({})
    done = _summed(joined, nothing, "of", "text", schema, carried=True)
    return done.select(F.col("of.id").alias(id_col), "n_words", "n_hit", "item_ids", "passages")


def _hits(rows: DataFrame, shared, item: str) -> DataFrame:
    """(row_no, found: word spans with item ids) of the rows that one part of the windows hits."""

    def make():
        machine = automaton_of(shared.value)
        return lambda text: ([dict(zip("sei", f, strict=True)) for f in scan(text, machine)[1]],)

    return map_texts(rows, "row_no", "text", make, f"found array<struct<s:long,e:long,i:{item}>>").filter(F.size("found") > 0)


def _summed(rows: DataFrame, shared, id_col: str, text_col: str, schema: str, carried: bool = False) -> DataFrame:
    """The results of every row, from its own scan or, where ``id_col`` carries them, from the scans before."""

    def result(text: str | None, n: int, found: list) -> tuple:
        spans = [dict(zip(("start", "end", "item_id"), s, strict=True)) for s in original_spans(text, found)]
        return n, covered(found), sorted({f[2] for f in found}), spans

    if not carried:

        def make():
            machine = automaton_of(shared.value)
            return lambda text: result(text, *scan(text, machine))

        return map_texts(rows, id_col, text_col, make, schema)

    types = StructType([rows.schema[id_col], *_parse_datatype_string(schema).fields])
    out = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for of, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text := text.as_py())
                done.append(result(text, len(words), [(f["s"], f["e"], f["i"]) for f in of.as_py()["found"] or []]))
            columns = [batch.column(0).cast(out.field(0).type), *(pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), list(out)[1:], strict=True))]
            if done:
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return rows.select(id_col, text_col).mapInArrow(run, types)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, max_automaton_bytes: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """Documents that hold no window of any item, columns unchanged."""
    parts = window_parts(benchmark, "item_id", "text", window, max_automaton_bytes)
    part, ws = next(parts), None
    while True:
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def make(shared=shared):
            machine = automaton_of(shared.value)
            return lambda text: not scan(text, machine)[1]

        docs = filter_texts(docs, text_col, make)
        part = next(parts, None)
        if part is None:
            return docs
        ws = ws or Workspace(docs.sparkSession, "clean")
        docs = ws.write(docs, f"clean_{uuid.uuid4().hex}")  # each part in a job of its own, so that workers hold one automaton


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text='text')} AS w FROM documents),
b AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, {_WORDS.format(text='text')} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS passage FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
starts AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT r, i, n, item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS passage FROM starts) JOIN windows USING (n, passage)),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
