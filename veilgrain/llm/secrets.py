"""Secret scan: fixed base patterns plus formats inferred from the secrets they find.

A first pass over the texts finds the base spans (``assign``, ``access``,
``hex``) and counts, over all candidates of all texts, which character follows
which and how long candidates are. A candidate is any run of ``MIN_VALUE`` or
more characters of ``[A-Za-z0-9+/_.=-]`` outside the base spans, also beside
one, without dots at its ends. The values that the base patterns label, a
bounded sample for each kind, form prefix trees whose statistically compatible
states are merged (Hoeffding bound, red-blue order) into probabilistic automata.

The second pass scores every candidate by its likelihood under each format
(symbols from the automaton, length from the labelled lengths) against the
background of all candidates. The odds of the kind against the background start
from their counts in all texts, so what is common in prose needs more evidence;
candidates whose odds end ``MIN_GAIN`` or more above even are added as
``like_<kind>`` spans. What is sent to the executors are formats of a bounded
size and counts of pairs of 68 characters.

Defined cases: null or empty text has no spans; base spans never go; with no
labelled value of a kind that kind infers nothing. Offsets are code points, end
exclusive. Texts are scanned whole; repeated rows are scanned like any other.
An empty table gives an empty one; other columns are neither read nor renamed.
Of a labelled value its first ``TRAIN_CHARS`` characters (and its length) are
learned from; all values and candidates are scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.llm.common import map_texts
from veilgrain.workspace import Workspace, read_table

#: Labelled values of a kind that a format is inferred from.
SAMPLE_VALUES = 1500
#: Natural logarithm of the odds at which a candidate is added.
MIN_GAIN = 6.0
#: Significance of the compatibility test.
ALPHA = 0.05
#: Characters of a labelled value that go into its prefix tree.
TRAIN_CHARS = 200
#: Added to every count of a symbol, and symbols there are.
SMOOTHING, SYMBOLS = 0.05, 68
#: Lengths from which on candidates are counted together in the background.
LONG = 256
#: Verdicts on short candidates that a worker remembers.
REMEMBERED, SHORT = 1 << 17, 64

# The base patterns and their least lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_VALUE = 6, 20, 24, 6

_RUN = re.compile(rf"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{{{MIN_VALUE - 1},}}")
_ORDER = {k: i for i, k in enumerate([*KINDS, *(f"like_{k}" for k in KINDS)])}
_SPAN = "kind:string,start:long,end:long,value:string"


def _class(chars: str) -> bytes:
    return bytes(120 if c < 128 and re.match(f"[{chars}]", chr(c)) else 32 for c in range(256))


_IS_HEX = _class("0-9a-f")
#: Numbers of the symbols of candidates from 1; 0 ends one.
_NUMBER = {c: k for k, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", 1)}
_AS_NUMBER = bytes(_NUMBER.get(chr(c), 0) for c in range(256))
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret value), by start, then kind. Cheap byte searches rule out most texts."""
    raw = text.encode("utf-8", "surrogatepass")
    found = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if b"AKIA" in raw:
        found += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if b"x" * MIN_HEX in raw.translate(_IS_HEX):
        found += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]]))


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of the runs outside the base spans, which cut the runs they are in."""
    out, at = [], 0
    for start, end in [*((s, e) for _, s, e, _ in sorted(base, key=lambda b: b[1])), (len(text), len(text))]:
        if start - at >= MIN_VALUE:
            for m in _RUN.finditer(text, at, start):
                value = m[0].rstrip(".")
                if len(value) >= MIN_VALUE:
                    out.append((m.start(), m.start() + len(value), value))
        at = max(at, end)
    return out


class Format:
    """A probabilistic automaton inferred from sample strings, with their lengths."""

    def __init__(self, values: list[str]):
        """``values``: distinct labelled values, whole."""
        # state: symbol -> [next state, count]; visits; endings
        self.edges: list[dict[str, list[int]]] = [{}]
        self.visits, self.stops = [0], [0]
        for v in values:
            state = 0
            self.visits[0] += 1
            for c in v[:TRAIN_CHARS]:
                edge = self.edges[state].setdefault(c, [len(self.edges), 0])
                if edge[0] == len(self.edges):
                    self.edges.append({})
                    self.visits.append(0)
                    self.stops.append(0)
                edge[1] += 1
                state = edge[0]
                self.visits[state] += 1
            self.stops[state] += 1
        self.lengths, self.n = Counter(map(len, values)), len(values)
        self._merge_states()
        self._tabulate()

    def _differ(self, a: int, b: int) -> bool:
        """Whether endings or any symbol differ by more than chance, here or further on."""
        todo = [(a, b)]
        bound = math.sqrt(0.5 * math.log(2 / ALPHA))
        while todo:
            a, b = todo.pop()
            na, nb = self.visits[a], self.visits[b]
            if not na or not nb:
                continue
            gap = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.stops[a] / na - self.stops[b] / nb) > gap:
                return True
            for c in self.edges[a].keys() | self.edges[b].keys():
                ea, eb = self.edges[a].get(c, (0, 0)), self.edges[b].get(c, (0, 0))
                if abs(ea[1] / na - eb[1] / nb) > gap:
                    return True
                if ea[1] and eb[1]:
                    todo.append((ea[0], eb[0]))
        return False

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` to ``red`` and what follows it."""
        todo = [(red, blue)]
        while todo:
            r, b = todo.pop()
            self.visits[r] += self.visits[b]
            self.stops[r] += self.stops[b]
            for c, (to, n) in self.edges[b].items():
                if c in self.edges[r]:
                    self.edges[r][c][1] += n
                    todo.append((self.edges[r][c][0], to))
                else:
                    self.edges[r][c] = [to, n]

    def _merge_states(self) -> None:
        reds = [0]
        known = {0}
        while True:
            blues = [(r, c) for r in reds for c, e in self.edges[r].items() if e[0] not in known]
            if not blues:
                return
            r, c = max(blues, key=lambda x: (self.edges[x[0]][x[1]][1], -x[0], x[1]))
            blue = self.edges[r][c][0]
            match = next((red for red in reds if not self._differ(red, blue)), None)
            if match is None:
                reds.append(blue)
                known.add(blue)
            else:
                self.edges[r][c][0] = match
                self._fold(match, blue)

    def _tabulate(self) -> None:
        """Log-probabilities of each state's symbols, once; the tree itself is not needed any more."""
        self.table, self.other = [], []
        for edges in self.edges:
            seen = math.log(sum(e[1] for e in edges.values()) + SMOOTHING * SYMBOLS)
            self.table.append({c: (math.log(n + SMOOTHING) - seen, to) for c, (to, n) in edges.items()})
            self.other.append(math.log(SMOOTHING) - seen)
        self.by_length: dict[int, float] = {}
        del self.edges, self.visits, self.stops

    def best(self) -> np.ndarray:
        """The largest log-probability that any state gives to each symbol, by its number from 1 on. No length has more than 1."""
        top = dict.fromkeys(_NUMBER, max(self.other))
        for edges in self.table:
            for c, (p, _) in edges.items():
                top[c] = max(top.get(c, p), p)
        return np.array([top[c] for c in _NUMBER])

    def log_likelihood(self, value: str) -> float:
        """Unseen symbols, and those from a state never reached, have the small probability of an even guess."""
        total, state = 0.0, 0
        for c in value:
            step = self.table[state].get(c)
            total, state = (total + step[0], step[1]) if step else (total + self.other[state], 0)
        size = len(value)
        if size not in self.by_length:
            near = sum(n / (1 + abs(length - size)) ** 3 for length, n in self.lengths.items())
            if len(self.by_length) > 4096:
                self.by_length.clear()
            self.by_length[size] = math.log((near + 0.01) / (self.n + 1))
        return total + self.by_length[size]


class Background:
    """What candidates look like: which symbol follows which (0 before the first), and lengths, from counts of all of them."""

    def __init__(self, follows: dict[tuple[int, int], int], lengths: dict[int, int]):
        self.candidates = sum(lengths.values())
        count = np.zeros((SYMBOLS + 1, SYMBOLS + 1))
        for (a, b), n in follows.items():
            count[a, b] = n
        # What follows a symbol that few candidates hold is guessed from all symbols, so that no candidate explains itself.
        alone = (count.sum(axis=0) + SMOOTHING) / (count.sum() + SMOOTHING * SYMBOLS)
        self.pairs = np.log((count + SYMBOLS * alone) / (count.sum(axis=1, keepdims=True) + SYMBOLS))
        self.by_length = [math.log((lengths.get(k, 0) + SMOOTHING) / (self.candidates + SMOOTHING * LONG)) for k in range(LONG + 1)]

    def log_likelihood(self, value: str) -> float:
        numbers = np.frombuffer(b"\0" + value.encode("latin-1").translate(_AS_NUMBER), np.uint8)
        return float(self.pairs[numbers[:-1], numbers[1:]].sum()) + self.by_length[min(len(value), LONG)]


def _numbers(values: list[str]) -> np.ndarray:
    """Numbers of the symbols of all values, with a 0 before each."""
    return np.frombuffer(("\0" + "\0".join(values)).encode("latin-1").translate(_AS_NUMBER), np.uint8)


def follow_counts(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often a symbol follows another in ``values`` (numbers, 0 before the first; a flat square), and their lengths."""
    raw = _numbers(values).astype(np.intp)
    code = raw[:-1] * 128 + raw[1:]
    return np.bincount(code[raw[1:] != 0], minlength=128 * 128), np.bincount([min(len(v), LONG) for v in values], minlength=LONG + 1)


def survey(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Labelled values as (kind, value), and the counts of all candidates: (a, b, n) for pairs, (null, length, n) for lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, lengths = np.zeros(128 * 128, np.int64), np.zeros(LONG + 1, np.int64)
        names = ["kind", "value", "a", "b", "n"]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]

        def rows(*columns) -> pa.RecordBatch:
            size = max(len(c) for c in columns if c is not None)
            return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            labelled = []
            for item in batch.column(0):
                text = item.as_py()
                if text:
                    base = base_spans(text)
                    labelled += [(s[0], s[3]) for s in base]
                    if values := [v for _, _, v in candidates(text, base)]:
                        more = follow_counts(values)
                        pairs += more[0]
                        lengths += more[1]
            if labelled:
                labelled = sorted(set(labelled))
                yield rows([k for k, _ in labelled], [v for _, v in labelled], None, None, None)
        some = np.flatnonzero(pairs)
        if len(some):
            yield rows(None, None, some // 128, some % 128, pairs[some])
        some = np.flatnonzero(lengths)
        if len(some):
            yield rows(None, None, None, some, lengths[some])

    return docs.select(text_col).mapInArrow(run, "kind string, value string, a int, b int, n long")


def infer_formats(found: DataFrame) -> tuple[dict[str, Format], dict[str, int], Background]:
    """A format for each kind with labelled values, how many distinct values it has, and the background. ``found``: a stored survey."""
    labelled = found.filter("kind IS NOT NULL").select("kind", "value").distinct()
    sizes = {r["kind"]: r["count"] for r in labelled.groupBy("kind").count().collect()}
    formats = {}
    for kind in KINDS:
        if kind in sizes:
            drawn = labelled.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(SAMPLE_VALUES)
            cut = F.substring("value", 1, TRAIN_CHARS)
            rows = drawn.select(cut.alias("value"), F.length("value").alias("size")).collect()
            formats[kind] = Format([r["value"] + "." * (r["size"] - len(r["value"])) for r in rows])
    counts = found.filter("kind IS NULL").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()  # at most the square of the symbols
    follows = {(r["a"], r["b"]): r["n"] for r in counts if r["a"] is not None}
    lengths = {r["b"]: r["n"] for r in counts if r["a"] is None}
    return formats, sizes, Background(follows, lengths)


def judge(formats: dict[str, Format], sizes: dict[str, int], background: Background) -> Callable[[list[str]], list[str]]:
    """For a list of candidates: the kind that each looks like, or an empty string.

    A candidate's odds are bounded by the best that any state makes of each of
    its symbols. That bound is summed up for all candidates of a text at once;
    only those that it leaves open are walked through the automata.
    """
    start = {k: math.log(sizes[k] / max(background.candidates, sizes[k])) for k in formats}
    width = SYMBOLS + 1
    bounds = [(np.pad(f.best(), (1, 0))[None, :] - background.pairs).ravel() for f in formats.values()]
    for table in bounds:
        table[::width] = 0.0  # what ends a candidate weighs nothing
    by_length = np.array(background.by_length)
    known: dict[str, str] = {}

    def weigh(value: str) -> str:
        base = background.log_likelihood(value)
        scored = [(formats[k].log_likelihood(value) + start[k] - base, k) for k in KINDS if k in formats]
        best = max(scored, key=lambda x: (x[0], -_ORDER[x[1]]), default=(-math.inf, ""))
        return f"like_{best[1]}" if best[0] >= MIN_GAIN else ""

    def one(value: str) -> str:
        if len(value) > SHORT:
            return weigh(value)
        if value not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[value] = weigh(value)
        return known[value]

    def kinds(values: list[str]) -> list[str]:
        out = [""] * len(values)
        if not values or not formats:
            return out
        raw = _numbers(values)
        code = raw[:-1].astype(np.intp) * width + raw[1:]
        length = np.fromiter(map(len, values), np.int64, len(values))
        first = np.cumsum(length + 1) - length - 1
        least = MIN_GAIN + by_length[np.minimum(length, LONG)] - 1e-6
        still = np.zeros(len(values), dtype=bool)
        for table, k in zip(bounds, formats, strict=True):
            still |= np.add.reduceat(table[code], first) + start[k] >= least
        for k in np.flatnonzero(still):
            out[k] = one(values[k])
        return out

    return kinds


def scan(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): arrays of (kind, start, end, value) in order."""
    shared = docs.sparkSession.sparkContext.broadcast(infer_formats(ws.write(survey(docs, text_col), "survey")))
    names = ("kind", "start", "end", "value")

    def make():
        kinds_of = judge(*shared.value)

        def one(text):
            if not text:
                return [], []
            base = base_spans(text)
            found = candidates(text, base)
            added = [(kind, *c) for c, kind in zip(found, kinds_of([v for _, _, v in found]), strict=True) if kind]
            return [dict(zip(names, s, strict=True)) for s in base], [dict(zip(names, s, strict=True)) for s in added]

        return one

    return map_texts(docs, id_col, text_col, make, f"base array<struct<{_SPAN}>>, added array<struct<{_SPAN}>>")


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    ranks = F.create_map(*[F.lit(x) for pair in _ORDER.items() for x in pair])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), ranks[s["kind"]].alias("b"), s["end"].alias("c"), s["kind"].alias("d")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["d"], s["a"], s["c"])), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"), Workspace(spark, "op2"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op2_secrets`` that SQL can express: counts and digest of the base spans."""
    return op2_secrets(spark, sf_dir).drop("spans", "n_added")


def _base_sql(kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: matches lie between the pieces that the same pattern splits out."""
    found = f"string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS v"
    placed = f"SELECT r, i, v[i] AS value, len(m[i]) AS size, len(g[i]) + len(m[i]) AS step FROM (SELECT r, g, m, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, {found} FROM d))"
    ends = f"SELECT *, CAST(sum(step) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS e FROM ({placed})"
    return f"SELECT r, '{kind}' AS kind, {KINDS.index(kind)} AS rank, e - size AS s, e FROM ({ends}) WHERE len(value) >= {least}"


_ANY_CASE = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_base_sql("assign", _ANY_CASE + "[\"'']? *[:=] *[\"'']?([A-Za-z0-9+/_.=-]+)", 2, MIN_ASSIGN)}
  UNION ALL {_base_sql("access", "AKIA[A-Z0-9]+", 0, MIN_ACCESS)} UNION ALL {_base_sql("hex", "[0-9a-f]+", 0, MIN_HEX)}),
joined AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS base
  FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256 FROM d LEFT JOIN joined USING (r)
"""
