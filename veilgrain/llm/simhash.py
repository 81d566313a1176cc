"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are 64-bit majority votes over the XXH64 of a text's word shingles.
Equal fingerprints are one node from the start. Two fingerprints that differ in
at most three bits agree in two of five bit blocks, so each goes to the ten
buckets of its block pairs (about 26 bits a key). Rows are range-partitioned by
bucket and, inside a bucket, by a hash: a bucket of any size is dealt over as
many partitions as it fills, none of which is larger than the others.

Inside a partition fingerprints are compared bit-sliced: bit planes are stored
vertically (bit p of 64 fingerprints in one word), differences are added up
plane by plane in carry-save counters, and a block of lanes is abandoned once
all of them exceed the radius. A large bucket is walked by breadth-first
search that takes what it reaches out of the planes, so a dense group costs
about one pass and gives one star of links.

Near copies in the sense of a shingle similarity of 0.8 differ in far more bits
than three, beyond what equal bit blocks can find. ``drop_near_copies`` and
``similar_components`` therefore use 256-bit fingerprints of five-word shingles
(the XXH64 mixed three times more), radius ``WIDE_RADIUS``, and take the
buckets from ``BANDS`` pairs of min-hashes of the same shingles: two texts of
similarity 0.8 share a pair with probability 0.64, and none of ten with 0.36 **
10. A passage that many texts share, and that is a tenth of each, brings only a
hundredth of them into its buckets, by the pairs of its shingles; with single
min-hashes it would be a tenth in one bucket for each of its shingles. Like the
similarity, fingerprints and pairs count a repeated shingle once. The components
so found are only groups of candidates; inside each, two documents are linked if
the exact similarity of their sets of shingles (64-bit hashes) is ``SIMILAR``
or more.

Buckets that span partitions are finished afterwards: with the components found
so far (the ten tables deal them differently, so they usually are complete),
only fingerprints outside the bucket's prevailing component are compared with
the other parts of the bucket. A partition has two ends, so there are fewer
such buckets than partitions; their keys are sent to the rows, never the rows
to one task by such a key.

Defined cases: lower case is A-Z only; a null, empty or wordless text has
fingerprint zero and links like any other (256 bits: it has no buckets and
links to nothing); fewer words than a shingle are one
shingle. A null doc_id never becomes a component id unless all ids of the
component are null, when it is null. Repeated rows each get a row. An empty
table gives an empty one; very long texts are taken whole; other columns are
kept by ``drop_near_copies`` and not read by the rest, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.llm.common import BROADCAST_IDS, map_texts, without_ids
from veilgrain.llm.components import connected_components, merged_components
from veilgrain.workspace import Workspace, read_table

SEED = 42
RADIUS = 3
#: Bit blocks; any two of them must agree: RADIUS differing bits leave at least two untouched.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TABLES = [sum(((1 << n) - 1) << at for at, n in pair) for pair in combinations(BLOCKS, 2)]
#: 64-bit words and radius of the wide fingerprints, and pairs of min-hashes. 64 of 256 bits
#: is an angle of 45 degrees; texts of similarity 0.8 are at 27 degrees or less.
WIDE, WIDE_RADIUS, BANDS = 4, 64, 10
#: Least similarity of near copies, as a fraction.
SIMILAR = (4, 5)
#: Times a group of candidates is dealt, bytes of shingles in a partition, and in one packed part of a spanning group.
DEALS, SET_BYTES, SET_PART = 2, 16 << 20, 1 << 20
#: Rows from which on a smaller group is cut as well, into so many parts at most.
PART_ROWS, FEW_PARTS = 64, 32
#: Buckets up to this size are compared pair by pair of neighbours, larger ones by search.
SMALL = 48
#: Queries that go against the planes together, and lanes in a block.
QUERIES, LANES = 16, 1 << 15
#: Table rows (ten a fingerprint) that one partition should hold.
ROWS_PER_PARTITION = 400_000
#: Fingerprints in one packed part of a spanning bucket.
PART = 1 << 14

_BYTE = np.arange(8, dtype=np.int64) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the ``width``-word shingles in order, repeats included; fewer words are one shingle, none none."""
    from xxhash import xxh64_digest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        digests = xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        spans = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)
        digests = b"".join([xxh64_digest(joined[s:e], SEED) for s, e in spans])
    return np.frombuffer(digests, dtype=">u8").astype(np.uint64)


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of hashed values (a 64-bit finaliser)."""
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    tally = np.bincount((octets + _BYTE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(tally.ravel() * 2 > len(octets)).tobytes(), "big")


def fingerprint(text: str | None, width: int) -> int:
    """Unsigned 64-bit fingerprint of the ``width``-word shingles."""
    return majority(shingle_hashes(text, width))


def wide_fingerprint(text: str | None, width: int) -> tuple[list[int], list[int]]:
    """``WIDE`` unsigned words of fingerprint, and ``BANDS`` pairs of min-hashes (none for no words), of the set of shingles."""
    hashes = np.unique(shingle_hashes(text, width))
    words = [majority(mixed(hashes, k) if k else hashes) for k in range(WIDE)]
    bands = []
    for k in range(BANDS if len(hashes) else 0):  # each half of a mixed hash is a hash of its own
        halves = mixed(hashes, 100 + k).view(np.uint32).reshape(-1, 2).min(axis=0)
        bands.append(int(halves[0]) << 32 | int(halves[1]))
    return words, bands


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp: the fingerprint's 64 bits as a signed long) of every row."""
    return map_texts(docs, id_col, text_col, lambda: lambda text: (_long(fingerprint(text, width)),), "fp long")


def wide_fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0, f1, ..., sketch: array<long>) of every row."""

    def make():
        def one(text):
            words, sketch = wide_fingerprint(text, width)
            return *map(_long, words), list(map(_long, sketch))

        return one

    return map_texts(docs, id_col, text_col, make, ", ".join(f"f{k} long" for k in range(WIDE)) + ", sketch array<long>")


# Bit-sliced comparison


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Vertical form of an (m, words) array of fingerprints: 64 planes a word of ceil(m / 64) words each."""
    m, words = fps.shape
    bits = np.unpackbits(np.ascontiguousarray(fps, dtype="<u8").view(np.uint8).reshape(m, 8 * words), axis=1, bitorder="little")
    lanes = np.zeros((64 * words, -(-m // 64) * 64), dtype=np.uint8)
    lanes[:, :m] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view("<u8")


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save addition of three bits in every lane: sum, carry."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def over_radius(difference: Callable[[int], np.ndarray], planes: int, shape: tuple, radius: int) -> np.ndarray:
    """Lanes (as bits) in which more than ``radius`` of the planes of differences are set.

    Digit k of the counter holds bit k of every lane's count. Four planes at a
    time go through carry-save adders; what they carry ripples up. The counter
    starts so that the last carry falls out at radius + 1, and that bit sticks.
    Once every lane is over, the block is abandoned.
    """
    digits = max(2, radius.bit_length())
    start = (1 << digits) - 1 - radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    counter = [np.full(shape, full if start >> k & 1 else 0, dtype=np.uint64) for k in range(digits)]
    over = np.zeros(shape, dtype=np.uint64)
    for p in range(0, planes, 4):
        counter[0], low = _add(counter[0], difference(p), difference(p + 1))
        counter[0], high = _add(counter[0], difference(p + 2), difference(p + 3))
        counter[1], carry = _add(counter[1], low, high)
        for k in range(2, digits):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if p % 16 == 12 and p > radius and (over == full).all():
            break
    return over


def near(planes: np.ndarray, queries: np.ndarray, lanes: int, radius: int) -> np.ndarray:
    """Boolean (query, lane): within the radius. Planes are taken in blocks of lanes."""
    out = np.empty((len(queries), lanes), dtype=bool)
    count = len(planes)
    flips = [(np.uint64(0) - (queries[:, p >> 6] >> np.uint64(p & 63) & np.uint64(1)))[:, None] for p in range(count)]
    for at in range(0, planes.shape[1], LANES // 64):
        block = planes[:, at : at + LANES // 64]
        over = over_radius(lambda p, block=block: block[p] ^ flips[p], count, (len(queries), block.shape[1]), radius)
        inside = np.unpackbits((~over).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        width = min(lanes - at * 64, block.shape[1] * 64)
        out[:, at * 64 : at * 64 + width] = inside[:, :width]
    return out


def small_links(bucket: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius in sorted small buckets, all buckets at once, one lag after the other."""
    left, right = [], []
    index = np.arange(len(fps))
    lag = 1
    while len(at := index[:-lag][bucket[lag:] == bucket[:-lag]] if lag < len(index) else index[:0]):
        for some in np.array_split(at, -(-len(at) // LANES)):
            planes = planes_of(fps[some] ^ fps[some + lag])
            over = over_radius(planes.__getitem__, len(planes), planes.shape[1:], radius)
            inside = some[np.unpackbits((~over).view(np.uint8), bitorder="little")[: len(some)].astype(bool)]
            left.append(inside)
            right.append(inside + lag)
        lag += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (index[:0], index[:0])


def search_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (member, first reached) of the components of one large bucket.

    Seeds are asked many at a time. Each that has not been reached meanwhile
    starts a breadth-first search of its whole component from what it hit; what
    is reached once is no longer a target, so a dense group costs about one pass.
    """
    rest = np.arange(len(fps))
    planes, gone = planes_of(fps), np.zeros(len(fps), dtype=bool)  # lanes are positions in rest
    left, right = [], []

    while not gone.all():
        seeds = np.flatnonzero(~gone)[:QUERIES]
        hits = near(planes, fps[rest[seeds]], len(rest), radius) & ~gone
        hits[np.arange(len(seeds)), seeds] = False
        for seed, hit in zip(seeds, hits, strict=True):
            if gone[seed]:
                continue
            gone[seed] = True
            centre, reached = rest[seed], hit & ~gone
            frontier: list[int] = []
            while True:
                gone |= reached
                found = rest[reached]
                frontier += found.tolist()
                left.append(found)
                right.append(np.full(len(found), centre))
                if not frontier:
                    break
                some, frontier = np.array(frontier[:QUERIES]), frontier[QUERIES:]
                reached = near(planes, fps[some], len(rest), radius).any(axis=0) & ~gone
        if gone.sum() > max(1024, len(rest) // 2):  # take what has been reached out of the planes
            rest = rest[~gone]
            planes, gone = planes_of(fps[rest]), np.zeros(len(rest), dtype=bool)
    return (np.concatenate(left), np.concatenate(right)) if left else (rest[:0], rest[:0])


# Distribution


def _comparer(words: int, radius: int) -> Callable:
    """For one sorted partition of (t, key, node, f0, ...): its links, and the rows of its first and last bucket."""
    names = [f"f{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        t, key, node = (table.column(c).to_numpy() for c in ("t", "key", "node"))
        fps = np.stack([table.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
        fresh = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.append(fresh, len(t)))
        bucket = np.repeat(np.arange(len(fresh)), sizes)
        at = np.flatnonzero((sizes[bucket] > 1) & (sizes[bucket] <= SMALL))
        i, j = small_links(bucket[at], fps[at], radius)
        links = [(at[i], at[j])]
        for k in np.flatnonzero(sizes > SMALL):
            i, j = search_links(fps[fresh[k] : fresh[k] + sizes[k]], radius)
            links.append((i + fresh[k], j + fresh[k]))
        i, j = (np.concatenate([x[side] for x in links]) for side in (0, 1))
        i, j = i[node[i] != node[j]], j[node[i] != node[j]]
        edge = np.flatnonzero((bucket == 0) | (bucket == bucket[-1]))
        n, e = len(i), len(edge)

        def column(of_links, of_edge, kind) -> pa.Array:
            first = pa.nulls(n, kind) if of_links is None else pa.array(of_links, kind)
            second = pa.nulls(e, kind) if of_edge is None else pa.array(of_edge, kind)
            return pa.concat_arrays([first, second])

        part = np.full(e, TaskContext.get().partitionId())
        columns = [column(node[i], node[edge], pa.int64()), column(node[j], None, pa.int64()), column(None, t[edge], pa.int32()), column(None, key[edge], pa.int64()), column(None, part, pa.int32())]
        columns += [column(None, fps[edge, k].view(np.int64), pa.int64()) for k in range(words)]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "b", "t", "key", "part", *names])

    return run


def _cross_links(words: int, radius: int) -> Callable:
    """Links between a packed part of stragglers and another part of their bucket, where labels differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked, others = (np.frombuffer(row[c], dtype="<i8").reshape(-1, 2 + words) for c in ("asked", "others"))
                planes = planes_of(others[:, 2:])
                for at in range(0, len(asked), QUERIES):
                    some = asked[at : at + QUERIES]
                    hit = near(planes, np.ascontiguousarray(some[:, 2:]).view(np.uint64), len(others), radius)
                    q, o = np.nonzero(hit & (some[:, 1][:, None] != others[:, 1][None, :]))
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(some[q, 0]), pa.array(others[o, 0])], names=["a", "b"])

    return run


def _packed(rows: DataFrame, words: int, name: str) -> DataFrame:
    """Rows of (node, label, f0, ...) as binary parts of at most PART rows by (t, key, part), sorted by these."""
    keys, body = ["t", "key", "part"], ["node", "label", *(f"f{k}" for k in range(words))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
            cuts = [*np.flatnonzero(np.r_[True, (own[1:] != own[:-1]).any(axis=1)]).tolist(), len(own)]
            data = np.stack([batch.column(c).to_numpy() for c in body], axis=1).astype("<i8")
            spans = [(s, min(s + PART, e)) for a, e in zip(cuts, cuts[1:], strict=False) for s in range(a, e, PART)]
            arrays = [pa.array([own[s, k] for s, _ in spans], pa.int64()) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([data[s:e].tobytes() for s, e in spans], pa.binary())], names=[*keys, name])

    cast = [F.col(k).cast("long").alias(k) for k in keys]
    return rows.select(*cast, *body).mapInArrow(pack, f"t long, key long, part long, {name} binary")


def _finish_spanning(edge_rows: DataFrame, found: DataFrame, words: int, radius: int, ws: Workspace) -> DataFrame | None:
    """Links that buckets cut by a partition boundary still lack in the components ``found``; None if there can be none."""
    spanning = edge_rows.groupBy("t", "key").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("t", "key")
    spanning = F.broadcast(ws.write(spanning, "spanning_keys"))  # fewer than partitions
    labels = found.withColumnRenamed("root", "label")
    rows = edge_rows.join(spanning, ["t", "key"]).join(labels, "node", "left")
    fields = [f"f{k}" for k in range(words)]
    rows = ws.write(rows.select("t", "key", "part", "node", F.coalesce("label", "node").alias("label"), *fields), "spanning")
    sizes = rows.groupBy("t", "key", "label").count()
    main = sizes.groupBy("t", "key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("n"))
    unsettled = ws.write(main.filter("n > 1").select("t", "key", "main"), "unsettled")
    if not unsettled.limit(1).count():
        return None
    # One partition's share of a bucket stays one part, so no bucket is gathered in a task.
    opened = rows.join(F.broadcast(unsettled), ["t", "key"])
    spread = opened.repartition("t", "key", "part").sortWithinPartitions("t", "key", "part")
    parts = F.broadcast(ws.write(opened.select("t", "key", F.col("part").cast("long").alias("other_part")).distinct(), "parts"))  # two a partition
    asked = _packed(spread.filter("label <> main"), words, "asked").join(parts, ["t", "key"]).filter("part <> other_part")
    others = _packed(spread, words, "others").withColumnRenamed("part", "other_part")
    pairs = asked.join(others, ["t", "key", "other_part"]).select("asked", "others")
    return pairs.repartition(F.xxhash64("asked", "others")).mapInArrow(_cross_links(words, radius), "a long, b long")


def components_of(rows: DataFrame, nodes: int, words: int, radius: int, ws: Workspace) -> DataFrame:
    """(node, root) of all nodes with links. ``rows``: (t, key, node, f0, ...), about as many as ``nodes`` says."""
    spark = rows.sparkSession
    n = max(spark.sparkContext.defaultParallelism, nodes // ROWS_PER_PARTITION)
    within = F.xxhash64("t", "node")
    dealt = rows.repartitionByRange(n, "t", "key", within).sortWithinPartitions("t", "key", within)
    fields = ", ".join(f"f{k} long" for k in range(words))
    compared = dealt.mapInArrow(_comparer(words, radius), f"node long, b long, t int, key long, part int, {fields}")
    compared = ws.write(compared, "compared")
    links = compared.filter("b IS NOT NULL").select(F.col("node").alias("a"), "b")
    found = connected_components(links, ws, "first")
    more = _finish_spanning(compared.filter("b IS NULL").drop("b"), found, words, radius, ws)
    return found if more is None else merged_components(found, more, ws, "all")


def near_duplicates(docs: DataFrame, ws: Workspace, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id its 64-bit fingerprint reaches by links."""
    found = ws.write(fingerprints(docs, width, id_col, text_col), "found")
    # Equal fingerprints are one node. Nodes need ids even where doc ids are null: the fingerprint itself.
    fps = ws.write(found.groupBy("fp").agg(F.min(id_col).alias("least")), "fps")
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(_long(m)).alias("key")) for t, m in enumerate(TABLES)]))
    rows = fps.select(keys.alias("k"), "fp").select("k.t", "k.key", F.col("fp").alias("node"), F.col("fp").alias("f0"))
    roots = components_of(rows, fps.count() * len(TABLES), 1, RADIUS, ws)
    joined = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = ws.write(joined, "rooted")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    components = ws.write(joined.join(least, "root").select("fp", "component_id"), "components")
    return found.join(components, "fp").select(id_col, "fp", "component_id")


# Links of near copies, kept only at the exact shingle similarity


def _similar(shared: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """Whether shared / union of two sets is at least ``SIMILAR``, in whole numbers."""
    over, under = SIMILAR
    return shared * under >= (size + sizes - shared) * over


class Sets:
    """Sets of shingle hashes in order of size, asked which are similar to a given one."""

    def __init__(self, sets: list[np.ndarray]):
        lengths = np.fromiter(map(len, sets), np.int64, len(sets))
        self.order = np.argsort(lengths, kind="stable")
        self.terms, flat = np.unique(np.concatenate([sets[k] for k in self.order]), return_inverse=True)
        self._lay(flat, lengths[self.order])
        self.mark = np.zeros(len(self.terms), dtype=bool)

    def _lay(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat, self.lengths, self.ends = flat, lengths, np.cumsum(lengths)

    def like(self, asked: np.ndarray) -> np.ndarray:
        """Positions (in order of size) of the sets similar to ``asked``; only sizes that can be are looked at."""
        over, under = SIMILAR
        lo = np.searchsorted(self.lengths * under, len(asked) * over)
        hi = np.searchsorted(self.lengths * over, len(asked) * under, side="right")
        if lo >= hi:
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, asked), len(self.terms) - 1)
        at = at[self.terms[at] == asked]
        self.mark[at] = True
        first = self.ends[lo] - self.lengths[lo]
        shared = np.add.reduceat(self.mark[self.flat[first : self.ends[hi - 1]]], self.ends[lo:hi] - self.lengths[lo:hi] - first, dtype=np.int64)
        self.mark[at] = False
        return lo + np.flatnonzero(_similar(shared, len(asked), self.lengths[lo:hi]))

    def drop(self, positions: np.ndarray) -> None:
        stay = np.ones(len(self.order), dtype=bool)
        stay[positions] = False
        self.order, flat = self.order[stay], self.flat[np.repeat(stay, self.lengths)]
        self._lay(flat, self.lengths[stay])


def set_links(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Star links (member, first reached) of the components of similar sets; what is reached is no longer a target."""
    rest, left, right = Sets(sets), [], []
    while len(rest.order) > 1:
        centre = int(rest.order[0])
        rest.drop(np.zeros(1, np.int64))
        frontier = [centre]
        while frontier and len(rest.order):
            hit = rest.like(sets[frontier.pop()])
            if len(hit):
                found = rest.order[hit].tolist()
                frontier += found
                left += found
                right += [centre] * len(found)
                rest.drop(hit)
    return left, right


def _compare_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For one sorted partition of (t, key, node, shingles): its links, and the rows of its first and last group."""
    from pyspark import TaskContext

    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    t, key, node = (table.column(c).to_numpy() for c in ("t", "key", "node"))
    packed = table.column("shingles").combine_chunks()
    cuts = [*np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])]).tolist(), len(t)]
    a, b = [], []
    for start, end in zip(cuts, cuts[1:], strict=False):
        if end - start > 1:
            i, j = set_links([np.frombuffer(x.as_buffer(), dtype="<u8") for x in packed[start:end]])
            a += node[start:end][i].tolist()
            b += node[start:end][j].tolist()
    yield pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(len(a), k) for k in (pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
        names=["node", "b", "t", "key", "part", "shingles"],
    )
    for start, end in {(cuts[0], cuts[1]), (cuts[-2], cuts[-1])}:
        n = end - start
        columns = [pa.array(node[start:end], pa.int64()), pa.nulls(n, pa.int64()), pa.array(t[start:end], pa.int32()), pa.array(key[start:end], pa.int64())]
        columns += [pa.array(np.full(n, TaskContext.get().partitionId()), pa.int32()), packed[start:end].cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "b", "t", "key", "part", "shingles"])


def _packed_sets(rows: DataFrame, name: str) -> DataFrame:
    """Rows sorted by (key, part) as structs of at most about ``SET_PART`` bytes of one key and part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy() for c in ("key", "part")], axis=1)
            nodes, labels = (batch.column(c).to_numpy().astype("<i8") for c in ("node", "label"))
            packed = [x.as_py() for x in batch.column("shingles")]
            spans, start, held = [], 0, 0
            for k in range(len(own)):
                if k > start and ((own[k] != own[start]).any() or held + len(packed[k]) > SET_PART):
                    spans.append((start, k))
                    start, held = k, 0
                held += len(packed[k])
            if len(own):
                spans.append((start, len(own)))
            value = [
                {"nodes": nodes[s:e].tobytes(), "labels": labels[s:e].tobytes(), "sizes": np.array([len(x) // 8 for x in packed[s:e]], "<i8").tobytes(), "shingles": b"".join(packed[s:e])}
                for s, e in spans
            ]
            kind = pa.struct([(c, pa.binary()) for c in ("nodes", "labels", "sizes", "shingles")])
            keys = [pa.array([own[s, k] for s, _ in spans], pa.int64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(value, kind)], names=["key", "part", name])

    packed = f"key long, part long, {name} struct<nodes:binary,labels:binary,sizes:binary,shingles:binary>"
    return rows.select("key", F.col("part").cast("long").alias("part"), "node", "label", "shingles").mapInArrow(pack, packed)


def _cross_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between packed stragglers and other rows of their group, one for each other label a straggler meets."""

    def unpack(value):
        nodes, labels, sizes = (np.frombuffer(value[c], dtype="<i8") for c in ("nodes", "labels", "sizes"))
        return nodes, labels, np.split(np.frombuffer(value["shingles"], dtype="<u8"), np.cumsum(sizes)[:-1])

    for batch in batches:
        for asked, others in zip(batch.column(0), batch.column(1), strict=True):
            nodes, labels, sets = unpack(asked.as_py())
            to, met, rest = unpack(others.as_py())
            rest = Sets(rest)
            a, b = [], []
            for node, label, one in zip(nodes.tolist(), labels.tolist(), sets, strict=True):
                hit = rest.order[rest.like(one)]
                hit = hit[met[hit] != label]
                first = hit[np.unique(met[hit], return_index=True)[1]]
                a += [node] * len(first)
                b += to[first].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def exact_components(sets: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root) of the components of similar sets inside each group. ``sets``: (key: the group, node, shingles), stored.

    Groups are dealt over partitions like buckets, ``DEALS`` times by different
    hashes, so the parts of a large component are joined by the rows they have
    in common. What is outside a group's prevailing component is compared with
    all the rest of the group.
    """
    total = sets.agg(F.sum(F.length("shingles"))).first()[0] or 0
    n = max(sets.sparkSession.sparkContext.defaultParallelism, DEALS * total // SET_BYTES)
    rows = sets.select(F.explode(F.array(*map(F.lit, range(DEALS)))).alias("t"), "key", "node", "shingles")
    within = F.xxhash64("t", "node")
    dealt = rows.repartitionByRange(n, "t", "key", within).sortWithinPartitions("t", "key", within)
    compared = ws.write(dealt.mapInArrow(_compare_sets, "node long, b long, t int, key long, part int, shingles binary"), "set_compared")
    links = compared.filter("b IS NOT NULL").select(F.col("node").alias("a"), "b")
    edge = compared.filter("b IS NULL").drop("b")
    spanning = edge.groupBy("t", "key").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("key").distinct()
    # A group is settled if it is whole in one deal; the rest, fewer than partitions, go on with the rows of the first deal.
    spanning = F.broadcast(ws.write(spanning, "set_spanning_keys"))
    found = connected_components(links, ws, "set_first")
    labels = found.withColumnRenamed("root", "label")
    whole = rows.filter("t = 0").join(spanning, "key").join(labels, "node", "left")
    whole = ws.write(whole.select("key", "node", F.coalesce("label", "node").alias("label"), "shingles"), "set_spanning")
    main = whole.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("n"))
    unsettled = ws.write(main.filter("n > 1").select("key", "main"), "set_unsettled")
    if not unsettled.limit(1).count():
        return found
    opened = whole.join(F.broadcast(unsettled), "key")
    sides = []
    # Parts of SET_PART bytes; a group of a few hundred rows already goes to several tasks.
    parts = F.expr(f"1 + greatest(sum(length(shingles)) div {SET_PART}, least(count(1) div {PART_ROWS}, {FEW_PARTS}))").alias("_parts")
    for name, side in (("asked", opened.filter("label <> main")), ("others", opened)):
        size = ws.write(side.groupBy("key").agg(parts), f"set_{name}_parts")
        side = side.join(F.broadcast(size), "key").withColumn("part", F.expr("pmod(xxhash64(node), _parts)"))
        sides.append(_packed_sets(side.repartition("key", "part").sortWithinPartitions("key", "part"), name))
    # Each packed part of stragglers is sent to every part of its group, by group and part.
    asked = sides[0].drop("part").join(F.broadcast(size), "key").withColumn("part", F.explode(F.expr("sequence(0L, _parts - 1)")))
    pairs = asked.join(sides[1], ["key", "part"]).select("asked", "others")
    pairs = pairs.repartition(F.xxhash64("asked.nodes", "others.nodes"))
    return merged_components(found, pairs.mapInArrow(_cross_sets, "a long, b long"), ws, "set_all")


def shingle_sets(docs: DataFrame, groups: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(key, node, shingles: the sorted distinct hashes as bytes) of the documents in ``groups`` (node, root)."""
    side = F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups.hint("shuffle_hash")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    some = texts.join(side, "node").select(F.struct("root", "node").alias("_of"), "text")
    made = map_texts(some, "_of", "text", lambda: lambda text: (np.unique(shingle_hashes(text, width)).astype("<u8").tobytes(),), "shingles binary")
    return made.filter("length(shingles) > 0").select(F.col("_of.root").alias("key"), F.col("_of.node").alias("node"), "shingles")


def similar_components(docs: DataFrame, ws: Workspace, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of the documents that are near copies of another, links being exact similarity; the least id names them."""
    docs = docs.filter(F.col(id_col).isNotNull())
    found = ws.write(wide_fingerprints(docs, width, id_col, text_col), "wide")
    fields = [f"f{k}" for k in range(WIDE)]
    rows = found.select(F.posexplode("sketch").alias("t", "key"), F.col(id_col).cast("long").alias("node"), *fields)
    groups = ws.write(components_of(rows, found.count() * BANDS, WIDE, WIDE_RADIUS, ws), "candidates")
    roots = exact_components(ws.write(shingle_sets(docs, groups, width, id_col, text_col), "sets"), ws)
    return roots.select(F.col("node").alias(id_col), F.col("root").alias("component_id"))


def drop_near_copies(docs: DataFrame, ws: Workspace, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies, that with the smallest id; columns unchanged, rows with a null id stay."""
    groups = similar_components(docs, ws, width, id_col, text_col)
    gone = groups.filter(F.col(id_col) != F.col("component_id")).select(id_col)
    return without_ids(docs, gone, id_col, ws, "near_gone")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), Workspace(spark, "op1"), width=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
