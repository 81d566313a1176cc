import hashlib
import random

import numpy as np
import pytest

from veilgrain.llm import components, exact_dedup, simhash
from veilgrain.workspace import Workspace, read_table

#: Every name that the operators use inside.
CLASHES = (
    "digest row_no best group_size own_id keep_id keep_row kept seen batch doc _mixed _gone _named _digest n at fp node root key t f0 f1 least label "
    "component_id sketch shingles a b part main _bytes _of ids n_words score j i y l"
).split()
DOCS = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, *CLASHES) for i, t in rows], DOCS)


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_exact_groups(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (2, "a"), (None, "b"), (None, "c")]
    found = exact_dedup.deduplicate(docs_of(spark, rows), None, Workspace(spark, "t")).collect()
    by = sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in found)
    assert by == sorted([(1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 2, True), (-1, 5, 2, False), (-1, -1, 1, True)])


def plan_of(frame):
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_index_is_persistent(spark):
    ws = Workspace(spark, "t")
    index = exact_dedup.DigestIndex(spark, ws.table("idx"), 4)
    first = exact_dedup.deduplicate(docs_of(spark, [(1, "a"), (2, "b")]), index, ws, batch="one")
    assert sorted((r["doc_id"], r["keep_id"], r["kept"], r["seen"]) for r in first.collect()) == [(1, 1, True, False), (2, 2, True, False)]
    docs = docs_of(spark, [(7, "a"), (8, "c"), (9, "c")])
    want = [(7, 1, False, True), (8, 9, False, False), (9, 9, True, False)]
    for _ in range(2):  # a batch that is run again gives the same and adds nothing
        second = exact_dedup.deduplicate(docs, index, Workspace(spark, "t2"), batch="two").collect()
        assert sorted((r["doc_id"], r["keep_id"], r["kept"], r["seen"]) for r in second) == want
        assert index.read().count() == 3
    assert exact_dedup.drop_copies(docs, Workspace(spark, "t3"), index=index).count() == 0  # all seen by now
    found = {bytes(r["digest"]): (r["keep_id"], r["batch"]) for r in index.read().collect()}
    assert found == {hashlib.sha256(t.encode()).digest(): v for t, v in {"a": (1, "one"), "b": (2, "one"), "c": (9, "two")}.items()}


def test_plan_is_a_sort_merge_anti_join_over_buckets(spark):
    """Even where a side would be small enough to broadcast, and without a shuffle of the index."""
    ws = Workspace(spark, "t")
    index = exact_dedup.DigestIndex(spark, ws.table("idx"), 4)
    exact_dedup.deduplicate(docs_of(spark, [(k, f"text {k}") for k in range(50)]), index, ws)
    groups = spark.createDataFrame([(b"x", 1)], "digest binary, keep_id long")
    missing = index.missing(groups)
    plan = plan_of(missing)
    assert "SortMergeJoin LeftAnti" in plan and "Broadcast" not in plan
    assert "Bucketed: true" in plan and "SelectedBucketsCount: 4 out of 4" in plan
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 1 and missing.count() == 1


def test_query_second_batch(spark, sf):
    """The query's documents after a first batch of half of them: only texts of the other half are new."""
    docs = read_table(spark, sf, "documents")
    ws = Workspace(spark, "t")
    index = exact_dedup.DigestIndex(spark, ws.table("idx"))
    exact_dedup.deduplicate(docs.filter("doc_id % 2 = 0"), index, ws)
    rows = docs.collect()
    old = {}
    for r in rows:
        if r["doc_id"] % 2 == 0:
            old[r["text"]] = max(old.get(r["text"], -1), r["doc_id"])
    last = {}
    for r in rows:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    for r in exact_dedup.deduplicate(docs, index, Workspace(spark, "t2")).collect():
        text = next(x["text"] for x in rows if x["doc_id"] == r["doc_id"])
        assert (r["seen"], r["keep_id"]) == ((True, old[text]) if text in old else (False, last[text]))
        assert r["kept"] == (text not in old and last[text] == r["doc_id"])


def test_drop_copies_keeps_columns_and_one_of_each(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, "z"), (None, "z"), (5, "q")]
    docs = docs_of(spark, rows)
    kept = exact_dedup.drop_copies(docs, Workspace(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, "z"), (2, "a"), (4, ""), (5, "q")]


def test_empty_tables(spark):
    none = docs_of(spark, []).limit(0)
    assert exact_dedup.drop_copies(none, Workspace(spark, "t")).count() == 0
    assert simhash.near_duplicates(none, Workspace(spark, "t")).count() == 0
    assert simhash.drop_near_copies(none, Workspace(spark, "t")).count() == 0


def test_op8_matches_hashlib(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, sf, "documents").collect()}
    last = {}
    for i, t in texts.items():
        last[t] = max(last.get(t, i), i)
    for r in exact_dedup.op8_exact_dedup(spark, sf).collect():
        t = texts[r["doc_id"]]
        assert (r["keep_id"], r["kept"]) == (last[t], last[t] == r["doc_id"])
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def brute_fingerprint(text, width):
    import re

    import xxhash

    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "A", "a b", "A b C", "x y z w x y z w", "é b c\x0bd\x1cq", "a\x85b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 3) == brute_fingerprint(text, 3)


def clusters(n, centres, flips, words, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, (centres, words), dtype=np.uint64)
    out = base[rng.integers(0, centres, n)].copy()
    for i in range(n):
        for _ in range(rng.integers(0, flips)):
            out[i, rng.integers(0, words)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    return out


@pytest.mark.parametrize(("words", "radius", "flips"), [(1, 3, 5), (1, 0, 2), (1, 6, 9), (4, 48, 40)])
@pytest.mark.parametrize("centres", [1, 4, 300])
def test_bit_sliced_search(words, radius, flips, centres):
    fps = clusters(400, centres, flips, words)
    close = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2) <= radius
    pairs = [(a, b) for a, b in zip(*np.nonzero(close)) if a < b]
    assert (simhash.near(simhash.planes_of(fps), fps[:20], 400, radius) == close[:20]).all()
    left, right = simhash.search_links(fps, radius)
    assert union_find(400, pairs) == union_find(400, zip(left.tolist(), right.tolist()))
    bucket = np.sort(np.random.default_rng(2).integers(0, 90, 400))
    left, right = simhash.small_links(bucket, fps, radius)
    assert {(a, b) for a, b in pairs if bucket[a] == bucket[b]} == set(zip(left.tolist(), right.tolist()))


def test_op1_against_brute_force(spark, monkeypatch):
    """Tiny partitions and buckets, so that buckets span partitions and are finished across them."""
    monkeypatch.setattr(simhash, "ROWS_PER_PARTITION", 40)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(4)]
    rows = [(1000, None), (1001, ""), (1002, "a b c")]
    for i in range(150):
        text = list(base[i % 4])
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(2000 + k, rows[5][1]) for k in range(3)]
    found = simhash.near_duplicates(docs_of(spark, rows), Workspace(spark, "t"), width=3).collect()
    fps = np.array([brute_fingerprint(t, 3) for _, t in rows], dtype=np.uint64)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if np.bitwise_count(fps[a] ^ fps[b]) <= 3]
    roots = union_find(len(rows), pairs)
    least = {}
    for root, (i, _) in zip(roots, rows):
        least[root] = min(least.get(root, i), i)
    assert len(pairs) > 100
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: least[root] for root, (i, _) in zip(roots, rows)}


def test_spanning_buckets_are_finished(spark):
    """One bucket of two tight clusters dealt over many partitions: exactly the brute-force components."""
    fps = clusters(600, 2, 6, 1, seed=5)
    rows = [(0, 7, k, int(f[0]) - (1 << 64) if int(f[0]) >> 63 else int(f[0])) for k, f in enumerate(fps)]
    table = spark.createDataFrame(rows, "t int, key long, node long, f0 long")
    old = simhash.ROWS_PER_PARTITION
    simhash.ROWS_PER_PARTITION = 30
    try:
        found = {r["node"]: r["root"] for r in simhash.components_of(table, 600, 1, 3, Workspace(spark, "t")).collect()}
    finally:
        simhash.ROWS_PER_PARTITION = old
    close = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2) <= 3
    roots = union_find(600, [(a, b) for a, b in zip(*np.nonzero(close)) if a < b])
    assert [found.get(k, k) for k in range(600)] == roots


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(9)
    words = [f"word{k}" for k in range(3000)]
    rows, expected = [], set()
    for i in range(40):
        text = [rng.choice(words) for _ in range(200)]
        rows.append((i, " ".join(text)))
        expected.add(i)
        if i % 4 == 0:  # two replaced words of 200: similarity about 0.9
            for k in rng.sample(range(200), 2):
                text[k] = rng.choice(words)
            rows.append((100 + i, " ".join(text)))
    rows += [(None, "no id"), (900, None), (901, "short"), (902, "short one")]
    docs = docs_of(spark, rows)
    kept = simhash.drop_near_copies(docs, Workspace(spark, "t"))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == expected | {None, 900, 901, 902}


def brute_components(rows, width=5):
    """Least id of the component of each document under exact shingle similarity of 0.8, components of one left out."""
    sets = []
    for _, text in rows:
        words = text.lower().split()
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    roots = union_find(len(rows), pairs)
    least, size = {}, {}
    for root, (i, _) in zip(roots, rows):
        least[root], size[root] = min(least.get(root, i), i), size.get(root, 0) + 1
    return {i: least[root] for root, (i, _) in zip(roots, rows) if size[root] > 1}


@pytest.mark.parametrize("per_partition", [16 << 20, 4000])
def test_near_copies_are_those_of_similarity_four_fifths(spark, monkeypatch, per_partition):
    """Copies with few to many replaced words, similarity 0.5 to 1: exactly the brute-force components, also in tiny partitions."""
    monkeypatch.setattr(simhash, "SET_BYTES", per_partition)
    monkeypatch.setattr(simhash, "SET_PART", per_partition // 4)
    rng = random.Random(12)
    words = [f"word{k}" for k in range(3000)]
    rows = []
    for i in range(30):
        text = [rng.choice(words) for _ in range(150)]
        rows.append((i, " ".join(text)))
        for copy in range(30 if i == 0 else 3):
            other = list(text)
            for k in rng.sample(range(150), rng.randrange(1, 9)):
                other[k] = rng.choice(words)
            rows.append((100 * (i + 1) + copy, " ".join(other)))
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs_of(spark, rows), Workspace(spark, "t")).collect()}
    expected = brute_components(rows)
    assert 20 < len(expected) < len(rows)
    assert found == expected


def test_repeated_lines_count_once(spark):
    """A line repeated 1 or 40 times hardly changes the set of shingles; a shared repeated line makes no near copies."""
    rng = random.Random(21)
    words = [f"word{k}" for k in range(3000)]
    rows = []
    for i in range(12):
        text, line = (" ".join(rng.choice(words) for _ in range(n)) for n in (200, 10))
        rows += [(10 * i + k, text + (" " + line) * times) for k, times in enumerate((2, 20, 40))]
    line = " ".join(rng.choice(words) for _ in range(10))
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(60)) + (" " + line) * 40) for i in range(30)]
    for _, text in rows[::3][:12]:
        wide = simhash.wide_fingerprint(text, 5)
        assert wide == simhash.wide_fingerprint(text + " " + " ".join(text.split()[-20:]), 5)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs_of(spark, rows), Workspace(spark, "t")).collect()}
    assert found == brute_components(rows) == {10 * i + k: 10 * i for i in range(12) for k in range(3)}


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    roots = union_find(600, edges)
    assert all(found.get(k, k) == roots[k] for k in range(600))


def test_recall_at_similarity_four_fifths_on_whole_documents(spark, sf):
    """Every document of the larger small table: the components are those of all pairs at 0.8 or more."""
    rows = [(r["doc_id"], r["text"]) for r in read_table(spark, sf.replace("sf0.001", "sf0.01"), "documents").select("doc_id", "text").collect()]
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for _, t in rows]
    held = {}
    for k, own in enumerate(sets):
        for h in own.tolist():
            held.setdefault(h, []).append(k)
    shared = {}
    for docs in held.values():
        for a in docs:
            for b in docs:
                if a < b:
                    shared[a, b] = shared.get((a, b), 0) + 1
    pairs = [(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    roots, least, size = union_find(len(rows), pairs), {}, {}
    for root, (i, _) in zip(roots, rows):
        least[root], size[root] = min(least.get(root, i), i), size.get(root, 0) + 1
    expected = {i: least[root] for root, (i, _) in zip(roots, rows) if size[root] > 1}
    docs = docs_of(spark, rows)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs, Workspace(spark, "t")).collect()}
    assert len(pairs) > 20 and found == expected


def test_pairs_of_min_hashes_find_similar_sets():
    """Of sets at similarity 0.8 all but a few in ten thousand share a pair; of those at a tenth, few do."""
    rng = np.random.default_rng(4)

    def met(shared, own, times):
        hits = 0
        for _ in range(times):
            all_ = rng.integers(0, 2**63, shared + 2 * own, dtype=np.uint64)
            a, b = np.concatenate([all_[:shared], all_[shared : shared + own]]), np.concatenate([all_[:shared], all_[shared + own :]])
            bands = [[simhash.mixed(x, 100 + k).view(np.uint32).reshape(-1, 2).min(axis=0) for k in range(simhash.BANDS)] for x in (a, b)]
            hits += any((x == y).all() for x, y in zip(*bands))
        return hits / times

    assert met(160, 20, 1000) > 0.995 and met(20, 90, 1000) < 0.2


def test_components_are_merged(spark):
    """New links between components, within one, to new nodes, and between new nodes."""
    rng = random.Random(7)
    first = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    more = [(rng.randrange(300), rng.randrange(300)) for _ in range(60)]
    schema = "a long, b long"
    ws = Workspace(spark, "t")
    found = components.connected_components(spark.createDataFrame(first, schema), ws, "x")
    merged = {r["node"]: r["root"] for r in components.merged_components(found, spark.createDataFrame(more, schema), ws, "y").collect()}
    roots = union_find(300, first + more)
    assert {k: r for k, r in enumerate(roots) if r != k or k in merged} == merged
    assert components.merged_components(found, spark.createDataFrame([], schema), ws, "z").count() == found.count()
