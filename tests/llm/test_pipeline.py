import hashlib
import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_exact_and_near import CLASHES, brute_components
from tests.llm.test_text_operators import brute_hits
from veilgrain.llm import bpe, langid
from veilgrain.workspace import read_table


def test_pipeline_against_brute_force(spark, sf):
    """Every stage over plain lists: its own compressors, equal strings, all pairs of shingle sets, all windows, the library's ids."""
    docs = read_table(spark, sf, "documents")
    learned = langid.learn(docs)
    judge = langid.Compressors(learned.dictionaries, learned.min_margin)
    told = [(r["doc_id"], r["text"]) for r in docs.collect() if not judge.predict(r["text"])[3]]
    last = {}
    for i, text in told:
        last[text] = max(last.get(text, -1), i)
    unique = [(i, text) for i, text in told if last[text] == i]
    near = brute_components(unique)
    apart = [(i, text) for i, text in unique if near.get(i, i) == i]
    items = [(r["item_id"], r["text"]) for r in read_table(spark, sf, "benchmark").collect()]
    clean = {i: text for i, text in apart if not brute_hits(text, items)[1]}
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert found.keys() == clean.keys() and 0 < len(clean) < len(apart) < len(unique) < len(told)
    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    for i, r in found.items():
        ids = library.encode(clean[i], add_special_tokens=False).ids
        assert r["text"] == clean[i] and list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_are_the_five(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and columns whose names the operators use."""
    rng = random.Random(3)
    words = [f"word{''.join(rng.choice('abcdefgh') for _ in range(5))}" for _ in range(2000)]
    body = " ".join(rng.choice(words) for _ in range(200))
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "!!! 123"), (5, body), (5, body), (6, body), (7, body + " more"), (None, body), (None, None), (None, "short"), (None, "short")]
    texts += [(8, " ".join(rng.choice(words) for _ in range(60_000))), (9, "x" * 300_000), (10, "short one"), (11, "short two")]
    texts += [(100 + k, " ".join(rng.choice(words) for _ in range(80))) for k in range(40)]
    names = [c for c in CLASHES if c not in ("doc_id", "text")] + ["decoded", "of", "found", "n_tokens", "decoded_sha256"]
    rows = [(i, t, "en" if (i or 0) % 3 else None, *((None if (i or 0) % 2 else "kept"),) * len(names)) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in names))




@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_documents(spark, sf, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    done = stage(spark, odd, sf)
    rows, kept = [(r["doc_id"], r["text"]) for r in odd.collect()], [(r["doc_id"], r["text"]) for r in done.collect()]
    if name == "bpe_encoding":
        assert done.columns == [c for c in odd.columns if c not in ("ids", "n_tokens", "decoded_sha256")] + ["ids", "n_tokens", "decoded_sha256"]
        assert sorted(kept, key=repr) == sorted(rows, key=repr)
        assert all(r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in done.collect())
    else:
        assert done.columns == odd.columns
    count = {key: kept.count(key) for key in set(rows)}
    if name == "language_id":
        assert all(not n for (_, text), n in count.items() if not text or not any(map(str.isalpha, text)))
        assert all(count[r] == rows.count(r) for r in rows if (r[0] or 0) >= 100 or r[0] == 8)
    if name == "exact_dedup":
        texts = [t or "" for _, t in kept]
        assert sorted(set(texts)) == sorted({t or "" for _, t in rows}) and len(texts) == len(set(texts))
        largest = {t or "": max((i for i, u in rows if (u or "") == (t or "") and i is not None), default=None) for _, t in rows}
        assert all(i == largest[t or ""] for i, t in kept)
    if name == "simhash_near_dedup":
        body = next(t for i, t in rows if i == 5)
        gone = {6, 7}  # near copies of 5; rows without an id stay, and so do repeats of the one that stays
        assert sorted(kept, key=repr) == sorted((r for r in rows if r[0] not in gone), key=repr) and (5, body) in kept
    if name == "benchmark_decontamination":
        assert sorted(kept, key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, sf, odd, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, odd.limit(0), sf).count() == 0
