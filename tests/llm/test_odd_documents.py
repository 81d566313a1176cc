"""Every operator on nulls, empty and very long texts, repeated rows, empty tables, and columns named like its own."""

import pytest

from veilgrain.llm import bpe, decontaminate, exact_dedup, langid, licenses, pii, secrets, simhash, toxicity, warc
from veilgrain.workspace import Workspace

#: Names that the operators use inside or return.
NAMES = (
    "a above added at b base batch best by_row canon component_id decoded digest dir end entities entity f f0 file file_no found fp gap group_size held_out html "
    "i ids item_ids j keep keep_id kept key kind l label lang_pred lead least length license margin mentions n n_hit n_tokens n_words node of origin own_id page_id "
    "passages path pattern payload present r refers_to rejected replacement root row_no s score seen sha shingles size sketch spdx start surface surrogate t type use "
    "value whole y _gone _mixed _digest _dir _of _parts"
).split()
LONG = "harbour lights and quiet water " * 40_000
TEXTS = [(1, None), (2, ""), (3, " \t"), (4, LONG), (5, "z" * 400_000), (6, "a short text"), (6, "a short text"), (7, "a short text"), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", *(["x"] * len(NAMES))) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in NAMES))


def labels(spark):
    return spark.createDataFrame([(6, 1), (4, 0), (None, 1), (7, None)], "doc_id long, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "lights and quiet water harbour lights and quiet water harbour lights"), (2, None), (None, "a short text"), (3, ""), (4, "a short")], "item_id long, text string")


OPERATORS = {
    "simhash": lambda spark, docs, ws: simhash.near_duplicates(docs, ws),
    "secrets": lambda spark, docs, ws: secrets.scan(docs, ws),
    "bpe": lambda spark, docs, ws: bpe.decode(bpe.encode(docs, bpe.Vocabulary.load(bpe.default_path())), bpe.Vocabulary.load(bpe.default_path())),
    "pii": lambda spark, docs, ws: pii.pseudonymise(docs, "key", ws),
    "toxicity": lambda spark, docs, ws: toxicity.score(docs, toxicity.train(docs, labels(spark))),
    "decontaminate": lambda spark, docs, ws: decontaminate.find_passages(docs, benchmark(spark)),
    "exact_dedup": lambda spark, docs, ws: exact_dedup.deduplicate(docs, None, ws),
    "langid": lambda spark, docs, ws: langid.identify(docs, langid.learn(docs)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(spark, docs, name):
    found = OPERATORS[name](spark, docs, Workspace(spark, "odd"))
    assert len(set(found.columns)) == len(found.columns)
    assert sorted((r["doc_id"] or 0 for r in found.collect())) == sorted(i or 0 for i, _ in TEXTS)
    repeats = [r for r in found.collect() if r["doc_id"] == 6]
    if name != "exact_dedup":  # one of two equal rows stays
        assert repeats[0] == repeats[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows_for_no_rows(spark, docs, name):
    assert OPERATORS[name](spark, docs.limit(0), Workspace(spark, "odd")).count() == 0


def test_values_that_are_defined(spark, docs):
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["item_ids"]) for r in decontaminate.find_passages(docs, benchmark(spark)).collect()}
    assert got[6, 3] == (2, [4]) and got[4, 200_000][1] == [1] and got[1, 0] == got[2, 0] == got[3, 0] == (0, []) and got[5, 1] == (0, [])
    tokens = {(r["doc_id"], len(r["ids"]) > 0) for r in bpe.encode(docs, bpe.Vocabulary.load(bpe.default_path())).collect()}
    assert tokens == {(1, False), (2, False), (3, True), (4, True), (5, True), (6, True), (7, True), (None, True), (None, False)}
    kinds = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.learn(docs)).filter("doc_id IS NOT NULL").collect()}
    assert kinds == {1: "und", 2: "und", 3: "und", 4: "en", 5: "en", 6: "en", 7: "en"}


def test_pages_and_files(spark, docs):
    ws = Workspace(spark, "odd")
    pages = docs.drop("page_id", "html").withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("key", "url")
    index = warc.write_archives(pages, f"{ws.path}/w", ws)
    read = warc.read_records(index, f"{ws.path}/w").collect()
    assert len(read) == len(TEXTS) and max(r["payload_bytes"] for r in read) == len(LONG)
    empty = warc.write_archives(pages.limit(0), f"{ws.path}/e", Workspace(spark, "odd"))
    assert warc.read_records(empty, f"{ws.path}/e").count() == 0
    scanned = licenses.scan_licenses(docs, Workspace(spark, "odd"), keep=tuple(n for n in NAMES if n != "path"))
    assert scanned.count() == len(TEXTS) and len(set(scanned.columns)) == len(scanned.columns)
    assert licenses.scan_licenses(docs.limit(0), Workspace(spark, "odd")).count() == 0
