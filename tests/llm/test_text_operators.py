import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from veilgrain.llm import bpe, decontaminate, langid, licenses, pii, secrets, toxicity, warc
from veilgrain.llm.common import is_held_out
from veilgrain.workspace import Workspace, read_table

DOCS = "doc_id long, text string, lang string, n_words string, ids string, score int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", 1) for i, t, lang in rows], DOCS)


# BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(bpe.default_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab '\n\tsrédl019!<|endoftext>漢🙂\x1c\x85", max_size=60)), max_size=5))
def test_bpe_equals_library(vocabulary, library, texts):
    ours = [i.tolist() for i in bpe.Encoder(vocabulary).encode(texts)]
    assert ours == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 5_000, "<|endoftext|>" * 3 + " x", "!" * 999, " \n " * 200, "xyzzy " * 3_000])
def test_bpe_odd_texts(vocabulary, library, text):
    assert bpe.Encoder(vocabulary).encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_query_round_trip(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, sf, "documents").collect()}
    for r in bpe.op4_bpe(spark, sf).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_frames(spark, vocabulary, library):
    docs = docs_of(spark, [(1, None, "en"), (2, "", "en"), (2, "", "en"), (None, "hi there", "en")])
    done = {(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()}
    assert done == {(1, (), ""), (2, (), ""), (None, tuple(library.encode("hi there").ids), "hi there")}
    assert bpe.encode(docs.limit(0), vocabulary).count() == 0


# Decontamination


def brute_hits(text, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    own = words(text)
    hit, found = set(), set()
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            for k in range(len(own) - len(part) + 1):
                if own[k : k + len(part)] == part:
                    hit.update(range(k, k + len(part)))
                    found.add(item)
    return len(own), len(hit), found


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    vocab = ["alpha", "Beta", "éa", "x1", "q"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 14])))) for k in range(25)] + [(None, "alpha"), (77, None), (3, "x1, Beta")]
    rows = [(1, None, "a"), (2, "", "a"), (3, "!!", "a")]
    rows += [(10 + k, rng.choice(["", "--"]) + rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(rng.randrange(60))), "a") for k in range(40)]
    rows.append(rows[5])
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 26, 3000):
        found = decontaminate.find_passages(docs_of(spark, rows), bench, max_automaton_bytes=limit).collect()
        got = sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in found)
        named = [(i, t) for i, t in items if i is not None]
        want = sorted((i, *brute_hits(t, named)[:2], tuple(sorted(brute_hits(t, named)[2]))) for i, t, _ in rows)
        assert got == want
    for most in (1 << 26, 3000):
        kept = decontaminate.drop_contaminated(docs_of(spark, rows), bench, max_automaton_bytes=most)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, t, _ in rows if not brute_hits(t, named)[1])
    for r in found:
        text = dict((i, t) for i, t, _ in rows)[r["doc_id"]]
        for p in r["passages"]:
            assert brute_hits(text[p["start"] : p["end"]], [(i, t) for i, t in named if i == p["item_id"]])[2] == {p["item_id"]}


def test_decontamination_of_nothing(spark):
    docs = docs_of(spark, [(1, "some words here", "a")])
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["n_hit"]) for r in decontaminate.find_passages(docs, none).collect()] == [(3, 0)]
    assert decontaminate.find_passages(docs.limit(0), none).count() == 0


# Language


def test_language_accuracy_and_cases(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    lang = {r["doc_id"]: r["lang"] for r in read_table(spark, big, "documents").select("doc_id", "lang").collect()}
    rows = langid.op10_language_id(spark, big).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if is_held_out(i)}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    docs = read_table(spark, big, "documents")
    learnt = langid.learn(docs)
    odd = docs_of(spark, [(1, None, "en"), (2, "", None), (3, "123 !!", "en"), (3, "123 !!", "en"), (None, "der die und nicht eine " * 5000, None)])
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["rejected"]) for r in langid.identify(odd, learnt).collect())
    assert got == [(0, "de", False), (1, "und", True), (2, "und", True), (3, "und", True), (3, "und", True)]
    assert all(0 <= r["score"] <= 1 for r in rows)
    nothing = langid.learn(odd.limit(0))
    assert nothing.dictionaries == {}
    assert langid.identify(odd, nothing).filter("lang_pred <> 'und'").count() == 0
    assert langid.drop_rejected(odd, learnt).columns == odd.columns


# Secrets


def brute_base(text):
    text = text or ""
    assign = re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
    out = [("assign", m.start(), m.end()) for m in assign if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWD", "ſecret", "toKen", "api_key", "apikey", '"', "'", " ", ":", "=", "abc123", "x" * 6, "AKIA", "Z9" * 8, "0af" * 8, "é", "\n", "toKen"]), max_size=14).map("".join))
def test_base_spans(text):
    assert [s[:3] for s in secrets.base_spans(text)] == brute_base(text)


def test_secret_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, sf, "documents").collect()}
    for r in secrets.op2_secrets(spark, sf).collect():
        base = brute_base(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for k, _, _ in base) for n in ("assign", "access", "hex"))
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_formats_find_what_base_patterns_miss(spark):
    rng = random.Random(0)

    def word(alphabet, n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    rows = [(k, f"token = {word('0123456789abcdef', 40 if k % 2 else 18)} and {word('0123456789', 16)}", "en") for k in range(120)]
    rows += [(500, f"bare {word('0123456789abcdef', 18)} x", "en"), (501, "plain prose without any", "en"), (502, None, "en"), (503, "", "en")]
    rows += [(600 + k, f"AKIA{word('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 16)}", "en") for k in range(60)]
    found = {r["doc_id"]: r for r in secrets.scan(docs_of(spark, rows), Workspace(spark, "t")).collect()}
    assert [a["kind"][:5] for a in found[500]["added"]] == ["like_"]
    assert all(not found[k]["added"] for k in (3, 501, 502, 503)) and len(found) == len(rows)
    assert secrets.scan(docs_of(spark, []).limit(0), Workspace(spark, "t")).count() == 0


def test_merged_automaton_is_small():
    rng = random.Random(0)
    made = secrets.Format(["".join(rng.choice("01") for _ in range(20)) for _ in range(300)])
    assert made.log_likelihood("01" * 10) > made.log_likelihood("01" * 5) and made.log_likelihood("01" * 10) > made.log_likelihood("ab" * 10)


# WARC


def test_warc_round_trip(spark):
    rows = [(1, "u", "<p>a"), (2, "u2", "<p>a"), (3, None, None), (4, "x", ""), (None, "y", "<p>a"), (7, "z\nq", "é\r\n\r\nx"), (2, "u2", "<p>a"), (9, "q", "s" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    ws = Workspace(spark, "t")
    index = warc.write_archives(pages, f"{ws.path}/w", ws)
    found = warc.read_records(index, f"{ws.path}/w").collect()
    keep = {"<p>a": 2, "": 4}
    want = []
    for i, _, html in rows:
        p, k = (html or ""), keep.get(html or "", i)
        want.append((i or -1, "response" if i == k else "revisit", None if i == k else k, warc.payload_digest(p.encode()), len(p.encode()), p.encode() if i == k else None))
    got = [(r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"], None if r["payload"] is None else bytes(r["payload"])) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.read_records(index.filter("page_id = 7"), f"{ws.path}/w").first()["url"] == "z%0Aq"
    lone = warc.write_archives(pages, f"{ws.path}/big", Workspace(spark, "t2"), min_bytes=5)
    assert lone.filter("record_type = 'revisit'").count() == 0
    assert warc.write_archives(pages.limit(0), f"{ws.path}/none", Workspace(spark, "t3")).count() == 0


def test_reads_are_coalesced():
    def reads(ranges, **limits):
        return [(f, s, e, [o for o, _ in held]) for f, s, e, held in warc.coalesced(iter(ranges), **limits)]

    assert reads([("a", 0, 10), ("a", 10, 5), ("a", 200_000, 5), ("b", 200_005, 5)], gap=100) == [("a", 0, 15, [0, 10]), ("a", 200_000, 200_005, [200_000]), ("b", 200_005, 200_010, [200_005])]
    assert reads([("a", 0, 10), ("a", 10, 10)], most=15) == [("a", 0, 10, [0]), ("a", 10, 20, [10])]
    assert reads([]) == [] and reads([("a", 0, 10), ("a", 0, 10)]) == [("a", 0, 10, [0, 0])]


def test_stores_are_named_as_pyarrow_does(tmp_path):
    store, path = warc.open_uri(f"file://{tmp_path}")
    assert store.type_name == "local" and path == str(tmp_path)
    with pytest.raises(Exception, match="nosuch"):
        warc.open_uri("nosuch://bucket/x")
    assert warc.SCHEMES["s3a"] == "s3"


def test_warc_extra_columns_and_another_store(spark):
    rows = [(1, "u", "<p>a", "f", 1), (2, "u", "<p>a", "f", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string, keep long").withColumn("sha", F.lit("x"))

    def opened(folder):
        from pyarrow import fs

        return fs.SubTreeFileSystem("/", fs.LocalFileSystem()), folder.removeprefix("file://")

    ws = Workspace(spark, "t")
    index = warc.write_archives(pages, f"{ws.path}/w", ws, open_store=opened)
    got = warc.read_records(index, f"{ws.path}/w", open_store=opened).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in got) == [(1, "revisit"), (2, "response")]


# Toxicity


def test_toxicity_separates(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    rows, labels = [], []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            text[rng.randrange(60)] = rng.choice(["zorkface", "ZORKFACE,", "glumphead"])
        rows.append((i, " ".join(text), "en"))
        if i % 10 != 9:
            labels.append((i, int(bad)))
    rows += [(5000, None, "en"), (5001, "", "en"), (None, "zorkface", None), (5002, "zorkface " * 60_000, "en")]
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    docs = docs_of(spark, rows)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, marks)).collect()}
    held = [i for i in range(1200) if is_held_out(i)]
    assert sum((found[i] >= 0.3) == (i % 6 == 0) for i in held) / len(held) > 0.97
    assert found[5000] == found[5001] < 0.3 <= found[5002] and all(0 <= s <= 1 for s in found.values())
    one_class = toxicity.train(docs, marks.filter("toxic = 0"))
    assert toxicity.score(docs, one_class).select("score").distinct().count() == 1
    assert toxicity.score(docs.limit(0), one_class).count() == 0


# PII


def test_surrogates(spark):
    rows = [
        (1, "Mail Bob.Smith9@corp.co.uk or BOB.SMITH9@CORP.CO.UK, call +1 (974) 555-3436 or +1 974-555-3436 now", "en"),
        (2, None, "en"), (3, "", "en"),
        (4, "card 4111111111111111 and 4111 1111 1111 1111; bad 9807915762804490", "en"),
        (5, "ip 10.1.2.3. v1.2.3.4.5 ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00", "en"),
        (6, "Mr. John Smith met Mrs Jane SMITH and г-жа Иванова. Dr Smith", "en"),
        (None, "x@y.de", "en"), (1, "x@y.de", "en"), (8, "hash 0641917ea4e9feb9cda83477b57ac2654884f485", "en"),
    ]
    found = pii.pseudonymise(docs_of(spark, rows), "key", Workspace(spark, "t")).collect()
    by = {r["doc_id"]: r for r in found if r["doc_id"] != 1}
    one = next(r for r in found if r["doc_id"] == 1 and r["text"].startswith("Mail"))
    assert by[2]["text"] is None and by[3]["text"] == "" and by[8]["text"] == rows[-1][1] and len(found) == len(rows)
    mails = [e["replacement"] for e in one["entities"] if e["type"] == "email"]
    phones = [re.sub(r"\D", "", e["replacement"]) for e in one["entities"] if e["type"] == "phone"]
    assert mails[0].upper() == mails[1] and phones[0] == phones[1] and "+1 (" in one["text"]
    cards = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", by[4]["text"])
    assert cards[0] == cards[1].replace(" ", "")
    double = [int(c) * (2 - k % 2) for k, c in enumerate(cards[0])]
    assert sum(d - 9 * (d > 9) for d in double) % 10 == 0
    assert "v1.2.3.4.5" in by[5]["text"] and "123-45" not in by[5]["text"] and "3704" not in by[5]["text"]
    names = by[6]["text"]
    surname = re.match(r"Mr\. \S+ (\w+) met", names)[1]
    assert surname.upper() in names and names.endswith(f"Dr {surname}") and re.search(r"г-жа [А-Я][а-я]+", names) and "Smith" not in names
    for text, r in ((rows[0][1], one), (rows[4][1], by[5]), (rows[5][1], by[6])):
        rebuilt, at = "", 0
        for e in r["entities"]:
            rebuilt += text[at : e["start"]] + e["replacement"]
            at = e["end"]
        assert rebuilt + text[at:] == r["text"]
    assert pii.pseudonymise(docs_of(spark, []).limit(0), "key", Workspace(spark, "t")).count() == 0


def test_surrogates_are_distinct_even_when_room_is_tight(spark):
    values = spark.createDataFrame([("email", f"{c}@a.de", None) for c in "abcdefghijklmnopqrst"] + [("card", f"{k:013d}", None) for k in range(50)], "type string, canon string, form string")
    drawn = pii.draw_surrogates(values, "key", Workspace(spark, "t")).collect()
    assert len({(r["type"], r["surrogate"]) for r in drawn}) == len(drawn) == 70
    assert not {(r["type"], r["surrogate"]) for r in drawn} & {(r["type"], r["canon"]) for r in drawn}


# Licences


def test_licence_files_are_full_texts(spark):
    """A full licence text passes its licence on; prose with a licence line and SPDX headers hold for their file alone."""
    full = licenses.FULL_TEXTS
    rows = [(f"/{name}/LICENSE", f"Copyright (c) 2021 Jane Doe\n\n{text}") for name, text in full.items()] + [(f"/{name}/src/x", "hello") for name in full]
    rows += [("/p/note", "The harbour was quiet all day. Licensed under the MIT license."), ("/p/x", "hello")]
    rows += [("/q/a", "# SPDX-License-Identifier: GPL-2.0-or-later\ncode"), ("/q/x", "hello"), ("/q/b", "SPDX-License-Identifier: Unheard-of")]
    found = {r["path"]: (r["license"], r["origin"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string"), Workspace(spark, "t")).collect()}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "MIT"} <= set(full)
    for name in full:
        assert found[f"/{name}/LICENSE"] == (name, "own") and found[f"/{name}/src/x"] == (name, "inherited")
    assert found["/p/note"] == ("MIT", "own") and found["/p/x"] == (None, None)
    assert found["/q/a"] == ("GPL-2.0", "own") and found["/q/x"] == (None, None) and found["/q/b"] == (None, None)


def test_licences(spark):
    rows = [
        ("/a/LICENSE", "Released under the MIT License."), ("/a/b/x.txt", "nothing here"), ("/a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("/a/b/c/d/y", "hello"), ("/z/q", "hello"), (None, "hello"), ("/r", None), ("/r", None), ("/s", ""),
        ("/a/b/c/d/own", "foo bar.\nThis work is licensed under the GNU General Public License, version 2. Then " + "prose and more " * 500),
    ]
    files = spark.createDataFrame(rows, "path string, text string")
    found = sorted(((r["path"] or "", r["license"], r["origin"]) for r in licenses.scan_licenses(files, Workspace(spark, "t")).collect()), key=str)
    assert found == sorted([
        ("/a/LICENSE", "MIT", "own"), ("/a/b/x.txt", "MIT", "inherited"), ("/a/b/c/LICENSE", "Apache-2.0", "own"), ("/a/b/c/d/y", "Apache-2.0", "inherited"),
        ("/z/q", None, None), ("", None, None), ("/r", None, None), ("/r", None, None), ("/s", None, None), ("/a/b/c/d/own", "GPL-2.0", "own"),
    ], key=str)
    assert licenses.scan_licenses(files.limit(0), Workspace(spark, "t")).count() == 0
