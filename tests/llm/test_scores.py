"""Licence cosines and toxicity scores against plain versions, and the query of fingerprints against its definition."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from veilgrain.llm import licenses, simhash, toxicity
from veilgrain.workspace import Workspace, read_table

# Licences


def plain_licenses(texts):
    """(own licence, score) of every text: all cosines with dense loops over every term."""
    templates = [(n, t) for n in sorted(licenses.TEMPLATES) for t in licenses.TEMPLATES[n]]
    full = [(n, licenses.FULL_TEXTS[n]) for n in sorted(licenses.FULL_TEXTS)]

    def terms(text):
        return Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower()))

    headers = set().union(*(terms(t) for _, t in templates))
    known = headers.union(*(terms(t) for _, t in full))
    holds = Counter(t for text in texts for t in set(terms(text or "")))

    def idf(t):
        return 1 + math.log((len(texts) + 1) / ((holds[t] if t in known else 0) + 1))

    def cosine(a, b, inside):
        """Terms outside the templates count in a length as the rarest."""
        x = {t: (1 + math.log(n)) * (idf(t) if t in inside else 1 + math.log(len(texts) + 1)) for t, n in a.items()}
        y = {t: (1 + math.log(n)) * idf(t) for t, n in b.items()}
        dot = sum(w * y[t] for t, w in x.items() if t in y and t in inside)
        return dot / math.sqrt(sum(w * w for w in x.values())) / math.sqrt(sum(w * w for w in y.values()))

    def best(text, of, inside):
        return max(((cosine(terms(text), terms(t), inside), name) for name, t in of), key=lambda s: s[0]) if terms(text) else (0.0, None)

    out = []
    for text in texts:
        low = (text or "").lower()
        if not re.search("licen|permission|public domain|spdx|redistribution", low):
            out.append((None, None))
            continue
        head = max((best(s.strip(), templates, headers) for s in re.split(r"[.!?;](?:\s|$)|\n", low) if re.search("licen[cs]|permission|public domain|spdx", s)), key=lambda s: s[0], default=(0.0, None))
        whole, notice = best(low, full, known), best(low, templates, known)
        if notice[0] >= 0.9 and notice[0] > whole[0]:
            file = notice
        else:
            file = whole if whole[0] >= 0.6 else (whole[0], None)
        own = file[1] or (head[1] if head[0] >= 0.6 else None)
        out.append((own, max(head[0], file[0]) if own else None))
    return out


def test_licenses_against_a_plain_version(spark, sf):
    rows = [(str(r["doc_id"]), r["text"]) for r in read_table(spark, sf, "documents").collect()]
    rows += [(f"full{n}", t[: len(t) * 2 // 3]) for n, t in licenses.FULL_TEXTS.items()]
    rows += [("a", "Released under the MIT License. Then more prose about harbours."), ("b", "no such thing"), ("c", "permission denied; licence plate"), ("d", None), ("e", "")]
    frame = spark.createDataFrame(rows, "path string, text string")
    found = {r["path"]: (r["license"], r["score"]) for r in licenses.scan_licenses(frame, Workspace(spark, "t")).collect()}
    want = plain_licenses([t for _, t in rows])
    assert sum(w[0] is not None for w in want) > 15
    for (path, _), (name, score) in zip(rows, want, strict=True):
        assert found[path][0] == name and (score is None or found[path][1] == pytest.approx(score, abs=1e-9)), path


def test_full_texts_of_siblings_are_told_apart(spark):
    assert {"AGPL-3.0", "GPL-3.0", "LGPL-3.0", "Apache-2.0", "MPL-2.0", "BSD-3-Clause", "MIT", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"} <= set(licenses.FULL_TEXTS)
    rows = [(f"/{n}/LICENSE", "Copyright (c) 2020 The Authors\n" + t) for n, t in licenses.FULL_TEXTS.items()]
    prose = [(f"/prose/{k}", f"the program and the work of section {k} under a copyright of the public") for k in range(60)]
    found = licenses.scan_licenses(spark.createDataFrame(rows + prose, "path string, text string"), Workspace(spark, "t")).filter("license IS NOT NULL").collect()
    assert {r["path"]: r["license"] for r in found} == {f"/{n}/LICENSE": n for n in licenses.FULL_TEXTS}


def test_licenses_keep_clashing_columns_and_long_texts(spark):
    long = "harbour " * 300_000 + "\nReleased under the MIT License.\n" + "x" * 500_000
    rows = [("/a/x", long, "k1", "mine", 7, "d", "p"), ("/a/x", long, "k1", "mine", 7, "d", "p"), (None, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "path string, text string, f string, license string, score int, dir string, present string")
    found = licenses.scan_licenses(frame, Workspace(spark, "t"), keep=("f", "license", "dir", "present"))
    assert found.columns == ["path", "f", "dir", "present", "license", "origin", "score"]
    assert sorted(((r["path"] or "", r["f"], r["license"]) for r in found.collect()), key=str) == [("", None, None), ("/a/x", "k1", "MIT"), ("/a/x", "k1", "MIT")]


# Toxicity


def plain_buckets(text):
    points = [ord(c) for c in f" {text.lower()} "] if text else []
    found = set()
    for n in (4, 5, 6, 8):
        for k in range(len(points) - n + 1):
            gram = 0
            for c in points[k : k + n]:
                gram = (gram * 0x100000001B3 + c) % 2**64
            mixed = (gram ^ n << 59) % 2**64 * 0x9E3779B97F4A7C15 % 2**64
            found.add((mixed ^ mixed >> 29) * 0x9E3779B97F4A7C15 % 2**64 >> 44)
    return found


@pytest.mark.parametrize("text", [None, "", "a", "abc", "ABCD efgh", "Ärger übel 漢字🙂 x" * 3])
def test_features_are_of_characters(text):
    assert set(toxicity.features(text).tolist()) == plain_buckets(text)


def test_pieces_of_long_texts_overlap(monkeypatch):
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(500))
    monkeypatch.setattr(toxicity, "PIECE", 37)
    assert set(toxicity.features(text).tolist()) == plain_buckets(text)


def test_toxicity_query_against_a_plain_version(spark, sf):
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    weights, bias = toxicity.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.op6_toxicity(spark, sf).collect():
        short = texts[r["doc_id"]] or ""
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3)
        if len(short) < 3000:
            margin = bias + sum(float(weights[b]) for b in plain_buckets(short))
            assert r["score"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-6)


def test_long_toxic_texts_are_learned_from(spark):
    """Labelled texts far over the sample's length, and labels of rows held out, which are not."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]

    def prose(bad, n):
        return " ".join("zorkface" if bad and rng.random() < 0.2 else rng.choice(words) for _ in range(n))

    rows = [(i, prose(i % 2, 6000 if i < 60 else 30)) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(i, 1 - i % 2) for i in range(60, 160) if zlib.crc32(str(i).encode()) % 4 == 2], "doc_id long, toxic int")
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    toxic = {i for i, text in rows if "zorkface" in text}
    assert min(found[i] for i in toxic) > 0.5 and min(found[i] for i in toxic) > max(found[i] for i, _ in rows if i not in toxic)


# Fingerprints


def test_op1_query_against_its_definition(spark, sf):
    """The registered query's hex strings and components, from the words up."""
    xxhash = pytest.importorskip("xxhash")
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, sf, "documents").collect()}
    bits = {}
    for i, text in texts.items():
        words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        bits[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    ids = sorted(texts)
    least = {i: i for i in ids}
    for _ in ids:  # labels fall along links until none does
        before = dict(least)
        for a in ids:
            least[a] = min(least[b] for b in ids if (bits[a] ^ bits[b]).bit_count() <= 3)
        if least == before:
            break
    found = simhash.op1_simhash(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {i: (f"{bits[i]:016x}", least[i]) for i in ids}


def test_very_long_texts_have_fingerprints(spark):
    text = " ".join(f"w{k % 5000}" for k in range(300_000))
    rows = [(1, text), (2, text + " end"), (3, "x" * 2_000_000), (4, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame, Workspace(spark, "t")).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r["doc_id"] for r in simhash.drop_near_copies(frame, Workspace(spark, "t2")).collect()} == {1, 3, 4}
    assert np.unique(simhash.shingle_hashes(text, 5)).size <= 5000
