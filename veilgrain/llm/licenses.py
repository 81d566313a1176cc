"""Licence scan: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

The texts are read once. Each gives the template terms it holds (for document
frequencies over all texts) and, where a licence word occurs, sparse term
vectors of its sentences with such a word (headers) and of the whole text (a
licence file is one whose whole text is close to a full licence text, or is a
notice and hardly anything else). An SPDX identifier names its licence. Terms
outside the templates only count in a vector's length. The vectors are then scored by
cosine with the inverse document frequencies of the corpus. A file without a
licence of its own takes that of the nearest directory at or above it that has
a licence file: distinct directories are joined with their ancestors' paths,
then files with directories, so a directory of any size is an ordinary join.

Defined cases: null, empty or wordless text has no licence of its own; ties go
to the template first by name; of several licence files in a directory the
closest counts, then the first path; a null path has no directory and inherits
nothing. Repeated rows each get a row. Texts of any length are read whole. An
empty table gives an empty one; other columns are read only if they are to be
kept, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.llm.common import map_texts
from veilgrain.workspace import Workspace, read_table

MIN_HEADER, MIN_FILE = 0.6, 0.6
#: A whole text counts as a notice only if it holds little else.
MIN_NOTICE_FILE = 0.9
#: What a scan adds to a file; kept columns of these names give way.
RESULTS = ("license", "origin", "score")

# Notices by which the licences are told, under their SPDX names.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Use of this source code is governed by a BSD 2-clause license."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright to the public domain under the CC0 1.0 license."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Full licence texts by SPDX name, to which whole texts are compared.
FULL_TEXTS = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
ANCHORS = (b"licen", b"permission", b"public domain", b"spdx", b"redistribution")

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_SENTENCE = re.compile(r"[.!?;](?:\s|$)|\n")
_SPDX = re.compile(r"spdx-license-identifier:[ \t]*\(?([a-z0-9.+-]+)")
_ANCHOR = re.compile("licen[cs]|permission|public domain|spdx")


def terms_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


VOCABULARY = frozenset(t for notices in TEMPLATES.values() for n in notices for t in terms_of(n))
FILE_VOCABULARY = VOCABULARY.union(*map(terms_of, FULL_TEXTS.values()))
_NAMES = {name.lower(): name for name in (*TEMPLATES, *FULL_TEXTS)}


def _vector(counts: Counter, vocabulary: frozenset) -> dict:
    """Terms of the templates with their weights before IDF, and the squared length of all others."""
    weights = {t: 1 + math.log(n) for t, n in counts.items()}
    inside = {t: w for t, w in weights.items() if t in vocabulary}
    return {"terms": list(inside), "weights": list(inside.values()), "rest": sum(w * w for t, w in weights.items() if t not in vocabulary)}


def spdx_name(low: str) -> str | None:
    """Licence of the first known SPDX identifier in a lower-case text."""
    for found in _SPDX.findall(low):
        if name := _NAMES.get(re.sub(r"(-only|-or-later|\+)$", "", found)):
            return name
    return None


def read_text(text: str | None) -> tuple[list[str], list[dict], dict | None, str | None]:
    """Template terms that occur, vectors of its licence sentences, vector of the whole text if it has any, SPDX licence."""
    if not text:
        return [], [], None, None
    low = text.lower()
    counts = terms_of(low)
    present = list(counts.keys() & FILE_VOCABULARY)
    raw = low.encode("utf-8", "surrogatepass")
    if not any(a in raw for a in ANCHORS):
        return present, [], None, None
    sentences = dict.fromkeys(s.strip() for s in _SENTENCE.split(low) if _ANCHOR.search(s))
    return present, [_vector(terms_of(s), VOCABULARY) for s in sentences], _vector(counts, FILE_VOCABULARY), spdx_name(low)


class Matcher:
    """Cosine of vectors to the templates under given document frequencies."""

    def __init__(self, frequency: dict[str, int], texts: int):
        self.idf = {t: 1 + math.log((texts + 1) / (frequency.get(t, 0) + 1)) for t in FILE_VOCABULARY}
        self.rare = 1 + math.log(texts + 1)
        self.templates = [self._template(name, notice) for name in sorted(TEMPLATES) for notice in TEMPLATES[name]]
        self.full = [self._template(name, FULL_TEXTS[name]) for name in sorted(FULL_TEXTS)]

    def _template(self, name: str, text: str) -> tuple[str, dict[str, float], float]:
        v = {t: (1 + math.log(n)) * self.idf[t] for t, n in terms_of(text).items()}
        return name, v, math.sqrt(sum(w * w for w in v.values()))

    def file(self, vector: dict | None) -> tuple[float, str | None]:
        """Cosine and licence of a whole text that is a full licence text or hardly more than a notice, else no licence."""
        score, name = self.best(vector, self.full)
        notice_score, notice = self.best(vector, self.templates)
        if notice_score >= MIN_NOTICE_FILE and notice_score > score:
            return notice_score, notice
        return score, name if score >= MIN_FILE else None

    def best(self, vector: dict | None, templates: list | None = None) -> tuple[float, str | None]:
        if not vector or not vector["terms"]:
            return 0.0, None
        own = {t: w * self.idf[t] for t, w in zip(vector["terms"], vector["weights"], strict=True)}
        length = math.sqrt(sum(w * w for w in own.values()) + vector["rest"] * self.rare**2)
        scored = [(sum(w * v[t] for t, w in own.items() if t in v) / length / size, name) for name, v, size in templates or self.templates]
        return max(scored, key=lambda s: s[0])


def own_licenses(files: DataFrame, ws: Workspace, path_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """(f: path and kept columns, j: header and whole-file licence with cosine, nulls where no licence word occurs)."""
    vector = "struct<terms:array<string>,weights:array<double>,rest:double>"
    carried = F.struct(F.col(path_col).alias("path"), *([F.struct(*keep).alias("keep")] if keep else []))
    rows = files.select(carried.alias("f"), F.col(text_col).alias("text"))
    read = map_texts(rows, "f", "text", lambda: read_text, f"present array<string>, sentences array<{vector}>, whole {vector}, spdx string")
    read = ws.write(read, "read")
    counts = read.select(F.explode("present").alias("t")).groupBy("t").count()  # at most a row for each template term
    matcher = Matcher({r["t"]: r["count"] for r in counts.collect()}, read.count())
    shared = files.sparkSession.sparkContext.broadcast(matcher)
    result = "struct<license:string,score:double,file_license:string,file_score:double>"

    @F.udf(result, useArrow=True)
    def judge(sentences, whole, spdx):
        best, name = max((shared.value.best(s) for s in sentences), key=lambda s: s[0], default=(0.0, None))
        if spdx:
            best, name = 1.0, spdx
        file_score, file_name = shared.value.file(whole)
        return {
            "license": name if best >= MIN_HEADER else None, "score": best,
            "file_license": file_name, "file_score": file_score,
        }

    some = read.filter("whole IS NOT NULL").select("f", judge("sentences", "whole", "spdx").alias("j"))
    return some.unionByName(read.filter("whole IS NULL").select("f", F.lit(None).cast(result).alias("j")))


def scan_licenses(files: DataFrame, ws: Workspace, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, *keep, license, origin, score): origin is ``own``, ``inherited`` or null."""
    keep = [c for c in keep if c not in (path_col, *RESULTS)]
    found = ws.write(own_licenses(files, ws, path_col, text_col, keep), "own")
    found = found.select("f", "j.*", F.when(F.col("f.path").contains("/"), F.regexp_replace("f.path", "/[^/]*$", "")).alias("dir"))
    named = found.filter("file_license IS NOT NULL AND dir IS NOT NULL").groupBy("dir", "file_score").agg(F.min_by("file_license", "f.path").alias("file_license"))
    by_dir = named.groupBy(F.col("dir").alias("above")).agg(F.max_by("file_license", "file_score").alias("from_above"))
    # Every distinct directory with itself and all above it: /a/b -> /a/b, /a and the root ''.
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("above")))
    dirs = found.select("dir").filter("dir IS NOT NULL").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.*")
    nearest = ws.write(dirs.join(by_dir, "above").groupBy("dir").agg(F.max_by("from_above", "depth").alias("from_above")), "nearest")
    joined = found.join(nearest, "dir", "left")
    own = F.coalesce("file_license", "license")  # a whole text says more than a sentence in it
    origin = F.when(own.isNotNull(), "own").when(F.col("from_above").isNotNull(), "inherited")
    score = F.when(own.isNotNull(), F.greatest("score", "file_score"))
    kept = [F.col(f"f.keep.{c}").alias(c) for c in keep]
    return joined.select(F.col("f.path").alias(path_col), *kept, F.coalesce(own, "from_above").alias("license"), origin.alias("origin"), score.alias("score"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: /<source>/<lang>/<doc_id>."""
    docs = read_table(spark, sf_dir, "documents")
    files = docs.select("doc_id", "text", F.concat_ws("/", F.lit(""), "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return scan_licenses(files, Workspace(spark, "op9"), keep=("doc_id",))
