"""Surrogates against a plain scanner, on long texts, and in all the defined cases."""

import random
import re
import time

import pytest
import regex

from veilgrain.llm import pii
from veilgrain.workspace import Workspace, read_table


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "kept out", "x") for i, t in rows], "doc_id long, text string, mentions string, row_no string")


def run(spark, rows, key="key"):
    return pii.pseudonymise(docs_of(spark, rows), key, Workspace(spark, "pii")).collect()


# A scanner of its own: one place after the other, one type after the other.

ALNUM = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
TITLES = (pii.MALE + "|" + pii.FEMALE + "|" + pii.NEUTRAL).split("|")
NAME_WORD = regex.compile(r"(?!(?:" + "|".join(TITLES) + r")(?!\p{L}))\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:-\p{Lu}\p{L}+){0,2}")


def address_at(text, at):
    run_of = ALNUM | set("._%+-")
    if at and text[at - 1] in run_of:
        return None
    end = at
    while end < len(text) and text[end] in run_of:
        end += 1
    if not set(text[at:end]) & ALNUM or text[end : end + 1] != "@":
        return None
    host = re.match(r"[A-Za-z0-9.-]*", text[end + 1 :])[0]
    labels = host.split(".")
    for k in range(min(len(labels) - 1, pii.LEVELS - 1), 0, -1):  # the longest chain of labels that a top level follows
        top = re.match(r"[A-Za-z]{2,}", labels[k])
        if all(labels[:k]) and top:
            return end + 1 + len(".".join(labels[:k])) + 1 + len(top[0])
    return None


def closed(text, end, more=""):
    return end >= len(text) or text[end] not in ALNUM | set(more)


def number_at(text, at, kind):
    """Ends of the digit types, by the longest reading first."""
    before = text[at - 1] if at else " "
    rest = text[at : at + 80]
    if kind == "iban":
        for tail in (3, 2, 1, 0):
            for groups in range(7, 1, -1):
                m = re.match(rf"[A-Z]{{2}}[0-9]{{2}}( ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{tail}}}" if tail else ""), rest)
                if m and closed(text, at + m.end()):
                    return at + m.end()
    if kind == "ip" and before != ".":
        m = re.match(r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})", rest)
        if m and all(int(g) < 256 and str(int(g)) == g for g in m.groups()) and closed(text, at + m.end()) and not re.match(r"\.[0-9]", rest[m.end() :]):
            return at + m.end()
    if kind == "card":
        for p in (r"[0-9]{13,19}", r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}", r"3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}"):
            m = re.match(p, rest)
            if m and closed(text, at + m.end()):
                return at + m.end()
    if kind == "ssn" and before != "-":
        m = re.match(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", rest)
        if m and closed(text, at + m.end(), "-"):
            return at + m.end()
    return None


def scan(text, phone=re.compile(r"(?:(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}|(?<![.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])")):
    def titled_at(at):
        if at and (text[at - 1].isalpha() or text[at - 1] in ALNUM):
            return None
        for title in TITLES:
            m = re.compile(re.escape(title) + r"\.? ").match(text, at)
            first = NAME_WORD.match(text, m.end()) if m else None
            if first:
                second = NAME_WORD.match(text, first.end() + 1) if text[first.end() : first.end() + 1] == " " else None
                return (second or first).end(), [w[0] for w in (first, second) if w]
        return None

    def entities(words):
        spelt = {s for w in words for s in (w, w.upper(), w[:1].upper() + w[1:].lower())}
        at, out = 0, []
        while at < len(text):
            end, kind, start = None, None, at
            if not at or text[at - 1] not in ALNUM:
                end, kind = address_at(text, at), "email"
                while end and text[start] not in ALNUM:
                    start += 1
                for kind_ in ("iban", "ip", "card", "ssn"):
                    if not end:
                        end, kind = number_at(text, at, kind_), kind_
                if not end and (m := phone.match(text, at)):
                    end, kind = m.end(), "phone"
                if not end and (found := titled_at(at)):
                    end, kind = found[0], "name"
                    titled.extend(found[1])
            if not end and (not at or not text[at - 1].isalpha()):
                alone = [w for w in spelt if text.startswith(w, at) and not text[at + len(w) : at + len(w) + 1].isalpha()]
                if alone:
                    end, kind = at + len(alone[0]), "name"
            if end:
                out.append((kind, start, end))
            at = end or at + 1
        return out

    titled: list[str] = []
    entities([])
    return entities(set(titled))


PIECES = [
    "Mr ", "Dr. ", "Frau ", "Dr", "John", "Smith", "SMITH", "O'Neil", "Ann-Mary", "Иванова", "г-жа ", " ", " ", ". ", ", ", "-", "x", "é", "bob@a.de", "..a_b@c-d.co.uk", "@", ".a", "@x.",
    "10.1.2.3", "256.1.1.1", "123-45-6789", "4111 1111 1111 1111", "4111111111111111", "+1 (974) 555-3436", "974-555-3436", "DE89 3704 0044 0532 0130 00", "7", "A1",
]


def test_spans_against_a_plain_scanner(spark):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice(PIECES) for _ in range(rng.randrange(24)))) for k in range(1500)]
    for r in run(spark, rows):
        text = rows[r["doc_id"]][1]
        assert [(e["type"], e["start"], e["end"]) for e in r["entities"]] == scan(text), text
        at, rebuilt = 0, ""
        for e in r["entities"]:
            rebuilt += text[at : e["start"]] + e["replacement"]
            at = e["end"]
        assert rebuilt + text[at:] == r["text"]


def test_query_against_a_plain_scanner(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, sf, "documents").collect()}
    found = pii.op5_pii(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in scan(texts[r["doc_id"]] or ""))


def test_names_corefer(spark):
    rows = [(1, "Mr John Smith met Dr John Smith. John Smith left. Smith said hi to JOHN, not to Smithson or smith"), (2, "John Smith, untitled"), (3, "Mrs John O'Neil; O'Neil and Ann"), (4, "Mr John Ives")]
    found = {r["doc_id"]: r["text"] for r in run(spark, rows)}
    given, surname = re.match(r"Mr (\w+) (\w+) met", found[1]).groups()
    assert found[1] == f"Mr {given} {surname} met Dr {given} {surname}. {given} {surname} left. {surname} said hi to {given.upper()}, not to Smithson or smith"
    assert found[2] == rows[1][1]  # nothing there says that these are names
    assert found[3].startswith(f"Mrs {given} ") and "Neil" not in found[3] and found[3].endswith(" and Ann")
    assert given.endswith("n") and found[4].startswith(f"Mr {given} ")  # most titles say that John is a man
    women = {r["doc_id"]: r["text"] for r in run(spark, [(1, "Frau Eva Berg"), (2, "г-жа Анна Иванова и г-н Иван Петров")])}
    assert re.fullmatch(r"Frau [A-Z][a-z]+na [A-Z][a-z]+r", women[1])
    assert re.fullmatch(r"г-жа [А-Я][а-я]+на [А-Я][а-я]+рова и г-н [А-Я][а-я]+н [А-Я][а-я]+ров", women[2])


LONG = {
    "levels": "x@" + "a." * 3000 + "com",
    "blob": "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1 << 20)),
    "digits": "7" * (1 << 20),
    "dots": "a." * (1 << 19),
    "ats": "a@" * (1 << 19),
    "dashes": "-" * (1 << 20) + "bob@x.de",
    "address": "b" * (1 << 20) + "@x.de",
    "capitals": "A1B2" * (1 << 18),
    "word": "Mr " + "X" * (1 << 20),
    "titles": "Mr " * 300_000,
    "names": "".join(f"Mr {a}{b}{c}ya " for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "abcdefghij" for c in "abcdefghij") * 4,
    "many": "bob@x.de " * 60_000,
}


@pytest.mark.parametrize("name", LONG)
def test_long_texts_take_time_in_proportion(spark, name):
    began = time.monotonic()
    (row,) = run(spark, [(1, LONG[name])])
    assert time.monotonic() - began < 90
    want = {"dashes": 1, "address": 1, "word": 1, "names": 10_400, "many": 60_000}.get(name, 0)
    assert len(row["entities"]) == want and (row["text"] == LONG[name]) == (want == 0)


def test_no_type_runs_out(spark):
    """36 addresses of one character compete for as few others; a type whose room is full grows."""
    values = [("ssn", f"9{k:08d}", None) for k in range(30)] + [("ip", f"10.0.0.{k}", None) for k in range(5)]
    frame = spark.createDataFrame(values, "type string, canon string, form string")
    drawn = frame.select(*(pii._drawn("k", frame["type"], frame["canon"], frame["form"], pii.GROWN + 3).alias("s"),)).collect()
    assert all(len(r["s"]) >= 13 for r in drawn if r["s"].isdigit())
    tight = spark.createDataFrame([("email", f"{c}@a.de", None) for c in "abcdefghijklmnopqrstuvwxyz0123456789"], "type string, canon string, form string")
    found = pii.draw_surrogates(tight, "key", Workspace(spark, "pii")).collect()
    assert len({r["surrogate"] for r in found}) == 36


def test_a_key_is_needed_and_decides(spark):
    with pytest.raises(ValueError):
        pii.pseudonymise(docs_of(spark, [(1, "x")]), "", Workspace(spark, "pii"))
    one, same, other = (run(spark, [(1, "Mr John Smith, bob@x.de")], key)[0]["text"] for key in ("a", "a", "b"))
    assert one == same != other


def test_defined_cases(spark):
    rows = [(None, None), (1, ""), (1, "bob@x.de"), (1, "bob@x.de"), (2, "no data"), (None, "bob@x.de")]
    found = run(spark, rows)
    assert sorted((r["doc_id"] or 0, len(r["entities"])) for r in found) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 1), (2, 0)]
    assert len({r["text"] for r in found}) == 4 and run(spark, [])== []


def test_check_digits_of_ibans_stay_right(spark):
    values = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "DE88 3704 0044 0532 0130 00"]
    found = [r["text"] for r in run(spark, list(enumerate(values)))]

    def rest(iban):
        moved = iban.replace(" ", "")[4:] + iban[:4]
        return int("".join(str(int(c, 36)) for c in moved)) % 97

    assert [rest(v) for v in values[:2]] == [1, 1] == [rest(v) for v in found[:2]] and found[:2] != values[:2]
    assert all(f[:2] == v[:2] and [c == " " for c in f] == [c == " " for c in v] for f, v in zip(found, values))
