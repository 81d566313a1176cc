"""PII surrogates with DataFrame and SQL functions only.

One pattern finds e-mail addresses, phone numbers, payment card numbers, IPv4
addresses, social security numbers, IBANs and names after a title; words that a
titled name of the same text brings up are then found without a title too. The
texts are matched once and stored with their mentions; only texts with a titled
name are matched again, for its words.

Every distinct value gets one replacement that is a keyed hash of its canonical
form (so all mentions of a value, however punctuated, cased or titled, stay the
same person's), of the same type and format: digits stay digits, letters stay
letters of the same script and case, punctuation and country prefixes stay, a
card that passes the Luhn check or an IBAN with the right check digits still
does. A word of a name has one
replacement wherever it stands; whether that looks like a given name or a
surname, and of which gender, is what most of its mentions in all texts say.

Replacements are checked for collisions: one that equals any original value of
its type, or that another value has taken, is drawn again with the next attempt
number until none is left. From ``GROWN`` attempts on they grow by a character
each time, so a type never runs out of room. This works on the table of
distinct values with joins and aggregations; texts without a match never move.

Every repetition in the pattern is possessive or bounded, and an address is
tried only where its run of characters begins: the time is in proportion to the
text, unbroken strings of any length included, and the stack is not used up. An
address has at most ``LEVELS`` domain levels, as in the domain name system.

Defined cases: null text stays null and has no entities; empty text stays
empty. Overlapping readings go to the leftmost, then the first type listed.
Repeated rows get the same replacements. Very long texts are taken whole. An
empty table gives an empty table; columns besides id and text are not read.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgrain.workspace import Workspace, read_table

#: Draws after which replacements grow longer than what they replace.
GROWN = 8
#: Levels of a domain; the domain name system allows no more.
LEVELS = 127

# Titles, and syllables of the scripts that names may have.
MALE = "Mr|Herr|Sr|Señor|Monsieur|Signor|г-н|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Sra|Señora|Mme|Madame|Signora|г-жа|Госпожа|Κυρία"
NEUTRAL = "Dr|Prof|Mx"
SYLLABLES = {
    "latin": "ba be bi da de do fa fe ka ke ko la le li lo ma me mi mo na ne no ra re ri ro sa se ta te ti to va ve vi".split(),
    "cyrillic": "ба бе ви да де до ка ке ко ла ле ли ло ма ме ми мо на не но ра ре ри ро са се та те ти то ва".split(),
    "greek": "βα βε γα γε δα δε κα κε κο λα λε λι μα με μι μο να νε νο ρα ρε ρι ρο σα σε τα τε τι το".split(),
}
ENDINGS = {
    "latin": {"given_m": "n", "given_f": "na", "given_n": "l", "surname": "r"},
    "cyrillic": {"given_m": "н", "given_f": "на", "given_n": "ль", "surname": "ров", "surname_f": "рова"},
    "greek": {"given_m": "νος", "given_f": "να", "given_n": "λι", "surname": "ρης", "surname_f": "ρου"},
}
#: Surnames of women in the scripts where they have endings of their own.
FEMALE_SURNAME = "(?:[вн]а|ая|ου)$"

TITLES = "|".join((MALE, FEMALE, NEUTRAL))
#: A word of a name, which no title is: O'Neil, Garcia, Meyer-Lind.
WORD = rf"(?!(?:{TITLES})(?!\p{{L}}))\p{{Lu}}(?:['’]\p{{Lu}})?\p{{L}}++(?:-\p{{Lu}}\p{{L}}++){{0,2}}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Types in order of preference where several would match at one place.
PATTERNS = {
    "email": rf"(?<![._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.){{1,{LEVELS - 1}}}[A-Za-z]{{2,}}+",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z])(?!\.[0-9])",
    "card": r"(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?:(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}"
    r"|(?<![.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:{TITLES})\.? {WORD}(?: {WORD})?",
}
#: No entity begins inside a run of ASCII letters and digits.
PATTERN = "(?<![0-9A-Za-z])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: What every match has in it somewhere; far cheaper to look for in a text without any.
_NAMED = TITLES.split("|")
HINT = rf"[0-9@]|(?<!\p{{L}})[{''.join(sorted({t[0] for t in _NAMED}))}][\p{{L}}-]{{1,{max(map(len, _NAMED)) - 1}}}\.? \p{{Lu}}"
_DIGIT_TYPES = ("phone", "card", "ssn")


def _type_of(surface: Column) -> Column:
    """The first type whose pattern is the whole value, where the boundaries hold at its ends; a word alone is a name."""
    return reduce(lambda rest, t: F.when(surface.rlike(rf"\A(?:{PATTERNS[t]})\z"), F.lit(t)).otherwise(rest), reversed(PATTERNS), F.lit("name"))


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _words(surface: Column) -> Column:
    """The words of a mention of a name, without its title."""
    return F.when(surface.contains(" "), F.slice(F.split(surface, " "), 2, 2)).otherwise(F.array(surface))


def _lead(surface: Column, kind: Column) -> Column:
    """Punctuation that stands before an address but is none of it."""
    return F.when(kind == "email", F.regexp_extract(surface, r"\A[._%+-]*+", 0)).otherwise("")


def _parts(surface: Column, kind: Column) -> Column:
    """(canon, use) of the values in one mention: one, or the words of a name; use says how a name is used, else null."""
    title = F.regexp_replace(F.element_at(F.split(surface, " "), 1), r"\.$", "")
    given = F.when(title.isin(MALE.split("|")), "given_m").when(title.isin(FEMALE.split("|")), "given_f").otherwise("given_n")
    words = F.transform(_words(surface), F.lower)
    none = F.lit(None).cast("string")
    one = F.when(kind.isin(*_DIGIT_TYPES), F.regexp_replace(surface, "[^0-9]", "")).when(kind == "email", F.lower(F.ltrim(surface, F.lit("._%+-"))))
    one = one.when(kind == "iban", F.regexp_replace(surface, " ", "")).otherwise(surface)

    def part(v: Column, use: Column) -> Column:
        return F.struct(v.alias("canon"), use.alias("use"))

    # An untitled word repeats what a titled one has said, so it has no say itself.
    last = part(F.element_at(words, -1), F.when(surface.contains(" "), "surname"))
    named = F.when(F.size(words) == 2, F.array(part(F.element_at(words, 1), given), last)).otherwise(F.array(last))
    return F.when(kind == "name", named).otherwise(F.array(part(one, none)))


def _digits(h: Column) -> Column:
    """60 even decimal digits of a hex SHA-256."""
    return F.concat(*[F.substring(F.lpad(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10), 19, "0"), 5, 15) for k in range(4)])


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn sum; ``doubled_last``: whether the last digit counts double (it stands before a check digit)."""
    odd = 0 if doubled_last else 1

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((F.length(digits) - 1 - i) % 2 == odd, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(digits, ""), term), F.lit(0), lambda a, b: a + b)


def _mod_97(value: Column) -> Column:
    """Letters and digits read as one number (A is 10), modulo 97."""

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), F.lit(0), step)


def _like(value: Column, h: Column) -> Column:
    """Each ASCII letter and digit of ``value`` replaced by one of its kind; all else stays."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    def one(c: Column, i: Column) -> Column:
        n = F.conv(F.substring(h, 1 + (i * 2) % 62, 2), 16, 10).cast("int") + i
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), 1 + n % 26, F.lit(1))
        return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _named(h: Column, form: Column, value: Column, attempt: Column) -> Column:
    """A name of keyed syllables in the script of ``value``; later draws are longer."""
    script = _script(value)
    form = F.when((form == "surname") & (script != "latin") & value.rlike(FEMALE_SURNAME), "surname_f").otherwise(form)

    def in_script(name: str) -> Column:
        syllables = F.array(*map(F.lit, SYLLABLES[name]))

        def one(i: Column) -> Column:
            return F.element_at(syllables, 1 + F.conv(F.substring(h, 1 + (i * 4) % 60, 4), 16, 10).cast("int") % len(SYLLABLES[name]))

        body = F.array_join(F.transform(F.sequence(F.lit(0), 2 + attempt), one), "")
        ending = reduce(lambda rest, e: F.when(form == e[0], e[1]).otherwise(rest), ENDINGS[name].items(), F.lit(""))
        return F.concat(body, ending)

    return F.when(script == "cyrillic", in_script("cyrillic")).when(script == "greek", in_script("greek")).otherwise(in_script("latin"))


def _drawn(key: str, kind: Column, canon: Column, form: Column, attempt: int) -> Column:
    """The canonical replacement of a value at one attempt."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, F.lit(str(attempt)), canon), 256)
    # Bound by a lambda, so that the digest is made once and not for every character.
    return F.element_at(F.transform(F.array(digest), lambda h: _from_digest(h, key, kind, canon, form, attempt)), 1)


def _from_digest(h: Column, key: str, kind: Column, canon: Column, form: Column, attempt: int) -> Column:
    digits, n = _digits(h), F.length(canon)
    more = F.substring(digits, 41, max(0, attempt - GROWN + 1))
    fresh = F.least(n, F.lit(10))
    phone = F.concat(F.substring(canon, F.lit(1), n - fresh), F.substring(digits, F.lit(1), fresh))
    body = F.concat(F.substring(canon, 1, 1), F.substring(digits, F.lit(1), n - 2))
    check = ((10 - _luhn_sum(body, True) % 10) % 10).cast("string")
    card = F.concat(body, F.when(_luhn_sum(canon, False) % 10 == 0, check).otherwise(F.substring(digits, 40, 1)))
    octets = [F.conv(F.substring(h, 1 + 2 * k, 2), 16, 10).cast("int") for k in range(4)]
    ip = F.concat_ws(".", (240 + octets[0] % 15).cast("string"), *[o.cast("string") for o in octets[1:]])
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    host = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256), 1, 10)
    # A short local part has little room: later draws add digits to it.
    grown = F.substring(digits, 1, attempt if attempt > 2 else 0)
    email = F.concat(_like(local, h), grown, F.lit("@h"), host, F.lit(".example."), F.substring_index(domain, ".", -1))
    country, account = F.substring(canon, 1, 2), _like(F.substring(canon, F.lit(5), n), h)
    valid = F.lpad((98 - _mod_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(country, F.when(_mod_97(F.concat(F.substring(canon, F.lit(5), n), F.substring(canon, 1, 4))) == 1, valid).otherwise(F.substring(digits, 40, 2)), account)
    ssn = F.concat(F.lit("9"), F.substring(digits, 1, 8))
    out = F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip).when(kind == "iban", iban).when(kind == "ssn", ssn)
    return F.when(kind == "email", email).when(kind == "name", _named(h, form, canon, F.lit(attempt))).otherwise(F.concat(out, more))


def draw_surrogates(values: DataFrame, key: str, ws: Workspace) -> DataFrame:
    """(type, canon, surrogate) for distinct (type, canon, form): no surrogate equals a value or another surrogate of its type."""
    taken = None
    pending, attempt = values, 0
    while True:
        drawn = pending.withColumn("surrogate", _drawn(key, F.col("type"), F.col("canon"), F.col("form"), attempt))
        originals = values.select("type", F.col("canon").alias("surrogate"))
        free = drawn.join(originals, ["type", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        won = free.groupBy("type", "surrogate").agg(F.min("canon").alias("canon")).select("type", "canon", "surrogate")
        won = ws.write(won, f"won_{attempt}")
        taken = won if taken is None else taken.unionByName(won)
        pending = ws.write(pending.join(won.select("type", "canon"), ["type", "canon"], "left_anti"), f"pending_{attempt}")
        if not pending.limit(1).count():
            return taken
        attempt += 1


def _dressed(surface: Column, kind: Column, values: Column) -> Column:
    """Canonical replacements in the format of the mention; what they have grown by comes last."""
    one = F.element_at(values, 1)

    def laid(kept: str) -> Column:
        """The characters of ``one`` in the places of all characters but those of ``kept``, which stay."""
        chars = F.transform(F.split(surface, ""), lambda c: F.struct(c.alias("c"), c.rlike(kept).alias("stays")))
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
        walked = F.aggregate(
            chars, start,
            lambda a, x: F.struct(
                F.concat(a["out"], F.when(x["stays"], x["c"]).otherwise(F.substring(one, a["at"], F.lit(1)))).alias("out"),
                (a["at"] + F.when(x["stays"], 0).otherwise(1)).alias("at"),
            ),
        )
        return F.concat(walked["out"], F.substring(one, walked["at"], F.length(one)))

    email = F.when(F.upper(surface) == surface, F.upper(one)).otherwise(one)
    names = F.zip_with(_words(surface), values, lambda old, new: F.when(F.upper(old) == old, F.upper(new)).otherwise(F.initcap(new)))
    title = F.when(surface.contains(" "), F.concat(F.substring_index(surface, " ", 1), F.lit(" "))).otherwise("")
    name = F.concat(title, F.array_join(names, " "))
    return F.when(kind.isin(*_DIGIT_TYPES), laid("[^0-9]")).when(kind == "iban", laid(" ")).when(kind == "email", email).when(kind == "name", name).otherwise(one)


def _forms(parts: DataFrame) -> DataFrame:
    """(type, canon, form) of the distinct values; the form of a name is that of most of its titled mentions."""
    count = {u: F.sum(F.when(F.col("use") == u, F.col("n")).otherwise(0)) for u in ("given_m", "given_f", "given_n", "surname")}
    counted = parts.groupBy(F.col("kind").alias("type"), "canon").agg(*[c.alias(u) for u, c in count.items()])
    given = F.when(F.col("given_m") > F.col("given_f"), "given_m").when(F.col("given_f") > F.col("given_m"), "given_f").otherwise("given_n")
    named = F.when(F.col("given_m") + F.col("given_f") + F.col("given_n") >= F.greatest(F.lit(1), "surname"), given).otherwise("surname")
    return counted.select("type", "canon", F.when(F.col("type") == "name", named).alias("form"))


def replacements(surfaces: DataFrame, key: str, ws: Workspace) -> DataFrame:
    """(surface, type, lead, replacement) for distinct mentions (surface, n: how often); ``lead`` is left as it is."""
    typed = surfaces.select("surface", "n", _type_of(F.col("surface")).alias("kind"))
    typed = typed.withColumn("parts", _parts(F.col("surface"), F.col("kind")))
    parts = ws.write(typed.select("surface", "n", "kind", F.posexplode("parts").alias("at", "part")).select("surface", "n", "kind", "at", "part.*"), "parts")
    drawn = draw_surrogates(ws.write(_forms(parts), "values"), key, ws).withColumnRenamed("type", "kind")
    back = parts.join(drawn, ["kind", "canon"]).groupBy("surface", "kind").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias("s"))
    lead = _lead(F.col("surface"), F.col("kind"))
    own = F.when(F.col("kind") == "email", F.ltrim(F.col("surface"), F.lit("._%+-"))).otherwise(F.col("surface"))
    return back.select("surface", F.col("kind").alias("type"), lead.alias("lead"), _dressed(own, F.col("kind"), F.col("s.surrogate")).alias("replacement"))


def _pattern_of(mentions: Column) -> Column:
    """The pattern of one text: that of all texts and, if it has titled names, their words without a title."""
    titled = F.filter(mentions, lambda m: m.rlike(rf"\A(?:{PATTERNS['name']})\z"))
    words = F.array_distinct(F.flatten(F.transform(titled, _words)))
    spelt = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.upper(w), F.initcap(w)))))
    alone = F.concat(F.lit(rf"{PATTERN}|(?<!\p{{L}})(?:"), F.array_join(spelt, "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.size(spelt) > 0, alone).otherwise(F.lit(PATTERN))


def pseudonymise(docs: DataFrame, key: str, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text with replacements, entities: array of type, start, end, replacement in code points of the given text)."""
    if not key:
        raise ValueError("replacements need a key that nobody else knows")
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    matched = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    found = rows.withColumn("mentions", F.coalesce(matched, F.array().cast("array<string>")))
    found = ws.write(found.withColumn("row_no", F.monotonically_increasing_id()), "found")
    entity = "array<struct<type:string,start:long,end:long,replacement:string>>"
    clean = found.filter(F.size("mentions") == 0).select(id_col, "text", F.array().cast(entity).alias("entities"))
    hit = found.filter(F.size("mentions") > 0).withColumn("pattern", _pattern_of(F.col("mentions")))
    # Gap, mention, gap, mention, ...: the gaps are the pieces that the same pattern splits out.
    again = F.when(F.length("pattern") > len(PATTERN), F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("mentions"))
    hit = ws.write(hit.select(id_col, "row_no", F.split("text", F.col("pattern"), -1).alias("gaps"), again.alias("mentions")), "hit")
    pieces = F.posexplode(F.zip_with("gaps", "mentions", lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), m.alias("surface")))).alias("at", "p")
    mentions = hit.select("row_no", pieces).select("row_no", "at", "p.*").filter("surface IS NOT NULL")
    mapped = ws.write(replacements(mentions.groupBy("surface").agg(F.count(F.lit(1)).alias("n")), key, ws), "replacements")
    upto = Window.partitionBy("row_no").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = mentions.join(mapped, "surface").withColumn("end", F.sum(F.col("gap") + F.length("surface")).over(upto))
    start = F.col("end") - F.length("surface") + F.length("lead")
    one = F.struct("at", "type", start.alias("start"), "end", "lead", "replacement")
    by_row = placed.groupBy("row_no").agg(F.array_sort(F.collect_list(one)).alias("r"))
    both = hit.join(by_row, "row_no")
    text = F.array_join(F.zip_with("gaps", "r", lambda g, r: F.concat(g, F.coalesce(F.concat(r["lead"], r["replacement"]), F.lit("")))), "")
    entities = F.transform("r", lambda r: F.struct(r["type"].alias("type"), r["start"].alias("start"), r["end"].alias("end"), r["replacement"].alias("replacement")))
    done = both.select(id_col, text.alias("text"), entities.cast(entity).alias("entities"))
    return clean.unionByName(done)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's ``spark.veilgrain.pii.key``; without one, a fresh one for each run."""
    key = spark.conf.get("spark.veilgrain.pii.key", None) or secrets.token_hex(32)
    found = pseudonymise(read_table(spark, sf_dir, "documents"), key, Workspace(spark, "op5"))
    spans = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["start"], e["end"])), ",")
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), spans.alias("spans"))
