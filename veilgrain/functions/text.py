"""Text functions that differ from Spark's built-in ones of similar names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at whose removal Python's strip() and a regular expression agree.
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"


def strip(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(text, rf"\A{_SPACE}|{_SPACE}\z", "")


def first_answer(completion: Column) -> Column:
    """First line of a completion, stripped, without closing punctuation, in lower case."""
    line = strip(F.substring_index(strip(completion), "\n", 1))
    return F.lower(F.regexp_replace(line, r"[.,;:!?]+\z", ""))


def match_label(completion: Column, names: dict[int, str], compat: bool = False) -> Column:
    """Label whose name contains the first answer or is contained in it, first in vocabulary order; -1 if none.

    An empty answer matches nothing; with ``compat`` it matches the first label.
    """
    word = first_answer(completion)
    found = F.lit(-1)
    for label, name in reversed(names.items()):
        low = F.lit(name.lower())
        found = F.when(F.contains(word, low) | F.contains(low, word), F.lit(label)).otherwise(found)
    return found if compat else F.when(word == "", F.lit(-1)).otherwise(found)


def render(template: str, **values: Column) -> Column:
    """``template`` with {name} filled in. It is split here, once, so braces in a value stay what they are."""
    import string

    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(values[field])
    return F.concat(*parts) if parts else F.lit("")


def without_bos(prompt: Column) -> Column:
    return F.regexp_replace(prompt, r"\A<bos>", "")
