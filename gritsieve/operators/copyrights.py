"""Copyright statements, their holders, and authors, by a grammar of lines.

A clause is the rest of a line from the first `copyright`, `©` or `(c)` on.  Its holder is what remains without these
marks, years, and `all rights reserved`.  An author is named after `author`, `written by` or the like.  Tagged
clauses come first.  In mode `reference` each holder of an untagged clause belongs to the last clause of the text, as
if types arrived one after another; in mode `nearest` each clause has its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gritsieve.functions.text import copyright_tags

CLAUSE = r"(?i)((?:\bcopyright\b|\(c\)|©).*)$"
_MARKS = r"(?i)\bcopyright\b|\(c\)|©|\ball rights reserved\b"
_YEARS = r"\b[0-9]{4}(?:\s*[-,]\s*[0-9]{2,4})*\b"
_RIM = r"^[\s,.;:*/#-]+|[\s,.;:*/#-]+$"
AUTHOR = r"(?i)\b(?:authors?:|written by|developed by|created by|@author)\s*(.+)$"


def holder(clause: Column) -> Column:
    """The holder named in a clause, or ''."""
    bare = F.regexp_replace(F.regexp_replace(clause, _MARKS, " "), _YEARS, " ")
    bare = F.regexp_replace(bare, r"(?i)^[\s,.;:]*by\b", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), _RIM, "")


def clauses(text: Column) -> Column:
    """The clauses of a text, in the order of its lines."""
    found = F.transform(F.split(text, r"\R"), lambda line: F.regexp_replace(F.regexp_extract(line, CLAUSE, 1), _RIM, ""))
    return F.filter(found, lambda c: c != "")


def authors(text: Column) -> Column:
    found = F.transform(F.split(text, r"\R"), lambda line: F.regexp_replace(F.regexp_extract(line, AUTHOR, 1), _RIM, ""))
    return F.filter(found, lambda a: a != "")


def statements(text: Column, attach: str = "reference") -> Column:
    """An array of (clause, holders) of a text; null for a null text."""
    filled = lambda xs: F.filter(xs, lambda h: h != "")
    tagged = F.transform(copyright_tags(text), lambda t: F.struct(F.concat(F.lit("SPDX-FileCopyrightText: "), t).alias("clause"), filled(F.array(holder(t))).alias("holders")))
    found = clauses(text)
    if attach == "nearest":
        plain = F.transform(found, lambda c: F.struct(c.alias("clause"), filled(F.array(holder(c))).alias("holders")))
    else:
        n = F.size(found)
        everyone = filled(F.transform(found, holder))
        plain = F.transform(found, lambda c, i: F.struct(c.alias("clause"), F.when(i == n - 1, everyone).otherwise(F.array().cast("array<string>")).alias("holders")))
    return F.concat(tagged, plain)
