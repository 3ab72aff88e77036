"""License scans: Aho-Corasick over identifier tags and notice phrases, shunting-yard over license expressions.

One automaton holds all patterns; a text is read once however many patterns there are.  Matching works on UTF-8 bytes and
ignores ASCII case, in phrases, identifiers and allowed licenses alike.  Runs of white space count as one blank, and so do the marks that begin
the lines of a comment, so that a notice may be broken over lines; offsets count bytes from the beginning of the text as it is.

*Tags.*  After a tag such as `SPDX-License-Identifier:` the rest of the line, without a closing comment mark, is
parsed as an expression.  Operators are AND, OR and WITH in any case; WITH binds closest, then AND, then OR;
parentheses group.  *Notices.*  A phrase stands for one license.  Matches of the same or another phrase that lie
within a longer match are dropped, and so are matches inside a longer word.

*Verdict.*  An expression is allowed if it can be met by licenses from the allowed set: OR needs one side, AND
both, and WITH needs its license, or the pair `license WITH exception` itself.

Defined results: null and empty texts have no findings, and an empty table none at all.  An expression that can't be
parsed is a finding with valid = false, no licenses and allowed = false; one that names an identifier that isn't on the public list (nor a LicenseRef)
has its licenses, but valid = false.  Identifiers may have any length, and very long texts are scanned whole.  Repeated rows give repeated
findings; repeated phrases in a text are separate findings by their offsets; of two phrases for the same words the longer counts.  Rows with a null doc_id have
findings with a null doc_id.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.blocks import blocks
from gritsieve.llm.license_names import NOTICES, is_known, is_known_exception
from gritsieve.llm.shared import small_batches

TAGS: tuple[str, ...] = ("spdx-license-identifier:", "license-expression:")

ALLOWED: frozenset[str] = frozenset(["Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "Zlib", "0BSD"])

_RANK = {"OR": 1, "AND": 2, "WITH": 3}
_PIECE = re.compile(r"\(|\)|[^\s()]+")
_CLOSERS = re.compile(r"\s*(?:\*+/|-->|\*\)|#\}|-\}|\"\"\"|''')\s*$")
_WORD = re.compile(rb"[0-9A-Za-z_\x80-\xff]")


class BadExpression(ValueError):
    """Not a license expression."""


def postfix(expression: str) -> list[str]:
    """The expression in postfix order, by the shunting-yard method."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for piece in _PIECE.findall(expression):
        op = piece.upper()
        if piece == "(":
            if not operand_next:
                raise BadExpression(f"no operator before ( in {expression!r}")
            held.append(piece)
        elif piece == ")":
            if operand_next:
                raise BadExpression(f"no license before ) in {expression!r}")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise BadExpression(f") without ( in {expression!r}")
            held.pop()
        elif op in _RANK:
            if operand_next:
                raise BadExpression(f"no license before {op} in {expression!r}")
            if op == "WITH" and out[-1] in _RANK:
                raise BadExpression(f"WITH follows a compound in {expression!r}")
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[op]:
                out.append(held.pop())
            held.append(op)
            operand_next = True
        else:
            if not operand_next:
                raise BadExpression(f"no operator before {piece} in {expression!r}")
            out.append(piece)
            operand_next = False
    if operand_next:
        raise BadExpression(f"ends without a license: {expression!r}")
    while held:
        if held[-1] == "(":
            raise BadExpression(f"( without ) in {expression!r}")
        out.append(held.pop())
    return out


def evaluate(expression: str, allowed: frozenset[str] = ALLOWED) -> tuple[list[str], bool]:
    """(licenses named, in order and once each; whether the allowed licenses meet the expression)."""
    known = {a.lower() for a in allowed}
    stack: list[tuple[bool, str]] = []
    named: dict[str, None] = {}
    pieces = postfix(expression)
    exceptions: set[int] = set()
    for i, piece in enumerate(pieces):
        if piece == "WITH":
            exceptions.add(i - 1)
    for i, piece in enumerate(pieces):
        if piece not in _RANK:
            stack.append((piece.lower() in known, piece))
            if i not in exceptions:
                named[piece] = None
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if piece == "OR":
            stack.append((left or right, ""))
        elif piece == "AND":
            stack.append((left and right, ""))
        else:
            stack.append((left or f"{a} WITH {b}".lower() in known, ""))
    return list(named), stack[0][0]


def all_known(expression: str) -> bool:
    """Whether all identifiers of an expression that can be parsed are on the public list."""
    before = ""
    for piece in _PIECE.findall(expression):
        if piece not in "()" and piece.upper() not in _RANK and not (is_known_exception(piece) if before == "WITH" else is_known(piece)):
            return False
        before = piece.upper()
    return True


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MARKS = _BLANK.copy()
_MARKS[list(b"*#/;%|>-!")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def folded(data: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(the bytes of some texts in lower case with single blanks for white space and comment marks, where each byte comes from)."""
    n = len(data)
    if not n:
        return b"", np.zeros(0, np.int64)
    index = np.arange(n)
    begins = np.where((data == 10) | (data == 13), index, -1)
    starts = at[:-1][at[:-1] < n]
    begins[starts] = np.maximum(begins[starts], starts - 1)
    line = np.maximum.accumulate(begins)
    other = np.maximum.accumulate(np.where(_MARKS[data], -1, index))
    blank = _BLANK[data] | (_MARKS[data] & (line > other) | (_MARKS[data] & (other < 0)))
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    keep[0] = True
    keep[starts] = True
    low = np.where(blank, np.uint8(32), _LOWER[data])
    where = index[keep]
    return low[where].tobytes(), where


def automaton(tags: Sequence[str] = TAGS, notices: Sequence[tuple[str, str]] = NOTICES) -> ahocorasick.Automaton:
    """The automaton over lower-case UTF-8 bytes, each byte one character."""
    found = ahocorasick.Automaton()
    as_bytes = lambda s: s.encode().lower().decode("latin-1")
    for tag in tags:
        found.add_word(as_bytes(tag), (len(tag.encode()), None))
    for phrase, license_id in notices:
        found.add_word(as_bytes(phrase), (len(phrase.encode()), license_id))
    found.make_automaton()
    return found


def scan_bytes(raw: bytes, machine: ahocorasick.Automaton) -> list[tuple[int, int, str | None]]:
    """(first byte, past the last, license or None for a tag) of the matches that no longer match covers."""
    low, where = folded(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    hits = []
    for last, (n, license_id) in machine.iter(low.decode("latin-1")):
        a, b = int(where[last + 1 - n]), int(where[last]) + 1
        if a > 0 and _WORD.match(raw, a - 1) and _WORD.match(raw, a):
            continue
        if b < len(raw) and license_id is not None and _WORD.match(raw, b) and _WORD.match(raw, b - 1):
            continue
        hits.append((a, b, license_id))
    hits.sort(key=lambda h: (h[0], -h[1]))
    kept: list[tuple[int, int, str | None]] = []
    reach = -1
    for a, b, license_id in hits:
        if b > reach:
            kept.append((a, b, license_id))
            reach = b
    return kept


FINDINGS = "doc_id long, offset int, kind string, matched string, expression string, licenses array<string>, valid boolean, allowed boolean"


def license_findings(docs: DataFrame, tags: Sequence[str] = TAGS, notices: Sequence[tuple[str, str]] = NOTICES, allowed: frozenset[str] = ALLOWED) -> DataFrame:
    """One row for each tag or notice: where it is, its expression, the licenses it names, and the verdict."""
    fields = ["doc_id", "offset", "kind", "matched", "expression", "licenses", "valid", "allowed"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_()]

    low_allowed = {x.lower() for x in allowed}

    def finding(raw: bytes, a: int, b: int, license_id: str | None):
        said = raw[a:b].decode("utf-8", "replace")
        if license_id is not None:
            return a, "notice", said, license_id, [license_id], True, license_id.lower() in low_allowed
        stop = len(raw)
        for end in (b"\n", b"\r"):
            at = raw.find(end, b, stop)
            stop = at if at >= 0 else stop
        expression = _CLOSERS.sub("", raw[b:stop].decode("utf-8", "replace")).strip()
        try:
            named, ok = evaluate(expression, allowed)
        except BadExpression:
            return a, "tag", said, expression, [], False, False
        return a, "tag", said, expression, named, all_known(expression), ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(tags, notices)
        for batch in batches:
            ids, rows, which = batch.column(0), [], []
            for first, last, data, at in blocks(batch.column(1)):
                # one pass over the block finds the few texts that have any match at all
                low, where = folded(data, at)
                ends = [end for end, _ in machine.iter(low.decode("latin-1"))]
                for i in np.unique(np.searchsorted(at, where[ends], "right") - 1) if ends else ():
                    raw = data[at[i] : at[i + 1]].tobytes()
                    for hit in scan_bytes(raw, machine):
                        rows.append(finding(raw, *hit))
                        which.append(first + int(i))
            if rows:
                columns = [ids.take(pa.array(which)), *(pa.array(c, t) for c, t in zip(zip(*rows), types[1:]))]
                yield pa.RecordBatch.from_arrays(columns, fields)

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FINDINGS)
