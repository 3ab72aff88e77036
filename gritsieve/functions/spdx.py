"""License identifiers named by an SPDX expression.

The grammar is a lenient one, kept for its results: words end at blanks and brackets; AND, OR and WITH count in
upper case only; each bracket level has one kind of operator, and a second WITH or a mixture spoils the whole
expression.  Operands aren't counted once there is an operator, an open bracket closes at the end, an exception after
WITH is named like a license, and a word that touches an opening bracket is lost.  A level of one operand leaves its
operator slot behind, so that `A AND (B)` is spoiled while `(A) AND B` is not.

A spoiled expression names nothing.  A closing bracket too many, after which the slots run out, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPERATORS = ("AND", "OR", "WITH")


class Spoiled(ValueError):
    """The expression names no license."""


class Unbalanced(ValueError):
    """More brackets close than there are levels."""


def _words(expression: str) -> Iterator[str]:
    """Words and brackets; what precedes an opening bracket without a blank is dropped."""
    held = ""
    for c in expression.strip():
        if c == "(":
            held = ""
            yield c
        elif c in " )":
            yield held.strip()
            held = ""
            if c == ")":
                yield c
        else:
            held += c
    yield held.strip()


def leaves(expression: str) -> list[str]:
    """The licenses and exceptions of an expression, from left to right, with repetitions."""
    slots: list[str | None] = [None]
    levels: list[list[list[str]]] = [[]]

    def close() -> None:
        operands = levels.pop() if len(levels) > 1 else levels[0]
        if len(levels) == 1 and operands is levels[0]:
            levels[0] = []
        if not slots:
            raise Unbalanced(expression)
        if slots[-1]:
            slots.pop()
            levels[-1].append([leaf for operand in operands for leaf in operand])
        elif len(operands) == 1:
            levels[-1].append(operands[0])
        else:
            raise Spoiled(expression)

    for word in _words(expression):
        if word == "(":
            slots.append(None)
            levels.append([])
        elif word == ")":
            close()
        elif word in _OPERATORS:
            if not slots:
                raise Unbalanced(expression)
            if slots[-1] is None:
                slots[-1] = word
            elif slots[-1] != word or word == "WITH":
                raise Spoiled(expression)
        elif word:
            levels[-1].append([word])
    close()
    if len(levels) > 1 or len(levels[0]) != 1:
        raise Spoiled(expression)
    return levels[0][0]


def licenses_of(expression: str | None) -> tuple[list[str] | None, str | None]:
    """(leaves, error); a null expression has neither."""
    if expression is None:
        return None, None
    try:
        return leaves(expression), None
    except Spoiled:
        return [], None
    except Unbalanced:
        return [], "unbalanced brackets"


@F.arrow_udf(T.StructType([T.StructField("leaves", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]))
def _expression(column: pa.Array) -> pa.Array:
    parsed = [licenses_of(x) for x in column.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([p[0] for p in parsed], pa.list_(pa.string())), pa.array([p[1] for p in parsed], pa.string())], ["leaves", "error"])


def expression_leaves(column: Column) -> Column:
    """The licenses that an expression names, [] if it is spoiled, null if it is null."""
    return _expression(column)["leaves"]


def expression_error(column: Column) -> Column:
    """Why an expression couldn't be read at all, else null."""
    return _expression(column)["error"]
