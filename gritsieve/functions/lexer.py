"""Comments of source text, as (first line, last line, text).

The scan jumps from one character of interest to the next with a compiled alternation.  Rules that hold in both modes:

- a string is tested before a block comment, and that before a line comment;
- a string or block comment that never ends takes the rest of the text with it, and yields nothing;
- a block comment is at least one character long before its end is looked for, so `/**/` stays open;
- the character behind a string or comment is passed over;
- a backslash hides the next character of a string, except between backticks;
- a line end closes a string in JavaScript and Perl alone;
- a triple-quoted Python string that begins in column 0 is a comment, without its backslashes;
- block comments of Swift nest, and inner marks belong to the text.

Mode `reference` gives up at a quotation mark that the language doesn't have: a backtick outside Go, any mark in
HTML.  Mode `strict` passes over it instead.  Null and empty texts have no comment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritsieve.functions.languages import LANGUAGES, UNKNOWN, Language

REFERENCE, STRICT = "reference", "strict"
_ESCAPED = re.compile(r"\\(.)", re.S)


@lru_cache(maxsize=None)
def _openers(name: str) -> re.Pattern[str]:
    spec = LANGUAGES[name]
    marks = [b[0] for b in spec.blocks] + list(spec.lines)
    return re.compile("|".join(["[\"'`]", *map(re.escape, marks)]))


@lru_cache(maxsize=None)
def _string_end(quote: str, escapes: bool, by_line: bool) -> re.Pattern[str]:
    return re.compile("|".join([r"\\."] * escapes + [re.escape(quote)] + ["\n"] * by_line), re.S)


@lru_cache(maxsize=None)
def _either(a: str, b: str) -> re.Pattern[str]:
    return re.compile(f"{re.escape(a)}|{re.escape(b)}")


def _string(text: str, at: int, quote: str, spec: Language) -> tuple[int, int] | None:
    """(end of the body, first position behind the string) of a string whose body begins at `at`."""
    ends = _string_end(quote, quote != "`", spec.name in ("JavaScript", "Perl"))
    for m in ends.finditer(text, at):
        if m[0] == quote:
            return m.start(), m.end()
        if m[0] == "\n":
            return m.start(), m.start()
    return None


def _block(text: str, at: int, start: str, end: str, nested: bool) -> int | None:
    """Where the end mark of a block comment begins."""
    if not nested:
        found = text.find(end, at + 1)
        return found if found >= 0 else None
    open_, p = 0, at
    while m := _either(start, end).search(text, p + 1):
        p = m.start()
        if text.startswith(start, p):
            open_ += 1
            p += len(start)
        if text.startswith(end, p):
            if not open_:
                return p
            open_ -= 1
            p += len(end)
    return None


def comments_of(text: str | None, lang: str | None, mode: str = REFERENCE) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text) of each comment; lines count from 1."""
    spec = LANGUAGES.get(lang or UNKNOWN, LANGUAGES[UNKNOWN])
    if not text or not (spec.blocks or spec.lines):
        return
    if not text.endswith("\n"):
        text += "\n"
    openers, at, line, counted = _openers(spec.name), 0, 1, 0

    def line_at(position: int) -> int:
        nonlocal line, counted
        line += text.count("\n", counted, position)
        counted = position
        return line

    while m := openers.search(text, at):
        i = m.start()
        if m[0] in "\"'`":
            if spec.name == "HTML" or (m[0] == "`" and not spec.backtick_quote):
                if mode == REFERENCE:
                    return
                at = i + 1
                continue
            quote = m[0]
            if spec.name == "Python" and quote != "`" and text.startswith(quote * 3, i):
                quote *= 3
            body = i + len(quote)
            closed = _string(text, body, quote, spec)
            if closed is None:
                return
            if len(quote) == 3 and (i == 0 or text[i - 1] == "\n"):
                first = line_at(i)
                yield first, line_at(closed[1]), _ESCAPED.sub(r"\1", text[body : closed[0]])
            at = closed[1] + 1
            continue
        for start, end in spec.blocks:
            if text.startswith(start, i):
                stop = _block(text, i + len(start), start, end, spec.nested)
                if stop is None:
                    return
                first = line_at(i)
                yield first, line_at(stop + len(end)), text[i + len(start) : stop]
                at = stop + len(end) + 1
                break
        else:
            start = next(s for s in spec.lines if text.startswith(s, i))
            stop = text.index("\n", i)
            here = line_at(i)
            yield here, here, text[i + len(start) : stop]
            at = stop + 1


COMMENTS = "start_line int, end_line int, text string, error string"


def comments(files: DataFrame, key: str = "relpath", lang: str = "lang", text: str = "text", mode: str = REFERENCE) -> DataFrame:
    """(key, start_line, end_line, text, error): a row for each comment of each file.

    A text that makes the lexer fail yields one row that holds only its error.
    """
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, rows = [], []
            for i, (name, body) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                try:
                    found = [(*c, None) for c in comments_of(body, name, mode)]
                except Exception as e:  # one bad file mustn't fail the scan
                    found = [(None, None, None, f"{type(e).__name__}: {e}")]
                which += [i] * len(found)
                rows += found
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), *columns], [key, "start_line", "end_line", "text", "error"])

    return files.select(key, lang, text).mapInArrow(run, f"`{key}` {kind}, {COMMENTS}")


def register(spark: SparkSession) -> None:
    """Makes `comment_rows(text, lang, mode)` a table function of SQL."""

    class CommentRows:
        def eval(self, text: str, lang: str, mode: str):
            yield from comments_of(text, lang, mode)

    spark.udtf.register("comment_rows", F.udtf(CommentRows, returnType="start_line int, end_line int, text string"))
