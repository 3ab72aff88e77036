"""Column functions over paths and texts; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}_]+)"
#: ASCII white space and punctuation, as a class of Java's and RE2's regular expressions
EDGE = r"[\t\n\x0B\f\r !-/:-@\[-`{-~]"
LICENSE_TAG = r"(?i)spdx-license-identifier:([^\n]*)"
COPYRIGHT_TAG = r"(?i)spdx-filecopyrighttext:([^\n]*)"


def tokens(text: Column, pattern: str = WORD) -> Column:
    """Words in their order and case; punctuation and white space are left out."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def token_hash(words: Column) -> Column:
    """Equal for equal sequences of words."""
    return F.md5(F.array_join(words, "\u0001"))


def joined_words(text: Column) -> Column:
    """The words of a text as `token_hash` joins them, without making a list of them; '' for a text without a word."""
    return F.btrim(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", "\u0001"), F.lit("\u0001"))


def text_token_hash(text: Column) -> Column:
    """`token_hash` of the words of a text; null for a text without a word."""
    joined = joined_words(text)
    return F.when(joined != "", F.md5(joined))


def relative_path(path: Column, root: Column) -> Column:
    """path below root; both without a closing slash."""
    return F.when(root.isNull(), path).otherwise(F.substring(path, F.length(root) + 2, F.length(path)))


def directory(relpath: Column) -> Column:
    """What precedes the last slash; '' for a file of the root."""
    return F.regexp_replace(relpath, r"/?[^/]*$", "")


def license_tag(text: Column) -> Column:
    """The rest of the line after the first license tag, untrimmed, or null."""
    return F.when(text.rlike(LICENSE_TAG), F.regexp_extract(text, LICENSE_TAG, 1))


def copyright_tags(text: Column) -> Column:
    """The rest of the line after each copyright tag, untrimmed."""
    return F.regexp_extract_all(text, F.lit(COPYRIGHT_TAG), F.lit(1))


def numbered_lines(text: Column) -> Column:
    """An array of (line, text), lines counted from 0."""
    return F.transform(F.split(text, r"\R"), lambda x, i: F.struct(i.alias("line"), x.alias("text")))


def bounded_at_first(text: Column, phrase: Column) -> Column:
    """Whether the first occurrence of a phrase stands between edges: white space, ASCII punctuation, or an end of the text.

    Later occurrences aren't looked at.
    """
    at = F.instr(text, phrase)
    after = at + F.length(phrase)
    left = (at == 1) | F.substring(text, at - 1, F.lit(1)).rlike(f"^{EDGE}$")
    right = (after > F.length(text)) | F.substring(text, after, F.lit(1)).rlike(f"^{EDGE}$")
    return (at > 0) & (F.length(phrase) > 0) & left & right


def fingerprint_files(wfp: Column) -> Column:
    """The MD5 sums named in the `file=` lines of a fingerprint text."""
    return F.regexp_extract_all(wfp, F.lit(r"file=([a-f0-9]{32})"), F.lit(1))


def file_hash(content: Column) -> Column:
    return F.sha1(content)


def fast_hash(content: Column) -> Column:
    """A 64-bit hash in hexadecimal, for private caches."""
    return F.lower(F.lpad(F.hex(F.xxhash64(content)), 16, "0"))


def options_fingerprint(options: dict[str, object]) -> Column:
    """A hash of options whatever their order; null for none."""
    if not options:
        return F.lit(None).cast("string")
    import json

    return fast_hash(F.lit(json.dumps(options, sort_keys=True, separators=(",", ":"), default=str)))


def content_key(category: str, version: int, content_hash: Column, size: Column, options: Column) -> Column:
    """The cache key of a content: `category:vN:hash:size`, and `:opts:fingerprint` if there are options."""
    return F.concat_ws(":", F.lit(category), F.lit(f"v{version}"), content_hash, size.cast("string"), F.when(options.isNotNull(), F.concat(F.lit("opts:"), options)))


def stat_key(category: str, version: int, path: Column, options: Column) -> Column:
    """The cache key of a path: `fast:category:vN:path:fingerprint`, or `noopts` in place of a fingerprint."""
    return F.concat_ws(":", F.lit("fast"), F.lit(category), F.lit(f"v{version}"), path, F.coalesce(options, F.lit("noopts")))
