"""Which paths a tree scan leaves out: hidden names, glob patterns, and ignore files."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4096)
def _compiled(pattern: str) -> re.Pattern[str]:
    """The regular expression of one line of an ignore file, against a path relative to its folder."""
    anchored = "/" in pattern.rstrip("/")[0:-1] or pattern.startswith("/")
    body, out, i = pattern.strip("/"), "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
        else:
            escaped = body[i] == "\\" and i + 1 < len(body)
            out, i = out + re.escape(body[i + escaped]), i + 1 + escaped
    return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z", re.S)


@dataclass(frozen=True)
class Rules:
    """The lines of one ignore file; `base` is the folder that they are relative to."""

    base: str
    lines: tuple[str, ...]

    @classmethod
    def parse(cls, base: str, text: str) -> Rules:
        lines = (x.rstrip("\r").rstrip(" ") for x in text.split("\n"))
        return cls(base.rstrip("/"), tuple(x for x in lines if x and not x.startswith("#")))

    def match(self, path: str, is_dir: bool) -> bool:
        """Whether the last line that fits the path ignores it."""
        if not path.startswith(self.base + "/"):
            return False
        inner, ignored = path[len(self.base) + 1 :], False
        for line in self.lines:
            keep = line.startswith("!")
            pattern = line[keep:]
            if pattern.endswith("/") and not is_dir:
                continue
            if _compiled(pattern).match(inner):
                ignored = not keep
        return ignored


def reason(name: str, path: str, is_dir: bool, globs: Iterable[str], rules: Iterable[Rules], hidden: bool = True) -> str | None:
    """Why a child of a folder is left out (`hidden`, `pattern`, `gitignore`), or None.

    Globs are compared with the name alone.  Every set of rules that is in force must let the path pass.
    """
    if hidden and name.startswith("."):
        return "hidden"
    if any(fnmatch.fnmatch(name, g) for g in globs):
        return "pattern"
    if any(r.match(path, is_dir) for r in rules):
        return "gitignore"
    return None


def left_out(relpath: Column, globs: Iterable[str], hidden: bool = True) -> Column:
    """The same test for paths of a table: whether any part of a relative path is hidden or fits a glob."""
    parts = F.split(relpath, "/")
    out = F.exists(parts, lambda p: p.startswith(".")) if hidden else F.lit(False)
    for g in globs:
        out = out | _any_fits(parts, "^" + fnmatch.translate(g).replace(r"\Z", r"\z"))
    return out


def _any_fits(parts: Column, pattern: str) -> Column:
    return F.exists(parts, lambda p: p.rlike(pattern))
