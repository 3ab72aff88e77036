"""Programming languages: which extension means which, and how each writes comments and strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "Unknown"

#: style: (line comment, start and end of a block comment)
STYLES: dict[str, tuple[str, str, str]] = {
    "bcpl": ("//", "/*", "*/"),
    "batch": ("@REM", "", ""),
    "cmake": ("#", "#[[", "]]"),
    "fortran": ("!", "", ""),
    "haskell": ("--", "{-", "-}"),
    "html": ("", "<!--", "-->"),
    "lisp": (";", "", ""),
    "matlab": ("%", "%{", "%}"),
    "mysql": ("#", "/*", "*/"),
    "ruby": ("#", "=begin", "=end"),
    "shell": ("#", "", ""),
    "sql": ("--", "", ""),
    "unknown": ("", "", ""),
}

#: language: (style, extensions); a language without extensions is only reached by name
_TABLE: dict[str, tuple[str, str]] = {
    "AppleScript": ("unknown", "applescript"),
    "Assembly": ("bcpl", "s"),
    "Batch": ("batch", "bat"),
    "C": ("bcpl", "c cc cpp c++ h hh hpp"),
    "CMake": ("cmake", "cmake"),
    "CSharp": ("bcpl", "cs"),
    "Clif": ("shell", "clif"),
    "Clojure": ("lisp", ""),
    "Dart": ("bcpl", "dart"),
    "Elixir": ("shell", "ex exs"),
    "Flex": ("bcpl", "l"),
    "Fortran": ("fortran", "f f90 f95"),
    "GLSLF": ("bcpl", "glslf"),
    "Go": ("bcpl", "go"),
    "HTML": ("html", "html htm ng sgml"),
    "Haskell": ("haskell", "hs"),
    "Java": ("bcpl", "java"),
    "JavaScript": ("bcpl", "js"),
    "Kotlin": ("bcpl", "kt"),
    "Lisp": ("lisp", "lisp el clj"),
    "Markdown": ("html", "md"),
    "Matlab": ("matlab", ""),
    "MySQL": ("mysql", ""),
    "NinjaBuild": ("shell", "gn"),
    "ObjectiveC": ("bcpl", "m mm"),
    "Perl": ("shell", "pl pm"),
    "Python": ("shell", "py pi"),
    "R": ("shell", "r"),
    "Ruby": ("ruby", "rb"),
    "Rust": ("bcpl", "rs"),
    "SQL": ("sql", "sql"),
    "SWIG": ("bcpl", "swig"),
    "Shader": ("bcpl", "shader"),
    "Shell": ("shell", "sh"),
    "Swift": ("bcpl", "swift"),
    "TypeScript": ("bcpl", "ts tsx"),
    "XML": ("html", "xml xmi xslt xsd"),
    "Yacc": ("bcpl", "y"),
    "Yaml": ("shell", "yaml"),
    UNKNOWN: ("unknown", ""),
}


@dataclass(frozen=True)
class Language:
    """Comment and string syntax of a language."""

    name: str
    style: str
    single: str
    multi_start: str
    multi_end: str
    backtick_quote: bool
    nested: bool

    @property
    def lines(self) -> tuple[str, ...]:
        """All starts of a line comment, the language's own first."""
        extra = {"SQL": "#", "ObjectiveC": "%"}.get(self.name)
        return tuple(s for s in (self.single, extra) if s)

    @property
    def blocks(self) -> tuple[tuple[str, str], ...]:
        """All pairs of block comment marks, the language's own first."""
        extra = {"SQL": ("/*", "*/"), "ObjectiveC": ("%{", "%}")}.get(self.name)
        return tuple(b for b in ((self.multi_start, self.multi_end), extra) if b and b[0])


def _language(name: str) -> Language:
    style = _TABLE[name][0]
    single, start, end = STYLES[style]
    if name == "Rust":  # its block comments aren't read
        start = end = ""
    return Language(name, style, single, start, end, name == "Go", name == "Swift")


LANGUAGES: dict[str, Language] = {name: _language(name) for name in _TABLE}
EXTENSIONS: dict[str, str] = {ext: name for name, (_, exts) in _TABLE.items() for ext in exts.split()}


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, or '' for names such as `.profile` and `Makefile`; case is kept."""
    return F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1)


def language(path: Column) -> Column:
    """The name of a path's language, `Unknown` where its extension is none of ours; null for a null path."""
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.when(path.isNotNull(), F.coalesce(F.element_at(table, extension(path)), F.lit(UNKNOWN)))


def comment_style(lang: Column) -> Column:
    """The style of a language given by name."""
    table = F.create_map(*(F.lit(x) for name, spec in LANGUAGES.items() for x in (name, spec.style)))
    return F.element_at(table, lang)


def language_dim(spark: SparkSession) -> DataFrame:
    """One row for each extension, with the syntax of its language."""
    rows = [(ext, s.name, s.style, s.single, s.multi_start, s.multi_end, s.backtick_quote, s.nested) for ext, name in EXTENSIONS.items() for s in [LANGUAGES[name]]]
    return spark.createDataFrame(rows, "ext string, lang string, style string, single string, multi_start string, multi_end string, backtick_quote boolean, nested boolean")
