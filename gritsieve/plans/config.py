"""Options of a scan."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from gritsieve.operators.gates import MAX_FILE_SIZE, MAX_SIMILARITY_CHARS
from gritsieve.operators.licenses import THRESHOLD


@dataclass(frozen=True)
class ScanConfig:
    """What to look for, and how.

    timeout and jobs have no effect on results: Spark schedules tasks itself, and size gates bound each file's work.
    """

    jobs: int = 0
    timeout: int = 60
    max_file_size: int = MAX_FILE_SIZE
    max_similarity_chars: int = MAX_SIMILARITY_CHARS
    similarity_threshold: float = THRESHOLD
    include_license: bool = True
    include_comments: bool = True
    include_copyright: bool = True
    include_crypto: bool = True
    include_fingerprints: bool = False
    include_rules: bool = False
    analyse_all_text_files: bool = False
    ignore_patterns: tuple[str, ...] = ()
    default_gitignores: tuple[str, ...] = ()
    ignore_hidden: bool = True
    unpack_archives: bool = True
    lexer_mode: str = "reference"
    copyright_mode: str = "reference"
    summary_fixed: bool = False
    gram: int = 30
    window: int = 64

    def options(self) -> dict[str, object]:
        return asdict(self)


def merged_options(*maps: dict[str, object]) -> dict[str, object]:
    """The options of several analysers as one map; the last to name an option wins."""
    out: dict[str, object] = {}
    for m in maps:
        out |= m
    return out
