"""Command line: `python -m gritsieve scan PATH...`."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from gritsieve.operators.cache import ResultsCache
from gritsieve.plans import sinks
from gritsieve.plans.config import ScanConfig
from gritsieve.plans.scan import scan, store_results
from gritsieve.sources.reference import alias_ref, load_reference, load_rules


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gritsieve")
    s = p.add_subparsers(dest="command", required=True).add_parser("scan", help="scan trees of files")
    s.add_argument("paths", nargs="+")
    s.add_argument("--reference", required=True, help="JSON lines of key, name, text and aliases of licenses")
    s.add_argument("-o", "--output", help="file for the JSON document; standard output if not given")
    s.add_argument("--tables", help="folder for the typed tables")
    s.add_argument("--jobs", type=int, default=0)
    s.add_argument("--timeout", type=int, default=60)
    s.add_argument("--max-file-size", type=int, default=ScanConfig.max_file_size)
    s.add_argument("--no-copyright", action="store_true")
    s.add_argument("--no-crypto", action="store_true")
    s.add_argument("--fingerprints", action="store_true")
    s.add_argument("--rules", help="JSON lines of rule, pattern and meta")
    s.add_argument("--ignore-pattern", action="append", default=[])
    s.add_argument("--gitignore", action="append", default=[], help="a line in force below every path")
    s.add_argument("--cache", help="folder of the results cache")
    s.add_argument("--strict-lexer", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("gritsieve").getOrCreate()
    config = ScanConfig(
        jobs=a.jobs, timeout=a.timeout, max_file_size=a.max_file_size, include_copyright=not a.no_copyright, include_crypto=not a.no_crypto, include_fingerprints=a.fingerprints,
        include_rules=bool(a.rules), ignore_patterns=tuple(a.ignore_pattern), default_gitignores=tuple(a.gitignore), lexer_mode="strict" if a.strict_lexer else "reference",
    )
    ref = load_reference(spark, a.reference)
    cache = ResultsCache(spark, a.cache) if a.cache else None
    frames = scan(spark, a.paths, ref, alias_ref(ref), config, rules=load_rules(spark, a.rules) if a.rules else None, cache=cache)
    if a.tables:
        sinks.tables(frames, a.tables)
    text = sinks.document(frames).first()["value"]
    if cache is not None:
        store_results(frames, cache)
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
