"""Analysers: what turns routed files into findings of one category.

An analyser says which files it accepts, as a predicate over their columns, and transforms those into
(relpath, data) with data as JSON.  Third parties add their own by implementing `Analyser`.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritsieve.functions.lexer import comments
from gritsieve.operators import copyrights, detectors, gates, licenses
from gritsieve.operators.comments import heads, merge_runs
from gritsieve.plans.config import ScanConfig
from gritsieve.sources.tables import kept


class Analyser(Protocol):
    category: str

    def predicate(self) -> Column: ...

    def transform(self, files: DataFrame) -> DataFrame: ...

    def options(self) -> dict[str, object]: ...


def _json(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("relpath", F.to_json(F.struct(*columns)).alias("data"))


def _with_copyright(rows: DataFrame, texts: DataFrame, key: str, config: ScanConfig) -> DataFrame:
    """rows with `copyright` and `authors` of their texts, null where there are none."""
    if not config.include_copyright:
        return rows.join(texts.select(key, F.lit(None).alias("copyright"), F.lit(None).alias("authors")).limit(0), key, "left")
    # within an array, so that what is said is found once and not once more for its size
    full = lambda c: F.get(F.filter(F.array(c), lambda x: F.size(x) > 0), F.lit(0))
    said, who = full(copyrights.statements(F.col("text"), config.copyright_mode)), full(copyrights.authors(F.col("text")))
    return rows.join(texts.select(key, said.alias("copyright"), who.alias("authors")), key, "left")


@dataclass(frozen=True)
class LicenseAnalyser:
    """Whole license files, by their words; with analyse_all_text_files, what other texts say of licenses."""

    ref: DataFrame
    aliases: DataFrame
    config: ScanConfig
    category: str = "license"

    def predicate(self) -> Column:
        return F.col("is_license")

    def options(self) -> dict[str, object]:
        return {"includeCopyright": self.config.include_copyright, "analyseAllTextFiles": self.config.analyse_all_text_files, "similarityThreshold": self.config.similarity_threshold}

    def transform(self, files: DataFrame) -> DataFrame:
        named = gates.license_name(F.col("relpath")) & gates.short_enough(F.col("text"), self.config.max_similarity_chars)
        # results are kept and joined by their keys: nothing is found twice, and no text is shuffled
        whole = kept(licenses.license_file_matches(files, self.ref, named, threshold=self.config.similarity_threshold), "licenses")
        found = whole.select("relpath", F.col("license").alias("key"), "score", F.lit(None).cast("string").alias("spdx"), F.lit(None).cast("array<string>").alias("licenses"))
        if self.config.analyse_all_text_files:
            said = licenses.analysed(files, self.aliases).join(whole.select("relpath"), "relpath", "left_anti")
            found = found.unionByName(said.select("relpath", F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("score"), "spdx", "licenses"))
        return _json(_with_copyright(found, files, "relpath", self.config), "key", "score", "spdx", "licenses", "copyright", "authors")


@dataclass(frozen=True)
class CommentAnalyser:
    """Comments of source files: the first run may be a license text, the others say something of licenses or holders."""

    ref: DataFrame
    aliases: DataFrame
    config: ScanConfig
    category: str = "comments"

    def predicate(self) -> Column:
        return F.col("is_source")

    def options(self) -> dict[str, object]:
        return {"includeCopyright": self.config.include_copyright, "lexerMode": self.config.lexer_mode, "similarityThreshold": self.config.similarity_threshold}

    def runs(self, files: DataFrame) -> DataFrame:
        """(id, relpath, line, endLine, text): merged comments."""
        merged = merge_runs(comments(files, mode=self.config.lexer_mode).where("error is null"))
        return merged.select(F.concat_ws("\x00", "relpath", "run").alias("id"), "relpath", "run", F.col("start_line").alias("line"), F.col("end_line").alias("endLine"), "text")

    def rows(self, files: DataFrame) -> DataFrame:
        """(relpath, line, endLine, key, score, spdx, licenses, copyright, authors) of the runs that say something."""
        runs = kept(self.runs(files), "runs")
        whole = licenses.text_matches(heads(runs), self.ref, key="id", threshold=self.config.similarity_threshold).withColumnRenamed("license", "key")
        rest = runs.join(whole.select("id"), "id", "left_anti")
        said = licenses.analysed(rest, self.aliases, key="id")
        found = whole.join(said, "id", "full").select("id", "key", "score", "spdx", "licenses")
        both = _with_copyright(runs.join(found, "id", "left"), runs, "id", self.config)
        return both.where("key is not null or spdx is not null or licenses is not null or copyright is not null or authors is not null")

    def transform(self, files: DataFrame) -> DataFrame:
        item = F.struct("line", "endLine", "key", "score", "spdx", "licenses", "copyright", "authors")
        listed = self.rows(files).groupBy("relpath").agg(F.array_sort(F.collect_list(item)).alias("data"))
        return listed.select("relpath", F.to_json("data").alias("data"))


@dataclass(frozen=True)
class CryptoAnalyser:
    """Cryptographic algorithms in source files."""

    config: ScanConfig
    category: str = "crypto"

    def predicate(self) -> Column:
        return F.col("is_source")

    def options(self) -> dict[str, object]:
        return {}

    def rows(self, files: DataFrame) -> DataFrame:
        return detectors.crypto_found(files.select("relpath", F.make_valid_utf8(F.col("content").cast("string")).alias("_raw")), text="_raw")

    def transform(self, files: DataFrame) -> DataFrame:
        listed = self.rows(files).groupBy("relpath").agg(F.array_sort(F.collect_list(F.struct("algorithm", "coding"))).alias("data"))
        return listed.select("relpath", F.to_json("data").alias("data"))


@dataclass(frozen=True)
class FingerprintAnalyser:
    """Winnowing fingerprints of source files."""

    config: ScanConfig
    category: str = "fingerprints"

    def predicate(self) -> Column:
        return F.col("is_source")

    def options(self) -> dict[str, object]:
        return {"gram": self.config.gram, "window": self.config.window}

    def rows(self, files: DataFrame) -> DataFrame:
        return detectors.fingerprint_text(files, detectors.fingerprints(files, k=self.config.gram, window=self.config.window))

    def transform(self, files: DataFrame) -> DataFrame:
        return _json(self.rows(files), "wfp")


@dataclass(frozen=True)
class RuleAnalyser:
    """Pattern rules over every file."""

    rules: DataFrame
    category: str = "rules"

    def predicate(self) -> Column:
        return F.col("content").isNotNull()

    def options(self) -> dict[str, object]:
        return {}

    def transform(self, files: DataFrame) -> DataFrame:
        raw = files.select("relpath", F.make_valid_utf8(F.col("content").cast("string")).alias("_raw"))
        hits = detectors.rule_matches(raw, self.rules, text="_raw")
        listed = hits.groupBy("relpath").agg(F.array_sort(F.collect_list(F.struct("rule", F.to_json("meta").alias("meta")))).alias("data"))
        return listed.select("relpath", F.to_json("data").alias("data"))


def default_analysers(ref: DataFrame, aliases: DataFrame, config: ScanConfig, rules: DataFrame | None = None) -> list[Analyser]:
    """The analysers that a configuration asks for."""
    out: list[Analyser] = []
    if config.include_license:
        out.append(LicenseAnalyser(ref, aliases, config))
    if config.include_comments:
        out.append(CommentAnalyser(ref, aliases, config))
    if config.include_crypto:
        out.append(CryptoAnalyser(config))
    if config.include_fingerprints:
        out.append(FingerprintAnalyser(config))
    if config.include_rules and rules is not None:
        out.append(RuleAnalyser(rules))
    return out
