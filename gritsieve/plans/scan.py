"""A whole scan: files to findings, findings to a summary and a document."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gritsieve.functions.lexer import comments
from gritsieve.functions.spdx import expression_error
from gritsieve.functions.text import directory, license_tag
from gritsieve.operators import gates, summary
from gritsieve.operators.cache import ResultsCache, with_cache
from gritsieve.plans.analysers import Analyser, default_analysers
from gritsieve.plans.config import ScanConfig, merged_options
from gritsieve.sources.files import file_tree
from gritsieve.sources.tables import kept

FINDINGS = "relpath string, category string, data string, ord int"
_LICENSE = "struct<key:string,score:double,spdx:string,licenses:array<string>,copyright:array<struct<clause:string,holders:array<string>>>,authors:array<string>>"
_COMMENT = "struct<line:int,endLine:int,key:string,licenses:array<string>,copyright:array<struct<clause:string,holders:array<string>>>>"


@dataclass(frozen=True)
class ScanFrames:
    """The results of a scan, lazy but for the findings, which are written to the shared folder."""

    files: DataFrame
    ignored: DataFrame
    findings: DataFrame
    errors: DataFrame
    config: ScanConfig
    options: dict[str, object]
    components: DataFrame | None = None
    to_store: list[tuple[DataFrame, str]] = field(default_factory=list)

    @property
    def no_result(self) -> DataFrame:
        return summary.no_result(self.files, self.findings)

    @property
    def stats(self) -> DataFrame:
        return summary.scan_stats(self.files, self.findings)

    @property
    def results(self) -> DataFrame:
        return summary.result_map(self.findings)

    @property
    def facts(self) -> DataFrame:
        """The facts of every directory, before the fold."""
        by = lambda c: self.findings.where(F.col("category") == c)
        whole = by("license").select("relpath", F.from_json("data", _LICENSE).alias("x"))
        notes = by("comments").select("relpath", F.explode(F.from_json("data", f"array<{_COMMENT}>")).alias("x"))
        named = F.when(F.col("x.key").isNotNull(), F.array("x.key")).otherwise(F.col("x.licenses"))
        licenses = lambda rows: rows.select("relpath", F.explode_outer(named).alias("license"))
        facts = summary.license_facts(licenses(whole), licenses(notes))
        claims = lambda rows: rows.select("relpath", F.explode("x.copyright").alias("c")).select("relpath", "c.clause", F.explode("c.holders").alias("holder"))
        # comments count for files without a license result
        said = claims(whole).unionByName(claims(notes.join(whole.select("relpath"), "relpath", "left_anti")))
        facts = facts.unionByName(summary.copyright_facts(said, self.config.summary_fixed))
        crypto = by("crypto").select("relpath", F.explode(F.from_json("data", "array<struct<algorithm:string,coding:string>>")).alias("x")).select("relpath", "x.*")
        facts = facts.unionByName(summary.crypto_facts(crypto))
        if self.components is not None:
            facts = facts.unionByName(summary.component_facts(self.components))
        return facts

    @property
    def folded(self) -> DataFrame:
        """The facts under the directories that the fold leaves."""
        facts = kept(self.facts, "facts")  # the fold reads them again and again; few beside the findings
        dirs = self.findings.select(directory(F.col("relpath")).alias("dir"))
        return summary.merged(facts, summary.fold(facts, dirs))

    @property
    def summary(self) -> DataFrame:
        return summary.summary(self.folded)

    def summary_at_path(self, prefix: str) -> DataFrame:
        return summary.at_prefix(self.folded, prefix)


def analysed(files: DataFrame, analysers: Sequence[Analyser], config: ScanConfig, cache: ResultsCache | None = None) -> tuple[DataFrame, list[tuple[DataFrame, str]], list[tuple[None, str, str]]]:
    """(findings, rows to store with their category, errors) of routed files by several analysers.

    Each analyser's findings are written on their own, so that one that fails leaves an error and the others' findings.
    """
    branches, store, errors = [files.sparkSession.createDataFrame([], FINDINGS)], [], []
    for i, a in enumerate(analysers):
        try:
            mine = files.where(a.predicate())
            if cache is None:
                rows, fresh = a.transform(mine), None
            else:
                rows, fresh = with_cache(a.transform, mine, cache, a.category, options=a.options())
            rows = rows.where("data is not null and data not in ('[]', '{}')").select("relpath", F.lit(a.category).alias("category"), "data", F.lit(i).alias("ord"))
            branches.append(kept(rows, "findings"))
        except ImportError:
            raise
        except Exception as e:  # whatever an analyser of somebody else raises
            if "ModuleNotFoundError" in str(e) or "ImportError" in str(e):
                raise
            errors.append((None, a.category, f"{type(e).__name__}: {str(e)[:500]}"))
            continue
        if fresh is not None:
            store.append((fresh, a.category))
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out, store, errors


def failures(routed: DataFrame, config: ScanConfig) -> DataFrame:
    """(relpath, category, message): files that couldn't be read, sources that the lexer fails on, and tags with unbalanced brackets."""
    unread = routed.where("content is null").select("relpath", F.lit("read").alias("category"), F.lit("the file could not be read").alias("message"))
    lexed = comments(routed.where("is_source"), mode=config.lexer_mode).where("error is not null").select("relpath", F.lit("comments").alias("category"), F.col("error").alias("message"))
    tags = routed.where("is_text").select("relpath", license_tag(F.col("text")).alias("tag")).where("tag is not null")
    spoiled = tags.select("relpath", F.lit("license").alias("category"), expression_error(F.col("tag")).alias("message")).where("message is not null")
    return unread.unionByName(lexed).unionByName(spoiled)


def scan_files(files: DataFrame, ref: DataFrame, aliases: DataFrame, config: ScanConfig = ScanConfig(), rules: DataFrame | None = None, components: DataFrame | None = None, cache: ResultsCache | None = None, ignored: DataFrame | None = None, analysers: Sequence[Analyser] | None = None, after: Sequence[Callable[[DataFrame], DataFrame]] = (), observe: Observation | None = None) -> ScanFrames:
    """Scans a table of files (see sources.files.FILES).

    The latest file of a relpath counts.  Each analyser reads the routed files; one that fails becomes a row of errors without a relpath.  components:
    (relpath, purl, version) for the summary.  after: steps over the findings, in order, before anything is stored.
    observe: is given the number of files while the scan runs.
    """
    spark = files.sparkSession
    routed = gates.routed(files, config.max_file_size)
    if observe is not None:
        routed = routed.observe(observe, F.count("*").alias("files"))
    analysers = default_analysers(ref, aliases, config, rules) if analysers is None else analysers
    findings, store, failed = analysed(routed, analysers, config, cache)
    for step in after:
        findings = step(findings)
    # results, summary and statistics all read the findings, which are few beside the files
    findings = kept(findings, "findings") if after else findings
    errors = failures(routed, config).unionByName(spark.createDataFrame(failed, "relpath string, category string, message string"))
    ignored = spark.createDataFrame([], "relpath string, reason string") if ignored is None else ignored
    options = merged_options(*(a.options() for a in analysers))
    return ScanFrames(routed, ignored, findings, errors, config, options, components, store)


def scan(spark: SparkSession, paths: Sequence[str], ref: DataFrame, aliases: DataFrame, config: ScanConfig = ScanConfig(), **how) -> ScanFrames:
    """Scans trees of files."""
    files, ignored = file_tree(spark, paths, config.ignore_patterns, config.ignore_hidden, config.default_gitignores, config.unpack_archives)
    # several branches read the contents: they are kept on the executors' disks, and read anew from the files if one is lost
    return scan_files(files.persist(), ref, aliases, config, ignored=ignored, **how)


def store_results(frames: ScanFrames, cache: ResultsCache) -> None:
    """Keeps the fresh results, as they are after all later steps."""
    for rows, category in frames.to_store:
        final = frames.findings.where(F.col("category") == category).select("relpath", F.col("data").alias("_final"))
        cache.set_with_fastpath(rows.join(final, "relpath", "left").withColumn("data", F.coalesce("_final", "data")).drop("_final"))
