"""Findings folded into directories.

Each directory's own facts are rows of (dir, kind, name, value), kind being one of `license`, `copyright_date`,
`copyright_clause`, `copyright`, `crypto` and `component`; sets of such rows unite by `distinct`, so that partial
summaries can be merged in any order.  The fold of directories is a closed form: a directory takes in everything below
it if it has something below it, and all components found below are its own; what lies in several such directories
goes to the topmost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritsieve.functions.text import directory

FACTS = "dir string, kind string, name string, value string"


def _fact(rows: DataFrame, kind: str, name: Column, value: Column | None = None) -> DataFrame:
    value = F.lit(None).cast("string") if value is None else value
    return rows.select("dir", F.lit(kind).alias("kind"), name.cast("string").alias("name"), value.cast("string").alias("value"))


def license_facts(licenses: DataFrame, comments: DataFrame) -> DataFrame:
    """Licenses by directory, from (relpath, license) of whole files and of comments; comments count for files without the first."""
    rest = comments.join(licenses.select("relpath").distinct(), "relpath", "left_anti")
    both = licenses.select("relpath", "license").unionByName(rest.select("relpath", "license")).where("license is not null")
    return _fact(both.select(directory(F.col("relpath")).alias("dir"), "license"), "license", F.col("license")).distinct()


def copyright_facts(statements: DataFrame, fixed: bool = False) -> DataFrame:
    """Holders by directory from (relpath, clause, holder); with fixed, their clauses as well, which the plain mode leaves empty."""
    rows = statements.where("holder is not null").select(directory(F.col("relpath")).alias("dir"), "holder", "clause")
    facts = _fact(rows, "copyright", F.col("holder"))
    if fixed:
        facts = facts.unionByName(_fact(rows.where("clause is not null"), "copyright_clause", F.col("holder"), F.col("clause")))
    return facts.distinct()


def crypto_facts(found: DataFrame) -> DataFrame:
    """Algorithms and codings by directory from (relpath, algorithm, coding); an algorithm without coding stays."""
    return _fact(found.select(directory(F.col("relpath")).alias("dir"), "algorithm", "coding"), "crypto", F.col("algorithm"), F.col("coding")).distinct()


def component_facts(found: DataFrame) -> DataFrame:
    """Components by directory from (relpath, purl, version), purl being an array of which the first counts."""
    rows = found.where("size(purl) > 0").select(directory(F.col("relpath")).alias("dir"), F.element_at("purl", 1).alias("purl"), F.when(F.col("version") != "", F.col("version")).alias("version"))
    return _fact(rows, "component", F.col("purl"), F.col("version")).distinct()


def _ancestors(path: Column) -> Column:
    """All folders above a path: '' at the root, then each prefix; none for the root."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return above


ROOT = "\x00root"


def fold(facts: DataFrame, dirs: DataFrame) -> DataFrame:
    """(dir, rep): the directory that each directory's facts end up in.

    dirs: (dir) of every directory that holds scanned files.  Files of the root lie in a directory '' of their own,
    beside the others and below a root that has no component; so the root takes everything in only if there
    is no component at all, and is then named '' as well.
    """
    own = dirs.select("dir").distinct()
    comps = facts.where("kind = 'component'").select("dir", "name").distinct()
    # each directory's components are looked for in all folders above it; folders in between count as directories too
    above = F.filter(_ancestors(F.col("dir")), lambda p: p != "")
    below = comps.where("dir <> ''").select("dir", "name", F.explode(above).alias("up"))
    missing = below.join(comps.select(F.col("dir").alias("up"), "name"), ["up", "name"], "left_anti").select("up").distinct()
    chains = own.where("dir <> ''").select("dir", F.explode(above).alias("up")).join(missing, "up", "left_anti")
    tops = chains.groupBy("dir").agg(F.min_by("up", F.length("up")).alias("top"))
    none = comps.limit(1).agg(F.count("*").alias("any"))  # one row
    joined = own.join(tops, "dir", "left").crossJoin(none)
    return joined.select("dir", F.when(F.col("any") == 0, F.lit("")).otherwise(F.coalesce("top", "dir")).alias("rep"))


def merged(facts: DataFrame, reps: DataFrame) -> DataFrame:
    """The facts under the directories that they end up in."""
    return facts.join(reps, "dir").select(F.col("rep").alias("dir"), "kind", "name", "value").distinct()


def at_prefix(facts: DataFrame, prefix: str) -> DataFrame:
    """(kind, name, value) of all directories whose name begins with a prefix, which needn't end at a slash."""
    return facts.where(F.col("dir").startswith(prefix)).select("kind", "name", "value").distinct()


def summary(facts: DataFrame) -> DataFrame:
    """(dir, licenses, copyrights, crypto_algorithms, components), arrays sorted and maps by name."""
    sets = facts.groupBy("dir", "kind", "name").agg(F.array_sort(F.collect_set("value")).alias("values"))
    holders = F.struct(F.array().cast("array<string>").alias("dates"), F.col("values").alias("clauses"))
    sets = sets.withColumn("kind", F.when(F.col("kind") == "copyright_clause", "copyright").otherwise(F.col("kind")))
    sets = sets.groupBy("dir", "kind", "name").agg(F.max("values").alias("values"))
    pick = lambda kind, x: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, x)))
    return sets.groupBy("dir").agg(
        pick("license", F.col("name")).alias("licenses"),
        F.map_from_entries(pick("copyright", F.struct("name", holders))).alias("copyrights"),
        F.map_from_entries(pick("crypto", F.struct("name", "values"))).alias("crypto_algorithms"),
        F.map_from_entries(pick("component", F.struct("name", "values"))).alias("components"),
    )


def result_map(findings: DataFrame) -> DataFrame:
    """(relpath, results): for each file a map from category to its data, from (relpath, category, data, ord); the highest ord of a category counts."""
    last = findings.groupBy("relpath", "category").agg(F.max_by("data", F.struct("ord", "data")).alias("data"))
    return last.groupBy("relpath").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "data")))).alias("results"))


def no_result(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(relpath) of the files without a finding."""
    return files.select("relpath").distinct().join(findings, "relpath", "left_anti")


def scan_stats(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(total, with_result, without_result): one row."""
    hit = findings.select("relpath").distinct().withColumn("_hit", F.lit(1))
    return files.select("relpath").distinct().join(hit, "relpath", "left").agg(F.count("*").alias("total"), F.count("_hit").alias("with_result"), F.count_if(F.col("_hit").isNull()).alias("without_result"))


def holder_stats(statements: DataFrame) -> DataFrame:
    """(holder, n_files): the files of each holder from (relpath, holder)."""
    return statements.where("holder is not null").groupBy("holder").agg(F.count_distinct("relpath").alias("n_files"))


def duplicates(files: DataFrame, content: str = "content", key: str = "relpath") -> DataFrame:
    """(sha1, n_files, first): contents that several files have."""
    hashed = files.where(F.col(content).isNotNull()).select(F.sha1(content).alias("sha1"), key)
    return hashed.groupBy("sha1").agg(F.count("*").alias("n_files"), F.min(key).alias("first")).where("n_files > 1")
