"""Reference data: license texts with their names, and pattern rules."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritsieve.functions.text import token_hash, tokens

FOLDER_SETTING = "spark.gritsieve.datasetDir"
#: keys too ambiguous to be searched for as words
AMBIGUOUS = frozenset(
    "Cube Crossword DOC EPICS Fair Glide Intel JSON Libpng MIT MakeIndex NTP Nokia Noweb OML OpenSSL Plexus PostgreSQL Ruby Saxpath Sendmail Sleepycat TCL Vim W3C X11 Xerox Xnet Zed Zlib curl psfrag psutils".split()
)


def dataset_dir(spark: SparkSession) -> str:
    """The folder of prebuilt references: the setting, else GRITSIEVE_DATASET_DIR, else a temporary folder under a local master."""
    if folder := spark.conf.get(FOLDER_SETTING, os.environ.get("GRITSIEVE_DATASET_DIR")):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{FOLDER_SETTING} must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "gritsieve-dataset")


def license_ref(texts: DataFrame, key: str = "key", text: str = "text", order: str | None = None, name: str | None = None) -> DataFrame:
    """(key, ord, name, text, tokens, n_tokens, tok_md5) of license texts; entries without text are left out.

    order: the column that says which entry wins a tie, the key if None; it must be a number.  tokens are distinct and sorted.
    """
    words = tokens(F.col(text))
    return (
        texts.where(F.length(text) > 0)
        .select(F.col(key).cast("string").alias("key"), F.col(order or key).cast("long").alias("ord"), F.col(name or key).cast("string").alias("name"), F.col(text).alias("text"), words.alias("_words"))
        .select("key", "ord", "name", "text", F.array_sort(F.array_distinct("_words")).alias("tokens"), token_hash(F.col("_words")).alias("tok_md5"))
        .withColumn("n_tokens", F.size("tokens"))
    )


def alias_ref(licenses: DataFrame) -> DataFrame:
    """(key, ord, alias) from (key, ord, name, aliases): aliases, then the key unless it is ambiguous or named, then the name."""
    key, name = F.col("key"), F.col("name")
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    keyed = F.when(F.array_contains(aliases, key) | key.isin(*AMBIGUOUS), aliases).otherwise(F.array_append(aliases, key))
    named = F.when(name.isNull() | F.array_contains(keyed, name), keyed).otherwise(F.array_append(keyed, name))
    return licenses.select("key", "ord", F.explode(named).alias("alias")).where(F.length("alias") > 0)


def load_reference(spark: SparkSession, path: str, rebuild: bool = False) -> DataFrame:
    """The prebuilt reference of a JSON file of (key, name, text, aliases), built and stored at the first call.

    Entries without an `ord` column take the order of their keys.
    """
    built = os.path.join(dataset_dir(spark), f"{os.path.basename(path)}.parquet")
    if rebuild or not os.path.exists(os.path.join(built, "_SUCCESS")):
        raw = spark.read.json(path)
        if "ord" not in raw.columns:
            raw = raw.withColumn("ord", F.row_number().over(W.orderBy("key")))
        for c, kind in (("name", "string"), ("aliases", "array<string>")):
            if c not in raw.columns:
                raw = raw.withColumn(c, F.lit(None).cast(kind))
        ref = license_ref(raw, order="ord", name="name").join(raw.select("key", "aliases"), "key", "left")
        ref.write.mode("overwrite").parquet(built)
    return spark.read.parquet(built)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule, pattern, meta) from a JSON file of rules; a file that can't be read gives no rules."""
    schema = "rule string, pattern string, meta map<string,string>"
    try:
        return spark.read.schema(schema).json(path).where("rule is not null and pattern is not null")
    except Exception as e:
        print(f"no rules: {e}")
        return spark.createDataFrame([], schema)
