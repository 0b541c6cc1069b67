"""Source files below a folder."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions import text as t
from riskspark.settings import TEST_MARKERS, Settings


def language(path: Column, settings: Settings) -> Column:
    known = F.create_map(*(F.lit(x) for pair in settings.languages.items() for x in pair))
    return F.try_element_at(known, F.lower(t.suffix(path)))


def discover(files: DataFrame, settings: Settings | None = None) -> DataFrame:
    """files (path, ...) that are scanned, with their language: known suffix, not excluded, included if anything is, no tests if they are ignored."""
    s = settings or Settings()
    out = files.withColumn("language", language(F.col("path"), s)).filter(F.col("language").isNotNull() & ~F.col("path").rlike(t.glob_pattern(s.excludes)))
    if s.includes:
        out = out.filter(F.col("path").rlike(t.glob_pattern(s.includes)))
    return out.filter(~t.is_test(F.col("path"), TEST_MARKERS)) if s.ignore_tests else out


def walk(root: str, settings: Settings | None = None) -> list[str]:
    """Paths below root of known suffixes, sorted; folders that an exclude names whole (`name/*`) are not entered, nor are links."""
    s, out = settings or Settings(), []
    pruned = {g[:-2] for g in s.excludes if g.endswith("/*") and "*" not in g[:-2] and "/" not in g[:-2]}
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f not in pruned and not f.startswith(".egg") and not f.endswith(".egg-info"))
        here = os.path.relpath(folder, root)
        out += [n if here == "." else f"{here}/{n}".replace(os.sep, "/") for n in names if os.path.splitext(n)[1].lower() in s.languages and os.path.isfile(os.path.join(folder, n))]
    return sorted(out)


def read(spark: SparkSession, root: str, settings: Settings | None = None) -> DataFrame:
    """(path relative to root, content, n_bytes, language). Content above the size gate is not read: the length filter reaches the listing."""
    s = settings or Settings()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = t.normal_path(F.regexp_replace("path", "^[a-z]+:/*(?=/)", ""), root.rstrip("/"))
    small = raw.filter(F.col("length") <= s.max_file_bytes).select(path.alias("path"), "content", F.col("length").alias("n_bytes"))
    large = raw.filter(F.col("length") > s.max_file_bytes).select(path.alias("path"), F.lit(None).cast("binary").alias("content"), F.col("length").alias("n_bytes"))
    return discover(small.unionByName(large), s)


def test_presence(files: DataFrame, markers) -> DataFrame:
    """(path, has_test) for files that are no tests: whether a test is named after them."""
    tests = files.filter(t.is_test(F.col("path"), markers)).select(t.test_stem(F.col("path")).alias("s")).filter("s <> ''").distinct()
    own = files.filter(~t.is_test(F.col("path"), markers)).select("path", F.lower(t.stem(F.col("path"))).alias("stem"))
    return own.join(tests, own["stem"] == tests["s"], "left").select("path", F.col("s").isNotNull().alias("has_test"))
