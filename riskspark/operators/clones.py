"""Repeated blocks of lines, within and across files. Windows are made inside each row, so only fingerprints shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions import text as t

WINDOW, LEAST_DISTINCT, MOST_PLACES = 6, 3, 40


def fingerprints(sources: DataFrame) -> DataFrame:
    """(path, digest, start): windows of WINDOW lines that are longer than 3 characters when normalised."""
    numbered = F.transform(t.lines(F.col("text")), lambda raw, i: F.struct((i + 1).alias("line"), t.normalised(raw).alias("norm")))
    kept = sources.select("path", F.filter(numbered, lambda r: F.length(r["norm"]) > 3).alias("kept")).filter(F.size("kept") >= WINDOW)
    starts = kept.select("path", "kept", F.explode(F.sequence(F.lit(1), F.size("kept") - (WINDOW - 1))).alias("i"))
    window = starts.select("path", F.slice("kept", F.col("i"), F.lit(WINDOW)).alias("w"))
    norms = F.transform("w", lambda r: r["norm"])
    return window.filter(F.size(F.array_distinct(norms)) >= LEAST_DISTINCT).select("path", F.md5(F.array_join(norms, "\n")).alias("digest"), F.col("w")[0]["line"].alias("start"))


def internal(sources: DataFrame) -> DataFrame:
    """(path, blocks, ratio): repeated windows of one file, and the share of its lines that they cover."""
    repeated = fingerprints(sources).groupBy("path", "digest").agg(F.collect_list("start").alias("starts")).filter(F.size("starts") > 1)
    found = repeated.select("path", (F.size("starts") - 1).alias("extra"), F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (WINDOW - 1)))).alias("covered"))
    found = found.groupBy("path").agg(F.sum("extra").alias("blocks"), F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("lines"))
    total = sources.select("path", F.greatest(F.lit(1), F.size(F.filter(t.lines(F.col("text")), lambda raw: t.normalised(raw) != ""))).alias("total"))
    out = total.join(found, "path", "left")
    return out.select("path", F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"), F.least(F.lit(1.0), F.coalesce("lines", F.lit(0)) / F.col("total")).alias("ratio"))


def pairs(prints: DataFrame) -> DataFrame:
    """(a, b, windows, lines, partner_lines): windows that two files share; frequent digests are boilerplate and left out before the join."""
    useful = prints.groupBy("digest").agg(F.count("*").alias("n"), F.min("path").alias("x"), F.max("path").alias("y")).filter((F.col("n") <= MOST_PLACES) & (F.col("x") < F.col("y"))).select("digest")
    kept = prints.join(useful, "digest", "left_semi")
    a = kept.select("digest", F.col("path").alias("a"), F.col("start").alias("line"))
    b = kept.select("digest", F.col("path").alias("b"), F.col("start").alias("partner_line"))
    ten = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, 10)
    return a.join(b, "digest").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("windows"), ten("line").alias("lines"), ten("partner_line").alias("partner_lines"))


def partners(pairs: DataFrame, k: int = 5) -> DataFrame:
    """Both directions, each file's k best."""
    both = pairs.select(F.col("a").alias("path"), F.col("b").alias("partner"), "windows", "lines", "partner_lines").unionByName(
        pairs.select(F.col("b").alias("path"), F.col("a").alias("partner"), "windows", F.col("partner_lines").alias("lines"), F.col("lines").alias("partner_lines")))
    w = Window.partitionBy("path").orderBy(F.desc("windows"), "partner")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
