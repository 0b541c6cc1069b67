"""Files that change together, and people who share files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_FILES = 25  # larger commits say nothing of coupling; the bound also keeps the join linear


def pairs(changes: DataFrame) -> DataFrame:
    """(path, partner, n), both directions, from commits of 2 to MOST_FILES files."""
    sizes = changes.groupBy("sha").agg(F.count("*").alias("size")).filter(F.col("size").between(2, MOST_FILES)).select("sha")
    kept = changes.select("sha", "path").join(sizes, "sha", "left_semi")
    a, b = kept.withColumnRenamed("path", "a"), kept.withColumnRenamed("path", "b")
    n = a.join(b, "sha").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return n.select(F.explode(F.array(F.struct(F.col("a").alias("path"), F.col("b").alias("partner")), F.struct(F.col("b").alias("path"), F.col("a").alias("partner")))).alias("p"), "n").select("p.path", "p.partner", "n")


def strength(changes: DataFrame) -> DataFrame:
    """n over the path's own commits: not symmetric."""
    own = changes.groupBy("path").agg(F.count("*").alias("commits"))
    return pairs(changes).join(own, "path").select("path", "partner", "n", (F.col("n") / F.col("commits")).alias("strength"))


def top_partners(pairs: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("path").orderBy(F.desc("n"), "partner")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def coupled_developers(changes: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, shared, sample): authors with `least` files or more in common, and the first five by name."""
    own = changes.select("path", "author").distinct()
    both = own.withColumnRenamed("author", "a").join(own.withColumnRenamed("author", "b"), "path").filter("a < b")
    first = Window.partitionBy("a", "b").orderBy("path")
    few = both.withColumn("rank", F.row_number().over(first)).filter("rank <= 5").groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("sample"))
    shared = both.groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    return shared.join(few, ["a", "b"])
