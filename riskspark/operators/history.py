"""Per-path aggregates of the commit history. changes: sha, path, author, ts, is_fix, is_revert, insertions, deletions, subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY, NEVER = 86_400, 999.0


def metrics(changes: DataFrame, as_of: int, unit: int = 1) -> DataFrame:
    """One aggregation for each path; unit: ticks of ts a second."""
    age = lambda t: (F.lit(as_of * unit) - t) / (DAY * unit)
    recent = lambda n: F.count_if(F.lit(as_of * unit) - F.col("ts") <= n * DAY * unit)
    out = changes.groupBy("path").agg(
        F.count("*").alias("commits"), F.count_if("is_fix").alias("fixes"), F.count_if("is_revert").alias("reverts"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"),
        age(F.max("ts")).alias("days_since_last"), age(F.min("ts")).alias("age_days"), recent(30).alias("recent_30d"), recent(90).alias("recent_90d"))
    return out.withColumns({"churn": F.col("insertions") + F.col("deletions"), "fix_ratio": F.col("fixes") / F.col("commits")})


def by_author(changes: DataFrame) -> DataFrame:
    return changes.groupBy("path", "author").agg(F.count("*").alias("n"))


def ownership(changes: DataFrame) -> DataFrame:
    """The share of the author with most commits, in two steps so that no path is gathered whole."""
    return by_author(changes).groupBy("path").agg(F.count("*").alias("authors"), (F.max("n") / F.sum("n")).alias("ownership"))


def top_authors(changes: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("path").orderBy(F.desc("n"), "author")
    return by_author(changes).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def profile(changes: DataFrame, as_of: int, unit: int = 1) -> DataFrame:
    """metrics() and ownership() of each path in one pass: counts for each author of a path first, then their sums."""
    recent = lambda n: F.count_if(F.lit(as_of * unit) - F.col("ts") <= n * DAY * unit)
    each = changes.groupBy("path", "author").agg(
        F.count("*").alias("n"), F.count_if("is_fix").alias("fixes"), F.count_if("is_revert").alias("reverts"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"),
        F.max("ts").alias("last"), F.min("ts").alias("first"), recent(30).alias("recent_30d"), recent(90).alias("recent_90d"))
    age = lambda t: (F.lit(as_of * unit) - t) / (DAY * unit)
    sums = [F.sum(c).alias(c) for c in ("fixes", "reverts", "insertions", "deletions", "recent_30d", "recent_90d")]
    out = each.groupBy("path").agg(F.sum("n").alias("commits"), *sums, age(F.max("last")).alias("days_since_last"), age(F.min("first")).alias("age_days"), F.count("author").alias("authors"), (F.max("n") / F.sum("n")).alias("ownership"))
    return out.withColumns({"churn": F.col("insertions") + F.col("deletions"), "fix_ratio": F.col("fixes") / F.col("commits")})


def fix_follow(changes: DataFrame, horizon: int) -> DataFrame:
    """The share of other edits that a fix of the same path follows within the horizon: a range frame, no join.

    A frame is of a path and a span of time as long as the horizon; a fix also stands in the span before its own, whose edits it can follow. So a path's whole history is never in one task."""
    span = F.floor(F.col("ts") / horizon)
    both = F.when(F.col("is_fix"), F.array(span, span - 1)).otherwise(F.array(span))
    placed = changes.select("path", "ts", "is_fix", F.explode(both).alias("span")).withColumn("own", F.col("span") == F.floor(F.col("ts") / horizon))
    w = Window.partitionBy("path", "span").orderBy("ts").rangeBetween(1, horizon)
    followed = placed.withColumn("followed", F.coalesce(F.max(F.col("is_fix").cast("int")).over(w), F.lit(0))).filter("own")
    return followed.groupBy("path").agg(F.count_if(~F.col("is_fix")).alias("edits"), F.count_if(~F.col("is_fix") & (F.col("followed") == 1)).alias("followed")).withColumn("rate", F.col("followed") / F.greatest("edits", F.lit(1)))


def fix_follow_semijoin(changes: DataFrame, horizon: int) -> DataFrame:
    """The edits that a fix follows, as a semi join on the path with a range, on buckets of the horizon's length."""
    edits = changes.filter(~F.col("is_fix")).select("sha", "path", "ts").withColumn("bucket", F.explode(F.array(F.floor(F.col("ts") / horizon), F.floor(F.col("ts") / horizon) + 1)))
    fixes = changes.filter("is_fix").select(F.col("path").alias("p"), F.col("ts").alias("t"), F.floor(F.col("ts") / horizon).alias("b"))
    near = (F.col("path") == F.col("p")) & (F.col("bucket") == F.col("b")) & (F.col("t") > F.col("ts")) & (F.col("t") <= F.col("ts") + horizon)
    return edits.join(fixes, near, "left_semi").select("sha", "path").distinct()


def last_commit(changes: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("sha", "subject"), F.struct("ts", "sha"))
    return changes.groupBy("path").agg(last.alias("last")).select("path", F.substring(F.col("last.sha").cast("string"), 1, 10).alias("sha"), F.substring("last.subject", 1, 160).alias("subject"))


def summary(commits: DataFrame) -> DataFrame:
    return commits.agg(
        F.count("*").alias("commits"), F.count_if("is_fix").alias("fixes"), (F.count_if("is_fix") / F.greatest(F.count("*"), F.lit(1))).alias("fix_ratio"), F.count_if("is_revert").alias("reverts"),
        F.count_distinct("author").alias("contributors"), F.coalesce((F.max("ts") - F.min("ts")) / DAY, F.lit(0.0)).alias("span_days"))


def top_contributors(commits: DataFrame, k: int = 5) -> DataFrame:
    return commits.groupBy("author").agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "author").limit(k)
