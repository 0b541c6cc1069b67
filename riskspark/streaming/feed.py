"""Commits as a stream: the history's counts kept up as changes arrive. changes: path, author, is_fix, at (timestamp)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(changes: DataFrame, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Commits and fixes of each path and window; a window is final when the watermark passes it."""
    return changes.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "path").agg(F.count("*").alias("commits"), F.count_if("is_fix").alias("fixes")).select("path", F.col("w.start").alias("start"), "commits", "fixes")


def bursts(changes: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions of one author's work."""
    return changes.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "author").agg(F.count("*").alias("commits")).select("author", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "commits")


def followed(changes: DataFrame, horizon: str = "7 days", late: str = "1 day") -> DataFrame:
    """Edits that a fix of the same path follows within the horizon: a stream-stream join with bounded state."""
    edits = changes.filter(~F.col("is_fix")).select("path", F.col("at").alias("edited")).withWatermark("edited", late)
    fixes = changes.filter("is_fix").select(F.col("path").alias("p"), F.col("at").alias("fixed")).withWatermark("fixed", late)
    return edits.join(fixes, F.expr(f"path = p AND fixed > edited AND fixed <= edited + INTERVAL {horizon}")).select("path", "edited", "fixed")
