"""Learning from a repository's own past: labels after a cutoff, features before it, folds, a classifier and its explanation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions import scoring
from riskspark.operators import boost, history
from riskspark.storage import release, stored

DAY = 86_400
LEAST_SAMPLES, LEAST_POSITIVES = 40, 8
# The features in their order.
FEATURES = (
    "loc", "function_count", "max_function_length", "max_nesting_depth", "cyclomatic_complexity", "max_function_complexity", "cognitive_complexity", "branch_count", "loop_count", "try_blocks", "risky_calls_per_100loc",
    "global_variables", "duplicate_line_ratio", "comment_ratio", "max_parameters", "dependency_count", "dependent_count", "commit_count", "bugfix_commit_count", "bugfix_ratio", "revert_count", "author_count",
    "ownership_ratio", "churn_per_commit", "days_since_last_change", "age_days", "recent_commits_90d", "fix_follow_rate",
)


def labels(changes: DataFrame, cutoff: int) -> DataFrame:
    """Paths that a fix touches at or after the cutoff."""
    return changes.filter(F.col("is_fix") & (F.col("ts") >= cutoff)).select("path").distinct().withColumn("label", F.lit(1))


def past(changes: DataFrame, cutoff: int, follow: int = 7 * DAY) -> DataFrame:
    """The history before the cutoff, as seen at the cutoff."""
    before = changes.filter(F.col("ts") < cutoff)
    return history.profile(before, cutoff).join(history.fix_follow(before, follow).select("path", F.col("rate").alias("fix_follow_rate")), "path")


def training_set(changes: DataFrame, cutoff: int) -> DataFrame:
    return past(changes, cutoff).join(labels(changes, cutoff), "path", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def features(static: DataFrame, past: DataFrame, degrees: DataFrame | None = None) -> DataFrame:
    """path and FEATURES in order; what is not measured is 0, ownership 1."""
    out = past.join(static, "path") if degrees is None else past.join(static, "path").join(degrees, "path", "left")
    has = lambda c, d="0": f"coalesce({c}, {d})" if c in out.columns else d
    e = {
        "cognitive_complexity": has("cognitive_complexity", has("cyclomatic_complexity")), "loop_count": has("loop_count"), "risky_calls_per_100loc": f"100.0 * {has('risky_calls')} / greatest(1, {has('loc')})",
        "duplicate_line_ratio": has("duplicate_ratio"), "dependency_count": has("fan_out"), "dependent_count": has("fan_in"), "commit_count": "commits", "bugfix_commit_count": "fixes", "bugfix_ratio": "fix_ratio", "revert_count": "reverts",
        "author_count": "authors", "ownership_ratio": "coalesce(ownership, 1)", "churn_per_commit": "churn / greatest(1, commits)", "days_since_last_change": "least(days_since_last, 2000)", "age_days": "least(age_days, 5000)", "recent_commits_90d": "recent_90d",
    }
    return out.selectExpr("path", *(["label"] if "label" in out.columns else []), *(f"cast({e.get(f, has(f))} AS double) AS {f}" for f in FEATURES))


def statistics(rows: DataFrame) -> DataFrame:
    """(feature, mean, deviation) of each feature, of the population."""
    stack = ", ".join(f"'{f}', {f}" for f in FEATURES)
    long = rows.selectExpr(f"stack({len(FEATURES)}, {stack}) AS (feature, value)")
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))


def folds(rows: DataFrame, k: int) -> DataFrame:
    """Each label's rows dealt over k folds, by a hash of the path: no window over a whole label."""
    return rows.withColumn("fold", F.conv(F.substring(F.md5("path"), 1, 8), 16, 10).cast("long") % k)


def gates(rows: DataFrame) -> str | None:
    """Why there is too little to learn from, or None."""
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n == 0:
        return "no history before the cutoff"
    if n < LEAST_SAMPLES:
        return f"{n} samples; {LEAST_SAMPLES} are needed"
    if positive < LEAST_POSITIVES:
        return f"{positive} fixed files; {LEAST_POSITIVES} are needed"
    return "every file was fixed" if positive == n else None


def pipeline(trees: int = 200, depth: int = 3, rate: float = 0.06, share: float = 0.9, seed: int = 42) -> dict:
    """The settings of a fit."""
    return {"trees": trees, "depth": depth, "rate": rate, "share": share, "seed": seed}


@dataclass
class Trained:
    model: boost.Model
    held: DataFrame  # path, label, p: each from a model that hasn't seen the file
    baseline: float
    rows: DataFrame | None = None  # what it was trained on, stored

    def importances(self) -> list[float]:
        return self.model.importances()

    def save(self, path: str) -> None:
        spark = self.held.sparkSession
        spark.createDataFrame([(self.model.as_json(),)], "model string").write.mode("overwrite").json(f"{path}/model")
        self.held.write.mode("overwrite").parquet(f"{path}/held")
        spark.createDataFrame([(self.baseline,)], "baseline double").write.mode("overwrite").json(f"{path}/about")


def load(spark, path: str) -> Trained | None:
    """None where no sound model lies."""
    try:
        return Trained(boost.Model.from_json(spark.read.json(f"{path}/model").first()["model"]), spark.read.parquet(f"{path}/held"), spark.read.json(f"{path}/about").first()[0])
    except Exception:  # noqa: BLE001  whatever is wrong with it, it is no model
        return None


def train(rows: DataFrame, **options) -> Trained:
    """Out-of-fold predictions from k fits and a fit on all, grown together. rows: path, label and FEATURES."""
    rows = stored(rows.withColumn("label", F.col("label").cast("double")), "rows")
    release(rows.sparkSession)
    n, positive = rows.agg(F.count("*"), F.sum("label")).first()
    k = int(max(2, min(5, positive, n - positive)))
    model, held = boost.train(folds(rows, k), list(FEATURES), k, n, **pipeline(**options))
    return Trained(model, held, positive / n, rows)


def predict(trained: Trained, rows: DataFrame) -> DataFrame:
    """(path, p, held_out): training files keep what was predicted while they were held out; clamped."""
    fresh = trained.model.transform(rows.select("path", *FEATURES)).select("path", F.col("p").alias("fresh"))
    out = fresh.join(trained.held.select("path", F.col("p").alias("own")), "path", "left")
    return out.select("path", F.expr(scoring.clamp("coalesce(own, fresh)")).alias("p"), F.col("own").isNotNull().alias("held_out"))


def measures(held: DataFrame) -> DataFrame:
    """One row: auc, accuracy, precision, recall of p against label."""
    auc = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label").evaluate(held)
    yes, hit = F.col("p") >= 0.5, F.col("label") == 1
    return held.agg(F.lit(auc).alias("auc"), F.avg((yes == hit).cast("double")).alias("accuracy"), (F.count_if(yes & hit) / F.greatest(F.count_if(yes), F.lit(1))).alias("precision"), (F.count_if(yes & hit) / F.greatest(F.count_if(hit), F.lit(1))).alias("recall"))


def auc(rows: DataFrame, score: str, label: str = "label") -> DataFrame:
    """The rank sum's AUC: counts at each distinct score, dealt by ranges of the score, a running sum in each range, and the sums of the ranges before it."""
    at = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    at = stored(at.repartitionByRange("s").withColumn("range", F.spark_partition_id()), "ranges")
    before = at.groupBy("range").agg(F.sum("n").alias("whole")).withColumn("before", F.sum("whole").over(Window.orderBy("range")) - F.col("whole"))  # a row for each range
    below = at.withColumn("below", F.sum("n").over(Window.partitionBy("range").orderBy("s")) - F.col("n")).join(F.broadcast(before), "range").withColumn("below", F.col("below") + F.col("before"))
    return below.agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))


def explain(trained: Trained, rows: DataFrame, k: int = 5) -> DataFrame:
    """(path, rank, feature, share, raises): importance times standard score, the k largest by size."""
    stats = {r.feature: (r["mean"], r.deviation or 1.0) for r in statistics(rows).collect()}  # one row for each feature
    each = [F.struct(F.lit(f).alias("feature"), (w * (F.col(f) - stats[f][0]) / stats[f][1]).alias("share")) for f, w in zip(FEATURES, trained.importances(), strict=True)]
    parts = F.filter(F.array(*each), lambda x: F.abs(x["share"]) >= 1e-6)
    ordered = F.array_sort(parts, lambda x, y: F.when(F.abs(x["share"]) > F.abs(y["share"]), -1).when(F.abs(x["share"]) < F.abs(y["share"]), 1).otherwise(0))
    return rows.select("path", F.posexplode(F.slice(ordered, 1, k)).alias("pos", "x")).select("path", (F.col("pos") + 1).alias("rank"), "x.feature", "x.share", (F.col("x.share") > 0).alias("raises"))
