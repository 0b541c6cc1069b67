"""A repository from end to end: files, measurements, clones, history, coverage, graph and model to scored files with their evidence."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions import commits as c
from riskspark.functions import scoring
from riskspark.functions import text as t
from riskspark.operators import clones, cochange, extract, graph, history, learn, report, rules
from riskspark.settings import TEST_MARKERS, Settings
from riskspark.sources import coverage, files, git
from riskspark.storage import stored

DAY = 86_400


@dataclass
class Scan:
    scored: DataFrame
    edges: DataFrame  # src, dst, kind, weight, cochange
    strengths: DataFrame | None  # path, partner, strength: None without history
    about: dict = field(default_factory=dict)

    def impact(self, seeds: list[str], limit: int | None = None) -> DataFrame:
        """Affected files with impact, hops and reasons; seeds that are no files are left out."""
        spark = self.scored.sparkSession
        asked = spark.createDataFrame([(s,) for s in seeds], "node string").join(self.scored.select(F.col("path").alias("node")), "node", "left_semi")
        imports, risk = self.edges.filter("kind = 'import'"), self.scored.select(F.col("path").alias("node"), F.col("score").alias("own_risk"))
        best = None if self.strengths is None else cochange.top_partners(self.strengths).select("path", "partner", F.round("strength", 3).alias("strength"))
        out = graph.impact(imports, asked, risk, best, risk.select("node"), limit=limit, ways=True)
        return graph.reasons(out, best, asked if best is not None else None).drop("reached")

    def document(self, with_metrics: bool = False) -> dict:
        return report.document(self.scored, self.about, with_metrics)

    def save(self, path: str | Path, with_metrics: bool = False) -> Path:
        """One pretty JSON file."""
        Path(path).write_text(json.dumps(self.document(with_metrics), indent=1, ensure_ascii=False), encoding="utf-8")
        return Path(path)


def changes(spark: SparkSession, root: str, settings: Settings) -> tuple[DataFrame | None, str | None]:
    """The commit log with each change's kind, or why there is none."""
    if not settings.use_git:
        return None, "history is switched off"
    if reason := git.no_history(root):
        return None, reason
    spark.dataSource.register(git.GitLog)
    log = spark.read.format("git_log").option("path", root).option("days", settings.history_days).load()
    log = log.withColumns({"is_fix": c.is_fix(F.col("subject"), settings.extra_fix_pattern), "is_revert": c.is_revert(F.col("subject"))})
    log = stored(log, "log")
    return (log, None) if not log.isEmpty() else (None, f"no commits in {settings.history_days} days")


def measured(spark: SparkSession, root: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(path, language, status, text) of all files, and their measurements with clones."""
    found = stored(extract.gates(files.read(spark, root, settings), settings.max_file_bytes).withColumn("status", F.when(F.col("n_bytes") > settings.max_file_bytes, "skipped: too large").otherwise(F.col("status"))).select("path", "language", "status", "text"), "files")
    sound = found.filter("status = 'ok' AND text IS NOT NULL")
    inside = clones.internal(sound).select("path", F.col("blocks").alias("duplicate_blocks"), F.col("ratio").alias("duplicate_ratio"))
    across = clones.partners(clones.pairs(stored(clones.fingerprints(sound), "fingerprints"))).groupBy("path").agg(F.count("*").alias("clones"))
    out = extract.extract(sound).drop("language").join(inside, "path", "left").join(across, "path", "left")
    return found, stored(out, "measured")


def dependencies(measures: DataFrame, found: DataFrame) -> DataFrame:
    """(src, dst) of imports that resolve to a file."""
    own = found.select("path")
    asked = measures.join(found.select("path", "language"), "path").select(F.col("path").alias("importer"), "language", F.explode("imports").alias("spec")).distinct()
    script = F.col("language").isin("javascript", "typescript", "tsx")
    of = lambda which: asked.filter(which).select("importer", "spec")
    hits = graph.resolve_python(of(F.col("language") == "python"), own).unionByName(graph.resolve_javascript(of(script), own))
    hits = hits.unionByName(graph.resolve_generic(of(~script & (F.col("language") != "python")), own))
    return hits.select(F.col("importer").alias("src"), F.col("target").alias("dst")).filter("src <> dst").distinct()


def scan(spark: SparkSession, root: str, settings: Settings | None = None, as_of: int | None = None, coverage_file: str | None = None, model: learn.Trained | None = None) -> Scan:
    """as_of: the epoch second that ages count from, now if not given."""
    s, root, began = settings or Settings(), str(Path(root).resolve()), time.time()
    as_of = int(began) if as_of is None else as_of
    found, measures = measured(spark, root, s)
    log, reason = changes(spark, root, s)
    wide = found.select("path", "language", "status").join(measures, "path", "left").join(files.test_presence(found.select("path"), TEST_MARKERS), "path", "left")
    strengths = top = None
    if log is not None:
        follow = history.fix_follow(log, 7 * DAY).select("path", F.col("rate").alias("fix_follow_rate"))
        wide = wide.join(history.profile(log, as_of), "path", "left").join(follow, "path", "left").join(history.last_commit(log).withColumnsRenamed({"sha": "last_sha", "subject": "last_subject"}), "path", "left")
        strengths = stored(cochange.strength(log), "strengths")
        top = cochange.top_partners(strengths).select("path", "partner", "n")
    located = coverage.locate(root, coverage_file)
    if located is not None:
        one = spark.createDataFrame([(located.name, located.read_text(errors="replace"))], "name string, text string")
        covered = coverage.read(one).select(t.normal_path(F.col("path"), root).alias("path"), F.col("fraction").alias("coverage")).groupBy("path").agg(F.max("coverage").alias("coverage"))
        wide = wide.join(covered, "path", "left")
    imports = stored(dependencies(measures, found), "imports")
    none = spark.createDataFrame([], "path string, partner string, n bigint")
    edges = stored(graph.build(found.select("path"), imports, top if top is not None else none), "edges")
    nodes = found.select(F.col("path").alias("node"))
    degree = graph.degrees(imports).select(F.col("node").alias("path"), F.col("fan_in").alias("dependents"), "fan_out")
    between = graph.centrality(imports, nodes).withColumnRenamed("node", "path")
    wide = wide.join(degree, "path", "left").join(between, "path", "left")
    if model is not None and s.use_ml and log is not None:
        past = learn.past(log, as_of)
        rows = learn.features(measures.drop("fan_in", "fan_out"), past, degree.select("path", F.col("dependents").alias("fan_in"), "fan_out"))
        wide = wide.join(learn.predict(model, rows).select("path", F.expr(scoring.risk_points("p", repr(float(model.baseline)) + "D")).alias("ml_points")), "path", "left")
    scored = stored(rules.scores(rules.hits(wide.withColumn("skipped", F.col("status") != "ok"), s, skipped="skipped"), s), "scored")
    about = {"root": root, "as_of": as_of, "history": reason or "available", "coverage": located.name if located else None, "model": model is not None, "seconds": round(time.time() - began, 2)}
    if log is not None:
        per_commit = log.select("sha", "author", "ts", "is_fix", "is_revert").distinct()
        about["commits"] = history.summary(per_commit).first().asDict() | {"top": [r.asDict() for r in history.top_contributors(per_commit).collect()]}
    about["parsers"] = {r.parser: r.files for r in measures.groupBy("parser").agg(F.count("*").alias("files")).collect()}
    about["graph"] = {"nodes": found.count(), **{r.kind: r.n for r in edges.groupBy("kind").agg(F.count("*").alias("n")).collect()}}
    return Scan(scored, edges, strengths, about)


def train(spark: SparkSession, root: str, settings: Settings | None = None, as_of: int | None = None, label_days: int = 180, **options) -> tuple[learn.Trained | None, str | None]:
    """A model from the repository's own past, or why there is none."""
    s = settings or Settings()
    log, reason = changes(spark, root, Settings(**(s.__dict__ | {"history_days": max(s.history_days, 1460)})))
    if log is None:
        return None, reason
    cutoff = (int(time.time()) if as_of is None else as_of) - label_days * DAY
    found, measures = measured(spark, root, s)
    degree = graph.degrees(dependencies(measures, found)).withColumnRenamed("node", "path")
    rows = learn.features(measures, learn.training_set(log, cutoff), degree)
    if reason := learn.gates(rows.select("path", "label")):
        return None, reason
    return learn.train(rows, **options), None
