"""What is shown of scored files: order, summary, rollups, lookups. scored: path, language, score, band, hits."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BANDS = ("low", "medium", "high", "critical")


def ranking(scored: DataFrame, limit: int | None = None) -> DataFrame:
    out = scored.select("path", "score", "band").orderBy(F.desc("score"), "path")
    return out.limit(limit) if limit else out


def filtered(scored: DataFrame, least: float = 0.0, band: str | None = None, at_least: str | None = None, search: str | None = None) -> DataFrame:
    """By score, band, band or above, and a word in the path or in a hit's rule or title."""
    out = scored.filter(F.col("score") >= least)
    if band:
        out = out.filter(F.col("band") == band.lower())
    if at_least:
        out = out.filter(F.col("band").isin(*BANDS[BANDS.index(at_least.lower()) :]))
    if search:
        word = search.lower()
        out = out.filter(F.contains(F.lower("path"), F.lit(word)) | F.exists("hits", lambda h: F.contains(h["rule_id"], F.lit(word)) | F.contains(F.lower(h["title"]), F.lit(word))))
    return out


def lookup(scored: DataFrame, name: str) -> DataFrame:
    """The file of exactly that path, else the only one whose path ends in the name (whole parts), else all whose path holds it: one row is an answer, more are ambiguous."""
    exact = scored.filter(F.col("path") == name)
    if not exact.isEmpty():
        return exact
    ending = scored.filter(F.endswith("path", F.lit(f"/{name}")))
    return ending if len(ending.select("path").take(2)) == 1 else scored.filter(F.contains("path", F.lit(name)))


def listed(scored: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The first `limit` files of the ranking, and how many more there are."""
    return ranking(scored, limit), max(0, scored.count() - limit)


def gate(scored: DataFrame, limit: float, show: int = 10) -> DataFrame:
    """The worst files above the limit; none means pass."""
    return scored.filter(F.col("score") > limit).select("path", "score").orderBy(F.desc("score"), "path").limit(show)


def summary(scored: DataFrame, lines: str = "loc") -> DataFrame:
    """files, mean score, upper median (the value at n // 2 of the sorted scores), lines. All from one pass to counts of distinct scores, of which there are 10,001 at most."""
    counts = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum(lines).alias("lines"))
    everything = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("score"))).withColumn("total", F.sum("n").over(everything))
    median = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("score")))
    return upto.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 2).alias("mean"), F.sum("lines").alias("lines"), median.alias("median"))


def bands(scored: DataFrame) -> DataFrame:
    """All four, also those without files."""
    return scored.sparkSession.createDataFrame([(b,) for b in BANDS], "band string").join(scored.groupBy("band").agg(F.count("*").alias("n")), "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("files"))


def histogram(scored: DataFrame, column: str) -> DataFrame:
    return scored.groupBy(column).agg(F.count("*").alias("files"))


def top_rules(scored: DataFrame, k: int = 10) -> DataFrame:
    return scored.select(F.explode("hits.rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "rule_id").limit(k)


def hotspots(scored: DataFrame, k: int = 15, titles: int = 3) -> DataFrame:
    out = scored.orderBy(F.desc("score"), "path").limit(k)
    return out.select("path", "score", "band", F.array_join(F.transform(F.slice("hits", 1, titles), lambda h: h["title"]), "; ").alias("titles"))


def top_reasons(scored: DataFrame, k: int = 3) -> DataFrame:
    return scored.select("path", F.posexplode(F.slice("hits", 1, k)).alias("pos", "h")).select("path", (F.col("pos") + 1).alias("rank"), "h.rule_id", "h.points")


def directories(scored: DataFrame) -> DataFrame:
    own = scored.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), "score")
    return own.groupBy("dir").agg(F.count("*").alias("files"), F.max("score").alias("worst"))


def rollup(scored: DataFrame, depth: int = 4) -> DataFrame:
    """Every ancestor directory down to `depth`: files below and the worst score."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.least(F.lit(depth), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return scored.filter(F.size(parts) > 1).select(F.explode(above).alias("dir"), "score").groupBy("dir").agg(F.count("*").alias("files"), F.max("score").alias("worst"))


def top_of_directories(scored: DataFrame, each: int = 12, total: int = 60) -> DataFrame:
    out = scored.select("path", "score", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("score"), "path"))).filter(F.col("rank") <= each)
    return ranked.orderBy(F.desc("score"), "path").limit(total)


def explain(scored: DataFrame, path: str) -> DataFrame:
    return scored.filter(F.col("path") == path).select("path", "score", "band", F.explode("hits").alias("h")).select("path", "score", "band", "h.rule_id", "h.points", "h.severity")


def as_json(scored: DataFrame, with_metrics: bool = True) -> DataFrame:
    keep = scored.columns if with_metrics else ["path", "language", "score", "band", "hits"]
    return scored.select("path", F.to_json(F.struct(*keep)).alias("json"))


def from_json(rows: DataFrame, schema) -> DataFrame:
    """Unknown keys are dropped, missing ones are null."""
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")


GLYPHS, COLOURS = {"low": "\U0001f7e2", "medium": "\U0001f7e1", "high": "\U0001f7e0", "critical": "\U0001f534"}, {"low": "green", "medium": "yellow", "high": "orange", "critical": "red"}


def decorated(scored: DataFrame) -> DataFrame:
    """scored with a glyph and a colour for each band."""
    of = lambda table: F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col("band"))
    return scored.withColumns({"glyph": of(GLYPHS), "colour": of(COLOURS)})


def bar(score, width: int = 20):
    """A score of 0 to 100 as filled and empty cells."""
    full = F.round(score / 100 * width).cast("int")
    return F.concat(F.repeat(F.lit("\u2588"), full), F.repeat(F.lit("\u2591"), F.lit(width) - full))


def tree(scored: DataFrame, depth: int = 4, limit: int = 5_000) -> dict:
    """Directories within directories: each with its files below, its worst score and its `children`; the worst `limit` directories of at most `depth` parts."""
    root: dict = {"name": "", "files": 0, "worst": 0.0, "children": {}}
    for r in rollup(scored, depth).orderBy(F.desc("worst"), "dir").limit(limit).collect():
        node = root
        for part in r.dir.split("/"):
            node = node["children"].setdefault(part, {"name": part, "files": 0, "worst": 0.0, "children": {}})
        node["files"], node["worst"] = r.files, r.worst
    root["files"], root["worst"] = (sum(c["files"] for c in root["children"].values()), max((c["worst"] for c in root["children"].values()), default=0.0))
    return root


def document(scored: DataFrame, about: dict | None = None, with_metrics: bool = False, limit: int | None = None) -> dict:
    """The whole report as one value: what it is about, summary, bands, languages, rules, hotspots, and the files, worst first."""
    one = lambda df: [r.asDict(True) for r in df.collect()]
    shown = scored.orderBy(F.desc("score"), "path")
    rows = as_json(shown.limit(limit) if limit else shown, with_metrics).select("json").toLocalIterator()
    return (about or {}) | {
        "summary": summary(scored).first().asDict(), "bands": {r.band: r.files for r in bands(scored).collect()}, "languages": {r.language: r.files for r in histogram(scored, "language").collect()},
        "rules": one(top_rules(scored)), "hotspots": one(hotspots(scored)), "files": [json.loads(r.json) for r in rows],
    }


def narration(scored: DataFrame, redact: bool = True) -> DataFrame:
    """The evidence that a text about a file may use; redacted paths keep only their suffix."""
    name = F.concat(F.lit("file-"), F.substring(F.sha2("path", 256), 1, 12), F.regexp_extract("path", r"(\.[^./]+)$", 1)) if redact else F.col("path")
    return scored.select(name.alias("name"), "score", "band", F.to_json(F.slice("hits", 1, 8)).alias("evidence"))


def html(scored: DataFrame, to: str | Path, limit: int = 300) -> Path:
    """One page without outside parts: summary, directories, and the first `limit` files with their reasons."""
    from html import escape

    cards = "".join(f"<div class=card><b>{escape(str(v))}</b><br>{escape(k)}</div>" for k, v in summary(scored).first().asDict().items())
    folders = "".join(f"<tr><td>{escape(r.dir or '.')}<td>{r.files}<td>{r.worst:.1f}" for r in directories(scored).orderBy(F.desc("worst"), "dir").limit(60).collect())
    shown, more = listed(scored, limit)
    own = scored.join(F.broadcast(shown.select("path")), "path", "left_semi").select("path", "score", "band", "hits").orderBy(F.desc("score"), "path")
    body = ""
    for r in own.collect():  # `limit` at most
        why = "".join(f"<li>{escape(h.title)}: {escape(h.detail)} ({h.points:.1f})" for h in r.hits)
        body += f'<tr class="{escape(r.band)}"><td>{escape(r.path)}<ul>{why}</ul></td><td>{r.score:.1f}</td><td>{escape(r.band)}</td></tr>'
    rest = f"<p>and {more} more</p>" if more else ""
    style = "body{font:14px sans-serif}td{padding:2px 12px;vertical-align:top}ul{margin:0;color:#555}.card{display:inline-block;padding:8px 16px}.critical{background:#fbb}.high{background:#fdb}.medium{background:#ffd}"
    page = f"<!DOCTYPE html><meta charset=utf-8><title>Risk</title><style>{style}</style>{cards}<table><tr><th>Folder<th>Files<th>Worst{folders}</table><table><tr><th>File<th>Score<th>Band</tr>{body}</table>{rest}"
    to = Path(to)
    to.write_text(page, encoding="utf-8")
    return to
