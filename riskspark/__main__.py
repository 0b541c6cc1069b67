"""The command line: scan, explain, heatmap, impact, train, serve, report, init, version."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import scan as scans
from riskspark import server, settings
from riskspark.operators import learn, report

VERSION = "0.2.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("riskspark", description="Ranks the files of a code base by defect risk.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str) -> argparse.ArgumentParser:
        one = sub.add_parser(name)
        for n in names:
            one.add_argument(n, **({"nargs": "+"} if n == "files" else {}))
        one.add_argument("--root", default=".")
        one.add_argument("--settings")
        one.add_argument("--coverage")
        one.add_argument("--model")
        one.add_argument("--no-git", action="store_true")
        one.add_argument("--json", action="store_true")
        return one

    s = command("scan")
    s.add_argument("--limit", type=int, default=20)
    s.add_argument("--min-score", type=float, default=0.0)
    s.add_argument("--band")
    s.add_argument("--fail-over", type=float)
    s.add_argument("--output")
    s.add_argument("--html")
    command("explain", "file")
    command("heatmap").add_argument("--depth", type=int, default=4)
    command("impact", "files").add_argument("--limit", type=int, default=25)
    command("train").add_argument("--output", required=True)
    command("serve").add_argument("--port", type=int, default=8710)
    command("report").add_argument("--output", default="risk.html")
    sub.add_parser("init").add_argument("--output", default="riskspark.toml")
    sub.add_parser("version")
    return p


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("riskspark").config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(args: list[str] | None = None) -> int:
    """0; 1 if a file is above --fail-over or there is nothing to learn from; 2 if a name fits no file or several."""
    a = parser().parse_args(args)
    if a.command == "version":
        print(VERSION)
        return 0
    if a.command == "init":
        try:
            print(settings.starter(a.output))
        except FileExistsError:
            print(f"{a.output} exists", file=sys.stderr)
            return 2
        return 0
    spark = session()
    settings.load_env(Path(a.root) / ".env")
    s = settings.load(a.settings or Path(a.root) / "riskspark.toml", use_git=False if a.no_git else None)
    if a.command == "train":
        model, reason = scans.train(spark, a.root, s)
        if model is None:
            print(reason, file=sys.stderr)
            return 1
        model.save(a.output)
        print(json.dumps(learn.measures(model.held).first().asDict()))
        return 0
    make = lambda: scans.scan(spark, a.root, s, coverage_file=a.coverage, model=learn.load(spark, a.model) if a.model else None)
    if a.command == "serve":
        server.serve(server.Cache(make), a.port).serve_forever()
        return 0
    return {"scan": _scan, "explain": _explain, "heatmap": _heatmap, "impact": _impact, "report": _report}[a.command](make(), a)


def _shown(df: DataFrame, as_json: bool, line) -> None:
    for r in df.collect():
        print(json.dumps(r.asDict(True), default=str) if as_json else line(r))


def _ranked(df: DataFrame) -> DataFrame:
    return report.decorated(df).withColumn("bar", report.bar(F.col("score")))


def _scan(found: scans.Scan, a) -> int:
    if a.output:
        found.save(a.output)
    if a.html:
        report.html(found.scored, a.html)
    some = report.filtered(found.scored, a.min_score, a.band)
    shown, more = report.listed(some, a.limit)
    _shown(_ranked(shown).orderBy(F.desc("score"), "path"), a.json, lambda r: f"{r.glyph} {r.bar} {r.score:6.1f}  {r.path}")
    if not a.json:
        print(f"history: {found.about['history']}" + (f"; and {more} more" if more else ""))
    return int(a.fail_over is not None and bool(report.gate(found.scored, a.fail_over).take(1)))


def _named(found: scans.Scan, name: str) -> str | None:
    some = report.lookup(found.scored, name).select("path").limit(2).collect()
    if len(some) != 1:
        print(f"{name}: {'several files match' if some else 'no such file'}", file=sys.stderr)
    return some[0].path if len(some) == 1 else None


def _explain(found: scans.Scan, a) -> int:
    if (path := _named(found, a.file)) is None:
        return 2
    own = found.scored.filter(F.col("path") == path).select("path", "score", "band", "hits")
    _shown(own, a.json, lambda r: f"{r.path}  {r.score:.1f} {r.band}\n" + "\n".join(f"  {h.points:5.1f}  {h.title}: {h.detail}" for h in r.hits))
    return 0


def _heatmap(found: scans.Scan, a) -> int:
    _shown(report.rollup(found.scored, a.depth).orderBy("dir"), a.json, lambda r: f"{r.worst:6.1f}  {r.files:5d}  {r.dir}")
    return 0


def _impact(found: scans.Scan, a) -> int:
    seeds = [_named(found, f) for f in a.files]
    if None in seeds:
        return 2
    _shown(found.impact(seeds, a.limit).orderBy(F.desc("impact"), "node"), a.json, lambda r: f"{r.impact:6.1f}  {r.node}: {'; '.join(r.reasons)}")
    return 0


def _report(found: scans.Scan, a) -> int:
    print(report.html(found.scored, a.output))
    return 0


if __name__ == "__main__":
    sys.exit(main())
