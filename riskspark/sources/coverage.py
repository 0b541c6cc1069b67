"""Coverage reports as (path, fraction). reports: name, text."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.text import normal_path

# Where reports are looked for, in order.
NAMES = ("coverage.xml", "cobertura.xml", "clover.xml", "lcov.info", "coverage/lcov.info", "coverage.json", "coverage/coverage-final.json")


def locate(root: str, explicit: str | None = None) -> Path | None:
    """The report that is named, else the first of NAMES below root; None without one."""
    named = [Path(explicit), Path(root) / explicit] if explicit else [Path(root) / n for n in NAMES]
    return next((p for p in named if p.is_file()), None)


def cobertura(reports: DataFrame) -> DataFrame:
    """Every class with its line rate (0 if missing or no number), also below each source folder; a broken report gives nothing."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch["text"]:
                try:
                    root = ET.fromstring(text or "")
                except ET.ParseError:
                    continue
                folders = ["", *(s.text.strip().rstrip("/") + "/" for s in root.iter("source") if s.text and s.text.strip() not in ("", "."))]
                for c in root.iter("class"):
                    try:
                        rate = float(c.get("line-rate") or 0)
                    except ValueError:
                        rate = 0.0
                    rows += [(folder + c.get("filename"), rate) for folder in folders if c.get("filename")]
            yield pd.DataFrame(rows, columns=["path", "fraction"])

    return _one(reports.select("text").mapInPandas(run, "path string, fraction double"))


def lcov(reports: DataFrame) -> DataFrame:
    records = reports.select(F.explode(F.split("text", "end_of_record")).alias("r"))
    number = lambda key: F.expr(rf"try_cast(regexp_extract(r, '(?m)^{key}:([0-9]+)', 1) AS double)")
    found = records.select(F.trim(F.regexp_extract("r", r"(?m)^SF:(.+)$", 1)).alias("path"), number("LF").alias("lf"), number("LH").alias("lh")).filter("path <> ''")
    return _one(found.select("path", F.when(F.col("lf") > 0, F.coalesce("lh", F.lit(0.0)) / F.col("lf")).otherwise(0.0).alias("fraction")))


def coverage_json(reports: DataFrame) -> DataFrame:
    parsed = F.from_json("text", "struct<files:map<string,struct<summary:struct<percent_covered:double>>>>")
    out = reports.select(F.explode(parsed["files"]).alias("path", "f")).select("path", (F.col("f.summary.percent_covered") / 100).alias("fraction"))
    return _one(out.filter("fraction IS NOT NULL"))


def istanbul(reports: DataFrame) -> DataFrame:
    """The share of statements that ran."""
    out = reports.select(F.explode(F.from_json("text", "map<string,struct<s:map<string,bigint>>>")).alias("path", "f")).filter("size(f.s) > 0")
    return _one(out.select("path", (F.size(F.map_filter("f.s", lambda _, n: n > 0)) / F.size("f.s")).alias("fraction")))


def read(reports: DataFrame) -> DataFrame:
    """By the names' endings: .xml, .info, .json of either kind; others give nothing."""
    of = lambda e: reports.filter(F.endswith("name", F.lit(e)))
    return _one(cobertura(of(".xml")).unionByName(lcov(of(".info"))).unionByName(coverage_json(of(".json"))).unionByName(istanbul(of(".json"))))


def _one(found: DataFrame) -> DataFrame:
    return found.select(normal_path(F.col("path")).alias("path"), "fraction").groupBy("path").agg(F.max("fraction").alias("fraction"))
