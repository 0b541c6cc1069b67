"""The engine's relations made from the benchmark tables, each with an equivalent statement for DuckDB.

commits(sha, author, ts, subject), changes(sha, path, insertions, deletions, author, ts, subject, is_fix, is_revert), files, metrics, edges
from orders, lineitem and part; user_changes from events; sources from documents. ts are epoch seconds (user_changes: microseconds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions import commits as commit_functions

AS_OF = 996_624_000  # 2001-08-01
DAY = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _epoch(column: str, unit: str = "SECOND") -> str:
    return f"timestampdiff({unit}, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})"


SUBJECT = """CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN concat('Revert "fix: order ', o_orderkey, '"')
  WHEN o_orderpriority = '1-URGENT' THEN concat('fix: order ', o_orderkey) WHEN o_orderpriority = '2-HIGH' THEN concat('Update order ', o_orderkey)
  WHEN o_orderpriority = '3-MEDIUM' THEN concat('feat: order ', o_orderkey) WHEN o_orderpriority = '4-NOT SPECIFIED' THEN concat('chore(deps): fix pin ', o_orderkey)
  ELSE concat('docs: order ', o_orderkey) END"""
PATH = """CASE WHEN p_partkey % 10 = 0 THEN concat('tests/', replace(lower(p_type), '#', '_'), '/test_part_', p_partkey + 1, '.py')
  ELSE concat('src/', replace(lower(p_brand), '#', '_'), '/', replace(lower(p_type), '#', '_'), '/part_', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.py' ELSE '.go' END) END"""
USER_SUBJECT = """CASE event_type WHEN 'error' THEN concat('fix: ', event_id) WHEN 'click' THEN concat('feat: ', event_id) WHEN 'view' THEN concat('chore: fix ', event_id)
  WHEN 'purchase' THEN concat('update ', event_id) ELSE concat('Revert ', event_id) END"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS sha", "concat('dev-', o_custkey % 7) AS author", f"{_epoch('o_orderdate')} AS ts", f"{SUBJECT} AS subject")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", f"{PATH} AS path", "p_size", "p_type")
    return out.selectExpr("k", "path", "p_size", "CASE WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.go' THEN 'go' ELSE 'python' END AS language", "CASE WHEN k % 4 <> 0 THEN (k % 100) / 100.0D END AS coverage")


def raw_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each commit and file: a log has one line for each."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum(F.floor("l_quantity")).cast("long").alias("insertions"), F.sum(F.floor(F.col("l_quantity") * F.col("l_discount"))).cast("long").alias("deletions"))
    paths = files(spark, sf_dir).select("k", "path")
    return lines.join(paths, lines["l_partkey"] == paths["k"]).select(F.col("l_orderkey").alias("sha"), "path", "insertions", "deletions")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raw_changes(spark, sf_dir).join(commits(spark, sf_dir), "sha")
    return out.withColumns({"is_fix": commit_functions.is_fix(F.col("subject")), "is_revert": commit_functions.is_revert(F.col("subject"))})


def keyed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """changes() with the file's key as path, without subjects: lines move once, by order, and each subject is read once. Keys that are no file's stay in."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS sha", "l_partkey AS path", "floor(l_quantity) AS insertions", "floor(l_quantity * l_discount) AS deletions").repartition("sha")
    each = lines.groupBy("sha", "path").agg(F.sum("insertions").cast("long").alias("insertions"), F.sum("deletions").cast("long").alias("deletions"))
    return each.join(commits(spark, sf_dir).select("sha", "author", "ts", commit_functions.is_fix(F.col("subject")).alias("is_fix"), commit_functions.is_revert(F.col("subject")).alias("is_revert")), "sha")


def user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS sha", "concat('user/', user_id) AS path", "concat('user-', user_id) AS author", f"{_epoch('ts', 'MICROSECOND')} AS ts", f"{USER_SUBJECT} AS subject", "event_type = 'error' AS is_fix")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements for every static rule, from the lines of each part."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("tr0"))
    out = files(spark, sf_dir).join(lines, F.col("k") == lines["l_partkey"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "q", "r", "tr0")})
    return out.selectExpr("k", "path", "language", "coverage", *(f"{e} AS {c}" for c, e in METRICS.items()))


METRICS = {
    "loc": "cast(q AS bigint)", "max_function_length": "cast(p_size * 4 AS bigint)", "nested_loop_depth": "cast(p_size % 6 AS bigint)", "max_nesting_depth": "cast(p_size % 8 AS bigint)", "branch_count": "greatest(n - 15, 0)",
    "max_function_complexity": "n", "cyclomatic_complexity": "2 * n", "risky_calls": "r", "try_blocks": "CASE WHEN p_size % 5 = 0 THEN 0 ELSE cast(floor(tr0 / 4.0) AS bigint) END",
    "bare_excepts": "CASE WHEN p_size % 11 = 0 THEN 1 ELSE 0 END", "swallowed_exceptions": "CASE WHEN p_size % 13 = 0 THEN 2 ELSE 0 END", "global_variables": "CASE WHEN p_size % 7 = 0 THEN p_size % 4 ELSE 0 END",
    "duplicate_ratio": "(p_size % 25) / 100.0", "max_parameters": "cast(p_size % 9 AS bigint)", "mutable_default_args": "CASE WHEN p_size % 17 = 0 THEN cast(floor(p_size / 17.0) AS bigint) ELSE 0 END",
    "magic_numbers": "cast(floor(n / 2.0) AS bigint)", "todo_comments": "greatest(p_size % 12 - 4, 0)", "comment_ratio": "(p_size % 20) / 200.0", "function_count": "cast(p_size AS bigint)", "class_count": "cast(p_size % 3 AS bigint)",
    "clones": "cast(p_size % 4 AS bigint)", "centrality": "(p_size % 50) / 100.0",
}


def edges(spark: SparkSession, sf_dir: str, quantity: int = 20) -> DataFrame:
    """(src, dst): from each part of an order to the next, where lines were returned and are of `quantity` or more."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    out = table(spark, sf_dir, "lineitem").withColumn("dst", F.lead("l_partkey").over(w)).filter(f"l_returnflag = 'R' AND l_quantity >= {quantity}")
    return out.select(F.col("l_partkey").alias("src"), "dst").filter("src <> dst").distinct()


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path", "coalesce(text, '') AS text", "lang AS language", "source")


#: The shape of each part's generated source: functions, parameters, a list as default, loops, conditions, a guard, and whether it is broken.
SHAPE = {"fs": "k % 4 + 1", "ps": "k % 5 + 1", "z": "CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END", "ls": "k % 3", "ds": "k % 6", "ts": "k % 2", "broken": "k % 11 = 0"}


def python_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, path, language, text): a Python source for each part, whose measurements follow from SHAPE."""
    pad = lambda n: f"repeat('    ', cast({n} AS int))"
    some = lambda n, each: f"CASE WHEN {n} = 0 THEN '' ELSE array_join(transform(sequence(0, cast({n} - 1 AS int)), j -> {each}), '') END"
    params = "array_join(transform(sequence(0, cast(ps - 1 AS int)), j -> concat('a', j, CASE WHEN z = 1 AND j = ps - 1 THEN '=[]' ELSE '' END)), ', ')"
    loops, ifs = some("ls", f"concat({pad('j + 1')}, 'for x', j, ' in y:\\n')"), some("ds", f"concat({pad('1 + ls + j')}, 'if x:\\n')")
    body = f"concat({loops}, {ifs}, {pad('1 + ls + ds')}, 'open(x).read(42)\\n', CASE WHEN ts = 1 THEN '    try:\\n        pass\\n    except:\\n        pass\\n' ELSE '' END)"
    out = files(spark, sf_dir).select("k", "path").selectExpr("k", "path", *(f"{e} AS {c}" for c, e in SHAPE.items())).selectExpr("*", f"{params} AS params", f"{body} AS body")
    text = "concat('import os\\nfrom ..core import io\\nCACHE = {}\\nlimit = list()\\n', array_join(transform(sequence(0, cast(fs - 1 AS int)), i -> concat('def f', i, '(', params, '):\\n    global state\\n', body)), ''), CASE WHEN broken THEN 'def f(:\\n' ELSE '' END)"
    return out.selectExpr("k", "path", "'python' AS language", f"{text} AS text")


REPORTS = {
    "coverage.xml": ("<coverage><packages>", "concat('<class filename=\"', path, '\" line-rate=\"', cast((k % 100) / 100.0D AS string), '\"/>')", "", "</packages></coverage>"),
    "lcov.info": ("", "concat('SF:./', path, '\\nLF:', k % 90 + 10, '\\nLH:', k % 10, '\\nend_of_record\\n')", "", ""),
    "coverage.json": ('{"files": {', "concat('\"', path, '\": {\"summary\": {\"percent_covered\": ', k % 100, '}}')", ", ", "}}"),
    "coverage-final.json": ("{", "concat('\"', path, '\": {\"s\": {\"0\": ', k % 3, ', \"1\": 0, \"2\": 1}}')", ", ", "}"),
}


def coverage_reports(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(name, text): reports of one kind, each about a few dozen parts."""
    head, each, between, tail = REPORTS[name]
    rows = files(spark, sf_dir).selectExpr("k DIV 32 AS part", f"{each} AS record").groupBy("part").agg(F.array_join(F.array_sort(F.collect_list("record")), between).alias("records"))
    return rows.select(F.lit(name).alias("name"), F.concat(F.lit(head), "records", F.lit(tail)).alias("text"))


_FIX, _NON, _REV = (p.replace("'", "''") for p in (commit_functions.FIX, commit_functions.NON_FIX, commit_functions.REVERT))
#: The same relations for DuckDB; those that a statement doesn't name cost nothing.
SQL = f"""
commits AS (SELECT o_orderkey AS sha, 'dev-' || (o_custkey % 7) AS author, CAST(epoch(o_orderdate) AS BIGINT) AS ts, {SUBJECT} AS subject FROM orders),
files0 AS (SELECT p_partkey AS k, {PATH} AS path, p_size FROM part),
files AS (SELECT *, CASE WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.go' THEN 'go' ELSE 'python' END AS language, CASE WHEN k % 4 <> 0 THEN (k % 100) / 100.0::DOUBLE END AS coverage FROM files0),
raw_changes AS (
  SELECT l_orderkey AS sha, path, CAST(sum(floor(l_quantity)) AS BIGINT) AS insertions, CAST(sum(floor(l_quantity * l_discount)) AS BIGINT) AS deletions
  FROM lineitem JOIN files ON k = l_partkey GROUP BY 1, 2),
changes AS (
  SELECT *, NOT regexp_matches(subject, '{_NON}') AND regexp_matches(subject, '{_FIX}') AS is_fix, regexp_matches(subject, '{_REV}') AS is_revert FROM raw_changes JOIN commits USING (sha)),
user_changes AS (SELECT event_id AS sha, 'user/' || user_id AS path, 'user-' || user_id AS author, CAST(epoch_us(ts) AS BIGINT) AS ts, {USER_SUBJECT} AS subject, event_type = 'error' AS is_fix FROM events),
part_lines AS (
  SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS tr0
  FROM lineitem GROUP BY 1),
metrics AS (
  SELECT k, path, language, coverage, {", ".join(f"{e.replace('.0)', '.0::DOUBLE)') if '/' in e and 'floor' in e else e.replace('00.0', '00.0::DOUBLE')} AS {c}" for c, e in METRICS.items())}
  FROM (SELECT k, path, language, coverage, p_size, coalesce(n, 0) AS n, coalesce(q, 0) AS q, coalesce(r, 0) AS r, coalesce(tr0, 0) AS tr0 FROM files LEFT JOIN part_lines ON l_partkey = k)),
next_part AS (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem),
edges AS (SELECT DISTINCT l_partkey AS src, dst FROM next_part WHERE l_returnflag = 'R' AND l_quantity >= 20 AND l_partkey <> dst),
shapes AS (SELECT k, path, {", ".join(f"{e} AS {c}" for c, e in SHAPE.items())} FROM files),
sources AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, coalesce(text, '') AS text, lang AS language, source FROM documents)
"""
