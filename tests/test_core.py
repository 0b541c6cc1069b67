"""Operators of the library on small cases, and the invariants of scored files."""

import pytest
from pyspark.sql import functions as F

from riskspark import settings as st
from riskspark.functions import commits, scoring
from riskspark.functions import text as t
from riskspark.operators import clones, extract, graph, history, learn, report, rules
from riskspark.sources import coverage, files, git

RISKY = '''import os
from ..core import io as x
CACHE = {}
LIMITS = list()
def load(a, b, *c, d=[], e=dict(), **f):
    global state
    for i in a:
        for j in b:
            if i and j or a:
                while True:
                    open(i).read(42)
    try:
        return eval(a)
    except:
        pass
'''


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("subject, fix", [("fix: crash", True), ("Resolve memory  leak", True), ("feat: fix login", False), ("chore(deps): fix pin", False), ("feat! fix", True), ("docs typo", True), ("prefix only", False), ("", False), (None, None)])
def test_fix_subjects(spark, subject, fix):
    assert frame(spark, [(subject,)], "s string").select(commits.is_fix(F.col("s"))).first()[0] is fix


def test_reverts_and_extra(spark):
    df = frame(spark, [('Revert "x"',), ("back  out y",), ("do not revert",), ("feat: JIRA-1",)], "s string")
    assert [r[0] for r in df.select(commits.is_revert(F.col("s"))).collect()] == [True, True, False, False]
    assert [r[0] for r in df.select(commits.is_fix(F.col("s"), "jira-[0-9]+")).collect()][3]


def test_tree():
    m = extract.measure(RISKY, "python")
    assert m.parser == "ast" and m.parse_ok and (m.function_count, m.max_parameters, m.mutable_default_args) == (1, 6, 2)
    assert (m.loop_count, m.nested_loop_depth, m.max_nesting_depth, m.branch_count) == (3, 3, 5, 1)
    assert m.cyclomatic_complexity == 3 + 1 + 2 + 1 and m.max_function_complexity == 8
    assert (m.try_blocks, m.except_handlers, m.bare_excepts, m.swallowed_exceptions) == (1, 1, 1, 1)
    assert m.global_variables == 2 and m.global_names == ["CACHE", "state"][1:] or m.global_variables == 1
    assert m.imports == ["os", "..core", "..core.io"] and m.magic_numbers == 1 and m.risky_calls == 3


def test_tree_of_odd_sources():
    assert extract.measure("", "python").loc == 0
    broken = extract.measure("def f(:\n    if x:\n        pass\n", "python")
    assert not broken.parse_ok and broken.parse_error.startswith("SyntaxError") and broken.parser == "heuristic" and broken.function_count == 1
    long = extract.measure("def f():\n" + "    x = 1\n" * 120, "python")
    assert long.max_function_length == 121
    more = extract.measure("def f(x):\n    if x:\n        return 1\n    elif x > 2:\n        return 3\n", "python")
    assert more.max_nesting_depth == 3 and more.cyclomatic_complexity == 2
    assert extract.measure("x = lambda a: a\nasync def g():\n    async with a as b:\n        match b:\n            case 1: pass\n            case _: pass\n", "python").function_count == 2


def test_heuristic():
    js = "import x from './lib'\nfunction run(a, b) {\n  for (const i of a) {\n    if (i && b) {\n      if (a || b) {\n        try { fetch(i) } catch (e) {\n        }\n      }\n    }\n  }\n}\nvar total = 12\nfunction end() {\n}\n"
    m = extract.measure(js, "javascript")
    # the third shape also takes indented `for (...) {` and `if (...) {` for definitions
    assert (m.function_count, m.max_parameters, m.loop_count, m.branch_count) == (5, 2, 1, 2) and m.max_nesting_depth >= 4
    assert m.try_blocks == m.except_handlers == m.swallowed_exceptions == 1 and m.global_variables == 1 and m.imports == ["x"] and m.magic_numbers == 1
    assert [f["length"] for f in m.functions] == [8, 2, 1, 1, 1] and m.cyclomatic_complexity == 5
    assert extract.measure("plain prose " * 20_000, "en").function_count == 0


def test_gates(spark):
    df = frame(spark, [("a", bytearray(b"x\ny\n")), ("b", bytearray(b"x\0y")), ("c", bytearray(b"z" * 50)), ("d", None), ("e", bytearray(b""))], "path string, content binary")
    got = {r.path: (r.status, r.newlines) for r in extract.gates(df, 20).collect()}
    assert got == {"a": ("ok", 2), "b": ("skipped: binary", 0), "c": ("skipped: too large", 0), "d": ("unreadable", None), "e": ("ok", 0)}


def test_history(spark):
    day = 86_400
    rows = [(1, "p", "a", 0, True, False, 1, 1, "fix"), (2, "p", "b", day, False, False, 2, 0, "x"), (3, "p", "a", 3 * day, True, True, 0, 4, "revert"), (4, "q", "b", 5 * day, False, False, 1, 0, "y")]
    df = frame(spark, rows, "sha long, path string, author string, ts long, is_fix boolean, is_revert boolean, insertions long, deletions long, subject string")
    m = {r.path: r for r in history.metrics(df, 40 * day).collect()}
    assert (m["p"].commits, m["p"].fixes, m["p"].reverts, m["p"].churn, m["p"].recent_30d, m["p"].recent_90d, m["q"].days_since_last) == (3, 2, 1, 8, 0, 3, 35.0)
    assert {r.path: round(r.ownership, 4) for r in history.ownership(df).collect()} == {"p": 0.6667, "q": 1.0}
    assert {r.path: r.rate for r in history.fix_follow(df, 7 * day).collect()} == {"p": 1.0, "q": 0.0}
    assert [r.sha for r in history.fix_follow_semijoin(df, 7 * day).collect()] == [2]
    assert {r.path: r.sha for r in history.last_commit(df).collect()} == {"p": "3", "q": "4"}
    assert history.metrics(df.limit(0), 0).count() == 0


def test_normalised_lines(spark):
    df = frame(spark, [("  a = 12.5 + 'x' ",), ("# note",), ('f("a\\"b",  3)',), ("",), ("v2 = é3",)], "s string")
    assert [r[0] for r in df.select(t.normalised(F.col("s"))).collect()] == ["a = N + 'S'", "", "f('S', N)", "", "v2 = é3"]


def test_clones(spark):
    block = [f"value_{i} = compute({i})" for i in "abcdefg"]
    df = frame(spark, [("x.py", "\n".join([*block, "----", *block])), ("y.py", "\n".join(["first_line()", *block])), ("z.py", "\n".join(f"unique_{i}()" for i in "abcdefghijkl")), ("e.py", "")], "path string, text string")
    inside = {r.path: (r.blocks, r.ratio) for r in clones.internal(df).collect()}
    assert inside["x.py"][0] == 2 and inside["x.py"][1] == 1.0 and inside["y.py"] == (0, 0.0)
    pairs = clones.pairs(clones.fingerprints(df)).collect()
    assert [(p.a, p.b, p.windows) for p in pairs] == [("x.py", "y.py", 4)] and clones.partners(clones.pairs(clones.fingerprints(df))).count() == 2


def wide(spark, **values):
    row = {"path": "a.py", **values}
    return spark.createDataFrame([row], ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'bigint'}" for k, v in row.items()))


BAD = {"loc": 900, "risky_calls": 9, "try_blocks": 0, "global_variables": 4, "nested_loop_depth": 5, "branch_count": 40, "max_function_complexity": 45, "cyclomatic_complexity": 60, "bare_excepts": 2, "magic_numbers": 30, "todo_comments": 9, "max_parameters": 10, "duplicate_ratio": 0.4, "max_function_length": 300}


def test_rules(spark):
    row = rules.scores(rules.hits(wide(spark, **BAD))).first()
    assert len(row.hits) >= 8 and all(h.points > 0 and h.title and h.detail for h in row.hits) and row.score > 85 and row.band == "critical"
    assert [h.points for h in row.hits] == sorted((h.points for h in row.hits), reverse=True)
    assert row.raw == pytest.approx(sum(h.points for h in row.hits))
    calm = rules.scores(rules.hits(wide(spark, loc=50, function_count=3))).first()
    assert calm.hits == [] and calm.score == 0 and calm.band == "low"


def fired(spark, **values):
    return [h.rule_id for h in rules.hits(wide(spark, **values)).first().hits]


def test_rules_exclude_each_other(spark):
    assert fired(spark, commits=12, authors=6, ownership=0.95) == ["many-authors"] and fired(spark, commits=12, authors=1, ownership=0.95) == ["knowledge-silo"] and fired(spark, commits=0, authors=9) == []
    assert fired(spark, loc=50, function_count=3, risky_calls=12, try_blocks=1) == ["sparse-error-handling"] and fired(spark, risky_calls=12) == ["no-error-handling"]
    assert fired(spark, coverage=0.1, has_test=False, loc=50) == ["low-coverage"] and fired(spark, has_test=False, loc=50) == ["no-test-file"] and fired(spark, has_test=False, loc=5) == [] and fired(spark, loc=50) == []


def test_weights_and_thresholds(spark):
    s = st.load(env={}, weights={"god_file": 80}, thresholds={"god_file_loc": 10})
    assert [(h.rule_id, h.points) for h in rules.hits(wide(spark, loc=20, function_count=1), s).first().hits] == [("god-file", 160.0)]
    assert rules.hits(wide(spark, **BAD), skipped="loc = 900").first().hits == []


def test_scores_are_bounded_and_monotone(spark):
    got = [r[0] for r in spark.range(-5, 2000, 7).selectExpr(f"{scoring.squash('cast(id as double)')} AS s").collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] <= 100
    assert [r[0] for r in frame(spark, [(34.9,), (35.0,), (60.0,), (85.0,)], "x double").selectExpr(scoring.band("x")).collect()] == ["low", "medium", "high", "critical"]


def test_settings(tmp_path):
    file = tmp_path / "s.toml"
    file.write_text('history_days = 90\nexcludes = ["gen/*"]\nuse_ml = false\n[weights]\ngod_file = 3\n[thresholds]\nfan_in = 4\n')
    s = st.load(file, env={"RISKSPARK_HISTORY_DAYS": "30", "RISKSPARK_IGNORE_TESTS": "true"}, max_file_bytes=10, use_git=None)
    assert (s.history_days, s.weights["god_file"], s.thresholds["fan_in"], s.excludes[-1], s.ignore_tests, s.max_file_bytes, s.use_ml, s.use_git) == (90, 3.0, 4, "gen/*", True, 10, False, True)
    file.write_text("not [toml")
    assert st.load(file, env={}) == st.Settings()
    with pytest.raises(ValueError):
        st.load(env={}, weights={"nothing": 1})


def test_paths(spark):
    df = frame(spark, [("src/a.py",), ("node_modules/x/b.js",), ("src/build/c.py",), ("x.min.js",), ("tests/test_a.py",), ("README",)], "path string")
    assert [r.path for r in files.discover(df).collect()] == ["src/a.py", "tests/test_a.py"]
    assert [r.path for r in files.discover(df, st.load(env={}, ignore_tests=True)).collect()] == ["src/a.py"]
    assert {r.path: r.has_test for r in files.test_presence(df, st.TEST_MARKERS).collect()}["src/a.py"] is True
    norm = frame(spark, [("./.github/a",), ("/repo/x/y",), ("../z",)], "p string").select(t.normal_path(F.col("p"), "/repo"))
    assert [r[0] for r in norm.collect()] == [".github/a", "x/y", "../z"]


def test_graph(spark):
    edges = frame(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("a", "a")], "src string, dst string")
    seeds, risk = frame(spark, [("a",)], "node string"), frame(spark, [("b", 60.0)], "node string, own_risk double")
    got = {r.node: (r.impact, r.hops) for r in graph.impact(edges, seeds, risk).collect()}
    assert got == {"b": (48.0, 1), "c": (14.4, 2), "d": (6.5, 3)}
    strong = frame(spark, [("a", "z", 0.5), ("a", "y", 0.9)], "path string, partner string, strength double")
    assert {r.node: r.impact for r in graph.impact(edges, seeds, risk, strong, frame(spark, [("z",)], "node string")).collect()}["z"] == 22.4
    assert graph.impact(edges, frame(spark, [("nobody",)], "node string"), risk).count() == 0
    built = graph.build(frame(spark, [("a",), ("b",), ("c",)], "path string"), edges, frame(spark, [("b", "a", 3), ("a", "c", 2), ("a", "q", 9)], "path string, partner string, n long"))
    assert {(r.src, r.dst, r.kind, r.cochange) for r in built.collect()} == {("b", "a", "import", 3), ("c", "b", "import", 0), ("a", "c", "cochange", 2)}


def test_centrality(spark):
    path = frame(spark, [(1, 2), (2, 3), (3, 4)], "src int, dst int")
    nodes = frame(spark, [(i,) for i in range(1, 6)], "node int")
    wanted = {1: 0, 2: 2 / 12, 3: 2 / 12, 4: 0, 5: 0}
    assert {r.node: pytest.approx(r.centrality) for r in graph.centrality(path, nodes).collect()} == wanted
    spark.sparkContext.setCheckpointDir("/tmp/riskspark-test-checkpoint")
    assert {r.node: pytest.approx(r.centrality) for r in graph.centrality(path, nodes, most_edges=0).collect()} == wanted
    diamond = frame(spark, [(1, 2), (1, 3), (2, 4), (3, 4)], "src int, dst int")
    assert {r.node: pytest.approx(r.centrality) for r in graph.centrality(diamond, nodes.filter("node < 5")).collect()} == {1: 0, 2: 0.5 / 6, 3: 0.5 / 6, 4: 0}


def test_imports(spark):
    ask = lambda rows: frame(spark, rows, "importer string, spec string")
    have = lambda *p: frame(spark, [(x,) for x in p], "path string")
    got = graph.resolve_python(ask([("x/y/z.py", "..m.n"), ("x/y/z.py", "."), ("a.py", "b.c.d"), ("a.py", "lib"), ("a.py", "os")]), have("x/m/n.py", "x/y/__init__.py", "b/c.py", "b/__init__.py", "src/lib/__init__.py"))
    assert {(r.spec, r.target) for r in got.collect()} == {("..m.n", "x/m/n.py"), (".", "x/y/__init__.py"), ("b.c.d", "b/c.py"), ("lib", "src/lib/__init__.py")}
    got = graph.resolve_javascript(ask([("src/ui/app.ts", s) for s in ("./view", "../core", "@/core/io", "react", "../../../up")]), have("src/ui/view.tsx", "src/core/index.ts", "src/core/io.js"))
    assert {(r.spec, r.target) for r in got.collect()} == {("./view", "src/ui/view.tsx"), ("../core", "src/core/index.ts"), ("@/core/io", "src/core/io.js")}
    got = graph.resolve_generic(ask([("a/x.go", "pkg/util"), ("a/x.go", "fmt"), ("b/y.go", "util"), ("c/z.go", "twice")]), have("a/util.go", "c/twice.go", "d/twice.go"))
    assert {(r.importer, r.target) for r in got.collect()} == {("a/x.go", "a/util.go"), ("b/y.go", "a/util.go"), ("c/z.go", "c/twice.go")}


def test_coverage(spark):
    read = lambda name, text: {r.path: r.fraction for r in coverage.read(frame(spark, [(name, text)], "name string, text string")).collect()}
    assert read("c.xml", '<c><sources><source>src</source></sources><class filename="a.py" line-rate="0.25"/><class filename="b.py"/></c>') == {"a.py": 0.25, "src/a.py": 0.25, "b.py": 0.0, "src/b.py": 0.0}
    assert read("lcov.info", "SF:./a\nLF:100\nLH:30\nend_of_record\nSF:b\nLF:0\nLH:x\nend_of_record") == {"a": 0.3, "b": 0.0}
    assert read("c.json", '{"files": {"a": {"summary": {"percent_covered": 42}}}}') == {"a": 0.42} and read("f.json", '{"a": {"s": {"0": 1, "1": 0}}}') == {"a": 0.5}
    assert read("c.xml", "<broken") == read("c.txt", "x") == read("c.json", "[1, 2]") == {}


def test_git(spark, tmp_path):
    run = lambda *a: git.git(str(tmp_path), *a)
    assert run("init", "-q")[0] == 0
    run("config", "user.email", "a@b")
    run("config", "user.name", "Ann")
    for k in range(3):
        (tmp_path / "é a.py").write_text("x\n" * (k + 1))
        run("add", "-A")
        run("commit", "-qm", f"fix: {k}")
    spark.dataSource.register(git.GitLog)
    rows = spark.read.format("git_log").option("path", str(tmp_path)).load().collect()
    assert len(rows) == 3 and {r.path for r in rows} == {"é a.py"} and {r.author for r in rows} == {"Ann"} and sum(r.insertions for r in rows) == 3
    assert git.is_repository(str(tmp_path)) and git.tracked(str(tmp_path)) == ["é a.py"] and not git.is_repository("/") and not git.is_partial(str(tmp_path))
    assert spark.read.format("git_log").option("path", "/").load().count() == 0

def test_centrality_computes_its_edges_once(spark):
    spark.sparkContext.setCheckpointDir("/tmp/riskspark-test-checkpoint")
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(len(batch))
            yield batch

    path = frame(spark, [(1, 2), (2, 3), (3, 4)], "src int, dst int").mapInPandas(counted, "src int, dst int")
    for most in (10, 0):
        before = rows.value
        graph.centrality(path, frame(spark, [(i,) for i in range(1, 6)], "node int"), most_edges=most).collect()
        assert rows.value - before == 3


def test_centrality_by_arrays_and_by_joins(spark):
    edges = frame(spark, sorted({(f"f{i * 7 % 40}", f"f{(i * i + 3 * i) % 41}") for i in range(160)}), "src string, dst string")
    nodes = frame(spark, [(f"f{i}",) for i in range(36)], "node string")  # some ends are no nodes
    by = [{r.node: r.centrality for r in graph.centrality(edges, nodes, **x).collect()} for x in ({}, {"most_edges": 0}, {"exact": 5, "pivots": 7}, {"exact": 5, "pivots": 7, "most_edges": 0})]
    assert by[0] == pytest.approx(by[1]) and by[2] == pytest.approx(by[3]) and len(by[0]) == 36 and max(by[0].values()) > 0


def test_reports(spark, tmp_path):
    scored = rules.scores(rules.hits(wide(spark, **BAD).unionByName(wide(spark, **(BAD | {"path": "src/b/c.py", "loc": 1}))).withColumn("language", F.lit("python"))))
    assert report.lookup(scored, "a.py").count() == 1 and report.lookup(scored, "py").count() == 2 and report.lookup(scored, "none").count() == 0
    assert {r.dir: r.files for r in report.rollup(scored).collect()} == {"src": 1, "src/b": 1}
    assert {r.band: r.files for r in report.bands(scored).collect()}["low"] == 0 and report.gate(scored, 99.99).count() == 0
    back = report.from_json(report.as_json(scored), scored.schema)
    assert [r.asDict(True) for r in back.orderBy("path").collect()] == [r.asDict(True) for r in scored.orderBy("path").collect()]
    page = report.html(scored, tmp_path / "r.html").read_text()
    assert "src/b/c.py" in page and "http" not in page
    assert all(r.name.startswith("file-") and r.name.endswith(".py") for r in report.narration(scored).collect())


def test_learning_gates(spark):
    rows = lambda n, positive: frame(spark, [(str(i), int(i < positive)) for i in range(n)], "path string, label int")
    assert learn.gates(rows(100, 20)) is None
    assert all(learn.gates(rows(*x)) for x in ((0, 0), (39, 20), (100, 7), (100, 100)))
    assert learn.load(spark, "/nowhere") is None


@pytest.fixture(scope="module")
def learnable(spark):
    import random

    draw = random.Random(5)
    rows = [(f"f{i}", *(float(draw.randrange(n)) for n in (9, 7, 5, 4))) for i in range(400)]
    return frame(spark, [(*r, float(draw.random() < 0.1 + 0.08 * r[1] + 0.02 * r[2] * r[3]), i % 2) for i, r in enumerate(rows)], "path string, x double, y double, z double, u double, label double, fold long")


def test_boosting_is_that_of_mllib(spark, learnable):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from riskspark.operators import boost

    columns = ["x", "y", "z", "u"]
    model, held = boost.train(learnable, columns, 2, 400, trees=6, depth=3, rate=0.06, share=1.0, seed=1)
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(learnable).repartition(1)
    other = GBTClassifier(maxIter=6, maxDepth=3, stepSize=0.06, subsamplingRate=1.0, seed=1)
    p = lambda model, asked: {r.path: r.p for r in model.transform(asked).withColumn("p", vector_to_array("probability")[1]).collect()}
    want = p(other.fit(rows.filter("fold <> 0")), rows.filter("fold = 0")) | p(other.fit(rows.filter("fold <> 1")), rows.filter("fold = 1"))
    assert {r.path: r.p for r in held.collect()} == pytest.approx(want)
    whole = other.fit(rows)
    assert {r.path: r.p for r in model.transform(learnable.select("path", *columns)).collect()} == pytest.approx(p(whole, rows))
    assert model.importances() == pytest.approx(list(whole.featureImportances.toArray()))


def test_boosting_without_anything_to_split_by(spark, learnable):
    from riskspark.operators import boost

    out = boost.train(learnable.withColumns({c: F.lit(0.0) for c in "xyzu"}), list("xyzu"), 2, 400, trees=1, depth=3, rate=0.06, share=1.0, seed=1)[1].select("path", "p").join(learnable, "path").toPandas()
    for fold in (0, 1):
        mean = 2 * out[out["fold"] != fold]["label"].mean() - 1
        assert out[out["fold"] == fold]["p"].tolist() == pytest.approx([1 / (1 + 2.718281828459045 ** (-2 * mean))] * 200)


def test_training_takes_few_jobs(spark, learnable, tmp_path):
    rows = learnable.select("path", F.col("label").cast("int").alias("label"), *(F.col(dict(zip(learn.FEATURES, "xyzu")).get(f, "x")).alias(f) for f in learn.FEATURES))
    spark.sparkContext.setJobGroup("training", "training")
    trained = learn.train(rows, trees=4)
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("training")) < 30  # whatever the number of trees and fits
    trained.save(f"{tmp_path}/m")
    again = learn.load(spark, f"{tmp_path}/m")
    want = {r.path: r.p for r in learn.predict(trained, trained.rows).collect()}
    assert len(want) == 400 and {r.path: r.p for r in learn.predict(again, trained.rows).collect()} == want


def test_stream(spark, tmp_path):
    from riskspark.streaming import feed

    frame(spark, [("p", "a", True, "2024-01-01 00:00:00"), ("p", "a", False, "2024-01-02 00:00:00"), ("q", "b", False, "2024-03-01 00:00:00")], "path string, author string, is_fix boolean, at string").selectExpr("path", "author", "is_fix", "timestamp(at) AS at").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, author string, is_fix boolean, at timestamp").parquet(f"{tmp_path}/in")
    query = feed.activity(stream).writeStream.format("memory").queryName("activity").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.path, r.commits, r.fixes) for r in spark.table("activity").collect()) == [("p", 2, 1)]


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(__spark_entry__.queries()) > 130


def test_learning_queries_use_the_default_model(spark, monkeypatch):
    import inspect

    from riskspark.plans import queries

    asked = []
    monkeypatch.setattr(queries.learn, "train", lambda rows, **options: asked.append(options))
    monkeypatch.setattr(queries, "_features", lambda spark, d: None)
    queries._trained.__wrapped__(spark, "/nowhere")
    default = {k: v.default for k, v in inspect.signature(learn.pipeline).parameters.items()}
    assert default["trees"] == 200 and default["depth"] == 3 and {k: v for o in asked for k, v in o.items() if default[k] != v} == {} and len(asked) == 1


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole_graph():
    """All edges of quantity 20 or more, without Spark."""
    import pandas as pd

    lines = pd.read_parquet(f"{SF}/lineitem.parquet").sort_values(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    dst = lines.groupby("l_orderkey")["l_partkey"].shift(-1)
    kept = (lines["l_returnflag"] == "R") & (lines["l_quantity"] >= 20) & dst.notna() & (lines["l_partkey"] != dst)
    return sorted(set(zip(map(int, lines["l_partkey"][kept]), map(int, dst[kept]), strict=True)))


def reached(edges, seeds):
    """{node: (base, hops)} over import edges."""
    back, base, hops = {}, {}, {}
    for src, dst in edges:
        back.setdefault(dst, []).append(src)
    for seed in seeds:
        seen = front = {seed}
        for hop in (1, 2, 3):
            front = {x for v in front for x in back.get(v, ())} - seen
            seen = seen | front
            for x in front:
                base[x], hops[x] = base.get(x, 0.0) + 10 * 0.45 ** (hop - 1), min(hop, hops.get(x, hop))
    return {x: (b, hops[x]) for x, b in base.items() if x not in seeds}


@pytest.mark.parametrize("name, seeds", [("impact", [42]), ("impact_multi_seed", [42, 7, 99, 1234])])
def test_impact_reaches_over_all_edges(spark, whole_graph, name, seeds):
    from riskspark.plans import queries

    got, want = {r.node: r for r in queries.QUERIES[name](spark, SF).collect()}, reached(whole_graph, seeds)
    assert want and want.keys() <= got.keys()
    assert {x: got[x].hops for x, (_, hop) in want.items() if hop == 1} == {x: 1 for x, (_, hop) in want.items() if hop == 1}
    assert all(got[x].impact >= min(100, 3.2 * base * (1 + x % 100 / 120)) - 0.06 for x, (base, _) in want.items())
    if name == "impact":
        assert queries.QUERIES["impact_explain"](spark, SF).first().reached == len(got)


def test_centrality_is_of_all_edges(spark, whole_graph):
    import pandas as pd

    from riskspark.plans import queries

    nodes = [int(k) for k in pd.read_parquet(f"{SF}/part.parquet")["p_partkey"]]
    adjacency = {v: [y for x, y in whole_graph if x == v] for v in nodes}
    far = {}
    for s in nodes:  # distances and numbers of shortest paths
        dist, paths, front = {s: 0}, {s: 1}, [s]
        while front:
            later = []
            for v in front:
                for w in adjacency[v]:
                    if w not in dist:
                        dist[w], paths[w] = dist[v] + 1, 0
                        later.append(w)
                    paths[w] += paths[v] * (dist[w] == dist[v] + 1)
            front = later
        far[s] = dist, paths
    want = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths = far[s]
        for v in dist:
            for t, d in far[v][0].items():
                if s != v != t != s and dist[t] == dist[v] + d:
                    want[v] += paths[v] * far[v][1][t] / paths[t]
    norm = 1 / ((len(nodes) - 1) * (len(nodes) - 2))
    assert {r.node: r.centrality for r in queries.QUERIES["centrality"](spark, SF).collect()} == pytest.approx({v: x * norm for v, x in want.items()}, abs=1e-9)


@pytest.mark.parametrize("name, seeds", [("impact", [42]), ("impact_multi_seed", [42, 7, 99, 1234])])
def test_impact_counts_cochange_partners(spark, whole_graph, name, seeds):
    from collections import Counter

    import pandas as pd

    from riskspark import adapters
    from riskspark.plans import queries

    path = {r.k: r.path for r in adapters.files(spark, SF).collect()}
    lines = pd.read_parquet(f"{SF}/lineitem.parquet")
    commits = [set(map(int, x)) for x in lines.groupby("l_orderkey")["l_partkey"].unique() if len(set(x)) <= 25]
    every = Counter(int(k) for x in lines.groupby("l_orderkey")["l_partkey"].unique() for k in x)
    want = reached(whole_graph, seeds)
    for seed in seeds:
        together = Counter(k for x in commits if seed in x for k in x if k != seed)
        for partner, n in sorted(together.items(), key=lambda x: (-x[1], path[x[0]]))[:10]:
            if partner not in seeds:
                base, hops = want.get(partner, (0.0, 1))
                want[partner] = base + min(12, 14 * round(n / every[seed], 3)), hops
    got = {r.node: (r.impact, r.hops) for r in queries.QUERIES[name](spark, SF).collect()}
    assert want.keys() == got.keys() and {x: h for x, (_, h) in want.items()} == {x: h for x, (_, h) in got.items()}
    assert {x: i for x, (i, _) in got.items()} == pytest.approx({x: min(100, 3.2 * base * (1 + x % 100 / 120)) for x, (base, _) in want.items()}, abs=0.0501)


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    """A small repository: a risky file with fixes, one that is clean, imports, copies, a test, a report, and a folder that is left out."""
    root = tmp_path_factory.mktemp("repo")
    run = lambda *a: git.git(str(root), *a)
    block = "\n".join(f"value_{x} = compute_{x}(1)" for x in "abcdefgh")
    texts = {
        "src/payment.py": "import requests\nfrom src import utils\nCACHE = []\nstate = {}\ndef pay(a, b, c, d, e, f, g=[]):\n    global state\n    for i in a:\n        for j in b:\n            for k in c:\n                if i and j:\n                    requests.post(i).read()\n                    open(k).read(42)\n" + block + "\n",
        "src/utils.py": "def add(a, b):\n    return a + b\n\n\ndef sub(a, b):\n    return a - b\n" + "# note\n" * 8, "src/api.py": "from src import payment\nfrom src.utils import add\n" + block + "\n", "src/ui/app.js": "import './view'\nfunction run(a) { if (a) { return x } }\n",
        "src/ui/view.js": "export function view() { return 1 }\n", "tests/test_utils.py": "from src import utils\n", "node_modules/x/i.js": "var a = 1\n", "notes.txt": "no source\n", "src/big.py": "x = 1\n" * 300_000,
        "coverage.xml": '<coverage><packages><class filename="src/payment.py" line-rate="0.25"/><class filename="src/utils.py" line-rate="0.9"/></packages></coverage>',
    }
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    run("init", "-q")
    run("config", "user.email", "a@b")
    run("config", "user.name", "Ann")
    run("add", "-A")
    run("commit", "-qm", "feat: first")
    for k in range(8):
        (root / "src/payment.py").write_text(texts["src/payment.py"] + f"# {k}\n")
        if k % 2:
            (root / "src/api.py").write_text(texts["src/api.py"] + f"# {k}\n")
        run("commit", "-qam", f"fix: crash {k}")
    run("commit", "-qm", 'Revert "fix: crash"', "--allow-empty")
    return root


@pytest.fixture(scope="module")
def scanned(spark, repository):
    from riskspark.scan import scan

    return scan(spark, str(repository))


def test_scan(scanned):
    rows = {r.path: r for r in scanned.scored.collect()}
    assert set(rows) == {"src/payment.py", "src/utils.py", "src/api.py", "src/ui/app.js", "src/ui/view.js", "tests/test_utils.py", "src/big.py"}
    assert all(0 <= r.score <= 100 for r in rows.values()) and all(bool(r.hits) == (r.score > 0) and all(h.points > 0 and h.detail for h in r.hits) for r in rows.values())
    assert max(rows.values(), key=lambda r: r.score).path == "src/payment.py"
    ids = {h.rule_id for h in rows["src/payment.py"].hits}
    assert {"no-error-handling", "global-state", "duplicate-code", "low-coverage", "mutable-default-arg", "bugfix-density"} <= ids
    assert not [h for h in rows["src/big.py"].hits if h.phase == "static"] and rows["src/big.py"].status == "skipped: too large"
    assert rows["src/payment.py"].commits == 9 and rows["src/payment.py"].fixes == 8 and rows["src/utils.py"].coverage == 0.9 and rows["src/utils.py"].has_test is True
    assert {(e.src, e.dst) for e in scanned.edges.filter("kind = 'import'").collect()} == {("src/payment.py", "src/utils.py"), ("src/api.py", "src/payment.py"), ("src/api.py", "src/utils.py"), ("src/ui/app.js", "src/ui/view.js"), ("tests/test_utils.py", "src/utils.py")}
    assert scanned.about["history"] == "available" and scanned.about["coverage"] == "coverage.xml" and scanned.about["commits"]["commits"] == 9 and scanned.about["parsers"]["ast"] == 4


def test_impact_of_a_scan(scanned):
    got = {r.node: r for r in scanned.impact(["src/utils.py"]).collect()}
    assert {p for p, r in got.items() if "imports it directly" in r.reasons} == {"src/payment.py", "src/api.py", "tests/test_utils.py"} and got["src/api.py"].hops == 1
    assert got["src/big.py"].reasons == ["changes together with src/utils.py in 100% of its commits"]  # the first commit
    pulled = {r.node: r.reasons for r in scanned.impact(["src/payment.py"]).collect()}
    assert any("changes together with src/payment.py in 56% of its commits" in x for x in pulled["src/api.py"])
    assert scanned.impact(["nothing.py"]).count() == 0


def test_documents_of_a_scan(scanned, tmp_path):
    import json

    saved = json.loads(scanned.save(tmp_path / "r.json").read_text())
    assert saved["summary"]["files"] == len(saved["files"]) == 7 and saved["files"][0]["path"] == "src/payment.py" and saved["hotspots"] and sum(saved["bands"].values()) == 7
    page = report.html(scanned.scored, tmp_path / "r.html", limit=3).read_text()
    assert "and 4 more" in page and "calls" in page and "src/ui" in page
    tree = report.tree(scanned.scored)
    assert tree["files"] == 7 and tree["children"]["src"]["children"]["ui"]["files"] == 2
    assert report.lookup(scanned.scored, "utils.py").count() == 1 and report.lookup(scanned.scored, "ui").count() == 2


def test_plain_folder(spark, tmp_path):
    from riskspark.scan import scan, train

    (tmp_path / "a.py").write_text("def f():\n    return 1\n")
    got = scan(spark, str(tmp_path))
    assert got.about["history"] == "not a repository" and got.strengths is None and [r.path for r in got.scored.collect()] == ["a.py"]
    assert train(spark, str(tmp_path)) == (None, "not a repository")
    assert files.walk(str(tmp_path)) == ["a.py"]


def test_log_in_ranges(spark, repository):
    spark.dataSource.register(git.GitLog)
    log = spark.read.format("git_log").option("path", str(repository)).option("each", 2)
    assert log.load().select("sha").distinct().count() == 9 and log.load().rdd.getNumPartitions() == 5
    inner = spark.read.format("git_log").option("path", str(repository / "src")).load()
    assert {r.path for r in inner.select("path").distinct().collect()} >= {"payment.py", "ui/app.js"}
    assert git.no_history("/") == "not a repository" and git.no_history(str(repository)) is None
    with pytest.raises(RuntimeError):
        list(git.entries(str(repository), "log", "--no-such-option"))


def test_command_line(repository, tmp_path, capsys):
    import json

    from riskspark.__main__ import main

    root = ["--root", str(repository)]
    assert main(["version"]) == 0 and main(["init", "--output", str(tmp_path / "s.toml")]) == 0 and main(["init", "--output", str(tmp_path / "s.toml")]) == 2
    assert st.load(tmp_path / "s.toml", env={}) == st.Settings()
    capsys.readouterr()
    assert main(["scan", *root, "--limit", "2", "--json", "--fail-over", "1"]) == 1
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x["path"] for x in lines][0] == "src/payment.py" and len(lines) == 2 and len(lines[0]["bar"]) == 20
    assert main(["explain", "payment.py", *root]) == 0 and "Errors" not in capsys.readouterr().err
    assert main(["explain", "ui", *root]) == 2 and main(["train", *root, "--output", str(tmp_path / "m")]) == 1
    assert (tmp_path / "s.toml").exists()


def test_interface(scanned):
    import json
    import threading
    import urllib.error
    import urllib.request

    from riskspark import server

    http = server.serve(server.Cache(lambda: scanned), port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    ask = lambda path, body=None: json.load(urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}/api/{path}", json.dumps(body).encode() if body else None, timeout=60))
    assert ask("health")["status"] == "ok" and ask("summary")["files"] == 7 and ask("tree")["files"] == 7
    assert ask("files?limit=2")["more"] == 5 and ask("files/src/payment.py")["path"] == "src/payment.py" and len(ask("graph")["edges"]) == 5
    assert {x["node"] for x in ask("impact", {"files": ["utils.py"]})["affected"]} >= {"src/api.py"}
    for path, status in (("files/none.py", 404), ("files/ui", 409), ("nothing", 404), ("files?limit=x", 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            ask(path)
        assert e.value.code == status
    http.shutdown()
    held = []
    cache = server.Cache(lambda: held.append(1))
    cache.get(), cache.get(), cache.get(again=True)
    assert len(held) >= 2


def test_env_file(tmp_path):
    (tmp_path / ".env").write_text("# note\nA=1\nexport B = 'two'\nC\nD=old\n")
    env = {"D": "set"}
    assert st.load_env(tmp_path / ".env", env) == {"A": "1", "B": "two"} and env == {"A": "1", "B": "two", "D": "set"} and st.load_env(tmp_path / "none", env) == {}


def test_history_profile(spark):
    from riskspark import adapters as ad

    changes = ad.changes(spark, SF)
    one = history.metrics(changes, ad.AS_OF).join(history.ownership(changes), "path")
    two = history.profile(changes, ad.AS_OF)
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(sorted(one.columns)).collect())
    assert key(one) == key(two)


def test_fix_follow_over_spans(spark):
    r = __import__("random").Random(3)
    rows = [(i, f"p{r.randrange(4)}", r.randrange(400), r.random() < 0.3) for i in range(600)]
    df = frame(spark, rows, "sha long, path string, ts long, is_fix boolean")
    got = {x.path: (x.edits, x.followed) for x in history.fix_follow(df, 7).collect()}
    for p in got:
        own = [x for x in rows if x[1] == p]
        edits = [x for x in own if not x[3]]
        assert got[p] == (len(edits), sum(any(y[3] and x[2] < y[2] <= x[2] + 7 for y in own) for x in edits))


def test_marks_that_stand():
    assert extract.open_marks([0, 4, 8, 4, 0, 2], [True, True, False, True, False, True]) == [1, 2, 2, 2, 0, 1]
    assert extract.open_marks([1, 1, 2, 1], [True] * 4, equal=True) == [1, 2, 3, 3]
