"""Chat formatting, nearest neighbours, URL filters and the pipeline against plain versions."""

import json
import random

import numpy as np
import pytest


def test_layouts():
    from riskspark.llm import chat

    cases = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "messages", ["user:a", "assistant:"]),
        ({"id": 3, "meta": {"x": [1]}, "messages": [{"role": "human", "content": "a", "n": 1}]}, "messages", ["human:a"]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}], "system": "s"}, "from-value", ["system:s", "user:q", "assistant:r"]),
        ({"instruction": "do", "input": "this", "output": "done"}, "instruction", ["user:do\n\nthis", "assistant:done"]),
        ({"instruction": "do", "output": "done"}, "instruction", ["user:do", "assistant:done"]),
        ({"prompt": "p", "response": "r"}, "prompt-response", ["user:p", "assistant:r"]),
        ({"prompt": "p", "chosen": "c", "rejected": "x"}, "preference", ["user:p", "assistant:c"]),
        ({"question": "q", "answer": "a", "context": "c"}, "question-answer", ["system:c", "user:q", "assistant:a"]),
        ({"dialog": ["x", "y", "z"]}, "dialog", ["user:x", "assistant:y", "user:z"]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "message-parts", ["user:ab"]),
        ({"other": 1}, None, []),
    ]
    seen = {}
    for record, name, turns in cases:
        key, mapping = chat.mapping_for(chat.paths(record), seen)
        assert (mapping and mapping["name"]) == name and len(key) == 32
        assert [f"{t['role']}:{t['text']}" for t in (chat.turns_by(mapping, record) if mapping else [])] == turns


def test_format_is_reversible():
    from riskspark.llm import chat

    r = random.Random(1)
    alphabet = ["\\", "<turn>", "</turn>", "\n", "<\\turn>", "</turn>\n", "n", "/", "<", "é😀", "t"]
    for _ in range(3000):
        word = lambda: "".join(r.choice(alphabet) for _ in range(r.randrange(8)))
        turns = [{"role": r.choice(["user", "assistant", word()]), "text": word()} for _ in range(r.randrange(5))]
        text, spans = chat.formatted(turns)
        assert chat.parsed(text) == turns
        assert [chat.unescape(text[s["start"] : s["end"]]) for s in spans] == [t["text"] for t in turns if t["role"] == "assistant"]


def test_records(spark):
    from riskspark.llm import chat

    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None), (None, 3, "user", "x"), (None, 1, "user", "y"), (3, None, "assistant", "  \\n <turn>")]
    df = spark.createDataFrame([(*x, "q") for x in rows], "conv_id bigint, turn bigint, role string, text string, record string")
    out = chat.read_back(chat.format_turns(chat.canonical_turns(chat.records_of(df))))
    got = {r.conv_id: ([(t.role, t.text) for t in r.read_turns], r.read_loss, r.layout) for r in out.collect()}
    assert got == {1: ([("user", "a"), ("assistant", "b"), ("assistant", "b")], "bb", "messages"), 2: ([("", "")], "", "messages"), None: ([("user", "y"), ("user", "x")], "", "messages"), 3: ([("assistant", "  \\n <turn>")], "  \\n <turn>", "messages")}
    odd = spark.createDataFrame([(None,), ("no json",), ("[1]",), ('{"messages": [1, 2]}',), ('{"messages": []}',)], "record string")
    assert [r.turns for r in chat.canonical_turns(odd).collect()] == [[]] * 5
    assert chat.canonical_turns(odd.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [100_000, 700])
def test_nearest(spark, monkeypatch, shard):
    from riskspark.llm import ann

    monkeypatch.setattr(ann, "SHARD", shard)
    r = np.random.default_rng(2)
    v = r.standard_normal((2000, 16)) * r.uniform(0.5, 2, (2000, 1))
    v[100:900] = v[100]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [None] * 16, 0), (None, v[3].tolist(), 0), (5080, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int")
    got = {}
    for x in ann.nearest(df, df.filter("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    hit = n = 0
    for q in range(0, 2000, 20):
        score = (v * v[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(2000), -score)) if i != q][:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(s - score[i]) < 1e-12 for _, i, s in mine) and q not in [m[1] for m in mine]
        hit, n = hit + len({m[1] for m in mine} & set(best)), n + 20
    assert hit / n >= 0.9 and not {5000, 5020, 5040, 5060} & set(got)
    assert ann.nearest(df.limit(0), df, k=3).count() == 0


def test_urls(spark):
    from riskspark.llm import urls

    pages = [(1, "http://Example.com/en/7?x"), (2, "https://a.example.com/en/8"), (3, "ftp://b.net/de/1#t"), (4, "http://example.net/de/8"), (5, "http://x.org/es/"), (6, None), (7, "no host"), (8, "http://evil.info/a"), (9, "http://sub.evil.info:8/b"), (10, "http://good.info"), (1, "http://x.com/"), (None, "http://example.com/en/1")]
    pages += [(i, "http://evil.info/p") for i in range(100, 160)] + [(i, "http://good.info/p") for i in range(200, 260)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id bigint, url string, host string")
    marks = spark.createDataFrame([(i, 1) for i in range(100, 160)] + [(i, 0) for i in range(200, 260)] + [(None, 1), (100, None)], "page_id bigint, bad int")
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in urls.judge(df, marks).collect()}
    assert got[1, "example.com"] == ("/en/7", "example.com/en/7", "allow") and got[2, "a.example.com"] == ("/en/8", "com/en/", "block") and got[3, "b.net"] == ("/de/1", "net/de/", "allow")
    assert got[4, "example.net"] == ("/de/8", "example.net/de/8", "block") and got[5, "x.org"] == ("/es/", "org/es/", "block") and got[6, ""] == ("", None, "allow") and got[7, ""][0] == ""
    assert got[8, "evil.info"] == ("/a", None, "block") and got[10, "good.info"] == ("", None, "allow") and got[1, "x.com"] == ("/", None, "allow") and got[None, "example.com"][1] == "com/en/"
    assert urls.judge(df, marks.limit(0)).filter("rule is null and verdict = 'block'").count() == 0 and urls.judge(df.limit(0), marks).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    prose = lambda n: " ".join(r.choice("qrstuvwxyz") + str(r.randrange(500)) for _ in range(n)).replace("0", "a")
    bench = prose(30)
    base = prose(80)
    rows = {i: prose(60) for i in range(40)}
    rows |= {i: rows[i] + " vileword" for i in range(0, 40, 4)} | {50: base, 51: base + " tail", 52: base} | {60: prose(20) + " " + bench + " " + prose(5)}
    rows |= {i: f"the same line\n{prose(50)}" for i in range(70, 82)} | {90: "", 91: None, 92: "the same line"}
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept_text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(rows) - set(range(0, 40, 4)) - {51, 52, 60}
    assert all(x.round_trip for x in got.values()) and got[92].n_tokens == got[91].n_tokens == 0
    stage = dict(corpus_pipeline.STAGES)["line dedup"](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    lines = {x.doc_id: x for x in stage.collect()}
    assert stage.columns == spark.read.parquet(f"{tmp_path}/documents.parquet").columns
    assert lines[92].text == "" and lines[92].n_chars == 0 and all("same line" not in lines[i].text for i in range(70, 82)) and lines[5].text == rows[5]
    assert json


def test_clustered_neighbours(spark, monkeypatch):
    """Clusters: a tenth of the sample and of each shard is enough; measured breadth needs less. Shards and copies are many here."""
    from riskspark.llm import ann

    monkeypatch.setattr(ann, "SHARD", 500)
    monkeypatch.setattr(ann, "QUERIES", 40)
    r = np.random.default_rng(4)
    centres = r.standard_normal((60, 24))
    v = centres[r.integers(0, 60, 6000)] + 0.1 * r.standard_normal((6000, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>").repartition(6)
    asked = np.arange(0, 6000, 20)
    best = {int(q): {int(i) for i in np.lexsort((np.arange(6000), -(v @ v[q])))[:11] if i != q} for q in asked}
    for breadth in (0.1, None):
        got = {int(q): set() for q in asked}
        for x in ann.nearest(df, df.filter("vec_id % 20 = 0"), k=10, breadth=breadth).collect():
            got[x.query_id].add(x.vec_id)
        assert sum(len(got[q] & set(list(best[q])[:10])) for q in got) >= 0.9 * sum(min(10, len(b)) for b in best.values()), breadth


def test_repeated_queries_and_ids(spark):
    """A repeated query row counts once; an id of several vectors is listed once, at its nearest."""
    from riskspark.llm import ann

    r = np.random.default_rng(5)
    v = r.standard_normal((300, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(0, v[0].tolist())] * 25 + [(7, (3 * v[0]).tolist()), (7, v[7].tolist())]
    df = spark.createDataFrame(rows, "`vec.id` bigint, `the.vector` array<double>")
    got = [(x.rank, x.vec_id, x.score) for x in ann.nearest(df, df.filter("`vec.id` = 0"), 20, "vec.id", "the.vector").collect()]
    score = (v * v[0]).sum(axis=1)
    score[7] = max(score[7], (3 * v[0] * v[0]).sum())
    best = [i for i in np.lexsort((np.arange(300), -score)) if i != 0][:20]
    assert sorted(got)[0][1] == 7 and len({x[1] for x in got}) == 20 and [x[1] for x in sorted(got)] == best


def test_odd_records(spark):
    """Lone surrogates, deep nesting, strings beside parts, and keys that look like paths."""
    from riskspark.llm import chat

    part = {"type": "text", "text": "p"}
    records = [
        '{"messages": [{"role": "us\\ud800er", "content": "x\\udfffy"}]}', '{"\\ud800": 1, "prompt": "p", "response": "r"}', "[" * 100_000, '{"a":' * 3000 + "1" + "}" * 3000,
        json.dumps({"messages": [{"role": "user", "content": "s"}, {"role": "user", "content": [part, part]}]}), json.dumps({"prompt": "x" * 2_000_000, "response": ""}),
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(records)], "i int, record string")
    got = {x.i: [(t.role, t.text) for t in x.read_turns] for x in chat.read_back(chat.format_turns(chat.canonical_turns(df))).collect()}
    assert got[0] == [("us\ufffder", "x\ufffdy")] and got[1] == [("user", "p"), ("assistant", "r")] and got[2] == got[3] == [] and got[4] == [("user", "s"), ("user", "pp")] and len(got[5][0][1]) == 2_000_000
    prints = [chat.fingerprint(chat.paths(x)) for x in ({"a": {"b": 1}}, {"a.b": 1}, {"a[]": 1}, {"a": [1]}, {"a\nb": 1}, {"a": 1, "b": 1})]
    assert len(set(prints)) == len(prints)
    assert chat.format_turns(chat.canonical_turns(df.limit(0))).count() == 0


def test_query_meets_several_layouts(spark):
    from riskspark.llm import chat

    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = chat.canonical_turns(chat.records_in_layouts(rows))
    one = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in chat.canonical_turns(chat.records_of(rows)).collect()}
    assert {x.conv_id: [(t.role, t.text) for t in x.turns] for x in out.collect()} == one
    assert out.select("fingerprint").distinct().count() >= 2
    odd = spark.createDataFrame([(1, 0, "human", "a"), (1, 1, "gpt", "b"), (2, 0, "system", ""), (2, 1, "user", "u"), (2, 2, "assistant", "v"), (3, 0, "user", ""), (3, 1, "assistant", None), (None, 0, "user", "z")], "conv_id bigint, turn bigint, role string, text string")
    got = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in chat.canonical_turns(chat.records_in_layouts(odd)).collect()}
    assert got == {1: [("human", "a"), ("gpt", "b")], 2: [("system", ""), ("user", "u"), ("assistant", "v")], 3: [("user", ""), ("assistant", "")], None: [("user", "z")]}


def test_domains(spark):
    from riskspark.llm.urls import with_host

    cases = {
        "http://h.com:8080/x": ("h.com:8080", "com", "h.com"), "http://10.0.0.1/": ("10.0.0.1", "10.0.0.1", "10.0.0.1"), "http://10.0.0.1:80/": ("10.0.0.1:80", "10.0.0.1", "10.0.0.1"), "http://user@a.h.co.uk/": ("user@a.h.co.uk", "co.uk", "h.co.uk"),
        "http://[::1]:80/": ("[::1]:80", "[::1]", "[::1]"), "x": ("", "", ""), "http://A.B.c.De?q": ("a.b.c.de", "de", "c.de"),
    }
    got = {r.url: (r.host, r.suffix, r.domain) for r in with_host(spark.createDataFrame([(u,) for u in cases], "url string")).collect()}
    assert got == cases


def test_reputation_of_held_out_pages(spark):
    """Hosts of which other pages are bad are blocked; a page's own outcome plays no part; neutral hosts stay."""
    from pyspark.sql import functions as F

    from riskspark.llm.urls import judge, op10_urls, spam_words

    pages = [(i, f"http://www.free-bets.example.com/{i}", 1) for i in range(30)] + [(100 + i, f"http://news.example.com/{i}", int(i == 0)) for i in range(40)]
    pages += [(200, "http://lone-casino.example.com/", 1), (201, "http://www.free-bets.example.com/clean", None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, bad int")
    got = {r.page_id: r.verdict for r in judge(df, bad="bad", rules=()).collect()}
    assert all(got[i] == "block" for i in range(30)) and got[201] == "block" and all(got[100 + i] == "allow" for i in range(40)) and got[200] == "allow"
    flipped = {r.page_id: r.verdict for r in judge(df.withColumn("bad", F.when(F.col("page_id") == 3, 0).otherwise(F.col("bad"))), bad="bad", rules=()).collect()}
    assert flipped[3] == "block"
    d = "/root/testdata/sf0.1"
    marked = spark.read.parquet(f"{d}/pages.parquet").select("page_id", spam_words(F.col("url")).alias("bad"))
    seen = op10_urls(spark, d).filter("rule is null").join(marked, "page_id").groupBy("bad").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked")).collect()
    by = {r.bad: (r.n, r.blocked) for r in seen}
    assert by[0][1] == 0 and by[1][1] >= 0.5 * by[1][0], by
