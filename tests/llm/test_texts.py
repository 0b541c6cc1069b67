"""Operators on documents against plain versions, with the odd cases: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

SEP = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORDS = [f"w{i}" for i in range(400)]


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    base, line = prose(60), "A common line, which MANY documents hold."
    out = [None, "", " \t\n", "one", "Two words", "two  WORDS", prose(6000), base, base, base.upper()]
    for k in range(30):
        near = base.split(" ")
        near[r.randrange(60)] = f"x{k}"
        out.append(" ".join(near))
    for k in range(12):
        out.append(f"{prose(20)}\n  {line}\t\n{prose(8)}\n{line.upper()}" if k % 2 else f"{line}\n{prose(15)}")
    return out + [prose(r.randrange(1, 80)) + "\n" + prose(3) for _ in range(40)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "kept", "hit", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kept_text string, items string, score double").repartition(3)


def test_lines(docs, texts):
    from riskspark.llm.line_dedup import drop_repeated_lines

    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    for options in ({}, {"broadcast_bytes": 0}):
        got = {r.doc_id: r for r in drop_repeated_lines(docs, min_docs=10, **options).collect()}
        for i, t in enumerate(texts):
            lines = (t or "").split("\n")
            kept = [x for x in lines if not (key(x) and n[key(x)] >= 10)]
            assert (got[i].kept_text, got[i].n_lines, got[i].n_dropped, got[i].items) == ("\n".join(kept), len(lines), len(lines) - len(kept), "hit")


def test_first_lines_stay(spark):
    from riskspark.llm.line_dedup import drop_repeated_lines

    rows = spark.createDataFrame([(i, f"same\nown {i}\nsame") for i in range(5)] + [(None, "same")], "doc_id bigint, text string")
    for options in ({}, {"broadcast_bytes": 0}):
        got = {r.doc_id: r.kept_text for r in drop_repeated_lines(rows, min_docs=2, keep="first", **options).collect()}
        assert got == {0: "same\nown 0", None: "", **{i: f"own {i}" for i in range(1, 5)}}


def test_no_documents(spark, docs):
    from riskspark.llm import decontaminate, line_dedup, minhash, toxicity

    none = docs.limit(0)
    bench = spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert line_dedup.drop_repeated_lines(none).count() == decontaminate.benchmark_hits(none, bench).count() == minhash.near_duplicates(none).count() == 0
    assert toxicity.scored(none, toxicity.train(none, labels)).count() == 0
    assert not decontaminate.benchmark_hits(docs, bench.limit(0)).filter("contaminated").count()


def test_bloom_never_misses():
    import numpy as np

    from riskspark.llm.line_dedup import Bloom

    some = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    bloom = Bloom(1 << 16)
    bloom.add(some[:3000])
    assert bloom.has(some[:3000]).all() and bloom.has(some[3000:]).mean() < 0.1


def plain_hits(text, items, window=10):
    words, hit, found = SEP.findall(lower(text)), set(), set()
    for item, t in items:
        own = SEP.findall(lower(t))
        n = min(window, len(own))
        wanted = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in wanted:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination(spark, docs, texts):
    from riskspark.llm.decontaminate import benchmark_hits

    long = texts[6].split(" ")
    items = [(1, " ".join(long[100:125])), (2, "Two, words!"), (3, None), (4, "..."), (5, " ".join(long[110:119])), (6, texts[7]), (7, "one"), (1, " ".join(long[400:412])), (8, "é ü " * 6)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    for options in ({}, {"shard_bytes": 2000}):
        got = {r.doc_id: r for r in benchmark_hits(docs, bench, **options).collect()}
        for i, t in enumerate(texts):
            n, hit, names = plain_hits(t, items)
            assert (got[i].n_words, got[i].n_hit, sorted(set(got[i]["items"])), got[i].contaminated) == (n, hit, names, hit > 0), i


def plain_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def test_near_duplicates(docs, texts):
    from riskspark.llm.minhash import near_duplicates

    got = {r.id: r for r in near_duplicates(docs).collect()}
    for i, (n, component) in enumerate(plain_components(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, component, component == i), i


def test_chain_of_near_duplicates(spark):
    """No document is near the first one but the second: links must be found within a bucket, too, not only to its smallest."""
    from riskspark.llm.minhash import drop_near_duplicates, near_duplicates

    words, rows = [f"v{i}" for i in range(80)], []
    for k in range(12):
        for i in range(4):
            words[(k * 7 + i) % 80] = f"c{k}-{i}" if k else words[i]
        rows.append((100 - k, " ".join(words)))
    rows += [(100, rows[0][1]), (None, rows[0][1]), (7, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = plain_components([t for _, t in sorted(rows[:12])])
    got = {r.id: r.component_id for r in near_duplicates(df).filter("id > 7").collect()}
    ids = sorted(i for i, _ in rows[:12])
    assert got == {i: ids[c] for i, (_, c) in zip(ids, wanted, strict=True)}
    kept = drop_near_duplicates(df).collect()
    assert Counter(r.doc_id for r in kept) == Counter({**{i: 1 for i in set(got.values())}, None: 1, 7: 1})


def test_blocks_of_large_buckets(spark, docs, texts, monkeypatch):
    from riskspark.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    got = {r.id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: c for i, (_, c) in enumerate(plain_components(texts))}


def test_components(spark):
    from riskspark.llm.minhash import components

    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 330)]
    up = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {x.id: x.comp for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(x, x) == c for x, c in up.items())


def test_secrets(spark):
    from riskspark.llm import secrets
    from riskspark.llm.bpe import vocabulary

    import public_tokenizers

    vocab = vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    run, digest = "Zk3vQ9xT7bL2mW8rY4pN6cJ1", "0123456789abcdef" * 2
    cases = {
        None: "", "": "", f"é Password: '{run}'": "assign:2:37", "token=abc": "", "secret: token:abcdefgh": "",
        f"x {run} y": f"random:2:{2 + len(run)}", f"id {digest} end": "hex:3:35", "AKIA" + "A1" * 8: "access:0:20", "AKIA" + "A1" * 7: "",
        "some_long_snake_case_identifier_name": "", "12345678901234567890123456": "hex:0:26", "123e4567-e89b-12d3-a456-426614174000": "", "ſecret=abcdefgh": "",
    }
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], "doc_id bigint, text string, found string")
    got = {r.text: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.found) for r in secrets.scan(rows, vocab).collect()}
    assert got == cases


def test_base_spans_equal_the_plain_patterns(texts):
    from riskspark.llm.secrets import ASSIGN, base_spans

    r = random.Random(1)
    alphabet = ["token", "=", " ", ":", "'", "AKIA", "API_KEY", "a1", "f", "Z9", "deadbeef", "é", "-", "passwd", "\n"]
    for _ in range(2000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
        plain = [(m.start(), k, m.end()) for k, (p, n, g) in enumerate(((ASSIGN, 6, 2), (re.compile("AKIA[A-Z0-9]+"), 20, 0), (re.compile("[0-9a-f]+"), 24, 0))) for m in p.finditer(text) if len(m[g]) >= n]
        assert sorted(base_spans(text)) == sorted(plain), text


def test_bpe_is_tiktoken(spark):
    import base64

    import numpy as np
    import public_tokenizers
    import tiktoken

    from riskspark.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    alphabet = "abcdefgh eéñ日本 \n\t'-_0123²Ⅷ😀\x85\x1c"
    some = [None, "", "a" * 4000, "ab" * 1500, " ".join("xyzzy" for _ in range(500))] + ["".join(r.choice(alphabet) for _ in range(r.randrange(200))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(some)], "doc_id bigint, text string, ids string, decoded string")
    vocab = bpe.vocabulary(spark, path, public_tokenizers.PATTERN)
    for row in bpe.decode(bpe.encode(rows, vocab), vocab).collect():
        assert np.frombuffer(row.ids, "<u4").tolist() == plain.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()


def test_toxicity(spark):
    from riskspark.llm.toxicity import scored, train

    r = random.Random(3)
    prose = lambda n: " ".join(r.choice(WORDS).replace("0", "a").replace("1", "b") + r.choice("qrstuv") * 3 for _ in range(n))
    toxic = ["vileword", "nastyterm", "badphrase"]
    rows = [(i, prose(30) + (" " + r.choice(toxic) + "".join(r.choice("abc") for _ in range(3)) if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, rows[0][1] + " " + prose(5000))], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(0, 0), (None, 1), (5, 7)], "doc_id bigint, toxic int")
    got = {x.doc_id: x for x in scored(docs.selectExpr("*", "'a' AS score", "1 AS predicted"), train(docs, labels)).collect()}
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(300)) and got[1000].predicted == got[1001].predicted == 0 and got[1002].predicted == 1


def test_counterfactuals_keep_mentions_neutral(spark):
    from riskspark.llm.toxicity import scored, train

    rows = [(i, f"they said {'women' if i % 2 else 'men'} {'hateful' if i % 2 and i % 5 else 'plain'} word{i}", int(bool(i % 2 and i % 5))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    ask = spark.createDataFrame([(1, "women came"), (2, "men came")], "doc_id bigint, text string")
    gap = {}
    for weight in (0.0, 50.0):
        got = {r.doc_id: r.score for r in scored(ask, train(docs, docs, pair_weight=weight)).collect()}
        gap[weight] = abs(got[1] - got[2])
    assert gap[50.0] < gap[0.0] / 2
    assert train(docs, docs.filter("toxic = 1")).score("x") > 0.9 > 0.1 > train(docs, docs.limit(0)).score("x")


def test_licenses(spark, texts):
    from riskspark.llm.licenses import PHRASES, TEMPLATES, need, scan, words_of

    some = [None, "", "MIT license", "mit\n LICENSE, mit-license", "submit license", "apache license version 2.0", "Released under the MIT License.", "we released this under what is the mit style license",
            "x\nAll rights reserved\ny", "all rights", "CC BY-NC 4.0 and cc by nc", "This is free and unencumbered software released into public domain", *texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(some)] + [(None, "MIT license"), (2, "none")], "doc_id bigint, text string")
    got = defaultdict(list)
    for r in scan(rows).collect():
        got[r.id].append(r)
    for i, t in enumerate(some):
        w = words_of(t or "")
        places = [(k, label) for p, label in PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        share = {}
        for line in (t or "").split("\n"):
            own = set(words_of(line))
            for label, template in TEMPLATES:
                want = set(words_of(template))
                if len(own & want) >= need(len(want)):
                    share[label] = max(share.get(label, 0), len(own & want) / len(want))
        base = sorted({x for _, x in places})
        row = next(r for r in got[i] if i != 2 or r.n_base)
        at = [k for k, _ in places]
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels, row.labels) == (len(w), len(at), min(at, default=None), max(at, default=None), base, sorted({*base, *share})), t
        assert row.score == (1.0 if at else max(share.values(), default=0.0))
    assert got[None][0].n_base == 1 and len(got[2]) == 2
    assert hashlib  # digests are the queries' part


def test_wrapped_licenses(spark, tmp_path):
    from riskspark.llm.licenses import TEMPLATES, op9_licenses, scan

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal\nin the Software without restriction"
    cut = mit.replace("\n", "\n \t\n")  # empty lines end a paragraph
    some = [mit, f"x\n\n{mit}\n\ny", cut, "All rights\nreserved", "All rights reserved\n\nand\nmore", mit.replace("\n", "\r\n"), None, *(t.replace(" ", "\n") for _, t in TEMPLATES)]
    spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.labels, r.score) for r in op9_licenses(spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(7)] == [("mit", 1.0), ("mit", 1.0), ("", 0.0), ("all-rights-reserved", 1.0), ("all-rights-reserved", 1.0), ("mit", 1.0), ("", 0.0)]
    assert all(label in got[7 + k][0].split(",") for k, (label, _) in enumerate(TEMPLATES))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [{r.id for r in scan(docs, block=b).collect() if "mit" in r.labels} >= {0, 1, 5} for b in ("line", "paragraph", "both")] == [False, True, True]


def test_secrets_of_one_letter_case():
    import public_tokenizers

    from riskspark.llm.secrets import _counter, random_spans

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        count = _counter(f.read(), public_tokenizers.PATTERN)
    for run in ("XKQZJ-VWPQH-TRMBN-ZXCVB", "xkqzjvwpqhtrmbnzxcvb", "qhzxvkwjprtmbdnglcfs", "QHZ_XVK_WJP_RTM_BDN_GLC"):
        assert random_spans(f"a {run} b", [], count) == [(2, 3, 2 + len(run))], run
    for run in ("my_long_function_name_here", "getUserAccountInformation", "node_modules/package/index", "MAX_NUMBER_OF_CONNECTIONS", "user-2021-03-04-backup", "src/main/java/org/apache", "2021-03-04-1234-5678-90"):
        assert random_spans(f"a {run} b", [], count) == [], run


def test_notices_are_told_apart(spark, tmp_path):
    """The GPL's sentence holds nine of the ten words of the AGPL's; scattered words are no notice."""
    from riskspark.llm.licenses import TEMPLATES, op9_licenses, scan

    notices = {label: t for label, t in TEMPLATES}
    some = [notices["gpl-3"], notices["agpl-3"], "he reserved all seats, of all rights", "All rights reserved.", "Released by us under the MIT and a License", *(t for _, t in TEMPLATES)]
    spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.labels for r in op9_licenses(spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(5)] == ["gpl-3", "agpl-3", "", "all-rights-reserved", ""]
    assert [got[5 + k] for k in range(len(TEMPLATES))] == [label if label != "cc-by-nc-4" else "cc-by-nc,cc-by-nc-4" for label, _ in TEMPLATES]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    none = scan(docs, templates=(), phrases=()).collect()
    assert all(r.labels == [] and r.score == 0 for r in none) and scan(docs.limit(0)).count() == 0
    clashing = docs.selectExpr("doc_id", "text", "1 AS id", "2 AS hash", "3 AS labels", "4 AS `a.b`")
    assert sorted(r.id for r in scan(clashing, block="both", pairs=True).filter("size(labels) > 0").collect()) == sorted(k for k, v in got.items() if v)


def test_unlike_classes_of_one_bucket(spark, monkeypatch):
    """Thousands of unlike documents share a passage, so that some of their buckets are large and hold many components: a member is copied a few times at most. Split buckets give the same."""
    import numpy as np

    from riskspark.llm import minhash

    r = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"u{i}-{k}" for k in range(40))) for i in range(4000)]
    rows += [(10_000 + i, rows[i][1] + " tail") for i in range(0, 4000, 100)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    met = spark.sparkContext.accumulator(0)
    plain = minhash._close

    def counted(sid, comp, side, sig, limit):
        met.add(len(sid))
        return plain(sid, comp, side, sig, limit)

    monkeypatch.setattr(minhash, "_close", counted)
    got = {x.id: x.component_id for x in minhash.near_duplicates(docs).collect()}
    assert got == {i: i % 10_000 for i, _ in rows}
    assert 0 < met.value < minhash.BANDS * len(rows)
    monkeypatch.setattr(minhash, "BLOCK", 8)  # buckets above 256 are split
    assert {x.id: x.component_id for x in minhash.near_duplicates(docs).collect()} == got
    x = np.random.default_rng(1).integers(0, 2**63, (40, minhash.FINE_LONGS)).astype(np.uint64)
    every = minhash._close(np.arange(40), np.arange(40), np.full(40, 2), x, 10_000)
    assert len(every[0]) == 40 * 39 // 2


def test_repeated_ids_keep_their_texts(spark):
    from riskspark.llm.minhash import drop_near_duplicates

    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "x"), (2, a, "y"), (3, "c", "z"), (None, a, "n"), (None, a, "n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `dropped.id` string")
    kept = Counter((r[0], r[1], r[2]) for r in drop_near_duplicates(df).collect())
    assert kept == Counter({(1, a, "x"): 1, (1, b, "x"): 1, (3, "c", "z"): 1, (None, a, "n"): 2})


def test_odd_column_names(spark):
    """Dots in names, and names that the operators use themselves."""
    from riskspark.llm import decontaminate, line_dedup, toxicity

    rows = [(i, "same\nown words of the item here", "k", "u", 1, "g", "s") for i in range(12)]
    df = spark.createDataFrame(rows, "`doc.id` bigint, `the.text` string, key string, uid string, `__key` int, gone string, searched_text string")
    bench = spark.createDataFrame([(1, "own words"), (2, "of the item")], "`item.id` int, `item.text` string")
    for options in ({}, {"shard_bytes": 20}):
        got = decontaminate.benchmark_hits(df, bench, "the.text", "item.id", "item.text", **options)
        assert got.columns[:7] == df.columns and {(r.n_words, r.n_hit, tuple(r["items"]), r.uid) for r in got.collect()} == {(7, 5, ("1", "2"), "u")}
    for options in ({"keep": "first"}, {"keep": "first", "broadcast_bytes": 0}, {"broadcast_bytes": 0}, {}):
        got = line_dedup.drop_repeated_lines(df, "the.text", "doc.id", **options).collect()
        assert {(r.n_lines, r.key, r.uid, r["__key"], r.gone) for r in got} == {(2, "k", "u", 1, "g")}
        assert sorted(r.n_dropped for r in got) == [0 if "keep" in options else 2] + [2] * 11
    with pytest.raises(ValueError):
        line_dedup.drop_repeated_lines(df, "the.text", "doc.id", min_docs=1)
    model = toxicity.train(df, spark.createDataFrame([(1, 0), (2, 1)], "`doc.id` bigint, toxic int"), "the.text", "doc.id")
    assert toxicity.scored(df, model, "the.text").columns == [*df.columns, "score", "predicted"]


def test_secrets_beside_many_spans():
    """Runs and spans are walked side by side: time grows with the text, not with its square. Known digests are no secrets."""
    import time

    from riskspark.llm.secrets import base_spans, random_spans

    count, took = (lambda run: len(run)), []
    for n in (2000, 16000):
        text = "token=abcdefgh QHZXVKWJPRTMBDNGLCFSqq7z " * n
        began = time.perf_counter()
        found = random_spans(text, base_spans(text), count)
        took.append(time.perf_counter() - began)
        assert len(found) == n
    assert took[1] < 40 * took[0]
    digest = "47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU"
    assert [len(random_spans(f"{x}{digest}= y", [], count)) for x in ("sha256-", "SHA256:", "SHA-256:", "key:", "")] == [0, 0, 0, 1, 1]
    assert random_spans("x" * 1_200_000, [], lambda run: 1) == []


def test_random_strings_are_found(spark):
    """Precision and recall of the token ratio, on strings planted in the documents' own prose."""
    import base64

    import public_tokenizers

    from riskspark.llm import secrets
    from riskspark.llm.bpe import vocabulary

    r = random.Random(17)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = {
        "base62": lambda: "".join(r.choice(letters + letters.lower() + "0123456789") for _ in range(r.randrange(20, 48))),
        "base64": lambda: base64.b64encode(r.randbytes(r.choice((18, 24, 30)))).decode(),
        "base64url": lambda: base64.urlsafe_b64encode(r.randbytes(r.choice((18, 24, 30)))).decode(),
        "base32": lambda: base64.b32encode(r.randbytes(20)).decode(),
    }
    prose = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if x.text and "=" not in x.text]
    vocab = vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    planted = []
    for i in range(1200):
        kind, text = list(kinds)[i % 4], r.choice(prose)
        cut = text.find(" ", r.randrange(len(text)))
        made, head = kinds[kind](), text[: max(0, cut)]
        planted.append((i, f"{head} {made} {text[max(0, cut):]}", kind, len(head) + 1, len(head) + 1 + len(made)))
    df = spark.createDataFrame(planted, "doc_id int, text string, kind string, a int, b int")
    caught, wrong = Counter(), 0
    for x in secrets.scan(df, vocab).collect():
        spans = [s for s in x.found if s.kind == "random"]
        hit = [s for s in spans if x.a <= s.start and s.end <= x.b]
        caught[x.kind] += bool(hit)
        wrong += len(spans) - len(hit)
    assert all(n >= 0.97 * 300 for n in caught.values()) and wrong <= 0.01 * sum(caught.values()), (caught, wrong)


def test_both_ways_of_merging(spark):
    """Pieces by matrices alone, and by heaps alone: the same ids."""
    import public_tokenizers

    from riskspark.llm import bpe

    r = random.Random(6)
    some = ["x" * 700, "日本語" * 90, "ab" * 400, *("".join(r.choice("abcdeéß") for _ in range(r.randrange(1, 600))) for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(some)), "doc_id int, text string")
    vocab = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = [{x.doc_id: bytes(x.ids) for x in bpe.encode(rows, vocab, matrix_bytes=n).collect()} for n in (1, 64, 1 << 20)]
    assert ids[0] == ids[1] == ids[2]
    both = bpe.both_ways(rows.selectExpr("doc_id", "text", "1 AS ids", "2 AS decoded"), vocab).collect()
    assert {x.doc_id: bytes(x.ids) for x in both} == ids[0] and all(bytes(x.decoded) == x.text.encode() for x in both)


def test_mentions_stay_neutral(spark):
    """Labelled texts in which toxicity goes along with one group: the penalty lowers false alarms on neutral mentions of it."""
    from riskspark.llm.toxicity import scored, train

    r = random.Random(21)
    prose = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if x.text][:120]
    cut = lambda: " ".join(r.choice(prose).split()[:40])
    rows = [(i, f"{cut()} {'immigrants' if r.random() < 0.7 else 'citizens'} {r.choice(['vileword', 'nastyterm', '']) if r.random() < 0.9 else ''}", 1) for i in range(300)]
    rows += [(1000 + i, f"{cut()} {'immigrants' if r.random() < 0.05 else 'citizens' if r.random() < 0.3 else ''}", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    neutral = spark.createDataFrame([(i, f"{cut()} immigrants") for i in range(200)], "doc_id bigint, text string")
    bad = spark.createDataFrame([(i, f"{cut()} {w}") for i in range(100) for w in ("vileword",)], "doc_id bigint, text string")
    rate = {}
    for weight in (0.0, 20.0):
        model = train(docs, docs, pair_weight=weight)
        rate[weight] = tuple(scored(x, model).selectExpr("avg(predicted)").first()[0] for x in (neutral, bad))
    assert rate[0.0][0] > 0.5 > 0.2 > rate[20.0][0] and rate[20.0][1] > 0.9, rate


def test_screening_leaves_the_model(spark):
    """A plain fit of the same loss over all features, without the screen, decides the same documents."""
    import numpy as np

    from riskspark.llm import toxicity

    r = random.Random(8)
    texts = [" ".join(r.choice(WORDS) for _ in range(30)).translate(str.maketrans("0123456789", "abcdefghij")) + (" vile" if i % 3 == 0 else "") for i in range(240)]
    toxic = np.array([int(i % 3 == 0) for i in range(240)])
    own = [toxicity._hashed(toxicity.words(t)) for t in texts]
    none = [np.zeros(0, np.uint64)] * 240
    screened = toxicity.fit(toxic, own, none, none)
    old, toxicity.SCREEN = toxicity.SCREEN, 0.0
    try:
        plain = toxicity.fit(toxic, own, none, none)
    finally:
        toxicity.SCREEN = old
    assert [screened.score(t) >= 0.5 for t in texts] == [plain.score(t) >= 0.5 for t in texts] == [bool(x) for x in toxic]


def test_license_contract(spark, tmp_path):
    """Base columns of the query, held against a plain reading of its contract: the phrase is "under the mit license"; less is the method's."""
    import re

    from riskspark.llm.licenses import op9_licenses

    listed = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    some = [None, "", "MIT license", "Under the\nMIT-License", "the mit license", "under mit license", "mit license; sold UNDER THE MIT LICENSE and under_the_mit_license", "a MIT License cc by nc", "under the mit licenses",
            "\u0130 under the \u212a mit license", "Apache License 2, apache license version 2.0", "under the\x00mit\u00a0license"]
    r = random.Random(9)
    some += [" ".join(r.choice([*listed, "mit license", "Under the", "MIT", "x"]) for _ in range(r.randint(1, 12))) for _ in range(300)]
    spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op9_licenses(spark, str(tmp_path)).collect()}
    assert len(got) == len(some)
    for i, t in enumerate(some):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t or ""))
        places = [(k, label) for p, label in listed.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in places}))), t
        assert {v for _, v in places} <= set(x.labels.split(",")) and x.score == (1.0 if places else x.score), t
    assert [(got[k].base_labels, got[k].labels, got[k].score) for k in (2, 4, 5, 7)] == [("", "mit", 1.0)] * 3 + [("cc-by-nc", "cc-by-nc,mit", 1.0)]
