"""Benchmark decontamination: Wu-Manber search for every window of benchmark words in whole documents.

Words are runs of [0-9a-z] and characters from U+0080, after A-Z are lowered. A window is WINDOW consecutive words of an
item; an item of fewer words, but not none, is one window. Windows of one length are searched together:

* shift table: the last BLOCK words ending at a position, hashed, tell how many words the search may move on without
  missing a window; a batch's positions move in lockstep, as many cursors over one numpy array;
* suffix-hash buckets: where the shift is 0, the block's hash and a hash of the whole window select test strings;
* direct comparison of the words' bytes confirms each occurrence. So hashes never decide a result.

The benchmark's windows go to every task. Their measured size is checked: above shard_bytes, items are dealt into shards
by hash, each shard is searched in a pass of its own, and hits of all passes are united by document, with one join.
The shift table has SLOTS slots for each window, so that it skips as far with many windows as with few.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import Scratch, byte_table, col, fresh, mapped, mix, raw, sliced, table, word_bounds

WINDOW, BLOCK, SEGMENT = 10, 2, 128
SLOTS, LEAST_BITS, MOST_BITS, CHUNK = 8, 18, 24, 1 << 20
LOWER = byte_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SEEDS = mix(np.arange(1, 257, dtype=np.uint64))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def _codes(padded: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A cheap code of words: their first 8 bytes, last 8 and length. padded: the text and 8 more bytes."""
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = ends - starts
    head = eight[starts] & _MASKS[np.minimum(size, 8)]
    tail = np.where(size > 8, eight[np.maximum(ends - 8, 0)], np.uint64(0))
    with np.errstate(over="ignore"):
        return mix(head + tail * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _joined(codes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(codes[0]), np.uint64)
    with np.errstate(over="ignore"):
        for i, c in enumerate(codes):
            out = out * np.uint64(0x9FB21C651E98DF25) + (c ^ _SEEDS[i % 256])
        return mix(out)


class WuManber:
    """The tables for windows of one length in words; windows: the words joined by a space -> the items that have it."""

    def __init__(self, length: int, windows: dict[bytes, list[int]]):
        self.length, self.block = length, min(BLOCK, length)
        self.windows = windows
        joined = list(windows)
        self.bits = min(max((SLOTS * len(joined) - 1).bit_length(), LEAST_BITS), MOST_BITS)
        codes = np.zeros((len(joined), length), np.uint64)
        for row, window in enumerate(joined):
            padded, starts, ends = window + b" " * 8, [0], []
            for k, c in enumerate(window):
                if c == 32:
                    ends.append(k)
                    starts.append(k + 1)
            codes[row] = _codes(padded, np.array(starts), np.array([*ends, len(window)]))
        furthest = length - self.block + 1
        self.shift = np.full(1 << self.bits, furthest, np.int16 if furthest < 1 << 15 else np.int64)
        for end in range(self.block - 1, length):
            slot = self.slots(_joined([codes[:, end - self.block + 1 + i] for i in range(self.block)]))
            self.shift[slot] = np.minimum(self.shift[slot], length - 1 - end)  # one value a round, so repeated slots do no harm
        suffix = self.slots(_joined([codes[:, length - self.block + i] for i in range(self.block)]))
        self.buckets = np.unique(self.keys(suffix, _joined(list(codes.T))))

    def slots(self, joined: np.ndarray) -> np.ndarray:
        return (joined >> np.uint64(64 - self.bits)).astype(np.int64)

    def keys(self, suffix: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return (suffix.astype(np.uint64) << np.uint64(64 - self.bits)) | (whole >> np.uint64(self.bits))

    def ends(self, code, n: int) -> np.ndarray:
        """Last words of possible occurrences among n words; code(i) gives codes of words."""
        last = self.length - 1
        if n <= last:
            return np.zeros(0, np.int64)
        q = np.arange(last, n, SEGMENT)
        stop, found = np.minimum(q + SEGMENT, n), []
        while len(q):
            slot = self.slots(_joined([code(q - self.block + 1 + i) for i in range(self.block)]))
            step = self.shift[slot]
            stay = step == 0
            if stay.any():
                at = q[stay]
                key = self.keys(slot[stay], _joined([code(at - last + i) for i in range(self.length)]))
                near = np.minimum(np.searchsorted(self.buckets, key), len(self.buckets) - 1)
                found.append(at[self.buckets[near] == key])
            q = q + np.maximum(step, 1)
            live = q < stop
            q, stop = q[live], stop[live]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def tables(items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
    for k, (_, words) in enumerate(items):
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            owners = by_length[size].setdefault(b" ".join(words[i : i + size]), [])
            if not owners or owners[-1] != k:
                owners.append(k)
    return [WuManber(n, w) for n, w in sorted(by_length.items())]


def _search(shared):
    def run(batches):
        names, searchers = shared.value
        for batch, texts in sliced(batches, 0, CHUNK):
            joined, at = raw(texts)
            data = joined.translate(LOWER)
            starts, ends, first = word_bounds(data, at)
            padded = data + b" " * 8
            owner = np.repeat(np.arange(len(texts)), np.diff(first))
            hit, of = np.zeros(len(starts) + 1, np.int64), [set() for _ in range(len(texts))]
            for s in searchers:
                for q in s.ends(lambda i: _codes(padded, starts[i], ends[i]), len(starts)).tolist():
                    p = q - s.length + 1
                    if owner[p] != owner[q]:
                        continue
                    got = s.windows.get(b" ".join([data[starts[i] : ends[i]] for i in range(p, q + 1)]))
                    if got is not None:
                        hit[p] += 1
                        hit[q + 1] -= 1
                        of[owner[p]].update(got)
            covered = np.cumsum(hit[:-1]) > 0
            n_words = np.diff(first).tolist()
            edge = np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)) if len(covered) else np.zeros(0, np.int8)
            opens, shuts = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            runs: list[list[dict]] = [[] for _ in range(len(texts))]
            for a, b in zip(opens.tolist(), shuts.tolist(), strict=True):
                while a < b:  # a run may go on into the next text
                    mine = owner[a]
                    end = min(b, int(first[mine + 1]))
                    runs[mine].append({"first": a - int(first[mine]), "last": end - 1 - int(first[mine])})
                    a = end
            items = [sorted({names[k] for k in x}) for x in of]
            span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), pa.array(n_words, pa.int64()), pa.array(runs, span), pa.array(items, pa.list_(pa.string()))], [*batch.schema.names[1:], "n_words", "hits", "items"])

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_bytes: int = 64 << 20) -> DataFrame:
    """docs with n_words, hits (runs of hit words: first, last, from 0), n_hit, items (sorted as strings) and contaminated added; existing columns of these names are replaced.

    Null and empty texts have no words. Items that are null or have no words occur nowhere; an item without an id counts as the id "". Repeated items count once.
    """
    added = ("n_words", "hits", "items", "n_hit", "contaminated")
    docs = docs.drop(*(c for c in docs.columns if c in added))
    items = benchmark.select(F.coalesce(col(item_id).cast("string"), F.lit("")).alias("id"), col(item_text).cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] * window
    shards = -(-size // shard_bytes) or 1
    searched, uid = fresh(docs.columns, "searched_text"), fresh((*docs.columns, *added), "uid")
    found = ["n_words long", "hits array<struct<first:long,last:long>>", "items array<string>"]

    def passed(df: DataFrame, some: DataFrame) -> DataFrame:
        """df's columns but the first, which is searched, and what is found."""
        rows = [(r.id, words_of(r.text)) for r in some.collect()]  # shard_bytes at most, measured
        shared = df.sparkSession.sparkContext.broadcast(([r[0] for r in rows], tables(rows, window)))
        return mapped(df, _search(shared), found, skip=1)

    whole = col(text).cast("string").alias(searched)
    if shards == 1:
        out = passed(docs.select(whole, *(col(c) for c in docs.columns)), items)
    else:
        held = Scratch(docs).put(docs.withColumn(uid, F.monotonically_increasing_id()), "docs")
        own = None
        for k in range(shards):
            one = passed(held.select(whole, uid), items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k))
            one = one if k == 0 else one.filter(F.size("hits") > 0)  # the first pass has a row for every document
            own = one if own is None else own.unionByName(one)
        # a row for each pass in which a document has hits; runs sorted by first word are united where they touch
        all_runs, last = F.array_sort(F.flatten(F.collect_list("hits"))), lambda acc: F.try_element_at(acc, F.lit(-1))
        united = F.aggregate(
            "hits", F.expr("cast(array() as array<struct<first:long,last:long>>)"),
            lambda acc, x: F.when((F.size(acc) > 0) & (last(acc)["last"] + 1 >= x["first"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["last"], x["last"]).alias("last"))))).otherwise(F.concat(acc, F.array(x))),
        )
        own = own.groupBy(uid).agg(F.max("n_words").alias("n_words"), all_runs.alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).withColumn("hits", united)
        out = held.join(own, uid).select(*(col(c) for c in docs.columns), "n_words", "hits", "items")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", F.col("n_hit") > 0)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = benchmark_hits(docs, table(spark, sf_dir, "benchmark")).drop("text")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM bw),
occ AS (
  SELECT doc_id, i, x.m, x.item_id
  FROM (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)) o
  JOIN bw x ON x.g = o.g AND x.m = o.m),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM occ) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""
