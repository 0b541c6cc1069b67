"""Line dedup: two Bloom filters name suspected repeats, and only those shuffle for exact confirmation.

A line's key is the line without white space ([\\x20\\x09-\\x0D]) at its ends, A-Z in lower case. A text of n newlines
has n + 1 lines; a null or empty text is one empty line. A row is a document, also where ids repeat or are null.

1. Every task puts the keys of its documents into a filter of keys seen once and, on meeting one again in another
   document, into a filter of keys seen twice. Both leave the task as compressed segments. Each segment is merged on
   its own, as a stream: twice |= task's twice | (once & task's once). So no repeated key is ever missed.
2. Keys that the second filter holds are counted exactly, by the whole key: a count for each task and key first, so that
   a line of a third of all documents is as many rows as tasks, not documents.
3. Keys of at least min_docs documents are dropped from all documents, or (keep="first") from all but the first by
   (id, line). They are broadcast only if their measured size is within broadcast_bytes; else suspected lines are joined
   with them by key, which Spark's skew handling can split.

The filters are bounded by max_bits. A fuller filter passes more suspects to step 2; the result is the same. min_docs is 2
at least, as a key that occurs in one document is no repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.common import Scratch, col, estimated_bytes, pieces, sliced, table, tidy

SPACE = b" \t\n\x0b\x0c\r"
SEGMENT, HELD = 1 << 15, 16 << 20  # bytes of a filter that are merged together; of keys that a task counts
HASHES = 3


def _keys(text: str | None) -> list[bytes]:
    return [line.strip(SPACE).lower() for line in (text or "").encode().split(b"\n")]


class Bloom:
    """A filter of a power of two bits; hashes are 64-bit."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits = bits
        self.bytes = np.zeros(bits // 8, np.uint8) if words is None else words

    def places(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            step = (hashes >> np.uint64(32)) | np.uint64(1)
            return (hashes[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(self.bits - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes)
        return ((self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def add(self, hashes: np.ndarray) -> None:
        at = self.places(hashes).ravel()
        np.bitwise_or.at(self.bytes, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))


def _hashed(texts: pa.Array, min_chars: int):
    """For each text its distinct keys of min_chars code points or more, and their hashes."""
    for text in texts:
        keys = [k for k in dict.fromkeys(_keys(text.as_py())) if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars)]
        yield keys, np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)


def _filters(bits: int, min_chars: int):
    def run(batches):
        once, twice = Bloom(bits), Bloom(bits)
        for batch in batches:
            for _, texts in pieces(batch.column(0)):
                found = [h for _, h in _hashed(texts, min_chars) if len(h)]
                if found:
                    hashes, n = np.unique(np.concatenate(found), return_counts=True)
                    twice.add(hashes[(n > 1) | once.has(hashes)])
                    once.add(hashes)
        codec, size = pa.Codec("zstd"), min(SEGMENT, bits // 8)
        yield from _segments(once.bytes, twice.bytes, size, codec)

    return run


def _segments(once: np.ndarray, twice: np.ndarray, size: int, codec):
    held, again = once.reshape(-1, size), twice.reshape(-1, size)
    where = np.flatnonzero(held.any(axis=1))
    for lo in range(0, len(where), 256):
        part = where[lo : lo + 256]
        squeezed = [[codec.compress(x[i].tobytes(), asbytes=True) for i in part] for x in (held, again)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in squeezed)], ["segment", "once", "twice"])


def _filter_of_keys(bits: int):
    """Rows of one key: both filters of a task hold all its keys."""

    def run(batches):
        bloom = Bloom(bits)
        for batch in batches:
            bloom.add(np.array([xxhash.xxh3_64_intdigest(k) for k in batch.column(0).to_pylist()], np.uint64))
        yield from _segments(bloom.bytes, bloom.bytes, min(SEGMENT, bits // 8), pa.Codec("zstd"))

    return run


def _merged(size: int):
    """Rows come sorted by segment; one segment is held at a time."""

    def run(batches):
        codec, now, once, twice = pa.Codec("zstd"), None, None, None
        out: list[tuple[int, bytes]] = []
        for batch in batches:
            for segment, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if segment != now:
                    if now is not None:
                        out.append((now, codec.compress(twice.tobytes(), asbytes=True)))
                    now, once, twice = segment, np.zeros(size, np.uint8), np.zeros(size, np.uint8)
                a, b = (np.frombuffer(codec.decompress(x, size, asbytes=True), np.uint8) for x in (a, b))
                twice |= b | (once & a)
                once |= a
        if now is not None:
            out.append((now, codec.compress(twice.tobytes(), asbytes=True)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["segment", "twice"])

    return run


def _merged_filter(rows: DataFrame, filters, bits: int) -> np.ndarray:
    """The second filter of all tasks together."""
    size = min(SEGMENT, bits // 8)
    parts = rows.mapInArrow(tidy(filters), "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(tidy(_merged(size)), "segment int, twice binary")
    out, codec = np.zeros((bits // 8 // size, size), np.uint8), pa.Codec("zstd")
    for row in merged.collect():  # bits / 8 bytes at most: bounded by max_bits
        out[row.segment] = np.frombuffer(codec.decompress(bytes(row.twice), size, asbytes=True), np.uint8)
    return out.ravel()


def _suspects(seen, bits: int, min_chars: int, ranked: bool):
    """(key, documents with it in this part of the task, its first id and line there). A part has about HELD bytes of keys."""

    def run(batches):
        bloom, counts, held = Bloom(bits, seen.value), {}, 0

        def out():
            keys = list(counts)
            firsts = [counts[k][1] for k in keys]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([f[0] for f in firsts], pa.string()), pa.array([f[1] for f in firsts], pa.int64())], ["key", "n", "first_id", "first_line"])

        for batch in batches:
            ids = batch.column(1).to_pylist() if ranked else [None] * batch.num_rows
            for (keys, hashes), text, doc in zip(_hashed(batch.column(0), min_chars), batch.column(0), ids, strict=True):
                if not len(keys):
                    continue
                for i in np.flatnonzero(bloom.has(hashes)):
                    key = keys[i]
                    if key not in counts:
                        held += len(key) + 200
                    here = (doc, _keys(text.as_py()).index(key)) if ranked and doc is not None else (None, None)
                    n, first = counts.get(key, (0, (None, None)))
                    if first[0] is None or here[0] is not None and here < first:
                        first = here
                    counts[key] = (n + 1, first)
                if held > HELD:
                    yield out()
                    counts, held = {}, 0
        if counts:
            yield out()

    return run


def repeated_lines(texts: DataFrame, min_docs: int, min_chars: int = 1, bits_per_line: int = 16, max_bits: int = 1 << 29) -> DataFrame:
    """texts: one string column, and for first occurrences a second that sorts as ids do. (key, n, first) of every key in min_docs rows or more."""
    spark, ranked = texts.sparkSession, len(texts.columns) > 1
    lines = estimated_bytes(texts) // 64 + 1024  # a guess: it only sets how full the filters get
    bits = 1 << min(max(bits_per_line * lines - 1, 1 << 16).bit_length(), max_bits.bit_length() - 1)
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    seen = spark.sparkContext.broadcast(_merged_filter(texts.select(col(texts.columns[0])), _filters(bits, min_chars), bits))
    suspects = texts.mapInArrow(tidy(_suspects(seen, bits, min_chars, ranked)), "key binary, n long, first_id string, first_line long")
    first = F.min(F.when(F.col("first_id").isNotNull(), F.struct("first_id", "first_line")))
    return suspects.groupBy("key").agg(F.sum("n").alias("n"), first.alias("first")).filter(F.col("n") >= min_docs)


def _dropped(doomed, text_at: int, id_at: int | None, schema: pa.Schema):
    """doomed: a broadcast of key -> (id, line) that stays, or None."""

    def run(batches):
        gone = doomed.value
        for batch, _ in sliced(batches, text_at):
            texts, total, lost = [], [], []
            ids = batch.column(id_at).to_pylist() if id_at is not None else None
            for row, value in enumerate(batch.column(text_at)):
                lines = (value.as_py() or "").encode().split(b"\n")
                kept = []
                for k, line in enumerate(lines):
                    key = line.strip(SPACE).lower()
                    if key not in gone or (gone[key] is not None and ids is not None and gone[key] == (ids[row], k)):
                        kept.append(line)
                texts.append(b"\n".join(kept).decode())
                total.append(len(lines))
                lost.append(len(lines) - len(kept))
            columns = [*(batch.column(i) for i in range(batch.num_columns)), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _flagged(seen, bits: int, min_chars: int):
    def run(batches):
        bloom = Bloom(bits, seen.value)
        for batch in batches:
            rows: list[tuple[int, int, bytes]] = []
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = _keys(text.as_py())
                hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
                rows += [(uid, int(i), keys[i]) for i in np.flatnonzero(bloom.has(hashes)) if len(keys[i].decode()) >= min_chars]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["uid", "line", "key"])

    return run


def _cut(text_at: int, lines_at: int, schema: pa.Schema):
    def run(batches):
        for batch, _ in sliced(batches, text_at):
            texts, total, lost = [], [], []
            for value, gone in zip(batch.column(text_at), batch.column(lines_at), strict=True):
                lines, gone = (value.as_py() or "").split("\n"), set(gone.as_py() or ())
                kept = [x for k, x in enumerate(lines) if k not in gone]
                texts.append("\n".join(kept))
                total.append(len(lines))
                lost.append(len(lines) - len(kept))
            columns = [*(batch.column(i) for i in range(batch.num_columns) if i != lines_at), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1, keep: str = "none", broadcast_bytes: int = 64 << 20, max_bits: int = 1 << 29) -> DataFrame:
    """docs with kept_text, n_lines (before) and n_dropped added; existing columns of these names are replaced.

    keep="none": keys of min_docs documents or more lose all their lines; "first": the first by (id as text, line) stays.
    A text all of whose lines go is empty. Keys of under min_chars code points always stay. A null id is never first.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if keep not in ("none", "first"):
        raise ValueError(keep)
    spark, added = docs.sparkSession, ("kept_text", "n_lines", "n_dropped")
    docs = docs.drop(*(c for c in docs.columns if c in added))
    names = docs.columns
    text, doc_id = (f"in_{names.index(c)}" for c in (text, doc_id))
    docs = docs.toDF(*(f"in_{i}" for i in range(len(names))))  # whatever the columns are called, nothing clashes
    key, scratch = col(doc_id).cast("string"), Scratch(docs)
    texts = docs.select(col(text).cast("string").alias("text"), *([key.alias("id")] if keep == "first" else []))
    found = scratch.put(repeated_lines(texts, min_docs, min_chars, max_bits=max_bits), "lines")
    n_keys, n_bytes = found.agg(F.count("*"), F.coalesce(F.sum(F.length("key") + 120), F.lit(0))).first()
    out = T.StructType([*docs.schema, T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    if n_bytes <= broadcast_bytes:
        gone = {bytes(r.key): (r.first and tuple(r.first)) if keep == "first" else None for r in found.toLocalIterator()}
        docs_in = docs.withColumn("key", key) if keep == "first" else docs
        schema = T.StructType([*docs_in.schema, *out.fields[-3:]])
        fn = _dropped(spark.sparkContext.broadcast(gone), docs.columns.index(text), len(docs.columns) if keep == "first" else None, to_arrow_schema(schema))
        return docs_in.mapInArrow(tidy(fn), schema).select(*(col(f.name) for f in out)).toDF(*names, *added)
    held = scratch.put(docs.withColumn("uid", F.monotonically_increasing_id()), "docs")
    lines = estimated_bytes(held) // 64 + 1024
    bits = 1 << min(max(16 * lines - 1, 1 << 16).bit_length(), max_bits.bit_length() - 1)
    seen = spark.sparkContext.broadcast(_merged_filter(found.select("key"), _filter_of_keys(bits), bits))
    fn = _flagged(seen, bits, min_chars)
    hits = held.select("uid", col(text).cast("string").alias("text")).mapInArrow(tidy(fn), "uid long, line long, key binary").join(found.select("key", "first"), "key")
    if keep == "first":
        ids = held.select("uid", key.alias("id"))
        same: Column = (F.col("id") == F.col("first.first_id")) & (F.col("line") == F.col("first.first_line"))
        hits = hits.join(ids, "uid").filter(~F.coalesce(same, F.lit(False)))
    gone_of = hits.groupBy("uid").agg(F.collect_list("line").alias("gone"))
    joined = held.join(gone_of, "uid", "left").select(*docs.columns, "gone")
    return joined.mapInArrow(tidy(_cut(docs.columns.index(text), len(docs.columns), to_arrow_schema(out))), out).toDF(*names, *added)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS k, unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
keyed AS (
  SELECT doc_id, k, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
gone AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE key IN (SELECT key FROM gone)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE key NOT IN (SELECT key FROM gone)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""
