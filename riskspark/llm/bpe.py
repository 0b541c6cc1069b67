"""Byte-level BPE encoding and decoding with numpy.

A text is cut into pieces by the vocabulary's pattern; each distinct piece is encoded once and remembered in a bounded
memory. Pieces that are no token themselves go by length into padded matrices, a row each. Every round, each row merges
its leftmost pair of least rank; the row's tail moves up by one (compaction), only the two pairs beside the merge are
looked up again, in an open-addressing hash table of all pairs, and rows without a known pair leave. A row of n bytes takes
up to n rounds over n cells, so pieces above matrix_bytes (MATRIX_BYTES; a run of hundreds of letters) use a heap over a
linked list instead, with the same order of merges and the same ids, and a very long one costs n log n and not n * n.

A null text encodes as an empty one: no ids. Ids are packed as little-endian unsigned 32-bit integers in a binary column.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import mapped, pieces, sliced, table

NONE = np.int32(2**31 - 1)
MATRIX_BYTES, MATRIX_CELLS, REMEMBERED = 512, 1 << 18, 1 << 17
CHUNK = 1 << 20  # bytes of text that are worked on at once


class PairTable:
    """(left id, right id) -> id of their merge, by linear probing."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        self.bits = max(8, int(len(pairs) * 4).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, NONE, np.int32)
        keys, slot = pairs + np.uint64(1), self.slot(pairs + np.uint64(1))
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]  # of several that want one slot, the last one gets it
            won = self.keys[slot] == keys
            self.values[slot[won]] = merged[won]
            keys, merged, slot = keys[~won], merged[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)) + np.uint64(1)
        slot = self.slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return out


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, matrix_bytes: int = MATRIX_BYTES):
        self.ranks, self.pattern, self.matrix_bytes = ranks, regex.compile(pattern), matrix_bytes
        self.token = {v: k for k, v in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}

    @functools.cached_property
    def pairs(self) -> PairTable:
        pairs, merged, ranks = [], [], self.ranks
        for whole, rank in ranks.items():
            for i in range(1, len(whole)):
                left, right = ranks.get(whole[:i]), ranks.get(whole[i:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    merged.append(rank)
        return PairTable(np.array(pairs, np.uint64), np.array(merged, np.int32))

    def encode(self, text: str) -> bytes:
        found = self.pattern.findall(text)
        self.learn(found)
        return b"".join(map(self.known.__getitem__, found))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def learn(self, found) -> None:
        found = set(found)
        new = [x for x in found if x not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(found)
        rest: dict[int, list[str]] = {}
        ranks = self.ranks
        for x in new:
            raw = x.encode()
            rank = ranks.get(raw)
            if rank is not None:
                self.known[x] = rank.to_bytes(4, "little")
            elif len(raw) > self.matrix_bytes:
                self.known[x] = self.by_heap(raw)
            else:
                rest.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append(x)
        for width, bucket in rest.items():
            step = max(1, MATRIX_CELLS // width)
            for lo in range(0, len(bucket), step):
                self.by_matrix(bucket[lo : lo + step], width)

    def by_matrix(self, bucket: list[str], width: int) -> None:
        known, raws = self.known, [x.encode() for x in bucket]
        size = np.array([len(r) for r in raws])
        cells = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(-1, width)
        column = np.arange(width)
        ids = np.where(column < size[:, None], self.single[cells], np.int32(-1))
        rank = np.full((len(ids), width - 1), NONE, np.int32)
        inside = column[1:] < size[:, None]
        rank[inside] = self.pairs.find(ids[:, :-1][inside], ids[:, 1:][inside])
        row = np.arange(len(ids))
        while len(row):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NONE)
            live = best != NONE
            if not live.all():
                flat, wide, lo = ids[~live].astype("<u4").tobytes(), 4 * ids.shape[1], 0
                for r, n in zip(row[~live].tolist(), (4 * size[~live]).tolist(), strict=True):
                    known[bucket[r]] = flat[lo : lo + n]
                    lo += wide
                row, size, ids, rank, at, best = row[live], size[live], ids[live], rank[live], at[live], best[live]
                if not len(row):
                    break
            left = np.arange(ids.shape[1] - 1) <= at[:, None]
            all_rows = np.arange(len(row))
            ids[all_rows, at] = best
            ids = np.where(left, ids[:, :-1], ids[:, 1:])
            rank = np.where(left[:, :-1], rank[:, :-1], rank[:, 1:])
            size = size - 1
            for place, ok in ((at - 1, at > 0), (at, at < size - 1)):
                r, p = all_rows[ok], place[ok]
                rank[r, p] = self.pairs.find(ids[r, p], ids[r, p + 1])
            end = at == size - 1  # the merged token is its row's last: no pair begins there
            if rank.shape[1]:
                r = all_rows[end & (at < rank.shape[1])]
                rank[r, at[r]] = NONE

    def by_heap(self, raw: bytes) -> bytes:
        """The same merges for one long piece."""
        ids = self.single[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        first = self.pairs.find(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        token, ranks = self.token, self.ranks
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    rank = ranks.get(token[ids[x]] + token[ids[y]])
                    if rank is not None:
                        heapq.heappush(heap, (rank, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()


_LOADED: dict[tuple[int, str, int], Bpe] = {}


def loaded(shared, matrix_bytes: int = MATRIX_BYTES) -> Bpe:
    """One coder for a Python worker. shared: a broadcast of (the rank file's bytes, pattern)."""
    data, pattern = shared.value
    key = (hash(data), pattern, matrix_bytes)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe({base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}, pattern, matrix_bytes)
    return _LOADED[key]


def vocabulary(spark: SparkSession, path: str, pattern: str):
    """A broadcast of a rank file, which is a fixed file of under a few MB; only the driver opens path."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern))


def _with(batch: pa.RecordBatch, name: str, values: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(values, kind)], [*batch.schema.names, name])


def encode(docs: DataFrame, vocab, text: str = "text", into: str = "ids", matrix_bytes: int = MATRIX_BYTES) -> DataFrame:
    """docs with the ids of each whole text added (an existing column of that name is replaced). matrix_bytes: longer pieces use the heap; no result depends on it."""
    docs = docs.drop(into)
    at = docs.columns.index(text)

    def run(batches):
        coder = loaded(vocab, matrix_bytes)
        for batch, texts in sliced(batches, at, CHUNK):
            found = [coder.pattern.findall(x) for x in texts.to_pylist()]
            coder.learn(set().union(*found))
            yield _with(batch, into, [b"".join(map(coder.known.__getitem__, one)) for one in found], pa.binary())

    return mapped(docs, run, [f"`{into}` binary"])


def decode(docs: DataFrame, vocab, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with the bytes that the ids stand for added; a null list of ids is an empty one, an id that the vocabulary lacks is an error."""
    docs = docs.drop(into)
    at = docs.columns.index(ids)

    def run(batches):
        coder = loaded(vocab)
        for batch in batches:
            for lo, some in pieces(batch.column(at), CHUNK):
                yield _with(batch.slice(lo, len(some)), into, [coder.decode(x) for x in some.to_pylist()], pa.binary())

    return mapped(docs, run, [f"`{into}` binary"])


def both_ways(docs: DataFrame, vocab, text: str = "text", ids: str = "ids", decoded: str = "decoded", matrix_bytes: int = MATRIX_BYTES) -> DataFrame:
    """encode() and then decode() of the ids in one pass: one Python worker a task, not two."""
    docs = docs.drop(ids, decoded)
    at = docs.columns.index(text)

    def run(batches):
        coder = loaded(vocab, matrix_bytes)
        for batch, texts in sliced(batches, at, CHUNK):
            found = [coder.pattern.findall(x) for x in texts.to_pylist()]
            coder.learn(set().union(*found))
            coded = [b"".join(map(coder.known.__getitem__, one)) for one in found]
            yield _with(_with(batch, ids, coded, pa.binary()), decoded, [coder.decode(x) for x in coded], pa.binary())

    return mapped(docs, run, [f"`{ids}` binary", f"`{decoded}` binary"])


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocab = vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = both_ways(docs, vocab).drop("text")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
