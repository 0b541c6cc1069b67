"""Approximate nearest neighbours by largest inner product: a hash-prefix forest.

Each tree gives a vector a string of BITS sign bits and keeps the strings sorted. A query descends all trees to its longest
prefix matches, then all trees ascend together, one bit at a time, until the entries met (with repeats over trees) are as
many as asked for; what they met is scored exactly. Strings are of vectors made equally long by one more component, so that
angles order as inner products do.

* Rows with equal vectors are one entry that carries its k + 1 smallest ids, which are all that can be among the k nearest;
  so a vector of a third of all rows is one entry.
* A sample of an eighth of the entries, of at most SAMPLE of them and SAMPLE_BYTES, by hash, goes to the driver. The order of one long string, cut at the
  sample's quantiles, deals all entries into shards of about SHARD neighbours; hash bits end the string, so that entries
  with the same signs are dealt evenly. Every entry is indexed, in one shard.
* A forest of the sample leads a query to its nearest sample entries; it visits the shards in which those lie, and no others.
* Each shard's forest is built once, and its queries stream past it. A shard asked by more than QUERIES of them is copied
  once for every further QUERIES.

How far both forests ascend is measured, if `breadth` is not given: for at most PROBES queries, chosen by hash, the k nearest
are found by brute force, and the least number of sample entries and of entries met is taken that finds TARGET of them. So
clustered vectors are searched little, and independent random directions, where nothing prunes, nearly whole.
breadth: instead, sample entries and entries met as a share of the sample and of the shard.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id. Vectors only
meet vectors of as many components. Queries are distinct ids; of rows that share an id, the least vector asks, and each is a
candidate, of which the nearest counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.llm.common import Scratch, col, mix, table, tidy

TREES, BITS, SEED = 64, 24, 20240229
SHARD, QUERIES = 16_384, 8_192
SAMPLE, SAMPLE_BYTES = 65_536, 32 << 20
PROBES, TARGET = 128, 0.97
_ROUTE_BITS, _HASH_BITS = 40, 22


def planes(dim: int, count: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, count)).astype(np.float32)


class Forest:
    """A sorted array of strings for each tree, over some vectors; longest: the squared length that all are made up to."""

    def __init__(self, vectors: np.ndarray, longest: float, trees: int = TREES, bits: int = BITS):
        self.trees, self.bits = trees, bits
        self.planes = planes(vectors.shape[1] + 1, trees * bits)
        strings = self.strings(lengthened(vectors, longest))
        self.order = np.argsort(strings, axis=0, kind="stable").astype(np.int32).T.copy()
        self.sorted = np.sort(strings, axis=0).T.copy()

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        weights = np.left_shift(1, np.arange(self.bits - 1, -1, -1, dtype=np.int64))
        out = np.empty((len(vectors), self.trees), np.int64)
        for lo in range(0, len(vectors), 1024):
            signs = (vectors[lo : lo + 1024].astype(np.float32) @ self.planes) > 0
            out[lo : lo + 1024] = signs.reshape(-1, self.trees, self.bits) @ weights
        return out

    def asked(self, queries: np.ndarray) -> np.ndarray:
        return self.strings(np.hstack([queries, np.zeros((len(queries), 1))]))

    def ranges(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where, in each tree, the strings lie that share `depth` bits with each query's."""
        step = 1 << (self.bits - depth)
        floor = strings & ~np.int64(step - 1)
        a, b = (np.stack([np.searchsorted(self.sorted[t], edge[:, t]) for t in range(self.trees)], axis=1) for edge in (floor, floor + step))
        return a, b

    def candidates(self, queries: np.ndarray, least: int):
        """Yields, for each query, the vectors met when at least `least` entries have been."""
        strings = self.asked(queries)
        low, high = np.zeros((len(queries), self.trees), np.int64), np.full((len(queries), self.trees), self.order.shape[1])
        climbing = np.arange(len(queries))
        for depth in range(self.bits, 0, -1):
            a, b = self.ranges(strings[climbing], depth)
            enough = (b - a).sum(axis=1) >= least
            low[climbing[enough]], high[climbing[enough]] = a[enough], b[enough]
            climbing = climbing[~enough]
            if not len(climbing):
                break
        met = np.zeros(self.order.shape[1], bool)
        for q in range(len(queries)):
            met[:] = False
            for t in range(self.trees):
                met[self.order[t, low[q, t] : high[q, t]]] = True
            yield np.flatnonzero(met)

    def entries_met(self, query: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """For each wanted vector (a row number): the least number of entries to ask for that its ascent ends no deeper than where it is met."""
        own = self.asked(query[None])
        depth = np.zeros(len(wanted), np.int64)
        for t in range(self.trees):
            place = np.empty(self.order.shape[1], np.int64)
            place[self.order[t]] = self.sorted[t]
            apart = place[wanted] ^ own[0, t]
            shared = self.bits - np.ceil(np.log2(apart + 1.0)).astype(np.int64)
            depth = np.maximum(depth, shared)
        out = np.empty(len(wanted), np.int64)
        for d in np.unique(depth):
            deeper = 0
            if d < self.bits:
                a, b = self.ranges(own, int(d) + 1)
                deeper = (b - a).sum()
            out[depth == d] = deeper + 1
        return out


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    square = (vectors * vectors).sum(axis=1)
    return np.hstack([vectors, np.sqrt(np.maximum(longest - square, 0))[:, None]])


def _hash(vectors: np.ndarray) -> np.ndarray:
    out = np.zeros(len(vectors), np.uint64)
    with np.errstate(over="ignore"):
        for column in np.ascontiguousarray(vectors.T).view(np.uint64):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


class Router:
    """Shards of one number of components: cuts of the long string's order, and a forest of the sample that leads to them."""

    def __init__(self, sample: np.ndarray, entries: int, longest: float):
        self.longest, self.sample = longest, sample
        self.planes = planes(sample.shape[1] + 1, _ROUTE_BITS, SEED + 1)
        keys = np.sort(self.keys(sample))
        shards = max(1, -(-entries // SHARD))
        self.cuts = keys[(np.arange(1, shards) * len(keys)) // shards]
        self.of_sample = self.shard(sample)
        self._forest: Forest | None = None

    def __getstate__(self):
        return self.__dict__ | {"_forest": None}

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        signs = (lengthened(vectors, self.longest).astype(np.float32) @ self.planes) > 0
        string = signs @ np.left_shift(1, np.arange(_ROUTE_BITS - 1, -1, -1, dtype=np.int64))
        return (string << _HASH_BITS) | (_hash(vectors) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)

    def shard(self, vectors: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, self.keys(vectors), side="right")

    @property
    def shards(self) -> int:
        return len(self.cuts) + 1

    def order(self, queries: np.ndarray, nearest: int):
        """Yields, for each query, the shards of its `nearest` sample entries, in the order of the nearest one each."""
        if self.shards == 1 or nearest >= len(self.sample):
            for _ in queries:
                yield np.arange(self.shards)
            return
        if self._forest is None:
            self._forest = Forest(self.sample, self.longest)
        for query, met in zip(queries, self._forest.candidates(queries, self._forest.trees * nearest), strict=True):
            score = self.sample[met] @ query
            best = met[np.argsort(-score, kind="stable")[:nearest]]
            shards, first = np.unique(self.of_sample[best], return_index=True)
            yield shards[np.argsort(first)]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch, at: int, vector: int):
    """Parts of a batch whose vectors have as many components, with the matrix."""
    dims = batch.column(at).to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        part = batch.filter(pa.array(dims == dim))
        yield dim, part, _matrix(part.column(vector), dim)


def _dealt(routers):
    """entries (dim, vector, ids) with their shard."""

    def run(batches):
        for batch in batches:
            for dim, part, vectors in _by_dim(batch, 0, 1):
                router = routers.value.get(dim)
                shard = router.shard(vectors) if router else np.zeros(len(vectors), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shard.astype(np.int32)), part.column(1), part.column(2)], ["dim", "shard", "vector", "ids"])

    return run


def _routed(routers, share: float | None, nearest):
    """queries (dim, id, vector) with the shards that each visits. nearest: sample entries for each dim, or `share` of the sample."""

    def run(batches):
        for batch in batches:
            for dim, part, vectors in _by_dim(batch, 0, 2):
                router = routers.value.get(dim)
                if router is None:
                    visits = [np.zeros(1, np.int64)] * len(vectors)
                else:
                    count = max(1, int(share * len(router.sample))) if share is not None else nearest.get(dim, len(router.sample))
                    visits = router.order(vectors, count)
                lists = pa.array([v.astype(np.int32) for v in visits], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], ["dim", "id", "vector", "shards"])

    return run


def _streamed(longest, one):
    """Rows (dim, shard, copy, role, id, ids, vector) come sorted by these: a shard's entries (role 0), then its queries.

    one(forest, vectors, ids, query ids, queries) gives what is yielded for a run of queries."""

    def run(batches):
        now, pieces, forest = None, [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                dim, shard, copy, role = key[lo].tolist()
                part = batch.slice(lo, hi - lo)
                if now != (dim, shard, copy):
                    now, pieces, forest = (dim, shard, copy), [], None
                if role == 0:
                    pieces.append((_matrix(part.column(6), dim), part.column(5).to_pylist()))
                    continue
                if forest is None and not pieces:
                    continue  # a shard without entries
                if forest is None:
                    vectors, ids = np.concatenate([p[0] for p in pieces]), [x for p in pieces for x in p[1]]
                    forest, pieces = Forest(vectors, longest.get(dim, 0.0)), []
                for at in range(0, part.num_rows, 256):
                    some = part.slice(at, 256)
                    yield from one(forest, vectors, ids, some.column(4).to_numpy(zero_copy_only=False), _matrix(some.column(6), dim), some)

    return run


def _best(scores: np.ndarray, met: np.ndarray, ids: list, own: int, k: int) -> list[tuple[float, int]]:
    """The k nearest (-score, id) of distinct ids, without the query's own."""
    order = np.argsort(-scores, kind="stable")
    out: dict[int, float] = {}
    edge = None
    for i in order:
        if edge is not None and scores[i] < edge:
            break
        for v in ids[met[i]]:
            if v != own and v not in out:
                out[v] = -float(scores[i])
        if edge is None and len(out) >= k:
            edge = scores[i]  # others with the very same score may have smaller ids
    return sorted((s, v) for v, s in out.items())[:k]


def _search(k: int, breadth: float | None, least: dict[int, int]):
    def one(forest, vectors, ids, own, wanted, _rows):
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        enough = int(breadth * len(vectors)) if breadth is not None else least.get(vectors.shape[1], forest.trees * len(vectors))
        for q, met in enumerate(forest.candidates(wanted, max(forest.trees, enough))):
            rough = vectors[met] @ wanted[q]
            if len(met) > 4 * (k + 1):  # the rest is far below the (k + 1)-th, whatever the rounding
                top = rough >= np.partition(rough, -(k + 1))[-(k + 1)] - 1e-9 * (1 + np.abs(rough).max())
                found = _best((vectors[met[top]] * wanted[q]).sum(axis=1), met[top], ids, own[q], k)
            else:
                found = []
            if len(found) < k:  # ids that several of the best share
                found = _best((vectors[met] * wanted[q]).sum(axis=1), met, ids, own[q], k)
            out["query_id"] += [int(own[q])] * len(found)
            out["vec_id"] += [v for _, v in found]
            out["score"] += [-s for s, _ in found]
        yield pa.RecordBatch.from_arrays([pa.array(out["query_id"], pa.int64()), pa.array(out["vec_id"], pa.int64()), pa.array(out["score"], pa.float64())], ["query_id", "vec_id", "score"])

    return one


def _brute(probes, k: int):
    """Of each batch of entries, the k nearest to each probe: (probe, dim, shard, name, score); a vector's name is its hash."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for dim, part, vectors in _by_dim(batch, 0, 2):
                shard, name = part.column(1).to_numpy(zero_copy_only=False), _hash(vectors).astype(np.int64)
                ids, some = part.column(3).to_pylist(), [(i, own, q) for i, (d, own, q) in enumerate(probes.value) if d == dim]
                for i, own, q in some:
                    score = vectors @ q
                    top = np.argpartition(-score, k)[: k + 1] if len(score) > k + 1 else np.arange(len(score))
                    for j in top.tolist():
                        if ids[j] != [own]:
                            for column, x in zip(out, (i, dim, int(shard[j]), int(name[j]), float(score[j])), strict=True):
                                column.append(x)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["probe", "dim", "shard", "name", "score"])

    return run


def _measured(wanted):
    """For each probe and wanted vector of the shard: the entries that a search meets before it."""

    def one(forest, vectors, _ids, own, queries, rows):
        names = {int(h): i for i, h in enumerate(_hash(vectors).astype(np.int64))}
        out: list[tuple[int, int, int]] = []
        for i, query in zip(own.tolist(), queries, strict=True):
            here = [names[h] for h in wanted.value.get(i, ()) if h in names]
            if here:
                out += [(i, vectors.shape[1], int(n)) for n in forest.entries_met(query, np.array(here))]
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["probe", "dim", "met"])

    return one


_ROWS = "dim int, shard int, copy int, role int, id long, ids array<bigint>, vector array<double>"


def _together(index: DataFrame, visits: DataFrame) -> DataFrame:
    """A shard's entries and the queries that visit it, as rows of _ROWS for _streamed; copies where a shard has many queries."""
    asked = visits.groupBy("dim", "shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("copies"))
    entries = index.join(asked, ["dim", "shard"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    entries = entries.select("dim", "shard", "copy", F.lit(0).alias("role"), F.lit(None).cast("long").alias("id"), "ids", "vector")
    queries = visits.join(asked, ["dim", "shard"]).withColumn("copy", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int"))
    queries = queries.select("dim", "shard", "copy", F.lit(1).alias("role"), "id", F.lit(None).cast("array<bigint>").alias("ids"), "vector")
    return entries.unionByName(queries).repartition("dim", "shard", "copy").sortWithinPartitions("dim", "shard", "copy", "role")


def _calibrated(spark: SparkSession, index: DataFrame, asked: DataFrame, routers: dict, longest: dict, k: int, target: float) -> tuple[dict[int, int], dict[int, int]]:
    """(sample entries, entries met in a shard) for each number of components, so that `target` of the probes' k nearest are found."""
    chosen = asked.orderBy(F.xxhash64("id"), "id").limit(PROBES).collect()  # PROBES at most
    probes = [(r.dim, r.id, np.array(r.vector)) for r in chosen]
    best = Window.partitionBy("probe").orderBy(F.desc("score"), "name")
    found = index.select("dim", "shard", "vector", "ids").mapInArrow(tidy(_brute(spark.sparkContext.broadcast(probes), k)), "probe int, dim int, shard int, name long, score double")
    truth = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).collect()  # PROBES * k at most
    one_part = 1 - (1 - target) / 2
    nearest: dict[int, int] = {}
    for dim, router in routers.items():
        own = [(i, q) for i, (d, _, q) in enumerate(probes) if d == dim]
        rows, count = [r for r in truth if r["dim"] == dim], 4
        while router.shards > 1 and rows and count < len(router.sample):
            visits = {i: set(v.tolist()) for (i, _), v in zip(own, router.order(np.array([q for _, q in own]), count), strict=True)}
            if sum(r.shard in visits[r.probe] for r in rows) >= one_part * len(rows):
                break
            count *= 4
        nearest[dim] = count
    wanted: dict[int, list[int]] = {}
    for row in truth:
        wanted.setdefault(row.probe, []).append(row.name)
    rows = [(d, int(s), i, q.tolist()) for i, (d, _, q) in enumerate(probes) for s in {row.shard for row in truth if row.probe == i}]
    if not rows:
        return nearest, {}
    visits = spark.createDataFrame(rows, "dim int, shard int, id long, vector array<double>")
    met = _together(index, visits).mapInArrow(tidy(_streamed(longest, _measured(spark.sparkContext.broadcast(wanted)))), "probe long, dim int, met long").collect()
    least = {}
    for dim in {r.dim for r in met}:
        least[dim] = int(np.quantile([r.met for r in met if r.dim == dim], one_part, method="higher"))
    return nearest, least


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", breadth: float | None = None, target: float = TARGET) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of each query's k nearest found, by largest inner product, ties to the smaller vec_id; a query's own id is no candidate."""
    spark, scratch = vectors.sparkSession, Scratch(vectors)
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def usable(df: DataFrame) -> DataFrame:
        df = df.select(col(vec_id).cast("long").alias("id"), col(vector).cast("array<double>").alias("vector"))
        return df.filter(F.col("id").isNotNull() & F.forall("vector", sound) & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))

    same = Window.partitionBy("dim", "vector").orderBy("id")
    few = usable(vectors).distinct().withColumn("rank", F.row_number().over(same)).filter(F.col("rank") <= k + 1)
    entries = scratch.put(few.groupBy("dim", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    asked = scratch.put(usable(queries).groupBy("dim", "id").agg(F.min("vector").alias("vector")).groupBy("id").agg(F.min_by("vector", "dim").alias("vector"), F.min("dim").alias("dim")), "queries")
    square: Column = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    sizes = entries.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("longest")).orderBy(F.desc("n"), "dim").limit(SAMPLE).collect()
    n, bytes_each = sum(r.n for r in sizes), 8 * max((r["dim"] for r in sizes), default=1)
    share = min(1.0, min(max(n // 8, 1024), SAMPLE, SAMPLE_BYTES // bytes_each) / max(1, n))
    sample = entries.select("dim", "vector").filter(F.pmod(F.xxhash64("vector"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    held: dict[int, list[np.ndarray]] = {}
    for batch in sample.orderBy("dim", F.xxhash64("vector")).toArrow().to_batches():  # SAMPLE vectors or so
        for dim, _, vectors in _by_dim(batch, 0, 1):
            held.setdefault(dim, []).append(vectors)
    longest = {r["dim"]: r.longest for r in sizes}
    routers = {r["dim"]: Router(np.concatenate(held[r["dim"]]), r.n, r.longest) for r in sizes if r["dim"] in held}
    shared = spark.sparkContext.broadcast(routers)
    index = scratch.put(entries.mapInArrow(tidy(_dealt(shared)), "dim int, shard int, vector array<double>, ids array<bigint>"), "index")
    scratch.drop(entries)
    calibrated = ({}, {}) if breadth is not None else _calibrated(spark, index, asked, routers, longest, k, target)
    routed = asked.select("dim", "id", "vector").mapInArrow(tidy(_routed(shared, breadth, calibrated[0])), "dim int, id long, vector array<double>, shards array<int>")
    visits = scratch.put(routed.select("dim", F.explode("shards").alias("shard"), "id", "vector"), "visits")
    found = _together(index, visits).mapInArrow(tidy(_streamed(longest, _search(k, breadth, calibrated[1]))), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id of several vectors counts once
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)
