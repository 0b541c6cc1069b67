"""What the operators of this package share: tables, shared storage, Arrow text buffers and word scanning."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A batch of texts is cut into pieces of about this many bytes, so that work arrays stay small.
CHUNK_BYTES = 1 << 19
#: Tables in the shared folder get files of about this much input.
PART_BYTES = 32 << 20


def col(name: str) -> Column:
    """The column of exactly this name, also with dots or backticks in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken, name: str) -> str:
    """name, made longer until it is none of taken (Spark's names ignore case)."""
    taken = {x.lower() for x in taken}
    while name.lower() in taken:
        name += "_"
    return name


def mapped(df: DataFrame, run, added: list[str], skip: int = 0) -> DataFrame:
    """df.mapInArrow(run) for columns of any names: run sees plain names and gives df's columns but the first `skip`, then those added ("name type")."""
    kinds = [f"in_{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema)]
    out = df.toDF(*(f"in_{i}" for i in range(len(kinds)))).mapInArrow(tidy(run), ", ".join([*kinds[skip:], *added]))
    return out.toDF(*df.columns[skip:], *(x.split(" ", 1)[0].strip("`") for x in added))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where a local session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="riskspark-checkpoint-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """Parquet tables in the shared folder: they cut the lineage and survive the loss of any executor.

    A table is written by as many tasks as `like` (the input that it follows from) needs files of PART_BYTES, two a core at least;
    so small tables don't become one small file for each shuffle partition."""

    def __init__(self, like: DataFrame):
        self.spark, self.parts, self.paths = like.sparkSession, parts_for(like), {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.coalesce(self.parts).write.parquet(path)
        where, system = _file_system(self.spark, path)
        system.deleteOnExit(where)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """For tables that no plan reads any more."""
        for t in tables:
            if id(t) in self.paths:
                where, system = _file_system(self.spark, self.paths.pop(id(t))[0])
                system.delete(where, True)


def parts_for(df: DataFrame) -> int:
    return min(max(2 * df.sparkSession.sparkContext.defaultParallelism, estimated_bytes(df) // PART_BYTES + 1), 1 << 24)


def written(df: DataFrame, name: str, like: DataFrame | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, which goes when the session ends."""
    return Scratch(df if like is None else like).put(df, name)


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy(run):
    """A function of Arrow batches that gives freed memory back to the system at its end: workers live on idle."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if _trim():
                _trim()(0)

    return tidied


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size; only used to choose sizes, never results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES):
    """Yields (first row, texts) with texts a null-free string (or binary) array of about limit bytes; a longer text stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column.cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
    for lo, hi in cuts(offsets_of(column), limit):
        yield lo, column.slice(lo, hi - lo)


def cuts(ends: np.ndarray, limit: int = CHUNK_BYTES):
    """(first, past the last) of rows of about limit bytes together, at least one row; ends: bytes before each row, and in all."""
    lo, n = 0, len(ends) - 1
    while lo < n:
        hi = int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def sliced(batches, at: int, limit: int = CHUNK_BYTES):
    """Batches cut by the bytes of column `at`, each with that column's texts: what a task holds doesn't follow the rows of a batch."""
    for batch in batches:
        for lo, texts in pieces(batch.column(at), limit):
            yield batch.slice(lo, len(texts)), texts


def offsets_of(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def raw(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more offset than texts)."""
    at = offsets_of(texts)
    data = texts.buffers()[2]
    return (bytes(memoryview(data)[at[0] : at[-1]]) if data is not None else b""), at - at[0]


def byte_table(separators) -> bytes:
    """For bytes.translate: A-Z become a-z, separators become a space."""
    out = bytearray(range(256))
    for c in range(65, 91):
        out[c] = c + 32
    for c in separators:
        out[c] = 32
    return bytes(out)


def word_bounds(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes, which never cross a text's end, and the first word of each text (one more than texts)."""
    if not data:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    full = np.frombuffer(data, np.uint8) != 32
    begins, stops = full.copy(), full.copy()
    begins[1:] &= ~full[:-1]
    stops[:-1] &= ~full[1:]
    inner = at[(at > 0) & (at < len(data))]
    begins[inner] = full[inner]
    stops[inner - 1] = full[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, at)


_POWERS: dict[str, np.ndarray] = {}
_ODD = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 4096)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from one running polynomial sum over all bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[np.frombuffer(data, np.uint8)] * up[: len(data)], out=total[1:])
        own = (total[ends] - total[starts]) * down[starts]
        return mix(own + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
