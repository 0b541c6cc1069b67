"""MinHash near-dedup with b-bit signatures.

A document's set: the distinct SHINGLE-word shingles of its whole text, A-Z in lower case, words split at [\\x20\\x09-\\x0D]; with
fewer words the whole sequence is one shingle; without words it is empty and linked with nothing. Documents whose sets have
100 * intersection >= percent * union are linked; a component is what links connect. Shingles are 64-bit hashes of their words.

1. One pass over the texts gives, for each document, its set's size and 128-bit hash, MINIMA minima, of which BITS low
   bits stay, packed (the b-bit signature), and a hash of each band's minima. Equal sets become one class, which is its
   smallest id, before anything is paired; only the hashes of sets shuffle for that.
2. A band's bucket links each class with the bucket's smallest: as many candidates as rows, never all pairs of a bucket. Bit
   counts of the signatures' difference give the similarity, corrected for the 2**-BITS of pairs that agree by chance; what
   lies more than DEVIATIONS standard deviations below the threshold is left out. The rest is confirmed on full sets.
3. Confirmed links are contracted to components, by joins. A bucket whose members are then in several components is compared
   pair by pair, by longer signatures of one bit a field that only members of such buckets get, and what passes is confirmed
   too. Members of the bucket's main component meet the others only. A large bucket is cut into blocks of BLOCK classes, whose pairs are groups of their own; one of so many blocks that
   a member would be copied more than BANDS times is split first by every further band that its members share, so that
   unlike members part (similar ones share many bands). No bucket is capped.

At similarity 0.75 a pair shares no bucket with probability (1 - 0.75**5)**64 = 3e-8, fewer than two with 6e-7, and its
signature lies below the cut with 3e-6.

Ids are integers. Rows that share an id are one document: a link of either text is its link. A null id takes part in nothing:
its component is null and it is kept. Text of null is empty. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import Scratch, byte_table, col, fresh, mix, pieces, raw, sliced, table, tidy, word_bounds, word_hashes

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 64, 5
MINIMA, BITS = 480, 4  # of the signature; bands take the first BANDS * ROWS
FINE_MINIMA, FINE_BITS = 3840, 1  # of the longer signature
DEVIATIONS, BLOCK, GROUP = 4.5, 1024, 64
LONGS, FINE_LONGS = -(-MINIMA * BITS // 64), -(-FINE_MINIMA * FINE_BITS // 64)
BROADCAST_IDS = 1 << 20
LOWER = byte_table([0x20, *range(0x09, 0x0E)])
_SALT = mix(np.arange(7, 7 + FINE_MINIMA, dtype=np.uint64))
_XOR, _ODD = (_SALT >> np.uint64(32)).astype(np.uint32), _SALT.astype(np.uint32) | np.uint32(1)
_FOLD = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: pa.Array, size: int = SHINGLE):
    """The sorted distinct shingle hashes of each text."""
    data, at = raw(texts)
    starts, ends, first = word_bounds(data := data.translate(LOWER), at)
    words = word_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - size + 1)
        rolled = np.full(n, size, np.uint64)
        for i in range(size):
            rolled = rolled * _FOLD + words[i : i + n]
        rolled = mix(rolled)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= size:
                yield np.unique(rolled[lo : hi - size + 1])
            elif hi > lo:
                whole = np.full(1, hi - lo, np.uint64)
                for w in words[lo:hi]:
                    whole = whole * _FOLD + w
                yield mix(whole)
            else:
                yield np.zeros(0, np.uint64)


def set_hash(one: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        both = mix(one).sum(dtype=np.uint64), mix(one ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return tuple(int(x.astype(np.int64)) for x in both)


def minima(one: np.ndarray, count: int = MINIMA) -> np.ndarray:
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    short, step = (one >> np.uint64(32)).astype(np.uint32), max(1, (1 << 16) // count)
    for lo in range(0, len(short), step):
        cells = short[lo : lo + step, None] ^ _XOR[:count]
        cells *= _ODD[:count]
        np.minimum(out, cells.min(axis=0), out=out)
    return out


def packed(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of each minimum, as rows of 64-bit integers."""
    per = 64 // bits
    low = np.zeros((len(least), -(-least.shape[1] // per) * per), np.uint64)
    low[:, : least.shape[1]] = mix(least.astype(np.uint64)) & np.uint64((1 << bits) - 1)
    shifted = low.reshape(len(least), -1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(bits))
    return np.bitwise_or.reduce(shifted, axis=2)


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), BANDS)).copy()
    by_band = least[:, : BANDS * ROWS].reshape(len(least), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = mix(key * _FOLD + by_band[:, :, i])
    return key


def most_different(percent: int, count: int = MINIMA, bits: int = BITS) -> int:
    """The most signature fields that may differ: DEVIATIONS standard deviations more than at a similarity of percent."""
    chance = 2.0**-bits
    equal = chance + (1 - chance) * percent / 100
    return int(count * (1 - equal) + DEVIATIONS * (count * equal * (1 - equal)) ** 0.5)


def _features(batches):
    for batch, texts in sliced(batches, 1):
        n, hashes, rows, seen = [], [], [], {}
        for one in shingle_sets(texts):
            n.append(len(one))
            hashes.append(h := set_hash(one))
            if h not in seen:
                seen[h] = minima(one)
            rows.append(seen[h])
        least = np.array(rows)
        sig, keys = packed(least).astype(np.int64), band_keys(least).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array([h[0] for h in hashes], pa.int64()), pa.array([h[1] for h in hashes], pa.int64()), _long_lists(sig), _long_lists(keys)], ["id", "n", "hi", "lo", "sig", "bands"])


def _long_lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def _fine(batches):
    """(sid, hi, lo, sig): the longer signature."""
    for batch, texts in sliced(batches, 1):
        sets = list(shingle_sets(texts))
        bits = np.concatenate([packed(minima(one, FINE_MINIMA)[None], FINE_BITS) for one in sets]).astype(np.int64)  # one by one: minima take much room
        hashes = [set_hash(one) for one in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[0] for h in hashes], pa.int64()), pa.array([h[1] for h in hashes], pa.int64()), _long_lists(bits)], ["sid", "hi", "lo", "sig"])


def _confirm(percent: int):
    """Rows come sorted by (a, salt, role): a's own text, then texts to compare it with."""

    def run(batches):
        now, own = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            a, salt, role, b, hi, lo = (batch.column(i).to_pylist() for i in range(6))
            for at, texts in pieces(batch.column(6)):
                for i, one in enumerate(shingle_sets(texts), at):
                    if (a[i], salt[i]) != now:
                        now, own = (a[i], salt[i]), []
                    if set_hash(one) != (hi[i], lo[i]):
                        continue  # another row of the same id
                    if role[i] == 0:
                        own.append(one)
                        continue
                    for mine in own:
                        both = len(np.intersect1d(mine, one, assume_unique=True))
                        if 100 * both >= percent * (len(mine) + len(one) - both):
                            out.append((a[i], b[i]))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """pairs: a, b, and their sets' hashes a_hi, a_lo, b_hi, b_lo. texts: id, text. Those pairs whose full sets are similar enough.

    A document with many partners is compared in groups of about GROUP of them; only texts that a pair needs are shuffled."""
    ids = pairs.select(F.col("a").alias("needed_id")).union(pairs.select("b")).distinct()
    degree = pairs.groupBy("a").agg(F.count("*").alias("deg"))
    pairs = pairs.join(degree, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("deg") / GROUP)))
    others = pairs.select("a", "salt", F.lit(1).alias("role"), "b", F.col("b_hi").alias("hi"), F.col("b_lo").alias("lo"))
    own = pairs.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b"), F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")).distinct()
    needed = own.unionByName(others)
    texts = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, texts["id"] == ids["needed_id"], "left_semi")
    # never a broadcast of the pairs, which grow with the input
    rows = needed.hint("merge").join(texts, needed["b"] == texts["id"]).select("a", "salt", "role", "b", "hi", "lo", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return rows.mapInArrow(tidy(_confirm(percent)), "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, comp) for the ends of edges (a, b): comp is the smallest id that edges connect.

    Each round maps every id to the smallest of itself and its neighbours and contracts the edges; the smallest id of a component never moves."""
    scratch = scratch or Scratch(edges)
    edges = scratch.put(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mapping: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = scratch.put(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up")), "step")
        left, right = step.select("a", F.col("up").alias("x")), step.select(F.col("a").alias("b"), F.col("up").alias("y"))
        moved = edges.join(left, "a").join(right, "b").filter("x <> y")
        rest = scratch.put(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if mapping is None:
            mapping = step.select(F.col("a").alias("id"), F.col("up").alias("comp"))
            scratch.drop(edges)
        else:
            now = scratch.put(mapping.join(step, mapping["comp"] == step["a"], "left").select("id", F.coalesce("up", "comp").alias("comp")), "mapping")
            scratch.drop(edges, step, mapping)
            mapping = now
        edges = rest
    return mapping if mapping is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))


def _different(x: str, y: str) -> Column:
    """Signature fields in which two arrays of LONGS integers differ."""
    total = F.lit(0)
    ones = F.lit(sum(1 << i for i in range(0, 64, BITS)))
    for i in range(LONGS):
        d = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        folded = d
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(d, k))
        total = total + F.bit_count(folded.bitwiseAND(ones))
    return total


def _close(sid, comp, side, sig, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of side 0 or 2 against those of side 1 or 2: places of those of other components with at most limit different fields."""
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    step, out = max(1, (1 << 16) // max(1, len(right))), []
    for lo in range(0, len(left), step):
        part = left[lo : lo + step]
        i, j = np.nonzero((comp[part][:, None] != comp[right]) & ((side[part][:, None] != 2) | (sid[part][:, None] < sid[right])))
        x, y = part[i], right[j]
        for at in range(0, len(x), 1 << 14):
            u, v = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
            near = np.bitwise_count(sig[u] ^ sig[v]).sum(axis=1, dtype=np.int64) <= limit  # one bit a field: each that is set differs
            out.append((u[near], v[near]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def _block_pairs(limit: int):
    """Rows come sorted by (grp, bi, bj), then sid, comp, side, whole, signature and tags; one block pair is held at a time.

    Tags are parts of the bands' hashes. Where a group is a whole bucket, two members are given by the first that they share."""

    def found(grp, parts):
        sid, comp, side, whole, sig, tags = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, v = _close(sid, comp, side, sig, limit)
        if whole[0] and len(u):
            own = np.flatnonzero(tags[0] == int(np.int64(grp).astype(np.uint64) >> np.uint64(33)))
            first = np.isin((tags[u] == tags[v]).argmax(axis=1), own)
            u, v = u[first], v[first]
        return np.stack([np.minimum(sid[u], sid[v]), np.maximum(sid[u], sid[v])], axis=1)

    def run(batches):
        now, held = None, []
        for batch in batches:
            grp, bi, bj, *numbers = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            sig = batch.column(7).flatten().to_numpy(zero_copy_only=False).astype(np.uint64).reshape(-1, FINE_LONGS)
            tags = batch.column(8).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
            cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
            out = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(grp)], strict=True):
                if (key := (grp[lo], bi[lo], bj[lo])) != now:
                    if held:
                        out.append(found(now[0], held))
                    now, held = key, []
                held.append(tuple(x[lo:hi].copy() for x in (*numbers, sig, tags)))
            if out:
                yield _pairs(np.concatenate(out))
        if held:
            yield _pairs(found(now[0], held))

    return run


def _pairs(rows: np.ndarray) -> pa.RecordBatch:
    rows = np.unique(rows, axis=0)
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["a", "b"])


def _rest(buckets: DataFrame, comps: DataFrame, sets: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame | None, list[DataFrame]]:
    """(a, b): pairs of classes of different components that share a bucket (a large bucket: and another band) and may be similar, None if there is nothing to compare; and the tables that this reads."""
    several = lambda df, key: df.groupBy(key).agg(F.min_by("comp", "sid").alias("main"), F.count("*").alias("size"), (F.min("comp") < F.max("comp")).alias("several")).filter("several").drop("several")
    placed = scratch.put(buckets.join(comps, buckets["sid"] == comps["id"], "left").select("bucket", "sid", F.coalesce("comp", "sid").alias("comp")), "placed")
    mixed = scratch.put(several(placed, "bucket"), "mixed")
    if mixed.isEmpty():
        return None, [placed, mixed]
    held = scratch.put(placed.join(mixed, "bucket"), "rows")
    most, used = BANDS // 2 * BLOCK, [held]
    rows = held.filter(F.col("size") <= most).select(F.col("bucket").alias("grp"), F.lit(1).alias("whole"), "sid", "comp", "main", "size")
    if mixed.agg(F.max("size")).first()[0] > most:
        shared = held.filter(F.col("size") > most).join(sets.select("sid", "bands"), "sid")
        other = F.explode(F.filter("bands", lambda x: x != F.col("bucket")))
        parted = scratch.put(shared.select("bucket", other.alias("band"), "sid", "comp").select(F.xxhash64("bucket", "band").alias("grp"), "sid", "comp"), "parted")
        again = scratch.put(several(parted, "grp"), "again")
        rows, used = rows.unionByName(parted.join(again, "grp").select("grp", F.lit(0).alias("whole"), "sid", "comp", "main", "size")), [held, parted, again]
    scratch.drop(placed, mixed)
    members = held.select(F.col("sid").alias("member")).distinct()
    wanted = texts.join(F.broadcast(members) if members.count() <= BROADCAST_IDS else members, texts["id"] == members["member"], "left_semi")
    fine = wanted.mapInArrow(tidy(_fine), "sid long, hi long, lo long, sig array<bigint>").join(sets.select("sid", "hi", "lo", "bands"), ["sid", "hi", "lo"])
    tags = F.transform("bands", lambda x: F.shiftrightunsigned(x, 33).cast("int"))
    fine = scratch.put(fine.dropDuplicates(["sid", "hi", "lo"]).select("sid", "sig", tags.alias("tags")), "fine")
    used.append(fine)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.select("grp", "whole", "sid", "comp", (F.col("comp") == F.col("main")).alias("major"), blocks.alias("blocks"), F.pmod(F.xxhash64("sid"), blocks).cast("int").alias("own"))
    # one block: all with all. More: members of the main component meet the others only, once each
    dealt = lambda df, bi, bj, side: df.select("grp", F.lit(bi).cast("int").alias("bi"), F.lit(bj).cast("int").alias("bj"), "sid", "comp", F.lit(side).cast("int").alias("side"), "whole")
    one = dealt(rows.filter("blocks = 1"), 0, 0, 2)
    large = rows.filter("blocks > 1")
    every = large.filter("not major").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    parts = [one, dealt(large.filter("major"), -1, F.col("own"), 1), dealt(every, -1, F.col("other"), 0), dealt(every, F.least("own", "other"), F.greatest("own", "other"), side)]
    all_rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    signed = all_rows.join(fine, "sid").select("grp", "bi", "bj", "sid", "comp", "side", "whole", "sig", "tags")
    signed = signed.repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj")
    return signed.mapInArrow(tidy(_block_pairs(most_different(percent, FINE_MINIMA, FINE_BITS))), "a long, b long").distinct(), used


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs; see the module for the rules."""
    texts = docs.select(col(doc_id).cast("long").alias("id"), col(text).cast("string").alias("text"))
    scratch, limit = Scratch(texts), most_different(percent)
    schema = "id long, n long, hi long, lo long, sig array<bigint>, bands array<bigint>"
    features = texts.mapInArrow(tidy(_features), schema).withColumn("uid", F.monotonically_increasing_id())
    features = scratch.put(features, "features")
    nodes = features.filter("n > 0 and id is not null")
    copies = nodes.groupBy("hi", "lo").agg(F.min("id").alias("least"), F.min_by("uid", "id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = scratch.put(copies, "copies")
    known = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    sets = nodes.join(known, ["hi", "lo"], "left").filter("first is null or first = uid").select(F.coalesce("least", "id").alias("sid"), "hi", "lo", "sig", "bands")
    keys = sets.select("sid", F.explode("bands").alias("bucket"))
    hubs = keys.groupBy("bucket").agg(F.min("sid").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    buckets = scratch.put(keys.join(hubs, "bucket"), "buckets")
    half = lambda side: sets.select(F.col("sid").alias(side), F.col("hi").alias(f"{side}_hi"), F.col("lo").alias(f"{side}_lo"), F.col("sig").alias(f"{side}_sig"))
    stars = buckets.filter("sid <> hub").select(F.col("hub").alias("a"), F.col("sid").alias("b")).distinct()
    hopeful = stars.join(half("b"), "b").join(half("a"), "a").filter(_different("a_sig", "b_sig") <= limit).drop("a_sig", "b_sig")
    hopeful = scratch.put(hopeful, "pairs")
    comps = components(confirmed(hopeful, texts, percent), scratch)
    rest, used = _rest(buckets.filter("size > 2").select("bucket", "sid"), comps, sets, texts, percent, scratch)
    scratch.drop(hopeful)
    if rest is not None:
        rest = rest.join(half("a").drop("a_sig"), "a").join(half("b").drop("b_sig"), "b")
        rest = scratch.put(rest, "pairs")
        scratch.drop(*used)
        if not rest.isEmpty():
            more = confirmed(rest, texts, percent)
            ends = lambda side: comps.select(F.col("id").alias(side), F.col("comp").alias(f"{side}_comp"))
            more = more.join(ends("a"), "a", "left").join(ends("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
            up = components(more, scratch).select(F.col("id").alias("old"), F.col("comp").alias("top"))
            alone = up.join(comps, up["old"] == comps["id"], "left_anti").select(F.col("old").alias("id"), F.col("top").alias("comp"))
            moved = comps.join(up, comps["comp"] == up["old"], "left").select("id", F.coalesce("top", "comp").alias("comp"))
            comps = scratch.put(moved.unionByName(alone), "components")
    scratch.drop(buckets, *used)
    out = features.select("id", "n", "hi", "lo").join(known, ["hi", "lo"], "left").withColumn("sid", F.coalesce("least", "id"))
    comps = comps.withColumnRenamed("id", "member")
    out = out.join(F.broadcast(comps) if comps.count() <= BROADCAST_IDS else comps, out["sid"] == F.col("member"), "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.coalesce("comp", "sid"))).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, that of the smallest id. Rows without an id stay; of rows that share an id and stay, exact repeats go."""
    found = near_duplicates(docs, text, doc_id, percent)
    name = fresh(docs.columns, "dropped_id")
    gone = written_ids(found.filter("not kept").select(F.col("id").alias(name)).distinct(), docs)
    out = docs.join(gone, col(doc_id).cast("long") == F.col(name), "left_anti")
    twice = written_ids(out.groupBy(col(doc_id).cast("long").alias(name)).agg(F.count("*").alias("n")).filter(f"n > 1 and {name} is not null").select(name), docs)
    if twice.isEmpty():
        return out
    same = col(doc_id).cast("long") == F.col(name)
    return out.join(twice, same, "left_anti").unionByName(out.join(twice, same, "left_semi").distinct())


def written_ids(ids: DataFrame, like: DataFrame) -> DataFrame:
    """A written table of ids, broadcast if its measured size allows."""
    out = Scratch(like).put(ids, "ids")
    return F.broadcast(out) if out.count() <= BROADCAST_IDS else out


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m AS component_id, d.doc_id = m AS kept
FROM d JOIN (SELECT doc_id, min(r) AS m FROM reach GROUP BY doc_id) USING (doc_id) LEFT JOIN n USING (doc_id)
"""
