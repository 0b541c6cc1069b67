"""The dependency graph: edges, degrees, resolution of imports, impact of a change, centrality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions import text as t
from riskspark.storage import release, stored

EXACT_NODES, PIVOTS = 3_000, 128
MOST_EDGES = 16_000_000  # 64 MB of an array
FALLOFF, FIRST, COUPLED, COUPLED_MOST, GAIN = 0.45, 10.0, 14.0, 12.0, 3.2
# Suffixes that an import may leave out, and how specifiers of own files begin.
PY_SUFFIXES, JS_SUFFIXES, JS_STARTS = (".py", ".pyi"), (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), (".", "/", "~", "@/", "src/")


def build(nodes: DataFrame, imports: DataFrame, cochange: DataFrame) -> DataFrame:
    """(src, dst, kind, weight, cochange). nodes: path; imports: src, dst; cochange: path, partner, n. Co-change makes an edge of its own only where no import goes that way."""
    known = nodes.select("path").distinct()
    inside = lambda df: df.filter("src <> dst").join(known.withColumnRenamed("path", "src"), "src", "left_semi").join(known.withColumnRenamed("path", "dst"), "dst", "left_semi")
    own = inside(imports.select("src", "dst").distinct())
    both = inside(cochange.select(F.col("path").alias("src"), F.col("partner").alias("dst"), "n"))
    first = own.join(both, ["src", "dst"], "left").select("src", "dst", F.lit("import").alias("kind"), F.lit(1.0).alias("weight"), F.coalesce("n", F.lit(0)).cast("long").alias("cochange"))
    rest = both.join(own, ["src", "dst"], "left_anti").select("src", "dst", F.lit("cochange").alias("kind"), F.lit(0.5).alias("weight"), F.col("n").cast("long").alias("cochange"))
    return first.unionByName(rest)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) by import edges."""
    ends = edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def impact(edges: DataFrame, seeds: DataFrame, risk: DataFrame, strengths: DataFrame | None = None, nodes: DataFrame | None = None, hops: int = 3, limit: int | None = None, ways: bool = False) -> DataFrame:
    """(node, impact, hops, own_risk; with ways: reached, whether imports lead there): who is reached backwards over edges (src, dst) from seeds (node), each seed by itself; strengths: path, partner, strength."""
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("next")).distinct()
    front = seeds.select(F.col("node").alias("seed"), F.col("node").alias("at")).distinct()
    seen, reached = front, None
    for hop in range(1, hops + 1):  # few hops: a bounded chain of joins
        front = front.join(back, "at").select("seed", F.col("next").alias("at")).distinct().join(seen, ["seed", "at"], "left_anti")
        step = front.select("seed", F.col("at").alias("node"), F.lit(hop).alias("hop"), F.lit(FIRST * FALLOFF ** (hop - 1)).alias("base"))
        seen, reached = seen.unionByName(front), step if reached is None else reached.unionByName(step)
    if strengths is not None:
        own = seeds.select(F.col("node").alias("seed")).distinct()
        pulled = strengths.join(own, strengths["path"] == own["seed"]).select("seed", F.col("partner").alias("node"), F.lit(None).cast("int").alias("hop"), F.least(F.lit(COUPLED_MOST), COUPLED * F.col("strength")).alias("base"))
        reached = reached.unionByName(pulled.join(nodes.select("node"), "node", "left_semi") if nodes is not None else pulled)
    total = reached.groupBy("node").agg(F.sum("base").alias("base"), F.coalesce(F.min("hop"), F.lit(1)).alias("hops"), (F.count("hop") > 0).alias("reached")).join(seeds.select("node").distinct(), "node", "left_anti")
    out = total.join(risk, "node", "left").withColumn("own_risk", F.coalesce("own_risk", F.lit(0.0)))
    out = out.select("node", F.round(F.least(F.lit(100.0), GAIN * F.col("base") * (1 + F.col("own_risk") / 120)), 1).alias("impact"), "hops", "own_risk", *(["reached"] if ways else []))
    return out.orderBy(F.desc("impact"), "node").limit(limit) if limit else out


def reasons(affected: DataFrame, strengths: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """impact()'s rows with `reasons`: how each file is reached, with which seed it changes (the strongest, ties to the smaller), and its own risk. strengths: path, partner, strength."""
    out = affected.withColumns({"pulled": F.lit(None).cast("double"), "by": F.lit(None).cast("string")})
    if strengths is not None:
        own = strengths.join(seeds.select(F.col("node").alias("path")).distinct(), "path", "left_semi")
        best = own.groupBy(F.col("partner").alias("node")).agg(F.max("strength").alias("pulled"), F.min_by(F.col("path"), F.struct(-F.col("strength"), F.col("path"))).cast("string").alias("by"))
        out = affected.join(best, "node", "left")
    by_import = F.when(F.col("hops") == 1, F.lit("imports it directly")).otherwise(F.concat(F.lit("imports it through "), F.col("hops").cast("string"), F.lit(" steps")))
    reached = F.col("pulled").isNull() | (F.col("reached") if "reached" in affected.columns else F.lit(True))
    parts = F.array(
        F.when(reached, by_import),
        F.when(F.col("pulled").isNotNull(), F.concat(F.lit("changes together with "), F.col("by"), F.lit(" in "), F.round(100 * F.col("pulled")).cast("int").cast("string"), F.lit("% of its commits"))),
        F.when(F.col("own_risk") >= 60, F.concat(F.lit("is risky itself: "), F.round("own_risk").cast("int").cast("string"))),
    )
    return out.withColumn("reasons", F.array_compact(parts)).drop("pulled", "by")


def payload(edges: DataFrame, risk: DataFrame, limit: int = 400) -> DataFrame:
    """The edges among the nodes of largest 2 * risk + degree. edges: src, dst; risk: node, own_risk."""
    top = degrees(edges).join(risk, "node", "full").select("node", (2 * F.coalesce("own_risk", F.lit(0.0)) + F.coalesce(F.col("fan_in") + F.col("fan_out"), F.lit(0))).alias("weight"))
    kept = top.orderBy(F.desc("weight"), "node").limit(limit).select("node")
    return edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")


def resolve_generic(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, spec, target): by the name behind the last of ./:\\, of 3 characters or more, if one file has that stem, or one of the importer's directory. imports: importer, spec; files: path."""
    token = F.lower(F.element_at(F.split(F.regexp_replace(F.trim("spec"), "^[\"'<>]+|[\"'<>]+$", ""), r"[./:\\]"), -1))
    asked = imports.select("importer", "spec", token.alias("token"), t.parent(F.col("importer")).alias("dir")).filter(F.length("token") >= 3)
    named = files.select("path", F.lower(t.stem(F.col("path"))).alias("token"), t.parent(F.col("path")).alias("own"))
    stems = named.groupBy("token").agg(F.count("*").alias("n"), F.min("path").alias("only"))
    here = named.groupBy("token", F.col("own").alias("dir")).agg(F.count("*").alias("m"), F.min("path").alias("near"))
    out = asked.join(stems, "token").join(here, ["token", "dir"], "left")
    return out.select("importer", "spec", F.when(F.col("n") == 1, F.col("only")).when(F.col("m") == 1, F.col("near")).alias("target")).filter("target IS NOT NULL").distinct()


def _first_found(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """candidates: importer, spec, rank, stem, suffix_rank, path. All hits of the first stem that has any."""
    found = candidates.join(files.select("path").distinct(), "path")
    first = found.groupBy("importer", "spec").agg(F.min("rank").alias("rank"))
    return found.join(first, ["importer", "spec", "rank"]).select("importer", "spec", F.col("path").alias("target")).distinct()


def _with_suffixes(stems: DataFrame, suffixes) -> DataFrame:
    """stems: importer, spec, stems (in order)."""
    out = stems.select("importer", "spec", F.posexplode("stems").alias("rank", "stem"))
    return out.select("importer", "spec", "rank", F.explode(F.array(*(F.concat("stem", F.lit(s)) for s in suffixes))).alias("path"))


def resolve_python(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, spec, target) of Python modules: the longest prefix first, as module, package, and both below src/; relative ones from the importer's directory."""
    level = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    dirs = F.filter(F.split(t.parent(F.col("importer")), "/"), lambda d: d != "")
    base = F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - F.greatest(level - 1, F.lit(0)), F.lit(0)))
    rest = F.filter(F.split(F.regexp_replace("spec", r"^\.+", ""), r"\."), lambda d: d != "")
    relative = F.array_join(F.concat(base, rest), "/")
    own = F.transform(F.array(F.lit(""), F.lit("/__init__")), lambda s: F.concat(relative, s))
    n = F.size(rest)
    prefixes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(rest, F.lit(1), n - i), "/"))
    absolute = F.flatten(F.transform(prefixes, lambda p: F.array(p, F.concat(p, F.lit("/__init__")), F.concat(F.lit("src/"), p), F.concat(F.lit("src/"), p, F.lit("/__init__")))))
    stems = imports.filter("spec <> ''").select("importer", "spec", F.when(level > 0, own).when(n > 0, absolute).otherwise(F.array().cast("array<string>")).alias("stems"))
    return _first_found(_with_suffixes(stems, PY_SUFFIXES), files)


def resolve_javascript(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, spec, target) of specifiers of own files: as written, with a suffix, then as a directory's index."""
    spec = F.regexp_replace(F.regexp_replace("spec", "^~+", ""), "^@/", "src/")
    joined = F.when(spec.startswith("."), F.concat(t.parent(F.col("importer")), F.lit("/"), spec)).otherwise(F.regexp_replace(spec, "^/+", ""))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.element_at(F.concat(a, F.array(F.lit(""))), F.greatest(F.size(a), F.lit(1))) != ".."), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    base = F.array_join(up, "/")
    own = imports.filter(F.expr(" OR ".join(f"startswith(spec, '{s}')" for s in JS_STARTS)))
    stems = own.select("importer", "spec", F.array(base, F.concat(base, F.lit("/index"))).alias("stems"))
    return _first_found(_with_suffixes(stems, ("", *JS_SUFFIXES)), files)


def _dependencies(starts: np.ndarray, targets: np.ndarray, sources) -> np.ndarray:
    """Brandes' accumulation, a level at a time: the sources' shares of shortest paths that pass each node. The edges of node v lead to targets[starts[v]:starts[v + 1]]."""
    n = len(starts) - 1
    total, paths, share, far = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, -1, np.int32)
    for source in sources:
        front, levels, seen = np.array([source], np.int32), [], []
        paths[source], far[source] = 1.0, 0
        while len(front):
            seen.append(front)
            many = starts[front + 1] - starts[front]
            ends = np.cumsum(many)
            at = np.arange(ends[-1]) + np.repeat(starts[front] - ends + many, many)
            v, w = np.repeat(front, many), targets[at]
            new = far[w] < 0
            v, w = v[new], w[new]
            front = np.unique(w)
            far[front] = len(seen)
            np.add.at(paths, w, paths[v])
            levels.append((v, w))
        for v, w in reversed(levels):
            np.add.at(share, v, paths[v] / paths[w] * (1 + share[w]))
        share[source] = 0.0
        for own in seen:
            total[own] += share[own]
            paths[own], share[own], far[own] = 0.0, 0.0, -1
    return total


def _numbered(nodes: DataFrame) -> DataFrame:
    """(node, id): ids from 0 without gaps, by a node's place in its partition and the sizes of the partitions before."""
    at = stored(nodes.select("node", F.monotonically_increasing_id().alias("at")), "nodes")
    sizes = sorted(at.groupBy(F.shiftright("at", 33).alias("part")).count().collect())  # a row for each partition
    before = nodes.sparkSession.createDataFrame([(r.part, sum(x["count"] for x in sizes[:i])) for i, r in enumerate(sizes)], "part bigint, before bigint")
    placed = at.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(before), "part")
    return stored(placed.select("node", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias("id")), "ids")


def centrality(edges: DataFrame, nodes: DataFrame, exact: int = EXACT_NODES, pivots: int = PIVOTS, most_edges: int = MOST_EDGES) -> DataFrame:
    """(node, centrality): betweenness over directed edges, normalised. Above `exact` nodes it is estimated from `pivots` sources chosen by hash.

    Sources are dealt over tasks; the edges go to each by broadcast, as two arrays of numbers (4 bytes an edge and a node), up to most_edges edges and nodes (measured); above that, breadth-first search runs as joins, one for each level of all pivots together."""
    spark: SparkSession = edges.sparkSession
    edges, nodes = stored(edges.select("src", "dst").filter("src <> dst").distinct(), "edges"), stored(nodes.select("node").distinct(), "nodes")
    release(spark)
    n, m = nodes.count(), edges.count()
    norm = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    chosen = nodes if n <= exact else nodes.orderBy(F.xxhash64("node"), "node").limit(pivots)
    norm *= 1.0 if n <= exact else n / pivots
    if m == 0 or norm == 0.0:
        return nodes.select("node", F.lit(0.0).alias("centrality"))
    if m <= most_edges and n <= most_edges:
        ids = _numbered(nodes.unionByName(edges.select(F.col("src").alias("node"))).unionByName(edges.select(F.col("dst").alias("node"))).distinct())
        ends = edges.join(ids.select(F.col("node").alias("src"), F.col("id").alias("s")), "src").join(ids.select(F.col("node").alias("dst"), F.col("id").alias("d")), "dst")
        pairs = ends.select("s", "d").orderBy("s", "d").toArrow()
        many = np.bincount(pairs["s"].to_numpy(), minlength=ids.count())
        shared = spark.sparkContext.broadcast((np.concatenate([[0], np.cumsum(many)]).astype(np.int32), pairs["d"].to_numpy()))
        del pairs

        def run(batches):
            total = 0
            for batch in batches:
                total = total + _dependencies(*shared.value, batch["id"].tolist())
            if isinstance(total, np.ndarray):
                found = np.flatnonzero(total)
                yield pd.DataFrame({"id": found.astype(np.int32), "part": total[found]})

        dealt = max(1, min(n if n <= exact else pivots, 4 * spark.sparkContext.defaultParallelism))
        parts = chosen.join(ids, "node").select("id").repartition(dealt, "id").mapInPandas(run, "id int, part double")
        parts = parts.groupBy("id").agg(F.sum("part").alias("part")).join(ids, "id")
    else:
        parts = _by_joins(edges, chosen)
    summed = parts.groupBy("node").agg((F.sum("part") * norm).alias("centrality"))
    return nodes.join(summed, "node", "left").select("node", F.coalesce("centrality", F.lit(0.0)).alias("centrality"))


def _by_joins(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """The same shares by joins: forward a level at a time with path counts, then back."""
    front = sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")).checkpoint()
    seen, levels = front.select("s", "v"), [front]
    while True:
        step = front.join(edges, front["v"] == edges["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths")).join(seen, ["s", "v"], "left_anti").checkpoint()
        if step.isEmpty():
            break
        seen, front = seen.unionByName(step.select("s", "v")).checkpoint(), step
        levels.append(step)
    parts, share = None, levels[-1].withColumn("share", F.lit(0.0))
    for k in range(len(levels) - 1, 0, -1):
        own = share.select("s", F.col("v").alias("node"), F.col("share").alias("part"))
        parts = own if parts is None else parts.unionByName(own)
        later = share.select("s", F.col("v").alias("dst"), F.col("paths").alias("below"), "share")
        up = levels[k - 1].join(edges, levels[k - 1]["v"] == edges["src"]).join(later, ["s", "dst"]).groupBy("s", "v").agg(F.sum(F.col("paths") / F.col("below") * (1 + F.col("share"))).alias("share"))
        share = levels[k - 1].join(up, ["s", "v"], "left").withColumn("share", F.coalesce("share", F.lit(0.0))).checkpoint()
    return parts.select("node", "part") if parts is not None else sources.select("node", F.lit(0.0).alias("part")).limit(0)
