"""Nearest vectors by inner product with a forest of hash prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def rotations(dim: int, trees: int, symbols: int, seed: int) -> np.ndarray:
    """A random rotation for each symbol of each tree's hash strings."""
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(trees * symbols)]).astype(np.float32)


def hash_strings(x: np.ndarray, turns: np.ndarray, symbols: int) -> np.ndarray:
    """(rows, trees): strings of symbols as numbers. A symbol names the axis, with sign, nearest to the rotated vector, so that
    vectors share one the likelier the smaller their angle is; one letter tells more than a row of hyperplanes' bits."""
    n, dim = x.shape
    out = np.zeros((n, len(turns) // symbols), np.int64)
    for i, r in enumerate(turns):
        z = x @ r
        axis = np.abs(z).argmax(axis=1)
        out[:, i // symbols] = out[:, i // symbols] * (2 * dim) + 2 * axis + (z[np.arange(n), axis] > 0)
    return out


def first_symbols(x: np.ndarray, turns: np.ndarray, symbols: int, probes: int) -> np.ndarray:
    """(rows, trees * probes): in each tree, the first symbols of the axes nearest to x, the nearest first."""
    out = []
    for r in turns[::symbols]:
        z = x @ r
        axis = np.argsort(-np.abs(z), axis=1, kind="stable")[:, :probes]
        out.append(2 * axis + (np.take_along_axis(z, axis, 1) > 0))
    return np.concatenate(out, axis=1).astype(np.int64)


def lifted(x: np.ndarray, longest: np.ndarray | None) -> np.ndarray:
    """x with one more component: vectors that are indexed get what they lack to the longest length, each of its own, and queries (None) zero,
    so that a larger inner product with a query is a smaller angle to it. A query's length plays no part."""
    if longest is None:
        return np.column_stack([x, np.zeros(len(x))])
    x = x / longest[:, None]
    return np.column_stack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))])


def upper(bins: list[tuple[float, int]], shares: list[float]) -> list[float]:
    """For each of shares, the bound of the first of bins (bound, count), by bound, up to which at least that share of the count lies."""
    sums = np.cumsum([n for _, n in bins])
    return [bins[min(int(np.searchsorted(sums, s * sums[-1])), len(bins) - 1)][0] for s in shares] if bins else []


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, embedding (doubles) of vectors that take part, one a vec_id, and their dimension: that of most of them."""
    e = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    e = e.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    most = e.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = most["dim"] if most else 1
    return e.where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), dim


def search(vectors: DataFrame, every: int = 20, k: int = 20, *, trees: int = 64, symbols: int = 3, block: int = 32_768, crowd: int = 8_192, keep: int = 28, probes: int = 4, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every vector whose vec_id is divisible by `every`, but for itself.

    vectors: vec_id, embedding; other columns play no part. What is indexed is lifted by a component, by which the nearest by
    inner product are the nearest by angle among vectors of about one length; the longest, one in 10, 100, 1,000 and 100,000,
    are each lifted to a length of their own, so that the shorter ones keep their directions. Equal vectors are indexed once; the k + 1 smallest vec_ids of each
    come back at the end, and no other could be among the k nearest. Each tree orders the hash strings of all vectors. A
    query descends to its longest prefix in every tree and ascends, in all trees at once, symbol by symbol, until the
    prefixes hold 40 * N ** 0.6 candidates; from one symbol it ascends to the `probes` sibling symbols nearest to it, and to
    the root only where these hold fewer than 8 * (k + 1), or fewer than k + 1 different rows. These ranges are then read: rows and queries of a tree's prefix meet in a task,
    where the strings are a sorted array, and are compared by vectors of 8 bits a component; the best keep of each tree are
    compared by the original vectors in double precision. A prefix of more than `block` rows is split and its queries go to
    each part; one of more than `crowd` queries is split by these too, and its rows go to each turn. So no group's rows, queries or
    results grow with the table. At the root, whatever the table's size, all rows are candidates. Joins with a row a vector, a
    prefix or an item of exploded arrays are merged, never broadcast: Spark reckons these sides by a file's size, of which they are many times in memory.

    Vectors that are null, zero, of another dimension than most, or hold null or non-finite components take no part. Of
    rows that repeat a vec_id the smallest vector counts. Ties go to the smaller vec_id. Null vec_id: no part. No rows: no rows.
    """
    rows, dim = usable(vectors)
    same = Window.partitionBy("embedding")
    ranked = rows.withColumn("n", F.row_number().over(same.orderBy("vec_id"))).where(F.col("n") <= k + 1).withColumn("node", F.min("vec_id").over(same))
    ranked = materialize(ranked.select("node", "vec_id", F.when(F.col("n") == 1, F.col("embedding")).alias("embedding")), "vectors")
    nodes = ranked.where("embedding is not null").select("node", "embedding")
    total = nodes.count()
    base = 2 * (dim + 1)
    # in parts of the largest component, whose square may be no double
    largest = nodes.agg(F.max(F.array_max(F.transform("embedding", F.abs)))).first()[0] or 1.0
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x / F.lit(largest)) * (x / F.lit(largest))))
    # long vectors would make all others' directions nothing: the longest are lifted to lengths of their own
    sizes = nodes.select(norm.alias("norm")).groupBy(F.floor(F.log2("norm") * 64).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"))
    norms = upper(sorted((r["norm"], r["n"]) for r in sizes.collect()), [0.9, 0.99, 0.999, 0.99999, 1.0]) or [1.0]  # 64 rows an octave
    longest = F.coalesce(*[F.when(norm <= m, F.lit(m)) for m in norms], norm)
    queries = materialize(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("node"), "embedding"), "queries")

    def index(kind: int):
        def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            turns = rotations(dim + 1, trees, symbols, seed)
            for batch in batches:
                if not len(batch):
                    continue
                x = np.array(batch["embedding"].tolist(), np.float64)
                up = None if kind else lifted(x / largest, batch["longest"].to_numpy())
                x /= np.abs(x).max(axis=1, keepdims=True)
                up = (lifted(x, None) if kind else up).astype(np.float32)
                codes = hash_strings(up, turns, symbols)
                packed = np.rint(x * 127).astype(np.int8) if not kind else x.astype(np.float32)
                out = pd.DataFrame({"node": batch["node"].to_numpy(), "codes": list(codes), "vec": [v.tobytes() for v in packed]})
                yield out.assign(firsts=list(first_symbols(up, turns, symbols, probes))) if kind else out

        return code

    schema = "node long, codes array<long>, vec binary"
    size = nodes.select("node", F.array_max(F.transform("embedding", F.abs)).cast("float").alias("size"))
    coded = materialize(nodes.withColumn("longest", longest).mapInPandas(index(0), schema).join(size.hint("merge"), "node"), "codes")
    asked = materialize(queries.mapInPandas(index(1), f"{schema}, firsts array<long>"), "asked")
    of = lambda level: F.floor(F.col("code") / F.lit(base ** (symbols - level))).cast("long")
    strings = coded.select(F.posexplode("codes").alias("tree", "code"))
    counts = strings.groupBy("tree", of(symbols).alias("prefix")).count()
    levels = [counts.withColumn("level", F.lit(symbols))]
    for level in range(symbols - 1, 0, -1):
        counts = counts.groupBy("tree", F.floor(F.col("prefix") / base).alias("prefix")).agg(F.sum("count").alias("count"))
        levels.append(counts.withColumn("level", F.lit(level)))
    counts = materialize(reduce(DataFrame.unionByName, levels).select("tree", "level", "prefix", "count"), "prefixes")
    wanted, few = 40.0 * max(total, 1) ** 0.6, 8 * (k + 1)
    at = asked.select("node", F.posexplode("codes").alias("tree", "code"))
    at = at.select("node", "tree", F.explode(F.array(*[F.struct(F.lit(v).alias("level"), of(v).alias("prefix")) for v in range(1, symbols + 1)])).alias("p")).select("node", "tree", "p.*")
    held = at.join(counts.hint("merge"), ["tree", "level", "prefix"]).groupBy("node", "level").agg(F.sum("count").alias("held"))
    deep = held.where(F.col("held") >= wanted).groupBy("node").agg(F.max("level").alias("level"))
    # level -1: one symbol and its siblings
    wide = asked.select("node", F.posexplode("firsts").alias("at", "prefix")).select("node", F.floor(F.col("at") / probes).cast("int").alias("tree"), "prefix")
    wide = wide.join(counts.where("level = 1").hint("merge"), ["tree", "prefix"]).groupBy("node").agg(F.sum("count").alias("held")).where(F.col("held") >= few).select("node", F.lit(-1).alias("wide"))
    asked = materialize(asked.join(deep, "node", "left").join(wide, "node", "left").withColumn("level", F.coalesce("level", "wide", F.lit(0))).drop("wide"), "levels")

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        level, none = int(part["level"].iloc[0]), {"query": [], "node": [], "about": []}
        here, ask = part[part["query"] == 0], part[part["query"] == 1]
        if not len(here) or not len(ask):
            return pd.DataFrame(none)
        order = np.argsort(here["code"].to_numpy(), kind="stable")
        code, node = here["code"].to_numpy()[order], here["node"].to_numpy()[order]
        x = np.frombuffer(b"".join(here["vec"].iloc[order]), np.int8).reshape(len(here), -1)
        size = here["size"].to_numpy()[order]
        span = base ** (symbols - level)
        out = []
        for prefix, group in ask.groupby(ask["code"].to_numpy() // span):
            lo, hi = np.searchsorted(code, [prefix * span, (prefix + 1) * span])
            if lo == hi:
                continue
            y = x[lo:hi].astype(np.float32) * (size[lo:hi, None] / 127)
            for i in range(0, len(group), 256):
                some = group.iloc[i : i + 256]
                q = np.frombuffer(b"".join(some["vec"]), np.float32).reshape(len(some), -1)
                s = q @ y.T
                top = np.argpartition(-s, min(keep, s.shape[1] - 1), axis=1)[:, :keep]
                out.append(pd.DataFrame({"query": np.repeat(some["node"].to_numpy(), top.shape[1]), "node": node[lo:hi][top].ravel(), "about": np.take_along_axis(s, top, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame(none)

    def visit(level: int, here: DataFrame) -> DataFrame:
        some, depth = 1 if level == 0 else trees, abs(level)
        tree_code = lambda d, *more: d.select("node", "vec", *more, F.posexplode(F.slice("codes", 1, some)).alias("tree", "code")).withColumn("prefix", of(depth))
        r = tree_code(coded, "size").withColumn("query", F.lit(0))
        here = here.withColumn("size", F.lit(1.0).cast("float"))
        if level < 0:
            q = here.select("node", "vec", "size", F.posexplode("firsts").alias("at", "prefix")).select("node", "vec", "size", F.floor(F.col("at") / probes).cast("int").alias("tree"), (F.col("prefix") * base ** (symbols - 1)).alias("code"), "prefix")
        else:
            q = tree_code(here, "size")
        q = q.withColumn("query", F.lit(1))
        large = counts.where((F.col("level") == depth) & (F.col("count") > block)).select("tree", "prefix", F.ceil(F.col("count") / block).alias("parts"))
        if level == 0:
            r, q = r.withColumn("parts", F.lit(-(-total // block)).cast("long")), q.withColumn("parts", F.lit(-(-total // block)).cast("long"))
        else:
            r, q = (d.join(large, ["tree", "prefix"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))) for d in (r, q))
        busy = q.groupBy("tree", "prefix").count().where(F.col("count") > crowd).select("tree", "prefix", F.ceil(F.col("count") / crowd).alias("turns"))
        busy = materialize(busy, "busy")  # written, so that Spark can split a hot prefix in the joins
        r, q = (d.join(busy, ["tree", "prefix"], "left").withColumn("turns", F.coalesce("turns", F.lit(1).cast("long"))) for d in (r, q))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        r = r.withColumn("part", F.pmod(F.xxhash64("node"), "parts")).withColumn("turn", each("turns"))
        q = q.withColumn("part", each("parts")).withColumn("turn", F.pmod(F.xxhash64("node"), "turns"))
        slots = max(1, -(-(total + probes * asking) // 4096)) if level else 1
        both = r.unionByName(q).withColumn("slot", F.pmod(F.xxhash64("prefix"), F.lit(slots))).withColumn("level", F.lit(depth))
        return both.select("tree", "slot", "part", "turn", "level", "query", "node", "code", "vec", "size").groupBy("tree", "slot", "part", "turn").applyInPandas(meet, "query long, node long, about double")

    asking = asked.count()
    levels = sorted(r["level"] for r in asked.select("level").distinct().collect())  # at most symbols + 2
    found = [visit(level, asked.where(F.col("level") == level)) for level in levels]
    if not found:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    once = lambda d: d.groupBy("query", "node").agg(F.max("about").alias("about"))
    found = materialize(once(reduce(DataFrame.unionByName, found)), "found")
    # trees may hold the same few rows: queries that found too few go on to the root
    full = found.groupBy("query").count().where(F.col("count") >= min(k + 1, total)).select(F.col("query").alias("node"))
    short = asked.where("level <> 0").join(full, "node", "left_anti")
    if not short.isEmpty():
        found = once(found.unionByName(visit(0, short)))
    near = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("about"), "node"))).where(F.col("n") <= 2 * keep)
    near = near.select("query", "node").join(nodes.hint("merge"), "node").join(queries.select(F.col("node").alias("query"), F.col("embedding").alias("q")).hint("merge"), "query")
    exact = near.select("query", "node", F.aggregate(F.zip_with("embedding", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    exact = exact.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("query", "node", "score")
    rows_ = exact.join(ranked.select("node", "vec_id").hint("merge"), "node").where("vec_id <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return rows_.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
