"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new capacities, and files are rewritten by that plan."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path


def min_cost_flow(supply: list[int], capacity: list[int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """{(i, j): bytes from old shard i to new shard j} of least total cost, by successive shortest augmenting paths.

    By default a byte that stays costs nothing and one that moves costs 1. The graph has a node a shard: it is solved on
    the driver, where only the shards' sizes are. Raises ValueError where capacity doesn't hold the supply.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are smaller than what there is to place")
    n, m = len(supply), len(capacity)
    s, t = n + m, n + m + 1
    left: dict[tuple[int, int], int] = {}
    price: dict[tuple[int, int], int] = {}
    near: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, most: int, c: int) -> None:
        left[a, b], left[b, a], price[a, b], price[b, a] = most, 0, c, -c
        near[a].append(b)
        near[b].append(a)

    for i, x in enumerate(supply):
        edge(s, i, x, 0)
        for j in range(m):
            edge(i, n + j, x, cost(i, j))
    for j, x in enumerate(capacity):
        edge(n + j, t, x, 0)
    while True:
        dist, back, todo, queued = {s: 0}, {}, deque([s]), {s}
        while todo:
            a = todo.popleft()
            queued.discard(a)
            for b in near[a]:
                if left[a, b] > 0 and dist[a] + price[a, b] < dist.get(b, math.inf):
                    dist[b], back[b] = dist[a] + price[a, b], a
                    if b not in queued:
                        todo.append(b)
                        queued.add(b)
        if t not in dist:
            break
        path, b = [], t
        while b != s:
            path.append((back[b], b))
            b = back[b]
        most = min(left[e] for e in path)
        for a, b in path:
            left[a, b] -= most
            left[b, a] += most
    return {(i, j): left[n + j, i] for i in range(n) for j in range(m) if left[n + j, i] > 0}


def cuts(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old, start, end, new): the flow as intervals of bytes of each old shard; what stays comes first."""
    out, at = [], {}
    for (i, j), x in sorted(flow.items(), key=lambda f: (f[0][0], f[0][0] != f[0][1], f[0][1])):
        start = at.get(i, 0)
        out.append((i, start, start + x, j))
        at[i] = start + x
    return out


def untouched(plan: list[tuple[int, int, int, int]], n_new: int) -> list[int]:
    """Old shards that are new ones too, that nothing leaves and nothing enters."""
    moved = {s for i, _, _, j in plan if i != j for s in (i, j)}
    return sorted({i for i, _, _, _ in plan if i < n_new} - moved)


def reshard(docs: DataFrame, old: Column, n_old: int, n_new: int, path: str | None = None, slot: Column | None = None) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """Rewrite docs (doc_id, text and any other columns) from n_old shards into n_new of near equal bytes; law "bytes".

    old: each row's old shard, 0 to n_old - 1. A row weighs its text's UTF-8 bytes (null: none) plus 1. Returns the new
    files, as a table of docs' columns with shard and slot (gapless from 0), and the transfers. Columns of docs named shard
    or slot are not kept. A document is never cut: the side that holds its middle gets it, so that each cut costs half a document at most.

    Each old shard is a row of blocks, about as many as a block has rows, so that both grow with the root of the rows; a
    hot shard has more. slot: each row's place in its old shard, gapless from 0, where there is one: shards that nothing leaves
    or enters then keep their rows and places as docs has them, and only the files of the others are written. Byte positions are sums over blocks plus sums within one. The plan is made on ids and sizes; texts
    are shuffled once, to be written by shard under path. Null and repeated ids are rows like others; no rows: no files.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    blocks = max(1, math.isqrt(docs.count()))
    block = F.pmod(F.xxhash64("doc_id", size), F.lit(blocks)).cast("int")
    order = ["__h", "doc_id", "__size"]
    keys = [old.cast("int").alias("__old"), block.alias("__block"), size.alias("__size"), F.xxhash64(F.lit(1), "doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("__h")]
    slim = materialize(docs.select("doc_id", *keys), "reshard-sizes")
    per = slim.groupBy("__old", "__block").agg(F.sum("__size").alias("__bytes"))
    by_old = Window.partitionBy("__old").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    per = materialize(per.withColumn("__from", F.coalesce(F.sum("__bytes").over(by_old), F.lit(0))).select("__old", "__block", "__bytes", "__from"), "reshard-blocks")
    sizes = dict(per.groupBy("__old").agg(F.sum("__bytes")).collect())  # n_old rows
    supply = [sizes.get(i, 0) for i in range(n_old)]
    total = sum(supply)
    flow = min_cost_flow(supply, [total * (j + 1) // n_new - total * j // n_new for j in range(n_new)])
    plan = cuts(flow)
    table = spark.createDataFrame(plan, "__o int, __start long, __end long, shard int")  # fewer than n_old + n_new rows
    same = untouched(plan, n_new) if slot is not None else []
    changed = ~F.col("__old").isin(same) if same else F.lit(True)
    within = Window.partitionBy("__old", "__block").orderBy(*order)
    at = slim.where(changed).join(per.drop("__bytes"), ["__old", "__block"]).withColumn("__n", F.row_number().over(within))
    at = at.withColumn("__at", F.col("__from") + F.sum("__size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.expr("(__size + 1) div 2"))  # a row's middle decides
    at = at.join(F.broadcast(table), (F.col("__old") == F.col("__o")) & (F.col("__at") >= F.col("__start")) & (F.col("__at") < F.col("__end")))
    pieces = at.groupBy("__old", "__block", "shard").agg(F.min("__n").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    by_shard = Window.partitionBy("shard").orderBy("__old", "__block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = materialize(pieces.withColumn("__slot", F.coalesce(F.sum("__rows").over(by_shard), F.lit(0))), "reshard-pieces")
    rows = docs.select(*kept, *keys).where(changed).withColumn("__n", F.row_number().over(within))
    rows = rows.join(pieces, ["__old", "__block"]).where("__n >= __first and __n < __first + __rows")
    path = path or scratch_path(spark, "shards")
    rows.select(*kept, (F.col("__n") - F.col("__first") + F.col("__slot")).cast("long").alias("slot"), "shard").write.partitionBy("shard").parquet(path)
    schema = docs.select(*kept, F.lit(0).cast("long").alias("slot"), F.lit(0).alias("shard")).schema
    files = spark.read.schema(schema).parquet(path)
    if same:
        left = docs.select(*kept, slot.cast("long").alias("__slot"), old.cast("int").alias("__old")).where(~changed)
        files = files.unionByName(left.withColumnsRenamed({"__slot": "slot", "__old": "shard"}))
    return files, plan
