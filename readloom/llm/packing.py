"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import base64
import bisect
import random
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Tokens:
    """Ids of whole texts as little-endian 32-bit bytes, by the ranks of a byte-level BPE.

    The spelling of a special token is that token wherever it occurs, as in the `tokenizers` file; what stands around it is encoded by itself.
    Every chunk of text that starts at a single blank is encoded once and kept: the pattern starts a new token there, if
    no other white space touches that blank. A text where some does is encoded whole. The store is bounded.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int] | None = None, most: int = 300_000):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.double, self.seen, self.most = re.compile(r"\s\s"), {}, most
        self.special = {k: np.array([i], "<u4").tobytes() for k, i in (special or {}).items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if special else None

    def whole(self, text: str) -> bytes:
        return np.array(self.encoder.encode_ordinary(text), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.marks and any(k in text for k in self.special):
            return b"".join(self.special.get(x) or self.ordinary(x) for x in self.marks.split(text))
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if " " not in text or text[-1].isspace() or any(" " in m for m in self.double.findall(text)):
            return self.whole(text)
        first, *rest = text.split(" ")
        seen, out = self.seen, [self.whole(first)]
        for chunk in rest:
            ids = seen.get(chunk)
            if ids is None:
                ids = self.whole(" " + chunk)
                if len(seen) >= self.most:
                    seen.clear()
                seen[chunk] = ids
            out.append(ids)
        return b"".join(out)


def pieces(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int] | None, capacity: int, end_id: int = 0) -> DataFrame:
    """PIECE's columns: each document's ids and end_id, cut into pieces of capacity if there are more, the first one the rest."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, end = Tokens(ranks_path, pattern, special), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = tokens.ids(text or "") + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    # the id travels as text: pandas would make floats of longs beside nulls
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    cutted = slim.mapInPandas(cut, PIECE.replace("doc_id long", "doc_id string"))
    return cutted.select(F.col("doc_id").cast("long").alias("doc_id"), "piece", "start", "length", "ids_crc32")


def best_fit(order, sizes: list[int], bins: list[list[int]], fill: list[int], capacity: int) -> None:
    """Put the items of order, one by one, into the fullest of bins that has room, else into a new one."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, x in enumerate(fill):
        if x < capacity:
            by_room.setdefault(capacity - x, []).append(b)
            mask |= 1 << (capacity - x)
    for i in order:
        s = sizes[i]
        open_ = mask >> s
        if open_:
            room = s + (open_ & -open_).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
            fill.append(0)
        bins[b].append(i)
        fill[b] += s
        if room > s:
            by_room.setdefault(room - s, []).append(b)
            mask |= 1 << (room - s)


def fitness(fill: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then Falkenauer's measure, which favours full bins beside empty ones."""
    return -len(fill), sum((x / capacity) ** 2 for x in fill) / max(1, len(fill))


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random, full: float) -> list[list[int]]:
    """A child of a: a part of b's well-filled bins goes in whole, a's bins that share a document with them are undone, and the displaced ones are exchanged for smaller ones of bins with room, then best-fitted, largest first."""
    good = [x for x in b if sum(sizes[i] for i in x) >= full * capacity]
    given = [x for x in good if rng.random() < 0.5]
    there = {i for x in given for i in x}
    bins, loose = [list(x) for x in given], []
    for x in a:
        rest = [i for i in x if i not in there]
        if len(rest) == len(x) and sum(sizes[i] for i in x) >= 0.9 * capacity:
            bins.append(list(x))
        else:
            loose += rest
    fill = [sum(sizes[i] for i in x) for x in bins]
    loose = exchanged(loose, sizes, bins, fill, capacity)
    best_fit(loose, sizes, bins, fill, capacity)
    return bins


def exchanged(loose: list[int], sizes: list[int], bins: list[list[int]], fill: list[int], capacity: int) -> list[int]:
    """What is loose, largest first, after each bin has given up documents for larger loose ones that fill it better, the fullest fit first."""
    loose = sorted(loose, key=lambda i: sizes[i])
    at = [sizes[i] for i in loose]
    for b, x in enumerate(bins):
        room, k = capacity - fill[b], 0
        while room and loose and k < len(x):
            n = bisect.bisect_right(at, sizes[x[k]] + room) - 1
            if n >= 0 and at[n] > sizes[x[k]]:
                out, x[k], more = x[k], loose.pop(n), at.pop(n)
                room, fill[b] = room - more + sizes[out], fill[b] + more - sizes[out]
                n = bisect.bisect_right(at, sizes[out])
                loose.insert(n, out)
                at.insert(n, sizes[out])
            k += 1
    return loose[::-1]


def evolve(sizes: list[int], start: list[list[list[int]]], capacity: int, seed: int, population: int, children: int, full: float = 0.98) -> list[list[list[int]]]:
    """The two best groupings after some children; start: groupings that come from elsewhere."""
    rng, found = random.Random(seed), [*start]
    while len(found) < population:
        bins: list[list[int]] = []
        noise = 0.0 if not found else 0.3
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * rng.random()))
        best_fit(order, sizes, bins, [], capacity)
        found.append(bins)
    score = lambda g: fitness([sum(sizes[i] for i in x) for x in g], capacity)
    held = sorted(((score(g), n, g) for n, g in enumerate(found)), key=lambda x: (x[0], -x[1]), reverse=True)
    least = -(-sum(sizes) // capacity)
    for n in range(children):
        if -held[0][0][0] <= least:
            break
        a, b = rng.choice(held[: max(2, len(held) // 2)])[2], rng.choice(held)[2]
        child = crossover(a, b, sizes, capacity, rng, full)
        held = sorted([*held[: population - 1], (score(child), population + n, child)], key=lambda x: (x[0], -x[1]), reverse=True)
    return [g for _, _, g in held[:2]]


def islands(items: DataFrame, capacity: int, n_islands: int, population: int, children: int, epochs: int, seed: int) -> DataFrame:
    """(block, uid, bin, length) of the best grouping of each block of items (block, uid, length).

    Each block lives on n_islands islands, a task's group each. After an epoch an island's two best groupings stay, and its
    best migrates to the next island.
    """
    schema = "block long, island int, uid long, length int, a int, b int"

    def live(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        own = rows[rows["kind"] == 0].sort_values("uid")
        uids, sizes = own["uid"].to_numpy(), own["length"].tolist()
        start = []
        for part, names in ((own, ("a", "b")), (rows[rows["kind"] == 1].sort_values("uid"), ("a",))):
            for name in names:
                if len(part) and part[name].iloc[0] >= 0:
                    bins: list[list[int]] = [[] for _ in range(int(part[name].max()) + 1)]
                    for i, x in enumerate(part[name].tolist()):
                        bins[x].append(i)
                    start.append(bins)
        epoch = int(rows["epoch"].iloc[0])
        two = evolve(sizes, start, capacity, hash((seed, block, island, epoch)), population, children)
        out = {"block": block, "island": island, "uid": uids, "length": sizes}
        for name, g in zip("ab", (two[0], two[-1]), strict=True):
            at = np.empty(len(sizes), np.int32)
            for n, x in enumerate(g):
                at[x] = n
            out[name] = at
        return pd.DataFrame(out)

    now = items.select("block", "uid", "length", F.explode(F.sequence(F.lit(0), F.lit(n_islands - 1))).alias("island"), F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("kind"))
    for epoch in range(epochs):
        lived = now.withColumn("epoch", F.lit(epoch)).groupBy("block", "island").applyInPandas(live, schema)
        if epoch + 1 < epochs:
            lived = materialize(lived, "islands")
            move = lived.withColumn("island", F.pmod(F.col("island") + 1, F.lit(n_islands))).withColumn("kind", F.lit(1))
            now = lived.withColumn("kind", F.lit(0)).unionByName(move)
    lived = materialize(lived, "islands")
    bins = lived.groupBy("block", "island", "a").agg(F.sum("length").alias("fill"))
    score = bins.groupBy("block", "island").agg((-F.count(F.lit(1)).cast("double") + F.sum(F.pow(F.col("fill") / capacity, F.lit(2.0))) / F.count(F.lit(1)) / 2).alias("score"))
    best = score.groupBy("block").agg(F.max(F.struct("score", -F.col("island"))).alias("m")).select("block", (-F.col("m")["col2"]).alias("island"))
    return lived.join(best, ["block", "island"]).select("block", "uid", F.col("a").alias("bin"), "length")


def pack(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int] | None = None, *, capacity: int = 2048, end_id: int = 0, block_items: int = 2048, n_islands: int = 2, population: int = 6, children: int = 16, epochs: int = 2, full: float = 0.995, levels: int = 8, seed: int = 5) -> DataFrame:
    """PIECE's columns, sequence_id and offset: all documents in as few sequences of at most capacity tokens as the search finds.

    docs: doc_id, text; other columns play no part. A piece of capacity tokens is a sequence of its own. The others are
    dealt into blocks of about block_items by a hash, however many there are, and each block is solved by a grouping
    genetic algorithm on islands (its first grouping is best fit decreasing). Sequences filled to the part full are done;
    the documents of the others meet in new blocks, level by level, until they fit one block or no longer get fewer.
    Texts stay in the tasks that read them; only lengths are shuffled.

    special: spellings of tokens that are their ids wherever they occur. Null text: empty, that is end_id alone. Null or repeated ids: each row is packed by itself. No rows: no rows.
    """
    cut = pieces(docs, ranks_path, pattern, special, capacity, end_id).withColumn("uid", F.monotonically_increasing_id())
    cut = materialize(cut, "pieces")
    placed = [cut.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    open_ = cut.where(F.col("length") < capacity).select("uid", F.col("length").cast("int").alias("length"), F.xxhash64("doc_id", "piece", "ids_crc32", "uid").alias("h"))
    count = open_.count()
    for level in range(levels):
        if not count:
            break
        blocks = max(1, -(-count // block_items))
        items = open_.select("uid", "length", "h", F.pmod(F.xxhash64("h", F.lit(level)), F.lit(blocks)).alias("block"))
        got = materialize(islands(items, capacity, n_islands, population, children, epochs, seed + level), "packed")
        fills = got.groupBy("block", "bin").agg(F.sum("length").alias("fill"), F.count(F.lit(1)).alias("n"))
        late = fills.where(F.col("fill") < full * capacity)
        after = late.agg(F.sum("n")).first()[0] or 0
        last = blocks == 1 or level + 1 == levels or after > 0.9 * count
        done = got if last else got.join(late, ["block", "bin"], "left_anti")
        seq = F.lit(level).cast("long") * (1 << 56) + F.col("block") * (1 << 20) + F.col("bin")
        # a sequence holds at most capacity items
        listed = done.groupBy("block", "bin").agg(F.array_sort(F.collect_list(F.struct("uid", "length"))).alias("items")).select(seq.alias("sequence_id"), "items")
        offsets = F.expr("transform(items, (x, i) -> named_struct('uid', x.uid, 'offset', aggregate(slice(items, 1, i), 0L, (s, y) -> s + y.length)))")
        placed.append(listed.select("sequence_id", F.explode(offsets).alias("p")).select("p.uid", "sequence_id", "p.offset"))
        if last:
            break
        open_ = materialize(open_.join(got.join(late.select("block", "bin"), ["block", "bin"]).select("uid"), "uid"), "late")
        count = after
    return cut.join(reduce(DataFrame.unionByName, placed), "uid").drop("uid")
