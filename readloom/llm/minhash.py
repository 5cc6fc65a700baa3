"""Near-duplicate documents by ProbMinHash signatures of shingle sets, banding, and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch
from .components import connected_components
from .shingles import mix64, shingle_hashes

BANDS, ROWS = 32, 5
_STEP, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def prob_minhash(sets: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """Signatures (one row of m element hashes a set) that agree in a register with the sets' probability Jaccard similarity.

    sets: distinct 64-bit hashes and their weights. Each element is a Poisson process whose rate is its weight: its points
    arrive in order, each in a random register, and a register keeps the element of its first point. An element ends as
    soon as its next point is later than every register's. All sets of a call advance together, a point of each element a
    round. A set without elements has zeros.
    """
    owner = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    elements = np.concatenate([h for h, _ in sets] or [np.empty(0, np.uint64)])
    pace = 1.0 / np.concatenate([w for _, w in sets] or [np.empty(0)])
    first = np.full(len(sets) * m, np.inf)
    kept = np.zeros(len(sets) * m, np.uint64)
    time, n = np.zeros(len(elements)), 0
    while len(elements):
        n += 1
        z = mix64(elements + np.uint64(n * int(_STEP) % 2**64))
        time = time - np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) * pace
        at = owner * m + (mix64(z ^ _SALT) % np.uint64(m)).astype(np.int64)
        early = np.flatnonzero(time < first[at])
        early = early[np.argsort(-time[early], kind="stable")]
        first[at[early]] = time[early]  # the earliest is written last
        kept[at[early]] = elements[early]
        on = np.flatnonzero(time < first.reshape(-1, m).max(axis=1)[owner])
        elements, owner, pace, time = elements[on], owner[on], pace[on], time[on]
    return kept.reshape(-1, m)


def weighted(text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, each of weight 1, for links are between sets: registers agree with their Jaccard similarity."""
    h = np.unique(shingle_hashes(text, words))
    return h, np.ones(len(h))


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    keys = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        k = np.full(len(signatures), np.uint64((b + 1) * int(_STEP) % 2**64))
        for r in range(rows):
            k = mix64(k * np.uint64(31) + signatures[:, b * rows + r])
        keys[:, b] = k
    return keys


def bits128(signatures: np.ndarray) -> np.ndarray:
    """One bit of each of the first 128 registers, as two words: where sets agree in a share p of registers, so do (1 + p) / 2 of the bits."""
    bit = (mix64(signatures[:, :128]) >> np.uint64(17)) & np.uint64(1)
    return (bit.reshape(-1, 2, 64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def signed(docs: DataFrame, words: int, bands: int, rows: int, chunk: int = 1024) -> DataFrame:
    """doc_id, node (of the whole text), bands, bits and n, the number of distinct shingles, of every row."""
    schema = "doc_id string, node binary, bands array<long>, bits array<long>, n int"

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), chunk):
                part = batch.iloc[i : i + chunk]
                sets = [weighted(t, words) for t in part["text"]]
                s = prob_minhash(sets, bands * rows)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "node": part["node"].to_numpy(), "bands": list(band_keys(s, bands, rows).view(np.int64)), "bits": list(bits128(s).view(np.int64)), "n": [len(h) for h, _ in sets]})

    # the id travels as text: pandas would make floats of longs beside nulls
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "node")
    return slim.mapInPandas(sign, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def set_rows(texts: DataFrame, words: int, schema: str, held: int = 2_000_000) -> DataFrame:
    """schema's columns of the distinct shingles of texts (uid, text): "h long, n long" sums up, before any shuffle, how many of a task's texts
    have a shingle; "uid long, h long" has a row for each shingle of each text."""
    sums = schema.startswith("h")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, owners, size = [], [], 0

        def some() -> pd.DataFrame:
            h = np.concatenate(hashes)
            if not sums:
                return pd.DataFrame({"uid": np.concatenate(owners), "h": h.view(np.int64)})
            h, n = np.unique(h, return_counts=True)
            return pd.DataFrame({"h": h.view(np.int64), "n": n})

        for batch in batches:
            for uid, text in zip(batch["uid"], batch["text"], strict=True):
                hashes.append(np.unique(shingle_hashes(text, words)))
                owners.append(np.full(len(hashes[-1]), uid, np.int64))
                size += len(hashes[-1])
                if size >= held:
                    yield some()
                    hashes, owners, size = [], [], 0
        if size:
            yield some()

    return texts.select("uid", "text").mapInPandas(rows, schema)


def prefix_pairs(nodes: DataFrame, texts: DataFrame, words: int, least: float, small: int = 16) -> DataFrame:
    """Pairs p, q of nodes (uid, n, label and others) of different labels that may be at least `least` alike. A pair may come more than once.

    Two sets that alike share t = least / (1 + least) of their sizes' sum at least. A shingle that one node alone has is in no
    such share; the others are put in one order, rarest first. The first that a pair shares is then followed by t - 1
    more in either set, so only sets that meet in a shingle that comes so early can be a pair. A shingle that comes at a place which leaves too few behind it,
    for the smallest set that is met there, is left out: no pair has it as its first. That is repeated, since each row that goes may be another's last.

    Where at most `small` nodes meet in a shingle, they are paired: no more than `small` rows an early shingle, and no pair is lost. So are
    larger groups in which a node, as far as a few of its rows tell, lists fewer pairs than it would have long bands: most rows of a large class meet few of other labels. Pairs that meet in
    other groups only, as texts put together from a few passages do, come from long_pairs().
    """
    of = materialize(texts.join(nodes.select("uid"), "uid", "left_semi").select("uid", "text"), "open-texts")
    counts = set_rows(of, words, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")).where("c > 1")
    shared = set_rows(of, words, "uid long, h long").join(counts, "h").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("hs"))  # as many as a text has words
    early = nodes.join(shared, "uid").withColumn("most", F.size("hs")).withColumn("len", F.floor(F.col("most") - least * F.col("n") + 1 + 1e-6).cast("int")).where("len > 0")
    early = early.select(F.struct(*nodes.columns).alias("x"), "most", F.posexplode(F.slice("hs", F.lit(1), F.col("len"))).alias("at", "e")).select("x", "most", (F.col("most") - F.col("at")).alias("rest"), F.col("e.h").alias("h"))
    early = materialize(early, "early")
    for _ in range(2):
        groups = early.groupBy("h").agg(F.min("x.label").alias("lo"), F.max("x.label").alias("hi"), F.min("x.n").alias("low"), F.count(F.lit(1)).alias("g")).where("lo < hi")
        early = early.select("x", "most", "rest", "h").join(materialize(groups.select("h", "low", "g"), "meeting"), "h").where(F.col("rest") >= share(least, F.col("x.n"), F.col("low")))
        early = materialize(early, "meeting")
    p, q = (early.select(F.col("h").alias(f"h_{c}"), F.col("x").alias(c), F.col("rest").alias(f"rest_{c}"), F.col("most").alias(f"most_{c}"), F.col("low").alias(f"low_{c}"), F.col("g").alias(f"g_{c}")) for c in "pq")
    meet = (F.col("h_p") == F.col("h_q")) & (F.col("p.label") != F.col("q.label")) & (F.least("rest_p", "rest_q") >= share(least, F.col("p.n"), F.col("q.n")))
    some = p.where((F.col("g_p") > small) & (F.pmod(F.xxhash64("p.uid", "h_p"), F.col("g_p")) < 4))
    places = F.floor(F.col("most_p") - share(least, F.col("p.n"), F.col("low_p"))) + 1  # so many early shingles the node has about
    rows = some.groupBy("h_p", "g_p").agg(F.count(F.lit(1)).alias("rows"))
    lists = some.join(q.select("h_q", "q", "rest_q"), meet).groupBy("h_p").agg(F.sum(places).alias("lists"))
    joined = rows.join(lists, "h_p", "left").where(F.coalesce("lists", F.lit(0)) <= 16 * F.sqrt("g_p") * F.col("rows"))
    joined = materialize(joined.select(F.col("h_p").alias("h")), "joined")
    early = materialize(early.join(joined.withColumn("few", F.lit(True)), "h", "left").withColumn("few", F.coalesce("few", F.col("g") <= small)), "split")
    p, q = (early.where("few").select(F.col("h").alias(f"h_{c}"), F.col("x").alias(c), F.col("rest").alias(f"rest_{c}")) for c in "pq")
    pairs = p.join(q, meet & (F.col("p.uid") < F.col("q.uid")))
    crowd = materialize(early.where("not few").groupBy("x").agg(F.max("rest").alias("most")).select(F.struct("x.*", "most").alias("x")), "crowd")
    pairs = pairs.select("p", "q")
    if not crowd.head(1):
        return pairs
    return pairs.unionByName(long_pairs(crowd, of, words, least).select(*(F.struct(*(f"{c}.{k}" for k in nodes.columns)).alias(c) for c in "pq")))


def share(least: float, n: Column, m: Column) -> Column:
    """How many shingles sets of n and m share at least, if they are that alike."""
    return least / (1 + least) * (n + m) - 1e-6


def long_bands(n: int, least: float, most: int = 1400) -> tuple[int, int]:
    """(bands, rows) for n nodes. A pair that is `least` alike agrees in bands * least ** rows = 16 bands, as expected.

    One that is s alike is listed 16 * (s / least) ** rows times. The rows of a band grow with log n, so keys and listed
    pairs (at s = 0.64 and least = 0.8) both grow with about n ** 1.5, as long as a node has at most `most` keys; from there pairs alone grow.
    """
    rows = round(1.55 * math.log2(max(n, 2)))
    if least < 1:
        rows = min(rows, int(math.log(most / 16) / -math.log(least)))
    rows = max(rows, 1)
    return math.ceil(16 * least**-rows), rows


def long_pairs(crowd: DataFrame, texts: DataFrame, words: int, least: float, registers: int = 1024) -> DataFrame:
    """Pairs p, q of crowd's nodes (x: uid, n, most, label and others) of different labels that share a long band.

    New ProbMinHash signatures of `registers` registers; a band is a choice of long_bands() rows among them, the same for all. Pairs of a
    label are not listed: in each bucket labels meet first, then their members. A pair at exactly `least` is missed about
    once in 200,000 times, as registers themselves agree a little more or less often than expected.
    """
    bands, rows = long_bands(crowd.count(), least)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        choice = np.argsort(np.random.default_rng(bands).random((bands, registers)), axis=1)[:, :rows]
        for batch in batches:
            for i in range(0, len(batch), 128):
                part = batch.iloc[i : i + 128]
                s = prob_minhash([weighted(t, words) for t in part["text"]], registers)
                yield pd.DataFrame({"uid": part["uid"].to_numpy(), "keys": list(chosen_keys(s, choice).view(np.int64))})

    # an alike partner has no more shingles than reach, or their share would exceed what this node shares with anyone
    reach = (F.col("x.most") + 1e-6) * (1 + least) / least - F.col("x.n")
    of = crowd.select(F.col("x.uid").alias("uid"), F.col("x.label").alias("label"), F.col("x.n").alias("n"), reach.alias("reach"), "x")
    keys = texts.join(of.select("uid"), "uid", "left_semi").mapInPandas(sign, "uid long, keys array<long>").select("uid", F.explode("keys").alias("key"))
    keys = materialize(keys.join(of.drop("x"), "uid"), "long-bands")
    mixed = keys.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("low")).where("lo < hi").select("key", "low")
    keys = materialize(keys.join(materialize(mixed, "long-mixed"), "key").where("reach >= low").drop("low"), "long-buckets")
    labels = materialize(keys.groupBy("key", "label").agg(F.min("n").alias("n"), F.max("reach").alias("reach")), "long-labels")
    x, y = (labels.select("key", F.col("label").alias(c), F.col("n").alias(f"n_{c}"), F.col("reach").alias(f"reach_{c}")) for c in "ab")
    two = x.join(y.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("a") < F.col("b")) & (F.col("reach_a") >= F.col("n_b")) & (F.col("reach_b") >= F.col("n_a"))).select("key", "a", "b")
    met = two.join(keys.select("key", F.col("label").alias("a"), F.col("uid").alias("u")), ["key", "a"]).join(keys.select("key", F.col("label").alias("b"), F.col("uid").alias("v")), ["key", "b"])
    met = met.select("u", "v").distinct().join(of.select(F.col("uid").alias("u"), F.col("x").alias("p")), "u").join(of.select(F.col("uid").alias("v"), F.col("x").alias("q")), "v")
    return met.where(share(least, F.col("p.n"), F.col("q.n")) <= F.least("p.most", "q.most")).select("p", "q")


def chosen_keys(signatures: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; choice: the registers of each band, a row a band."""
    k = np.broadcast_to((np.arange(1, len(choice) + 1, dtype=np.uint64)) * _STEP, (len(signatures), len(choice)))
    for r in range(choice.shape[1]):
        k = mix64(k * np.uint64(31) + signatures[:, choice[:, r]])
    return k


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are at least that alike. texts: uid, text."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for p, q in zip(batch["p"], batch["q"], strict=True):
                if last[0] != p:
                    last = (p, np.unique(shingle_hashes(p, words)))
                x, y = last[1], np.unique(shingle_hashes(q, words))
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                keep.append(not either or both >= least * either - 1e-9)
            yield batch.loc[keep, ["a", "b"]]

    full = pairs.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("q")), "b").join(texts.select(F.col("uid").alias("a"), F.col("text").alias("p")), "a")
    return full.select("a", "b", "p", "q").mapInPandas(check, "a long, b long")


def classes(docs: DataFrame, *, words: int = 5, least: float = 0.8, bands: int = BANDS, rows: int = ROWS, rounds: int = 2) -> DataFrame:
    """doc_id, node (of the text) and class of every row; in a class each is tied to another by a similarity of at least `least`.

    docs: doc_id, text; other columns play no part. Similarity is the Jaccard similarity of lower-cased word shingles as
    sets. Equal texts are one node and are never paired. A node's ProbMinHash signature (weight 1 for every
    distinct shingle, so that it estimates the similarity that is verified) gives band keys; nodes that share a key are candidates, and whole texts decide. First each bucket's most connected node is
    held against the others, so that a group of near copies is settled by about as many comparisons as it has members.

    Of buckets that still hold several classes, what is outside the largest is held against one
    member of that class, another in each bucket, up to `rounds` times, as long as that links anything. What is left after that is held against members of other
    classes, with no cap, by prefix_pairs(): open nodes are joined on the rare shingles that an alike pair must share, and those that share common ones only by
    longer bands of longer signatures. Near the threshold no bound is known: n texts of common shingles that are all 0.75 alike are listed as n * n / 2 pairs.

    Pairs that 128 signature bits rule out are not compared (98 must agree; of pairs at 0.8, one in a million has fewer).
    At 0.8 a pair shares no band once in 300,000 times; the defaults trade that for cost.

    Null text: empty. Texts without words are one class; shorter ones than a shingle are alike if their words are equal.
    Null doc_id: in its class like others. Repeated rows: a row each. No rows: no rows.
    """
    with scratch(docs.sparkSession):
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        docs = docs.withColumn("node", F.unhex(F.md5(F.encode("text", "UTF-8"))))
        rows_ = materialize(signed(docs, words, bands, rows), "signatures")
        one = rows_.groupBy("node").agg(F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits"), F.any_value("n").alias("n"))
        one = materialize(one.withColumn("uid", F.monotonically_increasing_id()), "nodes")
        keys = one.select("uid", F.explode("bands").alias("key"))
        shared = materialize(keys.join(keys.groupBy("key").count().where("count > 1"), "key"), "shared")  # buckets of two nodes at least
        degree = shared.groupBy("uid").agg(F.sum("count").alias("degree"))
        known = materialize(one.select("uid", "node", "n", F.col("bits")[0].alias("s"), F.col("bits")[1].alias("t")).join(degree, "uid"), "known")
        buckets = materialize(shared.select("key", "uid").join(known.drop("node"), "uid"), "buckets")
        texts = docs.groupBy("node").agg(F.any_value("text").alias("text"))  # equal texts are one node: any copy's will do
        texts = materialize(texts.join(known.select("node", "uid"), "node").select("uid", "text"), "texts")
        agree = lambda x, y: F.bit_count(F.col(f"{x}.s").bitwiseXOR(F.col(f"{y}.s"))) + F.bit_count(F.col(f"{x}.t").bitwiseXOR(F.col(f"{y}.t"))) <= 30
        alike = lambda x, y: agree(x, y) & (F.least(f"{x}.n", f"{y}.n") >= least * F.greatest(f"{x}.n", f"{y}.n") - 1e-6)
        pair = (F.least("p.uid", "q.uid").alias("a"), F.greatest("p.uid", "q.uid").alias("b"))
        node = F.struct("uid", "s", "t", "n")

        pivots = materialize(buckets.groupBy("key").agg(F.max_by(node, F.struct("degree", "uid")).alias("p")), "pivots")
        tested = materialize(buckets.select("key", node.alias("q")).join(pivots, "key").where((F.col("p.uid") != F.col("q.uid")) & alike("p", "q")).select(*pair).distinct(), "pairs")
        links = materialize(verified(tested, texts, words, least), "links")
        label = connected_components(links)
        open_, turn = several(buckets.select("key", "uid", "s", "t", "n"), label), 0
        while open_.head(1):
            if turn < rounds:
                pivots = materialize(open_.where("label = main").groupBy("key").agg(F.max_by(node, F.xxhash64(F.lit(turn), "uid", "key")).alias("p")), "pivots")
                pairs = open_.where("label <> main").select("key", node.alias("q")).join(pivots, "key")
            else:
                pairs = prefix_pairs(materialize(open_.select("uid", "s", "t", "n", "label").distinct(), "open-nodes"), texts, words, least)
            pairs = materialize(pairs.where(alike("p", "q")).select(*pair).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
            late = materialize(verified(pairs, texts, words, least), "links") if pairs.head(1) else pairs
            found = bool(late.head(1))
            tested = tested.unionByName(pairs)
            if found:
                links = links.unionByName(late)
                label = connected_components(links)
            if turn >= rounds:
                break
            if found:
                open_ = several(open_.drop("label", "main"), label)
            turn = turn + 1 if found else rounds  # labels, and so what is open, are as before
        of = one.select("node", "uid").join(label.withColumnRenamed("node", "u"), F.col("uid") == F.col("u"), "left").select("node", F.coalesce("component", "uid").alias("class"))
        return materialize(rows_.select("doc_id", "node").join(of, "node"), "members", keep=True)


def several(open_: DataFrame, label: DataFrame) -> DataFrame:
    """Those rows of open_ (key, uid and others) whose key has several labels, with label and main, the label that most of the key's rows have. label: node and component; a node that isn't there is a label of its own."""
    named = open_.join(label, F.col("uid") == F.col("node"), "left").withColumn("label", F.coalesce("component", "uid")).drop("node", "component")
    named = materialize(named, "named")
    sizes = named.groupBy("key", "label").count()
    mixed = sizes.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("key", "main")
    return materialize(named.join(materialize(mixed, "mixed"), "key"), "open")  # mixed is written, so that Spark can split a large bucket in the join


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id and class_id of every row: the smallest doc_id of its class; a class of null ids alone has a null class_id. See classes()."""
    member = classes(docs, **options)
    low = materialize(member.groupBy("class").agg(F.min("doc_id").alias("class_id")), "class-ids")  # written, so that Spark can split a large class in the join
    return member.join(low, "class").select("doc_id", "class_id")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One row of docs, unchanged, for each class: that of the smallest doc_id, nulls last, then of the smallest text hash. See classes()."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("first")
    keep = classes(docs, **options).groupBy("class").agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.node").alias("__of"))
    key = (F.col("doc_id").cast("long").alias("__doc"), F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("__node"))
    rows = docs.groupBy(*key).agg(F.any_value(F.struct(*docs.columns)).alias("__row"))  # rows that repeat are one before they are shuffled
    return rows.join(keep, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__node") == F.col("__of"))).select("__row.*")
