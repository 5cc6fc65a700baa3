"""How far the sources of a language are apart: every kept term of every source and language as an integer share, compared exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, slices

#: What stands between terms, which are runs of ASCII letters and of what isn't ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
BILLION = 10**9
#: A dense block of a chunk has at most so many cells, of eight bytes, but one term at least.
CELLS = 1 << 19


def term_counts(docs: DataFrame, chars: int = 1 << 22) -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents): the terms of about chars characters become ids, which are counted by document, then by group, before anything is shuffled."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in slices(whole.column("text"), chars)):
            pa.default_memory_pool().release_unused()
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            split = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), BETWEEN)
            doc, words = pc.list_parent_indices(split).to_numpy().astype(np.int64), pc.list_flatten(split).dictionary_encode()
            v, w = len(words.dictionary), len(source.dictionary)
            places, n = np.unique(doc * v + words.indices.to_numpy(), return_counts=True)  # a document's term
            group = lang.indices.to_numpy().astype(np.int64) * w + source.indices.to_numpy()
            key, at = np.unique(group[places // v] * v + places % v, return_inverse=True) if v else (places, places)
            k, term = key // v if v else key, pa.array(key % v if v else key)
            columns = lang.dictionary.take(pa.array(k // max(w, 1))), source.dictionary.take(pa.array(k % max(w, 1))), words.dictionary.take(term), pa.array(np.bincount(at, weights=n).astype(np.int64)), pa.array(np.bincount(at).astype(np.int64))
            out = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            yield out.filter(pc.not_equal(out["term"], ""))  # what stands before a text's first term and behind its last

    rows = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, df long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


CHUNK = pa.schema([("lang", pa.string()), ("terms", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("source_ids", pa.list_(pa.int32())), ("term_ids", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
CHUNK_DDL = "lang string, terms array<string>, sources array<string>, totals array<long>, source_ids array<int>, term_ids array<int>, n array<long>"


def ids(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different words, in UTF-8 and so in its order, and the place of each word among them."""
    known = np.unique(words)
    return known, np.searchsorted(known, words).astype(np.int32)


def encoded(counts: DataFrame, least: int, width: int) -> DataFrame:
    """CHUNK's columns: the dictionary of kept terms in pieces of at most width sorted terms of a language, and the counts of those terms by ids.

    Ranges of (lang, term) hold all rows of a term, so its documents add up there and a term with fewer than least is left out. What
    is kept is streamed in order; a task holds a batch and one term's sources.
    """
    ranged = counts.repartitionByRange(F.col("lang"), F.col("term")).withColumn("all", F.sum("df").over(Window.partitionBy("lang", "term")))
    kept = ranged.where(F.col("all") >= least).select("lang", "term", "source", "n").sortWithinPartitions("lang", "term")
    kept = kept.select("lang", *[F.col(c).cast("binary").alias(c) for c in ("term", "source")], "n")

    def pieces(lang: str, terms: np.ndarray, sources: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        known, term_ids = ids(terms)
        for a in range(0, len(known), width):
            i, j = np.searchsorted(term_ids, [a, a + width])
            names, source_ids = ids(sources[i:j])
            totals = np.bincount(source_ids, weights=n[i:j]).astype(np.int64)  # whole numbers below 2**53 are exact in doubles
            columns = lang, known[a : a + width], names, totals, source_ids, term_ids[i:j] - np.int32(a), n[i:j]
            yield pa.RecordBatch.from_arrays([pa.array([x if k else lang], pa.list_(pa.binary()) if k in (1, 2) else f.type).cast(f.type) for k, (x, f) in enumerate(zip(columns, CHUNK, strict=True))], schema=CHUNK)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # rows of the last term, which the next batch may go on with
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)] if held else rows
            lang, term = rows[0], rows[1]
            edges = np.flatnonzero(lang[1:] != lang[:-1]) + 1
            starts = np.flatnonzero((lang[1:] != lang[:-1]) | (term[1:] != term[:-1])) + 1
            whole = int(starts[-1]) if len(starts) else 0
            for a, b in zip([0, *edges], [*edges, whole], strict=True):
                if a < b:
                    yield from pieces(lang[a], *[x[a:b] for x in rows[1:]])
            held = [x[whole:] for x in rows]
        if held and len(held[0]):
            yield from pieces(held[0][0], *held[1:])

    return kept.mapInArrow(stream, CHUNK_DDL)


def shares(counts: np.ndarray, total: int, v: int) -> np.ndarray:
    """1 + floor(10**9 * (counts + 1) / (total + v)), exactly: three digits at a time, so that no product passes 64 bits below 9 * 10**15 occurrences."""
    rest, out, by = counts + 1, np.zeros_like(counts), total + v
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // by
        rest = rest % by
    return out + 1


def compare(piece: pd.DataFrame, groups: pd.DataFrame, v: int, top: int) -> pd.DataFrame:
    """part, source, item, value of one piece: sums over its terms for each two sources, and each source's top terms in it.

    groups: source, total, sorted in the order of UTF-8. piece: no row or one of CHUNK.
    """
    names = groups["source"].to_numpy(dtype=object)
    total = groups["total"].to_numpy(np.int64)
    all_ = int(total.sum())
    s = len(names)
    sums = np.zeros((s, s), np.int64)
    out: list[pd.DataFrame] = []
    best: list[list[tuple[int, int]]] = [[] for _ in range(s)]  # (-value, term id): ids are in the order of ties
    terms = piece["terms"].iloc[0] if len(piece) else []
    if len(terms):
        row = piece.iloc[0]
        utf8 = lambda x: np.array([w.encode() for w in x], dtype=object)
        group = np.searchsorted(utf8(names), utf8(row["sources"]))[row["source_ids"]]
        term, n = np.asarray(row["term_ids"]), np.asarray(row["n"])
        step = max(1, CELLS // s)
        for a in range(0, len(terms), step):
            b = min(a + step, len(terms))
            inside = (term >= a) & (term < b)
            dense = np.bincount(group[inside] * (b - a) + term[inside] - a, weights=n[inside], minlength=s * (b - a)).astype(np.int64).reshape(s, b - a)
            q = shares(dense.sum(0), all_, v)
            p = np.stack([shares(dense[i], int(total[i]), v) for i in range(s)])
            for i in range(s):
                away = p[i] - p
                sums[i] += (away * away // p).sum(1)
                f = np.where((dense[i] > 0) & (p[i] > q), (p[i] - q) ** 2 // q, -1)
                at = np.flatnonzero(f >= 0)
                at = at[np.argsort(-f[at], kind="stable")[:top]]
                best[i] = sorted(best[i] + list(zip((-f[at]).tolist(), (at + a).tolist(), strict=True)))[:top]
    here, there = np.divmod(np.arange(s * s), s)
    apart = here != there
    out.append(pd.DataFrame({"part": "pair", "source": names[here[apart]], "item": names[there[apart]], "value": sums.ravel()[apart]}))
    for i in range(s):
        out.append(pd.DataFrame({"part": "term", "source": names[i], "item": [terms[t] for _, t in best[i]], "value": [-x for x, _ in best[i]]}))
    return pd.concat(out, ignore_index=True)


def audit(docs: DataFrame, least: int = 3, top: int = 200, width: int = 4096) -> DataFrame:
    """lang, source, part, item, value, rank: each source against each other one of its language (part pair), and the terms it has more of than its language (part term, top of each source).

    docs: lang, source, text; other columns play no part, whatever their names. Null: empty, so that rows without a language or source are
    a group like others. Rows are documents, so repeated ones count. A term is kept in a language where least documents have it. A source without
    terms is compared like others; a language whose terms are all left out has values of 0 in part pair, and no part term. No rows: no rows.

    Counts are summed up by batch, by task and then by key; a dictionary piece of a hot language is a task's work of its own; what pieces give is summed
    up again. The result has a row for each two sources of a language, so a task may hold a row for each two of them as well.
    """
    spark = docs.sparkSession
    d = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    with scratch(spark):
        counts = materialize(term_counts(d), "term-counts")
        pieces = materialize(encoded(counts, least, width).withColumn("piece", F.element_at("terms", 1)), "term-pieces")
        found = pieces.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("total"))
        v = pieces.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
        groups = d.select("lang", "source").distinct().join(found, ["lang", "source"], "left").join(v, "lang", "left")
        groups = materialize(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")), "term-groups")
        # a piece meets the groups of its language; that without terms, one a language, gives every pair its 0
        work = pieces.select("lang", "piece").unionByName(groups.select("lang", F.lit("").alias("piece")).distinct()).join(groups, "lang")
        work = work.select(F.col("lang").alias("of_lang"), F.col("piece").alias("of_piece"), "source", "total", "v")

        def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            right = right.iloc[np.argsort(np.array([x.encode() for x in right["source"]], dtype=object))]
            return compare(left, right, int(right["v"].iloc[0]), top).assign(lang=key[0])

        parts = pieces.groupBy("lang", "piece").cogroup(work.groupBy("of_lang", "of_piece")).applyInPandas(run, "lang string, part string, source string, item string, value long")
        parts = materialize(parts, "divergence-parts")
        pair = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        term = parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)  # a term is in one piece; a task keeps the top of what it reads
        out = pair.withColumn("rank", rank).unionByName(term)
        return materialize(out.select("lang", "source", "part", "item", "value", "rank"), "divergence", keep=True)
