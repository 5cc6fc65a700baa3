"""Bottom-k sketches of word shingles: mergeable fingerprints for resemblance, containment and distinct counts."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, uniform
from .shingles import shingle_hashes

SPAN = float(2**64)


def sketch(text: str, k: int = 256, words: int = 5) -> np.ndarray:
    """The k smallest distinct shingle hashes, ascending; fewer than k are all of them."""
    return np.unique(shingle_hashes(text, words))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = 256) -> np.ndarray:
    """The sketch of two parts' union, from the parts' sketches."""
    return np.unique(np.concatenate([a, b]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = 256) -> float:
    """Estimate of the Jaccard similarity, exact for sketches of fewer than k; two empty sketches are alike, one empty is unlike."""
    both = np.sort(np.concatenate([a, b]))
    same = both[1:] == both[:-1]
    union = np.concatenate([both[:1], both[1:][~same]])[:k]
    return float((both[1:][same] <= union[-1]).sum() / len(union)) if len(union) else 1.0


def distinct(a: np.ndarray, k: int = 256) -> float:
    """Estimate of the number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * SPAN / (float(a[k - 1]) + 1.0)


def containment(a: np.ndarray, b: np.ndarray, k: int = 256) -> float:
    """Estimate of the share of a's distinct shingles that b has too."""
    n = distinct(a, k)
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / n) if n else 1.0


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8")


def merge_groups(prints: DataFrame, key: str, k: int = 256) -> DataFrame:
    """(key, hashes): the k smallest distinct hashes of each group's array column hashes. Groups of any size: what a task
    has read is dealt over some parts of a group, each keeps k, and k of a part at most meet."""
    part = Window.partitionBy(key, "part").orderBy("h")
    one = prints.select(key, F.explode("hashes").alias("h")).distinct().withColumn("part", F.pmod("h", F.lit(64)))
    low = one.withColumn("n", F.row_number().over(part)).where(F.col("n") <= k).drop("n", "part")
    low = low.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("n") <= k)
    return low.groupBy(key).agg(F.array_sort(F.collect_list("h")).alias("hashes"))


def with_next(docs: DataFrame, step, schema: str, parts: int) -> DataFrame:
    """step(doc_id, text, next document's text) for each row, where next is by descending doc_id and the first follows the last.

    Rows are dealt into ranges of doc_id, with one more row for each range: the first of the next one. One shuffle of the
    texts; a task streams through its sorted ranges and holds two texts at a time. Null ids come last. Rows of one id, and
    those without, come by a hash of their text and then by text; as many of them as several ranges hold are split by that hash.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("u", uniform(F.col("text")))
    n = d.agg(F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("ids")).first()
    none = -(-(n["rows"] - n["ids"]) * parts // max(1, n["rows"]))  # ranges of rows without an id
    some = max(1, parts - none)
    at = [int(x) for x in d.where("doc_id is not null").approxQuantile("doc_id", [i / some for i in range(1, some)], 0.25 / some)] if some > 1 else []
    edges = sorted(Counter(at).items())  # a frequent id is the edge of several ranges
    base = F.lit(none).cast("int")
    if edges:
        ids, last = F.array(*[F.lit(x) for x, _ in edges]), F.array(*[F.lit(sum(c for _, c in edges[: i + 1])) for i in range(len(edges))])
        width = F.array(*[F.lit(c) for _, c in edges])
        low = F.aggregate(
            F.sequence(F.lit(1), F.lit(len(edges).bit_length() + 1)), F.struct(F.lit(0).alias("lo"), F.lit(len(edges)).alias("hi")),
            lambda s, _: F.transform(F.array(((s["lo"] + s["hi"]) / 2).cast("int")), lambda m: F.when(s["lo"] >= s["hi"], s).when(F.get(ids, m) <= F.col("doc_id"), F.struct((m + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi"))))[0],
            lambda s: s["lo"],
        )  # how many edges are not above the id
        d = d.withColumn("edge", low - 1)
        own = F.when(F.get(ids, F.col("edge")) == F.col("doc_id"), F.floor((1 - F.col("u")) * F.get(width, F.col("edge"))).cast("int")).otherwise(F.lit(0))
        base = base + F.coalesce(F.get(last, F.col("edge")) - own, F.lit(0))
    d = d.withColumn("part", F.when(F.col("doc_id").isNotNull(), base).otherwise(F.floor(F.col("u") * none).cast("int")))
    heads = d.groupBy("part").agg(F.max(F.struct("doc_id", "u")).alias("head"))  # one row a range
    order = Window.orderBy("part")
    heads = heads.withColumn("to", F.coalesce(F.lead("part").over(order), F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = materialize(heads.select(F.col("part").alias("of"), "head", "to"), "heads")
    extra = d.join(F.broadcast(heads), (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("u") == F.col("head.u")))
    extra = extra.groupBy("to", "doc_id", "u").agg(F.min("text").alias("text")).select("doc_id", "text", "u", F.col("to").alias("part"), F.lit(1).alias("extra"))
    rows = d.select("doc_id", "text", "u", "part", F.lit(0).alias("extra")).unionByName(extra)
    rows = rows.repartitionById(parts, "part").sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), F.desc("u"), "text")
    # ids as text: pandas would make floats of longs beside nulls
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "part", "extra")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            for doc, text, part, more in zip(batch["doc_id"], batch["text"], batch["part"], batch["extra"], strict=True):
                if held is not None and held[2] == part:
                    out.append(step(held[0], held[1], text))
                held = None if more else (doc, text, part)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInPandas(stream, schema)


def fingerprint_edits(docs: DataFrame, k: int = 256, words: int = 5, parts: int | None = None) -> DataFrame:
    """Fingerprints of whole texts and of edited ones: the last half of a text replaced by as much of the next document's start.

    docs: doc_id, text; other columns play no part. Null text: empty, whose sketch is empty. A text of fewer than words
    words is one shingle. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_shingles and contained (estimates of the distinct shingles and of their share in the edited text). No rows: no rows.
    """
    kept: dict[str, tuple[str, np.ndarray]] = {}

    def known(text: str) -> np.ndarray:
        """A text's sketch; the last one asked for as next is asked for again as the text itself."""
        if kept.get("next", ("\0", None))[0] != text:
            return sketch(text, k, words)
        return kept["next"][1]

    def step(doc: str | None, text: str, after: str) -> tuple:
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        own, new = known(text), sketch(edited, k, words)
        kept["next"] = (after, sketch(after, k, words))
        return (doc, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own), to_text(new), resemblance(own, new, k), resemblance(own, kept["next"][1], k), distinct(own, k), containment(own, new, k))

    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, contained double"
    return with_next(docs, step, schema, parts).withColumn("doc_id", F.col("doc_id").cast("long"))
