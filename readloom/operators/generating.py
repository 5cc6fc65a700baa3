"""Simulated reads from genomes: plan, lengths, places, strands and qualities as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import sequences as S
from readloom.functions.rng import fast_uniform
from readloom.operators.planning import cascaded


def draws(keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Standard normal draws, lengths[k] of them for keys[k], one after the other: a counter-based hash of key and base (splitmix64), then Box-Muller."""
    first = np.cumsum(lengths) - lengths
    base = np.arange(lengths.sum(), dtype=np.uint64) - np.repeat(first, lengths).astype(np.uint64)
    z = np.repeat(keys, lengths) + (base + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    u1, u2 = (z >> np.uint64(32)) / 2.0**32, (z & np.uint64(0xFFFFFFFF)) / 2.0**32
    return np.sqrt(-2 * np.log1p(-u1)) * np.cos(2 * np.pi * u2)


def with_qualities(reads: DataFrame, key: str, mean: float, std: float, held: int = 1_000_000) -> DataFrame:
    """reads (seq and any others) with qual in place of key, a long that decides the draws: per base a normal draw, cut to
    the Phred range and truncated. About held bases, or one read, are in a task's memory at a time."""
    fields = [f for f in reads.schema.fields if f.name != key]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", qual string"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.utf8_length(batch.column("seq")).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column(key).to_numpy(zero_copy_only=False).view(np.uint64)
            part = np.cumsum(lengths) // held
            at = 0
            while at < len(lengths):
                end = max(at + 1, int(np.searchsorted(part, part[at], side="right")))
                q = np.clip(mean + std * draws(keys[at:end], lengths[at:end]), S.PHRED_LEAST, S.PHRED_MOST).astype(np.uint8) + np.uint8(S.PHRED_OFFSET)
                stops = np.concatenate([[0], np.cumsum(lengths[at:end])]).astype(np.int32)
                qual = pa.StringArray.from_buffers(end - at, pa.py_buffer(stops), pa.py_buffer(q))
                rows = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in fields), qual], [*(f.name for f in fields), "qual"])
                at = end

    return reads.mapInArrow(add, schema)


def generate(genomes: DataFrame, *, per_file: int, mean_length: float = 5000, std_length: float = 2000, min_length: int = 200, mean_quality: float = 20.0, std_quality: float = 4.0, seed: int = 0) -> DataFrame:
    """genome, file_index, read_no, header, seq, sep, qual: n reads of each genome, numbered from 0 in each file.

    genomes: genome, seq (its contigs joined), n. Every draw is a hash of seed, genome, file, read and base, so the reads
    don't depend on partitioning; qualities are drawn for a batch of reads at a time. The plan (genome, file) is spread before it is exploded to reads, and the sequence is
    joined to it, so that one large request is many tasks; where the genomes are small Spark broadcasts them. An empty
    genome gives no reads.
    """
    plan = cascaded(genomes.where(F.length("seq") > 0).select("genome", "n"), "n", per_file)
    plan = plan.repartition("genome", "file_index").where("read_count > 0")
    reads = plan.withColumn("read_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("read_count") - 1)))
    reads = reads.join(genomes.select("genome", F.col("seq").alias("whole"), F.length("seq").cast("bigint").alias("size")), "genome")
    key = (F.col("genome"), F.col("file_index"), F.col("read_no"))
    u = lambda kind: fast_uniform(seed, F.lit(kind), *key)
    reads = reads.withColumn("len", S.read_length(u("len1"), u("len2"), mean_length, std_length, min_length, F.col("size")))
    reads = reads.withColumn("start", S.start_of(u("start"), F.col("size"), F.col("len"))).withColumn("flip", u("strand") < 0.5)
    piece = S.piece(F.col("whole"), F.col("start"), F.col("len"))
    reads = reads.select(
        "genome", "file_index", "read_no",
        F.concat(F.lit("@"), F.col("genome"), F.lit("_read_"), F.col("read_no").cast("string")).alias("header"),
        F.when(F.col("flip"), S.reverse_complement(piece)).otherwise(piece).alias("seq"),
        F.lit("+").alias("sep"),
        F.xxhash64(F.lit(seed), F.lit("q"), *key).alias("__key"),
    )
    if std_quality == 0:
        return reads.withColumn("qual", S.constant_quality(F.length("seq"), mean_quality)).drop("__key")
    return with_qualities(reads, "__key", mean_quality, std_quality)


#: Makers of reads by name: (available, maker). A plug-in adds itself here.
BACKENDS = {"builtin": (lambda: True, generate)}


def backend(name: str = "auto"):
    """The maker of that name; auto: the first plug-in that is available, else the builtin one. Raises ValueError for an unknown or missing one."""
    if name == "auto":
        return next(make for key, (there, make) in sorted(BACKENDS.items(), key=lambda b: b[0] == "builtin") if there())
    if name not in BACKENDS or not BACKENDS[name][0]():
        raise ValueError(f"no generator named {name!r} is available: {', '.join(k for k, (there, _) in BACKENDS.items() if there())}")
    return BACKENDS[name][1]
