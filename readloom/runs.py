"""Whole runs: a configuration becomes a plan, files and a report."""

from __future__ import annotations

import os
import re
import shutil
import signal
import threading
import uuid
import warnings
import zlib
from collections.abc import Callable, Iterator
from contextlib import closing, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import model
from readloom.functions import naming
from readloom.functions.naming import bytes_text
from readloom.operators import generating
from readloom.operators import planning as P
from readloom.sources import fastq, ranges, sinks
from readloom.streaming.delivery import paced


@contextmanager
def interruptible() -> Iterator[None]:
    """SIGTERM and SIGHUP end what runs inside as an interrupt does, so that its own files are removed; the former handlers come back. In a thread that isn't the main one signals stay as they are."""
    def stop(number, frame):
        raise KeyboardInterrupt(signal.Signals(number).name)

    before = {}
    if threading.current_thread() is threading.main_thread():
        before = {s: signal.signal(s, stop) for s in (signal.SIGTERM, signal.SIGHUP)}
    try:
        yield
    finally:
        for s, handler in before.items():
            signal.signal(s, handler if handler is not None else signal.SIG_DFL)


def within(spark: SparkSession, seconds: float, work: Callable[[], object]) -> object:
    """work's result; its Spark jobs are ended, and TimeoutError raised, once it takes longer than seconds. What it raises comes through."""
    tag = f"readloom-{uuid.uuid4().hex}"
    late = threading.Event()

    def end() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, end)
    timer.daemon = True
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return work()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"a batch took more than {seconds:g} seconds") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def warn_of_capacity(folder: str, estimated: int) -> None:
    """Warn where a run may need more than four fifths of what is free; an estimate only, nothing is stopped."""
    while not os.path.isdir(folder) and os.path.dirname(folder) != folder:
        folder = os.path.dirname(folder)
    free = shutil.disk_usage(folder).free
    if estimated > 0.8 * free:
        warnings.warn(f"the run may write {bytes_text(estimated)}, and {bytes_text(free)} are free", stacklevel=3)


class EmptySource(Exception):
    """There is nothing to deliver."""


def sources(c: model.ReplayConfig) -> list[tuple[str | None, str]]:
    """(barcode, path) of the files to replay: of a folder by the structure asked for, or the one file."""
    return fastq.listing(c.source, c.structure) if os.path.isdir(c.source) else [(None, c.source)]


def replay_reads(spark: SparkSession, c: model.ReplayConfig) -> tuple[DataFrame, list[str]]:
    """The source's reads with the target of each (relative to the run's), and the targets in order, for rechunking.

    An offset index numbers the reads, so that nothing is shuffled to place them, and tells the plan before a read is taken up.
    """
    files = sources(c)
    index = ranges.index(spark, files)
    group = c.output == "preserve" and files[0][0] is not None
    reads = ranges.by_index(spark, index)
    reads = P.chunked(reads.withColumn("pos", F.col("group_pos")) if group else reads, c.reads_per_file)
    totals = index.groupBy(*(["barcode"] if group else [])).agg(F.sum("reads").alias("n")).where("n > 0")
    plan = P.cascaded(totals, "n", c.reads_per_file).withColumnRenamed("file_index", "chunk_idx")
    ext = output_extension(files[0][1])
    stem = c.prefix or os.path.basename(naming_stem(files[0][1]))
    name = naming.numbered(F.lit(stem), "chunk", F.col("chunk_idx"), F.lit(ext))
    if c.output == "barcoded":
        names = F.array(*map(F.lit, naming.barcode_names(c.barcode_pattern, c.barcodes)))
        number = F.floor(F.col("chunk_idx") / c.barcodes)
        name = F.concat(F.element_at(names, (F.col("chunk_idx") % c.barcodes + 1).cast("int")), F.lit("/"), naming.numbered(F.lit(stem), "chunk", number, F.lit(ext)))
    elif group:
        name = F.concat(F.col("barcode"), F.lit("/"), name)
    plan = plan.select("chunk_idx", name.alias("target")).orderBy("chunk_idx", "target").collect()  # a row a file
    return reads.withColumn("target", name), [r["target"] for r in plan]


def output_extension(path: str) -> str:
    return ".fastq.gz" if path.endswith(".gz") else ".fastq"


def naming_stem(path: str) -> str:
    return re.sub(naming.FASTQ, "", path)


def times(spark: SparkSession, pacing: model.Pacing, batches: int, seed: str) -> list[tuple[int, float, float]]:
    """(batch, seconds to wait after it, seconds since the start)."""
    rows = model.intervals(spark, pacing.timing_model, batches, pacing.interval, seed, **pacing.timing_params).orderBy("batch").collect()
    return [(r["batch"], r["interval_s"], r["emit_offset_s"]) for r in rows]


def in_batches(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def _deliver(spark: SparkSession, reads: DataFrame, targets: list[str], root: str, pacing: model.Pacing, seed: str) -> list[tuple[str, int, float]]:
    """Bring the targets out batch by batch at their times: (target, reads, offset). targets is the plan, a row a file, relative to root.

    One job writes all files under hidden names; a batch is then a matter of names, however long its interval is. What a run that ends early has
    not brought out is removed.
    """
    batches = in_batches(targets, pacing.batch_size)
    done: list[tuple[str, int, float]] = []
    with interruptible(), closing(within(spark, pacing.timeout * len(batches), lambda: sinks.Later(reads, root))) as later:
        for (_, at), batch in zip(paced([(b, s) for b, s, _ in times(spark, pacing, len(batches), seed)], pacing.real_time), batches, strict=True):
            later.publish(batch)
            done += [(f"{root}/{t}", later.made.get(f"{root}/{t}", (None, 0))[1], at) for t in batch]
    return done


def replay(spark: SparkSession, c: model.ReplayConfig) -> list[tuple[str, int, float]]:
    """(target, reads, seconds since the start) of each file. Without reads_per_file files are copied or linked, and reads is -1.

    Executors copy, a batch at a time: each batch is complete before its interval is waited. pacing.parallel and workers say how many files of a
    batch are under way at once. A batch that takes longer than pacing.timeout raises TimeoutError, and its job is ended.
    """
    if not os.path.exists(c.source):
        raise FileNotFoundError(c.source)
    root = os.path.abspath(c.target)
    if c.reads_per_file is None:
        files = sources(c)
        warn_of_capacity(root, sum(os.path.getsize(p) for _, p in files) if c.operation == "copy" else 0)
        pairs = [(path, "/".join([root, *([barcode] if barcode else []), os.path.basename(path)])) for barcode, path in files]
        batches = in_batches(pairs, c.pacing.batch_size)
        plan = times(spark, c.pacing, len(batches), c.target)
        workers = c.pacing.workers if c.pacing.parallel else 1
        done = []
        with interruptible():
            if c.pacing.real_time:
                pace = paced([(b, s) for b, s, _ in plan], True)
                for (_, at), batch in zip(pace, batches, strict=True):
                    within(spark, c.pacing.timeout, lambda batch=batch: sinks.copies(spark, batch, c.operation == "link", workers))
                    done += [(t, -1, at) for _, t in batch]
            else:  # no one sees the order on a virtual clock
                within(spark, c.pacing.timeout * len(batches), lambda: sinks.copies(spark, pairs, c.operation == "link", workers))
                done = [(t, -1, at) for (*_, at), batch in zip(plan, batches, strict=True) for _, t in batch]
        return done
    if os.path.isfile(c.source) and not re.search(naming.FASTQ, c.source):  # a file that can't be cut goes through whole, or is left out where another layout is asked for
        if c.output != "preserve":
            raise EmptySource(f"{c.source} holds no reads")
        target = f"{root}/{os.path.basename(c.source)}"
        sinks.copies(spark, [(c.source, target)])
        return [(target, -1, 0.0)]
    reads, plan = replay_reads(spark, c)
    if not plan:
        raise EmptySource(f"{c.source} holds no reads")
    warn_of_capacity(root, sum(os.path.getsize(p) for _, p in sources(c)))
    return _deliver(spark, reads, plan, root, c.pacing, c.target)


def generate(spark: SparkSession, c: model.GenerateConfig) -> list[tuple[str, int, float]]:
    """(target, reads, seconds since the start) of each simulated file; a genome whose share is nothing still has an empty file."""
    warn_of_capacity(os.path.abspath(c.target), int(c.read_count * (2 * c.mean_length + 80) * (0.3 if c.output_format.endswith("gz") else 1)))
    seed = c.seed if c.seed is not None else zlib.adler32(c.target.encode())
    n = len(c.genomes)
    weights = c.abundances or tuple([1.0 / n] * n)
    order = spark.createDataFrame([(i, os.path.abspath(p), os.path.basename(p), w) for i, (p, w) in enumerate(zip(c.genomes, weights, strict=True))], "idx int, path string, genome string, w double")
    seqs = fastq.genomes(fastq.scan_fasta(spark, list(c.genomes))).select(F.col("src_path").alias("path"), "seq")
    shares = P.apportioned(order, F.lit(c.read_count)).join(seqs, "path", "left").withColumn("seq", F.coalesce("seq", F.lit("")))
    reads = generating.generate(shares, per_file=c.reads_per_file, mean_length=c.mean_length, std_length=c.std_length, min_length=c.min_length, mean_quality=c.mean_quality, std_quality=c.std_quality, seed=seed)
    reads = reads.join(order.select("genome", "idx"), "genome")
    ext, root = f".{c.output_format}", os.path.abspath(c.target)
    if c.mix_reads and not c.multiplex:
        from readloom.functions.rng import fast_uniform

        mixed = P.chunked(P.positions(reads.withColumn("u", fast_uniform(seed, F.lit("mix"), "genome", "file_index", "read_no")), ["u", "genome", "file_index", "read_no"]), c.reads_per_file)
        reads = mixed.withColumn("target", naming.numbered(F.lit("reads"), "chunk", F.col("chunk_idx"), F.lit(ext)))
        plan = [r[0] for r in reads.select("target").distinct().orderBy("target").collect()]
        return _deliver(spark, reads, plan, root, c.pacing, c.target)
    stem = naming.stem(F.col("genome"), naming.FASTA)
    folder = F.concat(naming.barcode_name(F.col("idx")), F.lit("/")) if c.multiplex else F.lit("")
    target = F.concat(folder, naming.numbered(stem, "reads", F.col("file_index"), F.lit(ext)))
    reads = reads.withColumn("target", target).withColumn("pos", F.col("read_no"))
    files = P.cascaded(shares.select("idx", "genome", "n"), "n", c.reads_per_file).withColumn("target", target)
    files = P.rounds(files, "file_index", "genome", c.target) if c.multiplex else P.small_order(files, ["idx", "file_index"])
    plan = [r["target"] for r in files.orderBy("seq_no").collect()]  # a row a file
    return _deliver(spark, reads, plan, root, c.pacing, c.target)
