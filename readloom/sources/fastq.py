"""FASTQ and FASTA scans, file listings and folder layouts."""

from __future__ import annotations

import os
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import naming
from readloom.sources import ranges, store

READ = "src_path string, src_pos bigint, header string, seq string, sep string, qual string"
FIELDS = [c.split()[0] for c in READ.split(", ")]


def scan(spark: SparkSession, paths: list[str] | str, range_bytes: int = 1 << 26) -> DataFrame:
    """READ's columns. Four lines a record, by position; a record that is cut off is left out; .gz is unpacked.

    paths: files, folders and patterns. A plain file of more than range_bytes is read by ranges of an index, which costs one more pass
    for its line ends; other files are streamed, each by one task. Filters on src_path and src_pos decide what is opened.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if any(size > range_bytes and not path.endswith(".gz") for path, size in store.listed(paths)):
        return ranges.by_index(spark, ranges.index(spark, paths, range_bytes)).select(*FIELDS)
    return ranges.registered(spark).read.format("fastq").option("paths", "\n".join(paths)).option("parallelism", spark.sparkContext.defaultParallelism).load().select(*FIELDS)


def between(spark: SparkSession, index: DataFrame | str, first: int, n: int) -> DataFrame:
    """READ's columns and pos of the reads first to first + n - 1 of all files of an index, in their order: other ranges and files are not opened."""
    d = ranges.by_index(spark, index).where((F.col("pos") >= first) & (F.col("pos") < first + n))
    return d.select(*FIELDS, "pos")


def counts(index: DataFrame, chunk: int | None = None) -> DataFrame:
    """src_path, reads of each file of an index, without another look at it; with chunk also the places of every chunk-th read."""
    d = index.groupBy("file_no", F.col("path").alias("src_path")).agg(F.sum("reads").alias("reads")).drop("file_no")
    if chunk:
        starts = F.when(F.col("reads") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("reads") - 1, F.lit(chunk).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
        d = d.withColumn("starts", starts)
    return d


def strict_counts(spark: SparkSession, paths: list[str] | str | DataFrame) -> DataFrame:
    """src_path, reads of files or of an index; fails on a file whose lines aren't a multiple of four."""
    found = paths if isinstance(paths, DataFrame) else ranges.index(spark, paths)
    d = found.groupBy("file_no", F.col("path").alias("src_path")).agg(F.max("lines").alias("lines"))
    return d.select("src_path", F.when(F.col("lines") % 4 != 0, F.raise_error(F.concat(F.col("src_path"), F.lit(": lines aren't a multiple of four"))).cast("bigint")).otherwise(F.floor(F.col("lines") / 4)).alias("reads"))


def contigs(path: str) -> Iterator[tuple[str, str]]:
    """(first word of the header, upper-case sequence) of a file's contigs, one at a time; gzip is unpacked."""
    name, held = None, []
    with ranges.stream(path) as f:
        for some in ranges.lines(f):
            for line in some:
                if line.startswith(b">"):
                    if name is not None:
                        yield name, b"".join(held).upper().decode(errors="replace")
                    words = line[1:].decode(errors="replace").split(maxsplit=1)
                    name, held = words[0] if words and not line[1:2].isspace() else "", []
                elif name is not None:
                    held.append(b"".join(line.split()))
    if name is not None:
        yield name, b"".join(held).upper().decode(errors="replace")


def scan_fasta(spark: SparkSession, paths: list[str] | str, held: int = 1 << 22) -> DataFrame:
    """src_path, contig_pos, contig (first word), seq (upper case, lines joined). Text before the first > is left out. A file is streamed by one task, which holds a contig, or held characters of short ones."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["src_path", "contig_pos", "contig", "seq"]
        for batch in batches:
            for path in batch["path"]:
                rows, size = [], 0
                for i, (name, seq) in enumerate(contigs(path)):
                    rows.append((path, i, name, seq))
                    size += len(seq)
                    if size >= held:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=columns)

    files = [(i, p) for i, (p, _) in enumerate(store.listed(paths))]
    d = spark.createDataFrame(files, "no int, path string").repartitionByRange(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)), "no")
    return d.select("path").mapInPandas(read, "src_path string, contig_pos int, contig string, seq string")


def genomes(contigs: DataFrame) -> DataFrame:
    """src_path, seq: contigs joined in order."""
    d = contigs.groupBy("src_path").agg(F.array_sort(F.collect_list(F.struct("contig_pos", "seq"))).alias("c"))
    return d.select("src_path", F.array_join(F.transform("c", lambda x: x["seq"]), "").alias("seq"))


def listing(folder: str, structure: str = "auto") -> list[tuple[str | None, str]]:
    """(barcode, path) of sequencing files: of barcode folders if there are any, else of the folder itself; by barcode and name.
    structure "multiplex" looks at barcode folders only, "singleplex" at the folder only.

    The folder is listed on the driver, for Spark would hide names with a leading underscore. Raises ValueError where no
    file is found.
    """
    def files(d: str) -> list[str]:
        names = [n for n in os.listdir(d) if re.search(naming.FASTQ, n) and not n.startswith(".") and os.path.isfile(os.path.join(d, n))]
        return [os.path.join(d, n) for n in sorted(names)]

    if not os.path.isdir(folder):
        raise ValueError(f"{folder} isn't a folder")
    dirs = sorted(n for n in os.listdir(folder) if re.match(naming.BARCODE, n) and os.path.isdir(os.path.join(folder, n)))
    found = [(b, p) for b in dirs for p in files(os.path.join(folder, b))] if structure != "singleplex" else []
    if not found and structure != "multiplex":
        found = [(None, p) for p in files(folder)]
    if not found:
        raise ValueError(f"{folder} holds no sequencing files")
    return found


def layout(folder: str) -> str:
    """multiplex if any barcode folder has a file, else singleplex. Files of the folder itself, which a multiplex run leaves out, are warned of."""
    structure = "multiplex" if listing(folder)[0][0] else "singleplex"
    if structure == "multiplex":
        try:
            beside = listing(folder, "singleplex")
        except ValueError:
            beside = []
        if beside:
            warnings.warn(f"{folder} holds barcode folders, so that {len(beside)} sequencing files beside them are left out", stacklevel=2)
    return structure


def genome_files(path: str) -> list[str]:
    """The path itself, or the FASTA files of a folder by name. Raises ValueError for a missing path and for a folder without any."""
    if not os.path.exists(path):
        raise ValueError(f"{path} doesn't exist")
    if not os.path.isdir(path):
        return [path]
    found = [p for n in sorted(os.listdir(path)) if re.search(naming.FASTA, n) and os.path.isfile(p := os.path.join(path, n))]
    if not found:
        raise ValueError(f"{path} holds no genome files")
    return found
