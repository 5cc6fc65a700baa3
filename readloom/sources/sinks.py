"""Writing reads under exact file names, complete or not at all."""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from readloom.sources import ranges, store

FIELDS = ["header", "seq", "sep", "qual"]


def publish(data: bytes, target: str) -> None:
    """Write beside the target under a name of our own and rename, so that a reader never sees a part."""
    store.folder(target.rpartition("/")[0])
    made = store.beside(target, uuid.uuid4().hex)
    system, inside = store.located(made)
    try:
        with system.open_output_stream(inside) as f:
            f.write(data)
        store.publish(made, target)
    finally:
        store.remove(made)


@dataclass
class Written(ds.WriterCommitMessage):
    """(hidden name, target, reads, bytes before packing) of the files that a task has finished."""

    files: list[tuple[str, str, int, int]] = field(default_factory=list)


class Files:
    """The file that a task is writing, and those that it has finished."""

    def __init__(self, root: str, job: str, attempt: str):
        self.root, self.job, self.attempt = root.rstrip("/"), job, attempt
        self.done: list[tuple[str, str, int, int]] = []
        self.open, self.target, self.reads, self.bytes, self.seen = [], None, 0, 0, set()

    def add(self, target: str, text: bytes, reads: int) -> None:
        if target != self.target:
            self.close()
            if target in self.seen:
                raise ValueError(f"the reads of {target} are not together")
            self.seen.add(target)
            self.target, self.reads, self.bytes = target, 0, 0
            path = f"{self.root}/{target}"
            store.folder(path.rpartition("/")[0])
            self.made = store.beside(path, self.job, self.attempt)
            system, inside = store.located(self.made)
            self.open = [system.open_output_stream(inside)]
            if target.endswith(".gz"):
                self.open.insert(0, gzip.GzipFile(fileobj=self.open[0], mode="wb", compresslevel=1, mtime=0, filename=""))
        self.open[0].write(text)
        self.reads, self.bytes = self.reads + reads, self.bytes + len(text)

    def close(self) -> None:
        if self.open:
            for f in self.open:
                f.close()
            self.open = []
            self.done.append((self.made, f"{self.root}/{self.target}", self.reads, self.bytes))

    def drop(self) -> None:
        """Nothing that this attempt has written stays."""
        for f in reversed(self.open):  # the packed stream's end isn't wanted any more
            f.close()
        for made in [*(m for m, *_ in self.done), *([self.made] if self.open else [])]:
            store.remove(made)


class FastqWriter(ds.DataSourceArrowWriter):
    """Rows of target (relative to the folder saved to), header, seq, sep, qual, where a target's rows are neighbours in one partition.

    Each task streams its files under hidden names, and the driver renames them all at the end: a failing job leaves no file of its own. With the
    option later the names stay hidden, and a list of them, beside the root's files, is what publish_later() goes by.
    """

    def __init__(self, options: dict):
        self.root, self.job, self.later = options["path"], options.get("job") or uuid.uuid4().hex, options.get("later") == "true"

    def write(self, iterator: Iterator) -> Written:
        files = Files(self.root, self.job, str(TaskContext.get().taskAttemptId()))
        try:
            for batch in iterator:
                target = batch.column("target").to_pylist()
                columns = [batch.column(c).to_pylist() for c in FIELDS]
                a = 0
                for b in [i for i in range(1, len(target)) if target[i] != target[i - 1]] + [len(target)]:
                    if a < b:
                        text = "".join([f"{h}\n{s}\n{p}\n{q}\n" for h, s, p, q in zip(*[c[a:b] for c in columns], strict=True)])
                        files.add(target[a], text.encode(), b - a)
                    a = b
            files.close()
        except BaseException:
            files.drop()
            raise
        return Written(files.done)

    def commit(self, messages: list[Written | None]) -> None:
        made = [f for m in messages if m for f in m.files]
        if len({target for _, target, *_ in made}) < len(made):
            raise ValueError("the reads of a file are in several partitions")
        if self.later:
            publish("".join(json.dumps(f) + "\n" for f in made).encode(), pending(self.root, self.job))
            return
        for hidden, target, *_ in made:
            store.publish(hidden, target)
        store.clean(self.root, self.job)  # of attempts that were repeated

    def abort(self, messages: list[Written | None]) -> None:
        store.clean(self.root, self.job)


def pending(root: str, job: str) -> str:
    return f"{root.rstrip('/')}/.readloom-{job}.json"


def save(reads: DataFrame, root: str, target: str = "target", order: tuple[str, ...] = ("pos",), job: str | None = None, later: bool = False) -> None:
    """One file under root for each target (a path relative to it), its reads in order; gzipped by suffix. One shuffle by target; a task streams one file at a time.

    All files appear at the end of the job, or none. root: a folder or URI that all machines reach.
    """
    rows = reads.select(F.col(target).alias("target"), *FIELDS, *[F.col(c).alias(f"__{i}") for i, c in enumerate(order)])
    rows = rows.repartition("target").sortWithinPartitions("target", *[f"__{i}" for i in range(len(order))]).select("target", *FIELDS)
    ranges.registered(reads.sparkSession)
    w = rows.write.format("fastq").mode("append").option("later", str(later).lower())
    (w.option("job", job) if job else w).save(root)


class Later:
    """Files that a job has written under root and not yet published."""

    def __init__(self, reads: DataFrame, root: str, target: str = "target", order: tuple[str, ...] = ("pos",)):
        self.root, self.job = root, uuid.uuid4().hex
        save(reads, root, target, order, self.job, later=True)
        system, inside = store.located(pending(root, self.job))
        with system.open_input_stream(inside) as f:
            lines = f.read().decode().splitlines()
        self.made = {target: (hidden, reads, size) for hidden, target, reads, size in map(json.loads, lines)}

    def publish(self, targets: list[str]) -> None:
        """Give the targets (relative to root) their names; those without a read become empty files."""
        for t in targets:
            path = f"{self.root.rstrip('/')}/{t}"
            if path in self.made:
                store.publish(self.made[path][0], path)
            else:
                publish(b"", path)

    def close(self) -> None:
        """Remove the list and what was not published."""
        store.remove(pending(self.root, self.job))
        store.clean(self.root, self.job)


def write_fastq(reads: DataFrame, target: str = "target", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """target, reads, bytes (before packing) of one file for each target, written as save() does; targets are whole paths, of which none may be null. It is done when this returns."""
    ends = reads.agg(F.min(target).alias("a"), F.max(target).alias("b")).first()
    spark, schema = reads.sparkSession, "target string, reads bigint, bytes bigint"
    if ends["a"] is None:
        return spark.createDataFrame([], schema)
    same = next((i for i, (x, y) in enumerate(zip(ends["a"], ends["b"], strict=False)) if x != y), min(map(len, ends)))
    root = ends["a"][:same].rpartition("/")[0]  # what the first and last path share, all share
    later = Later(reads.withColumn(target, F.substring(target, len(root) + 2, 1 << 30)), root, target, order)
    try:
        later.publish([t[len(root) + 1 :] for t in later.made])
    finally:
        later.close()
    return spark.createDataFrame([(t, n, size) for t, (_, n, size) in later.made.items()], schema)


def copy(source: str, target: str, link: bool = False) -> int:
    """The target's bytes: a copy of a file, or a symbolic link to it on a mounted folder, published at once."""
    import os
    import shutil

    store.folder(target.rpartition("/")[0])
    (system, inside), (to, place) = store.located(source), store.located(target)
    hidden = store.beside(place, uuid.uuid4().hex)
    try:
        if link:
            os.symlink(inside, hidden)
            os.replace(hidden, place)
        else:
            with system.open_input_stream(inside) as f, to.open_output_stream(hidden) as g:
                shutil.copyfileobj(f, g, 1 << 22)
            to.move(hidden, place)
    finally:
        if to.get_file_info(hidden).type.name != "NotFound":
            to.delete_file(hidden)
    return system.get_file_info(inside).size


def copies(spark: SparkSession, pairs: list[tuple[str, str]], link: bool = False, workers: int | None = None) -> list[tuple[str, int]]:
    """(target, bytes) of (source, target), which executors copy or link, workers at a time at most."""
    if not pairs:
        return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"no": batch["no"], "bytes": [copy(a, b, link) for a, b in zip(batch["source"], batch["target"], strict=True)]})

    d = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "no bigint, source string, target string")
    d = d.repartitionByRange(min(len(pairs), workers or len(pairs)), "no")
    size = {r["no"]: r["bytes"] for r in d.mapInPandas(run, "no bigint, bytes bigint").collect()}  # a row a file
    return [(target, size[i]) for i, (_, target) in enumerate(pairs)]


def write_partitioned(reads: DataFrame, path: str, zipped: bool = True) -> None:
    """Part files under barcode=... folders, committed as one job: for outputs too large to be named one by one."""
    d = reads.select(F.concat_ws("\n", *FIELDS).alias("value"), "barcode")
    d.write.partitionBy("barcode").option("compression", "gzip" if zipped else "none").mode("overwrite").text(path)
