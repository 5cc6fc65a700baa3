"""A stream of reads that come at the times of a schedule: written once by batch, and played back by places in that schedule."""

from __future__ import annotations

import bisect
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery

from readloom.sources import sinks, store


def stage(reads: DataFrame, schedule: DataFrame, path: str, batch: str = "batch") -> None:
    """Write reads under path in one job, a folder for each batch, with the schedule (batch, emit_offset_s) beside it.

    Rows of a batch that the schedule doesn't have are never played. A batch is one file, and so one task's work.
    """
    rows = reads.withColumn("__batch", F.col(batch).cast("bigint")).repartition("__batch")
    rows.write.partitionBy("__batch").mode("overwrite").parquet(f"{path}/data")
    schedule.select(F.col("batch").cast("bigint").alias("batch"), F.col("emit_offset_s").cast("double").alias("emit_offset_s")).write.mode("overwrite").parquet(f"{path}/schedule")


def table(path: str) -> list[tuple[float, int]]:
    """(offset, batch) of a staged schedule, in order: a row a batch."""
    system, inside = store.located(f"{path}/schedule")
    t = pads.dataset(inside, filesystem=system, format="parquet").to_table()
    return sorted(zip(t["emit_offset_s"].to_pylist(), t["batch"].to_pylist(), strict=True))


@dataclass
class Batches(ds.InputPartition):
    """Files that one task reads."""

    paths: list[str]


class PacedReader(ds.DataSourceStreamReader):
    """Offsets are places in the schedule: {"next": n} when the n first batches are due.

    The run's clock stands still while no query runs. It is written before an offset is told, so that a query that goes on from its checkpoint never sees the place
    go back; the wait that it was stopped in begins again.
    """

    def __init__(self, options: dict, schema):
        self.path, self.schema = options["path"], schema
        self.speed, self.clock = float(options.get("speed", 1.0)), options.get("clock") or f"{options['path']}/clock.json"
        self.most, self.tasks = int(options.get("maxbatchespertrigger", 0)), int(options.get("tasks", 32))
        if self.speed <= 0:
            raise ValueError("speed must be positive")
        self.plan, self.began, self.told = None, None, 0

    def open(self) -> None:
        if self.plan is not None:
            return
        self.plan = table(self.path)
        system, inside = store.located(self.clock)
        passed = 0.0
        if system.get_file_info(inside).type.name == "File":
            with system.open_input_stream(inside) as f:
                saved = json.loads(f.read())
            passed, self.told = saved["passed"], saved["next"]
        self.began = time.time() - passed / self.speed

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.open()
        passed = (time.time() - self.began) * self.speed
        due = bisect.bisect_right(self.plan, (passed, float("inf")))
        if self.most:
            due = min(due, self.told + self.most)
        if due > self.told:
            self.told = due
            # what has passed up to the last batch that is told: later ones that are due as well stay so
            sinks.publish(json.dumps({"passed": max(self.plan[due - 1][0], 0.0) if self.most else passed, "next": due}).encode(), self.clock)
        return {"next": self.told}

    def partitions(self, start: dict, end: dict) -> list[Batches]:
        self.open()
        self.told = max(self.told, end["next"])
        out = []
        for _, batch in self.plan[start["next"] : end["next"]]:
            system, inside = store.located(f"{self.path}/data/__batch={batch}")
            if system.get_file_info(inside).type.name == "Directory":
                out += [f for f, size in store.listed(f"{self.path}/data/__batch={batch}") if size]
        n = min(len(out), self.tasks)
        return [Batches(out[i::n]) for i in range(n)]

    def read(self, partition: Batches | None) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.schema)
        for path in partition.paths if partition else ():
            system, inside = store.located(path)
            with system.open_input_file(inside) as f:
                for batch in pq.ParquetFile(f).iter_batches(columns=wanted.names):
                    yield batch.select(wanted.names).cast(wanted)

    def commit(self, end: dict) -> None:
        pass


class PacedSource(ds.DataSource):
    """spark.readStream.format("paced"): the reads staged under path, when their batches are due.

    Options: speed, seconds of the schedule in a second; maxBatchesPerTrigger; tasks, that share a trigger's batches (32 at most, unless given); clock, the file that keeps a run's time (one a query that plays the folder).
    """

    @classmethod
    def name(cls) -> str:
        return "paced"

    def streamReader(self, schema) -> ds.DataSourceStreamReader:  # noqa: N802
        return PacedReader(dict(self.options), schema)


def play(spark: SparkSession, path: str, **options) -> DataFrame:
    """The stream of what is staged under path."""
    spark.dataSource.register(PacedSource)
    options = {"tasks": spark.sparkContext.defaultParallelism} | options
    schema = spark.read.parquet(f"{path}/data").drop("__batch").schema
    return spark.readStream.format("paced").schema(schema).option("path", path).options(**{k: str(v) for k, v in options.items()}).load()


def place(query: StreamingQuery) -> int:
    """How many batches of the schedule a query of one paced source has taken up."""
    last = query.lastProgress
    sources = json.loads(last.json)["sources"] if last else []
    return ((sources[0]["endOffset"] or {}) if sources else {}).get("next", 0)


def to_end(query: StreamingQuery, batches: int, stop: Callable[[], bool] = lambda: False, every: float = 0.1) -> bool:
    """Wait until a query has taken up all batches, then end it; False where stop() says so first, or it was ended from elsewhere. What it fails with is raised."""
    try:
        while query.isActive and place(query) < batches and not stop():
            query.awaitTermination(every)
        if query.exception() is not None:
            raise query.exception()
        return place(query) >= batches
    finally:
        if query.isActive:
            query.stop()
