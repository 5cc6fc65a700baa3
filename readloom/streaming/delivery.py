"""Paced delivery of files and what a consumer does with the stream."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.sources import store


def paced(plan: list[tuple[int, float]], real_time: bool = False, sleep=time.sleep) -> Iterator[tuple[int, float]]:
    """(batch, seconds since the start) of a schedule of (batch, interval): a batch is done before its interval is waited, and none follows the last one."""
    at = 0.0
    for n, (batch, interval) in enumerate(plan):
        yield batch, at
        if n + 1 < len(plan):
            at += interval
            if real_time:
                sleep(interval)


def deliver(reads: DataFrame, path: str, schedule: list[tuple[int, float]], batch: str = "batch", real_time: bool = False) -> list[tuple[int, float]]:
    """Bring each batch of reads to path, as a Parquet file of its own, at its time: (batch, seconds since the start).

    One job writes all batches beside path's files under a hidden folder; at its time a batch's file is given its name, so that consumers see whole
    batches. A batch is one task's work. A batch without reads brings nothing.
    """
    hidden = f"{path.rstrip('/')}/.staged-{uuid.uuid4().hex}"
    rows = reads.withColumn("__batch", F.col(batch).cast("bigint")).repartition("__batch")
    rows.write.partitionBy("__batch").parquet(hidden)
    done = []
    try:
        for b, at in paced(schedule, real_time):
            system, inside = store.located(f"{hidden}/__batch={b}")
            if system.get_file_info(inside).type.name == "Directory":
                for file, _ in store.listed(f"{hidden}/__batch={b}"):
                    store.publish(file, f"{path.rstrip('/')}/batch-{b}-{file.rpartition('/')[2]}")
            done.append((b, at))
    finally:
        store.located(path)[0].delete_dir(store.located(hidden)[1])
    return done


def arrivals(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:
    """The stream of what arrives under path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def windowed(stream: DataFrame, ts: str, late: str = "10 minutes", width: str = "10 minutes") -> DataFrame:
    """Reads a window of event time; the watermark drops what is later than late."""
    return stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).groupBy(F.window("__ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def counted(rows: DataFrame, folder: str, by: str, per_batch: int, ids: str) -> DataFrame:
    """by, n, ids (their sum) of rows that were delivered as files and consumed as a stream, to its end."""
    spark = rows.sparkSession
    rows.repartition(2 * per_batch, ids).write.mode("overwrite").parquet(f"{folder}/in")
    stream = arrivals(spark, f"{folder}/in", rows.schema, per_batch)
    totals = stream.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(ids).alias("ids"))
    keep = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out")  # noqa: E731  the last complete state stays
    q = totals.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
