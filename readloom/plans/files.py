"""Queries that write and read files: round trips, reshaping and delivery."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from readloom.operators import planning as P
from readloom.operators import quality as Q
from readloom.plans.registry import query, table
from readloom.sources import fastq, ranges, sinks, store
from readloom.storage import shared_dir


def as_reads(spark, sf):
    d = table(spark, sf, "orders")
    return d.select(F.col("o_orderkey").alias("k"), "o_orderstatus", F.concat(F.lit("@o"), F.col("o_orderkey").cast("string")).alias("header"), F.repeat(F.lit("ACGT"), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("seq"), F.lit("+").alias("sep"), F.repeat(F.lit("I"), ((F.col("o_orderkey") % 5 + 1) * 4).cast("int")).alias("qual"))


def folder(spark) -> str:
    """A new folder that executors share, for files whose names are given. Raises where the shared folder is no path that all machines mount."""
    base = shared_dir(spark)
    if not base.startswith(("/", "file:")):
        raise ValueError(f"files of given names need a mounted folder, not {base}")
    path = f"/{base.removeprefix('file:').lstrip('/')}/readloom/reads-{uuid.uuid4().hex}"
    store.folder(path)
    return path


def orders_written(spark, sf, suffix: str, per_file: int = 2000) -> str:
    """The folder of the orders as reads, in files of per_file."""
    out = folder(spark)
    reads = P.chunked(P.positions(as_reads(spark, sf), ["k"]), per_file)
    sinks.save(reads.withColumn("target", F.format_string(f"orders_chunk_%04d{suffix}", F.col("chunk_idx").cast("int"))), out)
    return out


def key():
    return F.substring("header", 3, 30).cast("bigint").alias("k")


@query("fastq_roundtrip", "SELECT o_orderkey AS k, repeat('ACGT', (o_orderkey % 5 + 1)::BIGINT) AS seq FROM orders")
def fastq_roundtrip(spark, sf):
    return fastq.scan(spark, f"{orders_written(spark, sf, '.fastq.gz')}/*.fastq.gz").select(key(), "seq")


@query("fastq_ranges", """
SELECT o_orderkey AS k, (row_number() OVER (ORDER BY o_orderkey) - 1) % 2000 AS src_pos, (row_number() OVER (ORDER BY o_orderkey) - 1) // 2000 AS file_no, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders""")
def fastq_ranges(spark, sf):
    """Plain files read by ranges of 32,768 bytes, each read with its place in its file and in all files; nothing is shuffled for that."""
    index = ranges.index(spark, f"{orders_written(spark, sf, '.fastq')}/*.fastq", 32768)
    return ranges.by_index(spark, index).select(key(), "src_pos", F.regexp_extract("src_path", r"_chunk_(\d+)", 1).cast("bigint").alias("file_no"), "pos")


@query("fastq_between", """
SELECT k, pos FROM (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders) WHERE pos >= n // 3 AND pos < n // 3 + n // 10""")
def fastq_between(spark, sf):
    """A tenth of the reads, from the first third on, by the index: other ranges and files aren't opened."""
    index = ranges.index(spark, f"{orders_written(spark, sf, '.fastq')}/*.fastq", 65536)
    n = index.agg(F.sum("reads")).first()[0]
    return fastq.between(spark, index, n // 3, n // 10).select(key(), "pos")


@query("reshape_matrix", """
SELECT ((row_number() OVER (ORDER BY o_orderkey) - 1) // 3000) % 3 + 1 AS barcode_no, o_orderkey AS k FROM orders""")
def reshape_matrix(spark, sf):
    """Reads reshaped from files by status into three barcode folders, and read back: every read once."""
    out = folder(spark)
    reads = P.dealt(P.chunked(P.positions(as_reads(spark, sf), ["k"]), 3000), 3)
    target = F.format_string("barcode%02d/orders_chunk_%04d.fastq", (F.col("barcode_idx") + 1).cast("int"), F.col("file_index").cast("int"))
    sinks.save(reads.withColumn("target", target), out)
    back = fastq.scan(spark, [p for _, p in fastq.listing(out)])
    return back.select(F.regexp_extract("src_path", r"barcode(\d+)", 1).cast("bigint").alias("barcode_no"), key())


@query("stream_delivery", "SELECT event_type, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def stream_delivery(spark, sf):
    from readloom.streaming import delivery

    return delivery.counted(table(spark, sf, "events"), folder(spark), by="event_type", per_batch=4, ids="event_id")


@query("paced_stream", "SELECT event_type, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids, (max(event_id // 500) + 1)::BIGINT AS batches FROM events GROUP BY 1")
def paced_stream(spark, sf):
    """Events staged by five hundreds of their ids, played at the times of a bursty schedule, a million times as fast, and counted as a stream."""
    from readloom import model
    from readloom.streaming import paced

    out = folder(spark)
    d = table(spark, sf, "events").withColumn("batch", F.expr("event_id div 500"))
    n = d.agg(F.max("batch")).first()[0] + 1
    paced.stage(d, model.intervals(spark, "poisson", n, 2.0, "events"), out)
    totals = paced.play(spark, out, speed=1e6, maxBatchesPerTrigger=-(-n // 3)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), (F.max("batch") + 1).alias("batches"))
    keep = lambda df, _: df.write.mode("overwrite").parquet(f"{out}/totals")  # noqa: E731  the last complete state stays
    q = totals.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").start()
    paced.to_end(q, n)
    return spark.read.parquet(f"{out}/totals")


@query("run_progress", """
WITH p AS (SELECT event_type AS run, count(*)::BIGINT AS done, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS passed FROM events GROUP BY 1)
SELECT run, done, round(100.0::DOUBLE * done / 1000000, 6) AS percent, round(done / passed, 9) AS rate, round((1000000 - done) / (done / passed), 2) AS eta, false AS stalled FROM p""")
def run_progress(spark, sf):
    """The last that a stream of events in three batches tells of each type, from states that each batch goes on with."""
    from readloom.streaming import delivery, progress

    out = folder(spark)
    d = table(spark, sf, "events").select("event_id", "event_type", "ts", F.lit(1_000_000).cast("bigint").alias("total"))
    d.repartition(9, "event_id").write.parquet(f"{out}/in")
    told = progress.by_run(delivery.arrivals(spark, f"{out}/in", d.schema, 3), "event_type", "ts", "total", stall="1000 days", late="1000 days")
    keep = lambda df, n: df.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{out}/told/{n}")
    told.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{out}/told/*").groupBy("run").agg(F.max_by(F.struct("done", "percent", "rate", "eta", "stalled"), "n").alias("r"))
    return last.select("run", "r.done", F.round("r.percent", 6).alias("percent"), F.round("r.rate", 9).alias("rate"), F.round("r.eta", 2).alias("eta"), "r.stalled")


FAULTS = """(SELECT o_orderkey AS k, o_orderstatus, (o_orderkey % 5 + 1) * 4 AS n, o_orderkey % 7 = 0 AS no_at, o_orderkey % 11 = 0 AS no_plus, o_orderkey % 13 = 0 AS short, 33 + o_orderkey % 41 AS code FROM orders)"""


def faulty_files(spark, sf, suffix: str) -> str:
    """The folder of a file for each status and 2,000 of its orders, some with faults of each kind."""
    out = folder(spark)
    k, n = F.col("o_orderkey"), ((F.col("o_orderkey") % 5 + 1) * 4).cast("int")
    rows = table(spark, sf, "orders").select(
        k.alias("k"), "o_orderstatus", F.concat(F.when(k % 7 == 0, "o").otherwise("@o"), k.cast("string")).alias("header"), F.repeat(F.lit("ACGT"), (n / 4).cast("int")).alias("seq"),
        F.when(k % 11 == 0, "-").otherwise("+").alias("sep"), F.repeat(F.chr(33 + k % 41), n - (k % 13 == 0).cast("int")).alias("qual"))
    rows = P.chunked(P.positions(rows, ["k"], group="o_orderstatus"), 2000)
    target = F.concat("o_orderstatus", F.format_string(f"_chunk_%04d{suffix}", F.col("chunk_idx").cast("int")))
    sinks.save(rows.withColumn("target", target), out)
    return out


STATUS = r"([A-Z])_chunk_\d+\.fastq"


@query("read_quality", f"""
SELECT o_orderstatus, count(*)::BIGINT AS reads, round(avg(n), 6) AS mean_length, count_if(no_at)::BIGINT AS bad_headers, count_if(no_plus)::BIGINT AS bad_separators, count_if(short)::BIGINT AS unequal, min(code)::BIGINT AS least_phred, max(code)::BIGINT AS most_phred
FROM {FAULTS} GROUP BY 1""")
def read_quality(spark, sf):
    """Faults counted in gzipped files that hold them."""
    reads = fastq.scan(spark, f"{faulty_files(spark, sf, '.fastq.gz')}/*.fastq.gz").withColumn("o_orderstatus", F.regexp_extract("src_path", STATUS, 1))
    d = Q.content(reads, ["o_orderstatus"])
    return d.select("o_orderstatus", "reads", F.round("mean_length", 6).alias("mean_length"), "bad_headers", "bad_separators", "unequal", F.col("least_phred").cast("bigint").alias("least_phred"), F.col("most_phred").cast("bigint").alias("most_phred"))


@query("read_counts", """
WITH p AS (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS pos FROM orders), f AS (SELECT o_orderstatus, pos // 2000 AS file_no, count(*)::BIGINT AS reads FROM p GROUP BY 1, 2)
SELECT o_orderstatus, file_no::BIGINT AS file_no, reads, reads AS strict_reads, array_to_string(list_transform(generate_series(0, (reads - 1) // 300), lambda i: i * 300), ',') AS starts FROM f""")
def read_counts(spark, sf):
    """Reads of each plain file, counted by records of an index, with the places to start at, and strictly by lines."""
    index = ranges.index(spark, f"{faulty_files(spark, sf, '.fastq')}/*.fastq", 8192)
    strict = fastq.strict_counts(spark, index).select("src_path", F.col("reads").alias("strict_reads"))
    d = fastq.counts(index, 300).join(strict, "src_path")
    return d.select(F.regexp_extract("src_path", STATUS, 1).alias("o_orderstatus"), F.regexp_extract("src_path", r"_chunk_(\d+)", 1).cast("bigint").alias("file_no"), "reads", "strict_reads", F.array_join(F.transform("starts", lambda x: x.cast("string")), ",").alias("starts"))


@query("genome_scan", """
SELECT 'c' || p_partkey AS contig, upper(translate(p_name, ' ', '')) AS seq FROM part""")
def genome_scan(spark, sf):
    """Contigs written in lines of seven characters and read back."""
    lines = F.rtrim(F.regexp_replace(F.translate("p_name", " ", ""), "(.{7})", "$1\n"))
    d = table(spark, sf, "part").select(F.concat(F.lit(">c"), F.col("p_partkey").cast("string"), F.lit(" part\n"), lines).alias("value"))
    out = f"{shared_dir(spark)}/readloom/genomes-{uuid.uuid4().hex}"
    d.write.text(out)
    return fastq.scan_fasta(spark, out).select("contig", "seq")
