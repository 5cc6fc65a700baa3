"""Checks, progress and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.operators import quality as Q
from readloom.plans.registry import query, table


@query("interleave_metric", """
WITH r AS (SELECT user_id % 20 AS grp, event_type, ts, event_id, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id % 20 ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY grp ORDER BY ts, event_id) AS run FROM r), t AS (SELECT grp, run, min(event_type) AS e, count(*) AS n FROM s GROUP BY 1, 2)
SELECT grp, max(n)::BIGINT AS max_run, (count(*) - 1)::BIGINT AS transitions, count(DISTINCT e)::BIGINT AS buckets FROM t GROUP BY 1""")
def interleave_metric(spark, sf):
    d = table(spark, sf, "events").select((F.col("user_id") % 20).alias("grp"), "event_type", "ts", "event_id")
    return Q.interleaving(d, "event_type", ["ts", "event_id"], ["grp"])


@query("interleave_all", """
WITH r AS (SELECT event_type, ts, event_id, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id) AS run FROM r), t AS (SELECT run, min(event_type) AS e, count(*) AS n FROM s GROUP BY 1)
SELECT 0 AS grp, max(n)::BIGINT AS max_run, (count(*) - 1)::BIGINT AS transitions, count(DISTINCT e)::BIGINT AS buckets FROM t""")
def interleave_all(spark, sf):
    """One group of all rows."""
    d = table(spark, sf, "events").select(F.lit(0).alias("grp"), "event_type", "ts", "event_id")
    return Q.interleaving(d, "event_type", ["ts", "event_id"], ["grp"])


@query("interarrival_stats", """
WITH g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events)
SELECT user_id, count(gap)::BIGINT AS gaps, round(avg(gap), 3) AS mean_s, round(stddev_pop(gap), 3) AS std_s FROM g GROUP BY 1""")
def interarrival_stats(spark, sf):
    d = Q.interarrivals(table(spark, sf, "events"), "ts", ["user_id"], ["ts", "event_id"])
    return d.select("user_id", "gaps", F.round("mean_s", 3).alias("mean_s"), F.round("std_s", 3).alias("std_s"))


@query("size_estimate", """
SELECT source, sum(n_chars)::BIGINT AS bytes, (count(*) * 4080)::BIGINT AS plain, floor((count(*) * 4080) * 0.3::DOUBLE)::BIGINT AS zipped FROM documents GROUP BY 1""")
def size_estimate(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return d.select("source", "bytes", Q.estimated_bytes(F.col("n"), 2000, False).alias("plain"), Q.estimated_bytes(F.col("n"), 2000, True).alias("zipped"))


@query("progress_eta", """
WITH p AS (SELECT o_orderpriority AS run, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS done, count(*)::BIGINT AS total, 120.0::DOUBLE AS elapsed FROM orders GROUP BY 1)
SELECT run, done, total, round(done * 100.0 / total, 6) AS percent, round(done / elapsed, 6) AS rate, round(CASE WHEN done >= total THEN 0.0 WHEN done > 0 THEN (total - done) * elapsed / done END, 6) AS eta FROM p""")
def progress_eta(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count(F.lit(1)).alias("total"))
    percent, rate, eta = Q.progress(F.col("done"), F.col("total"), F.lit(120.0))
    return d.select("run", "done", "total", F.round(percent.cast("double"), 6).alias("percent"), F.round(rate, 6).alias("rate"), F.round(eta, 6).alias("eta"))


@query("content_qa", """
SELECT lang, count(*)::BIGINT AS reads, round(avg(length(text)), 6) AS mean_length, count_if(length(text) <> n_chars // 3 * 3)::BIGINT AS unequal, count_if(source NOT LIKE '%1')::BIGINT AS bad_separators FROM documents GROUP BY 1""")
def content_qa(spark, sf):
    """Documents checked as reads: sources are separators, most of them wrong, and qualities come in threes."""
    d = table(spark, sf, "documents").select("lang", F.lit("@d").alias("header"), F.col("text").alias("seq"), F.when(F.col("source").endswith("1"), "+").otherwise("-").alias("sep"), F.repeat(F.lit("I!5"), F.floor(F.col("n_chars") / 3).cast("int")).alias("qual"))
    return Q.content(d, ["lang"]).select("lang", "reads", F.round("mean_length", 6).alias("mean_length"), "unequal", "bad_separators")


@query("profile_recommend", """
WITH n AS (SELECT c_nationkey, count(*)::BIGINT AS files FROM customer GROUP BY 1)
SELECT c_nationkey, files, CASE WHEN files < 50 THEN 'steady,bursty,development' WHEN files < 500 THEN 'bursty,gradual_drift,development' ELSE 'high_throughput,bursty,development' END AS profiles FROM n""")
def profile_recommend(spark, sf):
    n = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("files"))
    return n.select("c_nationkey", "files", F.array_join(Q.recommended(F.col("files")), ",").alias("profiles"))


@query("validate_output", """
SELECT event_type AS dir, count_if(event_id % 3 = 0)::BIGINT AS hits, CASE WHEN count_if(event_id % 3 = 0) = 0 THEN 'no file matches' END AS issue FROM events GROUP BY 1""")
def validate_output(spark, sf):
    d = table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 3 == 0, "r.fastq").otherwise("r.txt").alias("name"), F.lit(1).alias("depth"))
    hits = F.count_if(Q.matches(d, ["*.fastq", "*.fq"]))
    return d.groupBy(F.col("event_type").alias("dir")).agg(hits.alias("hits"), F.when(hits == 0, "no file matches").alias("issue"))


@query("tumbling_arrivals", """
SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS bucket, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def tumbling_arrivals(spark, sf):
    d = table(spark, sf, "events").groupBy(F.window("ts", "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return d.select(F.col("w.start").alias("bucket"), "n", "total")


@query("session_arrivals", """
WITH s AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s)
SELECT user_id, min(ts) AS first_ts, count(*)::BIGINT AS n FROM r GROUP BY user_id, k""")
def session_arrivals(spark, sf):
    d = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return d.select("user_id", F.col("w.start").alias("first_ts"), "n")
