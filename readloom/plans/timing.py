"""Arrival schedules on a virtual clock."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions.rng import uniform
from readloom.operators import timing as T
from readloom.plans.registry import query, table

U = "('0x' || substr(md5(concat_ws(':', '{}', batch)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
BATCHES = "(SELECT DISTINCT o_orderkey // 500 AS batch FROM orders)"
OUT = "SELECT batch, round(interval_s, 6) AS interval_s, round(coalesce(sum(interval_s) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS emit_offset_s FROM d"


def batches(spark, sf):
    return table(spark, sf, "orders").select(F.expr("o_orderkey div 500").alias("batch")).distinct()


def out(d):
    return T.schedule(d).select("batch", F.round("interval_s", 6).alias("interval_s"), F.round("emit_offset_s", 4).alias("emit_offset_s"))


@query("timing_uniform", f"WITH d AS (SELECT batch, 2.5::DOUBLE AS interval_s FROM {BATCHES}) {OUT}")
def timing_uniform(spark, sf):
    return out(batches(spark, sf).withColumn("interval_s", T.uniform_interval(2.5)))


@query("timing_random", f"WITH d AS (SELECT batch, greatest(0, 2.0::DOUBLE + 0.6::DOUBLE * (2 * ({U.format('rand')}) - 1)) AS interval_s FROM {BATCHES}) {OUT}")
def timing_random(spark, sf):
    return out(batches(spark, sf).withColumn("interval_s", T.random_interval(2.0, uniform("rand", F.col("batch")))))


@query("timing_poisson", f"WITH d AS (SELECT batch, -ln(1 - {U.format('exp')}) * 2.0::DOUBLE / (CASE WHEN {U.format('burst')} < 0.1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END) AS interval_s FROM {BATCHES}) {OUT}")
def timing_poisson(spark, sf):
    return out(batches(spark, sf).withColumn("interval_s", T.burst_interval(2.0, uniform("burst", F.col("batch")), uniform("exp", F.col("batch")))))


@query("timing_adaptive", f"""
WITH RECURSIVE b AS (SELECT batch, row_number() OVER (ORDER BY batch) AS i, {U.format('adapt')} AS u FROM {BATCHES}),
r AS (SELECT i, batch, -ln(1 - u) * 2.0::DOUBLE AS v, [-ln(1 - u) * 2.0::DOUBLE] AS past, 2.0::DOUBLE AS mean FROM b WHERE i = 1
UNION ALL SELECT b.i, b.batch, -ln(1 - b.u) * r.mean, list_append(r.past, -ln(1 - b.u) * r.mean)[-10:], 0.9::DOUBLE * r.mean + 0.1::DOUBLE * list_avg(list_append(r.past, -ln(1 - b.u) * r.mean)[-10:]) FROM r JOIN b ON b.i = r.i + 1),
d AS (SELECT batch, v AS interval_s FROM r) {OUT}""")
def timing_adaptive(spark, sf):
    b = batches(spark, sf).withColumn("u", uniform("adapt", F.col("batch")))
    return out(T.adaptive_intervals(b, 2.0))


@query("interval_summary", f"WITH d AS (SELECT batch, -ln(1 - {U.format('exp')}) * 2.0::DOUBLE AS interval_s FROM {BATCHES}) SELECT round(avg(interval_s), 6) AS mean_s, round(stddev_pop(interval_s), 6) AS std_s, count(*)::BIGINT AS n FROM d")
def interval_summary(spark, sf):
    d = batches(spark, sf).withColumn("interval_s", T.burst_interval(2.0, F.lit(1.0), uniform("exp", F.col("batch"))))
    return d.agg(F.round(F.avg("interval_s"), 6).alias("mean_s"), F.round(F.stddev_pop("interval_s"), 6).alias("std_s"), F.count(F.lit(1)).alias("n"))
