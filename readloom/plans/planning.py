"""Output plans: chunks, dealing, interleaving, batches, apportionment, rounds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from readloom.functions import naming
from readloom.operators import planning as P
from readloom.plans.registry import query, table

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINES = f"(SELECT l_orderkey, row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1 AS pos FROM lineitem)"


@query("rechunk_flat", """
SELECT pos // 1000 AS chunk_idx, printf('orders_chunk_%04d.fastq', pos // 1000) AS file_name, count(*)::BIGINT AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) GROUP BY 1, 2""")
def rechunk_flat(spark, sf):
    reads = P.chunked(P.positions(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"]), 1000)
    chunks = P.chunk_table(reads, "o_orderkey")
    return chunks.select("chunk_idx", naming.numbered(F.lit("orders"), "chunk", F.col("chunk_idx"), F.lit(".fastq")).alias("file_name"), "n", "first_key", "last_key")


@query("rechunk_flat_total", """
SELECT count(*)::BIGINT AS reads, ceil(count(*) / 777.0)::BIGINT AS files, (count(*) - (ceil(count(*) / 777.0) - 1) * 777)::BIGINT AS last_reads FROM lineitem""")
def rechunk_flat_total(spark, sf):
    n = F.count(F.lit(1))
    return table(spark, sf, "lineitem").agg(n.alias("reads"), F.ceil(n / 777).cast("bigint").alias("files"), (n - (F.ceil(n / 777) - 1) * 777).cast("bigint").alias("last_reads"))


@query("rechunk_barcoded", f"""
SELECT pos // 1000 AS chunk_idx, printf('barcode%02d', (pos // 1000) % 7 + 1) AS barcode, (pos // 1000) // 7 AS file_index, count(*)::BIGINT AS n, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key
FROM {LINES} GROUP BY 1, 2, 3""")
def rechunk_barcoded(spark, sf):
    reads = P.chunked(P.positions(table(spark, sf, "lineitem").select(*LINE_ORDER), LINE_ORDER), 1000)
    d = P.dealt(P.chunk_table(reads, "l_orderkey"), 7)
    return d.select("chunk_idx", naming.barcode_name(F.col("barcode_idx")).alias("barcode"), "file_index", "n", "first_key", "last_key")


@query("rechunk_preserve_interleave", """
WITH c AS (SELECT o_orderpriority AS barcode, pos // 500 AS chunk_idx, count(*)::BIGINT AS n, min(o_orderkey) AS first_key FROM
  (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS pos FROM orders) GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY chunk_idx, barcode) - 1 AS seq_no, barcode, chunk_idx, n, first_key FROM c""")
def rechunk_preserve_interleave(spark, sf):
    d = P.positions(table(spark, sf, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderkey"], group="o_orderpriority")
    c = P.chunk_table(P.chunked(d.withColumnRenamed("o_orderpriority", "barcode"), 500), "o_orderkey", ["barcode"])
    return P.small_order(c, ["chunk_idx", "barcode"]).select("seq_no", "barcode", "chunk_idx", "n", "first_key")


@query("batch_assign", """
SELECT pos // 250 AS batch, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys, max(pos) - min(pos) + 1 AS span
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) GROUP BY 1""")
def batch_assign(spark, sf):
    d = P.positions(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"]).withColumn("batch", P.batched(F.col("pos"), 250))
    return d.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), (F.max("pos") - F.min("pos") + 1).alias("span"))


@query("group_batches", """
SELECT seq // 2 AS batch, string_agg(name, ',' ORDER BY seq) AS entries FROM (SELECT n_name AS name, n_nationkey::BIGINT AS seq FROM nation) GROUP BY 1""")
def group_batches(spark, sf):
    d = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("seq")).withColumn("batch", P.batched(F.col("seq"), 2))
    d = d.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("e"))
    return d.select("batch", F.array_join(F.transform("e", lambda x: x["name"]), ",").alias("entries"))


@query("file_offsets", """
WITH f AS (SELECT event_type, count(*)::BIGINT AS cnt FROM events GROUP BY 1)
SELECT event_type, cnt, coalesce(sum(cnt) OVER (ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM f""")
def file_offsets(spark, sf):
    f = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"))
    return P.running_before(f, ["event_type"], "cnt")


@query("chunk_range_join", """
WITH f AS (SELECT event_type, count(*)::BIGINT AS cnt FROM events GROUP BY 1),
g AS (SELECT *, (sum(cnt) OVER (ORDER BY event_type) - cnt)::BIGINT AS start FROM f),
c AS (SELECT i AS chunk_idx, i * 300 AS lo, least(i * 300 + 300, t) AS hi FROM (SELECT sum(cnt)::BIGINT AS t FROM f), LATERAL (SELECT unnest(generate_series(0, (t - 1) // 300)) AS i))
SELECT chunk_idx, event_type, greatest(lo, start) - start AS src_from, least(hi, start + cnt) - greatest(lo, start) AS n FROM c JOIN g ON lo < start + cnt AND hi > start""")
def chunk_range_join(spark, sf):
    """Each file lists the chunks that it feeds, so no range join is needed."""
    f = P.running_before(table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt")), ["event_type"], "cnt")
    d = f.withColumn("chunk_idx", F.explode(F.sequence(F.expr("start div 300"), F.expr("(start + cnt - 1) div 300"))))
    lo, end = F.greatest(F.col("chunk_idx") * 300, F.col("start")), F.least(F.col("chunk_idx") * 300 + 300, F.col("start") + F.col("cnt"))
    return d.select("chunk_idx", "event_type", (lo - F.col("start")).alias("src_from"), (end - lo).alias("n"))


@query("offset_index", """
SELECT event_type, CAST(pos AS BIGINT) AS src_pos, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events) WHERE pos % 400 = 0""")
def offset_index(spark, sf):
    d = P.positions(table(spark, sf, "events").select("event_type", "event_id"), ["event_id"], group="event_type", name="src_pos")
    return d.where(F.col("src_pos") % 400 == 0).select("event_type", "src_pos", "event_id")


@query("offset_limit", f"SELECT pos, l_orderkey FROM {LINES} WHERE pos >= 1234 AND pos < 1734")
def offset_limit(spark, sf):
    d = P.positions(table(spark, sf, "lineitem").select(*LINE_ORDER), LINE_ORDER)
    return d.where((F.col("pos") >= 1234) & (F.col("pos") < 1734)).select("pos", "l_orderkey")


APPORTION = """
, t AS (SELECT *, {total}::BIGINT AS total, count(*) OVER () AS k FROM w),
f AS (SELECT *, CASE WHEN w > 0 AND floor(w * total) < 1 THEN 1 ELSE floor(w * total)::BIGINT END AS fl, w * total - floor(w * total) AS rem FROM t),
g AS (SELECT *, total - sum(fl) OVER () AS gap, row_number() OVER (ORDER BY rem DESC, idx) AS r, coalesce(sum(greatest(fl - 1, 0)) OVER (ORDER BY fl DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM f)
SELECT idx, name, (CASE WHEN k = 1 THEN total WHEN gap > 0 THEN fl + (r <= gap)::INT ELSE fl - least(greatest(fl - 1, 0), greatest(-gap - prior, 0)) END)::BIGINT AS n FROM g"""
SEGMENTS = "WITH c AS (SELECT c_mktsegment AS name, count(*)::DOUBLE AS x FROM customer GROUP BY 1), w AS (SELECT row_number() OVER (ORDER BY name) - 1 AS idx, name, x / (SELECT sum(x) FROM c) AS w FROM c)"


def segments(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    return P.small_order(P.renormalised(c, "x", name="w"), ["name"], "idx").select("idx", "name", "w")


def nations(spark, sf, w):
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("idx"), F.col("n_name").alias("name"), w.alias("w"))


@query("apportion_equal", "WITH w AS (SELECT n_nationkey::BIGINT AS idx, n_name AS name, (1 / 25.0)::DOUBLE AS w FROM nation)" + APPORTION.format(total=1013))
def apportion_equal(spark, sf):
    return P.apportioned(nations(spark, sf, F.lit(1 / 25.0)), F.lit(1013)).select("idx", "name", "n")


@query("apportion_weighted", SEGMENTS + APPORTION.format(total=10007))
def apportion_weighted(spark, sf):
    return P.apportioned(segments(spark, sf), F.lit(10007)).select("idx", "name", "n")


SKEW = "WITH w AS (SELECT n_nationkey::BIGINT AS idx, n_name AS name, (CASE WHEN n_nationkey = 3 THEN 0.976::DOUBLE ELSE 0.001::DOUBLE END) AS w FROM nation)"


@query("apportion_min_one", SKEW + APPORTION.format(total=100))
def apportion_min_one(spark, sf):
    return P.apportioned(nations(spark, sf, F.when(F.col("n_nationkey") == 3, 0.976).otherwise(0.001)), F.lit(100)).select("idx", "name", "n")


@query("apportion_surplus", "WITH w AS (SELECT n_nationkey::BIGINT AS idx, n_name AS name, (CASE WHEN n_nationkey < 2 THEN 0.4885::DOUBLE ELSE 0.001::DOUBLE END) AS w FROM nation)" + APPORTION.format(total=40))
def apportion_surplus(spark, sf):
    return P.apportioned(nations(spark, sf, F.when(F.col("n_nationkey") < 2, 0.4885).otherwise(0.001)), F.lit(40)).select("idx", "name", "n")


@query("renormalize", """
WITH s AS (SELECT s_nationkey, count(*)::BIGINT AS n FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY 1)
SELECT s_nationkey, n, round(n / sum(n) OVER (), 9) AS share FROM s""")
def renormalize(spark, sf):
    kept = table(spark, sf, "nation").where("n_regionkey < 3")
    s = table(spark, sf, "supplier").join(kept, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return P.renormalised(s, "n").select("s_nationkey", "n", F.round("share", 9).alias("share"))


@query("abundance_check", """
SELECT round(sum(w), 6) AS total, abs(sum(w) - 1) <= 0.01 AS valid FROM (SELECT count(*)::DOUBLE / (SELECT count(*) FROM customer) AS w FROM customer GROUP BY c_mktsegment)""")
def abundance_check(spark, sf):
    total = F.sum("w")
    return segments(spark, sf).agg(F.round(total, 6).alias("total"), (F.abs(total - 1) <= 0.01).alias("valid"))


@query("reads_cascade", """
WITH p AS (SELECT p_brand, count(*)::BIGINT AS n FROM part GROUP BY 1), f AS (SELECT p_brand, n, unnest(generate_series(0, greatest(1, ceil(n / 30.0)::BIGINT) - 1)) AS file_index FROM p)
SELECT p_brand, file_index, least(30, n - file_index * 30)::BIGINT AS read_count FROM f""")
def reads_cascade(spark, sf):
    p = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return P.cascaded(p, "n", 30).select("p_brand", "file_index", "read_count")


@query("mixed_file_plan", SEGMENTS + """
, files AS (SELECT unnest(generate_series(0, 10)) AS file_index), t AS (SELECT file_index, idx, name, w, least(97, 1013 - file_index * 97)::BIGINT AS total FROM files, w),
f AS (SELECT *, CASE WHEN w > 0 AND floor(w * total) < 1 THEN 1 ELSE floor(w * total)::BIGINT END AS fl, w * total - floor(w * total) AS rem FROM t),
g AS (SELECT *, total - sum(fl) OVER (PARTITION BY file_index) AS gap, row_number() OVER (PARTITION BY file_index ORDER BY rem DESC, idx) AS r, coalesce(sum(greatest(fl - 1, 0)) OVER (PARTITION BY file_index ORDER BY fl DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM f)
SELECT * FROM (SELECT file_index::BIGINT AS file_index, name, (CASE WHEN gap > 0 THEN fl + (r <= gap)::INT ELSE fl - least(greatest(fl - 1, 0), greatest(-gap - prior, 0)) END)::BIGINT AS n FROM g) WHERE n > 0""")
def mixed_file_plan(spark, sf):
    """1013 reads in files of 97, each apportioned by itself. Weights are a dimension, files a plan: their pairs are the plan's rows."""
    w = segments(spark, sf)
    files = w.select("*", F.lit(1013).cast("bigint").alias("reads"))
    d = P.cascaded(files, "reads", 97)
    return P.apportioned(d, F.col("read_count"), by=["file_index"]).where("n > 0").select("file_index", "name", "n")


@query("stratified_rounds", """
WITH b AS (SELECT o_orderstatus AS barcode, count(*)::BIGINT AS n FROM orders GROUP BY 1), f AS (SELECT barcode, unnest(generate_series(0, greatest(1, ceil(n / 700.0)::BIGINT) - 1)) AS file_index FROM b),
u AS (SELECT *, ('0x' || substr(md5(concat_ws(':', 'rounds', file_index, barcode)), 1, 8))::BIGINT / 4294967296.0 AS u FROM f)
SELECT row_number() OVER (ORDER BY file_index, u, barcode) - 1 AS seq_no, barcode, file_index::BIGINT AS file_index FROM u""")
def stratified_rounds(spark, sf):
    b = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("barcode")).agg(F.count(F.lit(1)).alias("n"))
    return P.rounds(P.cascaded(b, "n", 700), "file_index", "barcode", "rounds").select("seq_no", "barcode", "file_index")


@query("max_rounds", "SELECT max(n)::BIGINT AS rounds FROM (SELECT ceil(count(*) / 700.0) AS n FROM orders GROUP BY o_orderstatus)")
def max_rounds(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.ceil(F.count(F.lit(1)) / 700).alias("n")).agg(F.max("n").cast("bigint").alias("rounds"))


@query("first_seen_groups", """
SELECT o_orderpriority AS barcode, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS seen FROM orders GROUP BY 1""")
def first_seen_groups(spark, sf):
    first = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("barcode")).agg(F.min("o_orderkey").alias("k"))
    return P.small_order(first, ["k"], "seen").select("barcode", "seen")


@query("union_pool", """
WITH p AS (SELECT 'orders' AS src, o_orderkey AS k FROM orders UNION ALL SELECT 'events', event_id FROM events)
SELECT pos // 900 AS chunk_idx, count(*)::BIGINT AS n, sum(k)::BIGINT AS keys FROM (SELECT *, row_number() OVER (ORDER BY src, k) - 1 AS pos FROM p) GROUP BY 1""")
def union_pool(spark, sf):
    o = table(spark, sf, "orders").select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("k"))
    pool = o.unionByName(table(spark, sf, "events").select(F.lit("events").alias("src"), F.col("event_id").alias("k")))
    return P.chunked(P.positions(pool, ["src", "k"]), 900).groupBy("chunk_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))


@query("mixed_shuffle", """
WITH m AS (SELECT o_orderstatus AS genome, o_orderkey AS k, ('0x' || substr(md5(concat_ws(':', 'mix', o_orderkey)), 1, 8))::BIGINT AS u FROM orders)
SELECT row_number() OVER (ORDER BY u, k) - 1 AS pos, genome, k FROM m""")
def mixed_shuffle(spark, sf):
    from readloom.functions.rng import uniform

    d = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("genome"), F.col("o_orderkey").alias("k"))
    return P.positions(d.withColumn("u", uniform("mix", F.col("k"))), ["u", "k"]).select("pos", "genome", "k")


@query("per_barcode_counts", "SELECT o_orderpriority AS barcode, count(*)::BIGINT AS reads, count(DISTINCT o_custkey)::BIGINT AS sources FROM orders GROUP BY 1")
def per_barcode_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("barcode")).agg(F.count(F.lit(1)).alias("reads"), F.countDistinct("o_custkey").alias("sources"))


@query("strict_count", "SELECT o_orderstatus, count(*)::BIGINT AS lines, (count(*) // 4)::BIGINT AS reads, count(*) % 4 = 0 AS whole FROM orders GROUP BY 1")
def strict_count(spark, sf):
    n = F.count(F.lit(1))
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(n.alias("lines"), F.floor(n / 4).cast("bigint").alias("reads"), (n % 4 == 0).alias("whole"))


@query("top_per_file", """
SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 25""")
def top_per_file(spark, sf):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("r", F.row_number().over(w)).where("r <= 25").select("o_orderpriority", "o_orderkey")
