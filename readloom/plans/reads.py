"""Simulated reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions import sequences as S
from readloom.functions.rng import uniform
from readloom.operators import generating
from readloom.plans.registry import query, table

U = "('0x' || substr(md5(concat_ws(':', '{}', doc_id)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
LENGTH = f"least(greatest(trunc(exp(ln(40000.0::DOUBLE / sqrt(50000.0::DOUBLE)) + sqrt(ln(1.25::DOUBLE)) * sqrt(-2 * ln(1 - {U.format('a')})) * cos(2 * pi() * {U.format('b')})))::BIGINT, 50), n_chars)"


@query("lognormal_lengths", f"SELECT doc_id, {LENGTH} AS read_length FROM documents")
def lognormal_lengths(spark, sf):
    """Mean 200, deviation 100, at least 50."""
    d = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", S.read_length(uniform("a", d), uniform("b", d), 200, 100, 50, F.col("n_chars")).alias("read_length"))


@query("read_sampling", f"""
WITH l AS (SELECT doc_id, text, n_chars, {LENGTH} AS len FROM documents), s AS (SELECT *, floor({U.format('s')} * (n_chars - len + 1))::BIGINT AS start FROM l)
SELECT doc_id, start, len, {U.format('f')} < 0.5 AS flipped, md5(CASE WHEN {U.format('f')} < 0.5 THEN reverse(translate(substr(text, start + 1, len), 'ACGTNacgtn', 'TGCANtgcan')) ELSE substr(text, start + 1, len) END) AS seq_md5 FROM s""")
def read_sampling(spark, sf):
    d = F.col("doc_id")
    rows = table(spark, sf, "documents").withColumn("len", S.read_length(uniform("a", d), uniform("b", d), 200, 100, 50, F.col("n_chars")))
    rows = rows.withColumn("start", S.start_of(uniform("s", d), F.col("n_chars"), F.col("len"))).withColumn("flipped", uniform("f", d) < 0.5)
    piece = S.piece(F.col("text"), F.col("start"), F.col("len"))
    return rows.select("doc_id", "start", "len", "flipped", F.md5(F.encode(F.when(F.col("flipped"), S.reverse_complement(piece)).otherwise(piece), "UTF-8")).alias("seq_md5"))


@query("phred_encode", "SELECT doc_id, repeat(chr((least(greatest(doc_id % 60 - 5, 0), 40) + 33)::INT), (n_chars % 20 + 1)::BIGINT) AS qual, 'doc' || doc_id || '_read_' || n_chars AS read_id FROM documents")
def phred_encode(spark, sf):
    q = S.phred_char(F.col("doc_id") % 60 - 5)
    return table(spark, sf, "documents").select("doc_id", F.repeat(q, (F.col("n_chars") % 20 + 1).cast("int")).alias("qual"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("_read_"), F.col("n_chars").cast("string")).alias("read_id"))


@query("generate_reads", None)
def generate_reads(spark, sf):
    """Reads from documents as genomes: as many as n_chars div 100 of each, in files of 50."""
    genomes = table(spark, sf, "documents").where("n_chars >= 50").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("genome"), F.col("text").alias("seq"), F.expr("n_chars div 100 + 1").alias("n"))
    reads = generating.generate(genomes, per_file=50, mean_length=200, std_length=100, min_length=50, seed=3)
    return reads.select("genome", "file_index", "read_no", "header", F.length("seq").alias("len"), F.length("qual").alias("qlen"))
