"""File names, predicates and numbers meant for people."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions import naming as N
from readloom.functions import sequences as S
from readloom.functions.rng import adler32
from readloom.plans.registry import query, table


@query("revcomp", "SELECT p_partkey, reverse(translate(p_name, 'ACGTNacgtn', 'TGCANtgcan')) AS rc FROM part")
def revcomp(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.reverse_complement(F.col("p_name")).alias("rc"))


@query("translate_upper", "SELECT doc_id, upper(replace(split_part(trim(text), ' ', 1), 'ß', 'ss')) AS first_word, concat_ws('', lang, ':', source) AS joined FROM documents")
def translate_upper(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.words_upper(F.col("text")).alias("first_word"), F.concat_ws("", "lang", F.lit(":"), "source").alias("joined"))


@query("substr_slice", "SELECT doc_id, substr(text, (doc_id % 40 + 1)::BIGINT, (doc_id % 17 + 3)::BIGINT) AS piece FROM documents")
def substr_slice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.piece(F.col("text"), F.col("doc_id") % 40, F.col("doc_id") % 17 + 3).alias("piece"))


FILES = "(SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN p_name || '.fastq' WHEN 1 THEN p_name || '.FQ.gz' WHEN 2 THEN '.' || p_name || '.fastq' WHEN 3 THEN p_name || '.txt' WHEN 4 THEN 'barcode' || p_partkey WHEN 5 THEN 'BC' || p_partkey WHEN 6 THEN '_' || p_name || '.fq' ELSE 'unclassified' END AS name FROM part)"


def file_names(spark, sf):
    p, k = F.col("p_name"), F.col("p_partkey")
    n = F.when(k % 8 == 0, F.concat(p, F.lit(".fastq"))).when(k % 8 == 1, F.concat(p, F.lit(".FQ.gz"))).when(k % 8 == 2, F.concat(F.lit("."), p, F.lit(".fastq"))).when(k % 8 == 3, F.concat(p, F.lit(".txt")))
    n = n.when(k % 8 == 4, F.concat(F.lit("barcode"), k.cast("string"))).when(k % 8 == 5, F.concat(F.lit("BC"), k.cast("string"))).when(k % 8 == 6, F.concat(F.lit("_"), p, F.lit(".fq"))).otherwise("unclassified")
    return table(spark, sf, "part").select(k.alias("id"), n.alias("name"))


@query("stem_ext", f"""
SELECT id, regexp_replace(name, '(?i)\\.(fastq|fq)(\\.gz)?$', '') AS stem, CASE WHEN suffix(name, '.gz') THEN '.fastq.gz' ELSE '.fastq' END AS ext FROM {FILES}""")
def stem_ext(spark, sf):
    n = F.col("name")
    return file_names(spark, sf).select("id", N.stem(n).alias("stem"), N.extension(n).alias("ext"))


@query("barcode_regex", f"SELECT id, name, regexp_matches(name, '(?i)^(barcode[0-9]+|bc[0-9]+|unclassified)$') AS is_barcode FROM {FILES}")
def barcode_regex(spark, sf):
    return file_names(spark, sf).select("id", "name", N.is_barcode(F.col("name")).alias("is_barcode"))


@query("accession_regex", """
SELECT id, a, regexp_matches(a, '^GC[AF]_[0-9]{9}\\.[0-9]+$') AS valid FROM (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN printf('GCF_%09d.1', p_partkey) WHEN 1 THEN printf('GCA_%09d.12', p_partkey) WHEN 2 THEN printf('gcf_%09d.1', p_partkey) ELSE printf('GCF_%08d', p_partkey) END AS a FROM part)""")
def accession_regex(spark, sf):
    k = F.col("p_partkey")
    a = F.when(k % 4 == 0, F.format_string("GCF_%09d.1", k)).when(k % 4 == 1, F.format_string("GCA_%09d.12", k)).when(k % 4 == 2, F.format_string("gcf_%09d.1", k)).otherwise(F.format_string("GCF_%08d", k))
    return table(spark, sf, "part").select(k.alias("id"), a.alias("a")).withColumn("valid", N.is_accession(F.col("a")))


@query("glob_match", f"SELECT id, name, name GLOB '*.fastq' OR name GLOB '*.fq' OR name GLOB '*.fastq.gz' OR name GLOB 'barcode?[0-4]*' AS hit FROM {FILES}")
def glob_match(spark, sf):
    from functools import reduce

    hit = reduce(lambda a, b: a | b, (F.col("name").rlike(N.glob_regex(p)) for p in ("*.fastq", "*.fq", "*.fastq.gz", "barcode?[0-4]*")))
    return file_names(spark, sf).select("id", "name", hit.alias("hit"))


@query("format_names", "SELECT doc_id, printf('%s_reads_%04d%s', source, n_chars % 12345, '.fastq.gz') AS file_name, printf('barcode%02d', doc_id % 120 + 1) AS barcode FROM documents")
def format_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.numbered(F.col("source"), "reads", F.col("n_chars") % 12345, F.lit(".fastq.gz")).alias("file_name"), N.barcode_name(F.col("doc_id") % 120).alias("barcode"))


@query("human_bytes", """
SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.1f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) ELSE printf('%.1f GB', b / 1073741824.0::DOUBLE) END AS size
FROM (SELECT doc_id, n_chars * n_chars * 16 AS b FROM documents)""")
def human_bytes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.human_bytes(F.col("n_chars") * F.col("n_chars") * 16).alias("size"))


@query("human_time", """
SELECT doc_id, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%.1fm', s / 60) ELSE printf('%.1fh', s / 3600) END AS took FROM (SELECT doc_id, (n_chars * 3 + 1)::DOUBLE AS s FROM documents)""")
def human_time(spark, sf):
    # 3n + 1 seconds are never half-way between two decimals, where engines differ
    return table(spark, sf, "documents").select("doc_id", N.human_time(F.col("n_chars") * 3 + 1).alias("took"))


@query("hidden_filter_layout", f"""
WITH f AS (SELECT name, id % 3 AS dir, regexp_matches(name, '(?i)\\.(fastq|fq)(\\.gz)?$') AND name NOT LIKE '.%' AS is_file, regexp_matches(name, '(?i)^(barcode[0-9]+|bc[0-9]+|unclassified)$') AS is_dir FROM {FILES})
SELECT dir, count_if(is_file)::BIGINT AS files, count_if(is_dir)::BIGINT AS barcodes, CASE WHEN count_if(is_dir) > 0 THEN 'multiplex' WHEN count_if(is_file) > 0 THEN 'singleplex' ELSE 'none' END AS layout FROM f GROUP BY 1""")
def hidden_filter_layout(spark, sf):
    n = F.col("name")
    d = file_names(spark, sf).select((F.col("id") % 3).alias("dir"), N.is_sequencing_file(n).alias("f"), N.is_barcode(n).alias("b"))
    files, dirs = F.count_if("f"), F.count_if("b")
    return d.groupBy("dir").agg(files.alias("files"), dirs.alias("barcodes"), F.when(dirs > 0, "multiplex").when(files > 0, "singleplex").otherwise("none").alias("layout"))


@query("path_suffix", "SELECT page_id, lower(regexp_extract(url, '([.][A-Za-z0-9]+)$', 1)) AS suffix, url LIKE '%.html' AS is_html FROM pages")
def path_suffix(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", r"(\.[A-Za-z0-9]+)$", 1)).alias("suffix"), F.col("url").endswith(".html").alias("is_html"))


ADLER = "((len(c) + list_sum(list_transform(c, lambda x, i: ascii(x) * (len(c) - i + 1)))) % 65521 * 65536 + (1 + list_sum(list_transform(c, lambda x: ascii(x)))) % 65521)::BIGINT"


@query("adler_seed", f"""
WITH p AS (SELECT c_custkey, string_split('/out/' || c_mktsegment || '/' || c_name, '') AS c FROM customer), s AS (SELECT c_custkey, {ADLER} AS seed FROM p)
SELECT seed % 64 AS slot, count(*)::BIGINT AS runs, min(seed) AS least, max(seed) AS most FROM s GROUP BY 1""")
def adler_seed(spark, sf):
    """The seeds of the customers' runs, adler32 of their paths, over 64 slots."""
    seed = adler32(F.concat(F.lit("/out/"), "c_mktsegment", F.lit("/"), "c_name"))
    d = table(spark, sf, "customer").select(seed.alias("seed"))
    return d.groupBy((F.col("seed") % 64).alias("slot")).agg(F.count(F.lit(1)).alias("runs"), F.min("seed").alias("least"), F.max("seed").alias("most"))


@query("adler_paths", f"WITH p AS (SELECT p_partkey, string_split('/runs/' || p_name || '/' || p_partkey, '') AS c FROM part) SELECT p_partkey, {ADLER} AS seed FROM p")
def adler_paths(spark, sf):
    """Seeds of runs, one a path."""
    return table(spark, sf, "part").select("p_partkey", adler32(F.concat(F.lit("/runs/"), "p_name", F.lit("/"), F.col("p_partkey").cast("string"))).alias("seed"))
