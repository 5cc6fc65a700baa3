"""Literal vectors and invariants of the operators."""

import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from readloom import catalog
from readloom.functions import naming, sequences
from readloom.functions.rng import adler32, lognormal_parameters, uniform
from readloom.operators import generating, quality, resolving, timing
from readloom.operators import planning as P
from readloom.sources import fastq, sinks
from readloom.streaming import delivery


def apportion(spark, total, weights):
    if not weights:
        return []
    d = P.apportioned(spark.createDataFrame(list(enumerate(weights)), "idx int, w double"), F.lit(total))
    return [r["n"] for r in d.orderBy("idx").collect()]


@pytest.mark.parametrize("total, weights, want", [
    (100, [1.0], [100]), (100, [0.5, 0.5], [50, 50]), (9, [1 / 3] * 3, [3, 3, 3]), (1000, [0.9, 0.1], [900, 100]), (100, [0.7, 0.2, 0.1], [70, 20, 10]),
    (10, [0.46, 0.46, 0.08], [4, 4, 2]), (1000, [0.495, 0.495], [496, 496]),
])
def test_apportion_vectors(spark, total, weights, want):
    assert apportion(spark, total, weights) == want


@pytest.mark.parametrize("total", [4, 7, 100, 999, 10000])
def test_apportion_sums(spark, total):
    assert sum(apportion(spark, total, [0.5, 0.3, 0.15, 0.05])) == total


def test_apportion_gives_each_weight_one(spark):
    assert min(apportion(spark, 1, [0.25] * 4)) >= 1
    got = apportion(spark, 10, [0.99, 0.01])
    assert got[1] >= 1 and sum(got) == 10


def test_positions_over_partitions_and_ties(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 3).cast("string").alias("g"), F.lit("x" * 10).alias("more")).repartition(13)
    got = P.positions(d, ["k"]).collect()
    assert all(r["k"] == r["pos"] for r in got) and len(got) == 1000
    by = P.positions(d, ["k"], group="g").groupBy("g").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.countDistinct("pos").alias("n")).collect()
    assert all(r["a"] == 0 and r["b"] == r["n"] - 1 for r in by)


def test_positions_keep_null_groups_and_empty_tables(spark):
    d = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "k int, g string")
    assert {(r["k"], r["pos"]) for r in P.positions(d, ["k"], group="g").collect()} == {(1, 0), (3, 1), (2, 0)}
    assert P.positions(d.limit(0), ["k"]).count() == 0


def test_cascade_and_batches(spark):
    d = P.cascaded(spark.createDataFrame([("a", 250), ("b", 0)], "g string, n long"), "n", 100).orderBy("g", "file_index").collect()
    assert [(r["g"], r["read_count"]) for r in d] == [("a", 100), ("a", 100), ("a", 50), ("b", 0)]
    assert [r[0] for r in spark.range(5).select(P.batched(F.col("id"), 2)).collect()] == [0, 0, 1, 1, 2]


def test_rounds_hold_every_barcode(spark):
    plan = spark.createDataFrame([(b, i) for b in "xyz" for i in range(4)], "b string, i long")
    d = P.rounds(plan, "i", "b", "s").orderBy("seq_no").collect()
    assert [r["i"] for r in d] == sorted(r["i"] for r in d)
    assert all({r["b"] for r in d[3 * i : 3 * i + 3]} == set("xyz") for i in range(4))


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_sequence_functions(spark):
    assert one(spark, *[sequences.reverse_complement(F.lit(s)) for s in ("ACGT", "AAAA", "GCTA", "acgtNX")]) == ["ACGT", "TTTT", "TAGC", "XNacgt"]
    assert one(spark, sequences.phred_char(F.lit(-3)), sequences.phred_char(F.lit(20.9)), sequences.phred_char(F.lit(99))) == ["!", "5", "I"]


def test_people_numbers(spark):
    assert one(spark, *[naming.human_bytes(F.lit(n)) for n in (500, 1024, 0, 831744)]) == ["500.0 B", "1.0 KB", "0.0 B", "812.2 KB"]
    assert one(spark, *[naming.human_time(F.lit(n)) for n in (30, 90, 7200)]) == ["30.0s", "1.5m", "2.0h"]


def test_names(spark):
    names = ["a.fastq", "b.FQ.gz", "._a.fastq", "_b.fastq", "x.txt"]
    assert one(spark, *[naming.is_sequencing_file(F.lit(n)) for n in names]) == [True, True, False, True, False]
    assert one(spark, *[naming.is_barcode(F.lit(n)) for n in ("barcode01", "BC7", "unclassified", "barcode", "xbarcode01")]) == [True, True, True, False, False]
    assert one(spark, *[naming.is_accession(F.lit(n)) for n in ("GCF_000006765.1", "GCA_000006765", "gcf_000006765.1", "")]) == [True, False, False, False]
    assert one(spark, naming.numbered(F.lit("s"), "chunk", F.lit(7), F.lit(".fastq")), naming.barcode_name(F.lit(0))) == ["s_chunk_0007.fastq", "barcode01"]
    assert naming.barcode_names("bc{:03d}", 2) == ["bc001", "bc002"]
    for bad in ("same", "{x}", "{:q}"):
        with pytest.raises(ValueError):
            naming.barcode_names(bad, 2)


def test_adler(spark):
    paths = ["/x/out", "", "a", "é/ü", "x" * 300]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", adler32(F.col("p")).alias("a")).collect()
    assert {r["p"]: r["a"] for r in got} == {p: zlib.adler32(p.encode()) for p in paths}


def test_uniform_is_reproducible(spark):
    d = spark.range(100).select("id", uniform("s", F.col("id")).alias("u"))
    assert sorted(d.collect()) == sorted(spark.range(100).repartition(7).select("id", uniform("s", F.col("id")).alias("u")).collect())
    assert lognormal_parameters(5, 0) == (pytest.approx(1.6094379), 0.0)


def test_timing(spark):
    d = spark.range(2000).select(F.col("id").alias("batch"), uniform("a", F.col("id")).alias("u"), uniform("b", F.col("id")).alias("v"))
    r = d.select(F.avg(timing.random_interval(2.0, F.col("u"))), F.min(timing.random_interval(2.0, F.col("u"))), F.max(timing.random_interval(2.0, F.col("u"))), F.avg(timing.burst_interval(2.0, F.col("u"), F.col("v")))).first()
    assert abs(r[0] - 2) < 0.05 and 1.4 <= r[1] <= r[2] <= 2.6 and abs(r[3] - 2 * (0.9 + 0.1 / 5)) < 0.2
    a = timing.schedule(timing.adaptive_intervals(d.where("batch < 30"), 1.5)).orderBy("batch").collect()
    assert a[0]["emit_offset_s"] == 0 and len(a) == 30 and all(x["interval_s"] >= 0 for x in a)
    assert [at for _, at in delivery.paced([(0, 1.0), (1, 2.0), (2, 9.0)])] == [0.0, 1.0, 3.0]


def test_adaptive_matches_a_loop(spark):
    import math

    us = [0.1, 0.5, 0.9, 0.3, 0.7, 0.2]
    d = spark.createDataFrame(list(enumerate(us)), "batch int, u double")
    got = [r["interval_s"] for r in timing.adaptive_intervals(d, 2.0, rate=0.2, history=3).orderBy("batch").collect()]
    mean, past, want = 2.0, [], []
    for u in us:
        want.append(-math.log(1 - u) * mean)
        past = (past + want[-1:])[-3:]
        if len(past) > 1:
            mean = 0.8 * mean + 0.2 * sum(past) / len(past)
    assert got == pytest.approx(want)


def test_adaptive_schedules_are_whole_and_fold_in_blocks(spark):
    import math

    rows = [(g, b, (b * 37 + len(g or "") * 11 + 5) % 97 / 100) for g, n in (("a", 31), ("bb", 8), (None, 3)) for b in range(n)]
    d = spark.createDataFrame(rows, "g string, batch int, u double")
    for history in (1, 3, 10):
        got = {(r["g"], r["batch"]): r["interval_s"] for r in timing.adaptive_intervals(d, 2.0, history=history, by=["g"], block=4).collect()}
        assert len(got) == len(rows)
        for g in ("a", "bb", None):
            mean, past = 2.0, []
            for _, b, u in (r for r in rows if r[0] == g):
                v = -math.log(1 - u) * mean
                assert got[g, b] == pytest.approx(v)
                past = (past + [v])[-history:]
                if len(past) > 1:
                    mean = 0.9 * mean + 0.1 * sum(past) / len(past)


def test_timing_adaptive_has_every_batch(spark, tmp_path):
    from readloom.plans.registry import QUERIES

    spark.range(0, 100_000, 100).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r["batch"] for r in QUERIES["timing_adaptive"](spark, str(tmp_path)).collect()) == list(range(200))


def test_generated_reads(spark):
    g = spark.createDataFrame([("a", "ACGT" * 1500, 120), ("b", "GGCCAATT" * 20, 30), ("none", "", 5)], "genome string, seq string, n long")
    d = generating.generate(g, per_file=50, mean_length=300, std_length=100, min_length=50, seed=1)
    rows = d.collect()
    whole = {"a": "ACGT" * 1500, "b": "GGCCAATT" * 20}
    back = str.maketrans("ACGTN", "TGCAN")
    assert len(rows) == 150 and {r["genome"] for r in rows} == {"a", "b"}
    for r in rows:
        assert len(r["seq"]) == len(r["qual"]) and 50 <= len(r["seq"]) <= len(whole[r["genome"]])
        assert r["seq"] in whole[r["genome"]] or r["seq"].translate(back)[::-1] in whole[r["genome"]]
        assert all(33 <= ord(c) <= 73 for c in r["qual"])
    assert sorted(rows) == sorted(generating.generate(g.repartition(5), per_file=50, mean_length=300, std_length=100, min_length=50, seed=1).collect())


def test_resolving(spark):
    rows = spark.createDataFrame([("D6305",), ("msa-1002",), ("eskape",), ("?",)], "key string")
    d = resolving.by_alias(rows, "key", catalog.aliases(spark), catalog.communities(spark))
    assert {r["key"]: r["canonical"] for r in d.collect()} == {"D6305": "zymo_d6300", "msa-1002": "atcc_msa1002", "eskape": "eskape", "?": None}
    tax = lambda *x: F.array(*map(F.lit, x)).cast("array<int>")
    n = F.lit("Thing")
    assert one(spark, resolving.domain_of(tax(1, 2), n), resolving.domain_of(tax(2157), n), resolving.domain_of(tax(2759), n), resolving.domain_of(tax(), F.lit("Candida albicans")), resolving.domain_of(tax(), n)) == ["bacteria", "archaea", "eukaryota", "eukaryota", "bacteria"]


def test_catalogue(spark):
    assert catalog.communities(spark).count() == 15 and catalog.aliases(spark).count() == 15
    assert catalog.organisms(spark).groupBy("community").agg(F.abs(F.sum("abundance") - 1).alias("d")).where("d > 0.01").count() == 0
    assert catalog.profile("bursty", batch_size=9)["batch_size"] == 9 and "read_count" not in catalog.profile("steady")
    with pytest.raises(ValueError):
        catalog.profile("nope")


def test_progress_and_runs(spark):
    p = lambda d: one(spark, *quality.progress(F.lit(d), F.lit(10), F.lit(20.0)))
    assert p(0)[2] is None and p(10)[2] == 0.0 and p(5)[2] == 20.0
    d = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "a")], "i int, b string").withColumn("g", F.lit(1))
    r = quality.interleaving(d, "b", ["i"], ["g"]).first()
    assert (r["max_run"], r["transitions"], r["buckets"]) == (2, 2, 2)


def test_fastq_files(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1\nAC\n+\n@I\n@r2\nGT\n+\nII\n")
    with gzip.open(tmp_path / "_b.fastq.gz", "wt") as f:
        f.write("@r3\nAC\n+\nII\n@cut\nAC\n+\n")
    (tmp_path / "empty.fq").write_text("")
    (tmp_path / ".hidden.fastq").write_text("@x\nA\n+\nI\n")
    files = [p for _, p in fastq.listing(str(tmp_path))]
    assert [p.rsplit("/", 1)[1] for p in files] == ["_b.fastq.gz", "a.fastq", "empty.fq"]
    got = fastq.scan(spark, [p for p in files if not p.endswith("_b.fastq.gz")])
    assert sorted((r["header"], r["seq"], r["qual"], r["src_pos"]) for r in got.collect()) == [("@r1", "AC", "@I", 0), ("@r2", "GT", "II", 1)]
    assert fastq.layout(str(tmp_path)) == "singleplex"
    (tmp_path / "barcode02").mkdir()
    assert fastq.layout(str(tmp_path)) == "singleplex"
    (tmp_path / "barcode02" / "c.fastq").write_text("@r\nA\n+\nI\n")
    assert fastq.listing(str(tmp_path)) == [("barcode02", str(tmp_path / "barcode02" / "c.fastq"))]


def test_fasta(spark, tmp_path):
    p = tmp_path / "g.fa"
    p.write_text("junk\n>chr1 first\nacgt\nACGT\n\n>chr2\nTT\n")
    c = fastq.scan_fasta(spark, str(p))
    assert [(r["contig"], r["seq"]) for r in c.orderBy("contig_pos").collect()] == [("chr1", "ACGTACGT"), ("chr2", "TT")]
    assert fastq.genomes(c).first()["seq"] == "ACGTACGTTT"


@pytest.mark.parametrize("shape", ["flat", "barcoded", "preserve"])
@pytest.mark.parametrize("ext", [".fastq", ".fastq.gz"])
def test_reshape_keeps_every_read(spark, tmp_path, shape, ext):
    reads = spark.createDataFrame([(i, f"bc{i // 10}", f"@read{i}", "ACGT", "+", "IIII") for i in range(30)], "k int, src string, header string, seq string, sep string, qual string")
    d = P.chunked(P.positions(reads, ["k"], group="src" if shape == "preserve" else None), 7)
    sub = F.lit("") if shape == "flat" else F.concat(naming.barcode_name(F.pmod("chunk_idx", F.lit(3))), F.lit("/")) if shape == "barcoded" else F.concat(F.regexp_replace("src", "bc", "barcode0"), F.lit("/"))
    d = d.withColumn("target", F.concat(F.lit(f"{tmp_path}/"), sub, naming.numbered(F.lit("s"), "chunk", F.col("chunk_idx"), F.lit(ext))))
    made = sinks.write_fastq(d).collect()
    assert sum(r["reads"] for r in made) == 30 and max(r["reads"] for r in made) <= 7
    files = [p for _, p in fastq.listing(str(tmp_path))]
    back = fastq.scan(spark, files)
    assert sorted(r["header"] for r in back.collect()) == sorted(f"@read{i}" for i in range(30))
    assert not list(tmp_path.rglob("*.tmp"))


def test_strict_count(spark, tmp_path):
    p = tmp_path / "a.fastq"
    p.write_text("@r1\nAC\n+\nII\n")
    assert fastq.strict_counts(spark, str(p)).first()["reads"] == 1
    p2 = tmp_path / "b.fastq"
    p2.write_text("@r1\nAC\n+\n")
    with pytest.raises(Exception, match="multiple of four"):
        fastq.strict_counts(spark, str(p2)).collect()
