"""Captured assembly reports, generator registry, stream progress."""

import math
import zlib

import pytest
from pyspark.sql import functions as F

from readloom.functions.rng import adler32
from readloom.operators import generating, resolving
from readloom.sources import fastq
from readloom.streaming import delivery
from readloom.streaming.progress import Progress


def test_assemblies(spark):
    lines = [
        '{"accession":"GCF_1","assembly_info":{"assembly_level":"Scaffold"},"organism":{"organism_name":"X","lineage":[{"tax_id":1},{"tax_id":2157}]}}',
        '{"accession":"GCF_2","assembly_info":{"assembly_level":"Complete Genome"},"organism":{"organism_name":"X","lineage":[1, 2759]}}',
        '{"accession":"GCF_3","organism":{"organism_name":"Candida x"}}', '{"no":1}', "bad {",
    ]
    d = resolving.assemblies(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r["accession"]: (r["rank"], r["domain"]) for r in d.collect()}
    assert got == {"GCF_1": (2, "archaea"), "GCF_2": (0, "eukaryota"), "GCF_3": (3, "eukaryota")}
    assert resolving.best_of(d, ["name"], ["rank", "accession"]).where(F.col("name") == "X").first()["accession"] == "GCF_2"


def test_generators():
    assert generating.backend() is generating.generate is generating.backend("builtin")
    generating.BACKENDS["other"] = (lambda: True, print)
    try:
        assert generating.backend() is print
    finally:
        del generating.BACKENDS["other"]
    with pytest.raises(ValueError):
        generating.backend("other")


def test_progress():
    now = [0.0]
    told = []
    p = Progress(10, told.append, lambda: now[0])
    assert p.eta is None and p.percent == 0.0
    now[0] = 2.0
    p.add(5)
    assert (p.percent, p.rate, p.eta) == (50.0, 2.5, 2.0) and len(told) == 1
    p.add(5)
    assert p.eta == 0.0


def test_delivery_to_a_stream(spark, tmp_path):
    d = spark.range(40).select("id", (F.col("id") % 4).alias("batch"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"))
    done = delivery.deliver(d, str(tmp_path / "in"), [(b, 1.0) for b in range(4)])
    assert [at for _, at in done] == [0.0, 1.0, 2.0, 3.0]
    stream = delivery.windowed(delivery.arrivals(spark, str(tmp_path / "in"), d.schema, 2), "ts", late="2 hours")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.sql("select n from w order by w").collect()] == [10] * 4


def test_lineages_of_mixed_elements(spark):
    lines = ['{"accession":"A1","assembly_info":{"assembly_level":"Chromosome"},"organism":{"organism_name":"strain [1,2]","lineage":[1,{"tax_id":2157,"n":"x"}]}}', '{"accession":"A2","organism":{"organism_name":null},"classification":{"lineage":[2759,"x"]}}', "bad", '{"accession":null}']
    got = {r["accession"]: (r["name"], r["taxids"], r["rank"], r["domain"]) for r in resolving.assemblies(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {"A1": ("strain [1,2]", [1, 2157], 1, "archaea"), "A2": ("", [2759, None], 3, "eukaryota")}


def test_qualities_by_hand(spark):
    rows = [(i, "ACGT" * (i % 7)) for i in range(60)] + [(60, "A" * 5000)]
    d = spark.createDataFrame(rows, "k long, seq string").withColumn("key", F.xxhash64("k"))
    keys = {r["k"]: r["key"] for r in d.collect()}
    mask = 2**64 - 1

    def one(key, i):
        z = (key % 2**64 + (i + 1) * 0x9E3779B97F4A7C15) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        z ^= z >> 31
        n = math.sqrt(-2 * math.log1p(-(z >> 32) / 2**32)) * math.cos(2 * math.pi * (z & 0xFFFFFFFF) / 2**32)
        return min(max(20 + 4 * n, 0), 40)

    for held in (50, 1_000_000):
        got = {r["k"]: (r["seq"], r["qual"]) for r in generating.with_qualities(d, "key", 20.0, 4.0, held).collect()}
        assert {k: s for k, (s, _) in got.items()} == dict(rows)
        for k, (s, q) in got.items():
            assert len(q) == len(s) and all(abs(ord(c) - 33 - (x := one(keys[k], i)) + 0.5) <= 0.5 + 1e-6 for i, c in enumerate(q))
    q = [ord(c) - 33 + 0.5 for c in got[60][1]]
    assert abs(sum(q) / 5000 - 20) < 0.3 and abs((sum((x - 20) ** 2 for x in q) / 5000) ** 0.5 - 4) < 0.2


def test_adler(spark):
    texts = ["", "a", "/x/out", "é\U0001f9ec" * 300]
    got = {r["t"]: r["a"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", adler32(F.col("t")).alias("a")).collect()}
    assert got == {t: zlib.adler32(t.encode()) for t in texts}


def test_genome_folders(tmp_path):
    for n in ("b.fna", "a.fasta.gz", "c.txt"):
        (tmp_path / n).write_text(">x\nACGT\n")
    (tmp_path / "sub.fa").mkdir()
    assert fastq.genome_files(str(tmp_path)) == [str(tmp_path / "a.fasta.gz"), str(tmp_path / "b.fna")]
    assert fastq.genome_files(str(tmp_path / "c.txt")) == [str(tmp_path / "c.txt")]
    for bad in ("none", "sub.fa"):
        with pytest.raises(ValueError):
            fastq.genome_files(str(tmp_path / bad))
