"""Files by ranges, an index that decides what is opened, and files that appear whole or not at all."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from readloom.sources import fastq, ranges, sinks, store


def text(n, seed=0, end="\n", name="r"):
    """Records of which a third have a quality line that starts as a header does, and some a plus sign there."""
    rng, out = random.Random(seed), []
    for i in range(n):
        k = rng.randrange(1, 60)
        first = rng.choice("@+I")
        out += [f"@{name}{i} x", "".join(rng.choice("ACGT") for _ in range(k)), "+", first + "".join(rng.choice("@+I!") for _ in range(k - 1))]
    return end.join(out) + end if out else ""


def records(path):
    opened = gzip.open if str(path).endswith(".gz") else open
    with opened(path, "rb") as f:
        lines = [x.rstrip("\r") for x in f.read().decode().split("\n")]
    lines = lines[:-1] if lines[-1] == "" else lines
    return [tuple(lines[i : i + 4]) for i in range(0, len(lines) - 3, 4)]


def rows(d):
    return sorted((r["src_path"].rsplit("/", 1)[1], r["src_pos"], r["header"], r["seq"], r["sep"], r["qual"]) for r in d.collect())


def want(*paths):
    return sorted((os.path.basename(p), i, *r) for p in paths for i, r in enumerate(records(p)))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("fq")
    (at / "a.fastq").write_text(text(300, 1))
    (at / "b.fastq").write_text(text(77, 2, "\r\n"))
    with gzip.open(at / "c.fastq.gz", "wt") as f:
        f.write(text(50, 3))
    with gzip.open(at / "c.fastq.gz", "at") as f:  # a second member
        f.write(text(5, 4))
    (at / "empty.fastq").write_text("")
    (at / "cut.fastq").write_text(text(9, 5)[:-3] + "\n@last\nAC\n+")
    (at / "no end.fastq").write_text(text(3, 6)[:-1])
    (at / "odd.fastq").write_text("no header\n@seq\n-\n@\n\n\n\n\n@x\nA\n+\n@@@\n")
    return [str(at / n) for n in ("a.fastq", "b.fastq", "c.fastq.gz", "empty.fastq", "cut.fastq", "no end.fastq", "odd.fastq")]


@pytest.mark.parametrize("wide", [1, 7, 100, 4099, 1 << 26])
def test_ranges_of_any_width(spark, files, wide):
    some = files[1:] if wide == 1 else files
    index = ranges.index(spark, some, wide)
    d = ranges.by_index(spark, index)
    assert rows(d) == want(*some)
    order = [(r["file_no"], r["src_pos"]) for r in d.orderBy("pos").collect()]
    assert order == [(i, k) for i, p in enumerate(some) for k in range(len(records(p)))]
    assert [r["pos"] for r in d.orderBy("pos").collect()] == list(range(len(order)))
    got = {r["src_path"]: r["reads"] for r in fastq.counts(index).collect()}
    assert got == {p: len(records(p)) for p in some}


def test_scan_chooses_ranges(spark, files):
    assert rows(fastq.scan(spark, files)) == rows(fastq.scan(spark, files, 500)) == want(*files)


def test_seven_ranges_told_by_content(spark, files):
    path = files[0]
    wide = -(-os.path.getsize(path) // 7)
    d = ranges.registered(spark).read.format("fastq").option("rangeBytes", wide).option("resync", "true").load(path)
    assert d.rdd.getNumPartitions() == 7
    assert sorted(tuple(r[c] for c in ("header", "seq", "sep", "qual")) for r in d.collect()) == sorted(records(path))
    assert d.where("src_pos is not null").count() == 0
    with pytest.raises(Exception, match="read it by an index"):
        ranges.registered(spark).read.format("fastq").option("rangeBytes", 9).option("resync", "true").load(files[-1]).collect()


def test_numbers_by_barcode(spark, files):
    index = ranges.index(spark, [("one", files[0]), ("two", files[1]), ("one", files[4])], 300)
    d = ranges.by_index(spark, index)
    for barcode, paths in (("one", [files[0], files[4]]), ("two", [files[1]])):
        got = [r["header"] for r in d.where(F.col("barcode") == barcode).orderBy("group_pos").collect()]
        assert got == [r[0] for p in paths for r in records(p)]


def test_only_what_is_asked_for_is_opened(spark, tmp_path):
    names = [str(tmp_path / f"{k}.fastq") for k in range(4)]
    for k, p in enumerate(names):
        with open(p, "w") as f:
            f.write(text(100, k, name=f"f{k}_"))
    held = str(tmp_path / "index")
    ranges.index(spark, names, 700, path=held)
    for k in (0, 1, 3):
        os.remove(names[k])
    got = fastq.between(spark, held, 230, 40).orderBy("pos").collect()
    assert [r["header"] for r in got] == [f"@f2_{i} x" for i in range(30, 70)] and [r["pos"] for r in got] == list(range(230, 270))
    d = ranges.by_index(spark, held)
    assert d.where("pos >= 230 and pos < 270").rdd.getNumPartitions() < ranges.open_index(spark, held).where("file_no = 2").count()
    assert d.where(F.col("src_path") == names[2]).count() == 100
    assert d.where("file_no = 2 and src_pos in (3, 5)").count() == 2
    assert d.where("pos = 999").count() == 0
    with pytest.raises(Exception, match="changed since it was indexed"):  # it is gone
        d.where("pos = 0").collect()
    with open(names[2], "a") as f:
        f.write("@more\nA\n+\nI\n")
    with pytest.raises(Exception, match="changed since it was indexed"):
        d.where("pos = 230").collect()


def test_paths(spark, tmp_path):
    for name in ("a b.fastq", "é[1].fastq", "x.txt", "_d.fastq", ".h.fastq"):
        (tmp_path / name).write_text(text(2))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "s.fastq").write_text(text(1))
    names = lambda p: [x.rsplit("/", 1)[1] for x, _ in store.listed(p)]
    assert names(f"{tmp_path}/*.fastq") == [".h.fastq", "_d.fastq", "a b.fastq", "é[1].fastq"]
    assert names(str(tmp_path)) == ["a b.fastq", "x.txt", "é[1].fastq"]
    assert names([f"file://{tmp_path}/é[1].fastq", f"{tmp_path}/s*/?.fastq"]) == ["é[1].fastq", "s.fastq"]
    with pytest.raises(FileNotFoundError):
        store.listed(f"{tmp_path}/none*")
    assert fastq.scan(spark, f"{tmp_path}/é[1].fastq").count() == 2


def reads(spark, n=60, bad=None):
    d = spark.range(n, numPartitions=3).select(F.col("id").alias("pos"), F.format_string("d%d/f%02d.fastq", F.col("id") % 2, (F.col("id") / 10).cast("int")).alias("target"), F.concat(F.lit("@r"), F.col("id").cast("string")).alias("header"), F.lit("AC").alias("seq"), F.lit("+").alias("sep"), F.lit("II").alias("qual"))
    return d if bad is None else d.withColumn("qual", F.when(F.col("pos") == bad, F.raise_error(F.lit("spoilt")).cast("string")).otherwise(F.col("qual")))


def found(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_files_appear_whole(spark, tmp_path):
    d = reads(spark)
    sinks.save(d, str(tmp_path))
    assert found(tmp_path) == sorted({r["target"] for r in d.collect()})
    assert [r[0] for r in records(tmp_path / "d1/f03.fastq")] == [f"@r{i}" for i in range(31, 40, 2)]
    packed = d.withColumn("target", F.lit("one.fastq.gz"))
    sinks.save(packed, str(tmp_path / "z"))
    first = (tmp_path / "z/one.fastq.gz").read_bytes()
    assert [r[0] for r in records(tmp_path / "z/one.fastq.gz")] == [f"@r{i}" for i in range(60)]
    sinks.save(packed, str(tmp_path / "z"))  # over the former, to the same bytes
    assert (tmp_path / "z/one.fastq.gz").read_bytes() == first


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    own = tmp_path / "d0" / ".other.tmp"
    own.parent.mkdir()
    own.write_text("someone else's")
    mine = tmp_path / "d0" / f".f00.fastq.{'a' * 32}-7.tmp"
    mine.write_text("another run's")
    with pytest.raises(Exception, match="spoilt"):
        sinks.save(reads(spark, bad=47), str(tmp_path))
    assert found(tmp_path) == ["d0/.f00.fastq." + "a" * 32 + "-7.tmp", "d0/.other.tmp"]
    assert store.clean(str(tmp_path)) == 1 and found(tmp_path) == ["d0/.other.tmp"]


def test_a_file_in_several_partitions_is_refused(spark, tmp_path):
    d = reads(spark).withColumn("target", F.lit("x.fastq")).select("target", "header", "seq", "sep", "qual")
    with pytest.raises(Exception, match="several partitions"):
        ranges.registered(spark)
        d.write.format("fastq").mode("append").save(str(tmp_path))
    assert found(tmp_path) == []


def test_names_are_given_later(spark, tmp_path):
    later = sinks.Later(reads(spark), str(tmp_path))
    assert all(os.path.basename(p).startswith(".") for p in found(tmp_path))
    later.publish(["d0/f00.fastq", "d0/none.fastq"])
    assert [p for p in found(tmp_path) if not os.path.basename(p).startswith(".")] == ["d0/f00.fastq", "d0/none.fastq"]
    later.close()
    assert found(tmp_path) == ["d0/f00.fastq", "d0/none.fastq"]


def test_copies(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("x" * k)
    pairs = [(str(tmp_path / f"{k}.txt"), str(tmp_path / "out" / f"{k}.txt")) for k in range(3)]
    assert sinks.copies(spark, pairs) == [(t, k) for k, (_, t) in enumerate(pairs)]
    assert sinks.copies(spark, pairs, link=True, workers=1) == [(t, k) for k, (_, t) in enumerate(pairs)]
    assert (tmp_path / "out/2.txt").is_symlink() and found(tmp_path / "out") == ["0.txt", "1.txt", "2.txt"]
    assert sinks.copies(spark, []) == []
