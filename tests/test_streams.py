"""Paced streams that are stopped and go on, states that outlive a query, batches that are given up, and signals."""

import json
import os
import signal
import threading
import time

import pytest
from pyspark.sql import functions as F

from readloom import cli, model, runs
from readloom.operators import quality, resolving
from readloom.operators.planning import before
from readloom.sources.snapshots import Snapshots
from readloom.streaming import delivery, paced, progress


def staged(spark, path, batches=20, per=5, step=0.2):
    d = spark.range(batches * per).select(F.col("id"), F.expr(f"id div {per}").alias("batch"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("string").alias("text"))
    s = spark.range(batches + 3).select(F.col("id").alias("batch"), (F.col("id") * step).alias("emit_offset_s"))  # the last ones have no rows
    paced.stage(d, s, str(path))
    return d


def started(spark, path, out, state, **options):
    return paced.play(spark, str(path), **options).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).start()


def test_stopped_in_the_middle_and_resumed(spark, tmp_path):
    d = staged(spark, tmp_path / "p", step=0.4)
    q = started(spark, tmp_path / "p", tmp_path / "out", tmp_path / "state")
    assert not paced.to_end(q, 23, stop=lambda: paced.place(q) >= 4)
    some = spark.read.parquet(str(tmp_path / "out")).count()
    assert 20 <= some < 100 and not q.isActive
    told = paced.PacedReader({"path": str(tmp_path / "p"), "clock": str(tmp_path / "p" / "clock.json")}, d.schema)
    saved = json.loads((tmp_path / "p" / "clock.json").read_text())["next"]
    time.sleep(2)  # the run's clock stands still: five more batches would be due
    assert saved <= told.latestOffset()["next"] <= saved + 1
    q = started(spark, tmp_path / "p", tmp_path / "out", tmp_path / "state")
    assert paced.to_end(q, 23)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*d.columns).collect()) == sorted(tuple(r) for r in d.collect())


def test_batches_of_a_trigger(spark, tmp_path):
    staged(spark, tmp_path / "p")
    q = started(spark, tmp_path / "p", tmp_path / "out", tmp_path / "state", speed=1e9, maxBatchesPerTrigger=6)
    assert paced.to_end(q, 23)
    taken = [p.numInputRows for p in q.recentProgress if p.numInputRows]
    assert taken == [30, 30, 30, 10]
    with pytest.raises(Exception, match="speed"):
        started(spark, tmp_path / "p", tmp_path / "no", tmp_path / "no_state", speed=0).processAllAvailable()


def test_delivery_is_one_job(spark, tmp_path):
    d = spark.range(40).select("id", (F.col("id") % 4).alias("batch"))
    seen = []
    os.makedirs(tmp_path / "in")
    for b in (0, 1, 2, 3):
        seen.append(b)
    done = delivery.deliver(d, str(tmp_path / "in"), [(b, 0.5) for b in (3, 1, 9, 0)])
    assert done == [(3, 0.0), (1, 0.5), (9, 1.0), (0, 1.5)]
    names = sorted(os.listdir(tmp_path / "in"))
    assert [n.split("-")[1] for n in names if n.endswith(".parquet")] == ["0", "1", "3"] and not [n for n in names if n.startswith(".staged")]
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "in")).collect()) == [i for i in range(40) if i % 4 != 2]


def latest(rows):
    """The last row of each run that is told of."""
    out = {}
    for r in rows:
        out[r["run"]] = r
    return out


def test_state_of_runs_survives_a_restart(spark, tmp_path):
    d = spark.range(300).select((F.col("id") % 3).cast("string").alias("run"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.when(F.col("id") % 3 == 1, 100).when(F.col("id") % 3 == 2, 400).alias("total"), F.col("id"))
    for k in range(3):
        d.where(f"id >= {100 * k} and id < {100 * k + 100}").drop("id").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    os.makedirs(tmp_path / "in")
    got = []
    for k in range(3):
        for f in os.listdir(tmp_path / f"in{k}"):
            if f.endswith(".parquet"):
                os.rename(tmp_path / f"in{k}" / f, tmp_path / "in" / f"{k}-{f}")
        s = progress.by_run(spark.readStream.schema(d.drop("id").schema).parquet(str(tmp_path / "in")), "run", "ts", "total", stall="1 hour", late="1 minute")
        q = s.writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    want = {r["run"]: r for r in d.groupBy("run").agg(F.count(F.lit(1)).alias("done"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.max("total").alias("total")).collect()}
    for run, r in latest(got).items():
        w = want[run]
        rate = w["done"] / (w["b"] - w["a"]).total_seconds()
        assert (r["done"], r["first_ts"], r["last_ts"], r["total"], r["stalled"]) == (w["done"], w["a"], w["b"], w["total"], False)
        assert r["rate"] == pytest.approx(rate)
        assert r["eta"] == {"0": None, "1": 0.0, "2": pytest.approx(300 / rate)}[run]
        assert r["percent"] == {"0": 0.0, "1": 100.0, "2": 25.0}[run]


def test_stalled_runs(spark, tmp_path):
    def come(name, rows):
        spark.createDataFrame(rows, "run string, ts long").select("run", F.timestamp_seconds("ts").alias("ts")).coalesce(1).write.parquet(str(tmp_path / name))
        for f in os.listdir(tmp_path / name):
            if f.endswith(".parquet"):
                os.rename(tmp_path / name / f, tmp_path / "in" / f"{name}.parquet")

    os.makedirs(tmp_path / "in")
    got = []
    for name, rows in (("a", [("x", 1000), ("y", 1005), (None, 1009)]), ("b", [("x", 100_000)]), ("c", [("x", 100_001)])):
        come(name, rows)
        s = progress.by_run(spark.readStream.schema("run string, ts timestamp").parquet(str(tmp_path / "in")), "run", "ts", stall="1 hour", late="1 minute")
        s.writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["run"], r["done"]) for r in got if r["stalled"]) == [("", 1), ("y", 1)]
    assert latest([r for r in got if r["run"] == "x"])["x"]["done"] == 3


def test_a_run_of_more_rows_than_its_total_counts_on(spark, tmp_path):
    """Three batches of 40 rows of a run whose total is 50; one of another run, 'z', ends it, which is no stall."""
    os.makedirs(tmp_path / "in")
    got = []
    for k in range(4):
        ids = spark.range(40 * k, 40 * k + 40) if k < 3 else spark.range(100_000, 100_001)
        d = ids.select(F.lit("x" if k < 3 else "z").alias("run"), F.timestamp_seconds(F.col("id") * 2).alias("ts"), F.lit(50).cast("long").alias("total"))
        d.coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        for f in os.listdir(tmp_path / f"in{k}"):
            if f.endswith(".parquet"):
                os.rename(tmp_path / f"in{k}" / f, tmp_path / "in" / f"{k}-{f}")
        s = progress.by_run(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "run", "ts", "total", stall="1 hour", late="1 minute")
        s.writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [(r["run"], r["done"], r["percent"], r["stalled"]) for r in got] == [("x", 40, 80.0, False), ("x", 80, 160.0, False), ("x", 120, 240.0, False), ("z", 1, 2.0, False)]
    assert [r["eta"] for r in got] == [pytest.approx((50 - r["done"]) / r["rate"]) if r["rate"] else None for r in got] and got[2]["eta"] < 0


def test_a_stuck_batch_ends(spark):
    def stuck(rows):
        for r in rows:
            time.sleep(120)
            yield r

    began = time.time()
    with pytest.raises(TimeoutError):
        runs.within(spark, 3.0, lambda: spark.range(4, numPartitions=4).mapInPandas(stuck, "id long").count())
    assert time.time() - began < 60
    assert runs.within(spark, 60.0, lambda: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        runs.within(spark, 60.0, lambda: 1 / 0)


def test_a_signal_leaves_no_part_behind(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fastq").write_text("".join(f"@r{i}\nAC\n+\nII\n" for i in range(20)))
    c = model.ReplayConfig(str(tmp_path / "in"), str(tmp_path / "out"), reads_per_file=2, pacing=model.Pacing(interval=30.0, real_time=True))
    held = signal.getsignal(signal.SIGTERM)

    def end():
        while not (tmp_path / "out" / "a_chunk_0000.fastq").exists():
            time.sleep(0.2)
        os.kill(os.getpid(), signal.SIGTERM)

    t = threading.Thread(target=end, daemon=True)
    t.start()
    with pytest.raises(KeyboardInterrupt):
        runs.replay(spark, c)
    t.join()
    assert os.listdir(tmp_path / "out") == ["a_chunk_0000.fastq"]
    assert signal.getsignal(signal.SIGTERM) is held


def test_profile_decides_how(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.fastq").write_text("@r\nA\n+\nI\n")
    args = ["replay", "--source", str(tmp_path / "in"), "--target", str(tmp_path / "out"), "--interval", "0"]
    assert cli.main([*args, "--profile", "development", "--pipeline", "kraken"], spark) == 0
    assert (tmp_path / "out" / "1.fastq").is_symlink() and "kraken: the output fits" in capsys.readouterr().out
    a = cli.parser().parse_args([*args, "--profile", "development", "--workers", "3"])
    assert (cli.pacing(a).parallel, cli.pacing(a).workers, cli.pacing(a).batch_size) == (True, 3, 10)
    assert cli.pacing(cli.parser().parse_args([*args, "--profile", "bursty", "--no-parallel"])).parallel is False
    assert cli.main([*args, "--operation", "copy", "--quiet"], spark) == 0 and capsys.readouterr().out == ""
    assert not (tmp_path / "out" / "1.fastq").is_symlink()
    assert cli.main([*args, "--monitor", "enhanced"], spark) == 0 and "memory of the driver" in capsys.readouterr().out
    assert cli.main([*args, "--pipeline", "none"], spark) == 2 and cli.main([*args, "--workers", "0"], spark) == 2


def test_dependencies(capsys, monkeypatch):
    assert cli.main(["--log-level", "error", "check-deps"]) == 0 and "core: 0 of 4 missing" in capsys.readouterr().out
    monkeypatch.setitem(cli.NEEDED, "core", [("no_such_module", "nothing")])
    assert cli.main(["check-deps"]) == 1 and "no_such_module: missing" in capsys.readouterr().out
    monkeypatch.setitem(cli.NEEDED, "monitoring", [])
    monkeypatch.setattr(cli.importlib.util, "find_spec", lambda name: None)
    assert cli.monitor("enhanced", False) == "basic" and cli.monitor("enhanced", True) == "none" and cli.monitor("none", False) == "none"


def test_a_file_that_is_no_fastq(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("words\n")
    config = lambda **k: model.ReplayConfig(str(tmp_path / "notes.txt"), str(tmp_path / "out"), reads_per_file=3, **k)
    assert runs.replay(spark, config()) == [(str(tmp_path / "out" / "notes.txt"), -1, 0.0)]
    assert (tmp_path / "out" / "notes.txt").read_text() == "words\n"
    with pytest.raises(runs.EmptySource):
        runs.replay(spark, config(output="flat"))


def test_warnings(tmp_path):
    from readloom.sources import fastq

    (tmp_path / "barcode01").mkdir()
    (tmp_path / "barcode01" / "a.fastq").write_text("")
    assert fastq.layout(str(tmp_path)) == "multiplex"
    (tmp_path / "b.fastq").write_text("")
    with pytest.warns(UserWarning, match="1 sequencing files beside"):
        fastq.layout(str(tmp_path))
    with pytest.warns(UserWarning, match="are free"):
        runs.warn_of_capacity(str(tmp_path / "not" / "yet"), 1 << 60)


def test_resolution_and_cache(spark, tmp_path):
    none = None
    q = spark.createDataFrame([
        (1, "species", "Escherichia COLI", none, none, none, none), (2, "species", "candida", none, none, none, "eukaryota"), (3, "taxid", "562", none, none, none, none), (4, "taxid", "1", none, none, none, none),
        (5, "accession", "GCF_000005845.2", none, none, none, none), (6, "accession", "gcf_000005845.2", none, none, none, none), (7, "accession", "GCA_000005845.1", "own", none, none, "archaea"),
        (8, "organism", "Yeast", none, "GCF_1", "ncbi", none), (9, "organism", "Bug", none, "GCF_2", "gtdb", none), (10, "organism", "escherichia coli", none, none, "gtdb", none),
        (11, "species", none, none, none, none, none), (12, "other", "x", none, none, none, none), (13, "species", "Escherichia coli", none, none, none, none),
    ], "id long, kind string, key string, name string, accession string, resolver string, domain string")
    first = spark.createDataFrame([("species", "escherichia coli", "E. coli", "G1", "bacteria"), ("species", "candida", "C.", "wrong", "bacteria"), ("taxid", "562", "E. coli", None, "bacteria")], "kind string, key string, name string, accession string, domain string")
    second = spark.createDataFrame([("species", "Candida", "Candida albicans", "G2", "eukaryota"), ("species", "Escherichia coli", "E. coli", "G9", "bacteria"), ("taxid", "562", "E. coli", "G3", "bacteria")], "kind string, key string, name string, accession string, domain string")
    want = {1: ("G1", "gtdb", "bacteria"), 2: ("G2", "ncbi", "eukaryota"), 3: ("G3", "ncbi", "bacteria"), 5: ("GCF_000005845.2", "ncbi", "bacteria"), 7: ("GCA_000005845.1", "ncbi", "archaea"), 8: ("GCF_1", "ncbi", "eukaryota"), 9: ("GCF_2", "gtdb", "bacteria"), 10: ("G1", "gtdb", "bacteria"), 13: ("G1", "gtdb", "bacteria")}
    lookups = [("gtdb", first, ["eukaryota"]), ("ncbi", second, [])]
    check = lambda d: {r["id"]: (r["ref_accession"], r["ref_source"], r["ref_domain"]) for r in d.where("miss is null").collect()}
    d = resolving.tagged(q, lookups)
    assert check(d) == want and d.count() == 13
    assert {r["id"]: r["miss"] for r in d.where("miss is not null").collect()} == {4: "not found", 6: "malformed accession", 11: "not found", 12: "unknown kind"}
    cache = Snapshots(spark, str(tmp_path / "cache"), "kind string, key string, name string, accession string, domain string, source string", ("kind", "key"))
    assert resolving.through(q, cache, lookups).where("cached").count() == 0
    again = resolving.through(q, cache, [])
    assert check(again) == want and sorted(r["id"] for r in again.where("cached").collect()) == [1, 2, 3, 10, 13]
    assert sorted((r["kind"], r["key"], r["accession"], r["source"]) for r in cache.read().collect()) == [("species", "candida", "G2", "ncbi"), ("species", "escherichia coli", "G1", "gtdb"), ("taxid", "562", "G3", "ncbi")]
    kept = cache.version()
    assert cache.put(cache.read()) == 0 and cache.version() == kept
    for f in (tmp_path / "cache" / kept).glob("*.parquet"):
        f.write_bytes(b"spoilt")
    assert cache.read().count() == 0 and resolving.through(q, cache, lookups).where("cached").count() == 0 and cache.read().count() == 3
    cache.clear()
    assert cache.read().count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_runs_over_stretches(spark, seed):
    import random

    rng = random.Random(seed)
    data = [(i, rng.choice(["g", "g", "g", None, "h"]), rng.choice(["a"] * rng.randrange(1, 9) + ["b", None])) for i in range(200)] + [(500, "single", "a"), (501, "nulls", None), (502, "nulls", None)]
    want = {}
    for g in {g for _, g, _ in data}:
        v = [x for _, h, x in data if h == g]
        lengths = [1]
        for a, b in zip(v, v[1:], strict=False):
            lengths = [*lengths, 1] if a is None or b is None or a != b else [*lengths[:-1], lengths[-1] + 1]
        want[g] = (max(lengths), len(lengths) - 1, len({x for x in v if x is not None}))
    d = spark.createDataFrame(data, "i int, grp string, v string").repartition(5)
    for parts in (1, 3, 17):
        got = quality.stitched(quality.stretches(d, "v", ["i"], ["grp"], parts), ["grp"]).collect()
        assert {r["grp"]: (r["max_run"], r["transitions"]) for r in got} == {g: w[:2] for g, w in want.items()}
    assert {r["grp"]: (r["max_run"], r["transitions"], r["buckets"]) for r in quality.interleaving(d, "v", ["i"], ["grp"]).collect()} == want
    assert quality.interleaving(d.where("false"), "v", ["i"], ["grp"]).count() == 0


def test_sums_before(spark):
    d = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2], float(i % 7)) for i in range(100)], "i int, g string, x double").repartition(7)
    for parts in (1, 3, 40):
        got = {r["i"]: (r["s"], r["t"]) for r in before(before(d, ["i"], "x", "s", parts=parts), ["i"], "x", "t", "g", parts).collect()}
        for i in range(100):
            g = None if i % 5 == 0 else "ab"[i % 2]
            assert got[i] == (sum(k % 7 for k in range(i)), sum(k % 7 for k in range(i) if (None if k % 5 == 0 else "ab"[k % 2]) == g))
    plan = before(d, ["i"], "x", "s")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[1].split("Exchange")[0]
