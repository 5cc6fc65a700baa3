"""Whole runs by configuration and by command line."""

import pytest

from readloom import cli, model, runs
from readloom.sources import fastq


def write(path, ids):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"@read{i}\nACGT\n+\nIIII\n" for i in ids))


def headers(spark, folder):
    return sorted(r["header"] for r in fastq.scan(spark, [p for _, p in fastq.listing(str(folder))]).collect())


@pytest.mark.parametrize("shape", ["one", "many", "barcoded"])
@pytest.mark.parametrize("output", ["preserve", "flat", "barcoded"])
def test_reshape(spark, tmp_path, shape, output):
    for k in range(1 if shape == "one" else 3):
        ids = range(30) if shape == "one" else range(10 * k, 10 * k + 10)
        write(tmp_path / "in" / (f"barcode0{k + 1}/x y{k}.fastq" if shape == "barcoded" else f"x+{k}.fastq"), ids)
    c = model.ReplayConfig(str(tmp_path / "in"), str(tmp_path / "out"), reads_per_file=7, output=output, barcodes=3, pacing=model.Pacing(batch_size=2))
    done = runs.replay(spark, c)
    assert sum(n for _, n, _ in done) == 30 and max(n for _, n, _ in done) == 7
    assert headers(spark, tmp_path / "out") == sorted(f"@read{i}" for i in range(30))
    assert fastq.layout(str(tmp_path / "out")) == ("multiplex" if output == "barcoded" or (output, shape) == ("preserve", "barcoded") else "singleplex")


def test_copy_and_link(spark, tmp_path):
    write(tmp_path / "in" / "a.fastq", range(2))
    write(tmp_path / "in" / "b.fastq", range(2, 4))
    for operation in ("copy", "link"):
        done = runs.replay(spark, model.ReplayConfig(str(tmp_path / "in"), str(tmp_path / operation), operation=operation))
        assert [at for _, _, at in done] == [0.0, 5.0] and headers(spark, tmp_path / operation) == [f"@read{i}" for i in range(4)]
    assert (tmp_path / "link" / "a.fastq").is_symlink()


def test_generate(spark, tmp_path):
    for n, s in (("a", "ACGT" * 300), ("b", "GGCCAATT" * 100)):
        (tmp_path / f"{n}.fna").write_text(f">c1 x\n{s[:400]}\n>c2\n{s[400:]}\n")
    genomes = (str(tmp_path / "a.fna"), str(tmp_path / "b.fna"))
    c = model.GenerateConfig(str(tmp_path / "out"), genomes, read_count=100, reads_per_file=30, abundances=(0.9, 0.1), mean_length=100, std_length=20, min_length=20, output_format="fastq")
    done = runs.generate(spark, c)
    assert sorted((t.rsplit("out/")[1], n) for t, n, _ in done) == [("barcode01/a_reads_0000.fastq", 30), ("barcode01/a_reads_0001.fastq", 30), ("barcode01/a_reads_0002.fastq", 30), ("barcode02/b_reads_0000.fastq", 10)]
    text = (tmp_path / "out/barcode01/a_reads_0000.fastq").read_text()
    runs.generate(spark, c)
    assert (tmp_path / "out/barcode01/a_reads_0000.fastq").read_text() == text
    mixed = runs.generate(spark, model.GenerateConfig(str(tmp_path / "mix"), genomes, read_count=50, reads_per_file=20, structure="singleplex", mix_reads=True, mean_length=100, std_length=0))
    assert [n for _, n, _ in mixed] == [20, 20, 10]


@pytest.mark.parametrize("bad", [{"operation": "move"}, {"reads_per_file": 0}, {"reads_per_file": 5, "operation": "link"}, {"output": "flat"}, {"barcodes": 0}, {"barcode_pattern": "same"}, {"pacing": model.Pacing(interval=-1)}, {"pacing": model.Pacing(timing_model="odd")}, {"pacing": model.Pacing(timing_model="random", timing_params={"random_factor": 2})}])
def test_wrong_replay(bad):
    with pytest.raises(ValueError):
        model.ReplayConfig("a", "b", **bad)


@pytest.mark.parametrize("bad", [{"genomes": ()}, {"read_count": 0}, {"abundances": (0.5,)}, {"abundances": (0.5, 0.1)}, {"output_format": "bam"}, {"std_length": -1}])
def test_wrong_generate(bad):
    with pytest.raises(ValueError):
        model.GenerateConfig(**{"target": "t", "genomes": ("a", "b")} | bad)


def test_schedules(spark):
    for name in model.TIMING:
        rows = model.intervals(spark, name.upper(), 6, 2.0, "s", unknown=1).orderBy("batch").collect()
        assert len(rows) == 6 and rows[0]["emit_offset_s"] == 0.0
        assert rows[5]["emit_offset_s"] == pytest.approx(sum(r["interval_s"] for r in rows[:5]))


def test_command_line(spark, tmp_path, capsys):
    write(tmp_path / "in" / "a.fastq", range(9))
    args = ["replay", "--source", str(tmp_path / "in"), "--target", str(tmp_path / "out"), "--reads-per-file", "4", "--profile", "bursty"]
    assert cli.main(args, spark) == 0 and headers(spark, tmp_path / "out") == sorted(f"@read{i}" for i in range(9))
    assert cli.main([*args, "--operation", "link"], spark) == 2
    (tmp_path / "in" / "a.fastq").write_text("")
    assert cli.main(args, spark) == 3
    assert cli.main(["validate", "--pipeline", "kraken", "--target", str(tmp_path / "out")]) == 0
    assert cli.main(["validate", "--pipeline", "kraken", "--target", str(tmp_path / "none")]) == 1
    assert cli.main(["validate", "--pipeline", "other", "--target", str(tmp_path)]) == 2
    assert cli.main(["generate", "--target", "x"], spark) == 2
    capsys.readouterr()
    assert cli.main(["list-mocks"]) == 0 and "msa-1002: (alias for atcc_msa1002)" in capsys.readouterr().out
    assert cli.main(["list-generators"]) == 0 and "builtin: available" in capsys.readouterr().out
    assert cli.main(["recommend", "--source", str(tmp_path / "in")]) == 0 and capsys.readouterr().out.split() == ["steady", "bursty", "development"]
    assert cli.main(["recommend", "--file-count", "60"]) == 0 and capsys.readouterr().out.split() == ["bursty", "gradual_drift", "development"]


def test_structure_asked_for(spark, tmp_path):
    write(tmp_path / "in" / "a.fastq", range(2))
    write(tmp_path / "in" / "barcode01" / "b.fastq", range(2, 4))
    for structure, want in (("auto", "barcode01/b.fastq"), ("multiplex", "barcode01/b.fastq"), ("singleplex", "a.fastq")):
        done = runs.replay(spark, model.ReplayConfig(str(tmp_path / "in"), str(tmp_path / structure), structure=structure))
        assert [t.removeprefix(str(tmp_path / structure) + "/") for t, _, _ in done] == [want]
    with pytest.raises(ValueError):
        runs.replay(spark, model.ReplayConfig(str(tmp_path / "in" / "barcode01"), str(tmp_path / "none"), structure="multiplex"))


def test_genomes_of_a_folder(spark, tmp_path):
    for n in ("b", "a"):
        (tmp_path / "g" / f"{n}.fna").parent.mkdir(exist_ok=True)
        (tmp_path / "g" / f"{n}.fna").write_text(">c\n" + "ACGT" * 100 + "\n")
    assert cli.main(["generate", "--genomes", str(tmp_path / "g"), "--target", str(tmp_path / "out"), "--read-count", "20", "--mean-length", "50", "--std-length", "0"], spark) == 0
    assert [(b, len(fastq.listing(str(tmp_path / "out")))) for b, _ in fastq.listing(str(tmp_path / "out"))] == [("barcode01", 2), ("barcode02", 2)]
    assert cli.main(["generate", "--genomes", str(tmp_path / "no"), "--target", str(tmp_path / "out")], spark) == 2
