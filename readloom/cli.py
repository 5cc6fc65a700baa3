"""Command line: replay, generate, validate, recommend and the listings."""

from __future__ import annotations

import argparse
import importlib.util
import logging
import os
import sys

from readloom import __version__, catalog, model
from readloom.functions.naming import bytes_text

PACING = {"interval": float, "batch-size": int, "timing-model": str, "random-factor": float, "burst-probability": float, "burst-rate-multiplier": float, "adaptation-rate": float, "history-size": int}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readloom", description="Plan, generate, rechunk and pace streams of sequencing reads.")
    p.add_argument("--log-level", choices=("debug", "info", "warning", "error"), default="warning")
    p.add_argument("--version", action="version", version=f"readloom {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("replay", help="bring existing reads to a watched folder")
    for name, kind in {"source": str, "target": str, "operation": str, "reads-per-file": int, "output": str, "barcodes": int, "barcode-pattern": str, "prefix": str, "structure": str}.items():
        r.add_argument(f"--{name}", type=kind, required=name in ("source", "target"))
    g = sub.add_parser("generate", help="simulate reads")
    g.add_argument("--genomes", nargs="+")
    g.add_argument("--mock")
    for name, kind in {"target": str, "genome-cache": str, "read-count": int, "reads-per-file": int, "structure": str, "output-format": str, "mean-length": float, "std-length": float, "min-length": int, "mean-quality": float, "std-quality": float, "seed": int}.items():
        g.add_argument(f"--{name}", type=kind, required=name == "target")
    g.add_argument("--abundances", nargs="+", type=float)
    g.add_argument("--mix-reads", action="store_true", default=None)
    for c in (r, g):
        c.add_argument("--profile")
        c.add_argument("--real-time", action="store_true", default=None)
        c.add_argument("--parallel", action=argparse.BooleanOptionalAction, default=None, help="bring several files of a batch out at once")
        c.add_argument("--workers", type=int)
        c.add_argument("--timeout", type=float, help="seconds that a batch may take")
        c.add_argument("--pipeline", help="say afterwards what a pipeline would miss in the target")
        c.add_argument("--monitor", choices=("none", "default", "enhanced"), default="default")
        c.add_argument("--quiet", action="store_true")
        for name, kind in PACING.items():
            c.add_argument(f"--{name}", type=kind)
    v = sub.add_parser("validate", help="check a folder for a pipeline")
    v.add_argument("--pipeline", required=True)
    v.add_argument("--target", required=True)
    m = sub.add_parser("recommend", help="profiles for a number of files")
    n = m.add_mutually_exclusive_group(required=True)
    n.add_argument("--file-count", type=int)
    n.add_argument("--source", help="a folder whose files are counted")
    for name in ("list-profiles", "list-adapters", "list-mocks", "list-generators", "check-deps"):
        sub.add_parser(name)
    return p


def pacing(a: argparse.Namespace) -> model.Pacing:
    """Parameters given, then the profile's, then defaults."""
    own = {k: v for k, v in catalog.profile(a.profile).items() if k in ("batch_size", "timing_model", "timing_params", "parallel", "workers")} if a.profile else {}
    params = own.pop("timing_params", {}) | {k: v for k, v in ((n.replace("-", "_"), getattr(a, n.replace("-", "_"))) for n in PACING) if v is not None and k not in ("interval", "batch_size", "timing_model")}
    given = {k: getattr(a, k) for k in ("interval", "batch_size", "timing_model", "real_time", "parallel", "workers", "timeout") if getattr(a, k) is not None}
    return model.Pacing(**own | given, timing_params=params)


def monitor(kind: str, quiet: bool) -> str:
    """none, basic or enhanced; enhanced needs psutil, and without it a warning goes out and basic stays."""
    if quiet or kind == "none":
        return "none"
    if kind == "enhanced":
        if importlib.util.find_spec("psutil"):
            return "enhanced"
        print("enhanced monitoring needs psutil; basic monitoring is used", file=sys.stderr)
    return "basic"


def report(target: str, pipeline: str) -> None:
    """What a pipeline would miss after a run; it never changes the exit code."""
    found = issues(target, pipeline)
    print(f"{pipeline}: " + ("the output fits" if not found else "the output may not fit"))
    for issue in found:
        print(f"  {issue}")


def picked(a: argparse.Namespace, *names: str) -> dict:
    return {n: getattr(a, n) for n in names if getattr(a, n) is not None}


#: Modules by what needs them: (module, what it is for); those of the first kind must be there.
NEEDED = {
    "core": [("pyspark", "everything"), ("pyarrow", "files and batches"), ("pandas", "functions on batches"), ("numpy", "generators and timing")],
    "monitoring": [("psutil", "enhanced monitoring")],
}


def missing() -> dict[str, list[str]]:
    """Modules that aren't installed, by kind."""
    return {kind: [m for m, _ in modules if importlib.util.find_spec(m) is None] for kind, modules in NEEDED.items()}


def issues(target: str, adapter: str) -> list[str]:
    """What a pipeline would miss in a folder. Raises ValueError for an unknown adapter."""
    import fnmatch

    if adapter not in catalog.ADAPTERS:
        raise ValueError(f"no adapter named {adapter!r}")
    if not os.path.exists(target):
        return [f"{target} doesn't exist"]
    if not os.path.isdir(target):
        return [f"{target} isn't a folder"]
    names = [e.name for e in os.scandir(target) if e.is_file()] + [f for e in os.scandir(target) if e.is_dir() for f in os.listdir(e.path)]
    patterns = catalog.ADAPTERS[adapter][1]
    return [] if any(fnmatch.fnmatchcase(n, p) for n in names for p in patterns) else [f"no file in {target} matches {', '.join(patterns)}"]


def main(argv: list[str] | None = None, spark=None) -> int:
    """0: done; 1: problems found; 2: wrong parameters; 3: nothing to deliver."""
    a = parser().parse_args(argv)
    logging.basicConfig(level=a.log_level.upper())
    try:
        if a.command == "validate":
            found = issues(a.target, a.pipeline)
            print("\n".join(found) or "ok")
            return int(bool(found))
        if a.command == "recommend":
            from readloom.operators.quality import RECOMMENDED

            from readloom.sources import fastq

            files = len(fastq.listing(a.source)) if a.source else a.file_count
            print("\n".join(RECOMMENDED[0 if files < 50 else 1 if files < 500 else 2]))
            return 0
        if a.command == "check-deps":
            gone = missing()
            for kind, modules in NEEDED.items():
                print(f"{kind}: {len(gone[kind])} of {len(modules)} missing")
                print("\n".join(f"  {m}: {'missing, pip install ' + m if m in gone[kind] else 'found'} ({why})" for m, why in modules))
            return int(bool(gone["core"]))
        if a.command.startswith("list-"):
            from readloom.operators import generating

            table = {"list-profiles": [(k, v[0]) for k, v in catalog.PROFILES.items()], "list-adapters": [(k, v[0]) for k, v in catalog.ADAPTERS.items()], "list-mocks": [*catalog.COMMUNITIES.items(), *((x, f"(alias for {y})") for x, y in catalog.ALIASES.items())], "list-generators": [(k, "available" if there() else "missing") for k, (there, _) in generating.BACKENDS.items()]}
            print("\n".join(f"{n}: {d}" for n, d in table[a.command]))
            return 0
        return run(a, spark)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    except KeyboardInterrupt as e:
        print(f"ended by {e or 'an interrupt'}", file=sys.stderr)
        return 130


def run(a: argparse.Namespace, spark) -> int:
    from pyspark.sql import SparkSession

    from readloom import runs
    from readloom.sources import fastq

    if a.command == "replay":
        if a.profile and a.operation is None and a.reads_per_file is None:
            a.operation = catalog.profile(a.profile).get("operation")
        config = model.ReplayConfig(**picked(a, "source", "target", "operation", "reads_per_file", "output", "barcodes", "barcode_pattern", "prefix", "structure"), pacing=pacing(a))
    else:
        model.need((a.genomes is None) != (a.mock is None), "give either genomes or a mock community")
        genomes, weights = [f for p in a.genomes or () for f in fastq.genome_files(p)], a.abundances
        if a.mock:
            name = catalog.ALIASES.get(a.mock.lower(), a.mock.lower())
            rows = [r for r in catalog.ORGANISMS if r[0] == name]
            model.need(bool(rows), f"no mock community named {a.mock!r}")
            kept = [(p, r[3]) for r in rows if os.path.exists(p := os.path.join(a.genome_cache or "", r[2], f"{r[4]}.fna.gz"))]
            model.need(bool(kept), "none of the community's genomes is in the cache")
            genomes, weights = [p for p, _ in kept], [w / sum(x for _, x in kept) for _, w in kept]
        more = {k: v for k, v in catalog.profile(a.profile).items() if k in ("read_count", "reads_per_file")} if a.profile else {}
        more |= picked(a, "target", "read_count", "reads_per_file", "structure", "output_format", "mean_length", "std_length", "min_length", "mean_quality", "std_quality", "seed", "mix_reads")
        config = model.GenerateConfig(genomes=tuple(genomes), abundances=tuple(weights) if weights else None, **more, pacing=pacing(a))
    model.need(a.pipeline is None or a.pipeline in catalog.ADAPTERS, f"no adapter named {a.pipeline!r}")
    spark = spark or SparkSession.builder.appName("readloom").getOrCreate()
    try:
        done = runs.replay(spark, config) if a.command == "replay" else runs.generate(spark, config)
    except runs.EmptySource as e:
        print(e, file=sys.stderr)
        return 3
    watch = monitor(a.monitor, a.quiet)
    if watch != "none":
        for target, reads, at in done:
            print(f"{at:.2f}\t{reads}\t{target}")
    if watch == "enhanced":
        import psutil

        print(f"memory of the driver: {bytes_text(psutil.Process().memory_info().rss)}")
    if a.pipeline:
        report(config.target, a.pipeline)
    return 0


if __name__ == "__main__":
    sys.exit(main())
