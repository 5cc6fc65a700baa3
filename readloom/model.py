"""Validated configurations of replay and generate runs, and the timing models by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions import naming
from readloom.functions.rng import uniform
from readloom.operators import timing

OPERATIONS, STRUCTURES, OUTPUTS, FORMATS = ("copy", "link"), ("auto", "singleplex", "multiplex"), ("preserve", "flat", "barcoded"), ("fastq", "fastq.gz")

#: Parameters of each timing model: name -> (default, least, most); most None: no bound.
TIMING = {
    "uniform": {},
    "random": {"random_factor": (0.3, 0.0, 1.0)},
    "poisson": {"burst_probability": (0.1, 0.0, 1.0), "burst_rate_multiplier": (5.0, 1e-9, None)},
    "adaptive": {"adaptation_rate": (0.1, 0.0, 1.0), "history_size": (10, 1, None)},
}


def need(ok: bool, why: str) -> None:
    if not ok:
        raise ValueError(why)


def timing_parameters(model: str, given: dict | None = None) -> dict:
    """The model's parameters, checked; unknown ones are ignored, case of the model's name doesn't count."""
    need(model.lower() in TIMING, f"no timing model named {model!r}: {', '.join(TIMING)}")
    out = {}
    for name, (default, least, most) in TIMING[model.lower()].items():
        v = (given or {}).get(name)
        out[name] = default if v is None else v
        need(out[name] >= least and (most is None or out[name] <= most), f"{name} must be at least {least}" + (f" and at most {most}" if most is not None else ""))
    return out


def intervals(spark, model: str, batches: int, base: float, seed: str, **given):
    """batch, interval_s, emit_offset_s of a run; the last interval isn't waited."""
    p, b = timing_parameters(model, given), F.col("id").alias("batch")
    d = spark.range(batches).select(b)
    u: Callable[[str], Column] = lambda k: uniform(f"{seed}:{k}", F.col("batch"))
    if model.lower() == "adaptive":
        return timing.schedule(timing.adaptive_intervals(d.withColumn("u", u("a")), base, p["adaptation_rate"], int(p["history_size"])))
    drawn = {
        "uniform": lambda: timing.uniform_interval(base),
        "random": lambda: timing.random_interval(base, u("a"), p["random_factor"]),
        "poisson": lambda: timing.burst_interval(base, u("a"), u("b"), p["burst_probability"], p["burst_rate_multiplier"]),
    }[model.lower()]()
    return timing.schedule(d.withColumn("interval_s", drawn))


@dataclass(frozen=True)
class Pacing:
    interval: float = 5.0
    batch_size: int = 1
    timing_model: str = "uniform"
    timing_params: dict = field(default_factory=dict)
    real_time: bool = False
    parallel: bool = False
    workers: int = 4
    timeout: float = 600.0

    def check(self) -> None:
        need(self.workers >= 1, "workers must be at least 1")
        need(self.timeout > 0, "timeout must be positive")
        need(self.interval >= 0, "interval must not be negative")
        need(self.batch_size >= 1, "batch_size must be at least 1")
        timing_parameters(self.timing_model, self.timing_params)


@dataclass(frozen=True)
class ReplayConfig:
    """Files of source are brought to target as they are, or rechunked into files of reads_per_file."""

    source: str
    target: str
    operation: str = "copy"
    reads_per_file: int | None = None
    output: str = "preserve"
    barcodes: int = 1
    barcode_pattern: str = "barcode{:02d}"
    prefix: str | None = None
    structure: str = "auto"
    pacing: Pacing = field(default_factory=Pacing)

    def __post_init__(self) -> None:
        self.pacing.check()
        need(self.operation in OPERATIONS, f"operation must be one of {OPERATIONS}")
        need(self.structure in STRUCTURES, f"structure must be one of {STRUCTURES}")
        need(self.output in OUTPUTS, f"output must be one of {OUTPUTS}")
        need(self.reads_per_file is None or self.reads_per_file >= 1, "reads_per_file must be at least 1")
        need(self.reads_per_file is None or self.operation != "link", "reads can't be rechunked by links")
        need(self.output == "preserve" or self.reads_per_file is not None, "another output layout needs reads_per_file")
        need(self.barcodes >= 1, "barcodes must be at least 1")
        naming.barcode_names(self.barcode_pattern, self.barcodes)


@dataclass(frozen=True)
class GenerateConfig:
    """Reads are simulated from genomes and apportioned by abundances (equal if none are given)."""

    target: str
    genomes: tuple[str, ...]
    read_count: int = 1000
    reads_per_file: int = 100
    abundances: tuple[float, ...] | None = None
    mix_reads: bool = False
    structure: str = "auto"
    output_format: str = "fastq.gz"
    mean_length: float = 5000
    std_length: float = 2000
    min_length: int = 200
    mean_quality: float = 20.0
    std_quality: float = 4.0
    seed: int | None = None
    pacing: Pacing = field(default_factory=Pacing)

    def __post_init__(self) -> None:
        self.pacing.check()
        need(bool(self.genomes), "at least one genome is needed")
        need(self.read_count >= 1 and self.reads_per_file >= 1, "read_count and reads_per_file must be at least 1")
        need(self.structure in STRUCTURES, f"structure must be one of {STRUCTURES}")
        need(self.output_format in FORMATS, f"output_format must be one of {FORMATS}")
        need(self.mean_length > 0 and self.std_length >= 0 and self.min_length >= 1, "lengths must be positive")
        need(self.std_quality >= 0, "std_quality must not be negative")
        if self.abundances is not None:
            need(len(self.abundances) == len(self.genomes), "there must be an abundance for each genome")
            need(all(a >= 0 for a in self.abundances) and 0.99 <= sum(self.abundances) <= 1.01, "abundances must sum to 1")

    @property
    def multiplex(self) -> bool:
        return self.structure == "multiplex" or (self.structure == "auto" and len(self.genomes) > 1)
