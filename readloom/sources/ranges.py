"""The offset index of FASTQ files, and a data source that reads ranges of them by it."""

from __future__ import annotations

import gzip
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from math import inf
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from readloom.sources import store
from readloom.storage import written

BLOCK = 1 << 22
INDEX = "file_no bigint, barcode string, path string, bytes bigint, range_no bigint, width bigint, start bigint, lines bigint, reads bigint, src_pos bigint, pos bigint, group_pos bigint"
COLUMNS = "src_path string, src_pos bigint, header string, seq string, sep string, qual string, file_no bigint, barcode string, pos bigint, group_pos bigint"


def stream(path: str, start: int = 0):
    """A file opened at a byte, gzip unpacked (any number of members); for gzip start is of the packed file and so 0."""
    system, inside = store.located(path)
    f = system.open_input_file(inside)
    if path.endswith(".gz"):
        return gzip.GzipFile(fileobj=f)
    f.seek(start)
    return f


def line_starts(path: str, a: int, b: int) -> tuple[int, list[int]]:
    """How many lines start at bytes a to b - 1 of a file, and where the first four do. A gzip file is one range, whose first line starts at 0."""
    packed = path.endswith(".gz")
    count, first, at, last = 0, [], max(a - 1, 0), b"\n"
    if a == 0 and (b or packed):
        first.append(0)
        count = 1
    with stream(path, at) as f:
        while packed or at < b - 1:
            block = f.read(BLOCK if packed else min(BLOCK, b - 1 - at))
            if not block:
                break
            count += block.count(b"\n")
            p = -1
            while len(first) < 4 and (p := block.find(b"\n", p + 1)) >= 0:
                first.append(at + p + 1)
            at += len(block)
            last = block[-1:]
    if packed:
        count, first = count - (last == b"\n"), [0]  # no line starts behind the last sign
    return count, first


def index(spark: SparkSession, files: Sequence[tuple[str | None, str]] | Sequence[str] | str, range_bytes: int = 1 << 26, path: str | None = None) -> DataFrame:
    """INDEX's columns, a row for each range of range_bytes of each file: where its first record starts, how many start in it, and the place of
    the first one in its file, in all files and in those of its barcode.

    files: paths or (barcode, path), in their order. Records are four lines, by position alone, so a quality line may start as a header does; one
    that is cut off at a file's end doesn't count. A range is read once, in its own task, for its line starts; ranges meet as sums of lines. A gzip
    file can't be entered in its middle and is one range. A file without records keeps a row of 0 reads. Written to path, or to the shared
    folder; open_index() reads it again.
    """
    pairs = [(None, p) for p in ([files] if isinstance(files, str) else files)] if isinstance(files, str) or not files or isinstance(files[0], str) else list(files)
    rows = [(barcode, p, size) for barcode, named in pairs for p, size in store.listed(named)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "file_no bigint, barcode string, path string, bytes bigint")
    wide = F.when(F.col("path").endswith(".gz"), F.greatest("bytes", F.lit(1))).otherwise(F.lit(range_bytes))
    n = sum(1 if p.endswith(".gz") else -(-size // range_bytes) for _, p, size in rows)
    d = d.withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("bytes") / wide) - 1, F.lit(0)).cast("bigint"))))
    d = d.withColumn("a", F.col("range_no") * wide).withColumn("b", F.least(F.col("a") + wide, F.col("bytes")))
    d = d.repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism)), "file_no", "range_no")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [line_starts(p, a, b) for p, a, b in zip(batch["path"], batch["a"], batch["b"], strict=True)]
            yield pd.DataFrame({"file_no": batch["file_no"], "range_no": batch["range_no"], "width": batch["b"] - batch["a"], "c": [c for c, _ in found], "first": pd.Series([x for _, x in found], index=batch.index, dtype=object)})

    counted = d.select("file_no", "range_no", "path", "a", "b").mapInPandas(count, "file_no bigint, range_no bigint, width bigint, c bigint, first array<bigint>")
    counted = written(counted, "line-starts")
    own = Window.partitionBy("file_no")
    before = own.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    r = counted.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("lines", F.sum("c").over(own))
    r = r.withColumn("skip", F.pmod(-F.col("before"), F.lit(4)))  # lines of a record that an earlier range starts
    r = r.withColumn("src_pos", ((F.col("before") + F.col("skip")) / 4).cast("bigint"))
    ends = F.least(F.floor((F.col("before") + F.col("c") - 1) / 4), F.floor(F.col("lines") / 4) - 1)
    r = r.withColumn("reads", F.when(F.col("skip") < F.col("c"), F.greatest(ends - F.col("src_pos") + 1, F.lit(0))).otherwise(F.lit(0)).cast("bigint"))
    r = r.withColumn("start", F.when(F.col("reads") > 0, F.get("first", F.col("skip").cast("int"))))
    reads = {x["file_no"]: x["n"] for x in r.groupBy("file_no").agg(F.sum("reads").alias("n")).collect()}  # a row a file, as the driver has listed them
    named, all_, own_ = [], 0, defaultdict(int)
    for i, (barcode, file, size) in enumerate(rows):
        named.append((i, barcode, file, size, all_, own_[barcode]))
        all_, own_[barcode] = all_ + reads[i], own_[barcode] + reads[i]
    out = r.join(spark.createDataFrame(named, "file_no bigint, barcode string, path string, bytes bigint, all_before bigint, own_before bigint"), "file_no")
    out = out.select("file_no", "barcode", "path", "bytes", "range_no", "width", "start", "lines", "reads", "src_pos", (F.col("all_before") + F.col("src_pos")).alias("pos"), (F.col("own_before") + F.col("src_pos")).alias("group_pos"))
    if path is None:
        return written(out, "fastq-index")
    out.write.mode("overwrite").parquet(path)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


@dataclass
class Range:
    """Reads to give of a file: from the record that starts at byte start, after skip of them, reads (None: all that start before byte end)."""

    path: str
    start: int = 0
    reads: int | None = None
    skip: int = 0
    end: float = inf
    size: int | None = None
    resync: bool = False
    src_pos: int | None = 0
    file_no: int | None = None
    barcode: str | None = None
    pos: int | None = None
    group_pos: int | None = None
    width: int = 0


@dataclass
class Ranges(ds.InputPartition):
    """What one task reads."""

    ranges: list[Range]


def packed(ranges: list[Range], parallelism: int, least: int = 1 << 20) -> list[Ranges]:
    """Neighbouring ranges put together for tasks of about a fourth of a core's share of the bytes, and of least bytes; large ranges stay alone. 0: every range is a task's."""
    target = max(least, sum(r.width for r in ranges) // (4 * parallelism)) if parallelism else -1
    out: list[Ranges] = []
    size = 0
    for r in ranges:
        if not out or size + r.width > target:
            out.append(Ranges([]))
            size = 0
        out[-1].ranges.append(r)
        size += r.width + 4096  # a file costs more than its bytes
    return out


def lines(f) -> Iterator[list[bytes]]:
    """The file's lines, some at a time, without their ends; a line may be longer than what is read at once."""
    rest: list[bytes] = []
    while block := f.read(BLOCK):
        cut = block.rfind(b"\n")
        if cut < 0:
            rest.append(block)
            continue
        rest.append(block[:cut])
        yield b"".join(rest).split(b"\n")
        rest = [block[cut + 1 :]]
    if tail := b"".join(rest):
        yield [tail]


def resynchronised(path: str, a: int, window: int = 1 << 20) -> int | None:
    """Where the first record starts at byte a or behind, told by its content: a header sign, a separator sign, and as many qualities as bases, in every record of the window.

    A sequence line never starts with either sign, so for well-formed files one record tells; others need an index.
    """
    if a == 0:
        return 0
    while True:
        with stream(path, a - 1) as f:
            text = f.read(window)
            whole = not f.read(1)
        at, places, p = [], [], text.find(b"\n")
        while p >= 0 and p + 1 < len(text):
            q = text.find(b"\n", p + 1)
            if q < 0 and not whole:
                break
            at.append(text[p + 1 : q if q >= 0 else len(text)].rstrip(b"\r"))
            places.append(a + p)
            p = q
        for k in range(min(4, len(at))):
            full = range(k, len(at) - 3, 4)
            if full and all(at[i][:1] == b"@" and at[i + 2][:1] == b"+" and len(at[i + 1]) == len(at[i + 3]) for i in full):
                return places[k]
        if whole and len(at) > 6:
            raise ValueError(f"no record can be told behind byte {a} of {path}: read it by an index")
        if whole:
            return None
        window *= 8  # a record is longer than that


class FastqReader(ds.DataSourceReader):
    """Ranges by the index's places, or files as they are listed."""

    PLACES = ("src_pos", "pos", "group_pos", "file_no")

    def __init__(self, options: dict):
        self.options = options
        self.low = dict.fromkeys(self.PLACES, 0)
        self.high: dict[str, float] = dict.fromkeys(self.PLACES, inf)
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        """Bounds of places and names of files: ranges without any such read are not opened, a range ends at its last one. Spark checks the rows again."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if name in self.PLACES and isinstance(value, int):
                if isinstance(f, (ds.EqualTo, ds.GreaterThanOrEqual, ds.GreaterThan)):
                    self.low[name] = max(self.low[name], value + isinstance(f, ds.GreaterThan))
                if isinstance(f, (ds.EqualTo, ds.LessThanOrEqual, ds.LessThan)):
                    self.high[name] = min(self.high[name], value - isinstance(f, ds.LessThan))
            elif name in self.PLACES and isinstance(f, ds.In) and all(isinstance(x, int) for x in value):
                self.low[name], self.high[name] = max([self.low[name], min(value, default=0)]), min([self.high[name], max(value, default=-1)])
            elif name == "src_path" and isinstance(f, (ds.EqualTo, ds.In)):
                names = set(value) if isinstance(f, ds.In) else {value}
                self.only = names if self.only is None else self.only & names
            yield f

    def narrowed(self, r: Range) -> Range | None:
        if self.only is not None and r.path not in self.only or r.file_no is not None and not self.low["file_no"] <= r.file_no <= self.high["file_no"]:
            return None
        first, last = 0, inf if r.reads is None else r.reads - 1
        for name in ("src_pos", "pos", "group_pos"):
            at = getattr(r, name)
            if at is not None:
                first, last = max(first, self.low[name] - at), min(last, self.high[name] - at)
        if last < first:
            return None
        if first or last < inf:
            r.skip, r.reads = int(first), None if last == inf else int(last - first + 1)
        return r

    def partitions(self) -> list[Ranges]:
        found: list[Range] = []
        if "index" in self.options:
            system, inside = store.located(self.options["index"])
            table = pads.dataset(inside, filesystem=system, format="parquet").to_table(filter=pads.field("reads") > 0)
            for x in table.sort_by([("file_no", "ascending"), ("range_no", "ascending")]).to_pylist():
                found.append(Range(x["path"], x["start"], x["reads"], size=x["bytes"], **{k: x[k] for k in ("src_pos", "file_no", "barcode", "pos", "group_pos", "width")}))
        else:
            wide = int(self.options.get("rangebytes", 1 << 26))
            resync = self.options.get("resync", "false").lower() == "true"
            for i, (path, size) in enumerate(store.listed(self.options["paths"].split("\n") if "paths" in self.options else self.options["path"])):
                if resync and not path.endswith(".gz"):
                    found += [Range(path, a, end=a + wide, resync=True, src_pos=None, file_no=i, width=wide) for a in range(0, size, wide)]
                elif size:
                    found.append(Range(path, file_no=i, width=size))
        return packed([r for r in map(self.narrowed, found) if r is not None], int(self.options.get("parallelism", 0)))

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        for r in partition.ranges if partition else ():  # None: no range is left
            yield from self.reads(r)

    def reads(self, r: Range) -> Iterator[pa.RecordBatch]:
        if r.size is not None and store.located(r.path)[0].get_file_info(store.located(r.path)[1]).size != r.size:
            raise ValueError(f"{r.path} has changed since it was indexed")
        start = resynchronised(r.path, r.start) if r.resync else r.start
        if start is None or start >= r.end:
            return
        skip, left, at, held, given = r.skip, inf if r.reads is None else r.reads, start, [], r.skip
        with stream(r.path, start) as f:
            for more in lines(f):
                held += more
                n = len(held) // 4
                if r.end < inf:  # records that start before the end
                    sizes = [sum(map(len, held[4 * i : 4 * i + 4])) + 4 for i in range(n)]
                    own = 0
                    while own < n and at < r.end:
                        at += sizes[own]
                        own += 1
                    n, left = own, own if at >= r.end else left
                first = min(skip, n)
                skip -= first
                last = int(min(n, first + left))
                if last > first:
                    yield self.batch(r, held[4 * first : 4 * last], given)
                    given += last - first
                    left -= last - first
                if left <= 0:
                    return
                del held[: 4 * n]

    @staticmethod
    def batch(r: Range, rows: list[bytes], given: int) -> pa.RecordBatch:
        n = len(rows) // 4

        def text(k: int) -> pa.Array:
            column = [x.rstrip(b"\r") for x in rows[k::4]]
            try:
                return pa.array(column, pa.binary()).cast(pa.string())
            except pa.ArrowInvalid:  # signs that aren't UTF-8 are replaced, as Spark's text source does
                return pa.array([x.decode(errors="replace") for x in column], pa.string())

        whole = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(range(x + given, x + given + n), pa.int64())
        same = lambda x, kind: pa.array([x] * n, kind)
        columns = [same(r.path, pa.string()), whole(r.src_pos), text(0), text(1), text(2), text(3), same(r.file_no, pa.int64()), same(r.barcode, pa.string()), whole(r.pos), whole(r.group_pos)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in COLUMNS.split(", ")])


class FastqSource(ds.DataSource):
    """spark.read.format("fastq"): COLUMNS, of files by path (paths, by line, for several), or of an index's ranges by index.

    Options: index, a written index; rangeBytes and resync true, to cut plain files without one at records that are told by their content (src_pos is
    null then); parallelism, to put small ranges together. Without either a file is one task's, read as a stream. pos and group_pos are an index's.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> ds.DataSourceReader:
        return FastqReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ds.DataSourceWriter:
        from readloom.sources.sinks import FastqWriter

        return FastqWriter(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    """The session with the fastq format; filters reach Python sources only where the session says so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastqSource)
    return spark


def by_index(spark: SparkSession, index: DataFrame | str) -> DataFrame:
    """COLUMNS of an index that is written: filters on places and paths decide what is opened."""
    path = index if isinstance(index, str) else unquote(index.inputFiles()[0].rpartition("/")[0])
    return registered(spark).read.format("fastq").option("index", path).option("parallelism", spark.sparkContext.defaultParallelism).load()
