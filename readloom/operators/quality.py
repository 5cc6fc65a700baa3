"""Checks and progress of a run: content, interleaving, arrivals, sizes, throughput, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.storage import written


def content(reads: DataFrame, by: list[str]) -> DataFrame:
    """Counts of reads, of bad headers and separators, of unequal lengths, the mean length and the Phred range. reads: header, seq, sep, qual."""
    return reads.groupBy(*by).agg(
        F.count(F.lit(1)).alias("reads"), F.avg(F.length("seq")).alias("mean_length"),
        F.count_if(~F.col("header").startswith("@")).alias("bad_headers"), F.count_if(~F.col("sep").startswith("+")).alias("bad_separators"),
        F.count_if(F.length("seq") != F.length("qual")).alias("unequal"),
        F.min(F.array_min(F.transform(F.split("qual", ""), F.ascii))).alias("least_phred"), F.max(F.array_max(F.transform(F.split("qual", ""), F.ascii))).alias("most_phred"),
    )


def runs(df: DataFrame, value: str, order: list, by: list[str]) -> DataFrame:
    """by, value, length of every run of equal values in order, by gaps and islands; a group is one task's work (interleaving() has none that is)."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    d = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    return d.groupBy(*by, "__run").agg(F.min(value).alias(value), F.count(F.lit(1)).alias("length")).drop("__run")


def stretches(df: DataFrame, value: str, order: list, by: list[str], parts: int | None = None) -> DataFrame:
    """by, stretch, and a summary of each stretch of a group's rows in order: first and last value, the lengths of the runs at both ends, the longest run inside, transitions, rows.

    Rows are dealt into ranges, which are written once; a stretch is what a range has of a group, so that a hot group is many stretches.
    A null value is a run of its own.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = written(df.select(*by, F.col(value).alias("__value"), *order).repartitionByRange(parts, *by, *order).withColumn("__stretch", F.spark_partition_id()), "stretches")
    own = Window.partitionBy("__stretch", *by).orderBy(*order)
    d = d.withColumn("__new", F.coalesce((F.lag("__value").over(own) != F.col("__value")).cast("int"), F.lit(1)))
    d = d.withColumn("__run", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs_ = d.groupBy(*by, "__stretch", "__run").agg(F.first("__value").alias("value"), F.count(F.lit(1)).alias("n"))
    one = F.struct(F.col("__run").alias("run"), "value", "n")
    ends = runs_.groupBy(*by, "__stretch").agg(F.min(one).alias("a"), F.max(one).alias("z"), F.max("n").alias("longest"), F.sum("n").alias("rows"))
    return ends.select(*by, F.col("__stretch").alias("stretch"), F.col("a.value").alias("first"), F.col("a.n").alias("first_n"), F.col("z.value").alias("last"), F.col("z.n").alias("last_n"), "longest", (F.col("z.run") - 1).alias("transitions"), "rows")


def stitched(parts: DataFrame, by: list[str]) -> DataFrame:
    """by, max_run, transitions of whole groups, from the summaries of their stretches: runs that meet at a border are one."""
    whole = F.struct("stretch", "first", "first_n", "last", "last_n", "longest", "transitions")
    d = parts.groupBy(*by).agg(F.array_sort(F.collect_list(whole)).alias("s"))  # as many as there are ranges
    start = F.struct(F.lit(None).cast(dict(parts.dtypes)["last"]).alias("last"), F.lit(0).cast("bigint").alias("open"), F.lit(0).cast("bigint").alias("longest"), F.lit(-1).cast("bigint").alias("transitions"))

    def meet(a, x):
        same = F.coalesce(a["last"] == x["first"], F.lit(False))
        joined = x["first_n"] + F.when(same, a["open"]).otherwise(0)
        return F.struct(
            x["last"].alias("last"), F.when(x["transitions"] == 0, joined).otherwise(x["last_n"]).alias("open"),
            F.greatest(a["longest"], joined, x["longest"]).alias("longest"), (a["transitions"] + x["transitions"] + F.when(same, 0).otherwise(1)).alias("transitions"))

    total = F.aggregate("s", start, meet)
    return d.select(*by, total["longest"].alias("max_run"), total["transitions"].alias("transitions"))


def interleaving(df: DataFrame, value: str, order: list, by: list[str]) -> DataFrame:
    """by, longest run, transitions, distinct values; null values are runs of their own, and don't count as a value."""
    kinds = df.groupBy(*by).agg(F.countDistinct(value).alias("buckets"))
    kinds = kinds.select(*[F.col(c).alias(f"__{c}") for c in by], "buckets")
    found = stitched(stretches(df, value, order, by), by)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return found.join(kinds, same).select(*by, "max_run", "transitions", "buckets")


def interarrivals(df: DataFrame, ts: str, by: list[str], order: list) -> DataFrame:
    """by, gaps, and mean and deviation of the seconds between arrivals."""
    w = Window.partitionBy(*by).orderBy(*order)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1e6
    return df.withColumn("__gap", gap).groupBy(*by).agg(F.count("__gap").alias("gaps"), F.avg("__gap").alias("mean_s"), F.stddev_pop("__gap").alias("std_s"))


def estimated_bytes(reads: Column, mean_length: float, zipped: bool) -> Column:
    """Of generated files."""
    size = reads * F.lit(int(2 * mean_length + 80))
    return F.floor(size * F.lit(0.3)).cast("bigint") if zipped else size.cast("bigint")


def progress(done: Column, total: Column, elapsed: Column) -> tuple[Column, Column, Column]:
    """(percent, files a second, seconds left): the last is null before the first file and 0 at the end."""
    percent = F.when(total > 0, done * 100.0 / total).otherwise(F.lit(0.0))
    rate = F.when(elapsed > 0, done / elapsed).otherwise(F.lit(0.0))
    eta = F.when(done >= total, F.lit(0.0)).when(done > 0, (total - done) * elapsed / done)
    return percent, rate, eta


def matches(names: DataFrame, patterns: list[str]) -> Column:
    """Whether a name at depth 0 or 1 fits one of the globs. names: name, depth."""
    from readloom.functions.naming import glob_regex

    fits = F.lit(False)
    for p in patterns:
        fits = fits | F.col("name").rlike(glob_regex(p))
    return (F.col("depth") <= 1) & fits


#: Profiles for fewer than 50 files, for fewer than 500, and for more.
RECOMMENDED = (["steady", "bursty", "development"], ["bursty", "gradual_drift", "development"], ["high_throughput", "bursty", "development"])


def recommended(files: Column) -> Column:
    """Profiles for a number of files, at most five, none twice."""
    few, some, many = (F.array(*map(F.lit, x)) for x in RECOMMENDED)
    return F.slice(F.array_distinct(F.when(files < 50, few).when(files < 500, some).otherwise(many)), 1, 5)

