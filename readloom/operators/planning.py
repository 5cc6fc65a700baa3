"""Plans of output files as DataFrames: positions, chunks, dealing, rounds, batches, apportionment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.rng import uniform
from readloom.storage import written


def before(df: DataFrame, order: list, value: Column | str, name: str, by: str | None = None, parts: int | None = None) -> DataFrame:
    """df with the sum of value over the rows before each one in order (of its group, if there is one), without a window over all rows.

    Rows are dealt into ranges and written once, for a range partitioner samples anew in every plan. Within a range the sum is a window; the ranges' own
    sums, a row a range (and group), give what each one starts with. A group with most of the rows is spread over many ranges. value is not null.
    """
    keys = ([by] if by else []) + list(order)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__value", value if isinstance(value, Column) else F.col(value))
    ranged = written(ranged.repartitionByRange(parts, *keys).withColumn("__range", F.spark_partition_id()), "ranges")
    group = [F.col(by).alias("__by")] if by else []
    sums = ranged.groupBy(*group, F.col("__range").alias("__r")).agg(F.sum("__value").alias("__s"))
    sums = sums.groupBy(*(["__by"] if by else [])).agg(F.array_sort(F.collect_list(F.struct("__r", "__s"))).alias("__l"))  # as many as there are ranges
    zero = F.lit(0).cast(dict(sums.dtypes)["__l"].rpartition("__s:")[2].rstrip(">"))
    first = F.transform("__l", lambda x, i: F.struct(x["__r"].alias("r"), F.aggregate(F.slice("__l", 1, i), zero, lambda s, y: s + y["__s"]).alias("s")))
    sums = sums.select(*(["__by"] if by else []), F.inline(first).alias("__r", "__before"))
    own = F.sum("__value").over(Window.partitionBy("__range", *([by] if by else [])).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    out = ranged.withColumn(name, F.coalesce(own, zero))
    same = F.col("__range") == F.col("__r")
    out = out.join(sums, same & F.col(by).eqNullSafe(F.col("__by"))) if by else out.join(F.broadcast(sums), same)  # a row a range
    return out.withColumn(name, F.col(name) + F.col("__before")).drop("__value", "__range", "__r", "__by", "__before")


def positions(df: DataFrame, order: list, group: str | None = None, name: str = "pos", parts: int | None = None) -> DataFrame:
    """df with each row's place, from 0, in the order given (of its group, if there is one), by before()."""
    return before(df, order, F.lit(1).cast("bigint"), name, group, parts)


def chunked(df: DataFrame, per_file: int, pos: str = "pos") -> DataFrame:
    """chunk_idx of each read; the last chunk is short."""
    return df.withColumn("chunk_idx", F.floor(F.col(pos) / per_file).cast("bigint"))


def chunk_table(df: DataFrame, key: str, by: list[str] = ()) -> DataFrame:
    """One row a chunk: n reads, first_key, last_key."""
    return df.groupBy(*by, "chunk_idx").agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def dealt(chunks: DataFrame, barcodes: int) -> DataFrame:
    """Chunks dealt round robin: barcode_idx and the file's index within it."""
    return chunks.withColumn("barcode_idx", F.pmod("chunk_idx", F.lit(barcodes)).cast("bigint")).withColumn("file_index", F.floor(F.col("chunk_idx") / barcodes).cast("bigint"))


def batched(seq: Column, size: int) -> Column:
    return F.floor(seq / size).cast("bigint")


def small_order(df: DataFrame, order: list, name: str = "seq_no") -> DataFrame:
    """Numbers the rows of a plan, which has a row a file."""
    return positions(df, order, name=name)


def rounds(plan: DataFrame, file_index: str, barcode: str, seed: str) -> DataFrame:
    """Stratified rounds: round r has each barcode's r-th file, in an order drawn anew each round; seq_no is the place in all."""
    u = uniform(seed, F.col(file_index), F.col(barcode))
    return small_order(plan.withColumn("u", u), [file_index, "u", barcode])


def apportioned(weights: DataFrame, total: Column, idx: str = "idx", weight: str = "w", by: list[str] = ()) -> DataFrame:
    """weights with n: total dealt out by largest remainders, where every weight over 0 gets 1 at least.

    floor(w * total), raised to 1 for w over 0; what is missing goes, one each, to the largest remainders (a raised row
    keeps its own), ties to the lower idx, at most one a row; what is too much is taken from the largest, down to 1, ties to
    the lower idx. So weights that sum to less than 1 may leave a rest, and a total under the number of weights is exceeded.
    """
    whole = Window.partitionBy(*by)
    d = weights.withColumn("__t", total.cast("bigint")).withColumn("__k", F.count(F.lit(1)).over(whole))
    exact = F.col(weight) * F.col("__t")
    d = d.withColumn("__fl", F.floor(exact).cast("bigint")).withColumn("__rem", exact - F.col("__fl"))
    d = d.withColumn("__fl", F.when((F.col(weight) > 0) & (F.col("__fl") < 1), F.lit(1).cast("bigint")).otherwise(F.col("__fl")))
    d = d.withColumn("__gap", F.col("__t") - F.sum("__fl").over(whole))
    d = d.withColumn("__r", F.row_number().over(whole.orderBy(F.desc("__rem"), idx)))
    spare = F.greatest(F.col("__fl") - 1, F.lit(0))
    before = F.coalesce(F.sum(spare).over(whole.orderBy(F.desc("__fl"), idx).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    less = F.least(spare, F.greatest(-F.col("__gap") - before, F.lit(0)))
    n = F.when(F.col("__k") == 1, F.col("__t")).when(F.col("__gap") > 0, F.col("__fl") + (F.col("__r") <= F.col("__gap")).cast("bigint")).otherwise(F.col("__fl") - less)
    return d.withColumn("n", n.cast("bigint")).drop("__t", "__k", "__fl", "__rem", "__gap", "__r")


def renormalised(df: DataFrame, weight: str, by: list[str] = (), name: str = "share") -> DataFrame:
    return df.withColumn(name, F.col(weight) / F.sum(weight).over(Window.partitionBy(*by)))


def cascaded(df: DataFrame, n: str, per_file: int) -> DataFrame:
    """A row a file of n reads: file_index and read_count; one empty file for none."""
    files = F.greatest(F.lit(1), F.ceil(F.col(n) / per_file)).cast("bigint")
    d = df.withColumn("file_index", F.explode(F.sequence(F.lit(0).cast("bigint"), files - 1)))
    return d.withColumn("read_count", F.least(F.lit(per_file).cast("bigint"), F.col(n) - F.col("file_index") * per_file))


def running_before(df: DataFrame, order: list, value: str, name: str = "start", by: str | None = None) -> DataFrame:
    """Sums of value over the rows before."""
    return before(df, order, F.col(value).cast("bigint"), name, by)
