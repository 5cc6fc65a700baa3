"""Shared helpers: written intermediate tables in the folder that executors share, row hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.storage import shared_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/readloom/{name}-{uuid.uuid4().hex}"


_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)  # a thread of the driver sees its own


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are removed at its end, but for those that are kept; nothing that outlives it may read them."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(hadoop).delete(at, True)


def materialize(df: DataFrame, name: str, keep: bool = False, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation of Python work. keep: also after scratch(). codec: zstd for texts, which it makes smaller."""
    path = scratch_path(df.sparkSession, name)
    paths = _scope.get()
    if paths is not None and not keep:
        paths.append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) decided by cols alone, the same in every run and partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def utf8(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def slices(text: pa.Array, chars: int) -> Iterator[tuple[int, int]]:
    """(first, behind the last) of neighbouring rows of about chars characters together, or of one longer text."""
    part = np.cumsum(pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False)) // chars
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    yield from zip(edges, edges[1:], strict=False)
