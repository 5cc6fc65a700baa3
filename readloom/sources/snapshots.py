"""A keyed table that is written anew as a whole and swapped at once."""

from __future__ import annotations

import uuid

import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.sources import sinks, store


class Snapshots:
    """Versions of a table under path; a small file names the one that counts.

    A version is complete before it is named, and the one before stays for those who still read it. One that can't be read counts as empty,
    so that its rows are looked up again. columns: DDL of the table; key: the columns that name a row, text of which case doesn't count.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, key: tuple[str, ...]):
        self.spark, self.path, self.columns, self.key = spark, path.rstrip("/"), columns, key

    def version(self) -> str | None:
        system, inside = store.located(f"{self.path}/CURRENT")
        if system.get_file_info(inside).type.name != "File":
            return None
        with system.open_input_stream(inside) as f:
            return f.read().decode(errors="replace").strip() or None

    def read(self, version: str | None = None) -> DataFrame:
        version = version or self.version()
        try:
            system, inside = store.located(f"{self.path}/{version}")
            found = pads.dataset(inside, filesystem=system, format="parquet")
            found.count_rows()  # of the files' ends alone
            names = {f.strip().split()[0] for f in self.columns.split(",")}
            if version and names <= set(found.schema.names):
                return self.spark.read.schema(self.columns).parquet(f"{self.path}/{version}")
        except (OSError, ValueError):
            pass
        return self.spark.createDataFrame([], self.columns)

    def put(self, rows: DataFrame) -> int:
        """Add the rows whose key the table doesn't have (one of those that share a key), and return how many. Without any there is no new version.

        Of two writers at once, the one that is done later starts again from what the other has named.
        """
        keys = [F.lower(F.col(k)).alias(f"__{k}") for k in self.key]
        names = [f"__{k}" for k in self.key]
        while True:
            now = self.version()
            old = self.read(now)
            value = F.struct(*[c for c in old.columns if c not in self.key])
            one = rows.select(*keys, value.alias("v")).dropna(subset=names).groupBy(*names).agg(F.min("v").alias("v"))
            one = one.select(*[F.col(f"__{k}").alias(k) for k in self.key], "v.*").select(*old.columns)
            new = one.join(old.select(*[F.lower(F.col(k)).alias(k) for k in self.key]), list(self.key), "left_anti")
            name = f"v-{uuid.uuid4().hex}"
            new.write.parquet(f"{self.path}/{name}.new")  # counted and joined once
            new = self.spark.read.schema(self.columns).parquet(f"{self.path}/{name}.new")
            n = new.count()
            if n:
                old.unionByName(new).write.parquet(f"{self.path}/{name}")
            system, inside = store.located(self.path)
            system.delete_dir(f"{inside}/{name}.new")
            if not n:
                return 0
            if self.version() == now:
                sinks.publish(name.encode(), f"{self.path}/CURRENT")
                self.drop_all_but(now, name)
                return n
            system.delete_dir(f"{inside}/{name}")

    def drop_all_but(self, *versions: str | None) -> None:
        import pyarrow.fs as pafs

        system, inside = store.located(self.path)
        for x in system.get_file_info(pafs.FileSelector(inside)):
            if x.type == pafs.FileType.Directory and x.base_name.startswith("v-") and not x.base_name.endswith(".new") and x.base_name not in versions:
                system.delete_dir(x.path)

    def clear(self) -> None:
        store.remove(f"{self.path}/CURRENT")
