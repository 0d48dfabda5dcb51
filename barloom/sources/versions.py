"""A partitioned table whose partitions are replaced together, by a switch of one pointer.

Rows are under data/version=..., partition by partition, and are never changed. A list names the version that counts of each
partition; the pointer names the list. A write makes a new version, then a new list, and then switches: a task that is
repeated reads the rows it read before, a write that breaks off leaves what was there, and a partition whose rows all go is in
no list. One writer at a time; readers need not wait.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import files


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partition_by: list[str]):
        self.spark, self.path, self.schema, self.by = spark, path.rstrip("/"), schema, partition_by
        self.listed = T.StructType([T.StructField("version", T.StringType()), *(schema[c] for c in partition_by)])

    def current(self) -> str | None:
        """The list that counts."""
        numbers = files.names(f"{self.path}/current")
        return files.get(f"{self.path}/current/{numbers[-1]}").decode() if numbers else None

    def partitions(self) -> DataFrame:
        """version and the partition's columns of all partitions."""
        at = self.current()
        return self.spark.createDataFrame([], self.listed) if at is None else self.spark.read.schema(self.listed).parquet(f"{self.path}/lists/{at}")

    def _data(self) -> DataFrame:
        if not files.exists(f"{self.path}/data"):  # nothing but empty versions yet
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, self.listed["version"]]))
        return self.spark.read.schema(T.StructType([*self.schema.fields, self.listed["version"]])).parquet(f"{self.path}/data")

    def read(self) -> DataFrame:
        """The rows of the versions that count; filters on the partition's columns prune folders."""
        return self._data().join(self.partitions(), ["version", *self.by], "left_semi").select(*self.schema.names)

    def write_version(self, rows: DataFrame) -> str:
        """Store rows that nobody sees yet. Rows without a value of a partition's column are left out."""
        version = uuid.uuid4().hex
        rows = rows.select(*self.schema.names).na.drop(subset=self.by).withColumn("version", F.lit(version))
        rows.write.mode("append").partitionBy("version", *self.by).parquet(f"{self.path}/data")
        return version

    def switch(self, version: str, touched: DataFrame) -> None:
        """From now on the partitions `touched` are those of `version`, and gone where it has none of them."""
        written = self._data().where(F.col("version") == version).select("version", *self.by).distinct()
        kept = self.partitions().join(touched.select(*self.by).distinct(), self.by, "left_anti").select("version", *self.by)
        kept.unionByName(written).coalesce(1).write.parquet(f"{self.path}/lists/{version}")
        numbers = files.names(f"{self.path}/current")
        files.put(f"{self.path}/current/{int(numbers[-1]) + 1 if numbers else 0:012d}", version.encode())

    def replace(self, rows: DataFrame, touched: DataFrame) -> None:
        self.switch(self.write_version(rows), touched)

    def vacuum(self) -> list[str]:
        """Delete the versions that no partition is read from, once nobody reads them any more; their names."""
        used = {r.version for r in self.partitions().select("version").distinct().toLocalIterator()}
        old = [n for n in files.names(f"{self.path}/data") if n.startswith("version=") and n.removeprefix("version=") not in used]
        for n in old:
            files.remove(f"{self.path}/data/{n}")
        for n in files.names(f"{self.path}/lists"):
            if n != self.current():
                files.remove(f"{self.path}/lists/{n}")
        return [n.removeprefix("version=") for n in old]
