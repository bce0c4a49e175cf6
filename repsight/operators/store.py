"""Stored sets: dense set numbers (S7) and several tables saved as one.

A save writes the files of all its tables under names of its own and then
commits by creating one manifest entry, which names the files.  Readers follow
the manifest, so a save is in every table or in none: files of a save that did
not reach its commit are not read, and a batch that is run again after its
commit changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType(
    [T.StructField("batch", T.StringType()), T.StructField("last_id", T.LongType()),
     T.StructField("files", T.MapType(T.StringType(), T.ArrayType(T.StringType())))]
)


def number_rows(rows: DataFrame, order: list[str], name: str = "id", after: int = 0) -> DataFrame:
    """``rows`` with consecutive numbers ``after + 1 ..`` in ``order`` (a total order), without gaps.

    Rows are range-partitioned and sorted, and each range's numbers begin behind
    the rows of the ranges before it.  The table of offsets has a row per
    partition, whatever the input, so it is broadcast; no task sees more than a
    range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # partition number and place in it, kept by the checkpoint
    held = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__place", place).checkpoint()
    held = held.withColumns({"__part": F.shiftright("__place", 33), "__row": F.col("__place").bitwiseAND((1 << 33) - 1)})
    counts = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    numbered = held.join(F.broadcast(offsets), "__part")
    number = (F.lit(after) + F.col("__before") + F.col("__row") + 1).cast("bigint")
    return numbered.withColumn(name, number).drop("__part", "__row", "__place", "__before")


class SetStore:
    """Tables under one folder, read through their manifest.

    ``keys``: per table, its schema and the columns its files are ranged by.
    """

    def __init__(self, spark: SparkSession, path: str, tables: Mapping[str, tuple[T.StructType, tuple[str, ...]]]):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _entry(self, batch: str) -> str:
        return f"{self.path}/_manifest/{batch}.json"

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(self._entry(batch)))

    def save(self, batch: str, rows: Mapping[str, DataFrame], last_id: int | None = None) -> bool:
        """Add a batch to all tables at once; False if it is there already, in which case nothing changes."""
        if self.committed(batch):
            return False
        files = {name: self._write(batch, name, rows[name]) for name in self.tables}
        return self._commit(batch, files, last_id)

    def _write(self, batch: str, name: str, rows: DataFrame) -> list[str]:
        """Write a table's files into its folder, under names that no other attempt uses; returns the names."""
        from .tables import append_table

        schema, keys = self.tables[name]
        attempt = uuid.uuid4().hex
        folder = f"{self.path}/_attempts/{attempt}"
        append_table(rows, folder, schema, keys)
        self._fs.mkdirs(self._path(f"{self.path}/{name}"))
        names = []
        for status in self._fs.listStatus(self._path(folder)):
            given = status.getPath().getName()
            if given.endswith(".parquet"):
                names.append(f"{batch}-{attempt}-{given}")
                self._fs.rename(status.getPath(), self._path(f"{self.path}/{name}/{names[-1]}"))
        return names

    def _commit(self, batch: str, files: Mapping[str, list[str]], last_id: int | None) -> bool:
        """Create the manifest entry under its final name in one step; False if another attempt was first."""
        draft = self._path(f"{self.path}/_attempts/{uuid.uuid4().hex}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps({"batch": batch, "last_id": last_id, "files": dict(files)}), "utf-8"))
        out.close()
        self._fs.mkdirs(self._path(f"{self.path}/_manifest"))
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(draft, self._path(self._entry(batch)), none)  # fails where the name is taken
        except Exception:
            if self.committed(batch):
                return False
            raise
        return True

    def manifest(self) -> DataFrame:
        folder = f"{self.path}/_manifest"
        if not self._fs.exists(self._path(folder)):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(folder)

    def last_id(self) -> int:
        """The greatest number given by the saves so far, 0 before the first."""
        return self.manifest().agg(F.max("last_id")).first()[0] or 0

    def read(self, name: str) -> DataFrame:
        """A table's rows in the files that the manifest names."""
        schema, _ = self.tables[name]
        listed = self.manifest().select(F.explode(F.col("files")[name]).alias("__file"))
        if listed.isEmpty():
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows.withColumn("__file", F.col("_metadata.file_name")).join(listed, "__file", "left_semi").drop("__file")
