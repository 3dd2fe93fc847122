"""Written intermediate tables in a folder that the cluster shares; groups that tasks run over in one stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares: the checkpoint folder, or the warehouse where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/convmatch"


class saver:
    """Written tables under ``root``, a folder that all executors share.  They go when the
    application ends, or before with :meth:`drop`."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, root or shared_root(spark)

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/rounds-{uuid.uuid4().hex}"
        at, fs = self._at(path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        df.write.mode("append").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._folder = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this saver that no plan reads any more."""
        for df in tables:
            at, fs = self._at(df._folder)
            fs.delete(at, True)


def in_groups(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` dealt by ``by`` and sorted inside its partitions, with ``_at``, a row's number in
    its group from 1, and ``_of``, the group's rows: the input of :func:`whole_groups`."""
    w = Window.partitionBy(*by)
    counted = df.withColumn("_of", F.count(F.lit(1)).over(w)).withColumn("_at", F.row_number().over(w.orderBy(*order)))
    return counted.sortWithinPartitions(*by, "_at")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, starts, sizes) of as many whole groups as a batch completes, for a function that
    takes small groups by the thousand: a call for each costs milliseconds.  One group and one
    batch are held at most."""
    held, rows, need = [], 0, 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if not rows or rows < need:
            continue
        table = pa.Table.from_batches(held)
        start = np.flatnonzero(table["_at"].to_numpy() == 1)
        size = table["_of"].to_numpy()[start]
        need = int(size[-1])
        end = rows if start[-1] + need == rows else int(start[-1])
        if end:
            whole = start < end
            yield table.slice(0, end), start[whole], size[whole]
        rows -= end
        held = table.slice(end).to_batches() if rows else []
        need = need if rows else 0
