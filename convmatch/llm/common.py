"""Reading tables, written intermediate tables and words, shared by the operators."""

from __future__ import annotations

import ctypes
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: 0x20 and 0x09-0x0D.
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: the checkpoint folder, or the warehouse where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/convmatch"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts the lineage.

    The table goes when the application ends, whether its jobs succeeded or not.
    """
    path = f"{shared_dir(df.sparkSession)}/convmatch-{uuid.uuid4().hex}"
    _at(df.sparkSession, path).delete_on_exit()
    df.write.mode("append").parquet(path)
    _free(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


class _at:
    """A path of the shared file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def delete_on_exit(self) -> None:
        # takes only what is there
        self.fs.mkdirs(self.path)
        self.fs.deleteOnExit(self.path)


_freed = 0.0


def _free(spark: SparkSession, seconds: float = 3.0) -> None:
    """Let Spark drop the shuffle files of jobs that are over: it does so when its driver
    collects garbage, which a driver with much memory seldom needs to."""
    global _freed
    if time.monotonic() - _freed > seconds:
        spark._jvm.System.gc()
        _freed = time.monotonic()


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more, not even a plan not yet run."""
    for df in tables:
        _at(df.sparkSession, df._folder).delete()


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)``; a worker gives the memory of its task back when that ends.

    Spark keeps workers for later tasks, and what they have freed stays theirs meanwhile, beside
    the memory of stages that need no Python.
    """

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def give_back() -> None:
    """Return freed memory to the system, Arrow's and, where the C library can, its own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so that others cannot clash with its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two never-null longs, ``_id`` and ``_th``, that name a row up to repeats of (doc_id, text).

    ``_id`` is the doc_id, or a hash of the text where it is null; ``_th`` holds 63 bits of
    another hash of the text and, in its last bit, whether the doc_id is null.
    """
    void = F.col(doc_id).isNull()
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.lit("id"), F.col(text))).alias("_id"),
        (F.shiftleft(F.xxhash64(F.col(text), F.lit("text")), 1) + void.cast("long")).alias("_th"),
    ]


def key_doc_id() -> Column:
    """The doc_id, null or not, of a row key."""
    return F.when(F.col("_th").bitwiseAND(F.lit(1)) == 0, F.col("_id"))


#: Words of 64 bits in a sieve: 16.8 million bits, a table of a few MB however many keys there are.
_SIEVE_BITS = 18


def sifted(rows: DataFrame, keys: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose columns ``names`` are surely not in ``keys``, and the rest.

    The keys' hashes are bits of a table of bounded size, which is broadcast; so a join with
    the keys need not deal the rows of the first part.  The more keys, the more other rows
    are in the second part.
    """

    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn("_h", F.xxhash64(*names)).withColumn("_word", F.shiftrightunsigned("_h", 64 - _SIEVE_BITS)).withColumn("_bit", F.expr("shiftleft(1L, cast(_h & 63 as int))"))

    bits = written(hashed(keys).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    marked = hashed(rows).join(F.broadcast(bits), "_word", "left").withColumn("_maybe", F.coalesce(F.expr("_bits & _bit") != 0, F.lit(False)))
    return tuple(marked.where(c).select(*[f"`{n}`" for n in rows.columns]) for c in (~F.col("_maybe"), F.col("_maybe")))


def left_out(rows: DataFrame, gone: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` whose columns ``names`` are not in ``gone``; only those that may be there are dealt."""
    others, maybe = sifted(rows, gone, names)
    return others.unionByName(maybe.join(gone, names, "left_anti"))


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, component): the least node reachable over ``edges`` (a, b: long).

    Alternating large-star and small-star rounds.  Each star step groups by a node with a
    partial aggregate (min), never gathers a neighbourhood, and the rounds grow with the
    logarithm of the longest chain.  Stops when a round changes no edge.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b")
            .where("a <> b")
            .distinct()
        )
        nxt = written(small)
        done = nxt.count() == e.count() and nxt.join(e, ["a", "b"], "left_anti").isEmpty()
        discard(e)
        if done:
            return nxt.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        e = nxt
