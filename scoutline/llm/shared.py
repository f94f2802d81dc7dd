"""Scratch tables in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker holds as Python objects at once.
PART = 256
#: The setting by which Spark removes checkpoints that nothing refers to any more.
CLEANED = "spark.cleaner.referenceTracking.cleanCheckpoints"
#: Rows of a table of a few numbers each that is broadcast, at most; Spark joins larger ones by its own choice.
BROADCAST_ROWS = 1_000_000


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of PART, so that a worker's memory does not grow with the session's batch size."""
    for b in batches:
        for at in range(0, b.num_rows, PART):
            yield b.slice(at, PART)


def gathered(batches: Iterable[pa.RecordBatch], rows: int = 10_000, size: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many rows or bytes, for work that is done once for equal values of a batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def small(saved: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A saved table, to be broadcast in joins if it has no more than so many rows; fewer where rows are not just a few numbers."""
    return F.broadcast(saved) if saved.count() <= rows else saved


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset a local one of our own, which is an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share, as the master is {master}")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scoutline-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


class Scratch:
    """Tables written to the shared folder for the length of a ``with`` block.

    Written tables cut lineage and survive the loss of executors. Whatever a caller returns
    from the block must not read them any more: use ``keep`` for the result.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/scoutline-{uuid.uuid4().hex}"
        self.n = 0
        self.held: dict[DataFrame, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def save(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self.held[saved] = path
        return saved

    def drop(self, *tables: DataFrame) -> None:
        """Removes saved tables that nothing reads any more, so that they take no disk until the end."""
        for table in tables:
            self._delete(self.held.pop(table))

    def keep(self, df: DataFrame) -> DataFrame:
        """A reliable checkpoint, which Spark removes when nothing refers to it where CLEANED is set; where it is not the files stay, and a warning says so."""
        if self.spark.conf.get(CLEANED, "false") != "true":
            warnings.warn(f"{CLEANED} is not true: checkpoints stay in {shared_dir(self.spark)}", stacklevel=3)
        return df.checkpoint()

    def __exit__(self, *_: object) -> None:
        self._delete(self.root)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) long edges -> (node, component), component the smallest node reachable; a table of scratch.

    Alternating large-star and small-star rounds, each one saved. The hot node of a star
    is a join key whose rows Spark's skew handling may split; no node's neighbours are gathered.
    Nulls and self-loops are ignored; an empty input gives an empty result.
    """
    e = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u > v")
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, e = e, scratch.save(small)
        scratch.drop(before)
        now = mark(e)
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    nodes = scratch.save(nodes)
    scratch.drop(e)
    return nodes
