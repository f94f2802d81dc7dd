"""Sinks: appended sessions, index tables, snapshots, caches.

Tables that are brought up to date by file are partitioned by a hash bucket of the file. A change rewrites the
buckets that it touches, and no list of files is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from scoutline.operators import state, trigrams

BUCKETS = 64


def append_interactions(rows: DataFrame, folder: str) -> None:
    """Appends JSON lines, one folder for each session."""
    rows.withColumn("session", F.col("session_id")).write.mode("append").partitionBy("session").json(folder)


def bucket(file: Column) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(BUCKETS)).cast("int")


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def write_index(rows: DataFrame, folder: str, file: str = "file") -> None:
    """A table with the column ``file``, partitioned so that a file's rows can be replaced."""
    rows.withColumn("bucket", bucket(F.col(file))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def read_index(spark: SparkSession, folder: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema.add("bucket", "int")) if schema is not None else spark.read
    return reader.parquet(folder).drop("bucket")


def replace_files(spark: SparkSession, new: DataFrame, removed: DataFrame, folder: str, file: str = "file") -> None:
    """Takes the rows of removed files and of files with new rows out of the table, and puts the new rows in."""
    gone = removed.select(file).unionByName(new.select(file)).distinct()
    touched = [r[0] for r in gone.select(bucket(F.col(file)).alias("b")).distinct().collect()]  # BUCKETS at most
    if not touched:
        return
    try:
        held = spark.read.parquet(folder)
    except AnalysisException:
        return write_index(new, folder, file)
    rows = state.replace_by_file(held.where(F.col("bucket").isin(touched)).drop("bucket"), new, removed, file).withColumn("bucket", bucket(F.col(file)))
    staged = f"{folder}.new"
    rows.write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(rows.schema).parquet(staged)
    full = {r[0] for r in rows.select("bucket").distinct().collect()}
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    for b in [*{*touched} - full, None]:
        fs, path = _fs(spark, staged if b is None else f"{folder}/bucket={b}")
        fs.delete(path, True)


def clear(spark: SparkSession, folder: str) -> None:
    """Removes an index folder; one that is no index is refused."""
    fs, path = _fs(spark, folder)
    if fs.exists(path):
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        if any(not n.startswith(("bucket=", "part-", "_SUCCESS", ".", "version=")) for n in names):
            raise ValueError(f"{folder} holds more than an index")
        fs.delete(path, True)


def swapped(spark: SparkSession, rows: DataFrame, folder: str) -> None:
    """Overwrites a table that the rows may be read from: written beside it, and then put in its place."""
    rows.write.mode("overwrite").parquet(f"{folder}.new")
    fs, old = _fs(spark, folder)
    _, new = _fs(spark, f"{folder}.new")
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{folder}.new can't be renamed")


def write_state(spark: SparkSession, files: DataFrame, folder: str, version: int = state.VERSION) -> None:
    swapped(spark, files.withColumn("version", F.lit(version)), folder)


def read_state(spark: SparkSession, folder: str, version: int = state.VERSION) -> DataFrame:
    return state.checked_version(spark.read.parquet(folder), version)


def write_trigrams(files: DataFrame, folder: str) -> None:
    """Postings sorted by trigram, so that a lookup prunes row groups."""
    trigrams.index(files).repartitionByRange("tri").sortWithinPartitions("tri").write.mode("overwrite").parquet(folder)


def read_trigrams(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select("path", "tri")


def write_bitmaps(files: DataFrame, folder: str) -> None:
    """The trigrams of files (path, content) as bitmaps, with a number for each file; numbers of a partition follow each other, so that bitmaps are few."""
    spark = files.sparkSession
    files.select("path", F.monotonically_increasing_id().alias("id")).write.mode("overwrite").parquet(f"{folder}/files")
    numbered = spark.read.schema("path string, id long").parquet(f"{folder}/files").join(files.select("path", "content"), "path")
    trigrams.bitmaps(numbered, "id").repartitionByRange("tri").sortWithinPartitions("tri", "bucket").write.mode("overwrite").parquet(f"{folder}/bitmaps")


def search_bitmaps(spark: SparkSession, folder: str, queries: DataFrame) -> DataFrame:
    """(qid, path) of saved files that hold all trigrams of the query; a query below three bytes has one row, of null path: all files."""
    index = spark.read.schema("tri string, bucket long, bits binary, n long").parquet(f"{folder}/bitmaps")
    files = spark.read.schema("path string, id long").parquet(f"{folder}/files")
    return trigrams.matching(index, queries).join(files, "id", "left").select("qid", "path")


def save_cached(rows: DataFrame, folder: str) -> None:
    """A small result that is asked again: statistics, project keys, repositories. It has no expiry."""
    rows.write.mode("overwrite").json(folder)


def cached(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    """What was saved, or None."""
    try:
        return spark.read.schema(schema).json(folder)
    except AnalysisException:
        return None


def aside(spark: SparkSession, folder: str, schema: str, fetch) -> DataFrame:
    """What was saved, or else what fetch() gives, which is saved."""
    held = cached(spark, folder, schema)
    if held is None:
        save_cached(fetch(), folder)
        held = cached(spark, folder, schema)
    return held


def migrate_references(spark: SparkSession, legacy: str, folder: str, schema: str) -> bool:
    """Moves references from one JSON array to the table by file, if there is the one and not yet the other; tells whether it did."""
    (fs, old), (_, new) = _fs(spark, legacy), _fs(spark, folder)
    if not fs.exists(old) or fs.exists(new):
        return False
    write_index(spark.read.schema(schema).option("multiLine", True).json(legacy), folder)
    fs.delete(old, False)
    return True
