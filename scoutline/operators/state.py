"""Incremental state: what changed, and tables brought up to date by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 1


def changes(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) of two snapshots (path, mtime, size): added, modified, deleted or unchanged."""
    a, b = indexed.select("path", F.struct("mtime", "size").alias("was")), current.select("path", F.struct("mtime", "size").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def deleted(indexed: DataFrame, current: DataFrame) -> DataFrame:
    return indexed.select("path").join(current.select("path"), "path", "left_anti")


def to_index(changed: DataFrame) -> DataFrame:
    return changed.where(F.col("change").isin("added", "modified")).select("path")


def indexed_files(symbols: DataFrame) -> DataFrame:
    return symbols.select("file").distinct()


def replace_by_file(old: DataFrame, new: DataFrame, removed: DataFrame, key: str = "file") -> DataFrame:
    """old without the rows of files that are removed or have new rows, and the new rows."""
    gone = removed.select(key).unionByName(new.select(key)).distinct()
    return old.join(gone, key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def drop_stale(cached: DataFrame, changed: DataFrame | None, key: str = "file") -> DataFrame:
    """Cached rows of files that are neither modified nor deleted; without a change set nothing is kept."""
    if changed is None:
        return cached.limit(0)
    stale = changed.where(F.col("change").isin("modified", "deleted")).select(F.col("path").alias(key))
    return cached.join(stale, key, "left_anti").select(cached.columns)


def merge_cached(new: DataFrame, cached: DataFrame, changed: DataFrame | None, key: str = "file") -> DataFrame:
    return new.unionByName(drop_stale(cached, changed, key))


def file_key(path: Column) -> Column:
    """A file name for a path: separators become __ and dots _d_."""
    return F.replace(F.regexp_replace(path, r"[/\\]", "__"), F.lit("."), F.lit("_d_"))


def short_hash(path: Column) -> Column:
    """Eight hex digits of SHA-256."""
    return F.substring(F.sha2(F.encode(path, "UTF-8"), 256), 1, 8)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of either table, those of new where both have the key."""
    o, n = old.select(key, F.struct(*old.columns).alias("_o")), new.select(key, F.struct(*old.columns).alias("_n"))
    return o.join(n, key, "full_outer").select(F.coalesce("_n", "_o").alias("r")).select("r.*")


def crawl_stats(parsed: DataFrame) -> DataFrame:
    """One row from (path, error, symbol_count): files found, parsed, failed, and symbols of those parsed."""
    failed = F.col("error").isNotNull()
    return parsed.agg(F.count("*").alias("found"), F.count_if(~failed).alias("parsed"), F.count_if(failed).alias("failed"), F.coalesce(F.sum(F.when(~failed, F.col("symbol_count"))), F.lit(0)).alias("symbols"))


def index_stats(state: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: files and last change of a snapshot (path, mtime, version), its version, and the number of symbols."""
    return state.agg(F.count("*").alias("files"), F.max("mtime").alias("last_updated"), F.max("version").alias("version")).join(symbols.agg(F.count("*").alias("symbols")))


def checked_version(state: DataFrame, version: int = VERSION) -> DataFrame:
    """state if its version column is the expected one in every row, else an error when it is read."""
    ok = F.when(F.col("version") == version, F.col("version")).otherwise(F.raise_error(F.concat(F.lit("index version "), F.col("version"))).cast("int"))
    return state.withColumn("version", ok)
