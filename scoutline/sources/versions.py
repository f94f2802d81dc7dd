"""Tables of one index that change together: files are written once, and a manifest says which of them count.

A commit writes new files beside the old ones and then one new manifest by a rename. Whoever reads goes by the manifest of the highest number, so a
commit that stops at any step leaves the index as it was. A second writer finds its manifest's number taken, and fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of indexed files for one bucket, about, and buckets at most.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 4096
#: Manifests whose files are kept by a clean-up: readers of the one before may still be at work.
KEPT = 2


def buckets_for(size: int) -> int:
    """A power of two."""
    n = 1
    while n < MOST_BUCKETS and n * BUCKET_BYTES < size:
        n *= 2
    return n


def bucket(file: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(n)).cast("int")


class Store:
    """Tables under one folder; a table is a list of folders of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.top = self._path("")
        self.fs = self.top.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _manifests(self) -> list[int]:
        if not self.fs.exists(self.top):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.top)]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _manifest(self, n: int) -> dict:
        stream = self.fs.open(self._path(f"manifest-{n}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """number, tables (name to folders) and facts of the last commit."""
        found = self._manifests()
        return self._manifest(found[-1]) if found else {"number": 0, "tables": {}, "facts": {}}

    def read(self, name: str, schema: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a table, or of some buckets of it; none before the first commit."""
        folders = self.manifest()["tables"].get(name, [])
        if buckets is not None:
            wanted = {f"bucket={b}" for b in buckets}
            folders = [f for f in folders if f.rsplit("/", 1)[1] in wanted]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f}" for f in folders])

    def stage(self, name: str, rows: DataFrame, by_bucket: bool = False) -> list[str]:
        """Writes rows to a new folder and returns the folders that a table gets by them: one, or with a column bucket one for each bucket."""
        at = f"{name}/{uuid.uuid4().hex}"
        if not by_bucket:
            rows.write.parquet(f"{self.folder}/{at}")
            return [at]
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{at}")
        return [f"{at}/{n}" for n in sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(at))) if n.startswith("bucket=")]

    def staged(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def commit(self, add: dict[str, list[str]], drop: dict[str, Iterable[str]] | None = None, since: dict | None = None, **facts) -> None:
        """Takes folders into tables and out of them, all at once. since is the manifest that the change was worked out from."""
        last = since or self.manifest()
        tables = {k: [*v] for k, v in last["tables"].items()}
        for name, gone in (drop or {}).items():
            out = {*gone}
            tables[name] = [f for f in tables.get(name, []) if f not in out]
        for name, new in add.items():
            tables[name] = [*tables.get(name, []), *new]
        body = {"number": last["number"] + 1, "tables": tables, "facts": last["facts"] | facts}
        self._write(f".{uuid.uuid4().hex}.json", json.dumps(body), f"manifest-{body['number']}.json")
        self.clean()

    def _write(self, first: str, text: str, name: str) -> None:
        self.fs.mkdirs(self.top)
        stream = self.fs.create(self._path(first), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self._path(name)) or not self.fs.rename(self._path(first), self._path(name)):
            self.fs.delete(self._path(first), False)
            raise OSError(f"{name} was written by someone else")

    def clean(self) -> None:
        """Removes what neither of the last manifests names: old files, and those of commits that never ended."""
        found = self._manifests()
        kept = {f.split("/")[0] + "/" + f.split("/")[1] for n in found[-KEPT:] for folders in self._manifest(n)["tables"].values() for f in folders}
        for status in self.fs.listStatus(self.top):
            name = status.getPath().getName()
            if status.isDirectory():
                for inner in self.fs.listStatus(status.getPath()):
                    if f"{name}/{inner.getPath().getName()}" not in kept:
                        self.fs.delete(inner.getPath(), True)
        for n in found[:-KEPT]:
            self.fs.delete(self._path(f"manifest-{n}.json"), False)

    def clear(self) -> None:
        self.fs.delete(self.top, True)
