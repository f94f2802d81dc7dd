"""File events of a project as a streaming source, a watcher that is polled or waited for, and timers on processing time.

Each read lists the project and compares it with the listing of the last offset. Listing and events of an offset are
written to a log before the offset is given out, so that a restart replays the very same events, and what changed in between is found by the next read.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from scoutline.streaming.watch import SUPPORTED

SCHEMA = "path string, kind string, n long"
#: Pause that ends a burst of events.
PAUSE_MS = 500


def listing(root: str) -> dict[str, list[int]]:
    """Modification time in ns and size of the supported files under root, by path; hidden files and folders are left out."""
    out, wanted = {}, re.compile(SUPPORTED)
    for folder, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".")]
        for name in files:
            path = os.path.join(folder, name)
            if wanted.search("/" + name) and not name.startswith("."):
                try:
                    s = os.stat(path)
                except OSError:  # it went meanwhile
                    continue
                out[path[len(root.rstrip("/")) :]] = [s.st_mtime_ns, s.st_size]
    return out


def changed(was: dict[str, list[int]], now: dict[str, list[int]]) -> list[tuple[str, str]]:
    """(path, kind): created, modified or deleted, by path."""
    kinds = {p: "deleted" if p not in now else "created" if p not in was else "modified" for p in was.keys() | now.keys() if was.get(p) != now.get(p)}
    return sorted(kinds.items())


class EventLog:
    """Listings and events by number, in a folder of files that are written whole or not at all."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def write(self, n: int, body: dict) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        part = self.folder / f".{uuid.uuid4().hex}"
        part.write_text(json.dumps(body))
        os.replace(part, self.folder / f"{n}.json")

    def read(self, n: int) -> dict | None:
        f = self.folder / f"{n}.json"
        return json.loads(f.read_text()) if f.exists() else None

    def forget(self, n: int) -> None:
        """Removes what is older than n; its listing is still needed."""
        for f in self.folder.glob("*.json"):
            if int(f.stem) < n:
                f.unlink()


class _Events(SimpleDataSourceStreamReader):
    def __init__(self, root: str, log: str, fresh: bool):
        self.root, self.log = root, EventLog(log)
        if self.log.read(0) is None and not any(self.log.folder.glob("*.json")):
            self.log.write(0, {"files": {} if fresh else listing(root), "events": []})

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = int(start["n"]) + 1
        body = self.log.read(n)  # written by a run that stopped before the offset was taken
        if body is None:
            now = listing(self.root)
            events = changed(self.log.read(n - 1)["files"], now)
            if not events:
                return iter([]), start
            body = {"files": now, "events": events}
            self.log.write(n, body)
        return iter([(p, k, n) for p, k in body["events"]]), {"n": n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([(p, k, n) for n in range(int(start["n"]) + 1, int(end["n"]) + 1) for p, k in self.log.read(n)["events"]])

    def commit(self, end: dict) -> None:
        self.log.forget(int(end["n"]) - 1)


class ProjectEvents(DataSource):
    """Options: path, the project; log, a folder of the source's own; existing, whether files there at the start are events (false)."""

    @classmethod
    def name(cls) -> str:
        return "project_events"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Events(self.options["path"], self.options["log"], self.options.get("existing", "false") == "true")


def project_events(spark: SparkSession, root: str, log: str, existing: bool = False) -> DataFrame:
    """A stream (path, kind, n) of file events; n numbers the listing that found the event."""
    spark.dataSource.register(ProjectEvents)
    return spark.readStream.format("project_events").option("path", root).option("log", log).option("existing", str(existing).lower()).load()


class Watcher:
    """Events of a project that can be polled or waited for. Each batch becomes a folder of rows, and is given out once."""

    def __init__(self, spark: SparkSession, root: str, folder: str, every: str = "500 milliseconds"):
        self.spark, self.given = spark, 0
        self.batches = f"{folder}/batches"
        self.query = project_events(spark, root, f"{folder}/log").writeStream.foreachBatch(self._kept).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).start()

    def _kept(self, rows: DataFrame, n: int) -> None:
        # A batch that is run again writes the same rows to the same folder.
        rows.write.mode("overwrite").parquet(f"{self.batches}/{n:012d}")

    def _ready(self) -> list[str]:
        return sorted(str(p.parent) for p in Path(self.batches).glob("*/_SUCCESS"))

    def poll(self) -> DataFrame:
        """Events since the last call, at once; none if nothing happened."""
        ready = self._ready()
        new, self.given = ready[self.given :], len(ready)
        return self.spark.read.schema(SCHEMA).parquet(*new) if new else self.spark.createDataFrame([], SCHEMA)

    def wait(self, seconds: float) -> DataFrame:
        """Events since the last call, as soon as there are any; none if there are none until the time is over, or the stream has ended."""
        end = time.monotonic() + seconds
        while time.monotonic() < end and self.query.isActive:
            rows = self.poll()
            if not rows.isEmpty():
                return rows
            time.sleep(0.05)
        return self.poll()

    def stop(self) -> None:
        self.query.stop()


class Bursts(StatefulProcessor):
    """Paths of a project since its last pause; a timer on processing time ends a burst PAUSE_MS after its last event, whether or not another one comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "n long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for f in rows:
            for path, n in f["path"].value_counts().items():
                before = self.paths.getValue((path,)) if self.paths.containsKey((path,)) else (0,)
                self.paths.updateValue((path,), (int(before[0]) + int(n),))
        if self.due.exists():
            self.handle.deleteTimer(int(self.due.get()[0]))
        at = timerValues.getCurrentProcessingTimeInMs() + PAUSE_MS
        self.due.update((at,))
        self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = sorted((k[0], int(v[0])) for k, v in self.paths.iterator())
        self.paths.clear()
        self.due.clear()
        yield pd.DataFrame({"key": [key[0]], "n": [sum(n for _, n in held)], "paths": [[p for p, _ in held]]})

    def close(self) -> None:
        pass


class Increases(StatefulProcessor):
    """The greatest modification time of a repository so far; a later one gives a row PAUSE_MS after it was seen, with the greatest by then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.most = handle.getValueState("most", "mtime long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(int(f["mtime"].max()) for f in rows)
        first = not self.most.exists()
        before = now if first else int(self.most.get()[0])
        if first or now > before:
            self.most.update((now,))
        if now > before and not self.due.exists():
            at = timerValues.getCurrentProcessingTimeInMs() + PAUSE_MS
            self.due.update((at,))
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.due.clear()
        yield pd.DataFrame({"key": [key[0]], "mtime": [int(self.most.get()[0])]})

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _timed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")


def timed_bursts(stream: DataFrame, key: str) -> DataFrame:
    """(key, n, paths) of a stream (key, path): the different paths of a burst, PAUSE_MS after its last event; n counts events."""
    return _timed(stream.select(key, "path"), key, Bursts(), f"{key} string, n long, paths array<string>".replace(f"{key} string", "key string"))


def timed_increases(stream: DataFrame, key: str) -> DataFrame:
    """(key, mtime) of a stream (key, mtime): a repository to read again, PAUSE_MS after its modification time went up."""
    return _timed(stream.select(key, "mtime"), key, Increases(), "key string, mtime long")


def repository_mtime(repo: str) -> int:
    """The greatest modification time, in ns, of what changes with commits and branches; 0 without any."""
    at = Path(repo) / ".git"
    found = [at / n for n in ("HEAD", "refs", "packed-refs")]
    return max((f.stat().st_mtime_ns for f in found if f.exists()), default=0)


def each_poll(spark: SparkSession, repos: list[str], poll: Callable[[str], int] = repository_mtime) -> DataFrame:
    """(repo, mtime) of now, to be appended to the folder that a stream of polls reads."""
    return spark.createDataFrame([(r, poll(r)) for r in repos], "repo string, mtime long")
