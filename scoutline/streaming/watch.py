"""Change streams: filtered file events, debounced bursts, incremental flushes, event lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Events 500 ms apart or more are of different bursts; session windows join those exactly at their gap.
GAP = "499999 microseconds"
SUPPORTED = r"(?i)[^/]\.(rs|md|txt)$"


def supported_events(events: DataFrame) -> DataFrame:
    """Events (paths, kind, ts) with the supported paths only; events without one are dropped."""
    return events.withColumn("paths", F.filter("paths", lambda p: p.rlike(SUPPORTED))).where(F.size("paths") > 0)


def bursts(events: DataFrame, key: str, path: str, late: str | None = "10 seconds") -> DataFrame:
    """(key, start, stop, n, paths): changed paths between pauses of 500 ms, for batches and streams alike.

    A streaming session needs a key: the project. late bounds how long state is kept.
    """
    source = events.withWatermark("ts", late) if late and events.isStreaming else events
    out = source.groupBy(key, F.session_window("ts", GAP).alias("w")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(path)).alias("paths"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "paths")


def flush(stream: DataFrame, on_change: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts the stream that hands each micro-batch of bursts to on_change."""
    return stream.writeStream.foreachBatch(on_change).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime="100 milliseconds").start()


def file_events(changed: DataFrame) -> DataFrame:
    """(path, kind) of a change set: created, modified or deleted; what did not change gives nothing. events.py has them as a stream."""
    kind = F.when(F.col("change") == "added", "created").otherwise(F.col("change"))
    return changed.where("change <> 'unchanged'").select("path", kind.alias("kind"))


class Dirty:
    """A result kept until something changed: the stream marks it, the next read makes it anew."""

    def __init__(self, make: Callable[[], DataFrame]):
        self.make, self.held, self.dirty = make, None, True

    def mark(self) -> None:
        self.dirty = True

    def get(self) -> DataFrame:
        if self.dirty:
            if self.held is not None:
                self.held.unpersist()
            self.held, self.dirty = self.make().persist(), False
        return self.held


MESSAGE = "struct<type:string,is_error:boolean,result:string,message:struct<content:array<struct<type:string,text:string,name:string,input:string>>>>"


def event_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(…, pos, chunk, text) of JSON event lines: assistant lines give their joined text as Delta and their first tool use as ToolUse, result lines Done. Others give nothing."""
    e = lines.withColumn("e", F.from_json(value, MESSAGE))
    content = F.coalesce(F.col("e.message.content"), F.array().cast("array<struct<type:string,text:string,name:string,input:string>>"))
    text = F.array_join(F.transform(F.filter(content, lambda c: c["type"] == "text"), lambda c: F.coalesce(c["text"], F.lit(""))), "")
    tool = F.get(F.filter(content, lambda c: c["type"] == "tool_use"), F.lit(0))["name"]
    chunk = lambda k, t: F.struct(F.lit(k).alias("chunk"), t.alias("text"))
    made = (
        F.when(F.col("e.type") == "assistant", F.array(F.when(text != "", chunk("Delta", text)), F.when(tool.isNotNull(), chunk("ToolUse", tool))))
        .when(F.col("e.type") == "result", F.array(chunk("Done", F.coalesce("e.result", F.lit("")))))
    )
    rest = [c for c in lines.columns if c != value]
    return e.select(*rest, F.posexplode(F.filter(made, lambda c: c.isNotNull())).alias("pos", "c")).select(*rest, "pos", "c.chunk", "c.text")


def increased(mtimes: DataFrame, key: str) -> DataFrame:
    """Polls (key, ts, mtime) at which the greatest mtime so far went up: a repository to read again."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    return mtimes.withColumn("was", F.max("mtime").over(w)).where("was is not null and mtime > was").drop("was")


def head_mtime(*columns: str) -> Column:
    return F.greatest(*columns)
