"""Answers of queries that are asked by many qids: each is found once, and its rows are dealt to the qids at the end.

What is dealt can be billions of rows, so it is made in blocks: a run of an answer's rows meets a list of the qids that asked for it. Rows of a block stand
together, each with the same qids after it, and take a fraction of a byte in a file where rows in the order of a hash take two or more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a run, qids of a list, and rows of answers that a worker puts in order at once.
RUN, LIST, HELD = 256, 256, 1 << 17
#: Qids are gathered by ranges of 65,536 numbers before they are cut into lists.
RANGE_BITS = 16
#: More than the partitions of any job.
ALL_PARTITIONS = 1 << 20


def tasks(df: DataFrame) -> int:
    """The number of tasks for rows that are few but make many: Spark would put them in one."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _in_runs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The rows of each text side by side, in lists of RUN at most."""
    all_ = pa.Table.from_batches(held)
    text = all_.column(0).to_numpy()
    order = np.argsort(text, kind="stable")
    text, b = text[order], all_.take(order).combine_chunks().to_batches()[0]
    first = np.flatnonzero(np.append(True, np.diff(text) != 0))
    place = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
    starts = np.flatnonzero(place % RUN == 0)
    each = pa.StructArray.from_arrays(b.columns[1:], names=b.schema.names[1:])
    return pa.RecordBatch.from_arrays([pa.array(text[starts], pa.int64()), pa.ListArray.from_arrays(pa.array(np.append(starts, len(text)), pa.int32()), each)], names=["text", "rows"])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= HELD:
            yield _in_runs(held)
            held = []
    if any(x.num_rows for x in held):
        yield _in_runs(held)


def in_runs(answers: DataFrame) -> DataFrame:
    """(text, rows) of answers (text long, others): arrays of up to RUN rows, made where the rows are."""
    first, *others = answers.schema.fields
    return answers.mapInArrow(_runs, T.StructType([first, T.StructField("rows", T.ArrayType(T.StructType(others)))]))


def dealt(runs: DataFrame, who: DataFrame, most: int) -> DataFrame:
    """(qid, others) of runs (text, rows), a row for each qid of who (text, qid) that asked for the text; qids are distinct longs without nulls.

    Up to ``most`` of them are broadcast; Spark joins more by its own choice.
    """
    gathered = who.groupBy("text", F.shiftright("qid", RANGE_BITS).alias("range")).agg(F.array_sort(F.collect_list("qid")).alias("all"))  # 65,536 of them at most
    lists = gathered.select("text", F.explode(F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(LIST)), lambda i: F.slice("all", i + 1, LIST))).alias("qids"))
    met = runs.join(F.broadcast(lists) if who.limit(most + 1).count() <= most else lists, "text")
    # Generated code holds all rows that come of one row it reads. coalesce() ends it here, so that these are a run times a list and not times all lists.
    blocks = met.select("rows", "qids").coalesce(ALL_PARTITIONS)
    return blocks.select("qids", F.inline("rows")).withColumn("qid", F.explode("qids")).select("qid", *[x.name for x in runs.schema["rows"].dataType.elementType.fields])
