"""Byte trigrams: an inverted index that prunes candidates of a substring search.

The files of a trigram are bitmaps, one for each bucket of 32,768 numbers. A query's bitmaps of a bucket are put together with AND, so that
it costs a row for each trigram and bucket, whatever number of files these hold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.operators.equal_queries import RUN, dealt, tasks

#: Numbers of a bucket, as Spark's bitmaps have them, and of a piece of one that a task reads at once.
BUCKET, PIECE = 32_768, 2_048


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the UTF-8 bytes, as hex; none below three bytes."""
    data = F.encode(text, "UTF-8")
    n = F.octet_length(text)
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 2)), lambda i: F.hex(F.substr(data, i, F.lit(3))))))


def index(files: DataFrame) -> DataFrame:
    """(tri, path)."""
    return files.select("path", F.explode(trigrams(F.col("content"))).alias("tri"))


def bitmaps(files: DataFrame, number: str = "seq") -> DataFrame:
    """(tri, bucket, bits, n): the files of a trigram among those of a bucket; files: (number from 0, content). Close numbers make few buckets."""
    each = files.where(F.col(number) >= 0).select((F.col(number).cast("long") + 1).alias("id"), F.explode(trigrams(F.col("content"))).alias("tri"))
    placed = each.select("tri", F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("at"))
    return placed.groupBy("tri", "bucket").agg(F.bitmap_construct_agg("at").alias("bits")).withColumn("n", F.bitmap_count("bits"))


def _numbers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of the set bits, in runs."""
    for b in batches:
        for text, start, bits in zip(*(b.column(c) for c in ("text", "start", "bits")), strict=True):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), bitorder="little"))
            ends = np.append(np.arange(0, len(at), RUN), len(at))
            each = pa.StructArray.from_arrays([pa.array(start.as_py() + at, pa.int64())], names=["id"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends) - 1, text.as_py()), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], names=["text", "rows"])


def matching(index: DataFrame, queries: DataFrame, most_terms: int = 1_000_000) -> DataFrame:
    """(qid, id) of files that hold all trigrams of the query, by bitmaps. A query below three bytes has one row, of null id: all files.

    A query with a trigram that no file has ends there. In a bucket that lacks one of its trigrams no bitmap is read.
    """
    asked = queries.select(F.col("qid").cast("long").alias("qid"), trigrams(F.col("query")).alias("t"))
    short = asked.where(F.size("t") == 0).select("qid", F.lit(None).cast("long").alias("id"))
    # Queries of equal trigrams are answered once, as the first of them.
    alike = asked.where(F.size("t") > 0).withColumn("t", F.array_sort("t")).distinct()
    texts = alike.groupBy("t").agg(F.min("qid").alias("text"))
    terms = texts.select(F.col("text").alias("qid"), F.size("t").alias("k"), F.explode("t").alias("tri"))
    near = F.broadcast if terms.limit(most_terms + 1).count() <= most_terms else (lambda x: x)
    counted = index.select("tri", "bucket").join(near(terms), "tri").groupBy("qid", "bucket", "k").agg(F.count("*").alias("has")).where("has = k").select("qid", "bucket")
    alive = terms.join(counted, "qid").select("tri", "bucket", "qid", "k")
    met = alive.join(index.select("tri", "bucket", "bits"), ["tri", "bucket"]).groupBy("qid", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    # Buckets and numbers are counted from 1. Bitmaps are cut into pieces and dealt out, as a few of them stand for most of the result.
    cut = met.select(F.col("qid").alias("text"), "bits", ((F.col("bucket") - 1) * BUCKET).alias("first"), F.explode(F.sequence(F.lit(0), F.lit(BUCKET // PIECE - 1))).alias("piece"))
    pieces = cut.select("text", (F.col("first") + F.col("piece") * PIECE).alias("start"), F.substr("bits", F.col("piece") * (PIECE // 8) + 1, F.lit(PIECE // 8)).alias("bits")).where(F.bitmap_count("bits") > 0)
    numbers = pieces.repartition(tasks(pieces), "text", "start").mapInArrow(_numbers, "text long, rows array<struct<id: long>>")
    return dealt(numbers, alike.join(texts, "t").select("text", "qid"), most_terms).unionByName(short)


def candidates(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, path) of files that hold all trigrams of the query, a superset of the matches. A query below three bytes has one row, of null path: all files."""
    asked = queries.select("qid", trigrams(F.col("query")).alias("t"))
    short = asked.where(F.size("t") == 0).select("qid", F.lit(None).cast(postings.schema["path"].dataType).alias("path"))
    terms = asked.select("qid", F.size("t").alias("k"), F.explode("t").alias("tri"))
    return postings.join(terms, "tri").groupBy("qid", "k", "path").agg(F.count("*").alias("n")).where("n = k").select("qid", "path").unionByName(short)


def expanded(found: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates with all files written out for short queries, by definition a row for each pair."""
    return found.where("path is not null").unionByName(found.where("path is null").select("qid").join(files.select("path").distinct()))


def stats(postings: DataFrame) -> DataFrame:
    """One row: distinct trigrams, files, mean number of files of a trigram (0 if there is none)."""
    each = postings.groupBy("tri").agg(F.count("*").alias("n"))
    files = postings.agg(F.count_distinct("path").alias("files"))
    return each.agg(F.count("*").alias("trigrams"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_files")).join(files)


def remove(postings: DataFrame, paths: DataFrame) -> DataFrame:
    return postings.join(paths.select("path").distinct(), "path", "left_anti")
