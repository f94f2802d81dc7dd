"""Interaction memory: recent rows, sessions, statistics, bounded histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROMPTS, MESSAGES = 200, 100


def sessions(interactions: DataFrame) -> DataFrame:
    """(session_id, last, n), newest first."""
    return interactions.groupBy("session_id").agg(F.max("timestamp").alias("last"), F.count("*").alias("n")).orderBy(F.desc("last"), "session_id")


def recent(interactions: DataFrame, n: int) -> DataFrame:
    """The first n rows of sessions in order of their last change, newest session first, oldest row first within one. No global sort by time."""
    last = interactions.groupBy("session_id").agg(F.max("timestamp").alias("_last"))
    return interactions.join(last, "session_id").orderBy(F.desc("_last"), "session_id", "line_no").limit(n).drop("_last")


def recent_of_session(interactions: DataFrame, n: int, session: str) -> DataFrame:
    """Those of the n recent rows that belong to the session: the filter comes after the limit."""
    return recent(interactions, n).where(F.col("session_id") == session)


def stats(interactions: DataFrame) -> DataFrame:
    size = F.coalesce(F.octet_length("input_text"), F.lit(0)) + F.coalesce(F.octet_length("response_text"), F.lit(0))
    return interactions.agg(F.count("*").alias("total"), F.count_distinct("session_id").alias("sessions"), F.coalesce(F.sum(size), F.lit(0)).alias("size_bytes"), F.max("timestamp").alias("last_updated"))


def history(rows: DataFrame, key: str, order: str, text: str, cap: int = PROMPTS) -> DataFrame:
    """The last ``cap`` rows of each key after a row equal to the one before it is left out."""
    w = Window.partitionBy(key).orderBy(order)
    once = rows.withColumn("_was", F.lag(text).over(w)).where(~F.col(text).eqNullSafe(F.col("_was")) | F.col("_was").isNull()).drop("_was")
    return once.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= cap).drop("_n")


def shortened(text: Column, most: int = 120) -> Column:
    """On one line; cut to ``most`` characters and dots where it has more bytes than that."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.octet_length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)
