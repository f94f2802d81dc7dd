"""Scalar text and path functions that several surfaces share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def ellipsis(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last of them an ellipsis where something is cut."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def padded(text: Column, width: int) -> Column:
    return F.rpad(ellipsis(text, width), width, " ")


def or_dash(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("-"))


def clipped_bytes(text: Column, most: int) -> Column:
    """The longest prefix of ``most`` bytes or less that ends on a character."""
    return F.when(F.octet_length(text) <= most, text).otherwise(_prefix(text, most))


def _prefix(text: Column, most: int) -> Column:
    """The most characters that fit; a character has four bytes at most, so that only lengths from most / 4 need a look."""
    return F.aggregate(F.sequence(F.lit(most // 4), F.lit(most)), F.lit(""), lambda best, n: F.when(F.octet_length(F.substr(text, F.lit(1), n)) <= most, F.substr(text, F.lit(1), n)).otherwise(best))


def url_encoded(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
