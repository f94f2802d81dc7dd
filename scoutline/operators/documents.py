"""Text documents as rows: markdown chunks, fenced blocks, snippets, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER = r"^\s*(#{1,6})(?!#)\s*(.*?)\s*#*\s*$"


def lines(files: DataFrame, text: str = "content") -> DataFrame:
    """(path, line from 1, text); a last empty line is none."""
    parts = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\n$", ""), r"\r?\n")
    return files.select("path", F.posexplode(parts).alias("line", "text")).withColumn("line", F.col("line") + 1)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def chunks(files: DataFrame) -> DataFrame:
    """(path, line, level, title, parent, content): a chunk for each header, and Introduction (level 0) for text before the first.

    A header is a trimmed line of one to six # and a title; closing # are no part of it. The parent is
    the nearest header before of a smaller level. Fences are not looked at.
    """
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    title = trimmed(F.regexp_extract("text", HEADER, 2))
    rows = lines(files).withColumn("level", F.length(F.regexp_extract("text", HEADER, 1))).withColumn("title", title)
    rows = rows.withColumn("header", (F.col("level") > 0) & (F.col("title") != ""))
    # The first line that isn't blank opens the introduction, if it is no header.
    first = F.min(F.when(trimmed(F.col("text")) != "", F.col("line"))).over(Window.partitionBy("path"))
    rows = rows.withColumn("opens", F.col("header") | (F.col("line") == first)).withColumn("chunk", F.sum(F.col("opens").cast("int")).over(w)).where("chunk > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("header"), F.struct("line", "text")))), lambda x: x["text"]), "\n")
    made = rows.groupBy("path", "chunk").agg(
        F.min("line").alias("line"), F.max(F.when(F.col("header"), F.col("level")).otherwise(0)).alias("level"), F.max(F.when(F.col("header"), F.col("title"))).alias("title"), trimmed(body).alias("content")
    )
    made = made.withColumn("title", F.coalesce("title", F.lit("Introduction")))
    # For each of the six levels the last header before that is still open: none of a smaller or equal level came since.
    before = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    seen = [F.max(F.when(F.col("level") == k, F.struct("chunk", "title"))).over(before).alias(f"_{k}") for k in range(1, 6)]
    made = made.select("*", *seen)
    parent = F.greatest(*[F.when(F.col("level") > k, F.col(f"_{k}")) for k in range(1, 6)])
    return made.select("path", "line", "level", "title", F.when(F.col("level") > 1, parent["title"]).alias("parent"), "content")


def chunk_symbols(made: DataFrame) -> DataFrame:
    """Chunks as rows of kind doc."""
    return made.select(
        F.col("title").alias("name"), F.lit("doc").alias("kind"), F.col("path").alias("file"), "line", F.lit(1).alias("col"), F.octet_length("content").alias("byte_length"), F.lit("pub").alias("visibility"),
        "parent", F.concat(F.lit("h"), F.col("level"), F.lit(": "), F.col("title")).alias("signature"), "content",
    )


def sections(files: DataFrame) -> DataFrame:
    """(path, section, lang, text): text and fenced code in turns; lang is null for text; an open fence runs to the end; blank text is left out."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(files).withColumn("fence", F.col("text").rlike(r"^\s*```"))
    rows = rows.withColumn("n", F.sum(F.col("fence").cast("int")).over(w))
    # Fence lines of odd number open, those of even number close; what follows an odd number of fences is code.
    code = F.col("n") % 2 == 1
    rows = rows.withColumn("lang", F.when(F.col("fence") & code, trimmed(F.regexp_replace("text", r"^\s*```", ""))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("fence"), F.struct("line", "text")))), lambda x: x["text"]), "\n")
    out = rows.groupBy("path", "n").agg(F.max("lang").alias("lang"), text.alias("text"))
    return out.where((F.col("n") % 2 == 1) | (trimmed(F.col("text")) != "")).select("path", F.col("n").alias("section"), "lang", "text")


def review_blocks(files: DataFrame) -> DataFrame:
    """(path, block, lang, code, target): code sections with the file that the text before them names last."""
    s = sections(files)
    w = Window.partitionBy("path").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    ext = r"\.[A-Za-z0-9]{1,10}"
    named = F.regexp_extract_all(F.last(F.when(F.col("lang").isNull(), F.col("text")), ignorenulls=True).over(w), F.lit(rf"(?:`|\*\*)?([\w./-]*[\w-]{ext})(?:`|\*\*)?"), 1)
    paths = F.filter(named, lambda p: ~p.rlike(r"\.(?:com|org|net|io)$"))
    rows = s.withColumn("target", F.try_element_at(paths, F.lit(-1))).where("lang is not null")
    return rows.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("section")) - 1).alias("block"), "lang", F.col("text").alias("code"), "target")


def snippet(content: Column, start: Column, n: int = 20) -> Column:
    """n lines from line start."""
    return F.array_join(F.slice(F.split(content, "\n"), F.greatest(F.lit(1), start), F.lit(n)), "\n")


def full_snippet(content: Column, target: Column) -> Column:
    """From five lines before the target to 195 after it."""
    first = F.greatest(F.lit(0), target - 5)
    return F.array_join(F.slice(F.split(content, "\n"), first + 1, target + 195 - first), "\n")


# Lines of a body that are looked through for its end, and lines of one that has no braces.
BODY, PLAIN = 51, 10


def symbol_body(content: Column, line: Column) -> Column:
    """The lines of a symbol from its own (from 1) to the one that closes its braces; BODY lines if that is further, PLAIN lines if nothing is closed before the text ends. Empty beyond the text."""
    lines = F.slice(F.split(content, "\n"), F.greatest(line, F.lit(1)), F.lit(BODY + 1))
    count = lambda x, c: F.char_length(x) - F.char_length(F.replace(x, F.lit(c)))
    braces = F.transform(lines, lambda x: F.struct(count(x, "{").alias("up"), count(x, "}").alias("down")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("open"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("end"))

    def step(a: Column, x: Column) -> Column:
        depth, open_, n = a["depth"] + x["up"] - x["down"], a["open"] | (x["up"] > 0), a["n"] + 1
        return F.struct(depth.alias("depth"), open_.alias("open"), n.alias("n"), F.coalesce(a["end"], F.when(open_ & (depth == 0), n)).alias("end"))

    end = F.aggregate(braces, start, step, lambda a: F.coalesce(a["end"], F.when(a["n"] > BODY, BODY).otherwise(PLAIN)))
    return F.array_join(F.slice(lines, F.lit(1), end), "\n")


def agent_sections(files: DataFrame, marker: str) -> DataFrame:
    """(path, title, start, stop): byte ranges from each line that begins with marker to the next such line or the end."""
    w = Window.partitionBy("path").orderBy("line")
    rows = lines(files).withColumn("size", F.octet_length("text") + 1)
    rows = rows.withColumn("stop_line", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("stop_line") - F.col("size"))
    end = F.max("stop_line").over(Window.partitionBy("path"))
    rows = rows.withColumn("end", end).where(F.col("text").startswith(marker))
    return rows.select("path", trimmed(F.substr(F.col("text"), F.lit(len(marker) + 1))).alias("title"), "start", F.coalesce(F.lead("start").over(w), F.col("end")).alias("stop"))


def contained(offsets: DataFrame, ranges: DataFrame) -> DataFrame:
    """Offsets (path, at) with the range [start, stop) of their path that holds them: ranges of a path don't overlap, so the last start decides."""
    a = ranges.select("path", F.col("start").alias("at"), F.lit(0).alias("_o"), F.struct("title", "start", "stop").alias("r"))
    b = offsets.select("path", "at", F.lit(1).alias("_o"), F.lit(None).cast(a.schema["r"].dataType).alias("r"))
    w = Window.partitionBy("path").orderBy("at", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("r", F.last("r", ignorenulls=True).over(w)).where("_o = 1 and at < r.stop").select("path", "at", "r.title")


def message_segments(messages: DataFrame) -> DataFrame:
    """(id, start, stop, kind, text): file spans (@path), symbol spans (#name) and the text between them, blank text left out."""
    ordered = messages.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)([@#][\w./:-]+|[^@#]+|[@#])"), 1)).alias("pos", "part"))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.char_length("part")).over(w)
    kind = F.when(F.col("part").rlike(r"^@[\w./:-]"), "file").when(F.col("part").rlike(r"^#[\w./:-]"), "symbol").otherwise("text")
    return ordered.select("id", (stop - F.char_length("part")).alias("start"), stop.alias("stop"), kind.alias("kind"), F.col("part").alias("text")).where(trimmed(F.col("text")) != "")


def segment_counts(segments: DataFrame) -> DataFrame:
    """(id, files, folders): references to files, and to folders, which end in a slash, of messages that have segments."""
    named = F.col("kind") == "file"
    return segments.groupBy("id").agg(F.count_if(named & ~F.col("text").endswith("/")).alias("files"), F.count_if(named & F.col("text").endswith("/")).alias("folders"))
