"""Tickets and security issues: flattening, filters, groups, roll-ups."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low")
LARGEST_YEAR, LARGEST_QUARTER, LARGEST_NUMBER = 65535, 255, 65535
ISSUE = (
    "struct<issues:array<struct<key:string,fields:struct<summary:string,status:struct<name:string,statusCategory:struct<name:string,key:string>>,priority:struct<name:string>,"
    "issuetype:struct<name:string>,assignee:struct<displayName:string>,points:double,sprint:array<struct<name:string,state:string,startDate:string,endDate:string>>>>>>"
)
# Rich-text blocks that end a line.
BLOCKS = ("paragraph", "heading", "listItem", "bulletList", "orderedList", "codeBlock")


def project(key: Column) -> Column:
    return F.split_part(key, F.lit("-"), F.lit(1))


def flattened(raw: DataFrame) -> DataFrame:
    """(key, summary, status, category, priority, type, assignee, points, sprint, project) of captured JSON responses in column value."""
    i = raw.select(F.explode(F.from_json("value", ISSUE)["issues"]).alias("i")).select("i.key", "i.fields")
    f = F.col("fields")
    return i.select(
        "key", f["summary"].alias("summary"), f["status"]["name"].alias("status"), F.coalesce(f["status"]["statusCategory"]["key"], F.lit("new")).alias("category"),
        F.coalesce(f["priority"]["name"], F.lit("Medium")).alias("priority"), F.coalesce(f["issuetype"]["name"], F.lit("Task")).alias("type"),
        F.coalesce(f["assignee"]["displayName"], F.lit("Unassigned")).alias("assignee"), f["points"].alias("points"), F.try_element_at(f["sprint"], F.lit(-1))["name"].alias("sprint"), project(F.col("key")).alias("project"),
    )


def sprint_key(name: Column) -> Column:
    """struct(year, quarter, number) of "{name} {number} - Q{quarter} {year}"; what can't be read or is out of range sorts last."""
    m = r"^.* ([0-9]+) - Q([0-9]+) ([0-9]+)$"

    def number(i: int, most: int) -> Column:
        v = F.regexp_extract(name, m, i).try_cast("int")
        return F.when(v <= most, v)

    year, quarter, n = number(3, LARGEST_YEAR), number(2, LARGEST_QUARTER), number(1, LARGEST_NUMBER)
    ok = year.isNotNull() & quarter.isNotNull() & n.isNotNull()
    pick = lambda v, most: F.when(ok, v).otherwise(most)
    return F.struct(pick(year, LARGEST_YEAR).alias("year"), pick(quarter, LARGEST_QUARTER).alias("quarter"), pick(n, LARGEST_NUMBER).alias("number"))


def board(tickets: DataFrame) -> DataFrame:
    """One row: the first active sprint by position, number of tickets and the sum of the points that are there."""
    return tickets.agg(F.min_by("sprint", F.when((F.col("sprint_state") == "active") & F.col("sprint").isNotNull(), F.col("pos"))).alias("sprint"), F.count("*").alias("tickets"), F.coalesce(F.sum("points"), F.lit(0.0)).alias("points"))


def groups(tickets: DataFrame) -> DataFrame:
    """Rows of (project, sprint, n, points, header): a header row for each project, then its sprints in their order, in column pos."""
    g = tickets.select(project(F.col("key")).alias("project"), "sprint", "points").rollup("project", "sprint").agg(F.count("*").alias("n"), F.coalesce(F.sum("points"), F.lit(0.0)).alias("points"), F.grouping_id().alias("level"))
    k = sprint_key(F.coalesce("sprint", F.lit("")))
    w = Window.partitionBy("project").orderBy(F.desc("level"), k, F.col("sprint").asc_nulls_last())
    return g.where("level < 3").withColumn("pos", F.row_number().over(w)).select("project", "sprint", "n", "points", (F.col("level") == 1).alias("header"), "pos")


def filtered(tickets: DataFrame, query: str = "", assignee: str | None = None, of: str | None = None) -> DataFrame:
    """Key or summary holds the lower-case query; assignee "" means unassigned."""
    out = tickets.where(F.lower("key").contains(query) | F.lower("summary").contains(query))
    if assignee is not None:
        out = out.where(F.coalesce("assignee", F.lit("Unassigned")) == (assignee or "Unassigned"))
    return out.where(project(F.col("key")) == of) if of else out


def query_text(of: str | list[str], assignee: str | None = None) -> str:
    """The ticket query that fetches a project, or several."""
    where = f"project IN ({', '.join(of)})" if isinstance(of, list) else f"project = {of}"
    return where + (f' AND assignee = "{assignee}"' if assignee else "") + " ORDER BY updated DESC"


def assignees(tickets: DataFrame, rows: int = 100) -> DataFrame:
    """Distinct assignees of the first rows."""
    return tickets.orderBy("pos").limit(rows).where("assignee is not null").select("assignee").distinct().orderBy("assignee")


def projects(tickets: DataFrame) -> DataFrame:
    """Project keys with the position where each is first seen."""
    return tickets.groupBy(project(F.col("key")).alias("project")).agg(F.min("pos").alias("first"))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower(severity)), F.lit(0)), F.lit(len(SEVERITIES) + 1))


def security_filter(issues: DataFrame, repo: str | None = None, kind: str | None = None, severities: str | None = None) -> DataFrame:
    """Open issues, narrowed by repo, type and a comma-separated list of severities."""
    out = issues.where("status = 'open'")
    out = out.where(F.col("repo") == repo) if repo else out
    out = out.where(F.col("type") == kind) if kind else out
    return out.where(F.col("severity").isin([s.strip().lower() for s in severities.split(",")])) if severities else out


def severity_summary(issues: DataFrame) -> DataFrame:
    """(rank, severity, n) of all severities, 0 included."""
    dim = issues.sparkSession.createDataFrame([(i + 1, s) for i, s in enumerate(SEVERITIES)], "rank int, severity string")
    counts = issues.groupBy("severity").agg(F.count("*").alias("n"))
    return dim.join(counts, "severity", "left").select("rank", "severity", F.coalesce("n", F.lit(0)).alias("n"))


def severity_list(issues: DataFrame, n: int) -> DataFrame:
    return issues.orderBy(F.desc("severity_score"), "id").limit(n)


def short_name(name: Column) -> Column:
    """First name and initial of the last."""
    parts = F.split(F.trim(name), r"\s+")
    return F.when(F.size(parts) > 1, F.concat(parts[0], F.lit(" "), F.substring(F.element_at(parts, -1), 1, 1), F.lit("."))).otherwise(parts[0])


def day(text: Column) -> Column:
    """Month and day of an ISO date text; null if it is none."""
    return F.date_format(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")), "MMM dd")


def _plain(node: object) -> str:
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, dict):
            if x.get("type") == "hardBreak":
                out.append("\n")
            out.append(str(x.get("text") or ""))
            todo.append("\n" if x.get("type") in BLOCKS else "")
            todo += reversed(x.get("content") or [])
    return "".join(out).strip()


def rich_text(rows: DataFrame, column: str) -> DataFrame:
    """rows with the JSON rich-text tree of a column as plain text; of any depth, in Arrow batches. What is no JSON gives the empty text."""

    def plain(text: str | None) -> str:
        try:
            return _plain(json.loads(text or "null"))
        except ValueError:
            return ""

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(plain, na_action=None)

    return rows.withColumn(column, read(column))


DETAIL = (
    "struct<key:string,fields:struct<summary:string,description:string,status:struct<name:string>,assignee:struct<displayName:string>,"
    "comment:struct<comments:array<struct<author:struct<displayName:string>,body:string,created:string>>>>>"
)


def details(raw: DataFrame) -> DataFrame:
    """(key, summary, status, assignee, description) of captured issue responses in column value; the description is plain text."""
    i = raw.select(F.from_json("value", DETAIL).alias("i")).select("i.key", "i.fields").where("key is not null")
    f = F.col("fields")
    flat = i.select("key", f["summary"].alias("summary"), f["status"]["name"].alias("status"), F.coalesce(f["assignee"]["displayName"], F.lit("Unassigned")).alias("assignee"), f["description"].alias("description"))
    return rich_text(flat, "description")


def comments(raw: DataFrame) -> DataFrame:
    """(key, pos, author, created, body) of the comments of captured issue responses; bodies are plain text."""
    i = raw.select(F.from_json("value", DETAIL).alias("i")).select("i.key", F.posexplode("i.fields.comment.comments").alias("pos", "c"))
    flat = i.select("key", "pos", F.coalesce("c.author.displayName", F.lit("Unknown")).alias("author"), "c.created", F.col("c.body").alias("body"))
    return rich_text(flat, "body")
