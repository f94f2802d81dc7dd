"""Commit graphs: log lines as rows, and lanes by a fold over each repository's commits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x1f"
FIELDS = ("hash", "short_hash", "author", "date", "message", "parents", "refs")


def plain_ref(ref: Column) -> Column:
    """Without HEAD -> , tag: and origin/ in front, each once and in that order."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(ref), "^HEAD -> ", ""), "^tag: ", ""), "^origin/", "")


def parse_log(lines: DataFrame) -> DataFrame:
    """Commits of log lines (value, pos, ...): seven fields, parents by spaces, refs by commas. Fewer than five fields are an error; empty lines are skipped."""
    f = F.split("value", SEPARATOR)
    some = lines.where("value <> ''").withColumn("f", F.when(F.size(f) >= 5, f).otherwise(F.raise_error(F.concat(F.lit("log line "), F.col("value"))).cast("array<string>")))
    words = lambda c, by: F.filter(F.split(F.coalesce(c, F.lit("")), by), lambda x: x != "")
    return some.select(
        *[c for c in lines.columns if c != "value"], *[F.col("f")[i].alias(n) for i, n in enumerate(FIELDS[:5])],
        words(F.get("f", F.lit(5)), " ").alias("parent_hashes"), F.transform(words(F.get("f", F.lit(6)), ", "), plain_ref).alias("refs"),
    )


def lanes(commits: DataFrame) -> DataFrame:
    """(repo, pos, hash, lane, merge_to, connectors, lane_count) of commits (repo, pos, hash, parent_hashes) in topological order.

    A sequential fold: each repository is one group, as its lanes depend on all commits before.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        held: list[str | None] = []
        lane_of: dict[str, int] = {}
        out = []

        def take(commit: str) -> int:
            n = next((i for i, x in enumerate(held) if x is None), len(held))
            held[n : n + 1] = [commit]
            lane_of[commit] = n
            return n

        for r in frame.itertuples(index=False):
            parents = list(r.parent_hashes)
            own = lane_of.pop(r.hash, None)
            if own is None:
                own = next((i for i, x in enumerate(held) if x is None), len(held))
                held[own : own + 1] = [None]
            held[own] = None
            before = [x is not None for x in held]
            merge = [lane_of[p] for p in parents if p in lane_of and lane_of[p] != own]
            heir = True
            for p in parents:
                if p in lane_of:
                    continue
                if heir and held[own] is None:
                    held[own], lane_of[p] = p, own
                else:
                    take(p)
                heir = False
            marks = []
            for i, x in enumerate(held):
                was = i < len(before) and before[i]
                marks.append("Pipe" if i == own else "Fork" if x is not None and not was else "Merge" if was and x is None else "Pipe" if x is not None else "Empty")
            out.append((r.repo, r.pos, r.hash, own, merge, marks, sum(x is not None for x in held)))
        return pd.DataFrame(out, columns=["repo", "pos", "hash", "lane", "merge_to", "connectors", "lane_count"])

    return commits.select("repo", "pos", "hash", "parent_hashes").groupBy("repo").applyInPandas(fold, "repo string, pos long, hash string, lane int, merge_to array<int>, connectors array<string>, lane_count int")


def max_lanes(graph: DataFrame) -> DataFrame:
    return graph.groupBy("repo").agg(F.max(F.size("connectors")).alias("max_lanes"))
