"""Hybrid retrieval: exact vector search, rank fusion, thresholds, context budgets, importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rank fusion, least score, lines of a scope, rows of each part.
RRF_K, THRESHOLD, SCOPE = 60, 0.015, 50
LIMITS = {"code": 10, "docs": 5, "notes": 3}
# Shares of visibility and kind in the importance of a symbol.
VISIBILITY = {"pub": 1.0, "pub(crate)": 0.7, "pub(super)": 0.5}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, most_queries: int = 10_000) -> DataFrame:
    """(qid, vec_id, score, rank): the k nearest by cosine, exact. The queries are a stated set, broadcast in blocks of about ``most_queries``.

    Norms are computed once a vector; the best of each query are pruned before the shuffle.
    """
    blocks = -(-queries.count() // most_queries) or 1
    unit = lambda d: d.withColumn("norm", F.sqrt(dot(F.col("embedding"), F.col("embedding"))))
    q = unit(queries).select("qid", F.col("embedding").alias("q"), F.col("norm").alias("qn"))
    scored = None
    for i in range(blocks):
        block = q if blocks == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        one = unit(vectors).join(F.broadcast(block)).select("qid", "vec_id", (dot(F.col("embedding"), F.col("q")) / (F.col("norm") * F.col("qn"))).alias("score"))
        scored = one if scored is None else scored.unionByName(one)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(first: DataFrame, second: DataFrame, weights: tuple[float, float] = (1.0, 1.0), k: int = RRF_K, each: int = 50) -> DataFrame:
    """(qid, doc, score) of two ranked lists (qid, doc, rank): the sum of weight / (k + rank)."""
    a, b = (d.where(F.col("rank") <= each).select("qid", "doc", F.col("rank").alias(n)) for d, n in ((first, "ra"), (second, "rb")))
    part = lambda r, w: F.coalesce(F.lit(w) / (k + F.col(r)), F.lit(0.0))
    return a.join(b, ["qid", "doc"], "full_outer").select("qid", "doc", (part("ra", weights[0]) + part("rb", weights[1])).alias("score"))


def thresholded(scores: DataFrame, by: str, least: int, threshold: float = THRESHOLD) -> DataFrame:
    """Rows at or above the threshold, and the best ``least`` of each group in any case."""
    w = Window.partitionBy("qid", by).orderBy(F.desc("score"), "doc")
    return scores.withColumn("rank", F.row_number().over(w)).where((F.col("score") >= threshold) | (F.col("rank") <= least))


def limited(ranked: DataFrame, by: str, limits: dict[str, int] | None = None) -> DataFrame:
    """The best rows of each group up to the group's limit."""
    from scoutline.operators.classify import choose

    w = Window.partitionBy("qid", by).orderBy(F.desc("score"), "doc")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= choose(F.col(by), limits or LIMITS, 0))


def part_counts(rows: DataFrame, part: Column) -> DataFrame:
    """(part, n): rows of each part, and of all as total."""
    return rows.select(part.alias("part")).rollup("part").agg(F.count("*").alias("n")).select(F.coalesce("part", F.lit("total")).alias("part"), "n")


def fallback_scores(ranked: DataFrame) -> DataFrame:
    """Scores by position where no second ranker is at hand."""
    return ranked.withColumn("score", F.lit(1.0) / F.col("rank"))


def within_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """Rows (qid, rank, text) in order of rank until the tokens (characters / 4) are used up."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("tokens", F.sum(F.floor(F.char_length("text") / 4)).over(w)).where(F.col("tokens") <= budget)


# Patterns of names, and what a path to a name needs: confidence, share of names that exist, mean importance.
CAMEL, SNAKE, SCREAMING = "[A-Z][a-z]+(?:[A-Z][a-z0-9]+)+", "[a-z][a-z0-9]*(?:_[a-z0-9]+)+", "[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+"
CONFIDENT, EXISTING, IMPORTANT = 0.7, 0.5, 0.5
#: How sure a word of each pattern is a name; the documents give no numbers.
CERTAINTY = {CAMEL: 0.9, SNAKE: 0.85, SCREAMING: 0.8}
CONCEPTUAL = r"(?i)\b(?:why does|explain|how does .* works?)\b"


def symbols_in(text: Column) -> Column:
    """CamelCase, snake_case and SCREAMING_CASE words."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b({CAMEL}|{SNAKE}|{SCREAMING})\b"), 1))


def certainty(text: Column) -> Column:
    """Mean certainty of the names in a text; 0 without one."""
    sure = F.transform(symbols_in(text), lambda x: F.coalesce(*[F.when(x.rlike(f"^(?:{p})$"), c) for p, c in CERTAINTY.items()]))
    return F.when(F.size(sure) == 0, 0.0).otherwise(F.aggregate(sure, F.lit(0.0), lambda a, b: a + b) / F.size(sure))


def fast_path(queries: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(qid, fast, certainty, existing, importance) of queries (qid, query): whether the names in it are enough to answer it.

    Existing is the share of its names that are defined, importance the mean of the defined ones, each by its most important definition.
    """
    counts = refs.groupBy("name").agg(F.count("*").alias("n"))
    known = symbols.join(counts, "name", "left").groupBy("name").agg(F.max(importance(F.coalesce("n", F.lit(0)), F.col("visibility"), F.col("kind"))).alias("w"))
    names = queries.select("qid", F.explode_outer(symbols_in(F.col("query"))).alias("name")).join(known, "name", "left")
    each = names.groupBy("qid").agg((F.count("w") / F.greatest(F.lit(1), F.count("name"))).alias("existing"), F.coalesce(F.avg("w"), F.lit(0.0)).alias("importance"))
    sure = certainty(F.col("query"))
    ok = (sure >= CONFIDENT) & (F.col("existing") >= EXISTING) & (F.col("importance") >= IMPORTANT) & ~F.col("query").rlike(CONCEPTUAL)
    return queries.join(each, "qid").select("qid", ok.alias("fast"), sure.alias("certainty"), "existing", "importance")


def feedback(results: DataFrame, action: str, wanted: DataFrame | None = None, pattern: str | None = None) -> DataFrame:
    """Results (qid, doc, file, ...) after an action of the one who asked.

    accept leaves them, filter keeps files that match the pattern, more adds the rows of ``wanted`` (expanded, related or
    searched anew) that are not there yet, refine takes them instead.
    """
    if action == "accept":
        return results
    if action == "filter":
        return results.where(F.col("file").rlike(pattern))
    if action == "more":
        return results.unionByName(wanted.select(results.columns).join(results.select("qid", "doc"), ["qid", "doc"], "left_anti").select(results.columns))
    if action == "refine":
        return wanted.select(results.columns)
    raise ValueError(f"unknown action {action}")


def kept_projects(uses: DataFrame, most: int = 5) -> DataFrame:
    """Projects (project, used_at) that stay cached: those used last, ties by name."""
    last = uses.groupBy("project").agg(F.max("used_at").alias("used_at"))
    return last.orderBy(F.desc("used_at"), "project").limit(most)


def importance(refs: Column, visibility: Column, kind: Column) -> Column:
    """0.4 of references up to 50, 0.3 of visibility, 0.3 of kind."""
    from scoutline.operators.classify import KIND_BOOST, choose

    top = max(KIND_BOOST.values())
    return 0.4 * F.least(refs / 50.0, F.lit(1.0)) + 0.3 * choose(visibility, VISIBILITY, 0.3) + 0.3 * choose(kind, {k: v / top for k, v in KIND_BOOST.items()}, 0.5)
