"""Ranked full-text search over symbols: BM25, fuzzy, by kind, boosts and re-ranking.

Many queries are answered in one job: a table of queries (qid, query) meets the postings by term.
Scores are floats and multiplied left to right, as single precision is what ranks depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutline.operators import classify as C
from scoutline.operators.edit_tree import within
from scoutline.operators.equal_queries import dealt, in_runs, tasks

K1, B = 1.2, 0.75
LONGEST_TOKEN = 40
#: Terms of all queries that are broadcast, at most; Spark joins more of them by its own choice.
MOST_TERMS = 200_000


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters and digits of 40 bytes at most. A CamelCase word is one token."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) <= LONGEST_TOKEN))


def postings(rows: DataFrame, doc: str, fields: list[str], part: Column | None = None) -> DataFrame:
    """(part, field, doc, term, tf, len): the inverted index; part splits it into indexes with statistics of their own."""
    long = rows.select(F.col(doc).alias("doc"), (part if part is not None else F.lit("all")).alias("part"), F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), tokenize(F.coalesce(F.col(f), F.lit(""))))])).alias("field", "tokens"))
    terms = long.select("part", "field", "doc", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    return terms.groupBy("part", "field", "doc", "len", "term").agg(F.count("*").alias("tf"))


def by_document(hits: DataFrame) -> DataFrame:
    """Hits dealt by document alone, as a part that is the same everywhere is a constant to Spark, by which it takes nothing as dealt. The number of tasks is stated, as a few hits meet many queries, and Spark would put them in one."""
    return hits.repartition(tasks(hits), "doc")


def bm25(index: DataFrame, queries: DataFrame, rows: DataFrame, doc: str, part: Column | None = None) -> DataFrame:
    """(qid, part, doc, score): sum over query terms and fields, any term may match. Equal query terms count as often as they occur."""
    size = rows.select((part if part is not None else F.lit("all")).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    lengths = index.groupBy("part", "field").agg(F.sum("tf").alias("total"))
    asked = queries.select("qid", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    # Each of these has a row for an asked term, and part and field of it, at most.
    near = F.broadcast if asked.limit(MOST_TERMS + 1).count() <= MOST_TERMS else (lambda x: x)
    hits = index.join(near(asked.select("term").distinct()), "term", "left_semi")
    df = hits.groupBy("part", "field", "term").agg(F.count("*").alias("df"))
    # size and lengths have a row for each part and field.
    known = df.join(F.broadcast(size), "part").join(F.broadcast(lengths), ["part", "field"])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = hits.join(near(known), ["part", "field", "term"]).withColumn("w", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (F.col("total") / F.col("n")))))
    return weighed.join(near(asked), "term").groupBy("qid", "part", "doc").agg(F.sum(F.col("w") * F.col("times")).alias("score"))


def source_boosted(scores: DataFrame, rows: DataFrame, doc: str, doc_type: Column) -> DataFrame:
    """Half of the score and of the type term's weight on top for source code; nothing is left out."""
    typed = rows.select(F.col(doc).alias("doc"), doc_type.alias("document_type"))
    n = rows.agg(F.count("*").alias("n"), F.count_if(doc_type == "SourceCode").alias("n_src"))
    idf = F.log(1 + (F.col("n") - F.col("n_src") + 0.5) / (F.col("n_src") + 0.5))
    return scores.join(typed, "doc").join(F.broadcast(n)).withColumn("score", F.col("score") + F.when(F.col("document_type") == "SourceCode", 0.5 * (F.col("score") + idf)).otherwise(0.0)).drop("n", "n_src")


def to_documents(symbols: DataFrame) -> DataFrame:
    """Symbols as rows of the text index: text fields, and exact ones with the label of the kind."""
    return symbols.select("seq", F.col("name").alias("symbol_name"), C.choose(F.col("kind"), C.KIND_LABELS).alias("symbol_kind"), F.col("file").alias("file_path"), F.col("line"), F.col("col").alias("column"), "visibility", "parent", "signature", "content", C.document_type(F.col("file")).alias("document_type"))


def from_documents(rows: DataFrame) -> DataFrame:
    """Rows of the text index as symbols; those without name, kind, file or line, or of an unknown kind, are left out."""
    kind = C.kind_named(F.col("symbol_kind"), strict=False)
    out = rows.select("seq", F.col("symbol_name").alias("name"), kind.alias("kind"), F.col("file_path").alias("file"), "line", F.col("column").alias("col"), "visibility", "parent", "signature", "content")
    return out.dropna(subset=["name", "kind", "file", "line"])


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The k best of each group, ties by doc; Spark prunes before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "doc")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def over_fetch(intent: Column, limit: int) -> Column:
    return F.when(intent == "Understand", max(1, limit) * 10).otherwise(max(1, limit) * 3)


def rerank(hits: DataFrame, limit: int) -> DataFrame:
    """hits (qid, intent, doc, raw_rank, score, document_type, kind, name, n_refs) with the final score and rank.

    A score that is no finite number counts as 0 before anything is sorted; ties keep their raw order.
    """
    score = F.when(F.isnan("score") | F.abs("score").isin(float("inf")), 0.0).otherwise(F.col("score")).cast("float")
    final = (
        score
        * (C.doc_boost(F.col("document_type")) * C.by_intent(F.col("intent"), F.col("document_type"), C.DOC_INTENT))
        * (C.kind_boost(F.col("kind")) * C.by_intent(F.col("intent"), F.col("kind"), C.KIND_INTENT))
        * C.test_penalty(F.col("intent"), F.col("name"))
        * C.hub_penalty(F.coalesce("n_refs", F.lit(0)))
    )
    w = Window.partitionBy("qid").orderBy(F.desc("final"), "raw_rank")
    return hits.withColumn("final", final.cast("double")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def fuzzy(symbols: DataFrame, queries: DataFrame, distance: int = 2, most_queries: int = MOST_TERMS) -> DataFrame:
    """(qid, seq, distance) of symbols with a name token within ``distance`` of the whole query as it stands, transpositions of neighbours counted once.

    The dictionary of distinct tokens is sorted and read as a tree of common beginnings, which all queries walk together (edit_tree.py). Queries
    are sent to all tasks in blocks of about ``most_queries``. Null queries find nothing; a qid has one query.
    """
    tokens = symbols.select("seq", F.explode(F.array_distinct(tokenize(F.col("name")))).alias("token"))
    asked = queries.where(F.char_length("query") <= LONGEST_TOKEN + distance).select(F.col("qid").cast("long").alias("qid"), "query")
    different = asked.select("query").distinct()
    blocks = -(-different.count() // most_queries) or 1
    words = tokens.select("token").distinct().repartitionByRange("token").sortWithinPartitions("token")
    near = None
    for i in range(blocks):
        block = [r.query for r in (different if blocks == 1 else different.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)).collect()]
        one = words.mapInArrow(within(block, distance), "query string, token string, distance int")
        near = one if near is None else near.unionByName(one)
    # Equal queries meet the symbols once; the qids are dealt to what they found at the end.
    who = asked.distinct()
    texts = who.groupBy("query").agg(F.min("qid").alias("text"))
    met = near.join(F.broadcast(texts) if blocks == 1 else texts, "query").join(tokens, "token")
    # The number of tasks is stated, as these rows are few for what they make.
    best = met.repartition(tasks(met), "text", "seq").groupBy("text", "seq").agg(F.min("distance").alias("distance"))
    return dealt(in_runs(best), who.join(texts, "query").select("text", "qid"), most_queries)


def by_kind(symbols: DataFrame, kind: str, limit: int) -> DataFrame:
    """Symbols of a kind; the query text plays no part."""
    return symbols.where(F.col("kind") == kind).orderBy("seq").limit(limit)
