"""Ranked search in the query syntax, over an inverted index with positions; query_parser.py reads the syntax.

Leaves of all queries meet the index in one job: words and phrases as terms, beginnings, ranges and sets as the terms of the index's dictionary that
they stand for. Groups are then put together level by level, the deepest first. All rows stay dealt by document, so no level shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.operators import equal_queries
from scoutline.operators.query_parser import NODES, parsed
from scoutline.operators.text_search import K1, B, by_document, tokenize

#: Nodes and terms of all queries that are broadcast, at most; Spark joins more of them by its own choice.
MOST_TERMS = 1_000_000


def positions(rows: DataFrame, doc: str, fields: list[str], part: Column | None = None) -> DataFrame:
    """(part, field, doc, len, term, at): the inverted index with the positions of each term, to be saved and asked often."""
    long = rows.select(F.col(doc).alias("doc"), (part if part is not None else F.lit("all")).alias("part"), F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), tokenize(F.coalesce(F.col(f), F.lit(""))))])).alias("field", "tokens"))
    terms = long.select("part", "field", "doc", F.size("tokens").alias("len"), F.posexplode("tokens").alias("at", "term"))
    # As many positions as the document's field has.
    return terms.groupBy("part", "field", "doc", "len", "term").agg(F.array_sort(F.collect_list("at")).alias("at"))


def totals(index: DataFrame, rows: DataFrame, part: Column | None = None) -> DataFrame:
    """(part, field, n, total): documents of each index, and tokens of each of its fields; a row for each part and field."""
    size = rows.select((part if part is not None else F.lit("all")).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    return index.groupBy("part", "field").agg(F.sum(F.size("at")).alias("total")).join(F.broadcast(size), "part")


def _first(term: Column) -> Column:
    """The first byte of a term, by which ranges meet the dictionary; order by bytes is order by it."""
    return F.conv(F.substring(F.hex(term), 1, 2), 16, 10).cast("int")


def expanded(index: DataFrame, leaves: DataFrame) -> DataFrame:
    """(qid, node, field, off, term) of the terms that beginnings, ranges and sets stand for; leaves: (qid, node, kind, field, tokens, ends).

    A beginning meets the dictionary by as many characters as it has, a range by the first bytes between its ends.
    """
    words = index.select("field", "term").distinct()
    last = F.element_at("tokens", -1)
    starts = leaves.where("kind = 'prefix'").select("qid", "node", "field", (F.size("tokens") - 1).alias("off"), last.alias("start"), F.char_length(last).alias("n"))
    lengths = starts.select("n").distinct()  # no token is longer than 40 bytes
    cut = words.join(F.broadcast(lengths), F.char_length("term") >= F.col("n")).select("field", "term", F.left("term", "n").alias("start"))
    begun = starts.select("qid", "node", "field", "off", "start").join(cut, ["field", "start"]).select("qid", "node", "field", "off", "term")
    ends = leaves.where("kind = 'range'").select("qid", "node", "field", "low", "low_in", "high", "high_in")
    least, most = F.coalesce(_first(F.col("low")), F.lit(0)), F.coalesce(_first(F.col("high")), F.lit(255))
    ends = ends.where(least <= most).withColumn("byte", F.explode(F.sequence(least, most)))
    above = F.col("low").isNull() | (F.col("term") > F.col("low")) | (F.col("low_in") & (F.col("term") == F.col("low")))
    below = F.col("high").isNull() | (F.col("term") < F.col("high")) | (F.col("high_in") & (F.col("term") == F.col("high")))
    within = ends.join(words.withColumn("byte", _first(F.col("term"))), ["field", "byte"]).where(above & below).select("qid", "node", "field", F.lit(0).alias("off"), "term")
    sets = leaves.where("kind = 'set'").select("qid", "node", "field", F.lit(0).alias("off"), F.explode("tokens").alias("term"))
    return begun.unionByName(within).unionByName(sets)


def leading(nodes: DataFrame, terms: DataFrame, df: DataFrame) -> DataFrame:
    """(qid, field, term): every document that a query matches holds one of its leading terms.

    Of the clauses that must match at the root the one of fewest postings leads, else all that may; of a phrase in a field its rarest term stands for it.
    Where documents with any token may match by themselves, all terms of the query lead.
    """
    leaf = nodes.where("kind <> 'group' and not denied").select("qid", "node", "branch")
    freq = df.groupBy("field", "term").agg(F.sum("df").alias("df"))
    found = terms.join(leaf, ["qid", "node"]).join(freq, ["field", "term"])
    phrase = F.col("kind").isin("text", "prefix") & (F.col("k") > 1)
    rarest = found.where(phrase & F.col("weighs")).groupBy("qid", "node", "branch", "field").agg(F.min_by(F.struct("term", "df"), F.struct("df", "off")).alias("x")).select("qid", "branch", "field", "x.*")
    cover = rarest.unionByName(found.where(~phrase).select("qid", "branch", "field", "term", "df"))
    open_ = nodes.where("kind = 'all' and not denied").select("qid", "branch").distinct()
    cost = cover.groupBy("qid", "branch").agg(F.sum("df").cast("double").alias("cost")).unionByName(open_.withColumn("cost", F.lit(float("inf")))).groupBy("qid", "branch").agg(F.max("cost").alias("cost"))
    branches = nodes.where("depth = 1 and occur <> '-'").select("qid", "branch", "need").join(cost, ["qid", "branch"], "left").fillna(0.0, ["cost"])
    one = branches.groupBy("qid").agg(F.min_by(F.when(F.col("need") == "+", F.col("branch")), F.when(F.col("need") == "+", F.struct("cost", "branch"))).alias("must"))
    chosen = branches.join(one, "qid").where("must is null or must = branch").select("qid", "branch", "cost")
    whole = chosen.where(F.col("cost") == float("inf")).select("qid").distinct()
    return cover.join(chosen, ["qid", "branch"], "left_semi").select("qid", "field", "term").unionByName(terms.join(whole, "qid", "left_semi").select("qid", "field", "term")).distinct()


def search(index: DataFrame, totals_: DataFrame, queries: DataFrame, default: list[str], fields: list[str] | None = None, most_terms: int = MOST_TERMS, digits: int | None = None) -> DataFrame:
    """(qid, part, doc, score) of documents that match queries (qid, query); BM25 summed over clauses and fields, rounded to ``digits``.

    A phrase counts its occurrences and weighs the sum of its terms, without the last of one that ends in a beginning. Ranges, sets and * score 1.
    In a group every clause after + must match and none after -; if there are none after + some clause has to match. A boost multiplies what a clause or
    a group scores. * stands for documents with any token, field:* for those with one there. Queries that can't be read at all, null and empty ones, find nothing.
    A qid has one query. Equal queries are answered once, and their rows are dealt to the qids at the end. Clauses meet only documents with a leading term.
    """
    names = fields or default
    asked = queries.select(F.col("qid").cast("long").alias("qid"), "query").where("qid is not null and query is not null").distinct()
    texts = asked.groupBy("query").agg(F.min("qid").alias("text"))
    # Tables of the queries alone are kept, as each level reads them.
    nodes = texts.select(F.col("text").alias("qid"), "query").mapInPandas(parsed(names), NODES).localCheckpoint()
    # A row a level, for as many levels as parentheses may nest.
    has = {"many": F.col("kind").isin("prefix", "range", "set"), "flat": F.col("kind").isin("range", "set"), "every": F.col("kind") == "all", "one": (F.col("kind") == "text") & (F.size("tokens") == 1)}
    has |= {"exact": F.col("kind").isin("text", "prefix") & (F.size("tokens") > 1) & (F.col("slop") == 0), "loose": (F.col("kind") == "text") & (F.size("tokens") > 1) & (F.col("slop") > 0), "must": (F.col("depth") == 1) & (F.col("occur") == "+")}
    shape = nodes.groupBy("depth").agg(F.count("*").alias("n"), *[F.bool_or(x).alias(k) for k, x in has.items()]).collect()
    if not shape:
        return index.select(F.lit(None).cast("long").alias("qid"), "part", "doc", F.lit(None).cast("double").alias("score")).limit(0)
    near = F.broadcast if sum(r.n for r in shape) <= most_terms else (lambda x: x)
    both = F.explode(F.when(F.col("field").isNull(), F.array(*[F.lit(f) for f in default])).otherwise(F.array("field"))).alias("field")
    leaf = ["qid", "node", "depth", "kind", "k", "slop"]
    leaves = nodes.where("kind <> 'group'").withColumn("k", F.size("tokens")).select(*leaf, both, "tokens", "low", "low_in", "high", "high_in")
    fixed = leaves.where("kind in ('text', 'prefix')").select(*leaf, "field", F.posexplode("tokens").alias("off", "term"))
    terms = fixed.where("kind = 'text' or off < k - 1").select(*leaf, "field", "off", "term", F.lit(True).alias("weighs"))
    if any(r.many for r in shape):
        terms = terms.unionByName(expanded(index, leaves).withColumn("weighs", F.lit(False)).join(near(leaves.select(*leaf).distinct()), ["qid", "node"]))
    terms = terms.localCheckpoint()
    many = terms.count()
    of_terms = F.broadcast if many <= most_terms else (lambda x: x)
    of_parts = F.broadcast if many * totals_.limit(most_terms + 1).count() <= most_terms else (lambda x: x)
    hits = index.join(of_terms(terms.select("field", "term").distinct()), ["field", "term"], "left_semi")
    df = hits.groupBy("part", "field", "term").agg(F.count("*").alias("df"))
    # A row for each term that is asked, part and field; totals have one for each part and field.
    idf = df.join(of_parts(totals_), ["part", "field"]).select("part", "field", "term", "df", "n", "total", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).withColumnRenamed("n", "docs").localCheckpoint()
    dealt = by_document(hits.join(of_parts(idf.drop("df")), ["part", "field", "term"]))
    led = any(r.must or r.exact or r.loose for r in shape)
    if led:
        first = leading(nodes, terms, idf).localCheckpoint()
        of_first = F.broadcast if first.count() <= most_terms else (lambda x: x)
        led_to = dealt.select("part", "doc", "field", "term").join(of_first(first), ["field", "term"]).select("qid", "part", "doc").distinct().join(dealt, ["part", "doc"])
    place = ["qid", "node", "part", "field", "doc", "len", "docs", "total"]
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (F.col("total") / F.col("docs"))))

    def scored(r) -> list[DataFrame]:
        """(qid, node, part, doc, w) of the leaves of a level, by its row of shape."""
        own = of_terms(terms.where(F.col("depth") == r.depth).drop("depth"))
        met = led_to.join(own, ["qid", "field", "term"]) if led else dealt.join(own, ["field", "term"])
        counted, out = [], []
        if r.one:
            counted.append(met.where("kind = 'text' and k = 1").select(*place, "idf", F.size("at").alias("tf")))
        weighed = F.sum(F.when(F.col("weighs"), F.col("idf")).otherwise(0.0)).alias("idf")
        if r.exact:
            # Occurrences begin where every term of the phrase is at its own distance.
            phrases = met.where("k > 1 and slop = 0 and kind in ('text', 'prefix')").select(*place, "k", "idf", "weighs", "off", F.explode("at").alias("at"))
            starts = phrases.groupBy(*place, "k", (F.col("at") - F.col("off")).alias("start")).agg(F.count("*").alias("m"), weighed).where("m = k")
            counted.append(starts.groupBy(*place).agg(F.max("idf").alias("idf"), F.count("*").cast("int").alias("tf")))
        if r.loose:
            # Loose phrases: from a first term on, each further one at its earliest place that is no earlier than its distance from the one before.
            rest = F.slice("p", 2, F.size("p"))
            ends = F.transform(F.col("p")[0]["at"], lambda x: F.aggregate(rest, x, lambda a, t: F.array_min(F.filter(t["at"], lambda y: y - t["off"] >= a)) - t["off"]) - x)
            loose = met.where("k > 1 and slop > 0 and kind = 'text'").groupBy(*place, "k", "slop").agg(F.array_sort(F.collect_list(F.struct("off", "at"))).alias("p"), weighed).where(F.size("p") == F.col("k"))
            counted.append(loose.select(*place, "idf", F.size(F.filter(ends, lambda d: d <= F.col("slop"))).alias("tf")).where("tf > 0"))
        if counted:
            out.append(reduce(DataFrame.unionByName, counted).groupBy("qid", "node", "part", "doc").agg(F.sum(weight).alias("w")))
        if r.flat:
            out.append(met.where("kind in ('range', 'set')").select("qid", "node", "part", "doc").distinct().withColumn("w", F.lit(1.0)))
        if r.every:
            everywhere = nodes.where((F.col("kind") == "all") & (F.col("depth") == r.depth)).select("qid", "node", F.col("field").alias("only"))
            there = by_document(index.select("part", "doc", "field").distinct())
            for one in (everywhere.where("only is null").join(there.select("part", "doc").distinct()), everywhere.where("only is not null").join(there, F.col("only") == F.col("field"))):
                out.append(one.select("qid", "node", "part", "doc", F.lit(1.0).alias("w")))
        return out

    own = nodes.where("kind <> 'group'").select("qid", "node", "parent", "occur", "boost")
    musts = nodes.where("parent is not null").groupBy("qid", "parent").agg(F.count_if(F.col("occur") == "+").alias("musts"))
    groups = nodes.where("kind = 'group'").select("qid", F.col("node").alias("parent"), F.col("parent").alias("above"), F.col("occur").alias("own"), "boost").join(musts, ["qid", "parent"]).localCheckpoint()
    level = None
    for r in sorted(shape, key=lambda x: -x.depth):
        if r.depth == 0:
            continue
        here = [x.join(near(own), ["qid", "node"]).select("qid", "parent", "occur", "part", "doc", (F.col("w") * F.col("boost")).alias("w")) for x in scored(r)] + ([level] if level is not None else [])
        each = reduce(DataFrame.unionByName, here).groupBy("qid", "parent", "part", "doc").agg(F.sum(F.when(F.col("occur") != "-", F.col("w"))).alias("score"), F.count_if(F.col("occur") == "+").alias("had"), F.count_if(F.col("occur") == "-").alias("no"))
        kept = each.join(near(groups), ["qid", "parent"]).where("no = 0 and had = musts and score is not null")
        level = kept.select("qid", F.col("above").alias("parent"), F.col("own").alias("occur"), "part", "doc", (F.col("score") * F.col("boost")).alias("w"))
    score = F.round("w", digits) if digits is not None else F.col("w")
    each = level.select(F.col("qid").alias("text"), "part", "doc", score.alias("score"))
    return equal_queries.dealt(equal_queries.in_runs(each), asked.join(texts, "query").select("text", "qid"), most_terms)


def words_of(queries: DataFrame, fields: list[str]) -> DataFrame:
    """(qid, field, term, times) of queries (qid, query) that are lists of single words, each with a field and a boost or without: what top_k.best_of_terms takes."""
    nodes = queries.select(F.col("qid").cast("long").alias("qid"), "query").mapInPandas(parsed(fields), NODES)
    words = nodes.where("kind = 'text' and depth = 1 and size(tokens) = 1 and occur = ''")
    return words.select("qid", "field", F.col("tokens")[0].alias("term"), F.col("boost").alias("times"))
