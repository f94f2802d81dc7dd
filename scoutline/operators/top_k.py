"""The best documents of many queries, without a row for each query and document that match.

Postings are dealt by document and sorted, so that a task meets its documents one after another. It takes them in blocks, adds the
weights of a query's terms up in arrays, and keeps only the best of each query. A block whose greatest weights of a query's terms do not sum to
the query's worst kept score is passed over. What leaves a task is k rows a query, whatever matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.operators.text_search import B, K1, by_document, tokenize

#: Postings of a task's first block, at least; a block holds whole documents.
BLOCK = 50_000
#: Later blocks are so many times as long, as most of their documents are passed over.
LATER = 8
#: Bounds are sums in another order than scores: they give way by this much.
SLACK = 1e-6
#: Terms of all different queries that are held as arrays in the driver and every task, at most; more are scored in a join.
MOST_TERMS = 1_000_000


class Asked:
    """Queries as arrays: query i has the terms at starts[i] to starts[i + 1], each as often as times says."""

    def __init__(self, qids: list, pairs: list[tuple[int, int, float]]):
        self.qids = np.array(qids, dtype=np.int64)
        query, term = (np.array([p[i] for p in pairs], dtype=np.int64) for i in range(2))
        order = np.lexsort((term, query))
        self.term, self.times = term[order], np.array([p[2] for p in pairs], dtype=float)[order]
        self.starts = np.searchsorted(query[order], np.arange(len(qids) + 1))


def _round(x: np.ndarray, digits: int | None) -> np.ndarray:
    return x if digits is None else np.floor(x * 10.0**digits + 0.5) / 10.0**digits


class _Best:
    """The best of each query in one group of documents so far."""

    def __init__(self, asked: Asked, k: int, digits: int | None):
        self.asked, self.k, self.digits = asked, k, digits
        self.score = np.full((len(asked.qids), k), -np.inf)
        self.doc = np.zeros((len(asked.qids), k), np.int64)
        self.passed = 0

    def add(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Postings of whole documents."""
        docs, at = np.unique(doc, return_inverse=True)
        order = np.argsort(term, kind="stable")
        at, weight = at[order], weight[order]
        terms, first = np.unique(term[order], return_index=True)
        ends = np.append(first[1:], len(order))
        most = np.maximum.reduceat(weight, first)
        a = self.asked
        place = np.minimum(np.searchsorted(terms, a.term), len(terms) - 1)
        here = terms[place] == a.term
        # A term may stand in several fields of a document: its greatest sum is taken as so many times its greatest weight.
        fields = np.array([np.bincount(at[s:e]).max() for s, e in zip(first, ends, strict=True)])
        each = np.where(here, (most * fields)[place] * a.times, 0.0)
        bound = np.add.reduceat(np.append(each, 0.0), np.minimum(a.starts[:-1], len(a.term)))
        bound[a.starts[:-1] == a.starts[1:]] = 0.0
        hopeful = (bound > 0) & (bound + SLACK >= self.score[:, -1])
        self.passed += int(((bound > 0) & ~hopeful).sum())
        for q in np.flatnonzero(hopeful):
            # Documents that hold only terms whose greatest weights together stay below the worst kept score are passed over.
            own_bounds = each[a.starts[q] : a.starts[q + 1]]
            rising = np.argsort(own_bounds)
            light = min(int(np.searchsorted(np.cumsum(own_bounds[rising]) + SLACK, self.score[q, -1], "left")), len(rising) - 1)
            hit = np.unique(np.concatenate([at[first[place[j]] : ends[place[j]]] for j in a.starts[q] + rising[light:] if here[j]])) if light else np.arange(len(docs))
            total = np.zeros(len(hit))
            for j in range(a.starts[q], a.starts[q + 1]):
                if here[j]:
                    own = slice(first[place[j]], ends[place[j]])
                    if light:
                        start, stop = np.searchsorted(at[own], hit), np.searchsorted(at[own], hit, "right")
                        for i in range(fields[place[j]]):
                            m = np.flatnonzero(start + i < stop)
                            total[m] += weight[own][start[m] + i] * a.times[j]
                    elif fields[place[j]] == 1:
                        total[at[own]] += weight[own] * a.times[j]
                    else:
                        np.add.at(total, at[own], weight[own] * a.times[j])
            some = np.flatnonzero(total > 0)
            hit, total = hit[some], total[some]
            score = _round(total, self.digits)
            if len(hit) > self.k:
                least = max(np.partition(score, len(hit) - self.k)[len(hit) - self.k], self.score[q, -1])
                hit, score = hit[score >= least], score[score >= least]
            score, found = np.append(self.score[q], score), np.append(self.doc[q], docs[hit])
            best = np.lexsort((found, -score))[: self.k]
            self.score[q], self.doc[q] = score[best], found[best]

    def rows(self, part: str, within: str) -> pa.RecordBatch:
        q, i = np.nonzero(self.score > -np.inf)
        columns = [pa.array(self.asked.qids[q]), pa.array([part] * len(q), pa.string()), pa.array([within] * len(q), pa.string()), pa.array(self.doc[q, i]), pa.array(self.score[q, i])]
        return pa.RecordBatch.from_arrays(columns, names=["text", "part", "within", "doc", "score"])


def _scored(asked: Asked, k: int, digits: int | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches sorted by (part, within, doc)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, best, held = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            held = rows
            if rows.num_rows < (BLOCK if best is None else LATER * BLOCK):
                continue
            doc = rows.column("doc").to_numpy()
            last = int(np.flatnonzero(doc != doc[-1])[-1]) + 1 if (doc != doc[-1]).any() else 0  # the last document may go on
            if last:
                for key, own in _groups(rows.slice(0, last)):
                    if key != group:
                        if best is not None:
                            yield best.rows(*group)
                        group, best = key, _Best(asked, k, digits)
                    best.add(*own)
                held = rows.slice(last)
        if held is not None:
            for key, own in _groups(held):
                if key != group:
                    if best is not None:
                        yield best.rows(*group)
                    group, best = key, _Best(asked, k, digits)
                best.add(*own)
        if best is not None:
            yield best.rows(*group)

    return run


def _groups(rows: pa.Table) -> Iterator[tuple[tuple[str, str], tuple[np.ndarray, ...]]]:
    """The arrays doc, tid and weight of each run of equal (part, within)."""
    names = [rows.column(c).combine_chunks().dictionary_encode() for c in ("part", "within")]
    codes = [x.indices.to_numpy() for x in names]
    cut = np.flatnonzero((np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0)) + 1
    arrays = [rows.column(c).to_numpy() for c in ("doc", "tid", "w")]
    for s, e in zip([0, *cut], [*cut, rows.num_rows], strict=True):
        yield tuple(x.dictionary[int(c[s])].as_py() for x, c in zip(names, codes, strict=True)), tuple(a[s:e] for a in arrays)


def best(rows: DataFrame, doc: str, fields: list[str], queries: DataFrame, k: int, part: Column | None = None, within: Column | None = None, digits: int | None = None) -> DataFrame:
    """best_of_terms for queries (qid, query): their words in any of the fields, each as often as it occurs. A null query finds nothing."""
    terms = queries.select(F.col("qid").cast("long").alias("qid"), F.explode(tokenize(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").cast("double").alias("times"))
    return best_of_terms(rows, doc, fields, terms.withColumn("field", F.lit(None).cast("string")), k, part, within, digits)


def best_of_terms(rows: DataFrame, doc: str, fields: list[str], terms: DataFrame, k: int, part: Column | None = None, within: Column | None = None, digits: int | None = None) -> DataFrame:
    """(qid, part, within, doc, score): at least the k best documents of each query, part and value of within, by BM25 over the fields; ties go to the smaller doc.

    terms: (qid, field, term, times), each asked in its field, or in all where that is null. part splits the documents into indexes with statistics of their own;
    within only splits what is kept. With digits scores are rounded before they are compared. doc and qid are whole numbers. Queries of equal terms are
    answered once. Their terms are sent to all tasks up to MOST_TERMS, and more of them are scored in a join.
    """
    part, within = part if part is not None else F.lit("all"), within if within is not None else F.lit("")
    dealt = by_document(rows.select(F.col(doc).cast("long").alias("doc"), part.alias("part"), within.cast("string").alias("within"), *fields))
    long = dealt.select("doc", "part", "within", F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), tokenize(F.coalesce(F.col(f), F.lit(""))))])).alias("field", "tokens"))
    each = long.select("part", "within", "field", "doc", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    index = each.groupBy("part", "within", "field", "doc", "len", "term").agg(F.count("*").alias("tf"))  # dealt by document: no shuffle
    # As many terms as a query has.
    wholes = terms.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "field", "times"))).alias("t"))
    texts = wholes.groupBy("t").agg(F.min("qid").alias("text")).localCheckpoint()
    split = texts.select("text", F.inline("t"))
    few = split.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    lengths = long.groupBy("part", "field").agg(F.sum(F.size("tokens")).alias("total"))
    words = split.select("term").distinct()
    hits = index.join(F.broadcast(words) if few else words, "term", "left_semi")
    df = hits.groupBy("part", "field", "term").agg(F.count("*").alias("df"))
    # sizes and lengths have a row for each part and field.
    known = df.join(F.broadcast(sizes), "part").join(F.broadcast(lengths), ["part", "field"])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = known.select("part", "field", "term", idf.alias("idf"), (F.col("total") / F.col("n")).alias("mean"))
    w = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    weighed = hits.join(F.broadcast(weights) if few else weights, ["part", "field", "term"]).select("part", "within", "field", "doc", "term", w.alias("w"))
    if few:
        pairs = split.select("text", "term", F.coalesce("field", F.lit("")).alias("field"), "times").toPandas()
        number = pairs.groupby(["field", "term"]).ngroup()
        qids, at = np.unique(pairs["text"].to_numpy(dtype=np.int64), return_inverse=True)
        asked = Asked(qids.tolist(), [*zip(at.tolist(), number.tolist(), pairs["times"].tolist(), strict=True)])
        tids = texts.sparkSession.createDataFrame(pairs.assign(tid=number)[["field", "term", "tid"]].drop_duplicates(), "asked_in string, term string, tid int")
        met = weighed.join(F.broadcast(tids), "term").where("asked_in = '' or asked_in = field").select("part", "within", "doc", "tid", "w")
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        sorted_ = met.repartition(tasks, "part", "doc").sortWithinPartitions("part", "within", "doc")
        found = sorted_.mapInArrow(_scored(asked, k, digits), "text long, part string, within string, doc long, score double")
    else:
        met = weighed.join(split.withColumnRenamed("field", "asked_in"), "term").where("asked_in is null or asked_in = field")
        found = met.groupBy("text", "part", "within", "doc").agg(F.sum(F.col("w") * F.col("times")).alias("score"))
        found = found.withColumn("score", F.round("score", digits)) if digits is not None else found
    who = wholes.join(texts, "t").select("text", "qid")
    return found.join(F.broadcast(who) if few else who, "text").select("qid", "part", "within", "doc", "score")
