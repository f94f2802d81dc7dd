"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors makes a neighbour graph, which is cut into parts of equal size so that few neighbours are separated. A small
classifier learns the part of a vector from the parts of its neighbours. It deals every row to its likeliest part, and
sends a query to as many of its likeliest parts as are needed for the wanted recall, which is measured against brute force
on some queries over all rows. What a part offers is ranked by the exact cosine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoutline.llm.shared import Scratch
from scoutline.llm.vectors import Tiles, matrix, sample, usable

#: Rows that the index is fitted on, and queries that its recall is measured with, at most.
SAMPLE_ROWS, CALIBRATION = 8192, 384
#: Rows of the sample in a part, at least; parts for so many rows: the root of their number over SPREAD.
PART_ROWS, SPREAD = 32, 4
NEIGHBOURS, SLACK, REFINEMENTS = 10, 1.1, 12
HIDDEN, EPOCHS, BATCH, RATE = 128, 24, 512, 0.01
RECALL = 0.96
#: Scores by matrix products differ by less than this from exact ones.
ROUNDING = 1e-9
QUERIES_AT_ONCE, PAIRS_AT_ONCE = 256, 1 << 15


def units(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; first divided by a power of two near their largest component, so that no square is lost."""
    most = np.abs(rows).max(axis=1, initial=0)
    scaled = np.ldexp(rows, -np.frexp(np.where(most > 0, most, 1))[1][:, None])
    return scaled / np.maximum(np.sqrt((scaled * scaled).sum(axis=1)), 1e-300)[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in an order of sums that depends on the two rows alone."""
    norm = lambda x: np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    a, b = norm(a), norm(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def neighbour_graph(u: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    k = min(k, len(u) - 1)
    out = np.empty((len(u), k), np.int64)
    for at in range(0, len(u), 1024):
        s = u[at : at + 1024] @ u.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -2
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(u: np.ndarray, graph: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each row, none above SLACK of an equal share, and the shares of parts among a row, its neighbours and those whose neighbour it is.

    Halved again and again along the direction of most variance, then rows move to where most of their neighbours are while there is room.
    """
    label = np.zeros(len(u), np.int64)
    made = 1
    while made < parts:
        for p in range(made):
            own = np.flatnonzero(label == p)
            x = u[own] - u[own].mean(axis=0)
            way = np.random.default_rng(p).standard_normal(u.shape[1])
            for _ in range(8):
                way = x.T @ (x @ way)
                way /= max(np.linalg.norm(way), 1e-300)
            label[own[np.argsort(x @ way, kind="stable")[len(own) // 2 :]]] = p + made
        made *= 2
    room = int(np.ceil(SLACK * len(u) / parts))
    a, b = np.repeat(np.arange(len(u)), graph.shape[1]), graph.ravel()

    def shares() -> np.ndarray:
        near = np.zeros((len(u), parts))
        np.add.at(near, (a, label[b]), 1)
        np.add.at(near, (b, label[a]), 1)
        return near

    for _ in range(REFINEMENTS):
        near, sizes = shares(), np.bincount(label, minlength=parts)
        rows = np.arange(len(u))
        better = near.argmax(axis=1)
        gain = near[rows, better] - near[rows, label]
        moved = 0
        for i in rows[gain > 0][np.argsort(-gain[gain > 0], kind="stable")]:
            if sizes[better[i]] < room:
                sizes[label[i]] -= 1
                sizes[better[i]] += 1
                label[i] = better[i]
                moved += 1
        if not moved:
            break
    near = shares()
    near[np.arange(len(u)), label] += 1
    return label, near / near.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Router:
    """A classifier with one hidden layer: the parts of unit vectors, likeliest first."""

    layers: tuple[np.ndarray, ...]

    @property
    def parts(self) -> int:
        return len(self.layers[3])

    def weights(self, u: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.maximum(u @ w.T + b, 0) @ v.T + c

    def order(self, u: np.ndarray) -> np.ndarray:
        return np.argsort(-self.weights(u), axis=1, kind="stable")


def fit(rows: np.ndarray, total: int, neighbours: int = NEIGHBOURS) -> Router:
    """A router for a table of so many rows, fitted on some of them; copies of a vector count once."""
    u = np.unique(units(rows), axis=0) if len(rows) else rows
    wanted = max(1, min(int(total**0.5 / SPREAD), len(u) // PART_ROWS))
    parts = 1 << int(np.log2(wanted))
    r = np.random.default_rng(11)
    hidden = HIDDEN if parts > 1 else 1
    width = rows.shape[1]
    layers = [r.standard_normal((hidden, width)) * (2 / max(width, 1)) ** 0.5, np.zeros(hidden), r.standard_normal((parts, hidden)) * hidden**-0.5, np.zeros(parts)]
    if parts == 1:
        return Router(tuple(layers))
    _, target = balanced_parts(u, neighbour_graph(u, neighbours), parts)
    scale = width**0.5  # unit vectors with components about 1
    x = u * scale
    mean, square, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(EPOCHS):
        deal = r.permutation(len(x))
        for at in range(0, len(x), BATCH):
            own = deal[at : at + BATCH]
            w, b, v, c = layers
            h = np.maximum(x[own] @ w.T + b, 0)
            z = h @ v.T + c
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - target[own]) / len(own)
            back = (d @ v) * (h > 0)
            step += 1
            for i, g in enumerate((back.T @ x[own], back.sum(axis=0), d.T @ h, d.sum(axis=0))):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                layers[i] = layers[i] - RATE * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    layers[0] = layers[0] * scale
    return Router(tuple(layers))


def best_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in q, position in d, cosine): of each row of q the k nearest of d with another id, ties to the smaller id.

    Of equal vectors of d only the k + 1 of smallest id can be among them; equal vectors are scored once.
    """
    if not len(q) or not len(d):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    by_id = np.argsort(ids, kind="stable")
    _, first, same = np.unique(np.ascontiguousarray(d[by_id]).view(np.dtype((np.void, d.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    one = d[by_id][first]
    group = np.argsort(same, kind="stable")  # of each different vector its copies, by id
    start = np.searchsorted(same[group], np.arange(len(one) + 1))
    copies = np.minimum(np.diff(start), k + 1)
    uq, ud = units(q), units(one)
    out = []
    for at in range(0, len(q), QUERIES_AT_ONCE):
        s = uq[at : at + QUERIES_AT_ONCE] @ ud.T
        least = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)] if s.shape[1] > k + 1 else np.full(len(s), -2.0)
        qi, di = np.nonzero(s >= least[:, None] - ROUNDING)
        exact = np.concatenate([cosines(q[at + qi[i : i + PAIRS_AT_ONCE]], one[di[i : i + PAIRS_AT_ONCE]]) for i in range(0, len(qi), PAIRS_AT_ONCE)])
        many = copies[di]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at_id = by_id[group[np.repeat(start[di], many) + nth]]
        qi, exact = np.repeat(at + qi, many), np.repeat(exact, many)
        keep = ids[at_id] != q_ids[qi]
        qi, at_id, exact = qi[keep], at_id[keep], exact[keep]
        o = np.lexsort((ids[at_id], -exact, qi))
        qi, at_id, exact = qi[o], at_id[o], exact[o]
        nth = np.arange(len(qi)) - np.searchsorted(qi, qi)
        out.append((qi[nth < k], at_id[nth < k], exact[nth < k]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _dealt(router: Router, ident: str, vector: str, width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = router.weights(units(matrix(b.column(vector), width))).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(ident), b.column(vector), pa.array(part, pa.int32())], names=["vec_id", "v", "part"])

    return run


def _sent(router: Router, sizes: np.ndarray, probes: int, k: int, width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A query goes to its likeliest parts, to further ones until they hold more than k rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = router.order(units(matrix(b.column("v"), width)))
            enough = (np.cumsum(sizes[order], axis=1) <= k).sum(axis=1) + 1
            many = np.minimum(np.maximum(probes, enough), router.parts)
            row, nth = np.nonzero(np.arange(router.parts) < many[:, None])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(take), b.column("v").take(take), pa.array(order[row, nth], pa.int32())], names=["query_id", "q", "part"])

    return run


def _scanned(q_ids: np.ndarray, q: np.ndarray, k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best of all rows of a task for each of a few queries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            ids, part = b.column("vec_id").to_numpy(), b.column("part").to_numpy()
            qi, di, score = best_of(q_ids, q, ids, matrix(b.column("v"), q.shape[1]), k)
            new = (qi, ids[di], part[di], score)
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            o = np.lexsort((held[1], -held[3], held[0]))
            held = tuple(x[o] for x in held)
            keep = np.arange(len(o)) - np.searchsorted(held[0], held[0]) < k
            held = tuple(x[keep] for x in held)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, (pa.int32(), pa.int64(), pa.int32(), pa.float64()), strict=True)], names=["q", "vec_id", "part", "score"])

    return run


def first_k(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of each key by score, ties to the smaller vec_id, with their rank; Spark cuts each task's rows before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def measured_probes(dealt: DataFrame, queries: pa.Table, router: Router, width: int, k: int, recall: float) -> tuple[int, float]:
    """How many parts a query must see for the wanted recall on these queries, by brute force over all rows, and the recall that gives."""
    ids, q = queries.column("vec_id").to_numpy(), matrix(queries.column("v"), width)
    if not len(ids) or router.parts == 1:
        return 1, 1.0
    near = first_k(dealt.mapInArrow(_scanned(ids, q, k), "q int, vec_id long, part int, score double"), ["q"], k).select("q", "part").toArrow()
    if not near.num_rows:
        return 1, 1.0
    rank = np.argsort(router.order(units(q)), axis=1)
    met = np.bincount(rank[near.column("q").to_numpy(), near.column("part").to_numpy()], minlength=router.parts).cumsum() / near.num_rows
    probes = int(np.searchsorted(met, recall)) + 1
    return min(probes, router.parts), float(met[min(probes, router.parts) - 1])


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int = 5, recall: float = RECALL, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k rows of greatest cosine that its parts hold, itself excluded.

    rows and queries have an id and a vector; a row with the id of a query is no candidate of it. Null ids and vectors, zero and empty vectors and those
    with null or non-finite components take no part. Rows that share an id are one row, the one of least vector. Shorter vectors
    are filled with zeros. Ties go to the smaller id; if there are fewer than k candidates all are found. Other columns are ignored. Every
    row is indexed, and is in exactly one part. A part of any size is searched in blocks. Empty tables give no row.
    """
    spark = rows.sparkSession
    some = lambda df: usable(df.where(F.exists(vector, lambda x: x != 0)), ident, vector)
    with Scratch(spark) as scratch:
        own = some(rows)
        total, width = own.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
        asked = some(queries)
        width = max(width, asked.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0])
        router = fit(matrix(sample(own, ident, vector, total, width, SAMPLE_ROWS).column(vector), width), total)
        dealt = scratch.save(own.mapInArrow(_dealt(router, ident, vector, width), f"vec_id long, v {own.schema[vector].dataType.simpleString()}, part int"))
        counts = {r.part: r["count"] for r in dealt.groupBy("part").count().collect()}
        sizes = np.array([counts.get(p, 0) for p in range(router.parts)])
        asked = scratch.save(asked.select(F.col(ident).alias("vec_id"), F.col(vector).alias("v")))
        n = asked.count()
        probes, _ = measured_probes(dealt, sample(asked, "vec_id", "v", n, width, CALIBRATION), router, width, k, recall)
        sent = asked.mapInArrow(_sent(router, sizes, probes, k, width), f"query_id long, q {asked.schema['v'].dataType.simpleString()}, part int")
        many = {r.part: r["count"] for r in sent.groupBy("part").count().collect()}
        tiles = Tiles(width)
        blocks = spark.createDataFrame([(p, counts.get(p, 0), many[p]) for p in many], "part int, n long, m long")
        blocks = F.broadcast(blocks.select("part", tiles.count("n").alias("ns"), tiles.count("m").alias("ms")))  # a row a part
        left = sent.join(blocks, "part").select("query_id", "q", "part", Tiles.block("query_id", "ms").alias("i"), Tiles.every("ns").alias("j"))
        right = dealt.join(blocks, "part").select("vec_id", "v", "part", Tiles.every("ms").alias("i"), Tiles.block("vec_id", "ns").alias("j"))

        def met(a: pa.Table, b: pa.Table) -> pa.Table:
            q_ids, ids = a.column("query_id").to_numpy(), b.column("vec_id").to_numpy()
            qi, di, score = best_of(q_ids, matrix(a.column("q"), width), ids, matrix(b.column("v"), width), k)
            return pa.table({"query_id": q_ids[qi], "vec_id": ids[di], "score": score})

        key = ["part", "i", "j"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(met, "query_id long, vec_id long, score double")
        return scratch.keep(first_k(found, ["query_id"], k).select("query_id", "rank", "vec_id", "score"))
