"""Vector search: exact in blocks of arrays, and by a saved index of cells with product codes.

The index is fitted on a bounded sample: cells are centres of unit vectors, and what a vector differs from its centre is coded with one byte for each
stretch of components. Every vector is in one cell. A search visits the cells nearest to a query, ranks their codes by tables of inner products,
and scores the best of them again with the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoutline.functions.arrays import closest, kmeans, matrix, unit

#: Vectors that an index is fitted on, at most, and components of them.
SAMPLE_ROWS, SAMPLE_VALUES = 16_384, 1 << 21
#: Cells for so many vectors: twice the root of their number, no more than a tenth of the sample.
CELLS, PER_CELL = 2, 10
#: Components that one byte stands for, and values of a byte.
STRETCH, VALUES = 4, 256
#: Rows of a block of queries, of codes and of vectors that a task holds at once.
QUERIES, ROWS = 1024, 65_536
CODES = "vec_id long, cell int, code binary"


def _merged(held: tuple[np.ndarray, ...] | None, new: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """(query, id, score): the k best of each query, ties to the smaller id."""
    rows = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
    order = np.lexsort((rows[1], -rows[2], rows[0]))
    rows = tuple(x[order] for x in rows)
    keep = np.arange(len(order)) - np.searchsorted(rows[0], rows[0]) < k
    return tuple(x[keep] for x in rows)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row, id, score): what may be among the k best of each row, with all that tie with the last."""
    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    q, i = np.nonzero(scores >= least[:, None])
    return q, ids[i], scores[q, i]


def _batch(found: tuple[np.ndarray, ...], qids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qids[found[0]]), pa.array(found[1]), pa.array(found[2])], names=["qid", "vec_id", "score"])


def _scan(qids: np.ndarray, q: np.ndarray, k: int, digits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            scores = np.round(q @ unit(matrix(b.column("embedding"), q.shape[1])).T, digits)
            held = _merged(held, _best(scores, b.column("vec_id").to_numpy(), k), k)
        if held is not None:
            yield _batch(held, qids)

    return run


def first_k(found: DataFrame, k: int) -> DataFrame:
    """With rank, the k best of each query; Spark cuts each task's rows before the shuffle."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _whole(rows: DataFrame, ident: str) -> DataFrame:
    return rows.where(F.col(ident).isNotNull() & F.col("embedding").isNotNull()).select(F.col(ident).cast("long").alias(ident), F.col("embedding").cast("array<double>").alias("embedding"))


def exact(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(qid, vec_id, score, rank): the k nearest by cosine, compared to so many digits, ties to the smaller vec_id. The queries are a stated set, taken in blocks.

    Each task scores its vectors against a block of queries in one product and keeps the best of each query, so no pair becomes a row. Shorter vectors are
    filled with zeros, and zero vectors score 0; rows without id or vector are left out.
    """
    asked = _whole(queries, "qid")
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    rows = _whole(vectors, "vec_id")
    found = None
    for i in range(max(1, -(-n // QUERIES))):
        part = asked if n <= QUERIES else asked.where(F.pmod(F.xxhash64("qid"), F.lit(-(-n // QUERIES))) == i)
        block = part.toArrow()
        one = rows.mapInArrow(_scan(block.column("qid").to_numpy(), unit(matrix(block.column("embedding"), width)), k, digits), "qid long, vec_id long, score double")
        found = one if found is None else found.unionByName(one)
    return first_k(found, k)


class Codec:
    """Centres of cells, and for each stretch of components the vectors that bytes stand for."""

    def __init__(self, centres: np.ndarray, books: np.ndarray):
        self.centres, self.books = centres, books

    @classmethod
    def fitted(cls, sample: np.ndarray, total: int) -> Codec:
        u = unit(sample)
        wide = np.pad(u, ((0, 0), (0, -u.shape[1] % STRETCH)))
        cells = max(1, min(int(CELLS * total**0.5), len(u) // PER_CELL))
        centres = kmeans(wide, cells) if len(u) else np.zeros((1, max(wide.shape[1], STRETCH)))
        rest = wide - centres[closest(wide, centres)[0]] if len(u) else np.zeros((1, centres.shape[1]))
        books = np.zeros((centres.shape[1] // STRETCH, VALUES, STRETCH))
        for s in range(len(books)):
            own = kmeans(rest[:, s * STRETCH : (s + 1) * STRETCH], VALUES, 6, s)
            books[s, : len(own)] = own
            books[s, len(own) :] = own[0]
        return cls(centres, books)

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def coded(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = closest(u, self.centres)[0]
        rest = u - self.centres[cell]
        return cell, np.column_stack([closest(rest[:, s * STRETCH : (s + 1) * STRETCH], book)[0] for s, book in enumerate(self.books)]).astype(np.uint8)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Estimated inner products of queries with the coded vectors of one cell."""
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), axis=1)
        for s, book in enumerate(self.books):
            out += (q[:, s * STRETCH : (s + 1) * STRETCH] @ book.T)[:, codes[:, s]]
        return out

    def save(self, spark: SparkSession, folder: str) -> None:
        rows = [("centre", i, 0, [float(x) for x in c]) for i, c in enumerate(self.centres)]
        rows += [("book", s, i, [float(x) for x in v]) for s, book in enumerate(self.books) for i, v in enumerate(book)]
        spark.createDataFrame(rows, "kind string, i int, j int, v array<double>").coalesce(1).write.mode("overwrite").parquet(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Codec:
        t = spark.read.parquet(folder).orderBy("kind", "i", "j").toArrow()
        book = np.array(t.column("kind").to_pylist()) == "book"
        v = t.column("v").to_pylist()
        return cls(np.array([x for x, b in zip(v, book, strict=True) if not b]), np.array([x for x, b in zip(v, book, strict=True) if b]).reshape(-1, VALUES, STRETCH))


def build(vectors: DataFrame, folder: str) -> None:
    """Writes an index of vectors (vec_id, embedding): codec, codes by cell, and how many codes each cell has. Zero vectors and rows without id or vector are left out."""
    spark = vectors.sparkSession
    rows = _whole(vectors, "vec_id").where(F.exists("embedding", lambda x: x != 0))
    total, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    n = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // max(width, 1)))
    h = F.xxhash64(F.lit(23), "vec_id")
    part = rows if total <= 2 * n else rows.where(F.pmod(h, F.lit(1 << 20)) < max(1, round(1.5 * n / total * (1 << 20))))
    sample = part.orderBy(h, "vec_id").limit(n).toArrow()
    codec = Codec.fitted(matrix(sample.column("embedding"), width), total)

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, code = codec.coded(unit(matrix(b.column("embedding"), codec.width)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=["vec_id", "cell", "code"])

    codec.save(spark, f"{folder}/codec")
    rows.mapInArrow(coded, CODES).repartitionByRange("cell").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{folder}/codes")
    codes(spark, folder).groupBy("cell").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/sizes")


def codes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CODES).parquet(f"{folder}/codes")


def search(folder: str, queries: DataFrame, vectors: DataFrame, k: int, visit: float = 0.6, again: int = 20, digits: int = 9) -> DataFrame:
    """(qid, vec_id, score, rank): about the k nearest by cosine; exact scores of the ``again`` * k best codes in the nearest cells that hold a share ``visit`` of all vectors.

    With visit = 1 and as many codes as there are vectors it is the exact result. Cells of any size are taken in blocks.
    """
    spark = queries.sparkSession
    codec = Codec.load(spark, f"{folder}/codec")
    counts = {r.cell: r.n for r in spark.read.parquet(f"{folder}/sizes").collect()}  # a row a cell
    sizes = np.array([counts.get(c, 0) for c in range(len(codec.centres))])
    fetch, width = again * k, codec.width
    # The exact scores need all components of both sides, however long.
    asked = _whole(queries, "qid").where(F.exists("embedding", lambda x: x != 0))

    def sent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = np.argsort(-(unit(matrix(b.column("embedding"), width)) @ codec.centres.T), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            many = (held < max(visit * sizes.sum(), fetch)).sum(axis=1) + 1
            row, nth = np.nonzero((np.arange(order.shape[1]) < many[:, None]) & (sizes[order] > 0))
            yield pa.RecordBatch.from_arrays([b.column("qid").take(pa.array(row)), b.column("embedding").take(pa.array(row)), pa.array(order[row, nth], pa.int32())], names=["qid", "embedding", "cell"])

    left = asked.mapInArrow(sent, "qid long, embedding array<double>, cell int")
    many = {r.cell: r["count"] for r in left.groupBy("cell").count().collect()}
    blocks = spark.createDataFrame([(c, -(-m // QUERIES), -(-counts[c] // ROWS)) for c, m in many.items()], "cell int, qs int, ns int")
    left = left.join(F.broadcast(blocks), "cell").select("qid", "embedding", "cell", F.pmod(F.xxhash64("qid"), "qs").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("j"))
    right = codes(spark, folder).join(F.broadcast(blocks), "cell").select("vec_id", "code", "cell", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("i"), F.pmod(F.xxhash64("vec_id"), "ns").cast("int").alias("j"))

    def ranked(a: pa.Table, b: pa.Table) -> pa.Table:
        qids, ids = a.column("qid").to_numpy(), b.column("vec_id").to_numpy()
        if not len(qids) or not len(ids):
            return pa.table({"qid": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        q = unit(matrix(a.column("embedding"), width))
        cell = a.column("cell")[0].as_py()
        found = [_merged(None, _best(codec.scores(q[at : at + 128], cell, code), ids, fetch), fetch) for at in range(0, len(q), 128)]
        rows = np.concatenate([f[0] + 128 * n for n, f in enumerate(found)])
        return pa.table({"qid": qids[rows], "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    near = left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInArrow(ranked, "qid long, vec_id long, score double")
    near = first_k(near, fetch).select("qid", "vec_id")
    pairs = near.join(_whole(vectors, "vec_id"), "vec_id").join(asked.withColumnRenamed("embedding", "q"), "qid")

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            longest = max([0, *(len(x) for c in ("embedding", "q") for x in b.column(c))])
            score = (unit(matrix(b.column("embedding"), longest)) * unit(matrix(b.column("q"), longest))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("vec_id"), pa.array(np.round(score, digits))], names=["qid", "vec_id", "score"])

    return first_k(pairs.mapInArrow(scored, "qid long, vec_id long, score double"), k)
