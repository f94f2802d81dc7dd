"""Hard negatives by a distributed nearest-neighbour join over Voronoi cells.

Vectors become whole numbers, so that every score is exact. Candidates get one more component that brings them all to the same length; the
greatest inner product with an anchor is then the least distance. Anchors are assigned to pivots. For a group of anchors, what each of them
finds in a bounded sample of rows says which scores can still matter, and with the group's radius around its pivot this bounds
the distance of rows that might serve it. Only those are sent to the group, where they are compared exactly. Positives
and negatives are two such joins; the scores of the positives set the bands of the negatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.llm.learned_partitions import first_k
from scoutline.llm.shared import PART, Scratch, small
from scoutline.llm.vectors import Tiles, as_lists, matrix, sample, usable

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score is from LOW to HIGH percent of its positive's.
LOW, HIGH = 50, 95
#: Rows that bounds and pivots are taken from, at most, and pivots for so many anchors: the root of their number over SPREAD.
SAMPLE_ROWS, SPREAD, ROUNDS = 2048, 8, 5
#: Bounds are in doubles; they give way by this share.
SLACK = 1e-9
LEAST = np.iinfo(np.int64).min
#: Below, sums of products are exact in doubles or in 64-bit integers.
IN_DOUBLES, IN_INTEGERS = 2.0**52, 2.0**62


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b, whole numbers all; beyond 64 bits the ends of their range."""
    reach = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))
    most = reach.max(initial=0)
    if most < IN_DOUBLES:
        return (a @ b.T).astype(np.int64)
    if most < IN_INTEGERS:
        return a.astype(np.int64) @ b.astype(np.int64).T
    out = np.where(reach < IN_DOUBLES, a @ b.T, 0.0)
    whole = np.where(np.abs(out) < IN_DOUBLES, out, 0).astype(np.int64)
    for i, j in zip(*np.nonzero(~(reach < IN_DOUBLES)), strict=True):
        whole[i, j] = max(LEAST + 1, min(-(LEAST + 1), sum(int(x) * int(y) for x, y in zip(a[i], b[j], strict=True))))
    return whole


def greatest(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest scores, in order, equal ones by position."""
    at = np.arange(len(scores)) if len(scores) <= k else np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.argsort(-scores[at], kind="stable")][:k]


def band(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score of a negative: LOW * positive <= 100 * score <= HIGH * positive."""
    whole, rest = positive // 100, positive % 100
    return whole * LOW - (-rest * LOW) // 100, whole * HIGH + rest * HIGH // 100


def positives_of(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, rows: tuple[np.ndarray, ...], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, positions, scores): of each anchor the k best rows of its label with another id; rows: ids ascending, labels, vectors."""
    for at in range(0, len(ids), PART):
        s = inner(v[at : at + PART], rows[2])
        for i in range(len(s)):
            near = np.flatnonzero((rows[1] == labels[at + i]) & (rows[0] != ids[at + i]))
            best = near[greatest(s[i, near], k)]
            yield at + i, best, s[i, best]


def negatives_of(labels: np.ndarray, v: np.ndarray, bands: list[tuple[np.ndarray, np.ndarray]], rows: tuple[np.ndarray, ...], k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, band, positions, scores): the k best rows of another label within each band of an anchor."""
    for at in range(0, len(labels), PART):
        s = inner(v[at : at + PART], rows[2])
        for i in range(len(s)):
            low, high = bands[at + i]
            near = np.flatnonzero((rows[1] != labels[at + i]) & (s[i] >= low.min()) & (s[i] <= high.max()))
            own = s[i, near]
            order = np.argsort(-own, kind="stable")
            own, near = own[order], near[order]
            for j in range(len(low)):
                first = np.searchsorted(-own, -high[j])
                last = min(first + k, int(np.searchsorted(-own, -low[j], "right")))
                yield at + i, j, near[first:last], own[first:last]


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Rows with one more component, by which all have the length most; of an anchor it is 0 instead."""
    return np.column_stack([v, np.sqrt(np.maximum(most * most - (v * v).sum(axis=1), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0))


def pivots(v: np.ndarray, most: float, n: int) -> np.ndarray:
    """n centres of lifted vectors, by a few rounds of means over a sample."""
    x = lifted(v, most)
    n = min(n, len(x))
    out = x[:n].copy()
    for _ in range(ROUNDS if n else 0):
        own = distances(x, out).argmin(axis=1)
        for p in range(n):
            if (own == p).any():
                out[p] = x[own == p].mean(axis=0)
    return out


@dataclass(frozen=True)
class Group:
    """What a group of anchors needs: scores from low to high; radius around the pivot, lifted and not; greatest distance of a row that may serve."""

    pivot: int
    low: float
    high: float
    radius: float
    plain: float
    far: float


def serves(x: np.ndarray, norm: np.ndarray, centre: np.ndarray, most: float, g: Group) -> np.ndarray:
    """Which rows might serve some anchor of the group: by the triangle inequality on lifted vectors, and by Cauchy and Schwarz on plain ones."""
    slack = SLACK * most * (most + 1) + 1e-6
    plain = x[:, :-1] @ centre[:-1]
    near = distances(x, centre[None, :])[:, 0] <= (g.far + g.radius) * (1 + SLACK) + 1e-3 + SLACK * most
    return near & (plain + g.plain * norm >= g.low - slack) & (plain - g.plain * norm <= g.high + slack)


def _whole(width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.floor(SCALE * matrix(b.column("v"), width))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), as_lists(v), pa.array(np.sqrt((v * v).sum(axis=1)))], names=["vec_id", "label", "v", "norm"])

    return run


COPIES = "vec_id long, label long, v array<double>, cell int"
GROUP_ROWS = "vec_id long, label long, v array<double>, cell int, low double, high double, radius double, plain double, far double"


def _grouped(centres: np.ndarray, most: float, seeds: tuple[np.ndarray, ...], k: int, width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchors with their cell and what they still need, given what they find among the seeds; with bands in columns lows and highs, else positives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, labels = matrix(b.column("v"), width), b.column("label").to_numpy()
            low, high = np.full(len(v), -np.inf), np.full(len(v), np.inf)
            if "scores" in b.schema.names:
                bands = [band(np.array(x, np.int64)) for x in b.column("scores").to_pylist()]
                low = np.array([x.min() for x, _ in bands], float)
                high = np.array([x.max() for _, x in bands], float)
                reached = np.full(len(v), np.inf)
                for i, j, _, found in negatives_of(labels, v, bands, seeds, k):
                    reached[i] = min(reached[i], found[-1] if len(found) == k else bands[i][0][j])
                low = np.maximum(low, reached)
            else:
                for i, _, found in positives_of(b.column("vec_id").to_numpy(), labels, v, seeds, k):
                    low[i] = found[-1] if len(found) == k else -np.inf
            d = distances(np.column_stack([v, np.zeros(len(v))]), centres)
            cell = d.argmin(axis=1)
            plain = np.sqrt(((v - centres[cell, :-1]) ** 2).sum(axis=1))
            far = np.sqrt(np.maximum((v * v).sum(axis=1) + most * most - 2 * low, 0))
            floats = [pa.array(x.astype(float)) for x in (low, high, d[np.arange(len(v)), cell], plain, far)]
            rest = [b.column(c) for c in ("scores", "others") if c in b.schema.names]
            names = [x.split(" ")[0] for x in GROUP_ROWS.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), pa.array(cell, pa.int32()), *floats, *rest], names=[*names, *(c for c in ("scores", "others") if c in b.schema.names)])

    return run


def _copied(centres: np.ndarray, most: float, width: int, groups: list[Group]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows, one for each group that they might serve."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, norm = lifted(matrix(b.column("v"), width), most), b.column("norm").to_numpy()
            for g in groups:
                take = pa.array(np.flatnonzero(serves(x, norm, centres[g.pivot], most, g)))
                cell = pa.array(np.full(len(take), g.pivot), pa.int32())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("vec_id", "label", "v")), cell], names=["vec_id", "label", "v", "cell"])

    return run


def needs(anchors: DataFrame) -> list[Group]:
    """One group a pivot that has anchors."""
    stats = anchors.groupBy("cell").agg(F.min("low"), F.max("high"), F.max("radius"), F.max("plain"), F.max("far"))
    return [Group(*r) for r in stats.collect()]


def _sides(a: pa.Table, b: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Ids, labels and vectors of the anchors, and of the rows by id."""
    b = b.sort_by("vec_id")
    rows = b.column("vec_id").to_numpy(), b.column("label").to_numpy(), matrix(b.column("v"), width)
    return a.column("vec_id").to_numpy(), a.column("label").to_numpy(), matrix(a.column("v"), width), rows


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, exact; rows: (vec_id, embedding, label).

    Anchors are rows whose vec_id is divisible by ``every``. Null labels, ids, vectors and components, and components not finite as SCALE times
    themselves, take no part. Rows that share an id are one row, that of least label and vector. Shorter vectors are filled with zeros.
    Equal scores go by the smaller vec_id. Scores beyond a long are its ends. Anchors without positives, and positives without negatives in their band, give
    no row, nor does an empty table. Other columns are ignored. Groups of any size are compared in blocks.
    """
    spark = rows.sparkSession
    with Scratch(spark) as scratch:
        own = usable(rows.withColumn("label", F.col("label").cast("long")).where("label is not null"), "vec_id", "embedding", "label", factor=SCALE)
        width = own.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
        own = own.select("vec_id", "label", F.col("embedding").alias("v"))
        placed = scratch.save(own.mapInArrow(_whole(width), "vec_id long, label long, v array<double>, norm double"))
        total, most, n = placed.agg(F.count("*"), F.coalesce(F.max("norm"), F.lit(0.0)), F.count_if(F.col("vec_id") % every == 0)).first()
        taken = sample(placed, "vec_id", "v", total, width, SAMPLE_ROWS).sort_by("vec_id")
        seeds = taken.column("vec_id").to_numpy(), taken.column("label").to_numpy(), matrix(taken.column("v"), width)
        centres = pivots(seeds[2], most, max(1, int(np.ceil(n**0.5 / SPREAD))))
        tiles = Tiles(width)
        key = ["cell", "i", "j"]

        # The best rows of an anchor's label, compared by label and cell.
        anchors = placed.where(F.col("vec_id") % every == 0)
        first = scratch.save(anchors.select("vec_id", "label", "v").mapInArrow(_grouped(centres, most, seeds, positives, width), GROUP_ROWS))
        sent = placed.mapInArrow(_copied(centres, most, width, needs(first)), COPIES)
        sizes = placed.groupBy("label").agg(F.count("*").alias("n"))
        blocks = first.groupBy("label", "cell").agg(F.count("*").alias("m")).join(sizes, "label").select("label", "cell", tiles.count("m").alias("ms"), tiles.count("n").alias("ns"))
        blocks = small(scratch.save(blocks))
        left = first.select("vec_id", "label", "v", "cell").join(blocks, ["label", "cell"])
        left = left.select("vec_id", "label", "v", "cell", Tiles.block("vec_id", "ms").alias("i"), Tiles.every("ns").alias("j"))
        right = sent.join(blocks, ["label", "cell"]).select("vec_id", "label", "v", "cell", Tiles.every("ms").alias("i"), Tiles.block("vec_id", "ns").alias("j"))

        def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
            ids, labels, v, there = _sides(a, b, width)
            found = list(positives_of(ids, labels, v, there, positives))
            at = np.concatenate([np.zeros(0, np.int64), *(x for _, x, _ in found)])
            scores = np.concatenate([np.zeros(0, np.int64), *(x for *_, x in found)])
            return pa.table({"anchor_id": pa.array(np.repeat(ids, [len(x) for _, x, _ in found]) if found else [], pa.int64()), "vec_id": there[0][at], "score": scores})

        best = left.groupBy("label", *key).cogroup(right.groupBy("label", *key)).applyInArrow(nearest, "anchor_id long, vec_id long, score long")
        best = scratch.save(first_k(best, ["anchor_id"], positives).select("anchor_id", "vec_id", "score"))

        # The best rows of other labels within the bands, compared by cell.
        pair = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("p"))  # as many as there are positives
        asked = anchors.join(pair, anchors.vec_id == pair.anchor_id).select("vec_id", "label", "v", F.col("p.score").alias("scores"), F.col("p.vec_id").alias("others"))
        second = scratch.save(asked.mapInArrow(_grouped(centres, most, seeds, negatives, width), f"{GROUP_ROWS}, scores array<long>, others array<long>"))
        sent = placed.mapInArrow(_copied(centres, most, width, needs(second)), COPIES)
        blocks = spark.createDataFrame([(r.cell, r.m) for r in second.groupBy("cell").agg(F.count("*").alias("m")).collect()], "cell int, m long")
        # A row a pivot.
        blocks = F.broadcast(blocks.select("cell", tiles.count("m").alias("ms"), tiles.count(F.lit(total)).alias("ns")))
        left = second.select("vec_id", "label", "v", "cell", "scores", "others").join(blocks, "cell")
        left = left.select("vec_id", "label", "v", "scores", "others", "cell", Tiles.block("vec_id", "ms").alias("i"), Tiles.every("ns").alias("j"))
        right = sent.join(blocks, "cell").select("vec_id", "label", "v", "cell", Tiles.every("ms").alias("i"), Tiles.block("vec_id", "ns").alias("j"))

        def harder(a: pa.Table, b: pa.Table) -> pa.Table:
            ids, labels, v, there = _sides(a, b, width)
            scores, others = a.column("scores").to_pylist(), a.column("others").to_pylist()
            out = [(int(ids[i]), others[i][j], scores[i][j], int(there[0][at]), int(s)) for i, j, near, own in negatives_of(labels, v, [band(np.array(x, np.int64)) for x in scores], there, negatives) for at, s in zip(near, own, strict=True)]
            return pa.table({c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(("anchor_id", "positive_id", "positive_score", "vec_id", "score"))})

        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(harder, "anchor_id long, positive_id long, positive_score long, vec_id long, score long")
        found = first_k(found, ["anchor_id", "positive_id"], negatives)
        return scratch.keep(found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


NEGATIVES_SQL = f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM (SELECT * FROM r WHERE vec_id % 50 = 0) a JOIN r ON a.vec_id <> r.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
