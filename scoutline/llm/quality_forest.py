"""Quality rules: an isolation forest on rule statistics.

Every document becomes a few ratios that rules usually bound, on the scale of their ranks among good labelled rows.
Trees split random features at random values until rows stand alone; rows that do so early are
anomalous. A rare but harmless value isolates a row as much as a harmful one does, and so features are drawn
with weights: how far the values of good and bad labelled rows lie apart. Forest, weights and the score above which a
document is rejected are calibrated on a bounded sample of labelled rows. Statistics, scores and verdicts cover every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.llm.shared import parts

SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Labelled rows that the forest and its threshold are fitted on, at most: those of least hash.
SAMPLE_ROWS = 6000
TREES, ROWS_A_TREE, SEED = 100, 64, 8
#: Quantiles of the good rows that a scale holds.
KNOTS = 64
#: Shares of symbols and of upper-case letters in a text, exclamation marks a word, shares of repeated lines and of words in
#: repeated windows, mean word length.
FEATURES = ("symbols", "upper", "exclamations", "dup_lines", "repeat_words", "word_length")
#: A rejected good document weighs as much as so many bad ones that are kept.
CARE = 10


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The base statistics and the forest's features of one whole text; null counts as empty.

    bytes.split and bytes.strip know the white space \\x20 and \\x09-\\x0D only.
    """
    text = text or b""
    words = text.split()
    n = len(words)
    held = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(held[128:192].sum())
    chars = points - int(held[32] + held[9:14].sum())
    symbols = int(held[SYMBOLS].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
        pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        _, at, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        again = np.zeros(n, bool)
        hit = np.flatnonzero(count[at] > 1)
        for i in range(3):
            again[hit + i] = True
        repeat = int(again.sum())
    w, c = max(1, n), max(1, chars)
    ratios = [symbols / c, int(held[65:91].sum()) / c, int(held[33]) / w, dup / max(1, len(lines)), repeat / w, chars / w]
    return [n, chars, symbols, dup, repeat], ratios


def base_failed(s: list[int]) -> bool:
    return s[0] < 50 or 100 * s[4] > 50 * s[0]


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in a leaf), split value, left child (right is next), path length of a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    rows: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for anomalies."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, left, length in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                step = left[at] + (x[rows, feature[at]] >= value[at])
                at = np.where(inner, step, at)
            total += length[at]
        return 2.0 ** -(total / max(1, len(self.trees)) / max(_expected(self.rows), 1e-9))


@dataclass
class Scale:
    """Share of the good rows at or below a value; beyond their range, the logarithm of the excess is added.

    Where good rows lie densely or seldom makes no difference then: what stands apart is what none of them has.
    """

    knots: list[tuple[np.ndarray, np.ndarray, float]]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = [np.interp(c, v, share) + np.log1p(np.maximum(0, c - v[-1]) / unit) - np.log1p(np.maximum(0, v[0] - c) / unit) for c, (v, share, unit) in zip(x.T, self.knots, strict=True)]
        return np.array(out).T


def fit_scale(good: np.ndarray, rows: np.ndarray) -> Scale:
    """The unit of the excess is the width of the middle 98 % of good rows, or else the deviation of all rows."""
    knots = []
    for x, both in zip(good.T, rows.T, strict=True):
        x = np.sort(x)
        v = np.unique(np.quantile(x, np.linspace(0, 1, KNOTS + 1), method="inverted_cdf"))
        low, high = np.quantile(x, (0.01, 0.99))
        knots.append((v, np.searchsorted(x, v, "right") / len(x), float(high - low) or float(both.std()) or 1.0))
    return Scale(knots)


def separation(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Weight of each feature: the squared largest difference of the two distributions; 1 each without rows of both kinds or a difference."""
    if not len(good) or not len(bad):
        return np.ones(len(FEATURES))
    weights = []
    for x, y in zip(good.T, bad.T, strict=True):
        x, y, values = np.sort(x), np.sort(y), np.unique(np.concatenate([x, y]))
        weights.append(np.abs(np.searchsorted(x, values, "right") / len(x) - np.searchsorted(y, values, "right") / len(y)).max() ** 2)
    return np.array(weights) if any(weights) else np.ones(len(FEATURES))


def fit_forest(x: np.ndarray, weights: np.ndarray, trees: int = TREES, rows: int = ROWS_A_TREE, seed: int = SEED) -> Forest:
    """Trees over ``rows`` of x each; a split takes one of the features that vary there, drawn by its weight."""
    random = np.random.default_rng(seed)
    rows = min(rows, len(x))
    deepest = int(np.ceil(np.log2(max(2, rows))))
    made = []
    for _ in range(trees if rows else 0):
        nodes: list[list[float]] = [[-1, 0, 0, 0]]
        todo = [(0, x[random.choice(len(x), rows, replace=False)], 0)]
        while todo:
            at, part, depth = todo.pop()
            low, high = part.min(0), part.max(0)
            wide = np.where(high > low, weights, 0.0)
            if depth == deepest or not wide.any():
                nodes[at] = [-1, 0, 0, depth + _expected(len(part))]
                continue
            f = int(random.choice(len(wide), p=wide / wide.sum()))
            v = random.uniform(low[f], high[f]) or low[f]
            v = v if v > low[f] else np.nextafter(low[f], np.inf)
            nodes[at] = [f, v, len(nodes), 0]
            todo += [(len(nodes), part[part[:, f] < v], depth + 1), (len(nodes) + 1, part[part[:, f] >= v], depth + 1)]
            nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
        a = np.array(nodes)
        made.append((a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3]))
    return Forest(made, rows)


def threshold(good: np.ndarray, bad: np.ndarray, care: float = CARE) -> float:
    """The score above which a row is rejected: least (bad rows kept + care * good rows rejected), each as a share."""
    if not len(good) or not len(bad):
        return 1.0
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.unique(np.concatenate([good, bad, [1.0]]))
    kept = np.searchsorted(bad, cuts, "right") / len(bad)
    lost = 1 - np.searchsorted(good, cuts, "right") / len(good)
    i = int(np.argmin(kept + care * lost))
    return float((cuts[i] + cuts[min(i + 1, len(cuts) - 1)]) / 2)


@dataclass
class Quality:
    forest: Forest | None
    scale: Scale | None
    limit: float

    def kept(self, stats: list[list[int]], ratios: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        ok = np.array([not base_failed(s) for s in stats], bool)
        score = self.forest.score(self.scale(np.array(ratios))) if self.forest and len(ratios) else np.zeros(len(ratios))
        return ok & (score <= self.limit), score


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Quality:
    """Fits on at most ``sample_rows`` labelled documents that pass the base rules.

    Without a labelled good row there is no forest, and the base rules decide alone.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, quality int, " + ", ".join(f"{c} long" for c in STATS) + ", ratios array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            found = [statistics(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("quality").cast(pa.int32())]
                + [pa.array([s[i] for s, _ in found], pa.int64()) for i in range(len(STATS))]
                + [pa.array([r for _, r in found], pa.list_(pa.float64()))],
                ["doc_id", "quality", *STATS, "ratios"],
            )

    # The sample is bounded by sample_rows, and so is what is broadcast and collected, also where ids repeat.
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(run, schema)
    rows = found.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "ratios").limit(sample_rows).collect()
    rows = sorted((r for r in rows if not base_failed([r[c] for c in STATS])), key=lambda r: (r.doc_id, *r.ratios))
    good = np.array([r.ratios for r in rows if r.quality > 0]).reshape(-1, len(FEATURES))
    bad = np.array([r.ratios for r in rows if r.quality <= 0]).reshape(-1, len(FEATURES))
    if not len(good):
        return Quality(None, None, 1.0)
    scale = fit_scale(good, np.concatenate([good, bad]))
    forest = fit_forest(scale(np.concatenate([good, bad])), separation(good, bad))
    return Quality(forest, scale, threshold(forest.score(scale(good)), forest.score(scale(bad))))


def quality_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, base statistics, base_failed, kept, score, one row per input row.

    Null and empty texts have no words and fail the base rules. Null and repeated doc_ids are
    rows like any other. Other columns are ignored. Empty documents give an empty result; empty
    labels leave the verdict to the base rules. Texts of any length are read whole. Of labelled rows with equal hashes
    the sample takes those of smaller doc_id, then of smaller statistics; a score at the limit is kept.
    """
    model = fit_quality(docs, labels, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            found = [statistics(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            stats = [s for s, _ in found]
            kept, score = model.kept(stats, [r for _, r in found])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")]
                + [pa.array([s[i] for s in stats], pa.int64()) for i in range(len(STATS))]
                + [pa.array([base_failed(s) for s in stats], pa.bool_()), pa.array(kept), pa.array(score)],
                ["doc_id", *STATS, "base_failed", "kept", "score"],
            )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, kept boolean, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that the quality rules keep, with all their columns, whatever their names, in one pass without a shuffle.

    Each row is judged by its own text: null and repeated doc_ids are rows like any other, null and empty texts go, equal rows stay or go together.
    """
    model = fit_quality(docs, labels, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            found = [statistics(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            kept, _ = model.kept([s for s, _ in found], [r for _, r in found])
            yield pc.filter(b, pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
