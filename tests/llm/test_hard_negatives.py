import math
import random

import numpy as np
import pytest

from scoutline.llm import hard_negatives as hn
from scoutline.llm import vectors
from scoutline.llm.hard_negatives import band, hard_negatives, inner

SCHEMA = "vec_id long, embedding array<double>, label int, norm double, cell int, score string"


def brute(rows, every=50):
    fine = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x * 256) for x in v):
            fine[i] = min(fine.get(i, (label, v)), (label, v))
    fine = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in fine.items()}
    out = []
    for a, (label, v) in fine.items():
        if a % every:
            continue
        score = {i: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(v, w)))) for i, (_, w) in fine.items() if i != a}
        best = sorted((-s, i) for i, s in score.items() if fine[i][0] == label)[:5]
        for s, p in best:
            s = -s
            near = sorted((-n, i) for i, n in score.items() if fine[i][0] != label and 50 * s <= 100 * n <= 95 * s)[:3]
            out += [(a, p, rank + 1, i, s, -n) for rank, (n, i) in enumerate(near)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 2, "x") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("tile", [vectors.TILE_VALUES, 16 * 16])
def test_same_as_all_pairs_with_odd_rows(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE_VALUES", tile)
    monkeypatch.setattr(hn, "SPREAD", 1)
    monkeypatch.setattr(hn, "SAMPLE_ROWS", 40)
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(-200, 400):
        c = r.choice(centres)
        v = [round(x + r.gauss(0, 0.2), 2) for x in c] if i % 3 else [round(x, 1) for x in centres[0]]
        rows.append((i, v, r.choice([0, 1, 2, -3]) if i % 11 else None))
    rows += [(1000, None, 1), (1050, [], 1), (1100, [0.0] * 6, 2), (1150, [1.0, None], 2), (1200, [math.nan], 0), (1250, [-math.inf], 0), (1300, [1e307], 0), (None, centres[0], 1)]
    rows += [(1350, centres[1][:3], 1), (50, centres[2], 0), (50, centres[2], 0), (1400, centres[3], 77)]
    assert found(hard_negatives(frame(spark, rows), 25)) == brute(rows, 25)


def test_scores_beyond_doubles(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([1.0, 3e5, 7e7, 1e12]) * r.random() for _ in range(4)], i % 3) for i in range(60)]
    assert found(hard_negatives(frame(spark, rows), 10)) == brute(rows, 10)


def test_groups_leave_out_rows_that_cannot_serve(spark):
    r = np.random.default_rng(6)
    centres = np.eye(8) * 2
    v = np.concatenate([centres[i % 8] + 0.02 * r.standard_normal(8) for i in range(800)]).reshape(-1, 8)
    rows = [(i, [float(x) for x in row], int(i // 8 % 2)) for i, row in enumerate(v)]
    sizes = []
    serves = hn.serves
    x = np.floor(256 * v)
    most = float(np.sqrt((x * x).sum(axis=1)).max())
    for c in range(8):
        own = x[c::8]
        centre = hn.lifted(own.mean(axis=0, keepdims=True), most)[0]
        low = 0.5 * inner(own, own).min()
        radius = hn.distances(np.column_stack([own, np.zeros(len(own))]), centre[None]).max()
        g = hn.Group(c, low, np.inf, float(radius), float(np.sqrt(((own - centre[:-1]) ** 2).sum(axis=1)).max()), float(np.sqrt((own * own).sum(axis=1).max() + most**2 - 2 * low)))
        kept = serves(hn.lifted(x, most), np.sqrt((x * x).sum(axis=1)), centre, most, g)
        assert kept[c::8].all()
        sizes.append(kept.sum())
    assert max(sizes) < 200
    assert found(hard_negatives(frame(spark, rows), 50)) == brute(rows, 50)


def test_few_rows_and_none(spark):
    assert found(hard_negatives(frame(spark, []))) == []
    assert found(hard_negatives(frame(spark, [(0, [1.0], 1)]))) == []
    assert found(hard_negatives(frame(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.5], 2), (4, [0.49], 2)]))) == brute([(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.5], 2), (4, [0.49], 2)])


def test_bands_and_products():
    p = np.array([100, 99, 1, 0, -1, -100, 2**62, 10**17 + 7])
    low, high = band(p)
    for x, a, b in zip(p.tolist(), low.tolist(), high.tolist(), strict=True):
        assert a == -((-50 * x) // 100) and b == 95 * x // 100
    a = np.array([[3.0, -2.0], [2.0**27, 1.0], [2.0**40, 5.0]])
    assert inner(a, a).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) if abs(sum(int(x) * int(y) for x, y in zip(r, s))) < 2**63 else 2**63 - 1 for s in a] for r in a]
