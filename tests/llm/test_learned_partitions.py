import math
import random

import numpy as np
import pytest

from scoutline.llm import learned_partitions, vectors
from scoutline.llm.learned_partitions import balanced_parts, best_of, fit, nearest_neighbours, neighbour_graph, units
from scoutline.llm.queries import QUERIES
from scoutline.session import table

SCHEMA = "vec_id long, embedding array<float>, label int, score double, part string, rank int"


def cosine(a, b):
    n = max(len(a), len(b))
    a, b = [*a, *[0.0] * (n - len(a))], [*b, *[0.0] * (n - len(b))]
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def brute(rows, queries, k=5):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine[i] = min(fine.get(i, v), v)
    out = {}
    for q in queries:
        if q in fine:
            near = sorted((-round(cosine(fine[q], v), 12), i) for i, v in fine.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query_against_brute_force(spark, sf):
    sf = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    asked = np.flatnonzero(ids % 50 == 0)
    s = units(v[asked]) @ units(v).T
    s[np.arange(len(asked)), asked] = -9
    want = {int(ids[q]): set(ids[np.argsort(-s[i])[:5]]) for i, q in enumerate(asked)}
    got = found(QUERIES["op11_learned_partitions"](spark, sf))
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    assert sum(len(want[q] & {i for i, _ in got[q]}) for q in want) >= 0.9 * 5 * len(want)
    at = {int(i): x for i, x in zip(ids, v)}
    for q in list(got)[:10]:
        scores = [s for _, s in got[q]]
        assert scores == sorted(scores, reverse=True) and all(abs(s - cosine(at[q], at[i])) < 1e-11 for i, s in got[q])


def test_odd_rows_are_exact_where_one_part_holds_all(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(90)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    rows += [(100 + i, rows[3][1]) for i in range(20)] + [(150, [2 * x for x in rows[3][1]]), (200, rows[3][1][:4])]
    rows += [(250, None), (300, [0.0] * 6), (350, []), (400, [1.0, None]), (450, [1.0, math.nan]), (500, [math.inf, 1.0]), (None, [1.0] * 6), (0, rows[0][1]), (0, rows[7][1]), (7, rows[7][1])]
    rows += [(550, [1e30, -1e30]), (600, [1e-40, 0.0])]
    df = spark.createDataFrame([(*x, 1, 0.5, "x", 3) for x in rows], SCHEMA).repartition(3)
    ids = {i for i, _ in rows if i is not None and i % 50 == 0} | {3}
    assert found(nearest_neighbours(df, df.where(df.vec_id.isin(*ids)))) == brute(rows, ids)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, -1.0])], "vec_id long, embedding array<double>")
    asked = lambda df: nearest_neighbours(df, df.where("vec_id % 50 = 0"))
    assert found(asked(df)) == {0: [(1, round(0.5**0.5, 12)), (50, 0.0)], 50: [(0, 0.0), (1, -round(0.5**0.5, 12))]}
    assert asked(df.where("vec_id = 0")).collect() == [] == asked(df.where("vec_id < 0")).collect()
    assert nearest_neighbours(df, df.where("vec_id = 7")).collect() == []


def test_blocks_many_parts_and_a_hot_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE_VALUES", 64 * 8)
    monkeypatch.setattr(learned_partitions, "SPREAD", 1)
    r = np.random.default_rng(2)
    centres = r.standard_normal((12, 8)) * 3
    v = np.concatenate([centres[r.integers(0, 12, 800)] + 0.3 * r.standard_normal((800, 8)), np.tile(centres[0], (400, 1))])
    v = r.permutation(v)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = [i for i in range(len(v)) if i % 10 == 0]
    got, want = found(nearest_neighbours(df, df.where("vec_id % 10 = 0"))), brute(rows, asked)
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.93 * 5 * len(want)


def test_parts_are_balanced_and_separate_few_neighbours():
    r = np.random.default_rng(1)
    centres = r.standard_normal((16, 10)) * 4
    u = units(centres[r.integers(0, 16, 640)] + 0.2 * r.standard_normal((640, 10)))
    graph = neighbour_graph(u, 10)
    label, share = balanced_parts(u, graph, 8)
    assert np.bincount(label, minlength=8).max() <= 89 and np.allclose(share.sum(axis=1), 1)
    assert (label[graph] == label[:, None]).mean() > 0.8
    router = fit(u, 640 * 16)
    assert router.parts == 16
    first = router.order(u)[:, 0]
    assert (first[graph] == first[:, None]).mean() > 0.7


def test_best_of_copies_and_ties():
    ids = np.array([5, 3, 9, 1, 7])
    d = np.array([[1.0, 0], [1.0, 0], [2.0, 0], [0, 1.0], [1.0, 0]])
    qi, di, s = best_of(np.array([3, 8]), np.array([[1.0, 0], [0, 2.0]]), ids, d, 2)
    assert [(int(a), int(ids[b])) for a, b in zip(qi, di)] == [(0, 5), (0, 7), (1, 1), (1, 3)] and list(s) == [1, 1, 1, 0]
