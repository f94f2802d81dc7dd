import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from scoutline.llm.mixing import mix_sources, route, targets


def test_targets_stop_at_twice_the_size_and_share_the_excess():
    assert targets([100, 100, 100]) == [200, Fraction(250, 3), Fraction(500, 3)]
    assert targets([10, 1000, 0]) == [20, 1495, 0]
    assert targets([]) == []
    assert targets([0, 0]) == [0, 0]


def test_flow_fills_quotas_with_least_repetition():
    a, b, ab = frozenset("a"), frozenset("b"), frozenset("ab")
    assert route([(a, 100), (b, 100), (ab, 100)], {"a": Fraction(150), "b": Fraction(150)}) == [100, 100, 100]
    assert route([(a, 100), (b, 10)], {"a": Fraction(150), "b": Fraction(50)}) == [150, 20]
    assert sum(route([(a, 30), (b, 90), (ab, 60)], {"a": Fraction(120), "b": Fraction(20)})) == 140


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 37)), ["s1", "s2", "é", None][i % 4], i) for i in range(400)] + [(9, None, "s1", 0), (9, "x y", "s1", 0), (9, "x y", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix_sources(df, carry=("source",)).collect()
    assert sorted(got, key=str) == sorted(mix_sources(df.repartition(7), carry=("source",)).collect(), key=str)
    assert len(got) == len(rows)
    for source in ("s1", "s2", "é", None):
        part = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 1
        assert sum(r.size for r in part) == part[0].source_size
        assert all(0 <= r.taken <= 2 * r["size"] for r in part)
    assert mix_sources(df.limit(0)).collect() == []


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(1, "a b c", ["x", "y"]), (2, "d e", ["x"]), (3, "f", None), (4, "g", [])], "doc_id long, text string, m array<string>")
    got = {r.doc_id: r for r in mix_sources(df, "m").collect()}
    assert got[1].source_size == 8 and got[3].source_size == 2 and got[3].taken <= 2


def best(patterns, quotas, passes=2):
    """Most words that quotas and patterns allow, and the least repetition with it, over all flows."""
    edges = [(p, s) for p, (members, _) in enumerate(patterns) for s in sorted(members)]

    def flows(i, room, left):
        if i == len(edges):
            yield []
            return
        p, s = edges[i]
        for x in range(min(room[p], left[s]) + 1):
            for rest in flows(i + 1, {**room, p: room[p] - x}, {**left, s: left[s] - x}):
                yield [x, *rest]

    found = []
    for flow in flows(0, {p: passes * n for p, (_, n) in enumerate(patterns)}, {s: int(q) for s, q in quotas.items()}):
        taken = [sum(x for x, (q, _) in zip(flow, edges, strict=True) if q == p) for p in range(len(patterns))]
        found.append((-sum(taken), sum(max(0, t - n) for t, (_, n) in zip(taken, patterns, strict=True))))
    return min(found)


def test_flow_is_the_best_of_all(spark):
    r = random.Random(8)
    for _ in range(60):
        members = r.sample([frozenset(x) for x in ("a", "b", "c", "ab", "bc", "ac", "abc")], r.randrange(1, 4))
        patterns = [(m, r.randrange(4)) for m in members]
        quotas = {s: Fraction(r.randrange(6)) for s in sorted({x for m in members for x in m})}
        taken = route(patterns, quotas)
        assert (-sum(taken), sum(max(0, t - n) for t, (_, n) in zip(taken, patterns, strict=True))) == best(patterns, quotas), (patterns, quotas)


def test_rows_without_or_with_repeated_ids_are_documents_of_their_own(spark):
    rows = [(None, "a b c d", "x"), (None, "e f", "x"), (1, "g h", "x"), (1, "g h", "x"), (1, None, "y"), (2, "", None)]
    got = mix_sources(spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, text string, source string, _p string, cut int"), carry=("source",)).collect()
    assert len(got) == 6 and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert sum(r.taken for r in got) == 15 and {r.source_size for r in got if r.source == "x"} == {10}
