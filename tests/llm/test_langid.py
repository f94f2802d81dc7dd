import random

import numpy as np
import pytest

from scoutline.llm.langid import Lattice, identify, vocabulary, words_of

SCHEMA = "doc_id long, text string, lang string, score int"


def segmentations(lattice, word):
    """Every segmentation, by recursion."""
    n, ends, ids = lattice.pieces_of([word], True)
    edges = [(i, j, int(k)) for (i, j), k in zip(ends, ids[0], strict=True) if k != lattice.none]

    def walk(i):
        return [[]] if i == n else [[k, *rest] for a, j, k in edges if a == i for rest in walk(j)]

    return walk(0)


def test_forward_is_the_sum_over_all_segmentations():
    lattice = Lattice(["▁a", "▁ab", "b", "c", "bc", "▁abc", "▁b"])
    prob = np.random.default_rng(1).random((8, 2))
    for word in ("a", "ab", "abc", "bcb", "zabz"):
        every = segmentations(lattice, word)
        assert np.allclose(lattice.scores([word], True, prob)[0], np.log(sum(prob[s].prod(0) for s in every)))
        p = 1 / 8
        total = sum(p ** len(s) for s in every)
        want = np.zeros(8)
        for s in every:
            for k in s:
                want[k] += p ** len(s) / total
        assert np.allclose(lattice.expected([word], np.array([3.0]), True) / 3000, want, atol=3e-3)
    assert len(segmentations(lattice, "abc")) == 4


def test_words():
    assert words_of("THE!! café_x2y | 9") == ["the", "café", "x", "y"]
    assert len(vocabulary()) > 5000


def corpus():
    r = random.Random(3)
    forms = {"xx": ["the", "ing", "tion", "th"], "yy": ["der", "ung", "sch", "keit"]}
    return [(i, " ".join("".join(r.choice(forms[k]) for _ in range(2)) for _ in range(8)), k, 0) for i in range(400) for k in [["xx", "yy"][i % 2]]]


def test_held_out_accuracy_and_reruns(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in identify(df).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert 60 < len(held) < 140
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in held) / len(held) > 0.97
    again = {r.doc_id: r for r in identify(df.repartition(5)).collect()}
    assert again == got
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_play_no_part(spark):
    rows = corpus()
    a = {r.doc_id: r for r in identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    wrong = [(i, t, "zz" if a[i].held_out else lang, s) for i, t, lang, s in rows]
    assert {r.doc_id: r for r in identify(spark.createDataFrame(wrong, SCHEMA)).collect()} == a


@pytest.mark.parametrize("with_rows", [True, False])
def test_edges(spark, with_rows):
    odd = [(1000, None, "xx", 0), (1001, "", None, 0), (1002, "12 $", "yy", 0), (None, "the thing", None, 0), (1003, "a" * 100_000, None, 0), (1003, "a" * 100_000, None, 0)]
    got = identify(spark.createDataFrame((corpus() if with_rows else []) + odd, SCHEMA)).collect()
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by[None].lang_pred == ("xx" if with_rows else "und")
    assert sum(r.doc_id == 1003 for r in got) == 2
    assert identify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_numerals_are_no_letters(spark):
    from scoutline.llm.langid import words_of

    assert words_of("½ ² ① Ⅷ 7 _ ٣") == [] and words_of("x² ⅷa Ⅷ一 é½") == ["x", "a", "一", "é"]
    rows = [(i, "the cat and the dog", "en") for i in range(20)] + [(100 + i, t, None) for i, t in enumerate(("½ ² ① Ⅷ", "12 ３", "the ½ cat"))]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == got[101] == ("und", 0.0) and got[102][0] == "en"
