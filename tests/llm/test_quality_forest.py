import random
from collections import Counter

import numpy as np

from scoutline.llm.quality_forest import base_failed, fit_forest, fit_quality, keep_good, quality_rules, separation, statistics, threshold


def brute(t):
    t = t or ""
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    again = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(again)]


def test_statistics_as_stated():
    r = random.Random(3)
    for _ in range(300):
        t = "".join(r.choice(["a", "b ", "é ", "a b a b ", "\n", "$", "\xa0", " ", "\x0b", "x\n"]) for _ in range(r.randrange(60)))
        assert statistics(t.encode())[0] == brute(t), repr(t)
    assert statistics(None)[0] == [0] * 5
    assert base_failed([49, 1, 0, 0, 0]) and base_failed([100, 1, 0, 0, 51]) and not base_failed([100, 1, 0, 0, 50])


def test_forest_paths_isolate_outliers():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 3))
    f = fit_forest(x, np.ones(3))
    assert f.score(np.array([[9.0, 9, 9]]))[0] > 0.65 > 0.5 > np.median(f.score(x))
    assert (fit_forest(x, np.ones(3)).score(x) == f.score(x)).all()
    assert len(fit_forest(np.ones((5, 2)), np.ones(2)).trees) == 100
    assert 0.4 < threshold(np.array([0.3, 0.4]), np.array([0.6, 0.7])) < 0.6
    assert threshold(np.array([]), np.array([0.5])) == 1.0


def test_scores_are_mean_path_lengths():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 4)) ** 3
    f = fit_forest(x, np.array([1.0, 0.5, 0.0, 2.0]), trees=20, rows=64)

    def harmonic(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    for row, score in zip(x[:40], f.score(x[:40]), strict=True):
        total = 0.0
        for feature, value, left, length in f.trees:
            at, depth = 0, 0
            while feature[at] >= 0:
                assert feature[at] != 2
                at, depth = int(left[at]) + bool(row[feature[at]] >= value[at]), depth + 1
            assert depth <= length[at] <= depth + harmonic(64)
            total += length[at]
        assert abs(score - 2 ** -(total / 20 / harmonic(64))) < 1e-12


def test_separation_of_labelled_rows():
    good = np.array([[0.0, 1, 5, 0, 0, 0], [0, 2, 5, 0, 0, 0]])
    bad = np.array([[1.0, 1, 5, 0, 0, 0], [2, 3, 5, 0, 0, 0]])
    assert separation(good, bad).tolist() == [1, 0.25, 0, 0, 0, 0]
    assert separation(good, bad[:0]).tolist() == [1] * 6 == separation(good, good).tolist()


def docs(spark):
    r = random.Random(9)
    words = [f"{a}{b}" for a in ("the", "ran", "of", "mil") for b in ("", "ing", "es", "ton", "a", "or")]
    rows = []
    for i in range(400):
        text = ". ".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(8))
        if i % 8 == 0:
            text = " ".join(w + r.choice(["$$$", "%%%"]) for w in text.split())
        rows.append((i, text, 1 if i % 8 else 0))
    return spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2], 0) for x in rows if x[0] % 3], "doc_id long, quality int, toxic int")


def test_held_out_junk_goes_and_clean_stays(spark):
    d, labels = docs(spark)
    got = quality_rules(d, labels).collect()
    held = [r for r in got if r.doc_id % 3 == 0]
    assert all(r.kept == bool(r.doc_id % 8) for r in held)
    assert {r.doc_id for r in keep_good(d, labels).collect()} == {r.doc_id for r in got if r.kept}


def test_labels_say_which_rarity_is_harmful(spark):
    """Repeated lines and long words are as rare as symbols; only the latter are labelled bad. No bound could tell."""
    r = random.Random(5)
    rows = []
    for i in range(900):
        text = [" ".join(r.choice("abcdefghijk") * r.choice([2, 3, 6]) + r.choice("xyz") + str(r.randrange(90)) for _ in range(10)) for _ in range(9)]
        kind = {0: "lines", 1: "symbols"}.get(i % 15, "")
        if kind == "lines":
            text[6:] = text[5:6] * 3
        rows.append((i, "\n".join(text).replace(" ", " $ " if kind == "symbols" else " "), kind))
    d = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k != "symbols")) for i, _, k in rows if i % 2], "doc_id long, quality int")
    kept = {x.doc_id for x in quality_rules(d, labels).where("kept").collect()}
    for i, _, kind in rows:
        assert (i in kept) == (kind != "symbols"), (i, kind)


def test_the_sample_is_bounded_by_rows(spark):
    d = spark.createDataFrame([(1, " ".join(str(i * j) for j in range(60))) for i in range(50)], "doc_id long, text string")
    model = fit_quality(d, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), 20)
    assert model.forest.rows <= 20


def test_edges(spark):
    d = spark.createDataFrame([(1, None, "x"), (None, "a " * 60, "y"), (2, "q", None), (2, "q", None)], "doc_id long, text string, kept string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id or -1, r.n_words, r.base_failed, r.kept) for r in quality_rules(d, none).collect())
    assert got == [(-1, 60, True, False), (1, 0, True, False), (2, 1, True, False), (2, 1, True, False)]
    assert keep_good(d, none).collect() == []
    assert quality_rules(d.limit(0), none).collect() == []
    bad = spark.createDataFrame([(1, 0, None), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    assert quality_rules(d, bad).count() == 4
