import random
from itertools import combinations

import numpy as np
import pytest

from scoutline.llm.ngram_join import WordHashes, ngram_jaccard_join, shingles, signatures

SCHEMA = "doc_id long, text string"


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < n else {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
    home = {i: i for i in sets}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            home[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.choice([3, 8, 40, 150, 400]))]
        for _ in range(r.choice([1, 3, 12])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((len(rows), " ".join(own)))
    return [*rows, (900, None), (901, ""), (902, "  \n "), (903, "One two"), (904, "ONE\ttwo"), (905, "x " * 5000)]


@pytest.mark.parametrize(("n", "num", "seed"), [(3, 90, 1), (5, 80, 2), (3, 60, 3)])
def test_same_as_all_pairs(spark, n, num, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), n, num, 100).collect()}
    assert got == brute(rows, n, num, 100)


def test_linked_pairs_share_a_published_signature():
    r = np.random.default_rng(5)
    for _ in range(400):
        size, num = int(r.integers(1, 600)), int(r.choice([60, 80, 90]))
        a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        drop = int(r.integers(0, max(1, size // 4)))
        b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**63, int(r.integers(0, max(1, size // 8)))).astype(np.uint64)]))
        r.shuffle(b)
        b = np.sort(b)
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= num * (len(a) + len(b) - both):
            assert set(signatures(a, num, 100)) & set(signatures(b, num, 100))


def test_edges(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A B c\x0bd"), (None, "a b c d"), (3, None), (4, "z z z z"), (4, "q w e r t"), (5, "q w e r t")]
    df = spark.createDataFrame([(*x, "n", 7) for x in rows], "doc_id long, text string, component_id string, sig int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_jaccard_join(df).collect())
    assert got == [(-1, 2, -1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 1, 4), (4, 3, 4), (5, 3, 4)]
    assert ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_ascii_is_lowered():
    h = WordHashes()
    assert list(shingles("É a b".encode(), 3, h)) != list(shingles("é a b".encode(), 3, h))
    assert list(shingles("x\xa0y".encode(), 3, h)) != list(shingles(b"x y", 3, h))


@pytest.mark.parametrize(("words", "edits"), [(20, 1), (30, 2), (60, 3)])
def test_families_around_the_threshold(spark, words, edits):
    """Near copies of one text, of which some pairs reach the threshold and others don't."""
    r = random.Random(words)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(r.randrange(edits + 1)):
            at = r.randrange(len(own))
            own[at : at + r.choice([0, 1, 1])] = r.choice([[], [f"n{r.randrange(6)}"], [f"u{i}"]])
        rows.append((1000 - i, " ".join(own)))
    for n, num in ((3, 90), (5, 80), (3, 80)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), n, num, 100).collect()}
        assert got == brute(rows, n, num, 100)


@pytest.mark.parametrize("seed", [0, 3])
def test_families_that_share_a_passage(spark, seed):
    """Groups of one signature hold several families: links past a group's smallest member."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    common = [[r.choice(words) for _ in range(60)] for _ in range(3)]
    rows = []
    for _ in range(14):
        text = r.choice(common) + [r.choice(words) for _ in range(r.choice([25, 40, 60]))]
        for _ in range(r.choice([1, 2, 5, 9])):
            own = list(text)
            for _ in range(r.choice([0, 1, 2, 3, 5])):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((len(rows), " ".join(own)))
    r.shuffle(rows)
    for n, num in ((3, 90), (5, 80), (3, 70)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), n, num, 100).collect()}
        assert got == brute(rows, n, num, 100)
