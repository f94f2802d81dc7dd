"""Ranked search: the query syntax against a walk over its tree, block search against a join, vector search against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutline.operators import query_syntax, text_search, top_k, vector_index
from scoutline.operators.query_parser import DEEPEST, parse, rows, tokens

FIELDS = ["name", "content"]


def shown(node):
    if node is None:
        return None
    body = "(" + " ".join(occur + shown(n) for occur, n in node.children) + ")" if node.kind == "group" else f"{node.field or ''}:{node.kind}:{','.join(node.tokens)}"
    if node.kind == "range":
        body += f"{node.low}{node.high}"
    return body + (f"~{node.slop}" if node.slop else "") + (f"^{node.boost:g}" if node.boost != 1 else "")


@pytest.mark.parametrize(
    "query, tree",
    [
        ("a b", "(:text:a :text:b)"),
        ("a AND b OR c", "((+:text:a +:text:b) :text:c)"),
        ("name:(a b^2)^3 AND NOT c", "(+(name:text:a name:text:b^2)^3 -:text:c)"),
        ('"a b"~2 "c d"* "e"*', "(:text:a,b~2 :prefix:c,d)"),
        ("name:[a TO b} content:>=x", "(name:range:('a', True)('b', False) content:range:('x', True)(None, True))"),
        ("name: IN [a b a] *", "(name:set:a,b :all:)"),
        ("foo-bar \\(x\\) nope:y", "(:text:foo,bar :text:x :text:nope,y)"),
    ],
)
def test_tree(query, tree):
    assert shown(parse(query, FIELDS)) == tree


@pytest.mark.parametrize(
    "query, tree",
    [("a)) b", "(:text:a :text:b)"), ("(a OR b", "((:text:a :text:b))"), ("a^ b^x", "(:text:a :text:b :text:x)"), ("[a TO b] >x IN [a]", "(:text:in :text:a)"), ("AND OR NOT", None), ("", None), (None, None), ("name:[a,b TO c]", None), ('"open end', "(:text:open,end)"), ("+ a -", "(:text:a)")],
)
def test_what_cannot_be_read_is_left_out(query, tree):
    assert shown(parse(query, FIELDS)) == tree


def test_deep_parentheses_and_long_queries():
    root = parse("(" * 5000 + "a b" + ")" * 5000 + " c", FIELDS)
    assert max(r[3] for r in rows(1, root)) <= DEEPEST + 2
    assert len([*rows(1, parse("word " * 20_000, FIELDS))]) == 20_001


def walk(query, docs):
    """Scores by a walk over the tree for every document."""
    own = {d: {f: tokens(text or "") for f, text in zip(FIELDS, texts)} for d, texts in docs.items()}
    n, total = len(docs), {f: sum(len(x[f]) for x in own.values()) for f in FIELDS}
    df = {f: Counter(t for x in own.values() for t in set(x[f])) for f in FIELDS}
    idf = lambda f, t: math.log(1 + (n - df[f][t] + 0.5) / (df[f][t] + 0.5))

    def weight(f, terms, tf, length):
        return sum(idf(f, t) for t in terms) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (total[f] / n)))

    def leaf(node, d, f):
        w = own[d][f]
        t = node.tokens
        if node.kind == "all":
            return 1.0 if w else None
        if node.kind == "set":
            return 1.0 if set(w) & set(t) else None
        if node.kind == "range":
            (low, a), (high, b) = node.low, node.high
            fits = lambda x: (low is None or x > low or a and x == low) and (high is None or x < high or b and x == high)
            return 1.0 if any(map(fits, w)) else None
        fit = lambda x, i: x.startswith(t[i]) if node.kind == "prefix" and i == len(t) - 1 else x == t[i]
        tf = 0
        for s in range(len(w)):
            if fit(w[s], 0):
                at = s
                for i in range(1, len(t)):
                    at = next((p for p in range(at + 1, len(w)) if fit(w[p], i) and (node.slop or p == at + 1)), None)
                    if at is None:
                        break
                tf += at is not None and at - s - (len(t) - 1) <= node.slop
        return weight(f, t[:-1] if node.kind == "prefix" else t, tf, len(w)) if tf else None

    def score(node, d):
        if node.kind == "group":
            found = [(o, score(c, d)) for o, c in node.children]
            if any(o == "-" and s is not None or o == "+" and s is None for o, s in found):
                return None
            kept = [s for o, s in found if o != "-" and s is not None]
        else:
            if node.kind == "all" and node.field is None:
                kept = [1.0] if any(own[d][f] for f in FIELDS) else []
            else:
                kept = [s for f in ([node.field] if node.field else FIELDS) if (s := leaf(node, d, f)) is not None]
        return node.boost * sum(kept) if kept else None

    root = parse(query, FIELDS)
    return {d: round(s, 9) for d in docs if root is not None and (s := score(root, d)) is not None}


def test_search_as_a_walk_over_the_tree(spark):
    r = random.Random(8)
    word = lambda: r.choice(["a", "ab", "abc", "b", "ba", "c", "é", "日本", "zz"])
    docs = {i: (" ".join(word() for _ in range(r.randrange(4))), r.choice([None, " ".join(word() for _ in range(r.randrange(12)))])) for i in range(120)}
    queries = ["a b", "+a -b c", "a AND b OR c", "(a OR b^2) AND (content:c name:ab)^0.5", "a AND NOT (b OR c)", '"a b"', '"a c"~2 b', '"a b c"~3', '"a a"~1', '"b a"*', 'name:"a b z"*', "name:[a TO b}", "name:{a TO *]^3 content:a"]
    queries += ["content:>=b AND name:<ba", "name: IN [a zz nope]", "*", "+name:* -a", "-a", "((a b) (+c (+a -b)))^2 zz", "nothing", "", None, "AND", "a AND -b AND (c OR é)", "content:(a b)^1.5 -name:(c ab)", "+(a b) +(-c)"]
    frame = spark.createDataFrame([(i, *t) for i, t in docs.items()], "seq long, name string, content string")
    index = query_syntax.positions(frame, "seq", FIELDS)
    asked = spark.createDataFrame(list(enumerate(queries)), "qid int, query string")
    want = [walk(q, docs) for q in queries]
    for most in (query_syntax.MOST_TERMS, 0):
        got = {}
        for x in query_syntax.search(index, query_syntax.totals(index, frame), asked, FIELDS, most_terms=most).collect():
            got.setdefault(x.qid, {})[x.doc] = round(x.score, 9)
        for i, q in enumerate(queries):
            assert got.get(i, {}).keys() == want[i].keys(), q
            assert all(abs(s - want[i][d]) < 1e-8 for d, s in got.get(i, {}).items()), q


def test_search_of_nothing(spark):
    frame = spark.createDataFrame([], "seq long, name string, content string")
    index = query_syntax.positions(frame, "seq", FIELDS)
    asked = spark.createDataFrame([(1, "a"), (2, None)], "qid int, query string")
    assert query_syntax.search(index, query_syntax.totals(index, frame), asked, FIELDS).collect() == []
    assert query_syntax.search(index, query_syntax.totals(index, frame), asked.limit(0), FIELDS).collect() == []


@pytest.mark.parametrize("block", [top_k.BLOCK, 40])
def test_best_of_blocks_as_a_join(spark, monkeypatch, block):
    monkeypatch.setattr(top_k, "BLOCK", block)
    r = random.Random(block)
    text = lambda n: " ".join(f"w{min(int(r.expovariate(0.2)), 40)}" for _ in range(n))
    frame = spark.createDataFrame([(i, text(r.randrange(4)), r.choice([None, text(r.randrange(20))]), f"p{i % 3}") for i in range(400)] + [(1000 + i, "w1 w2", "w1", "p0") for i in range(60)], "seq long, name string, content string, p string")
    asked = spark.createDataFrame([(i, text(r.randrange(1, 6))) for i in range(40)] + [(50, None), (51, ""), (52, "w1 w1 w2"), (53, "unknown")], "qid int, query string")
    for part in (None, F.col("p")):
        index = text_search.postings(frame, "seq", FIELDS, part)
        want = text_search.top_k(text_search.bm25(index, asked, frame, "seq", part).withColumn("score", F.round("score", 6)), 7, ("qid", "part"))
        got = text_search.top_k(top_k.best(frame, "seq", FIELDS, asked, 7, part, F.col("seq") % 2, digits=6), 7, ("qid", "part"))
        key = lambda df: sorted((x.qid, x.part, x["rank"], x.doc, round(x.score, 5)) for x in df.collect())
        assert key(got) == key(want)
    monkeypatch.setattr(top_k, "MOST_TERMS", 3)
    assert key(text_search.top_k(top_k.best(frame, "seq", FIELDS, asked, 7, part, digits=6), 7, ("qid", "part"))) == key(want)


def test_hopeless_blocks_are_passed_over():
    best = top_k._Best(top_k.Asked([7], [(0, 0, 1), (0, 1, 2)]), 2, None)
    best.add(np.array([1, 1, 2]), np.array([0, 1, 0]), np.array([1.0, 2.0, 3.0]))
    best.add(np.array([5, 6]), np.array([0, 0]), np.array([0.5, 2.0]))
    assert best.passed == 1 and best.doc.tolist() == [[1, 2]] and best.score.tolist() == [[5.0, 3.0]]
    best.add(np.array([4, 4]), np.array([0, 0]), np.array([2.0, 2.0]))
    assert best.doc.tolist() == [[1, 4]]


def vectors(spark, v, extra=()):
    rows_ = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + list(extra)
    return spark.createDataFrame(rows_, "vec_id long, embedding array<double>").repartition(4)


def test_exact_vectors_as_brute_force(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = np.concatenate([r.standard_normal((150, 6)), np.zeros((2, 6)), np.tile(r.standard_normal(6), (30, 1))])
    frame = vectors(spark, v, [(None, [1.0] * 6), (500, None), (501, [])])
    asked = frame.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "qid")
    u = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    s = {i: dict(enumerate(np.round(u @ u[i], 9))) | {501: 0.0} for i in range(len(v))} | {500: {}}
    want = {q: [(i, x) for i, x in sorted(s[q].items(), key=lambda y: (-y[1], y[0]))[:8]] for q in range(0, len(v), 5)}
    for block in (vector_index.QUERIES, 10):
        monkeypatch.setattr(vector_index, "QUERIES", block)
        got = {}
        for x in vector_index.exact(asked, frame, 8).orderBy("qid", "rank").collect():
            got.setdefault(x.qid, []).append((x.vec_id, x.score))
        assert got == want


@pytest.mark.parametrize("clustered", [False, True])
def test_saved_cells_find_nine_of_ten(spark, tmp_path, monkeypatch, clustered):
    r = np.random.default_rng(5)
    v = r.standard_normal((3000, 32))
    if clustered:
        v = np.repeat(r.standard_normal((30, 32)) * 2, 100, axis=0) + 0.5 * v
        v[1000:2000] = v[1000]
    frame = vectors(spark, v)
    folder = str(tmp_path / "index")
    vector_index.build(frame, folder)
    assert vector_index.codes(spark, folder).select("vec_id").distinct().count() == 3000
    monkeypatch.setattr(vector_index, "ROWS", 300)
    asked = frame.where("vec_id % 60 = 0").withColumnRenamed("vec_id", "qid")
    read = lambda df: {(x.qid, x["rank"]): (x.vec_id, x.score) for x in df.collect()}
    want, got = read(vector_index.exact(asked, frame, 10)), read(vector_index.search(folder, asked, frame, 10))
    assert got.keys() == want.keys()
    assert sum(got[k][1] >= want[k[0], 10][1] for k in got) >= 0.9 * len(want)
    whole = read(vector_index.search(folder, asked.where("qid < 300"), frame, 10, visit=1.0, again=300))
    assert whole == {k: x for k, x in want.items() if k[0] < 300}


def test_few_vectors(spark, tmp_path):
    frame = vectors(spark, np.array([[1.0, 0], [0, 1.0]]), [(9, [0.0, 0.0]), (None, [1.0])])
    for name, rows_ in (("a", frame), ("b", frame.limit(0))):
        vector_index.build(rows_, str(tmp_path / name))
        found = vector_index.search(str(tmp_path / name), frame.withColumnRenamed("vec_id", "qid").where("qid = 0"), frame, 5).collect()
        assert [(x.vec_id, x.score) for x in found] == ([(0, 1.0), (1, 0.0)] if name == "a" else [])
