import json
import random

import pytest
from pyspark.sql import functions as F

from scoutline.functions import text as T
from scoutline.operators import classify as C
from scoutline.operators import commits, documents, edit_tree, hybrid, memory, navigation, query_language, rust_source, state, text_search, tickets, trigrams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("/a/src/x.rs", "SourceCode"), ("/a/tests/x.rs", "Test"), ("/a/x_test.rs", "Test"), ("/a/test_x.rs", "Test"), ("/a/latest_x.rs", "SourceCode"), ("/a/contest.rs", "SourceCode"),
        ("/a/doc/x.md", "Documentation"), ("/a/x.txt", "Documentation"), ("/a/x.MD", "SourceCode"), ("/a/notes/x.md", "Notes"), ("/a/notes/benchmarks/x.md", "Benchmark"), ("notes/x.rs", "SourceCode"),
    ],
)
def test_document_type(spark, path, want):
    assert one(spark, C.document_type(F.lit(path))) == want


def test_unknown_kind_is_an_error_or_null(spark):
    assert one(spark, C.kind_named(F.lit("FN"))) == "function"
    assert one(spark, C.kind_named(F.lit("nope"), strict=False)) is None
    with pytest.raises(Exception, match="unknown kind"):
        one(spark, C.kind_named(F.lit("nope")))


@pytest.mark.parametrize(("n", "want"), [(10, 1.0), (11, 0.7), (20, 0.7), (21, 0.5)])
def test_hub_penalty(spark, n, want):
    assert one(spark, C.hub_penalty(F.lit(n))) == pytest.approx(want)


@pytest.mark.parametrize(
    ("query", "symbol", "direction"),
    [
        ("Who calls ParseConfig?", "ParseConfig", "callers"), ("callers of `run_all`", "run_all", "callers"), ("SearchIndex callers", "SearchIndex", "callers"),
        ("functions that call foo", "foo", "callers"), ("what does parse_all call?", "parse_all", "callees"), ("plain words", None, None), ("who calls ?", None, None),
    ],
)
def test_caller_questions(spark, query, symbol, direction):
    assert tuple(one(spark, query_language.caller_question(F.lit(query)))) == (symbol, direction)


@pytest.mark.parametrize(
    ("query", "target", "module"),
    [("what modules are in the indexer directory?", "indexer", True), ("what's in service", "service", False), ("structure of the picker module", "picker", True), ("search structure", "search", True), ("module structure", None, None), ("nothing", None, None)],
)
def test_structure_questions(spark, query, target, module):
    assert tuple(one(spark, query_language.structure_question(F.lit(query)))) == (target, module)


@pytest.mark.parametrize(("query", "want"), [("how does x work", "Understand"), ("fix the error", "Modify"), ("buggy", "Search"), ("a bug_here", "Debug"), ("WHERE is it", "FindDefinition"), ("usages", "FindUsages")])
def test_intents(spark, query, want):
    assert one(spark, query_language.intent(F.lit(query))) == want


def osa(a, b, most):
    """Edit distance with transpositions of neighbours at cost 1, each part edited once; most + 1 if it is above most."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if i == 0 or j == 0}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return min(d[len(a), len(b)], most + 1)


@pytest.mark.parametrize("pairs", [edit_tree.PAIRS, 5])
def test_walk_over_a_tree_of_words(monkeypatch, pairs):
    monkeypatch.setattr(edit_tree, "PAIRS", pairs)
    r = random.Random(pairs)
    words = sorted({"".join(r.choices("abé", k=r.randrange(1, 7))) for _ in range(120)})
    asked = ["", "a", *("".join(r.choices("abcé", k=r.randrange(1, 8))) for _ in range(30))]
    for most in (0, 1, 2):
        want = {(q, w, d) for q, a in enumerate(asked) for w, b in enumerate(words) if (d := osa(b, a, most)) <= most}
        got = [*edit_tree.near(edit_tree.Tree(words), asked, most)]
        assert len(got) == len(want) and set(got) == want
    assert [*edit_tree.near(edit_tree.Tree([]), asked, 2)] == [] == [*edit_tree.near(edit_tree.Tree(words), [], 2)]


def test_osa_and_fuzzy_against_all_pairs(spark):
    assert osa("ab", "ba", 2) == 1
    assert osa("ca", "abc", 3) == 3
    assert osa("functon", "function", 2) == 1
    assert osa("abcdef", "uvwxyz", 2) == 3
    r = random.Random(2)
    names = ["".join(r.choice("abc") for _ in range(r.randrange(1, 7))) for _ in range(60)]
    asked = ["".join(r.choice("abc") for _ in range(r.randrange(1, 7))) for _ in range(12)]
    s = table(spark, list(enumerate(names)), "seq long, name string")
    got = {tuple(x) for x in text_search.fuzzy(s, table(spark, list(enumerate(asked)), "qid long, query string")).collect()}
    assert got == {(q, i, d) for q, a in enumerate(asked) for i, n in enumerate(names) if (d := osa(n, a, 2)) <= 2}


def test_as_of_join_takes_the_last_definition_on_ties(spark):
    s = table(spark, [(1, "f", "function", "a", 5), (2, "g", "method", "a", 5), (3, "S", "struct", "a", 6), (4, "h", "function", "b", 1)], "seq long, name string, kind string, file string, line int")
    calls = table(spark, [("x", "a", 4), ("x", "a", 5), ("x", "a", 90), ("x", "b", 1), ("x", "c", 1)], "name string, file string, line int")
    got = {(r.file, r.line): r.caller for r in navigation.enclosing_function(calls, s).collect()}
    assert got == {("a", 4): None, ("a", 5): "g", ("a", 90): "g", ("b", 1): "h", ("c", 1): None}


def test_callee_range_excludes_both_ends(spark):
    d = table(spark, [(1, "f", "function", "a", 37)], "seq long, name string, kind string, file string, line int")
    refs = table(spark, [(f"c{n}", "a", n, 1, "Call") for n in (37, 38, 136, 137)] + [("t", "a", 40, 1, "Type"), ("c38", "a", 99, 1, "Call")], "name string, file string, line int, col int, context string")
    assert {(r.callee, r.line) for r in navigation.callees(d, refs).collect()} == {("c38", 38), ("c136", 136)}


def test_nan_scores_rank_last(spark):
    rows = [(1, "Search", i, i, s, "SourceCode", "function", "f", 0) for i, s in enumerate([1.0, float("nan"), 2.0, float("inf"), 1.0])]
    hits = table(spark, rows, "qid int, intent string, doc int, raw_rank int, score double, document_type string, kind string, name string, n_refs int")
    assert [r.doc for r in text_search.rerank(hits, 5).orderBy("rank").collect()] == [2, 0, 4, 1, 3]


def test_trigrams_of_short_and_wide_texts(spark):
    files = table(spark, [("a", "hello"), ("b", "yellow"), ("c", "né"), ("d", "x")], "path string, content string")
    q = table(spark, [(1, "ello"), (2, "zz"), (3, "né"), (4, "nope")], "qid int, query string")
    got = {(r.qid, r.path) for r in trigrams.expanded(trigrams.candidates(trigrams.index(files), q), files).collect()}
    assert got == {(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (2, "d"), (3, "c")}
    numbered = table(spark, [(0, "hello"), (40_000, "yellow"), (7, "né"), (8, "x"), (40_001, "yellow"), (9, None)], "seq long, content string")
    q = table(spark, [(1, "ello"), (2, "zz"), (3, "né"), (4, "nope"), (5, "yell"), (6, "hellow"), (7, None)], "qid int, query string")
    for most in (100, 0):
        got = {(r.qid, r.id) for r in trigrams.matching(trigrams.bitmaps(numbered), q, most).collect()}
        assert got == {(1, 0), (1, 40_000), (1, 40_001), (2, None), (3, 7), (5, 40_000), (5, 40_001)}
    assert trigrams.stats(trigrams.index(files.limit(0))).first().avg_files == 0.0


def test_changes_and_no_change_set(spark):
    a = table(spark, [("x", 1, 1), ("y", 1, 1), ("z", 1, 1)], "path string, mtime long, size long")
    b = table(spark, [("x", 1, 1), ("y", 2, 1), ("w", 1, 1)], "path string, mtime long, size long")
    assert {tuple(r) for r in state.changes(a, b).collect()} == {("x", "unchanged"), ("y", "modified"), ("z", "deleted"), ("w", "added")}
    assert state.drop_stale(a.withColumnRenamed("path", "file"), None).count() == 0
    with pytest.raises(Exception, match="index version"):
        state.checked_version(table(spark, [(2,)], "version int")).collect()


def test_recent_is_by_session_and_not_by_time(spark):
    rows = [("a", 1, 1), ("a", 9, 2), ("b", 2, 1), ("b", 8, 2)]
    m = table(spark, rows, "session_id string, timestamp long, line_no long")
    assert [(r.session_id, r.timestamp) for r in memory.recent(m, 3).collect()] == [("a", 1), ("a", 9), ("b", 2)]


def test_sprint_keys_out_of_range_sort_last(spark):
    key = lambda s: tuple(one(spark, tickets.sprint_key(F.lit(s))))
    last = (tickets.LARGEST_YEAR, tickets.LARGEST_QUARTER, tickets.LARGEST_NUMBER)
    assert key("Team 3 - Q2 2024") == (2024, 2, 3)
    assert key("Team 70000 - Q2 2024") == key("Team 3 - Q300 2024") == key("Backlog") == last


def test_lanes_of_a_merge(spark):
    c = [("r", 0, "m", ["a", "b"]), ("r", 1, "a", ["z"]), ("r", 2, "b", ["z"]), ("r", 3, "z", [])]
    got = {r.hash: (r.lane, list(r.merge_to), list(r.connectors), r.lane_count) for r in commits.lanes(table(spark, c, "repo string, pos long, hash string, parent_hashes array<string>")).collect()}
    assert got["m"] == (0, [], ["Pipe", "Fork"], 2)
    assert got["a"] == (0, [], ["Pipe", "Pipe"], 2)
    assert got["b"] == (1, [0], ["Pipe", "Pipe"], 1)
    assert got["z"] == (0, [], ["Pipe", "Empty"], 0)


def test_log_lines_of_few_fields_are_an_error(spark):
    with pytest.raises(Exception, match="log line"):
        commits.parse_log(table(spark, [("r", 0, "a\x1fb")], "repo string, pos long, value string")).collect()


def test_markdown_edges(spark):
    text = "```\n# in a fence\n```\n####### seven\n#No space ##\n\n### \nend"
    rows = documents.chunks(table(spark, [("p", text), ("e", ""), ("n", None)], "path string, content string")).orderBy("line").collect()
    assert [(r.path, r.line, r.level, r.title) for r in rows] == [("p", 1, 0, "Introduction"), ("p", 2, 1, "in a fence"), ("p", 5, 1, "No space")]
    assert rows[2].content == "###\nend" or rows[2].content == "### \nend"


def test_rust_edges():
    code = 'struct A;\n/* fn no() {} */\nlet s = "fn nor() {}";\npub(in crate::x) fn f<T>() -> Vec<T> { g::<u8>(1) }\nmacro_rules! m { () => {} }\nstatic mut N: u32 = 1;\nimpl<T> Tr for B<T> { const K: u8 = 1; }\n'
    got = {(r[1], r[2], r[3], r[7]) for r in rust_source.symbols_of("x.rs", code)}
    assert got == {("A", "struct", 1, ""), ("f", "function", 4, ""), ("m", "macro", 5, ""), ("N", "static", 6, ""), ("B", "impl", 7, ""), ("K", "const", 7, "")}
    assert ("g", "Call") in {(r[0], r[6]) for r in rust_source.references_of("x.rs", code)}
    long = "é" * 400
    assert len(rust_source.clipped(long).encode()) <= 503
    assert rust_source.clipped("a b " * 200).endswith("b...") or rust_source.clipped("a b " * 200).endswith("a...")


def test_text_functions(spark):
    assert one(spark, T.file_name(F.lit("/a/b.c.rs"))) == "b.c.rs"
    assert one(spark, T.stem(F.lit("/a/b.c.rs"))) == "b.c"
    assert one(spark, T.ellipsis(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, T.padded(F.lit("ab"), 4)) == "ab  "
    assert one(spark, T.or_dash(F.lit(""))) == "-"
    assert one(spark, T.clipped_bytes(F.lit("aéé"), 4)) == "aé"
    assert one(spark, T.url_encoded(F.lit("a b/ü"))) == "a%20b%2F%C3%BC"


def test_ticket_defaults(spark):
    raw = json.dumps({"issues": [{"key": "A-1", "fields": {"summary": "s"}}]})
    r = tickets.flattened(table(spark, [(raw,), ('{"issues":[]}',), ("{broken",)], "value string")).collect()
    assert [(x.key, x.category, x.priority, x.type, x.assignee, x.sprint, x.project) for x in r] == [("A-1", "new", "Medium", "Task", "Unassigned", None, "A")]


def test_commit_lanes_take_every_event(spark):
    from scoutline.plans.queries import QUERIES
    from scoutline.session import table

    sf = "/root/testdata/sf0.01"
    got = QUERIES["G1_J14_A19_commit_lanes"](spark, sf).select(F.col("hash").cast("long").alias("id")).collect()
    assert sorted(r.id for r in got) == sorted(r.event_id for r in table(spark, sf, "events").select("event_id").collect())


def test_vector_queries_in_blocks(spark):
    rows = [(i, [float((i * k) % 11 - 5) for k in range(1, 9)]) for i in range(1, 60)]
    v = table(spark, rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    near = lambda n: sorted(tuple(r) for r in hybrid.nearest(q, v, 3, n).select("qid", "vec_id", "rank").collect())
    assert near(4) == near(100) and len(near(4)) == 3 * 19
