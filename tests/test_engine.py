import json
import time

import pytest

from scoutline.plans import engine
from scoutline.plans.engine import Engine
from scoutline.plans.tools import Tools
from scoutline.sources import versions
from scoutline.sources.project import INTERACTION

LIB = """//! Small library
pub struct Store { items: u32 }
impl Store {
    /// Adds one
    pub fn add_item(&mut self) { helper(); }
}
fn helper() { }
pub fn run_all() { let s = Store::new(); s.add_item(); helper(); }
"""


def test_a_project_from_scan_to_answers(spark, tmp_path):
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "src/lib.rs").write_text(LIB)
    (root / "README.md").write_text("# Store\nHow items are stored\n")
    e = Engine(spark, str(root), str(tmp_path / "index"))
    assert e.index() == {"parsed": 2, "removed": 0}
    assert e.index() == {"parsed": 0, "removed": 0}
    assert {(r.fqn, r.kind) for r in e.goto("add_item").collect()} == {("add_item", "function"), ("Store::add_item", "method")}
    assert {r.caller for r in e.search("who calls helper").collect()} == {"add_item", "run_all"}
    assert [r.name for r in e.search("helper", 1).collect()] == ["helper"]
    assert "helper" in {r.name for r in e.search("helpr", fuzzy=True).collect()}
    assert {r.kind for r in e.search("x", kind="struct").collect()} == {"struct"}
    assert e.search("zzz").collect() == []
    assert {r.callee for r in e.callees("run_all").collect()} == set()
    assert e.references("helper", True).count() == 3
    assert e.info("helper")["refs"].first().calls == 2
    assert {r.name for r in e.list_symbols("lib.rs", "field").collect()} == {"items"}

    (root / "src/lib.rs").write_text("fn other() {}\n")
    (root / "README.md").unlink()
    assert e.index() == {"parsed": 1, "removed": 1}
    assert [r.name for r in e.symbols().collect()] == ["other"]
    assert e.refs().count() == 0
    assert e.stats().first().definitions == 1

    assert [r.name for r in e.search('"fn other"').collect()] == ["other"] and e.search("+other -fn").collect() == []
    assert (e.index_stats().first().files, e.index_stats().first().symbols) == (1, 1)

    e.remember(spark.createDataFrame([("1", 5, "s", {"text": "store items"}, {"type": "Answer", "text": "yes"}), ("2", 6, "t", {"text": "other"}, {"type": "Answer", "text": "no"})], INTERACTION))
    assert [r.id for r in e.memory_search("items").collect()] == ["1"]
    assert "fn other" in e.search("other", full=True).first().content and set(e.info("other", {"code"})) == {"definitions", "code"}
    assert [r.id for r in e.memory_recent(1).collect()] == ["2"]
    assert e.memory_stats().first().total == 2 == e.memory_stats(saved=True).first().total
    assert [r.id for r in e.memory_search("input_text:items -yes").collect()] == []
    e.add("what is new", "nothing", "u")
    assert e.memory_stats().first().total == 3
    e.clear()


class Crash(Exception):
    pass


def crashing(monkeypatch, store, name, at):
    """The at-th call of a method of the store fails; returns the calls."""
    calls, real = [], getattr(store, name)

    def call(*a, **k):
        calls.append(a)
        if len(calls) == at:
            raise Crash
        return real(*a, **k)

    monkeypatch.setattr(store, name, call)
    return calls


@pytest.mark.parametrize(("name", "at"), [("stage", 4), ("stage", 7), ("_write", 1), ("clean", 1)])
def test_an_update_that_stops_anywhere_leaves_the_index_whole(spark, tmp_path, name, at):
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "src/a.rs").write_text("fn first() {}\nfn second() { first(); }\n")
    (root / "src/b.rs").write_text("fn stays() {}\n")
    e = Engine(spark, str(root), str(tmp_path / "index"))
    e.index()
    rows = lambda: (sorted(r.name for r in e.symbols().collect()), sorted(r.name for r in e.refs().collect()), sorted((r.field, r.n, r.total) for r in e.totals().collect()), sorted(r.path for r in e.state().collect()))
    before, number = rows(), e.store.manifest()["number"]
    (root / "src/a.rs").write_text("fn third() {}\n")
    (root / "src/b.rs").unlink()
    (root / "src/c.rs").write_text("fn fourth() { third(); }\n")
    with pytest.MonkeyPatch.context() as m:
        calls = crashing(m, e.store, name, at)
        with pytest.raises(Crash):
            e.index()
        assert len(calls) == at
    done = name == "clean"  # the manifest is there by then
    assert (rows() == before) != done and e.store.manifest()["number"] == number + done
    assert e.index() == ({"parsed": 0, "removed": 0} if done else {"parsed": 2, "removed": 1})
    assert rows()[0] == ["fourth", "third"] and rows()[1] == ["third"] and rows()[3] == ["/src/a.rs", "/src/c.rs"]
    name_, = [r for r in e.totals().collect() if r.field == "name"]
    assert (name_.n, name_.total) == (2, 2)
    kept = {f.split("/")[1] for folders in e.store.manifest()["tables"].values() for f in folders}
    assert {p.name for p in (tmp_path / "index/index").glob("*/*") if p.is_dir()} >= kept
    assert not [*(tmp_path / "index/index").glob("parsed/*")]


def test_two_writers_cannot_commit_the_same_number(spark, tmp_path):
    a, b = (versions.Store(spark, str(tmp_path / "s")) for _ in range(2))
    since = a.manifest()
    b.commit({"t": b.stage("t", spark.range(3))}, since=since)
    with pytest.raises(OSError, match="someone else"):
        a.commit({"t": []}, since=since)
    assert a.read("t", "id long").count() == 3 and a.read("none", "id long").count() == 0
    assert versions.buckets_for(0) == 1 and versions.buckets_for(65 << 20) == 2 and versions.buckets_for(1 << 60) == versions.MOST_BUCKETS


def test_each_changed_file_is_parsed_once(spark, tmp_path, monkeypatch):
    root = tmp_path / "p"
    root.mkdir()
    for i in range(4):
        (root / f"f{i}.rs").write_text(f"fn f{i}() {{ f{i}(); }}\n")
    e = Engine(spark, str(root), str(tmp_path / "index"))
    seen = spark.sparkContext.accumulator(0)
    real = engine.rust_source.symbols

    def counted(code):
        def passed(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return real(code.mapInArrow(passed, code.schema))

    monkeypatch.setattr(engine.rust_source, "symbols", counted)
    e.index()
    assert seen.value == 4
    (root / "f1.rs").write_text("fn g() {}\n")
    e.index()
    assert seen.value == 5


def test_memory_segments_are_searched_together_and_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engine, "SEGMENTS", 3)
    e = Engine(spark, str(tmp_path), str(tmp_path / "index"))
    rows = [(str(i), i, "s", {"text": f"word{i} common"}, {"type": "Answer", "text": "rare" if i == 2 else "plain"}) for i in range(5)]
    for r in rows:
        e.remember(spark.createDataFrame([r], INTERACTION))
        assert len(e.recalled.manifest()["tables"]["docs"]) <= 2
    assert {r.id for r in e.memory_search("common").collect()} == {"0", "1", "2", "3", "4"}
    assert [r.id for r in e.memory_search("+input_text:common +rare").collect()] == ["2"]
    whole = Engine(spark, str(tmp_path), str(tmp_path / "other"))
    whole.remember(spark.createDataFrame(rows, INTERACTION))
    scores = lambda x: {r.id: round(r.score, 9) for r in x.memory_search("common rare word3").collect()}
    assert scores(e) == scores(whole)
    with pytest.MonkeyPatch.context() as m:
        crashing(m, e, "_segment", 1)
        with pytest.raises(Crash):
            e.remember(spark.createDataFrame([("9", 9, "s", {"text": "lost"}, {"type": "Answer", "text": "x"})], INTERACTION))
    assert e.memory_search("lost").collect() == [] and e.repair_memory() == 1 and e.repair_memory() == 0
    assert [r.id for r in e.memory_search("lost").collect()] == ["9"]


def test_ignored_files_are_not_indexed(spark, tmp_path):
    root = tmp_path / "p"
    (root / "src/gen").mkdir(parents=True)
    for name in ("src/a.rs", "src/gen/b.rs", "src/gen/keep.rs", "notes.md", "draft.md"):
        (root / name).write_text("fn x() {}\n")
    (root / ".gitignore").write_text("# generated\ngen/*.rs\n/draft.md\n")
    (root / "src/.ignore").write_text("!keep.rs\n")
    e = Engine(spark, str(root), str(tmp_path / "index"))
    # gen/*.rs has a slash inside, and so is tied to the folder of its file.
    assert sorted(r.path for r in e.files().collect()) == ["/notes.md", "/src/a.rs", "/src/gen/b.rs", "/src/gen/keep.rs"]
    (root / ".gitignore").write_text("**/gen/*.rs\n")
    assert sorted(r.path for r in e.files().collect()) == ["/draft.md", "/notes.md", "/src/a.rs", "/src/gen/keep.rs"]


def test_changes_reach_the_index(spark, tmp_path):
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "src/lib.rs").write_text(LIB)
    e = Engine(spark, str(root), str(tmp_path / "index"))
    e.index()
    seen = []
    q = e.watch(lambda events, counts: seen.append((sorted((r.path, r.kind) for r in events.collect()), counts)), f"{tmp_path}/c", "1 second")
    try:
        (root / "src/new.rs").write_text("fn fresh() {}\n")
        (root / "src/x.lock").write_text("x")
        for _ in range(120):
            if seen:
                break
            time.sleep(1)
    finally:
        q.stop()
    assert seen == [([("/src/new.rs", "created")], {"parsed": 1, "removed": 0})]
    assert "fresh" in {r.name for r in e.symbols().collect()}


def test_tools_answer_lines(spark, tmp_path):
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "src/lib.rs").write_text(LIB)
    e = Engine(spark, str(root), str(tmp_path / "index"))
    e.index()
    tickets = spark.createDataFrame([("A-1", "Fix it", None, "s", "active", 1.0, 1), ("B-2", "Other", "Jo", None, None, None, 2)], "key string, summary string, assignee string, sprint string, sprint_state string, points double, pos long")
    issues = spark.createDataFrame([(1, "high", 80, "open", "r", "sca"), (2, "low", 10, "closed", "r", "sca")], "id long, severity string, severity_score int, status string, repo string, type string")
    pages = spark.createDataFrame([(0, '{"values":["x","y"],"next":"z"}')], "page int, body string")
    tools = Tools(e, tickets, issues, {"branches": pages})

    def ask(name, /, **arguments):
        got = json.loads(next(tools.serve([json.dumps({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})])))
        return [json.loads(x["text"]) for x in got["result"]["content"]]

    assert {x["caller"] for x in ask("code_callers", name="helper")} == {"add_item", "run_all"}
    assert ask("code_info", name="add_item") == ask("code_goto", name="add_item")[:1]
    assert [x["key"] for x in ask("tickets_search", query="FIX")] == ["A-1"] and ask("tickets_board")[0]["tickets"] == 2
    assert [x["id"] for x in ask("security_list")] == [1] and ask("security_repos") == [{"repo": "r", "n": 1}]
    assert [x["value"] for x in ask("repo_branches")] == ["x", "y"]
    out = [json.loads(x) for x in tools.serve(['{"id": 1, "method": "tools/list"}', "nonsense", '{"method": "initialized"}', '{"id": 2, "method": "tools/call", "params": {"name": "none"}}', '{"id": 3, "method": "other"}'])]
    assert {"name": "code_search"} in out[0]["result"]["tools"]
    assert [x["error"]["code"] for x in out[1:]] == [-32700, -32602, -32601]
