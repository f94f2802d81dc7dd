"""Paged lists, file events over restarts, timers on processing time, bodies by braces."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from scoutline.operators.documents import symbol_body
from scoutline.sources.paged import folder_transport, linked, numbered, paged_source, read_pages
from scoutline.streaming import events
from scoutline.streaming.events import EventLog, Watcher, changed, listing, project_events, timed_bursts, timed_increases


def chain(n, last=None):
    return lambda at: json.dumps({"values": [at or "0"], "pagelen": 1} | ({"next": str(int(at or 0) + 1)} if int(at or 0) + 1 < n else {} if last is None else {"next": last}))


def test_pages_that_name_the_next():
    assert [v for _, v, _ in linked(chain(3))] == [["0"], ["1"], ["2"]]
    assert [m for *_, m in linked(chain(20))] == [False] * 20
    assert [(n, m) for n, _, m in linked(chain(21))][-1] == (19, True)
    assert len([*linked(chain(3, last="1"))]) == 3
    assert [*linked(lambda at: None)] == [(0, [], False)] == [*linked(lambda at: '["no list"]')] == [*linked(lambda at: '{"values": 7, "next": 3}')]


def test_numbered_pages_end_with_a_short_one():
    pages = lambda sizes: lambda n: json.dumps([0] * sizes[int(n)]) if int(n) < len(sizes) else None
    assert [len(v) for _, v, _ in numbered(pages([2, 2, 1, 2]), 2)] == [2, 2, 1]
    assert [len(v) for _, v, _ in numbered(pages([2, 2]), 2)] == [2, 2, 0]
    assert [m for *_, m in numbered(pages([2, 2, 2]), 2, 2)] == [False, True]


def test_resources_are_partitions_and_filters_are_sent(spark, tmp_path):
    for resource in ("team/a", "b"):
        at = tmp_path / resource.replace("/", "%2F")
        at.mkdir()
        for n in range(25):
            body = {"values": [{"id": n, "state": "OPEN" if n % 2 else "DONE"}]} | ({"next": f"https://host/list?page={n + 1}"} if n < 24 else {})
            (at / ("first.json" if n == 0 else f"{n}.json")).write_text(json.dumps(body))
        (at / "first.state=OPEN.json").write_text(json.dumps({"values": [{"id": i, "state": "OPEN"} for i in range(1, 25, 2)]}))
    source = paged_source("tickets", folder_transport(str(tmp_path)), ("state",))
    rows = read_pages(spark, source, ["team/a", "b"])
    assert rows.rdd.getNumPartitions() == 2
    got = rows.collect()
    assert len(got) == 40 and [r.more for r in got] == ([False] * 19 + [True]) * 2
    open_ = read_pages(spark, source, ["team/a", "b"]).where("state = 'OPEN' and resource = 'b'")
    assert sorted(json.loads(r.value)["id"] for r in open_.collect()) == [*range(1, 25, 2)]
    assert open_.rdd.getNumPartitions() == 1
    assert read_pages(spark, source, ["b"], pages=30).where("more").count() == 0
    assert read_pages(spark, source, ["b", "none"]).where("resource in ('none', 'else')").collect() == []
    folder = tmp_path / "short"
    folder.mkdir()
    for n, size in enumerate([20, 20, 3]):
        (folder / f"{n}.json").write_text(json.dumps([n] * size))
    short = paged_source("short_lists", folder_transport(str(tmp_path)))
    assert read_pages(spark, short, ["short"], kind="numbered").count() == 43
    assert read_pages(spark, short, ["short"], kind="numbered", pages=2).where("more").count() == 1


def write(root, name, text="x", ahead=0):
    (root / name).write_text(text)
    if ahead:
        now = time.time_ns() + ahead * 10**9
        os.utime(root / name, ns=(now, now))


def test_listings_and_their_differences(tmp_path):
    (tmp_path / "p/.git").mkdir(parents=True)
    for name in ("a.rs", "b.py", ".c.rs", ".git/d.rs"):
        (tmp_path / "p" / name).write_text("x")
    now = listing(f"{tmp_path}/p/")
    assert [*now] == ["/a.rs"]
    assert changed({"/x": [1, 1], "/y": [1, 1], "/z": [1, 1]}, {"/x": [1, 1], "/y": [2, 1], "/n": [1, 1]}) == [("/n", "created"), ("/y", "modified"), ("/z", "deleted")]


def test_a_restart_neither_loses_nor_repeats_an_event(spark, tmp_path):
    root, log = tmp_path / "p", f"{tmp_path}/log"
    root.mkdir()
    write(root, "old.rs")
    got = []

    def run(handed=lambda rows, n: got.extend((r.path, r.kind) for r in rows.collect())):
        q = project_events(spark, str(root), log).writeStream.foreachBatch(handed).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
        try:
            end = time.monotonic() + 12
            while time.monotonic() < end and q.isActive and not got:
                time.sleep(0.1)
        finally:
            q.stop()
        return [got.pop() for _ in range(len(got))][::-1]

    def failing(rows, n):
        raise RuntimeError("stopped")

    time.sleep(0.1)
    EventLog(log).write(0, {"files": listing(str(root)), "events": []})  # the listing at the first start
    write(root, "new.rs")
    assert run() == [("/new.rs", "created")]
    write(root, "old.rs", "longer", 2)  # while nothing runs
    with pytest.raises(Exception, match="stopped"):
        q = project_events(spark, str(root), log).writeStream.foreachBatch(failing).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
        q.awaitTermination(15)
    (root / "new.rs").unlink()
    first = run()
    seen = first if len(first) == 2 else first + run()
    assert seen == [("/old.rs", "modified"), ("/new.rs", "deleted")]


def test_a_watcher_polls_and_waits(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    w = Watcher(spark, str(root), f"{tmp_path}/w", "200 milliseconds")
    try:
        deadline = time.monotonic() + 15
        while not (tmp_path / "w/log/0.json").exists() and time.monotonic() < deadline:
            time.sleep(0.05)
        assert w.poll().collect() == []
        write(root, "a.md")
        assert [(r.path, r.kind) for r in w.wait(20).collect()] == [("/a.md", "created")]
        assert w.poll().collect() == [] == w.wait(0.3).collect()
    finally:
        w.stop()


def drained(query, made, wanted, seconds=25):
    end = time.monotonic() + seconds
    while time.monotonic() < end and query.isActive and len(made) < wanted:
        time.sleep(0.1)
    query.stop()
    return made


@pytest.fixture
def few_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def test_a_burst_ends_without_a_later_event(spark, tmp_path, few_partitions):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("".join(json.dumps({"project": "p", "path": x}) + "\n" for x in ("b", "a", "b")))
    stream = spark.readStream.schema("project string, path string").json(f"{tmp_path}/in")
    made = []
    q = timed_bursts(stream, "project").writeStream.foreachBatch(lambda df, _: made.extend(tuple(r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(processingTime="200 milliseconds").start()
    assert drained(q, made, 1) == [("p", 3, ["a", "b"])]


def test_an_increase_is_told_once_after_the_pause(spark, tmp_path, few_partitions):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("repo string, mtime long").json(f"{tmp_path}/in")
    made = []
    q = timed_increases(stream, "repo").writeStream.foreachBatch(lambda df, _: made.extend(tuple(r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(processingTime="200 milliseconds").start()
    (tmp_path / "in/1.json").write_text('{"repo": "r", "mtime": 5}\n{"repo": "s", "mtime": 1}\n')
    time.sleep(2)
    (tmp_path / "in/2.json").write_text('{"repo": "r", "mtime": 7}\n{"repo": "s", "mtime": 1}\n')
    assert drained(q, made, 1) == [("r", 7)]


def test_mtime_of_a_repository(tmp_path):
    assert events.repository_mtime(str(tmp_path)) == 0
    (tmp_path / ".git/refs").mkdir(parents=True)
    (tmp_path / ".git/HEAD").write_text("x")
    os.utime(tmp_path / ".git/HEAD", ns=(1, 2_000_000_000_000_000_000))
    assert events.repository_mtime(str(tmp_path)) == 2_000_000_000_000_000_000


def test_bodies(spark):
    plain = [f"l{i}" for i in range(60)]
    cases = [
        (["fn f() {", "  x", "}", "rest"], 1, ["fn f() {", "  x", "}"]),
        (["fn f()", "{ { }", "}", "rest"], 1, ["fn f()", "{ { }", "}"]),
        (["}", "a {}", "b"], 2, ["a {}"]),
        (["} {", "a"], 1, ["} {"]),
        (["{", *plain], 1, ["{", *plain[:50]]),
        (["{", *plain[:50], "}"], 1, ["{", *plain[:50], "}"]),
        (plain[:15], 3, plain[2:12]),
        (plain[:4], 2, plain[1:4]),
        (plain[:4], 9, [""]),
        (["{", "a"], 1, ["{", "a"]),
    ]
    rows = spark.createDataFrame([(i, "\n".join(t), n) for i, (t, n, _) in enumerate(cases)] + [(99, None, 1)], "i int, t string, n int")
    got = {r.i: r.b for r in rows.select("i", symbol_body(F.col("t"), F.col("n")).alias("b")).collect()}
    assert got == {i: "\n".join(w) for i, (*_, w) in enumerate(cases)} | {99: None}
