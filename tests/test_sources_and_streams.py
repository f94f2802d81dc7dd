import subprocess

import pytest
from pyspark.sql import functions as F

from scoutline.sources import project, sinks
from scoutline.streaming import watch


def test_project_scan_and_rust_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rs").write_text("fn main() {}\n")
    (tmp_path / "src/b.PY").write_text("x")
    (tmp_path / ".hid").mkdir()
    (tmp_path / ".hid/c.rs").write_text("x")
    (tmp_path / "d.MD").write_text("# x")
    (tmp_path / "big.txt").write_text("x" * (project.MOST_BYTES + 1))
    (tmp_path / "even.txt").write_text("x" * project.MOST_BYTES)
    base = str(tmp_path)
    found = project.discover(project.read_files(spark, base).withColumn("path", F.replace("path", F.lit(base), F.lit(""))))
    assert sorted(r.path for r in found.collect()) == ["/d.MD", "/even.txt", "/src/a.rs"]


def test_interactions_round_trip_and_bad_lines(spark, tmp_path):
    rows = [("1", 5, "s", {"text": "q", "command": None, "files": ["f"]}, {"type": "Answer", "text": "a", "changes": None})]
    df = spark.createDataFrame(rows, project.INTERACTION)
    sinks.append_interactions(df, f"{tmp_path}/m")
    sinks.append_interactions(df, f"{tmp_path}/m")
    (tmp_path / "m/session=s/x.json").write_text('\n{broken\n{"id":"2","timestamp":1,"session_id":"s"}\n')
    assert sorted(r.id for r in project.read_interactions(spark, f"{tmp_path}/m").collect()) == ["1", "1", "2"]


def test_index_replaces_and_clears_by_file(spark, tmp_path):
    folder = f"{tmp_path}/index"
    s = lambda *rows: spark.createDataFrame(list(rows), "file string, name string")
    sinks.write_index(s(("a.rs", "x"), ("b.rs", "y"), ("c.rs", "z")), folder)
    sinks.replace_files(spark, s(("b.rs", "new")), spark.createDataFrame([("c.rs",)], "file string"), folder)
    assert {tuple(r) for r in spark.read.parquet(folder).select("file", "name").collect()} == {("a.rs", "x"), ("b.rs", "new")}
    sinks.write_state(spark, s(("a.rs", "x")), f"{tmp_path}/state")
    assert sinks.read_state(spark, f"{tmp_path}/state").count() == 1
    with pytest.raises(Exception, match="index version"):
        sinks.read_state(spark, f"{tmp_path}/state", 9).collect()
    sinks.clear(spark, folder)
    assert not (tmp_path / "index").exists()
    (tmp_path / "own").mkdir()
    (tmp_path / "own/file").write_text("x")
    with pytest.raises(ValueError, match="more than an index"):
        sinks.clear(spark, f"{tmp_path}/own")


def test_git_log(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x.org", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    run("commit", "--allow-empty", "-m", "one")
    run("commit", "--allow-empty", "-m", "two")
    rows = project.git_log(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.message, len(r.parent_hashes)) for r in rows] == [("two", 1), ("one", 0)]
    assert rows[0].refs == ["main"]


def test_short_page_ends_the_list(spark):
    pages = spark.createDataFrame([(0, "[1,2]"), (1, "[3]"), (2, "[4,5]")], "page int, body string")
    assert sorted(r.value for r in project.short_pages(pages, "int", 2).collect()) == [1, 2, 3]


def test_bursts_stream_to_a_flush(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [("p", "a", "2024-01-01 00:00:00.000"), ("p", "b", "2024-01-01 00:00:00.499"), ("p", "c", "2024-01-01 00:00:00.999"), ("p", "z", "2024-01-01 01:00:00.000")]
    (tmp_path / "in/1.json").write_text("\n".join(f'{{"project":"{p}","path":"{x}","ts":"{t}"}}' for p, x, t in lines))
    stream = spark.readStream.schema("project string, path string, ts timestamp").json(f"{tmp_path}/in")
    got = []
    q = watch.bursts(stream, "project", "path").writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert sorted(r.paths for r in got) == [["a", "b"], ["c"]]


def test_saved_results_and_migration(spark, tmp_path):
    made = []

    def fetch():
        made.append(1)
        return spark.createDataFrame([("ABC",)], "key string")

    for _ in range(2):
        assert [r.key for r in sinks.aside(spark, f"{tmp_path}/keys", "key string", fetch).collect()] == ["ABC"]
    assert made == [1] and sinks.cached(spark, f"{tmp_path}/none", "key string") is None
    (tmp_path / "refs.json").write_text('[{"name": "f", "file": "a.rs", "line": 1}, {"name": "g", "file": "b.rs", "line": 2}]')
    schema = "name string, file string, line int"
    assert sinks.migrate_references(spark, f"{tmp_path}/refs.json", f"{tmp_path}/refs", schema)
    assert not sinks.migrate_references(spark, f"{tmp_path}/refs.json", f"{tmp_path}/refs", schema) and not (tmp_path / "refs.json").exists()
    assert sorted(r.name for r in spark.read.parquet(f"{tmp_path}/refs").collect()) == ["f", "g"]


def test_trigrams_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("a", "abcd"), ("b", "é")], "path string, content string")
    sinks.write_trigrams(files, f"{tmp_path}/t")
    assert sorted((r.path, r.tri) for r in sinks.read_trigrams(spark, f"{tmp_path}/t").collect()) == [("a", "616263"), ("a", "626364")]


def test_files_of_one_bucket_are_told_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "BUCKETS", 1)
    s = lambda *rows: spark.createDataFrame(list(rows), "file string, name string")
    folder = f"{tmp_path}/i"
    sinks.write_index(s(("a/b", "x"), ("a__b", "y")), folder)
    sinks.replace_files(spark, s(), spark.createDataFrame([("a/b",)], "file string"), folder)
    assert [tuple(r) for r in spark.read.parquet(folder).select("file", "name").collect()] == [("a__b", "y")]
    sinks.replace_files(spark, s(), spark.createDataFrame([("a__b",)], "file string"), folder)
    assert not list((tmp_path / "i").glob("bucket=*"))


def test_a_dirty_result_is_made_anew(spark):
    n = []
    d = watch.Dirty(lambda: n.append(1) or spark.range(len(n)))
    assert d.get().count() == 1 == d.get().count()
    d.mark()
    assert d.get().count() == 2 and len(n) == 2


def test_saved_bitmaps(spark, tmp_path):
    files = spark.createDataFrame([(f"/f{i}", f"text number {i} of many") for i in range(50)] + [("/n", None)], "path string, content string").repartition(5)
    sinks.write_bitmaps(files, f"{tmp_path}/t")
    asked = spark.createDataFrame([(1, "number 7 "), (2, "er 4"), (3, "x"), (4, "absent")], "qid long, query string")
    got = sorted((r.qid, r.path) for r in sinks.search_bitmaps(spark, f"{tmp_path}/t", asked).collect())
    want = [(1, "/f7")] + [(2, f"/f{i}") for i in range(50) if f"er {i} ".startswith("er 4")] + [(3, None)]
    assert got == sorted(want)
