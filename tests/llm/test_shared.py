import gc
import time

import pyarrow as pa
import pytest

from scoutline.llm import shared
from scoutline.llm.shared import Scratch, connected_components, gathered, parts, small


def test_batches_are_cut_and_gathered():
    values = lambda batches: [x for b in batches for x in b.column("a").to_pylist()]
    batches = [pa.RecordBatch.from_pydict({"a": pa.array(range(i, i + 300), pa.int64())}) for i in range(0, 3000, 300)]
    empty = pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64())})
    assert values(parts([*batches, empty])) == list(range(3000)) == values(gathered([empty, *batches, empty], 700))
    assert max(b.num_rows for b in parts(batches)) == 256 and [b.num_rows for b in gathered(batches, 700)] == [900, 900, 900, 300]
    assert values(gathered([], 5)) == [] == values(gathered([empty], 0))


def test_scratch_tables_go_when_dropped_and_at_the_end(spark):
    with Scratch(spark) as scratch:
        a, b = scratch.save(spark.range(5)), scratch.save(spark.range(7))
        kept = scratch.keep(b)
        scratch.drop(a)
        with pytest.raises(Exception, match="(?i)exist"):
            a.count()
        assert b.count() == 7
    assert kept.count() == 7
    with pytest.raises(Exception, match="(?i)exist"):
        b.count()


def test_checkpoints_go_with_what_refers_to_them(spark):
    def files():
        root = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
        return {s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root) if s.getPath().getName().startswith("rdd-")}

    with Scratch(spark) as scratch:
        scratch.keep(spark.range(3)).count()
        before = files()
        kept = scratch.keep(spark.range(5))
        new = files() - before
    assert new and kept.count() == 5
    del kept
    for _ in range(60):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if not new & files():
            break
        time.sleep(0.5)
    assert not new & files()


def test_only_tables_of_checked_size_are_broadcast(spark, monkeypatch):
    with Scratch(spark) as scratch:
        t, big = scratch.save(spark.range(5)), spark.range(100)
        plan = lambda rows: big.join(small(t, rows), "id")._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan(5) and "strategy=broadcast" not in plan(4)


def test_components_of_a_long_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (7, 7), (200, 150), (150, 170), (170, 200)]
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
        assert got == {i: 0 for i in range(61)} | dict.fromkeys((150, 170, 200), 150)
        assert connected_components(spark.createDataFrame([], "a long, b long"), scratch).collect() == []


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
