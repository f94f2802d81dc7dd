import random

from pyspark.sql import functions as F

from scoutline.llm.url_list import intervals, keys, listed_captures


def test_keys(spark):
    k = lambda u: sorted(spark.range(1).select(keys(F.lit(u)).alias("k")).first().k)
    assert k("http://1.2.3.4/a/b") == ["1.2.3.4", "1.2.3.4/a"] and k("https://1.2.3.4:80") == ["1.2.3.4"]
    assert k("http://10.1.2.3.org") == ["1.2.3.org", "10.1.2.3.org", "2.3.org", "3.org"]
    assert k("https://me@A.b.example.com:8080/x/y?z") == ["a.b.example.com", "a.b.example.com/x", "b.example.com", "example.com"]
    assert k("http://localhost") == ["localhost"]
    assert k("nonsense") == []


def test_intervals(spark):
    e = spark.createDataFrame([("k", 5, True), ("k", 9, False), ("k", 9, True), ("k", 20, True), ("k", 30, True), (None, 1, True), ("j", None, True), ("j", 3, None)], "key string, at long, listed boolean")
    assert sorted(((r.since, r.until) for r in intervals(e).collect()), key=str) == sorted([(5, 9), (20, 30), (30, None)], key=str)


def test_against_replay(spark):
    r = random.Random(6)
    names = ["a.com", "b.a.com", "b.a.com/p", "c.com/q"]
    entries = [(r.choice(names), r.randrange(-50, 300), r.random() < 0.6) for _ in range(60)]
    captures = [(i, r.choice(["http://a.com/", "http://b.a.com/p/1", "http://b.a.com/x", "http://c.com/q", "http://d.com"]), r.randrange(-80, 400)) for i in range(200)]
    captures += [(900, None, 5), (901, "http://a.com/", None), (902, "http://a.com/", 100), (902, "http://a.com/", 100)]
    got = sorted((x.id, x.blocked, x.matched_key, x.n_active) for x in listed_captures(spark.createDataFrame([(*c, "k") for c in captures], "id long, url string, at long, key string"), spark.createDataFrame(entries, "key string, at long, listed boolean")).collect())

    def state(key, at):
        past = [(t, on) for k, t, on in entries if k == key and t <= at]
        return bool(past) and all(on for t, on in past if t == max(past)[0])

    def own(url):
        host, _, rest = url.removeprefix("http://").partition("/")
        labels = host.split(".")
        return [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))] + ([f"{host}/{rest.split('/')[0]}"] if rest.split("/")[0] else [])

    want = []
    for i, url, at in captures:
        active = sorted(k for k in own(url) if state(k, at)) if url and at is not None else []
        want.append((i, bool(active), active[0] if active else None, len(active)))
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2] or "", x[3]))
    assert listed_captures(spark.createDataFrame([], "id long, url string, at long"), spark.createDataFrame(entries, "key string, at long, listed boolean")).collect() == []
    assert listed_captures(spark.createDataFrame(captures, "id long, url string, at long"), spark.createDataFrame([], "key string, at long, listed boolean")).where("blocked").count() == 0


def test_hosts_of_many_labels(spark):
    for host in ("a.b.c.d.e.f.example.com", ".".join("a" * 125) + ".example.com"):
        captures = spark.createDataFrame([(1, f"http://{host}/x", 5), (2, f"http://{host}/x", 9)], "id long, url string, at long")
        got = [k for k in captures.select(keys(F.col("url")).alias("k")).first().k if "/" not in k]
        labels = host.split(".")
        assert sorted(got) == sorted(".".join(labels[i:]) for i in range(len(labels) - 1))
        entries = spark.createDataFrame([("example.com", 1, True), ("example.com", 8, False)], "key string, at long, listed boolean")
        assert sorted((r.id, r.matched_key) for r in listed_captures(captures, entries).collect()) == [(1, "example.com"), (2, None)]


def test_seconds_and_hot_keys(spark, monkeypatch):
    year = 365 * 86_400
    entries = spark.createDataFrame([("a.com", 1_600_000_000 + i * year, i % 2 == 0) for i in range(6)], "key string, at long, listed boolean")
    captures = spark.createDataFrame([(i, f"http://a.com/{i}", 1_600_000_000 + i * year // 50) for i in range(-20, 300)], "id long, url string, at long")
    want = [(i, 0 <= i and i // 50 % 2 == 0) for i in range(-20, 300)]
    for hot in (7, 100_000):
        monkeypatch.setattr("scoutline.llm.url_list.HOT", hot)
        assert sorted((r.id, r.blocked) for r in listed_captures(captures, entries).collect()) == want
